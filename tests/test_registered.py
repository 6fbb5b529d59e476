"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from checks import registry
from checks.compare import digest

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_sql_belongs_to_a_query():
    assert set(registry.oracles()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, database, name):
    frame = registry.queries()[name](spark, SF_DIR)
    mine = digest(frame.columns, frame.collect())
    if name not in registry.oracles():
        assert mine[0] > 0
        return
    cursor = database.execute(registry.oracles()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert mine == digest(columns, cursor.fetchall())
