"""One key holding most rows: same results, and plans that do not gather it."""

from pyspark.sql import functions as F

from cuesift.operators.ranking import result_page, top_segments
from cuesift.operators.tagging import link_tags
from cuesift.operators.trigram import gram_blocks, write_blocks
from cuesift.session import fits_broadcast, salted_join


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_salted_join_equals_the_plain_one_and_shares_a_hot_key(spark):
    many = spark.range(4000).select(F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id")).alias("k"), "id")
    one = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_anti", "left_semi"):
        plain = many.join(one.where("k <> 3"), ["k"], how)
        salted = salted_join(many, one.where("k <> 3"), ["k"], how, F.col("id"))
        assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = salted_join(many, one, ["k"], "inner", F.col("id"))
        sizes = [r["count"] for r in joined.where("k = 0").groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 1 and max(sizes) < 2800
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_top_rows_are_cut_before_the_shuffle(spark):
    hits = spark.range(3000).select(
        F.when(F.col("id") < 5000, 0).otherwise(1).cast("long").alias("query_id"),
        F.when(F.col("id") < 2900, 1).otherwise(2).cast("long").alias("asset_id"),
        F.col("id").alias("segment_id"),
        (-F.col("id").cast("double")).alias("rank"),
    )
    best = top_segments(hits, 5)
    assert [r.segment_id for r in best.where("asset_id = 1").orderBy("n").collect()] == [2899, 2898, 2897, 2896, 2895]
    candidates = hits.select(
        "query_id", F.col("segment_id").alias("asset_id"), F.lit(2).alias("tier"), F.lit(0).alias("n_terms"),
        F.col("rank").alias("best_rank"),
    )
    for frame in (best, result_page(candidates, limit=3)):
        plan = plan_of(frame)
        assert plan.index("Final") < plan.index("Partial") and "WindowGroupLimit" in plan
    assert [r.asset_id for r in result_page(candidates, limit=3).orderBy("position").collect()] == [2999, 2998, 2997]


def test_one_tag_asked_for_everywhere(spark):
    assets = spark.range(500).select(F.col("id").alias("asset_id"))
    tags = spark.createDataFrame([], "tag_id long, name string, name_key string, color string")
    links = spark.createDataFrame([], "asset_id long, tag_id long")
    asked = spark.range(2000).select(
        F.col("id").alias("request_id"),
        (F.col("id") % 500).alias("asset_id"),
        F.when(F.col("id") % 3 == 0, "热门").otherwise(F.concat(F.lit("t"), F.col("id") % 7)).alias("name"),
        F.lit(None).cast("string").alias("color"),
        F.lit("manual").alias("source"),
        F.lit(0).cast("long").alias("created_at"),
    )
    out = link_tags(assets, tags, links, asked)
    rows = {r.request_id: r for r in out.requests.collect()}
    seen, made = set(), set()
    for i in range(2000):
        name = "热门" if i % 3 == 0 else f"t{i % 7}"
        assert rows[i].already_linked == ((i % 500, name) in seen) and rows[i].tag_created == (name not in made)
        seen.add((i % 500, name))
        made.add(name)
    assert out.new_tags.count() == 8 and out.new_links.count() == len(seen)


def test_a_common_gram_is_written_by_several_tasks(spark, tmp_path):
    segments = spark.range(400).select(
        F.col("id").alias("segment_id"), F.lit(1).cast("long").alias("asset_id"), F.lit("aaaaaa").alias("text")
    )
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB"}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        write_blocks(gram_blocks(segments, 10), str(tmp_path / "p"), buckets=2)
    finally:
        for key in small:
            spark.conf.unset(key)
    assert len(list((tmp_path / "p").glob("gram_bucket=*"))) == 1
    assert len(list((tmp_path / "p").glob("gram_bucket=*/*.parquet"))) > 1
    stored = spark.read.parquet(str(tmp_path / "p"))
    entries = stored.selectExpr("inline(entries)")
    assert entries.count() == 400 and entries.where("positions = array(0, 1, 2, 3)").count() == 400


def test_the_size_check_reads_no_more_than_it_needs(spark):
    assert fits_broadcast(spark.range(10), 10) and not fits_broadcast(spark.range(11), 10)
