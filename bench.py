"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query
runs over the whole tables and is written to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from checks import adapters, registry, searches  # noqa: E402

from cuesift.operators.trigram import GramIndex, segment_stats  # noqa: E402
from cuesift.plans.search import Catalogue, one_query, search, search_page  # noqa: E402
from cuesift.session import build_session  # noqa: E402

# Read the source tables.
INGEST = [
    "segment_documents",
    "trigram_index",
    "srt_round_trip",
    "redact_documents",
    "manifest_diff",
    "ngram_stats",
    "suggest_keywords",
    "extraction_worklist",
    "link_tags",
    "derive_status",
    "prompt_batch",
]

# Read the stored catalogue, as a search service does; the batches ask two words of each passage.
SERVE = [
    "search_ranked",
    "search_batch",
    "search_batch_scan",
    "search_batch_top",
    "recall_segments_indexed",
    "recall_segments_matched",
    "recall_segments_scan",
    "bm25_segments",
    "top_segments_per_asset",
    "recall_names",
    "recall_tags",
]


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 3)


def drain(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = set(sys.argv[1:])
    queries = registry.queries()
    # start the engine on something that is not measured
    drain(adapters.table(spark, sf_dir, "nation"))
    times: dict[str, float] = {}

    def measure(names: list[str], made) -> None:
        for name in names:
            if not wanted or name in wanted:
                times[name] = timed(lambda name=name: drain(made(name)))

    measure(INGEST, lambda name: queries[name](spark, sf_dir))
    kept, took = store_catalogue(spark, sf_dir)
    times.update(took)
    asked = two_words(spark, sf_dir)
    measure(SERVE, lambda name: adapters.SERVED[name](kept, asked))
    times.update(indexed_pages(spark, kept))
    print(
        json.dumps(
            {
                "metric": "total wall clock of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


def two_words(spark, sf_dir: str):
    """``query_id, query``: the two longest words of each benchmark passage."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    keyed = F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
    longest = F.slice(F.array_sort(keyed), 1, 2)
    query = F.array_join(F.transform(longest, lambda e: e["w"]), " ")
    return adapters.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), query.alias("query"))


def store_catalogue(spark, sf_dir: str) -> tuple[Catalogue, dict[str, float]]:
    """Write the tables a deployment keeps, and the index."""
    folder = tempfile.mkdtemp(prefix="bench-")
    made = adapters.catalogue(spark, sf_dir)

    def keep(name: str, frame):
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    began = time.perf_counter()
    segments = keep("segments", made.segments)
    times = {"store_segments": round(time.perf_counter() - began, 3)}
    index = GramIndex(spark, f"{folder}/index", buckets=16)
    times["store_index"] = timed(lambda: index.build(segments))
    others = {name: keep(name, getattr(made, name)) for name in ("assets", "tags", "asset_tags")}
    return Catalogue(segments=segments, postings=index, stats=keep("stats", segment_stats(segments)), **others), times


def indexed_pages(spark, kept: Catalogue) -> dict[str, float]:
    """One page of results through the stored index."""

    def page(query: str):
        return search_page(kept, search(kept, one_query(spark, query)))

    return {
        "page_long_term": timed(lambda: drain(page("treelle"))),
        "page_mixed_terms": timed(lambda: drain(page(searches.FLAGSHIP))),
    }


if __name__ == "__main__":
    main()
