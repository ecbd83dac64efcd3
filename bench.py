"""Wall-clock of the headline queries, as one line of JSON.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1); BENCH_CPUS: cores (default 8).
Every query runs once to warm up and is then timed, writing its whole result to Spark's
null sink.  ``stored_topk`` and ``ann_topk`` search indexes that were built before.  The ingest figures are a full run, a run without changes and one with one file in
a hundred changed, over all documents.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ravelin import schemas
from ravelin.config import DEFAULT
from ravelin.operators import ingest, postings
from ravelin.operators.store import SnapshotStore
from ravelin.plans import queries, registry

HEADLINE = ("tokenize_terms", "sparse_tf", "sparse_vectors", "sparse_topk", "dense_topk", "hybrid_topk", "citations", "sections", "sub_split", "diff_todo", "prompt_messages")


def session() -> SparkSession:
    own = lambda: tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", own())
        .config("spark.sql.warehouse.dir", own())
        .config("spark.checkpoint.dir", own())
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    found: dict[str, float] = {}
    for name in HEADLINE:
        run = lambda q=registry.queries()[name]: q(spark, sf_dir).write.format("noop").mode("overwrite").save()
        run()
        found[name] = timed(run)
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    index, lists = queries.built_index(spark, sf_dir, f"{root}/index"), queries.built_lists(spark, sf_dir, f"{root}/lists")
    searches = {
        "stored_topk": lambda: postings.search(index, queries.asked_terms(spark, sf_dir)),
        "ann_topk": lambda: lists.search(queries._vectors(spark, sf_dir)[1]),
    }
    for name, search in searches.items():
        run = lambda s=search: s().write.format("noop").mode("overwrite").save()
        run()
        found[name] = timed(run)
    chunks = SnapshotStore(spark, f"{root}/chunks", schemas.STORED_CHUNK, "metadata.source", DEFAULT.buckets)
    state = SnapshotStore(spark, f"{root}/state", schemas.FILE_STATE)
    files = queries.files(spark, sf_dir)
    changed = files.withColumn("content", F.when(F.pmod(F.xxhash64("source"), F.lit(100)) == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    found["ingest_full"] = timed(lambda: ingest.ingest(files, chunks, state, full=True))
    found["ingest_no_change"] = timed(lambda: ingest.ingest(files, chunks, state))
    found["ingest_1_percent"] = timed(lambda: ingest.ingest(changed, chunks, state))
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
