"""Collections as tables of the session's catalogue: created once, with their vectors' size and distance as properties.

Rows lie in partitions by a hash of their source, which a change rewrites one by one, and within them in Spark's buckets by
source, sorted, with a Bloom filter: a filter on a source opens one bucket's files of one partition, and two
collections join by source without moving either.  ``store.SnapshotStore`` is the choice where several
partitions must change at one moment; here each changes by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = (
    "id STRING, content STRING, embedding ARRAY<FLOAT>, sparse STRUCT<indices: ARRAY<INT>, values: ARRAY<DOUBLE>>, terms INT, "
    "title STRING, section_title STRING, chunk_index INT, source STRING"
)
PARTS, BUCKETS = 32, 4
DISTANCES = ("cosine",)


def _name(name: str) -> str:
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def create(spark: SparkSession, name: str, size: int, distance: str = "cosine", parts: int = PARTS, buckets: int = BUCKETS) -> None:
    """Make the table if it is not there; one that is there must have the same vectors."""
    if distance not in DISTANCES:
        raise ValueError(f"no such distance: {distance}; one of {', '.join(DISTANCES)}")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_name(name)} ({COLUMNS}, part INT) USING parquet OPTIONS ('parquet.bloom.filter.enabled#source' 'true') "
        f"PARTITIONED BY (part) CLUSTERED BY (source) SORTED BY (source) INTO {buckets} BUCKETS "
        f"TBLPROPERTIES ('vector.size' = '{size}', 'vector.distance' = '{distance}', 'parts' = '{parts}', 'buckets' = '{buckets}')"
    )
    found = properties(spark, name)
    if (found["vector.size"], found["vector.distance"]) != (str(size), distance):
        raise ValueError(f"{name} holds vectors of {found['vector.size']} numbers by {found['vector.distance']}")


def properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {_name(name)}").collect()}


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_name(name)}")


def _part(spark: SparkSession, name: str, source: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(source), F.lit(int(properties(spark, name)["parts"]))).cast("int")


def _put(spark: SparkSession, name: str, rows: DataFrame, overwrite: bool) -> None:
    names = spark.table(name).columns
    # rows of a bucket of a partition come to one task, which writes one file of them
    bucket = F.pmod(F.hash("source"), F.lit(int(properties(spark, name)["buckets"])))
    ordered = rows.select(*names).repartition(F.col("part"), bucket)
    setting = "spark.sql.sources.partitionOverwriteMode"  # a table's writer takes it from the session only
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        ordered.write.mode("overwrite" if overwrite else "append").insertInto(name)
    finally:
        spark.conf.set(setting, before)


def add(spark: SparkSession, name: str, chunks: DataFrame) -> None:
    """Append chunks as a store holds them (metadata nested); vectors of another size are an error."""
    size = int(properties(spark, name)["vector.size"])
    fits = F.col("embedding").isNull() | (F.size("embedding") == size)
    vector = F.when(fits, F.col("embedding")).otherwise(F.raise_error(F.lit(f"vectors of {name} have {size} numbers")))
    flat = chunks.select("id", "content", vector.alias("embedding"), "sparse", "terms", "metadata.*")
    _put(spark, name, flat.withColumn("part", _part(spark, name, F.col("source"))), False)


def of_source(spark: SparkSession, name: str, source: str) -> DataFrame:
    """The rows of one source: other partitions and buckets are not opened."""
    part = spark.range(1).select(_part(spark, name, F.lit(source)).alias("p")).first()["p"]
    return spark.table(name).filter((F.col("part") == part) & (F.col("source") == source))


def delete_sources(spark: SparkSession, name: str, sources: DataFrame, scratch: str) -> None:
    """Delete the rows of ``sources`` (source): their partitions alone are read and written, by way of the folder ``scratch``,
    as a table cannot be read and overwritten at once.  A partition that loses all rows is dropped."""
    touched = sorted(r["p"] for r in sources.select(_part(spark, name, F.col("source")).alias("p")).distinct().collect())
    if not touched:
        return
    gone = sources.select("source").distinct()
    spark.table(name).filter(F.col("part").isin(touched)).join(gone, "source", "left_anti").write.parquet(scratch)
    schema = spark.table(name).schema
    kept = spark.read.schema(schema).parquet(scratch)
    left = {r["part"] for r in kept.select("part").distinct().collect()}
    if left:
        _put(spark, name, kept, True)
    for part in touched:
        if part not in left:
            spark.sql(f"ALTER TABLE {_name(name)} DROP IF EXISTS PARTITION (part = {int(part)})")
