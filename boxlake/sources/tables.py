"""Listings of folders, and the Parquet layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


def listing(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files below a folder as `path, name, length, modified`. Contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    return files.select(
        "path",
        F.regexp_extract("path", r"([^/]*)$", 1).alias("name"),
        "length",
        F.col("modificationTime").alias("modified"),
    )


def doc_bucket(n: int = BUCKETS):
    return F.pmod(F.xxhash64("doc"), F.lit(n)).cast("int")


def write_table(df: DataFrame, path: str, mode: str = "overwrite", buckets: int = BUCKETS) -> None:
    """Flat table partitioned by a hash bucket of the document, sorted by document and
    page in each file so that row-group statistics prune. One document may fill many
    files: rows are spread by document and page."""
    spread = df.withColumn("doc_bucket", doc_bucket(buckets))
    keys = ["doc_bucket", "doc", *[c for c in ("page",) if c in df.columns]]
    (
        spread.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode(mode)
        .partitionBy("doc_bucket")
        .parquet(path)
    )


def read_table(spark: SparkSession, path: str, docs: Sequence | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The table; for given documents only their buckets are scanned."""
    df = spark.read.parquet(path)
    if docs is not None:
        wanted = spark.createDataFrame([(d,) for d in docs], ["doc"]).select(doc_bucket(buckets).alias("b"))
        numbers = sorted(r.b for r in wanted.distinct().toLocalIterator())
        df = df.filter(F.col("doc_bucket").isin(numbers) & F.col("doc").isin(list(docs)))
    return df.drop("doc_bucket")
