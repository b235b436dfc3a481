"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are tuned for. Shuffle partitions are left to the
# session: AQE coalesces small ones and splits skewed join sides.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", app: str = "boxlake", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, kind: str = "boxlake") -> str:
    """A new path in the shared folder; the innermost open `scratch` removes it."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the intermediate tables written inside the `with` block at its end. Results
    are lazy and read these tables, so write or collect them inside the block."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` as a table written to the shared folder, so that loops stay short and an
    executor loss costs one round, not all of them. The written size is known to the
    optimizer, which then picks broadcast or shuffled joins by it."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Bytes of a written table that may travel whole to every task: packed columns are some
# twenty times as large as rows.
SMALL_TABLE = 256 * 1024


def cut_sized(df: DataFrame) -> DataFrame:
    """`cut_lineage` for tables with as many rows as there is data, joined with their like.
    Spark would broadcast one by the size of its packed columns, and fill the driver: only
    really small ones are, all others are joined by sorting."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    small = files.getContentSummary(where).getLength() <= SMALL_TABLE
    return spark.read.schema(df.schema).parquet(path).hint("broadcast" if small else "merge")


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The result of `make`, written; the tables it wrote on its way are removed."""
    path = scratch_path(spark)
    with scratch(spark):
        out = make()
        out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)
