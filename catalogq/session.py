"""Session settings and the shared folder for data that must outlive a stage."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package relies on; all can be set on a live session.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A JSON object that repeats a key keeps the last value instead of being refused.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # A step over wider rows is compiled in parts: as one method it is too long for HotSpot, which then interprets it.
    "spark.sql.codegen.maxFields": "40",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the package's SQL settings to an existing session."""
    for name, value in SQL_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("catalogq")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        # Small tables on many cores: the defaults, made for large ones, would put them into one task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.files.openCostInBytes", "128k")
        # Else every function call from Python also records where it stands.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in SQL_SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset, a local session uses a folder below its warehouse; a cluster must name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/catalogq-shared"


_made: list[str] = []


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other job uses; release() deletes it."""
    path = f"{shared_dir(spark)}/catalogq-{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the folders made so far (from the given one on); results that still read them must be written first."""
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while len(_made) > since:
        target = paths(_made.pop())
        target.getFileSystem(conf).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is made inside is deleted at the end of the block: write results before it ends."""
    since = len(_made)
    try:
        yield
    finally:
        release(spark, since)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _made:
        release(spark)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back.

    Later jobs start from the files, so a lost executor costs no recomputation,
    values that depend on the partitioning stay fixed, and every reader still
    prunes columns.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
