"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Once a table is written, the exchanges that led to it are of no more use; Spark can delete their files then.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str, cores: str = "8", partitions: int = 8, memory: str = "16g") -> SparkSession:
    """Session for tests and benchmarks on one machine; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the session; without one, a folder in the warehouse of a local session."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{use_checkpoint_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Lets Spark delete the shuffle files of each query inside when that query has ended."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_TIDY)
        else:
            spark.conf.set(_TIDY, before)


def freeze(df: DataFrame, path: str | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder as a table and read it from there.

    Values that depend on the physical layout (partition ids, row positions) or on random draws must not be
    computed a second time after an executor is lost, and iterative jobs must not drag their whole history
    along. A written table gives both; being columnar it is also cheaper to read again than stored rows, since
    later passes take only the columns they need. ``path`` is overwritten when given: a loop that alternates
    between two of them keeps two copies at most.
    """
    path = path or scratch_path(df.sparkSession, "frozen")
    with tidy_shuffles(df.sparkSession):
        df.write.mode("overwrite").parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
