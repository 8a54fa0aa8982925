"""Session configuration and the shared checkpoint folder.

Materialised intermediates (the golden record, the range-partitioned rank
input) are written under the folder the cluster names in
``spark.checkpoint.dir``.  Library code only *reads* that setting; tests, the
bench and the driver's entry point set a folder on the context where it is unset.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every plan in this package relies on.  AQE re-plans joins and
# partition counts from runtime sizes (the broadcast decision is taken on
# the measured size of a materialised shuffle stage), splits skewed
# partitions of sort-merge joins, and coalesces small shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str = "local[8]", app: str = "ledgerframe",
                  shuffle_partitions: int = 8, driver_memory: str = "16g",
                  extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder named by ``spark.checkpoint.dir``, or else the one set
    on the Spark context (tests, the bench); None when neither is set."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return d or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; the library never makes one
    up, as a folder of one machine would not survive the loss of an executor."""
    d = checkpoint_dir(spark)
    if not d:
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    return d


_MADE: ContextVar[list[str] | None] = ContextVar("intermediate tables", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Removes, at its end, the intermediate tables that plans built inside it
    wrote below the shared folder (their paths are the context's value).

    Results must be written, or collected, inside: a DataFrame that leaves the
    context would read tables that are gone.  Contexts nest; each removes its own."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)
        for path in made:
            remove(spark, path)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read again (cuts the lineage)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
