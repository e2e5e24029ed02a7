"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Removes the shuffle files of an execution when it ends, instead of when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows up to which a side whose size follows from a fixed table may be broadcast.
BROADCAST_ROWS = 200_000
#: Rows of the largest vocabulary that the driver reads.
VOCABULARY_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only where it is unset, as in tests on one machine, a temporary folder is set.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = os.path.join(tempfile.gettempdir(), "loomcat-checkpoints")
    spark.sparkContext.setCheckpointDir(configured)
    return jsc.getCheckpointDir().get()


def keyed(df: DataFrame, *key: str) -> DataFrame:
    """df hash-partitioned by a key into as many parts as the session shuffles into, at least one per core.

    For work that costs much per row: later steps on the key need no further shuffle, and small parts are not merged.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *key)


@contextmanager
def _without_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves no shuffle files: nothing reads them again once the table is there."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder; later reads survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, written once as a table in the shared folder: as `settled`, but compressed and read again by columns."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    with _without_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.parquet(path)
    table.stored_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Takes the files of `stored` tables away; nothing may read them any more, nor what is lazily made of them."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is proven to hold at most `limit` rows, else df as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fixed_rows(df: DataFrame, limit: int = VOCABULARY_ROWS) -> list:
    """All rows of a fixed vocabulary in the driver. A table that outgrows the limit is no vocabulary: an error, never a part of it."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows where a fixed vocabulary is expected")
    return rows


def fingerprint(columns: list[str]):
    """A 64-bit hash of some columns, for salting."""
    return F.xxhash64(*columns)
