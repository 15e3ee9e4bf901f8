"""Lineage cuts that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Tables that go when the innermost ``passing`` block ends; None outside of one.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster in ``spark.checkpoint.dir``; a scratch one only in unset local sessions."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing is not None:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="cohortlens-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint of ``df``; inside a ``passing`` block a table that ends with it."""
    if _passing.get() is not None and eager:
        return stored(df, "checkpoint")
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is stored inside this block, unless it is to be kept, is removed at its end, and shuffle files go with the query that wrote them.

    So work that is done part by part takes the disk of one part. Nothing that reads those tables may leave the block.
    """
    tables: list[str] = []
    token, before = _passing.set(tables), spark.conf.get(_RELEASE)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, before)
        _passing.reset(token)
        for path in tables:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder: a short plan and few bytes, where a table feeds many plans.

    With ``keep`` it outlives the ``passing`` block that it is stored in.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not keep and _passing.get() is not None:
        _passing.get().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS_PER_TASK = 20_000


def settled(df: DataFrame) -> DataFrame:
    """Training table for iterative learners: checkpointed, so that every pass plans and ships a short lineage, and
    cached in as many partitions as its rows justify, so that small tables do not pay for empty tasks on each pass."""
    held = durable(df)
    parts = max(1, -(-held.count() // ROWS_PER_TASK))
    return held.coalesce(parts).persist()
