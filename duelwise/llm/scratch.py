"""Tables written between the steps of an operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts that a task hands to Python at once.
TEXTS = 1000


@lru_cache(maxsize=4)
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"{application}-")


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one on a single machine.

    On a cluster without a named folder this fails: executors would write where others, and
    the driver, cannot read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return named or _own_folder(spark.sparkContext.applicationId)


@contextmanager
def small_batches(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """While it lasts, tasks hand Python so many rows at once: whole texts make large batches."""
    if rows is None:
        yield
        return
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def settle(df: DataFrame, batch: int | None = None) -> DataFrame:
    """Write rows and read them back: nothing is computed twice, and executors may be lost."""
    spark = df.sparkSession
    path = f"{folder(spark)}/llm-{uuid.uuid4().hex}"
    with small_batches(spark, batch):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slot_counts(
    df: DataFrame, slot: str, size: int, weight: str | None = None, batch: int | None = None
) -> np.ndarray:
    """Totals of a column of slot numbers below `size`, as one array of that fixed length."""
    total = F.sum(weight) if weight else F.count(F.lit(1))
    with small_batches(df.sparkSession, batch):
        rows = df.groupBy(slot).agg(total.alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out
