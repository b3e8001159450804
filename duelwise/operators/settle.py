"""Frames that are computed once and read often."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel


def settle(df: DataFrame) -> DataFrame:
    """The same rows, computed when first used and then kept on the executors.

    What is lost with an executor, or was dropped, is computed again from the same shuffle,
    so every use sees the same rows in the same ranges. ``spark.catalog.clearCache()`` lets
    them all go.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)
