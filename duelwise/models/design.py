"""Design matrices: indicator terms kept as arrays, turned into sparse vectors by MLlib."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .. import params
from ..operators.reshape import level_list
from ..operators.state import eligible_players
from ..operators.xkill import key_hash

MAX_TERMS = 100_000  # names that the driver may list


@contextmanager
def settled(df: DataFrame) -> Iterator[DataFrame]:
    """A frame that a fit reads many times, computed once.

    Where the session names a shared checkpoint folder the frame is written there, so a
    lost executor does not recompute the feed; otherwise it is persisted.
    """
    context = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None and folder:
        context.setCheckpointDir(folder)
    if context.getCheckpointDir() is not None:
        yield df.checkpoint()
        return
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def hash_share(keys: list[str], seed: int) -> Column:
    """A number below one million from the row keys, the same on any partitioning."""
    head = F.substring(key_hash(*keys, F.lit(seed)), 1, 8)
    return F.conv(head, 16, 10).cast("long") % 1_000_000


def train_test_split(
    df: DataFrame, keys: list[str], seed: int = 7, share: float = 0.75
) -> tuple[DataFrame, DataFrame]:
    """Split rows by a hash of their keys."""
    marked = hash_share(keys, seed) < int(share * 1_000_000)
    return df.filter(marked), df.filter(~marked)


def with_fold(df: DataFrame, keys: list[str], folds: int, seed: int = 5) -> DataFrame:
    return df.withColumn("fold", (hash_share(keys, seed) % folds).cast("int"))


def player_terms(
    roster: DataFrame, roles: list[str], min_games: int = params.MIN_GAMES,
    baseline_player: str | None = None,
) -> list[str]:
    """``player_ROLE`` names of the eligible players, by exact name, without the baseline."""
    names = level_list(eligible_players(roster, min_games), "player_id", MAX_TERMS)
    if baseline_player is None and names:
        baseline_player = names[0]
    return sorted(f"{p}_{r}" for p in names if p != baseline_player for r in roles)


def level_term(column: str) -> Column:
    return F.concat(F.lit(column), F.col(column).cast("string"))


def collect_terms(rows: DataFrame, ids: list[str], term: Column, present: Column) -> DataFrame:
    """The terms that hold in each event, as an array bounded by the roster of the event.

    A term that several rows of an event name holds once: a design has presence, not counts.
    """
    held = F.array_distinct(F.collect_list(F.when(present, term)))
    return rows.groupBy(*ids).agg(held.alias("terms"))


def add_term(df: DataFrame, term: Column) -> DataFrame:
    return df.withColumn("terms", F.array_append("terms", term))


def term_counts(df: DataFrame, allowed: Column) -> DataFrame:
    """Rows in which each term holds, for the terms that satisfy a condition on ``term``."""
    held = F.explode(F.array_distinct("terms")).alias("term")
    return df.select(held).filter(allowed).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def varying_terms(
    df: DataFrame, names: list[str], level: str | None = None, baseline: str | None = None
) -> list[str]:
    """The terms that neither hold in every row nor in none, counted in one pass.

    Terms are the given names and, first, the levels of the factor ``level`` but for its
    baseline: the given one, or, with a warning, the first if that does not occur.
    """
    everything = df.withColumn("terms", F.array_append("terms", F.lit("")))
    allowed = F.col("term").isin([*names, ""])
    if level:
        allowed = allowed | F.col("term").rlike(f"^{level}-?[0-9]+(v[0-9]+)?$")
    rows = term_counts(everything, allowed).limit(MAX_TERMS + 2).collect()
    if len(rows) > MAX_TERMS + 1:
        raise ValueError(f"more than {MAX_TERMS} terms; raise min_games")
    counts = {row["term"]: row["n"] for row in rows}
    total = counts.pop("", 0)
    listed = set(names)
    levels = sorted(t for t in counts if t not in listed)
    if levels:
        asked = f"{level}{baseline}"
        if baseline is not None and asked not in levels:
            warnings.warn(f"{asked} does not occur; {levels[0]} is the baseline",
                          RuntimeWarning, stacklevel=2)
        levels.remove(asked if asked in levels else levels[0])
    return [t for t in [*levels, *names] if 0 < counts.get(t, 0) < total]


def assemble(
    df: DataFrame, terms: list[str], numeric: list[str] | None = None
) -> DataFrame:
    """Add ``features``: the numeric columns, then one sparse count per term."""
    numeric = numeric or []
    if not terms:
        return VectorAssembler(inputCols=numeric, outputCol="features").transform(df)
    counter = CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="held")
    vectors = counter.transform(df)
    return VectorAssembler(inputCols=[*numeric, "held"], outputCol="features").transform(vectors)


def correlations(assembled: DataFrame) -> np.ndarray:
    """Correlation matrix of the features, computed in the JVM."""
    return Correlation.corr(assembled, "features").first()[0].toArray()


def deviations(assembled: DataFrame) -> np.ndarray:
    """Standard deviations of the features, computed in the JVM."""
    return assembled.select(Summarizer.std(F.col("features")).alias("s")).first()["s"].toArray()


def aliased_columns(matrix: np.ndarray, tolerance: float = 1e-7) -> list[int]:
    """Columns that are, beside an intercept, a linear combination of earlier columns."""
    rest = np.where(np.isfinite(matrix), matrix, 0.0)
    dropped: list[int] = []
    for column in range(len(rest)):
        if not rest[column, column] > tolerance:
            dropped.append(column)
            continue
        # What this column explains is taken out of those behind it.
        later = rest[column, column + 1:] / np.sqrt(rest[column, column])
        rest[column + 1:, column + 1:] -= np.outer(later, later)
    return dropped
