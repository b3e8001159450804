"""Long to wide and back, with explicit and bounded value lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_COLUMNS = 4096


def level_list(df: DataFrame, column: str, limit: int = MAX_COLUMNS) -> list[str]:
    """Sorted distinct values for use as columns. Refuses more than ``limit`` values."""
    rows = df.select(column).dropna().distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} values; use the long form")
    return sorted(row[0] for row in rows)


def presence_matrix(df: DataFrame, ids: list[str], term: Column, terms: list[str]) -> DataFrame:
    """One boolean column per term: whether the id has a row with it."""
    rows = df.select(*ids, term.alias("term"))
    return rows.groupBy(*ids).agg(*[(F.count_if(F.col("term") == t) > 0).alias(t) for t in terms])


def sum_matrix(
    df: DataFrame, ids: list[str], term: Column, value: Column, terms: list[str]
) -> DataFrame:
    """One column per term with the sum of a value, 0 where the id has no such row.

    One aggregate per id: a pivot would first hold a group per id and term in each task.
    """
    def total(t: str) -> Column:
        held = F.sum(F.when(F.col("term") == t, F.col("value")))
        return F.coalesce(held, F.lit(0)).cast("long").alias(t)

    rows = df.select(*ids, term.alias("term"), value.alias("value"))
    return rows.groupBy(*ids).agg(*map(total, terms))


def spread(
    df: DataFrame, ids: list[str], names: str, values: str, levels: list[str]
) -> DataFrame:
    """One column per level holding its value, NULL where absent."""
    return df.groupBy(*ids).pivot(names, levels).agg(F.first(values, ignorenulls=True))


def unfold(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """Columns of one type to rows.

    An explode of structs rather than ``unpivot``: two uses of the result then share one
    shuffle, which Spark does not recognise for the plan that ``unpivot`` makes.
    """
    cells = F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns
    ])
    return df.select(*ids, F.explode(cells).alias("cell")).select(*ids, "cell.*")


def gather(
    df: DataFrame, ids: list[str], columns: list[str], name: str = "stat", value: str = "value"
) -> DataFrame:
    """Columns to rows, as doubles."""
    aligned = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return unfold(aligned, ids, columns, name, value)


def role_terms(players: list[str], roles: list[str]) -> list[str]:
    """Sorted ``player_ROLE`` names."""
    return sorted(f"{player}_{role}" for player in players for role in roles)
