"""Percent ranks that never hold one group or one value in one task, and league means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .scan import part, part_sizes, placed_rows, same


def percent_rank_by(
    df: DataFrame,
    group: str,
    value: str = "value",
    out: str = "percentile",
    descending: bool | Column = False,
    buckets: int | None = None,
) -> DataFrame:
    """``(rank - 1) / (values - 1)`` in each group; a NULL value has none and counts nowhere.

    A group of one value has no rank either (0 / 0). ``descending`` may be a condition on
    the group column, ``buckets`` the number of ranges, which changes no rank.

    Rows are put in ranges of (group, value, a random number), so that a common value spreads
    over ranges, and ranked where they are: the rank of a value is the number of its first
    row, found within the range. Only the first and last value of a range can go on in
    another one; their numbers come from a table with a row per range and group, the only
    table that is joined to the rows, and by group and range.
    """
    given = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    by = [group, "p_given"]
    rows = df.withColumns({"p_given": given, "p_mixed": F.rand(7)})
    placed = placed_rows(rows, by, [value, "p_mixed"], buckets)
    pieces = _range_ends(placed, by, value)
    match = same(placed, pieces, by, "_n") & (part() == F.col("n_part"))
    here = Window.partitionBy(*by, part(), value)
    ranked = placed.withColumns({
        "p_first": F.min("n_at").over(here), "p_last": F.max("n_at").over(here)
    }).join(pieces, match)

    def place(of_end: str, here: str) -> Column:
        return (
            F.when(F.col(value) == F.col("n_low.value"), F.col(f"n_low.{of_end}"))
            .when(F.col(value) == F.col("n_high.value"), F.col(f"n_high.{of_end}"))
            .otherwise(F.col(here) + F.col("n_shift"))
        )

    is_descending = descending if isinstance(descending, Column) else F.lit(descending)
    fewer = F.when(is_descending, F.col("n_values") - place("last", "p_last")).otherwise(
        place("first", "p_first") - 1)
    share = F.when(F.col("p_given"), F.try_divide(fewer, F.col("n_values") - 1))
    return ranked.withColumn(out, share).select(*[c for c in df.columns if c != out], out)


def _range_ends(placed: DataFrame, by: list[str], value: str) -> DataFrame:
    """For each group and range: n_shift, the group's n_values, and n_low and n_high, the two
    end values of the range with their first and last numbers over all ranges."""
    names = [f"{c}_n" for c in by]
    pieces = part_sizes(
        placed, by, F.min("n_at").alias("n_first"),
        F.min(F.struct(value, (-F.col("n_at")).alias("at"))).alias("n_low"),
        F.max(F.struct(value, (-F.col("n_at")).alias("at"))).alias("n_high"))
    shift, first = F.col("n_shift"), F.col("n_first")

    def end(name: str, low: Column, high: Column) -> Column:
        return F.struct(F.lit(name).alias("end"), F.col(f"{name}.{value}").alias("value"),
                        (low + shift).alias("first"), (high + shift).alias("last"))

    ends = pieces.withColumn("n_values", F.sum("n_rows").over(Window.partitionBy(*names))).select(
        *names, "n_part", "n_shift", "n_values", F.explode(F.array(
            end("n_low", first, -F.col("n_low.at")),
            end("n_high", -F.col("n_high.at"), first + F.col("n_rows") - 1))).alias("e"))
    whole = Window.partitionBy(*names, "e.value")
    ends = ends.withColumn("whole", F.struct(
        F.col("e.value").alias("value"), F.min("e.first").over(whole).alias("first"),
        F.max("e.last").over(whole).alias("last")))
    return ends.groupBy(*names, "n_part", "n_shift", "n_values").agg(*[
        F.max(F.when(F.col("e.end") == name, F.col("whole"))).alias(name)
        for name in ("n_low", "n_high")])


def league_mean(df: DataFrame, value: str, condition: Column | None = None) -> Column:
    """The mean of a column over a whole table, as a scalar for use in another select."""
    rows = df if condition is None else df.filter(condition)
    return rows.agg(F.avg(value)).scalar()
