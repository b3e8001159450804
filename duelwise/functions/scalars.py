"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip_gap(gap: Column, cap_ms: int) -> Column:
    """A time gap, at most ``cap_ms``."""
    return F.least(F.lit(cap_ms).cast("long"), gap)


def odds_to_probability(odds: Column) -> Column:
    return odds / (F.lit(1.0) + odds)


def odds_ratio_delta(odds_ratio: Column, probability: Column) -> Column:
    """Change of probability that an odds ratio makes at a base probability."""
    shift = (odds_ratio - 1) * F.try_divide(probability, 1 - probability)
    return F.try_divide(shift, 1 + shift)


def per_minute(amount: Column, seconds: Column) -> Column:
    """Rate per minute, NULL where no time was played."""
    return F.try_divide(amount, seconds) * 60


def interval_label(value: Column, low: int, high: int) -> Column:
    """Label ``(a,b]`` of the right-closed unit interval of ``value``; NULL outside."""
    top = F.ceil(value).cast("long")
    text = F.concat(
        F.lit("("), (top - 1).cast("string"), F.lit(","), top.cast("string"), F.lit("]")
    )
    return F.when((top > low) & (top <= high), text)


def recode(value: Column, labels: dict[str, str]) -> Column:
    """Replace known values by their label; other values stay."""
    pairs = [F.lit(part) for item in labels.items() for part in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), value), value)


def term_parts(term: Column) -> tuple[Column, Column]:
    """Split ``player_ROLE`` at its last underscore; a term without one has no role.

    A trailing ``TRUE`` of the role, left by a boolean indicator, is removed.
    """
    has_role = term.contains("_")
    player = F.when(has_role, F.regexp_replace(term, "_[^_]*$", "")).otherwise(term)
    role = F.when(
        has_role,
        F.regexp_replace(F.element_at(F.split(term, "_"), -1), "TRUE$", ""),
    )
    return player, role


def utc_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def snake_case(df: DataFrame) -> DataFrame:
    """Lower-case, underscore-separated column names, unique by a number suffix."""
    seen: dict[str, int] = {}
    names = []
    for column in df.columns:
        split_camel = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", column)
        name = re.sub(r"[^A-Za-z0-9]+", "_", split_camel).strip("_").lower() or "x"
        if name[0].isdigit():
            name = "x" + name
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)
