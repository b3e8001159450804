"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as make it new to the frame."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also where lambdas in it use it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are; the common ASCII text takes a short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def split_words(text: Column, separators: str) -> Column:
    """Array of the pieces between runs of separators; null text: no words."""
    pieces = F.filter(F.split(text, separators), lambda x: x != "")
    return F.coalesce(pieces, F.array().cast("array<string>"))
