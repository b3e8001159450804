"""Running values in ordered groups.

A match of a few hundred events is a window of its own. Where single matches may hold any
share of all rows, the session says so by a number of events in ``BLOCK_SETTING``, and no
group is in one task any more: ``number_rows`` orders a feed by ranges of (match, time,
tie-breaker), so that a large match, or a burst at one moment, spreads over tasks, and adds to
the numbers in each range what the ranges before carry over. Event numbers are dense, so the
block of an event follows from its number: windows run within a block, and ``scan`` adds the
row counts, sums, maxima and last rows of the blocks before. The setting, not the data,
decides the plan; rows and columns are the same with and without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import Window

from .settle import settle

EVENT_COLUMNS = ("state", "adv")
#: Session setting: events of a match in one block; 0, or not set, keeps matches whole.
BLOCK_SETTING = "spark.duelwise.blockEvents"
#: Bits of a row's place within its partition in Spark's increasing ids.
PLACE_BITS = 33


def block_of(df: DataFrame) -> Column | None:
    """The block of an event, from its number; None where matches stay whole."""
    size = int(df.sparkSession.conf.get(BLOCK_SETTING, "0"))
    return F.expr(f"event_id div {size}") if size else None


def by_match(df: DataFrame) -> DataFrame:
    """``df`` dealt by match over all shuffle partitions of the session; not where blocks follow.

    The engine merges partitions by the bytes that it shuffles, but a later task holds each
    event once per player of the roster. A number that is asked for stays, so what a task
    holds shrinks with the number of partitions that the session sets for its data.
    """
    if block_of(df) is not None:
        return df
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "match_id")


def event_keys(df: DataFrame, *more: str) -> list[str]:
    """The columns that name an event, and those that hold for the event as a whole.

    State and advantage, once computed, travel on the rows of their event: grouping by them
    as well changes nothing and saves the join that would bring them back.
    """
    shared = [c for c in EVENT_COLUMNS if c in df.columns]
    return ["match_id", "event_id", *more, *shared]


def by_event(df: DataFrame, *keys: str) -> GroupedData:
    """Groups of the keys, which hold match and event; blocks keep their partitioning.

    The aggregate may have a column ``in_block``, to be dropped.
    """
    block = block_of(df)
    return df.groupBy(*keys, *([] if block is None else [block.alias("in_block")]))


def same(left: DataFrame, right: DataFrame, keys: list[str], suffix: str) -> Column:
    """Equal keys, also where NULL; the right ones carry the suffix."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key + suffix])
    return condition


def placed_rows(
    df: DataFrame, by: list[str], order: list[str], ranges: int | None = None
) -> DataFrame:
    """``df`` in ranges of ``by`` and ``order``, settled, with each row's place ``n_at``.

    ``ranges`` is their number; None leaves it to the session.
    """
    number = [] if ranges is None else [ranges]
    ranged = df.repartitionByRange(*number, *by, *order).sortWithinPartitions(*by, *order)
    return settle(ranged.withColumn("n_at", F.monotonically_increasing_id()))


def part() -> Column:
    """The range that a placed row is in."""
    return F.shiftright("n_at", PLACE_BITS)


def part_sizes(placed: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """(by with suffix _n, n_part, n_shift, more): what to add to a place for a row number.

    A row per group and range that it touches; a group that began in an earlier range
    continues its count.
    """
    names = [f"{c}_n" for c in by]
    pieces = placed.groupBy(
        *[F.col(c).alias(n) for c, n in zip(by, names)], part().alias("n_part")
    ).agg(F.count(F.lit(1)).alias("n_rows"), F.min("n_at").alias("n_begin"), *more)
    earlier = Window.partitionBy(*names).orderBy("n_part").rowsBetween(
        Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_rows").over(earlier), F.lit(0))
    return pieces.withColumn("n_shift", before + 1 - F.col("n_begin")).drop("n_begin")


def number_rows(df: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """``df`` with the row number, from 1, in each ``by`` group: a scan over ranges."""
    placed = placed_rows(df, by, order)
    shifts = part_sizes(placed, by)
    match = same(placed, shifts, by, "_n") & (part() == F.col("n_part"))
    numbered = placed.join(shifts, match).withColumn(out, F.col("n_at") + F.col("n_shift"))
    return numbered.select(*df.columns, out)


def number_events(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``event_id``, partitioned as later steps need it: by match, or by block."""
    block = block_of(df)
    if block is not None:
        numbered = number_rows(df, ["match_id"], order, "event_id")
        return numbered.repartition("match_id", block)
    place = F.row_number().over(Window.partitionBy("match_id").orderBy(*order))
    return by_match(df).withColumn("event_id", place.cast("long"))


def scan(
    df: DataFrame,
    by: list[str],
    order: list[str],
    *,
    number: str | None = None,
    previous: dict[str, str] | None = None,
    total: dict[str, Column] | None = None,
    peak: dict[str, Column] | None = None,
    latest: dict[str, Column] | None = None,
    changes: dict[str, tuple[str, str]] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add running values of each ``by`` group in ``order``.

    ``by`` begins with the match and ``order`` with the event number. ``number`` is the row
    number; ``previous`` maps an output to the column whose value on the row before is
    wanted; ``total`` maps an output to a running sum that includes the row; ``peak`` maps an
    output to the maximum over the rows strictly before; ``latest`` maps an output to the
    row number of the latest row strictly before that meets a condition; ``changes`` maps an
    output to a column and the value it starts from, for the number of rows up to this one
    that differ from the row before. With ``descending`` the group is walked from its end,
    so ``previous`` looks ahead.
    """
    previous, total, peak = previous or {}, total or {}, peak or {}
    latest, changes = latest or {}, changes or {}
    sort = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    block = block_of(df)
    window = Window.partitionBy(*by, *([] if block is None else [block])).orderBy(*sort)
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(window)

    names = ["c_match", *(f"c_{c}" for c in by[1:])]
    walk = F.col("c_block").desc() if descending else F.col("c_block").asc()
    across = Window.partitionBy(*names).orderBy(walk)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    edge = F.min_by if descending else F.max_by
    other_edge = F.max_by if descending else F.min_by
    # What a block adds up to, and, from these sums, what the blocks before it leave to it.
    marks, sums, ends, fields = {}, {}, {}, {}
    if number or latest:
        sums["c_rows"] = F.count(F.lit(1))
        fields["c_rows"] = F.coalesce(F.sum("c_rows").over(earlier), F.lit(0))
    for out, value in total.items():
        sums[f"c_sum_{out}"] = F.sum(value)
        fields[f"c_sum_{out}"] = F.sum(f"c_sum_{out}").over(earlier)
    for out, value in peak.items():
        sums[f"c_max_{out}"] = F.max(value)
        fields[f"c_max_{out}"] = F.max(f"c_max_{out}").over(earlier)
    for out, condition in latest.items():
        marks[f"c_at_{out}"] = F.when(condition, place)
        sums[f"c_at_{out}"] = F.max(f"c_at_{out}")
        ends[f"c_at_{out}"] = F.col(f"c_at_{out}") + F.coalesce(
            F.sum("c_rows").over(earlier), F.lit(0))
        fields[f"c_at_{out}"] = F.max(f"c_at_{out}").over(earlier)
    for out, (column, start) in changes.items():
        marks[f"c_new_{out}"] = (F.lag(column).over(window) != F.col(column)).cast("long")
        sums[f"c_new_{out}"] = F.sum(f"c_new_{out}")
        sums[f"c_first_{out}"] = other_edge(column, F.struct(*order))
        sums[f"c_end_{out}"] = edge(column, F.struct(*order))
        first_new = F.coalesce(F.lag(f"c_end_{out}").over(across), F.lit(start)) != F.col(
            f"c_first_{out}")
        ends[f"c_new_{out}"] = F.coalesce(f"c_new_{out}", F.lit(0)) + first_new.cast("long")
        fields[f"c_new_{out}"] = F.sum(f"c_new_{out}").over(earlier)
        fields[f"c_end_{out}"] = F.lag(f"c_end_{out}").over(across)
    if previous:
        last = F.struct(*[F.col(c).alias(o) for o, c in previous.items()])
        sums["c_last"] = edge(last, F.struct(*order))
        fields["c_last"] = F.lag("c_last").over(across)

    joined = df
    if block is not None:
        rows = _several_blocks(df, block)
        if marks:
            rows = rows.withColumns(marks)
        rows = rows.groupBy(
            *[F.col(c).alias(n) for c, n in zip(by, names)], block.alias("c_block")
        ).agg(*[value.alias(name) for name, value in sums.items()])
        if ends:
            rows = rows.withColumns(ends)
        has_earlier = F.row_number().over(across) > 1
        carried = (
            rows.select(*names, "c_block", has_earlier.alias("c_more"),
                        *[value.alias(name) for name, value in fields.items()])
            .filter("c_more").groupBy("c_match", "c_block")
            .agg(F.collect_list(F.struct(*names[1:], *fields)).alias("c_carry"))
        )
        at_block = (F.col("match_id") == F.col("c_match")) & (block == F.col("c_block"))
        mine = F.filter("c_carry", lambda x: _equal(x, by[1:]))
        joined = df.join(carried, at_block, "left").withColumn("c_carry", F.get(mine, F.lit(0)))

    def carry(name: str, field: str | None = None) -> Column:
        """What earlier blocks leave; nothing where matches stay whole."""
        if block is None:
            return F.lit(None)
        return F.col(f"c_carry.{name}" + (f".{field}" if field else ""))

    added, inner = {}, {}
    for out, column in previous.items():
        own = F.lag(column).over(window)
        added[out] = own if block is None else F.when(
            place == 1, carry("c_last", out)).otherwise(own)
    for out, value in total.items():
        within = F.sum(value).over(so_far)
        added[out] = within if block is None else F.coalesce(
            within + carry(f"c_sum_{out}"), within, carry(f"c_sum_{out}"))
    for out, value in peak.items():
        here = F.max(value).over(before)
        added[out] = here if block is None else F.greatest(carry(f"c_max_{out}"), here)
    if number or latest:
        inner["c_place"] = F.coalesce(carry("c_rows"), F.lit(0)) + place
    if number:
        added[number] = F.col("c_place").cast("long")
    for out, condition in latest.items():
        here = F.max(F.when(condition, F.col("c_place"))).over(before)
        added[out] = F.coalesce(here, carry(f"c_at_{out}"))
    for out, (column, start) in changes.items():
        old = F.when(place == 1, carry(f"c_end_{out}")).otherwise(F.lag(column).over(window))
        inner[f"c_new_{out}"] = (
            F.coalesce(old, F.lit(start)) != F.col(column)).cast("long")
        added[out] = F.sum(f"c_new_{out}").over(so_far) + F.coalesce(
            carry(f"c_new_{out}"), F.lit(0))
    if inner:
        joined = joined.withColumns(inner)
    return joined.select(*df.columns, *[value.alias(name) for name, value in added.items()])


def _several_blocks(df: DataFrame, block: Column) -> DataFrame:
    """The rows of matches of more than one block: only these hand anything on.

    Where there are none, the engine finds this join empty and skips all that follows.
    """
    numbers = df.select(F.col("match_id").alias("s_match"), block.alias("s_block"))
    last = numbers.filter("s_block > 0").groupBy("s_match").agg(F.max("s_block").alias("s_last"))
    blocks = last.select("s_match", F.explode(F.sequence(
        F.lit(0).cast("long"), "s_last")).alias("s_block"))
    same_block = (F.col("match_id") == F.col("s_match")) & (block == F.col("s_block"))
    return df.join(blocks, same_block, "left_semi")


def _equal(carry: Column, names: list[str]) -> Column:
    found = F.lit(True)
    for name in names:
        found = found & carry[f"c_{name}"].eqNullSafe(F.col(name))
    return found
