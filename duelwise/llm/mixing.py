"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots of equally many words. Slot j has the van der Corput point of j in
base 2; cumulative target shares cut the unit interval into one range per source, and the
range that the point falls into names the slot's source. With a power of two of slots the
points are a full grid, so each source gets its share of slots to within one, evenly spread
over the mix. A source's documents, ordered by a hash, form a tape that is laid twice and
cut into blocks of the slots' size; the r-th slot of a source takes its r-th block.

Running totals (places on the tape, ranks of slots) go by three levels of the ordering key,
so that no source, however large, is in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duelwise.llm.scratch import settle

#: Words of a slot at most.
BLOCK = 64
#: Cells of the unit interval by which slots find their source.
CELLS = 12


def running_start(df: DataFrame, group: str, key: str, value: str, *ties: str) -> DataFrame:
    """`df` with `start`: the sum of `value` over the rows of the group that come before.

    `key` is a string of at least four hexadecimal digits spread evenly; its first two and
    first four digits are the upper levels of the order.
    """
    fine = df.withColumn("_k4", F.substring(key, 1, 4))
    by4 = settle(fine.groupBy(group, "_k4").agg(F.sum(value).alias("_s4")))
    by2 = by4.groupBy(group, F.substring("_k4", 1, 2).alias("_k2")).agg(F.sum("_s4").alias("_s2"))

    def before(total: str, *cols: str):
        w = W.partitionBy(*cols[:-1]).orderBy(cols[-1]).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum(total).over(w), F.lit(0))

    by2 = by2.select(group, "_k2", before("_s2", group, "_k2").alias("_b2"))
    by4 = (
        by4.withColumn("_k2", F.substring("_k4", 1, 2))
        .withColumn("_b4", before("_s4", group, "_k2", "_k4"))
        .join(by2, [group, "_k2"])
        .select(group, "_k4", (F.col("_b2") + F.col("_b4")).alias("_base"))
    )
    w = W.partitionBy(group, "_k4").orderBy(key, *ties).rowsBetween(W.unboundedPreceding, -1)
    return (
        fine.withColumn("_own", F.coalesce(F.sum(value).over(w), F.lit(0)))
        .join(settle(by4), [group, "_k4"])
        .withColumn("start", F.col("_base") + F.col("_own"))
        .drop("_k4", "_own", "_base")
    )


def source_targets(sizes: DataFrame, weights: list[int], percent: int) -> DataFrame:
    """(skey, source_size, target, edge, before, total) from (skey, source, source_size).

    Sources share `percent` of all words by weight; none gets more than twice its size, and
    what is above is shared again by weight. before and edge are the sums of targets without
    and with the source. One task orders the sources: a row for each, not for their rows.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*(F.lit(float(x)) for x in weights)), F.col("place") % len(weights) + 1)
    rows = (
        sizes.withColumn("place", (F.row_number().over(order) - 1).cast("int"))
        .withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(2.0))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
    )
    rise = W.orderBy("full_at", "place")
    earlier, later = rise.rowsBetween(W.unboundedPreceding, -1), rise.rowsBetween(
        0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing).orderBy("place")) * F.lit(percent) / 100.0
    level = (F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) \
        / F.sum("weight").over(later)
    rows = rows.withColumn("total", total).withColumn("level", level)
    # The first source in that order which stays below its cap sets the level of all such.
    rate = F.min_by(F.when(F.col("level") <= F.col("full_at"), F.col("level")), F.when(
        F.col("level") <= F.col("full_at"), F.struct("full_at", "place"))).over(
        W.orderBy("place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = rows.withColumn("rate", rate).withColumn(
        "target", F.round(F.least("cap", F.col("rate") * F.col("weight")), 6))
    edge = F.sum("target").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("edge", edge).select(
        "skey", "source_size", "target", (F.col("edge") - F.col("target")).alias("before"),
        "edge", "total")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2), percent: int = 150,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of `docs`.

    size counts runs without white space (null: 0). Sources in the order of their code
    points, null last, have the weights in turn and share `percent` (at most 200) of all
    words; no source takes more than twice its words. taken counts the words of the
    document in the mix, repeats included: whole documents, but for those at the ends of a
    tape. A source takes its rounded target, or up to one slot less. Documents are shuffled
    by a hash of the id; equal rows are interchangeable. Without any word all is 0.
    """
    if not 0 < percent <= 200:
        raise ValueError("the mix is up to twice the sources")
    spark = docs.sparkSession
    rows = settle(docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
        F.coalesce(F.regexp_count(f"`{text_col}`", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
        .cast("long").alias("size"))
        .withColumn("skey", F.coalesce(F.concat(F.lit("v"), F.col("source").cast("string")),
                                       F.lit("n"))))
    sizes = rows.groupBy("skey").agg(F.first("source").alias("source"),
                                     F.sum("size").alias("source_size"))
    targets = settle(source_targets(sizes, list(weights), percent))
    total = targets.agg(F.max("total")).first()[0] or 0.0
    bits = max(0, (max(1, -(-int(total) // BLOCK)) - 1).bit_length())
    block = int(total) // (1 << bits) + 1
    cells = min(CELLS, bits)
    grid = F.lit(float(1 << bits)) / F.col("total")
    ranges = (
        targets.filter("target > 0").select(
            "skey", F.ceil(F.round(F.col("before") * grid, 3)).alias("low"),
            F.ceil(F.round(F.col("edge") * grid, 3)).alias("high"))
        .filter("low < high")
        .withColumn("cell", F.explode(F.sequence(
            F.shiftright("low", bits - cells), F.shiftright(F.col("high") - 1, bits - cells))))
    )
    slots = spark.range(1 << bits).withColumnRenamed("id", "slot")
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), max(1, bits), "0")), 2, 10).cast("long")
    slots = slots.withColumn("point", point).withColumn(
        "cell", F.shiftright("point", bits - cells))
    named = settle(
        slots.join(ranges, "cell").filter("point >= low and point < high").select(
            "skey", "slot", F.lpad(F.hex(F.col("slot") * F.lit(1 << (16 - min(16, bits)))),
                                   max(4, (bits + 3) // 4), "0").alias("time"),
            F.lit(1).alias("one")))
    ranked = running_start(named, "skey", "time", "one").select(
        "skey", F.col("start").alias("block"))
    placed = rows.filter("size > 0").withColumn(
        "key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")))
    placed = settle(running_start(placed, "skey", "key", "size", "size").join(
        targets.select("skey", "source_size", "target"), "skey"))
    lap = F.explode(F.array(F.lit(0), F.lit(1)))
    begin = F.col("start") + F.col("lap") * F.col("source_size")
    end = F.least(F.col("begin") + F.col("size"), F.round("target").cast("long"))
    pieces = (
        placed.withColumn("lap", lap).withColumn("begin", begin).withColumn("end", end)
        .filter("begin < end")
        .withColumn("block", F.explode(F.sequence(
            (F.col("begin") / block).cast("long"), ((F.col("end") - 1) / block).cast("long"))))
    )
    words = F.least("end", (F.col("block") + 1) * block) - F.greatest(
        "begin", F.col("block") * block)
    taken = (
        pieces.join(ranked, ["skey", "block"]).groupBy("skey", "start")
        .agg(F.sum(words).alias("taken"))
    )
    mixed = placed.join(taken, ["skey", "start"], "left").select(
        "doc_id", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    empty = rows.filter("size = 0").join(targets, "skey").select(
        "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return mixed.union(empty)
