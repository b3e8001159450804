"""Benchmark passages in documents, by winnowed fingerprints.

Of every LEAD consecutive hashes of GRAM words the least is kept, in documents and items
alike. A run of GRAM + LEAD - 1 words that both share has the same hashes, hence a kept hash
in common: with 5 and 6, every shared window of 10 words is found. Kept hashes of all
documents are joined to those of the items; for documents with a hit, each hit is extended
to the windows around it, and their words are compared. Items shorter than a window are
looked for as a whole, by the hashes of as many words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelwise.llm.columns import ascii_lower, let, split_words
from duelwise.llm.scratch import settle

GRAM = 5
#: Fingerprints of the items that may be broadcast, at eight bytes each.
BROADCAST = 1 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(text), SEPARATORS)


def _hashes(words: Column, size: int) -> Column:
    """Rolling hashes of `size` words, none for fewer."""
    last = F.size(words) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(
        F.lit(size), *(F.get(words, i + k) for k in range(size))))).otherwise(
        F.array().cast("array<bigint>"))


def winnowed(words: Column, lead: int) -> Column:
    """Array of (h, p): the first least hash of each `lead` consecutive ones and its place."""

    def chosen(hashes: Column, least: Column) -> Column:
        # A window that keeps the least hash of the one before adds nothing.
        new = F.filter(F.sequence(F.lit(0), F.size(least) - 1), lambda j: (j == 0) | (
            F.get(least, j) != F.get(least, j - 1)) | (F.get(hashes, j - 1) == F.get(least, j)))
        return F.transform(new, lambda j: F.struct(
            F.get(least, j).alias("h"),
            (j + F.array_position(F.slice(hashes, j + 1, F.lit(lead)), F.get(least, j)) - 1)
            .cast("int").alias("p")))

    def kept(hashes: Column) -> Column:
        last = F.size(hashes) - lead
        return F.when(last >= 0, let(
            F.transform(F.sequence(F.lit(0), last), lambda j: F.array_min(
                F.slice(hashes, j + 1, F.lit(lead)))),
            lambda least: chosen(hashes, least)))

    return F.coalesce(let(_hashes(words, GRAM), kept), F.array().cast(_PRINTS))


_PRINTS = "array<struct<h:bigint,p:int>>"


def _short(words: Column, size: int) -> Column:
    return F.transform(_hashes(words, size), lambda h, p: F.struct(h.alias("h"), p.alias("p")))


def fingerprints(words: Column, window: int, lengths: list[int]) -> Column:
    """Array of (h, p) of a document: winnowed hashes, and all those of short items' lengths."""
    return F.concat(winnowed(words, window - GRAM + 1), *(_short(words, n) for n in lengths))


def _item_prints(items: DataFrame, window: int) -> DataFrame:
    """(h, item, size, near, lead): size is that of the item's windows, near the words around
    the hash, and lead how many of them come before it."""
    n = F.size("words")
    around = window - GRAM
    long_ = items.filter(n >= window).select(
        "item", "words", F.explode(winnowed(F.col("words"), window - GRAM + 1)).alias("f"))
    lead = F.least(F.col("f.p"), F.lit(around))
    long_ = long_.select(
        F.col("f.h").alias("h"), "item", F.lit(window).alias("size"),
        F.slice("words", F.col("f.p") - lead + 1, lead + window).alias("near"),
        lead.alias("lead"))
    short = items.filter((n > 0) & (n < window))
    for size in range(1, window):
        some = short.filter(n == size).select(
            F.get(_hashes(F.col("words"), size), F.lit(0)).alias("h"), "item",
            F.lit(size).alias("size"), F.col("words").alias("near"), F.lit(0).alias("lead"))
        long_ = long_.union(some)
    return long_


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10,
) -> DataFrame:
    """(row, n_words, n_hit, n_items, items) for every row of `docs`, which is the struct row.

    Words are runs of a-z, 0-9 and non-ASCII letters after lower-casing A-Z. A window is
    `window` consecutive words of an item, or all words of a shorter one; an item without
    words has none. n_hit counts the words of the document inside any occurrence of a
    window; items holds the ids of the items that occur, as sorted strings. A null text has
    no words. Rows that repeat, or lack an id, are judged by their text like others; items
    that share an id are one, and the hits of an item without id count, but not it. Without
    items nothing is hit.
    """
    if window < GRAM + 1:
        raise ValueError(f"windows of {GRAM + 1} words or more")
    items = settle(items.select(
        F.col(f"`{item_id_col}`").cast("string").alias("item"),
        words_of(F.col(f"`{item_text_col}`")).alias("words")).filter(F.size("words") > 0))
    prints = settle(_item_prints(items, window))
    lengths = sorted(r.size for r in prints.select("size").distinct().collect()
                     if r.size < window)
    wanted = settle(prints.select("h").distinct())
    if wanted.count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    source = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
        F.xxhash64(f"`{text_col}`").alias("part"), F.col(f"`{text_col}`").alias("text"))

    def printed(rows: DataFrame) -> DataFrame:
        return rows.withColumn(
            "f", F.explode(fingerprints(F.col("words"), window, lengths)))

    hit = settle(
        printed(source.select("id", "part", words_of(F.col("text")).alias("words")))
        .select("id", "part", F.col("f.h").alias("h")).join(wanted, "h", "left_semi")
        .select("id", "part").distinct()
    )
    near = printed(
        source.join(hit, ["id", "part"], "left_semi").dropDuplicates(["id", "part"])
        .select("id", "part", words_of(F.col("text")).alias("words")))
    around = window - GRAM
    before = F.least(F.col("f.p"), F.lit(around))
    near = near.select(
        "id", "part", F.col("f.h").alias("h"), F.col("f.p").alias("p"), before.alias("before"),
        F.slice("words", F.col("f.p") - before + 1, before + window).alias("own"))
    # A window that starts k words before the hash, in both.
    starts = F.filter(
        F.sequence(F.lit(0), F.least("before", "lead")),
        lambda k: (k <= F.col("size") - F.least(F.lit(GRAM), F.col("size")))
        & (F.size("near") >= F.col("lead") - k + F.col("size"))
        & (F.slice("own", F.col("before") - k + 1, F.col("size"))
           == F.slice("near", F.col("lead") - k + 1, F.col("size"))))
    found = settle(
        near.join(prints, "h").withColumn("k", F.explode(starts))
        .select("id", "part", (F.col("p") - F.col("k")).alias("start"), "size", "item").distinct()
    )
    places = found.groupBy("id", "part").agg(
        F.collect_set(F.struct("start", "size")).alias("places"),
        F.sort_array(F.collect_set("item")).alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        "places", lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1)))))
    places = settle(places.select("id", "part", covered.alias("n_hit"), "items"))
    rows = docs.select(
        F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"),
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
        F.xxhash64(f"`{text_col}`").alias("part"),
        F.coalesce(F.size(words_of(F.col(f"`{text_col}`"))), F.lit(0)).cast("long")
        .alias("n_words"))
    return rows.join(places, ["id", "part"], "left").select(
        "row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
