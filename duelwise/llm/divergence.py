"""Divergence of the sources of a language, by bitmaps of count levels.

Terms of a language get numbers, 64 to a word. For every group, word and count there is one
bitmap of the terms that the group has so often. For two groups, the AND of two bitmaps has
as many bits as there are terms with these two counts; times the difference of the two
shares, that is what these terms add. Terms that a group lacks are the complement of all its
bitmaps, as a level of count 0. Most terms share few counts, so words hold many terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duelwise.llm.scratch import TEXTS, settle

#: Shares are counted in parts of this.
UNIT = 1_000_000_000
#: Added to every count.
PRIOR = 5
#: Distinct (group, term) pairs that a task holds before it hands them on.
HELD = 200_000
#: Terms whose bitmaps are compared in one go.
BLOCK = 1024
#: Cells of two bitmaps compared at once.
CELLS = 1 << 20

#: Runs of ASCII letters and characters beyond ASCII, as UTF-8 bytes.
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows with the term; one row per task's
    share. A group without terms has a row with a null term, n 0, and its rows as docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows, held = {}, {}, 0

        def flushed() -> pa.RecordBatch:
            keys = [(g, t) for g, counts in rows.items() for t in counts]
            return pa.RecordBatch.from_arrays([
                pa.array([g[0] for g, _ in keys], pa.string()),
                pa.array([g[1] for g, _ in keys], pa.string()),
                pa.array([None if t is None else t.decode() for _, t in keys], pa.string()),
                pa.array([n[g][t] for g, t in keys], pa.int64()),
                pa.array([rows[g][t] for g, t in keys], pa.int64()),
            ], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for text, *group in zip(*(c.to_pylist() for c in batch.columns)):
                group = tuple(group)
                own = Counter(_TERM.findall((text or "").encode().lower()))
                if group not in n:
                    n[group], rows[group] = Counter(), Counter()
                held -= len(n[group])
                n[group].update(own)
                rows[group].update(own.keys())
                rows[group][None] += 1
                held += len(n[group])
                if held > HELD:
                    yield flushed()
                    n, rows, held = {}, {}, 0
        if rows:
            yield flushed()

    given = docs.select(
        F.col(f"`{text_col}`").alias("text"),
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source"))
    return given.mapInArrow(
        run, "lang string, source string, term string, n long, docs long")


def share(n: str, total: str) -> Column:
    """The smoothed share of a count, in whole parts; `total` includes the added counts."""
    parts = F.call_function("div", (F.col(n) + PRIOR).cast("decimal(19,0)")
                            * F.lit(UNIT).cast("decimal(10,0)"), F.col(total).cast("decimal(19,0)"))
    return (F.lit(1) + parts).cast("long")


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, whole): terms in so many rows of a language, with their occurrences."""
    return (
        counts.filter("term is not null").groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole"))
        .filter(F.col("docs") >= least_docs).drop("docs")
    )


def numbered(terms: DataFrame) -> DataFrame:
    """(lang, term, whole, block, word, bit): terms of similar counts are in one block.

    Blocks are drawn by a hash among as many as the terms of that magnitude need, so that no
    task numbers a whole language.
    """
    sized = terms.withColumn("magnitude", F.floor(F.log2("whole")).cast("int"))
    need = sized.groupBy("lang", "magnitude").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    drawn = sized.join(need, ["lang", "magnitude"]).withColumn("block", F.concat_ws(
        ".", "magnitude", F.pmod(F.xxhash64("term"), F.col("blocks"))))
    place = F.row_number().over(
        W.partitionBy("lang", "block").orderBy(F.desc("whole"), "term")) - 1
    return drawn.withColumn("place", place).select(
        "lang", "term", "whole", "block", F.floor(F.col("place") / 64).cast("int").alias("word"),
        (F.col("place") % 64).cast("int").alias("bit"))


def _joint(table: pa.Table) -> tuple[list[str], np.ndarray]:
    """(sources, matrix of differences summed over the terms) of one block."""
    coded = table.column("source").combine_chunks().dictionary_encode()
    names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    word, n, p, bits = (table.column(c).to_numpy() for c in ("word", "n", "p", "bits"))
    order = np.lexsort((code, word))
    word, code, n, p = word[order], code[order], n[order], p[order]
    bits = bits[order].astype(np.int64).view(np.uint64)
    total = np.zeros((len(names), len(names)), np.int64)
    edges = np.append(np.flatnonzero(np.append(True, word[1:] != word[:-1])), len(word))
    for low, high in zip(edges[:-1], edges[1:]):
        c, level, mine = code[low:high], n[low:high], bits[low:high].copy()
        starts = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        present = np.bitwise_or.reduceat(np.where(level > 0, mine, np.uint64(0)), starts)
        absent = np.repeat(~present, np.diff(np.append(starts, len(c))))
        mine[level == 0] &= absent[level == 0]
        some = np.flatnonzero(mine)
        c, mine, own = c[some], mine[some], p[low:high][some]
        starts = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        step = max(1, CELLS // len(c))
        for i in range(0, len(c), step):
            cells = np.bitwise_count(mine[i:i + step, None] & mine).astype(np.int64)
            cells *= np.abs(own[i:i + step, None] - own)
            np.add.at(total, (c[i:i + step, None], c[starts]), np.add.reduceat(cells, starts, 1))
    return names, total


def pair_sums(levels: DataFrame) -> DataFrame:
    """(lang, source, item, value) summed over blocks, from the bitmaps of count levels."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        names, total = _joint(table)
        first, second = np.nonzero(~np.eye(len(names), dtype=bool))
        return pa.table({
            "lang": pa.array([key[0].as_py()] * len(first), pa.string()),
            "source": pa.array([names[i] for i in first], pa.string()),
            "item": pa.array([names[i] for i in second], pa.string()),
            "value": pa.array(total[first, second], pa.int64())})

    return levels.groupBy("lang", "block").applyInArrow(
        run, "lang string, source string, item string, value long"
    ).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least_docs: int = 30, top: int = 50,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every language and source of `docs`.

    Terms are runs of letters (a-z after lower-casing A-Z, and all beyond ASCII); a language
    keeps those in at least `least_docs` of its rows. With a group's count n of a kept term,
    N of all of them and V kept terms, its share is 1 + floor(10^9 (n + 5) / (N + 5 V)).
    Part `pair` has for each other source of the language the sum of absolute differences of
    shares over all kept terms (0 without any), part `term` the `top` kept terms of the group
    whose share is above the language's, by that difference. Ranks count from 1, larger values
    first, then by the bytes of the item. Null texts, languages and sources count as empty
    strings; repeated rows count each time; an empty table gives no rows. All is exact.
    """
    counts = settle(
        term_counts(docs, text_col, lang_col, source_col).groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), TEXTS)
    terms = settle(numbered(kept_terms(counts, least_docs)))
    kept = settle(counts.filter("term is not null").join(terms, ["lang", "term"]).select(
        "lang", "source", "term", "n", "whole", "block", "word", "bit"))
    sizes = terms.groupBy("lang").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("whole").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    added = F.coalesce("terms", F.lit(0)) * PRIOR
    groups = settle(
        counts.filter("term is null").select("lang", "source").join(sizes, "lang", "left")
        .join(own, ["lang", "source"], "left").select(
            "lang", "source", (F.coalesce("own_n", F.lit(0)) + added).alias("total"),
            (F.coalesce("lang_n", F.lit(0)) + added).alias("lang_total")))
    place = ["lang", "block", "word"]
    bits = F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")
    seen = kept.groupBy(*place, "source", "n").agg(bits)
    # Level 0: all terms of the word; the task takes those of the other levels away.
    rest = terms.groupBy(*place).agg(bits).join(groups.select("lang", "source"), "lang").select(
        *place, "source", F.lit(0).cast("long").alias("n"), "bits")
    levels = seen.unionByName(rest).join(groups, ["lang", "source"]).select(
        *place, "source", "n", share("n", "total").alias("p"), "bits")
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = (
        groups.select("lang", "source").join(others, "lang").filter("source <> item")
        .join(pair_sums(levels), ["lang", "source", "item"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item",
                F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    )
    marked = (
        kept.join(groups, ["lang", "source"])
        .withColumn("value", share("n", "total") - share("whole", "lang_total"))
        .filter("value > 0")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    )
    rank = F.row_number().over(
        W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    marked = marked.withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(marked)
