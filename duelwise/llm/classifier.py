"""Text quality by logistic regression on hashed word n-grams.

Features of a text are its words, its pairs of neighbouring words, and the same two for the
words' shapes (runs of letters, capitals and digits shrunk to one sign, other signs kept);
a pair of equal words is one feature of its own. Each family's counts are divided by their
number plus SMOOTH, so a score is the bias plus mean weights, a sparse dot product without
sorting, and a short text stays near the bias: the log odds of the labels.

Weights are learnt by follow-the-regularised-leader updates, one text at a time, in shards
of a bounded sample of labelled rows; the shards' weights are averaged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelwise.llm.words import SPACED, hash_runs, mix, split_words, text_slices

#: Weights; the bias is the last one.
SIZE = 1 << 18
#: Labelled rows that are learnt from, and how many of them a shard holds, at about.
MAX_ROWS, SHARD_ROWS = 16_000, 4_000
EPOCHS, RATE, BETA, L1, L2 = 4, 4.0, 1.0, 1e-4, 1e-4
SMOOTH = 8

_code = np.arange(256)
_SHAPE = np.where((_code >= 97) & (_code <= 122) | (_code >= 128), 97, _code)
_SHAPE = np.where((_code >= 65) & (_code <= 90), 65, _SHAPE)
_SHAPE = np.where((_code >= 48) & (_code <= 57), 48, _SHAPE).astype(np.uint8)


def features(data: np.ndarray, offsets: np.ndarray):
    """(words per text, a list of (feature, text) per family) for a run of texts."""
    words = split_words(data, offsets, SPACED)
    text = words.text
    shape = _SHAPE[data]
    sign = np.ones(len(data), bool)
    sign[1:] = shape[1:] != shape[:-1]
    sign[words.start] = True
    at = np.append(0, np.cumsum(sign))
    shapes = hash_runs(shape[sign], at[words.start], at[words.end])
    pair = text[1:] == text[:-1]
    families = [(words.hash, text), (shapes, text)]
    for salt, own in enumerate((words.hash, shapes), 2):
        both = mix(own[:-1] + np.uint64(salt)) + own[1:]
        if salt == 2:
            both = np.where(own[:-1] == own[1:], np.uint64(0), both)
        families.append((both[pair], text[1:][pair]))
    slots = [((mix(h + np.uint64(i * 977 + 13)) % np.uint64(SIZE - 1)).astype(np.int64), t)
             for i, (h, t) in enumerate(families)]
    return np.diff(words.offsets), slots


def logits(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The bias plus the mean weight of each family; the bias alone for a text without words."""
    texts = len(offsets) - 1
    total = np.full(texts, float(weights[-1]))
    for slot, text in features(data, offsets)[1]:
        counts = np.bincount(text, minlength=texts)
        sums = np.bincount(text, weights=weights[slot].astype(np.float64), minlength=texts)
        total += sums / (counts + SMOOTH)
    return total


def _examples(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots, values) of each text."""
    for _, data, offsets in text_slices(column):
        _, families = features(data, offsets)
        bounds = [np.searchsorted(t, np.arange(len(offsets))) for _, t in families]
        for i in range(len(offsets) - 1):
            parts = [s[b[i]:b[i + 1]] for (s, _), b in zip(families, bounds)]
            value = np.concatenate([np.full(len(p), 1 / (len(p) + SMOOTH)) for p in parts])
            slot, where = np.unique(np.concatenate(parts), return_inverse=True)
            yield slot, np.bincount(where, value, minlength=len(slot))


def train(texts: pa.Array, quality: np.ndarray) -> np.ndarray:
    """Weights after EPOCHS passes over the texts, in their order."""
    examples = list(_examples(texts))
    z, n = np.zeros(SIZE), np.zeros(SIZE)
    good = int(quality.sum())
    bias = math.log((good + 1) / (len(quality) - good + 1))

    def weights(slot: np.ndarray) -> np.ndarray:
        lead = z[slot]
        shrunk = np.sign(lead) * np.maximum(np.abs(lead) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[slot])) / RATE + L2)

    for _ in range(EPOCHS):
        for (slot, value), label in zip(examples, quality):
            w = weights(slot)
            logit = min(max(bias + float(w @ value), -35.0), 35.0)
            slope = (1 / (1 + math.exp(-logit)) - label) * value
            squares = slope * slope
            grown = n[slot] + squares
            z[slot] += slope - (np.sqrt(grown) - np.sqrt(n[slot])) / RATE * w
            n[slot] = grown
    found = weights(np.arange(SIZE))
    found[-1] = bias
    return found.astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> np.ndarray:
    """Weights learnt from labelled rows outside the held-out quarter.

    Of more than MAX_ROWS such rows, about MAX_ROWS are drawn by a hash of the id. Rows
    without id or label are left out; of several labels of one id the mean is taken, and
    0.5 counts as 1. Without any label all weights are 0 and every score is 0.5.
    """
    marked = (
        labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).alias("y"))
        .filter("i is not null and y is not null").filter(~held_out(F.col("i")))
        .groupBy("i").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    )
    size = marked.count()
    if not size:
        return np.zeros(SIZE, np.float32)
    draw = F.pmod(F.xxhash64("i"), F.lit(1 << 30))
    marked = marked.filter(draw < math.ceil(min(1.0, MAX_ROWS / size) * (1 << 30)))
    shards = -(-min(size, MAX_ROWS) // SHARD_ROWS)
    # About MAX_ROWS rows of two numbers, so the join needs no shuffle of the texts.
    chosen = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("text")).join(
        F.broadcast(marked), "i").select(
        F.pmod(F.xxhash64("i", F.lit(7)), F.lit(shards)).alias("shard"), "i", "text", "y")

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("i", "ascending"), ("text", "ascending")])
        ids = table.column("i").to_numpy().astype(np.uint64)
        order = np.argsort(mix(ids), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        texts = table.column("text").cast(pa.large_string()).combine_chunks()
        found = train(texts, table.column("y").to_numpy())
        return pa.table({"rows": pa.array([len(table)], pa.int64()),
                         "weights": pa.array([found.tobytes()], pa.binary())})

    parts = chosen.groupBy("shard").applyInArrow(learn, "rows long, weights binary").toArrow()
    if not len(parts):
        return np.zeros(SIZE, np.float32)
    rows = parts.column(0).to_numpy()
    found = np.stack([np.frombuffer(x.as_py(), np.float32) for x in parts.column(1)])
    order = np.lexsort((found[:, -1], rows))
    return np.average(found[order], axis=0, weights=rows[order]).astype(np.float32)


def held_out(id_):
    """Whether a row is never learnt from; false without id."""
    crc = F.crc32(id_.cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(4)) == 2, F.lit(False))


def score(
    docs: DataFrame, weights: np.ndarray, text_col: str = "text", out: str = "quality_score"
) -> DataFrame:
    """All columns of `docs`, then `out` from 0 to 1; null texts count as empty, and texts
    without words get the bias. The name `out` must be new to `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = docs.columns
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in names)).alias("row"),
                       docs[f"`{text_col}`"].alias("text"))

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            found = [logits(data, offsets, shared.value)
                     for _, data, offsets in text_slices(column)]
            total = np.concatenate(found) if found else np.empty(0)
            yield pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))), pa.float64())

    scored = F.arrow_udf(run, "double")
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in names),
                       scored("text").alias(out))
