"""URL rules, and a character language model for URLs that no rule decides.

Two variable-order Markov models are counted over all URLs that the rules allow or block.
A character's chance mixes all orders: each one leans on the next lower the more, the fewer
times its context was seen. The mean log-likelihood difference per character is turned into
a probability on a fifth of those URLs that was not counted. Counts are exact, one row of a
table per context and next character, which grows with the input; URLs are joined to it, and
nothing of it is gathered on the driver or broadcast. Characters are UTF-8 bytes.

All joins are merged by request: Spark would tell sizes from compressed files, and a URL's
characters from the URL, and broadcast tables far over its limit through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duelwise.llm.columns import LOWER, UPPER
from duelwise.llm.scratch import settle, slot_counts
from duelwise.llm.words import text_slices

#: Characters of context at most.
ORDER = 5
#: Of the hashed table that counts were kept in before; read by nothing but an older test.
SLOTS = 1 << 17
#: Observations that the next lower order is worth.
LEAN = 2.0
#: Width and number of the bins of scores by which they are calibrated.
BIN, BINS = 0.01, 2000
_TABLE = (ORDER + 1) * SLOTS


Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ? or #, with A-Z lower-cased; else empty."""
    return F.coalesce(
        F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule = F.when(fits, own + start).otherwise(rule)
        verdict = F.when(fits, action).otherwise(verdict)
    return rule, verdict


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(url, gram) of each character: its context of ORDER bytes and itself, as one number."""
    size = np.diff(offsets)
    url = np.repeat(np.arange(len(size)), size)
    # Every URL is led by ORDER signs that no text has.
    at = np.arange(len(data)) + (url + 1) * ORDER
    padded = np.full(len(data) + len(size) * ORDER, 255, np.int64)
    padded[at] = data
    gram = np.zeros(len(data), np.int64)
    for back in range(ORDER, -1, -1):
        gram = gram << 8 | padded[at - back]
    return url, gram


def _counted(rows: DataFrame) -> DataFrame:
    """(gram, n0, n1): how often blocked and allowed URLs hold each gram of any URL.

    good is 1 of allowed, 0 of blocked, -1 of other URLs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = batch.column(1).to_numpy()
            for first, data, offsets in text_slices(batch.column(0)):
                url, gram = _grams(data, offsets)
                gram, place = np.unique(gram, return_inverse=True)
                side = good[first + url]
                yield pa.RecordBatch.from_arrays([pa.array(gram), *(pa.array(np.bincount(
                    place[side == s], minlength=len(gram)).astype(np.int64)) for s in (0, 1))],
                    names=["gram", "n0", "n1"])

    counted = rows.select("url", "good").mapInArrow(run, "gram long, n0 long, n1 long")
    return counted.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _model(grams: DataFrame) -> DataFrame:
    """(gram, d): log-likelihood difference of a gram's last character, allowed minus blocked.

    Each order is one table, joined to the next lower one by its grams' last bytes, so a key
    meets at most 256 rows.
    """
    orders = [grams]
    for order in range(ORDER - 1, -1, -1):
        short = F.col("gram").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))
        orders.append(settle(orders[-1].groupBy(short.alias("gram")).agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))))
    chances = None
    for order, table in enumerate(reversed(orders)):
        context = W.partitionBy(F.shiftright("gram", 8))
        table = table.select("gram", *(c for k in "01" for c in (
            F.col(f"n{k}"), F.sum(f"n{k}").over(context).alias(f"seen{k}"))))
        if chances is None:
            table = table.withColumns({f"p{k}": F.lit(1 / 256) for k in "01"})
        else:
            table = table.withColumn(
                "short", F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1))).join(
                chances.withColumnRenamed("gram", "short").hint("merge"), "short")
        chances = settle(table.select("gram", *(
            ((F.col(f"n{k}") + LEAN * F.col(f"p{k}")) / (F.col(f"seen{k}") + LEAN)).alias(f"p{k}")
            for k in "01")))
    return settle(chances.select("gram", (F.log("p1") - F.log("p0")).alias("d")))


def _ratios(rows: DataFrame, model: DataFrame) -> DataFrame:
    """(key, ratio): mean log-likelihood difference per character of each URL that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            for first, data, offsets in text_slices(batch.column(1)):
                url, gram = _grams(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[first + url]), pa.array(gram)], names=["key", "gram"])

    once = rows.filter("url <> ''").groupBy("key").agg(F.min("url").alias("url"))
    placed = once.select("key", "url").mapInArrow(run, "key long, gram long")
    return placed.join(model.hint("merge"), "gram").groupBy("key").agg(F.avg("d").alias("ratio"))


def calibrate(centre: np.ndarray, bad: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through binned scores, both sides weighing alike."""
    if not bad.sum() or not good.sum():
        return 1.0, 0.0
    bad, good = bad / bad.sum(), good / good.sum()
    x = np.stack([centre, np.ones_like(centre)])
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        slope = x @ (good - (good + bad) * p) - 1e-3 * theta
        bend = (x * ((good + bad) * p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        theta = theta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(theta[0], 1e-6)), float(theta[1])


def filter_urls(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url",
    least: float = 0.5,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, ratio, probability) for every row of `pages`.

    rules are (verdict, host, path), verdict being allow or block. The longest fitting rule
    decides; else the model: allow from the probability `least` on. ratio is the model's
    score, probability its calibrated chance of allow. The model reads what follows ://.
    If the rules allow or block no URL at all there is no model: ratio 0, probability 0.5.
    A null URL, or one without ://, has an empty host and path, no rule and ratio 0. Rows
    may repeat; other columns are not read.
    """
    url = F.col(f"`{url_col}`")
    host, path = host_of(url), path_of(url)
    rule, verdict = matching_rule(host, path, rules)
    rows = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"),
        rule.alias("rule"), verdict.alias("decided"),
        F.coalesce(F.regexp_extract(url, r"://([\s\S]*)", 1), F.lit("")).alias("url"))
    # Rows alike in id and URL share a key; a common URL alone does not make one.
    rows = settle(rows.withColumn("key", F.xxhash64("page_id", "url")))
    fold = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(5))
    good = (F.col("decided") == "allow").cast("int")
    counts = settle(_counted(rows.select(
        "url", F.when(fold != 0, good).alias("good")).fillna(-1, ["good"])))
    sides = counts.agg(F.sum("n0"), F.sum("n1")).head()
    if sides[0] and sides[1]:
        ratios = settle(_ratios(rows, _model(counts)))
        scored = rows.join(ratios.hint("merge"), "key", "left").fillna(0.0, ["ratio"])
    else:
        scored = rows.withColumn("ratio", F.lit(0.0))
    place = F.least(F.greatest(F.floor(F.col("ratio") / BIN) + BINS // 2, F.lit(0)),
                    F.lit(BINS - 1)).cast("int")
    bins = scored.filter((fold == 0) & F.col("decided").isNotNull()).select(
        (place + good * BINS).alias("slot"))
    held = slot_counts(bins, "slot", 2 * BINS)
    centre = (np.arange(BINS) - BINS // 2 + 0.5) * BIN
    slope, offset = calibrate(centre, held[:BINS], held[BINS:])
    scored = scored.withColumn(
        "probability", 1 / (1 + F.exp(-(F.col("ratio") * slope + F.lit(offset)))))
    return scored.select(
        "page_id", "host", "path", "rule",
        F.coalesce("decided", F.when(F.col("probability") >= least, "allow").otherwise("block"))
        .alias("verdict"), "ratio", "probability")
