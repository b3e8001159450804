"""Quality rules: fixed limits, then robust multivariate outliers.

Every text gives a vector of transformed statistics. Per language and source the minimum
covariance determinant of the vectors is sought by concentration steps: from medians and
median deviations on, the half of the texts (HALF of them) that lie nearest give the next
mean and covariance. Texts far from that centre, by Mahalanobis distance, are rejected.
Copies of one text count once in all estimates, so junk may fill a group with its copies;
different texts of junk may fill up to half of it. There is one start, the medians: of
several, the least determinant would favour a tight cluster of junk.

Medians and limits are read from histograms, so a group of any size is summed up where its
rows are, and no group is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duelwise.llm.columns import let, split_words
from duelwise.llm.scratch import settle

#: Share of a group that the covariance is taken from, steps towards it, least group.
HALF, STEPS, LEAST_GROUP = 0.5, 5, 100
#: Rows that what a group is shrunk towards is worth.
WORTH = 100.0
#: Squared robust distance from which a text is an outlier.
CUTOFF = 200.0
#: Median of the chi-square distribution with five degrees of freedom.
CHI_MEDIAN = 4.351
#: Width of a histogram's bins, of statistics and of log distances.
BIN = 0.01
#: Least spread of each statistic: smaller differences are never odd.
LEAST_SPREAD = (0.5, 0.05, 0.05, 0.2, 1.0)
SPACE = r"[\x20\x09-\x0D]+"
N = len(LEAST_SPREAD)


def _covered(hashes: Column) -> Column:
    """Words in three-word windows that occur twice or more, from the windows' hashes."""

    def repeated(sorted_: Column) -> Column:
        same = F.filter(sorted_, lambda x, k: (x["h"] == F.get(sorted_, k - 1)["h"]) | (
            F.coalesce(x["h"] == F.get(sorted_, k + 1)["h"], F.lit(False))))
        return F.size(F.array_distinct(F.flatten(F.transform(
            same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
        let(F.array_sort(placed), repeated))


def _repeats(words: Column) -> Column:
    last = F.size(words) - 3
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(last >= 1, let(hashes, _covered)).otherwise(F.lit(0))


def base_statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; null text: 0.

    Equal three-word windows of a text are those with equal 64-bit hashes.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counted(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
            .alias("n_dup_lines"),
            _repeats(words).cast("long").alias("n_repeat_words"))

    return let(split_words(text, SPACE), counted)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> list[Column]:
    """Transformed statistics of a text that has words."""
    return [F.log("n_words"), F.log(F.col("word_chars") / F.col("n_words")),
            F.sqrt(F.col("n_symbols") / F.col("word_chars")),
            F.sqrt(F.col("n_repeat_words") / F.col("n_words")), F.log1p("n_dup_lines")]


def _quantile(df: DataFrame, value: str, share: float, *by: str) -> DataFrame:
    """(*by, cut): the number of the bin that holds the share of each group's rows."""
    bins = df.groupBy(*by, F.floor(F.col(value) / BIN).alias("cut")).count()
    up = W.partitionBy(*by).orderBy("cut")
    total = F.sum("count").over(W.partitionBy(*by))
    return (
        bins.withColumn("reached", F.sum("count").over(up) >= share * total)
        .filter("reached").groupBy(*by).agg(F.min("cut").alias("cut"))
    )


def _scale(rows: DataFrame) -> DataFrame:
    """(g, median and spread of each statistic) of each group."""
    long_ = rows.select("g", F.posexplode("x").alias("k", "v"))
    median = settle(_quantile(long_, "v", 0.5, "g", "k").select(
        "g", "k", ((F.col("cut") + 0.5) * BIN).alias("m")))
    off = long_.join(median, ["g", "k"]).withColumn("v", F.abs(F.col("v") - F.col("m")))
    spread = settle(_quantile(off, "v", 0.5, "g", "k"))
    least = F.element_at(F.array(*(F.lit(x) for x in LEAST_SPREAD)), F.col("k") + 1)
    both = median.join(spread, ["g", "k"]).withColumn(
        "s", F.greatest(1.4826 * (F.col("cut") + 0.5) * BIN, least))
    return settle(both.groupBy("g").agg(
        *(F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}")
          for k in range(N) for c in "ms")))


def _standard(rows: DataFrame, scale: DataFrame) -> DataFrame:
    """Rows with z, the vector less its group's medians over its median deviations."""
    return rows.join(scale, "g").select(
        *rows.columns, *(((F.get("x", F.lit(k)) - F.col(f"m{k}")) / F.col(f"s{k}")).alias(f"z{k}")
                         for k in range(N)))


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(N) for j in range(i + 1)]


def _moments(rows: DataFrame) -> DataFrame:
    """(g, means of z and of its products) of each group."""
    return rows.groupBy("g").agg(
        *(F.avg(f"z{i}").alias(f"a{i}") for i in range(N)),
        *(F.avg(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"q{i}{j}") for i, j in _pairs()))


def _estimate(rows: DataFrame) -> DataFrame:
    """(g, mean and lower Cholesky factor of the covariance) of the rows of each group."""
    return _factor(_moments(rows))


def _factor(sums: DataFrame) -> DataFrame:
    """The same from means of z and of its products.

    A small ridge keeps statistics that hardly vary from making everything odd.
    """
    for i in range(N):
        for j in range(i + 1):
            left = F.col(f"q{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}")
            left = left + (0.1 if i == j else 0.0)
            for k in range(j):
                left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            sums = sums.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(1e-6)))
                                   if i == j else left / F.col(f"l{j}{j}"))
    return sums.select("g", *(f"a{i}" for i in range(N)), *(f"l{i}{j}" for i, j in _pairs()))


def _distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Rows with d2, the squared Mahalanobis distance, and its logarithm."""
    out, names = rows.join(estimate, "g"), rows.columns
    for i in range(N):
        left = F.col(f"z{i}") - F.col(f"a{i}")
        for k in range(i):
            left = left - F.col(f"l{i}{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", left / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, N)), F.col("y0") * F.col("y0"))
    return out.withColumn("d2", d2).select(*names, "d2", F.log(F.col("d2") + 1e-9).alias("log_d2"))


def _nearest(rows: DataFrame) -> DataFrame:
    cut = settle(_quantile(rows, "log_d2", HALF, "g"))
    return rows.join(cut, "g").filter(F.floor(F.col("log_d2") / BIN) <= F.col("cut"))


def outliers(rows: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Rows (.., g, x) with d2, the robust squared distance in their group.

    Estimates are taken from `counted` (g, x), where copies are left out; else from all rows.
    A group of fewer than LEAST_GROUP rows is judged with all other such rows as one group;
    if these are fewer, too, d2 is 0.
    """
    sizes = settle(rows.groupBy("g").agg((F.count(F.lit(1)) < LEAST_GROUP).alias("few")))
    few = F.when(F.col("few"), "").otherwise(F.col("g"))
    of = rows if counted is None else counted
    of = settle(of.join(sizes, "g").withColumn("g", few).drop("few"))
    rows = rows.join(sizes, "g").withColumn("g", few).drop("few")
    scale = _scale(of)
    rows, of = settle(_standard(rows, scale)), settle(_standard(of, scale))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(N)), F.lit(0.0))
    near = _nearest(of.withColumn("d2", d2).withColumn("log_d2", F.log(F.col("d2") + 1e-9)))
    for _ in range(STEPS - 1):
        near = _nearest(_distance(of, settle(_estimate(near))))
    last = settle(_estimate(near))
    found = _distance(rows, last)
    # The nearest rows understate the spread; the median distance is made that of a normal.
    middle = settle(_quantile(_distance(of, last), "log_d2", 0.5, "g"))
    enough = settle(rows.groupBy("g").agg((F.count(F.lit(1)) >= LEAST_GROUP).alias("enough")))
    grown = F.greatest(F.exp((F.col("cut") + 0.5) * BIN) / CHI_MEDIAN, F.lit(1.0))
    return found.join(middle, "g").join(enough, "g").withColumn(
        "d2", F.when(F.col("enough"), F.col("d2") / grown).otherwise(0.0))


def _levels(rows: DataFrame) -> DataFrame:
    """Each row for its group, for its language and for the whole."""
    return rows.withColumn("g", F.explode(F.array("g", "up", F.lit(""))))


def _shrunk(table: DataFrame, tree: DataFrame, unit: dict[str, float]) -> DataFrame:
    """(g, values): each group's mean with those of its language, and these with the whole's.

    table has values for all levels, tree (g, up, n, n_up, n_all). What is above counts for
    WORTH rows; above the whole are the values of `unit`, where it has any.
    """
    names = [c for c in table.columns if c != "g"]

    def mean(n: str, own: Column, above: Column) -> Column:
        return (F.col(n) * own + WORTH * above) / (F.col(n) + WORTH)

    up = table.select(F.col("g").alias("up"), *(F.col(c).alias(f"up_{c}") for c in names))
    all_ = table.filter("g = ''").select(*(F.col(c).alias(f"all_{c}") for c in names))
    rows = tree.join(table, "g").join(up, "up").crossJoin(all_)
    whole = {c: mean("n_all", F.col(f"all_{c}"), F.lit(unit[c])) if c in unit
             else F.col(f"all_{c}") for c in names}
    return rows.select("g", *(mean("n", F.col(c), mean("n_up", F.col(f"up_{c}"), whole[c])).alias(c)
                              for c in names))


def shrunk_outliers(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """Rows (.., g, up, x) with d2, the robust squared distance in their group.

    As `outliers`, but groups of every size by one formula: medians, spreads, moments and the
    last scale of a group g are shrunk towards its language `up`, and these towards the
    whole, by weight of rows; the whole's moments towards those of independent statistics of
    spread 1. Neither g nor up may be empty or shared between levels.
    """
    of = settle(counted)
    tree = of.groupBy("g", "up").agg(F.count(F.lit(1)).alias("n"))
    tree = settle(tree.withColumn("n_up", F.sum("n").over(W.partitionBy("up"))))
    tree = settle(tree.crossJoin(tree.agg(F.sum("n").alias("n_all"))))
    scale = settle(_shrunk(_scale(_levels(of)), tree, {}).select("g", *(
        F.col(f"{c}{k}") for k in range(N) for c in "ms")))
    rows, of = settle(_standard(rows, scale)), settle(_standard(of, scale))
    unit = {f"a{i}": 0.0 for i in range(N)} | {f"q{i}{j}": float(i == j) for i, j in _pairs()}
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(N)), F.lit(0.0))
    near = _nearest(of.withColumn("d2", d2).withColumn("log_d2", F.log(F.col("d2") + 1e-9)))
    for step in range(STEPS):
        last = settle(_factor(_shrunk(settle(_moments(_levels(near))), tree, unit)))
        if step < STEPS - 1:
            near = _nearest(_distance(of, last))
    middle = settle(_quantile(_levels(_distance(of, last)), "log_d2", 0.5, "g"))
    middle = settle(_shrunk(middle.withColumn("cut", F.col("cut").cast("double")), tree, {}))
    grown = F.greatest(F.exp((F.col("cut") + 0.5) * BIN) / CHI_MEDIAN, F.lit(1.0))
    return _distance(rows, last).join(middle, "g").withColumn("d2", F.col("d2") / grown)


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    source_col: str = "source", cutoff: float = CUTOFF,
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, distance) for every row of `docs`.

    base_failed: fewer than 50 words, or more than half of them in repeated windows. kept is
    false for these and for outliers among the others. distance is the robust squared
    distance, null where base_failed. A null text counts as empty and fails; a null
    language or source is a value of its own; rows may repeat. Other columns are not read.
    """
    lang, source = (*(F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")),
                                 F.lit("n")) for c in (lang_col, source_col)),)
    name = F.concat_ws("\x01", F.lit("2"), lang, source)
    rows = settle(docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), name.alias("g"),
        F.concat_ws("\x01", F.lit("1"), lang).alias("up"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("copy"),
        base_statistics(F.col(f"`{text_col}`")).alias("s")
    ).select("doc_id", "g", "up", "copy", "s.*").withColumn("base_failed", base_failed()))
    passed = rows.filter(~F.col("base_failed")).withColumn("x", F.array(*_vector()))
    once = passed.groupBy("g", "up", "copy").agg(F.min("x").alias("x"))
    judged = shrunk_outliers(passed, once.select("g", "up", "x")).withColumnRenamed("d2", "distance")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "base_failed"]
    failed = rows.filter("base_failed").select(
        *names, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return judged.select(*names, (F.col("distance") <= cutoff).alias("kept"), "distance").union(
        failed)
