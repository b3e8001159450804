"""Fits with tidy coefficient tables: logistic with standard errors, and ridge."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import term_parts
from ..operators.ranking import league_mean
from ..operators.reshape import spread
from . import newton
from .design import aliased_columns, assemble, correlations

TIDY = "term string, estimate double, `std.error` double, statistic double, `p.value` double"
INTERCEPT = "(Intercept)"
IRLS_STEPS, LBFGS_STEPS = 50, 500


def _warn_unless(converged: bool, what: str) -> None:
    if not converged:
        warnings.warn(f"{what} stopped before it converged", RuntimeWarning, stacklevel=3)


def terms_frame(spark: SparkSession, rows: list[tuple], schema: str = TIDY) -> DataFrame:
    """A coefficient table: one row per model term, never more."""
    return spark.createDataFrame(rows, schema)


def fit_logistic(
    df: DataFrame, label: Column, terms: list[str], numeric: list[str] | None = None,
    intercept: bool = True, exponentiate: bool = True, solver: str = "irls",
):
    """Unregularised logistic regression.

    Returns the model, the names of its columns, and a tidy table in which ``estimate``
    is an odds ratio. Terms that depend linearly on earlier ones are left out of the fit
    and listed with NULL values. The caller chooses the solver, and with it the table:
    ``irls``, iteratively reweighted least squares, gives standard errors and takes up to
    4096 columns, Spark's limit for normal equations, beyond which it fails; ``lbfgs``
    takes any number and gives estimates only. A fit that stops before it has converged
    gives a warning. ``df`` is read once per iteration: settle it first.
    """
    if solver not in ("irls", "lbfgs"):
        raise ValueError(f"no solver {solver}")
    numeric = numeric or []
    names = [*numeric, *terms]
    labelled = df.withColumn("label", label.cast("double"))
    rows = labelled.select("label", *(["terms"] if terms else []), *numeric)
    gone: set[str] = set()
    if intercept and len(names) > 1:
        dropped = aliased_columns(correlations(assemble(rows, terms, numeric)))
        gone = {names[i] for i in dropped}
    used_numeric = [n for n in numeric if n not in gone]
    used_terms = [t for t in terms if t not in gone]
    vectors = assemble(rows, used_terms, used_numeric)
    order = [*used_numeric, *used_terms]
    if solver == "irls":
        model = GeneralizedLinearRegression(
            family="binomial", link="logit", fitIntercept=intercept, maxIter=IRLS_STEPS, tol=1e-8
        ).fit(vectors)
        summary = model.summary
        _warn_unless(summary.numIterations < IRLS_STEPS, "logistic fit")
        columns = [summary.coefficientStandardErrors, summary.tValues, summary.pValues]
    else:
        model = LogisticRegression(
            regParam=0.0, fitIntercept=intercept, maxIter=LBFGS_STEPS, tol=1e-9
        ).fit(vectors)
        _warn_unless(model.summary.totalIterations < LBFGS_STEPS, "logistic fit")
        columns = [[None] * (len(order) + 1)] * 3
    found = dict(zip(
        [*order, *([INTERCEPT] if intercept else [])],
        zip([*model.coefficients.toArray().tolist(), *([model.intercept] if intercept else [])],
            *columns),
    ))
    table = []
    for name in [*([INTERCEPT] if intercept else []), *names]:
        estimate, *rest = found.get(name, (None,) * 4)
        if estimate is not None and exponentiate:
            estimate = math.exp(estimate)
        table.append((name, estimate, *rest))
    return model, (used_terms, used_numeric), terms_frame(df.sparkSession, table)


def logistic_table(
    df: DataFrame, label: Column, terms: list[str], numeric: list[str] | None = None,
    intercept: bool = True, exponentiate: bool = True,
) -> DataFrame:
    """The tidy table of an unregularised logistic regression of any width.

    As ``fit_logistic`` gives it with standard errors, without a model, and with no bound on
    the columns but the driver's memory for a matrix of terms. Terms that depend linearly on
    the intercept, if there is one, and on earlier terms have NULL values.
    """
    numeric = numeric or []
    with newton.read_often(newton.design(df, label, terms, numeric)) as data:
        found = newton.newton(data, [0.0], [-2], intercept)
    _warn_unless(found.converged, "logistic fit")
    errors = newton.standard_errors(found.matrices[0], found.kept[0])
    names = [INTERCEPT, *numeric, *terms]
    table = []
    for name, value, error, kept in zip(names, found.betas[0], errors, found.kept[0]):
        if name == INTERCEPT and not intercept:
            continue
        row = (None,) * 4
        if kept:
            z = float(value / error)
            row = (math.exp(value) if exponentiate else float(value), float(error), z,
                   newton.p_value(z))
        table.append((name, *row))
    return terms_frame(df.sparkSession, table)


def predict(model, df: DataFrame, columns: tuple[list[str], list[str]]) -> DataFrame:
    """Rows with the model's ``prediction``: a probability, or a value for ridge linear."""
    scored = model.transform(assemble(df, *columns))
    if "probability" in scored.columns:
        positive = vector_to_array("probability").getItem(1)
        scored = scored.withColumn("prediction", positive)
    return scored.drop("features", "held", "rawPrediction", "probability")


def _ridge(df: DataFrame, label: Column, terms, numeric, estimator):
    labelled = df.withColumn("label", label.cast("double"))
    rows = labelled.select("label", "terms", *(numeric or []))
    model = estimator.fit(assemble(rows, terms, numeric))
    names = [INTERCEPT, *(numeric or []), *terms]
    values = [model.intercept, *model.coefficients.toArray().tolist()]
    table = terms_frame(
        df.sparkSession, list(zip(names, map(float, values))), "term string, estimate double"
    )
    return model, (terms, numeric or []), table


def fit_ridge_logistic(
    df: DataFrame, label: Column, terms: list[str], numeric: list[str] | None = None,
    penalty: float = 1e-9,
):
    """Logistic regression with an L2 penalty on standardised columns, on the log-odds scale."""
    estimator = LogisticRegression(
        regParam=penalty, elasticNetParam=0.0, standardization=True, maxIter=LBFGS_STEPS,
        tol=1e-7,
    )
    return _ridge(df, label, terms, numeric, estimator)


def fit_ridge_linear(
    df: DataFrame, label: Column, terms: list[str], numeric: list[str] | None = None,
    penalty: float = 1e-9, solver: str = "normal",
):
    """Linear regression with an L2 penalty on standardised columns.

    ``normal`` takes up to 4096 columns, Spark's limit, and fails beyond; ``l-bfgs`` any number.
    """
    estimator = LinearRegression(
        regParam=penalty, elasticNetParam=0.0, standardization=True, solver=solver
    )
    return _ridge(df, label, terms, numeric, estimator)


def penalty_levels(levels: int = 10, low: float = -10.0, high: float = 0.0) -> list[float]:
    """Penalties equally spaced in the exponent of ten."""
    if levels == 1:
        return [10.0**high]
    return [10.0 ** (low + i * (high - low) / (levels - 1)) for i in range(levels)]


def cross_validate(
    df: DataFrame, label: Column, terms: list[str], numeric: list[str] | None = None,
    penalties: list[float] | None = None, folds: int = 10, kind: str = "linear",
) -> DataFrame:
    """Mean held-out error of a ridge fit per penalty: RMSE (linear) or log loss (logistic).

    ``df`` carries the fold number in ``fold``, from 0. All folds and penalties share each
    pass over the rows.
    """
    penalties = penalties or penalty_levels()
    labelled = df.withColumn("label", label.cast("double"))
    rows = labelled.select("label", "fold", "terms", *(numeric or []))
    schema = "penalty double, metric string, mean double, std double"
    if kind == "linear":
        errors = _ridge_errors(_fold_sums(rows, terms, numeric or [], folds), penalties)
        return terms_frame(df.sparkSession, [
            (float(p), "rmse", float(e.mean()), float(e.std(ddof=1)) if folds > 1 else None)
            for p, e in zip(penalties, errors)
        ], schema)
    grid = [(p, k) for p in penalties for k in range(folds)]
    with newton.read_often(newton.design(rows, F.col("label"), terms, numeric)) as data:
        found = newton.newton(data, *map(list, zip(*grid)))
    _warn_unless(found.converged, "cross-validation")
    losses = found.held_out.reshape(len(penalties), folds)
    return terms_frame(df.sparkSession, [
        (float(p), "logLoss", float(e.mean()), float(e.std()))
        for p, e in zip(penalties, losses)
    ], schema)


def _fold_sums(
    rows: DataFrame, terms: list[str], numeric: list[str], folds: int
) -> np.ndarray:
    """Sums of products of (1, numeric, terms, label) per fold, in one pass over the rows.

    What leaves a task, and what the driver sees, is a matrix per fold, not rows.
    """
    size = len(numeric) + len(terms) + 2
    names = pa.array(terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, size, size))
        for batch in batches:
            for start in range(0, len(batch), 4096):
                part = batch.slice(start, 4096)
                x = np.zeros((len(part), size))
                x[:, 0], x[:, -1] = 1.0, part.column(0).to_numpy(zero_copy_only=False)
                for i in range(len(numeric)):
                    x[:, 1 + i] = part.column(3 + i).to_numpy(zero_copy_only=False)
                held = part.column(2)
                at = pc.index_in(pc.list_flatten(held), names)
                whose = pc.list_parent_indices(held)
                known = at.is_valid()
                place = at.filter(known).to_numpy() + 1 + len(numeric)
                np.add.at(x, (whose.filter(known).to_numpy(), place), 1.0)
                fold = part.column(1).to_numpy()
                for k in np.unique(fold):
                    own = x[fold == k]
                    total[k] += own.T @ own
        k, i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v.astype(np.int32)) for v in (k, i, j)] + [pa.array(total[k, i, j])],
            names=["k", "i", "j", "v"])

    sums = rows.select("label", "fold", "terms", *(F.col(c).cast("double") for c in numeric))
    found = sums.mapInArrow(run, "k int, i int, j int, v double").groupBy("k", "i", "j").agg(
        F.sum("v").alias("v")).toArrow()
    out = np.zeros((folds, size, size))
    out[tuple(found.column(c).to_numpy() for c in range(3))] = found.column(3).to_numpy()
    return out


def _ridge_errors(sums: np.ndarray, penalties: list[float]) -> list[np.ndarray]:
    """Held-out root mean squared error per penalty and fold, from sums of products.

    Columns and label are standardised on the training folds, and the penalty is divided by
    the label's deviation, as in Spark's own fit.
    """
    whole = sums.sum(axis=0)
    errors = [np.zeros(len(sums)) for _ in penalties]
    for k, held in enumerate(sums):
        train = whole - held
        mean = train[0, 1:] / train[0, 0]
        cov = train[1:, 1:] / train[0, 0] - np.outer(mean, mean)
        spread_ = np.sqrt(np.maximum(np.diag(cov), 0.0))
        varies = spread_[:-1] > 1e-12
        scale = np.where(varies, spread_[:-1], 1.0)
        left = cov[:-1, :-1] / np.outer(scale, scale)
        right = cov[:-1, -1] / scale
        for error, penalty in zip(errors, penalties):
            lead = left + np.diag(np.where(varies, penalty / spread_[-1], 1.0))
            slope = np.where(varies, np.linalg.lstsq(lead, right, rcond=None)[0], 0.0) / scale
            full = np.concatenate([[mean[-1] - slope @ mean[:-1]], slope, [-1.0]])
            error[k] = np.sqrt(max(full @ held @ full, 0.0) / held[0, 0])
    return errors


def player_table(terms: DataFrame, roles: list[str], positive: str, negative: str) -> DataFrame:
    """One row per player with a column per role, 0 where absent, and their signed total.

    Terms without a role, such as a state level, keep their value in ``base``.
    """
    player, role = term_parts(F.col("term"))
    rows = terms.select(
        player.alias("name"), F.coalesce(role, F.lit("base")).alias("type"), "estimate"
    )
    wide = spread(rows, ["name"], "type", "estimate", ["base", *roles]).fillna(0.0)
    return wide.withColumn("total", F.col("base") - F.col(negative) + F.col(positive))


def side_ranking(table: DataFrame, positive: str = "FOR", negative: str = "AGAINST") -> DataFrame:
    """Players by positive minus negative coefficient, beside the league mean of each."""
    return table.withColumns({
        "total": F.col(positive) - F.col(negative),
        "mean_positive": league_mean(table, positive),
        "mean_negative": league_mean(table, negative),
    }).orderBy(F.col("total").desc(), "name")


def confusion(predicted: DataFrame, truth: str, probability: str, cut: float = 0.5) -> DataFrame:
    """Rows by true class, with a column per predicted class."""
    called = F.when(F.col(probability) > cut, "true").otherwise("false")
    return (
        predicted.select(truth, called.alias("called"))
        .groupBy(truth)
        .pivot("called", ["false", "true"])
        .agg(F.count(F.lit(1)))
        .fillna(0)
    )


def predictions_by(predicted: DataFrame, keys: list[str], probability: str) -> DataFrame:
    """Number and mean of the predictions, and share called positive, per group."""
    return predicted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(probability).alias("mean_pred"),
        F.avg((F.col(probability) > 0.5).cast("int")).alias("called"),
    )


def common_levels(df: DataFrame, level: str, min_n: int) -> DataFrame:
    """Rows of the levels with more than ``min_n`` rows, with that number.

    Counted by an aggregate and joined back: a window on a level would put the most common
    level into one task. Whether the counts are broadcast is left to Spark's size check.
    """
    counts = df.groupBy(level).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_n)
    return df.join(counts, level)


def prediction_grid(df: DataFrame, factors: list[str], ranges: dict[str, tuple[int, int, int]]):
    """Every combination of the observed levels of the factors and of the number ranges.

    The levels are gathered into arrays, one per factor, and unfolded one after another.
    """
    grid = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in factors])
    for factor in factors:
        grid = grid.withColumn(factor, F.explode(factor))
    for name, (low, high, step) in ranges.items():
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(step))))
    return grid
