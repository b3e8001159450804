"""Newton fits over sums of products against numpy, alone, in grids, and wide."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelwise.models import fits, newton

from .helpers import keyed
from .test_models import TERMS, frame, irls, matrix, sample


@pytest.mark.parametrize("intercept", [True, False])
def test_table_equals_numpy(spark, intercept):
    rng, players, x = sample()
    X = matrix(players, x, TERMS)[:, 0 if intercept else 1:]
    y = rng.random(len(x)) < 1 / (1 + np.exp(-X @ (rng.normal(size=X.shape[1]) * 0.5)))
    table = fits.logistic_table(
        frame(spark, players, x, y), F.col("y"), TERMS, ["x"], intercept=intercept)
    beta, error = irls(X, y.astype(float))
    got = keyed(table, ["term"], "estimate", "std.error", "statistic", "p.value")
    names = [*(["(Intercept)"] if intercept else []), "x", *TERMS]
    assert list(got) == names
    for name, b, e in zip(names, beta, error):
        estimate, se, z, p = got[name]
        assert np.isclose(np.log(estimate), b, atol=1e-7)
        assert np.isclose(se, e, rtol=1e-6) and np.isclose(z, b / e, atol=1e-6)
        assert np.isclose(p, newton.p_value(b / e), atol=1e-7)


@pytest.mark.parametrize("intercept", [True, False])
def test_explained_columns_are_null(spark, intercept):
    """Six players of whom one always holds, a number that doubles another, a constant."""
    rng, players, x = sample(900)
    y = rng.random(len(x)) < 0.4
    terms = [f"p{i}_K" for i in range(6)] + ["p1_D", "never"]
    df = frame(spark, players, x, y).withColumns({"two": 2 * F.col("x"), "five": F.lit(5.0)})
    table = fits.logistic_table(df, F.col("y"), terms, ["x", "two", "five"], intercept=intercept)
    got = keyed(table, ["term"], "estimate", "std.error")
    null = {t for t, (b, e) in got.items() if b is None}
    # Without intercept the constant number takes its place.
    assert null == {"two", "p5_K", "never", *(["five"] if intercept else [])}
    X = matrix(players, x, [*terms[:5], "p1_D"])
    if not intercept:
        X[:, 0] = 5.0
    beta, error = irls(X, y.astype(float))
    kept = ["(Intercept)" if intercept else "five", "x", *terms[:5], "p1_D"]
    for name, b, e in zip(kept, beta, error):
        assert np.isclose(np.log(got[name][0]), b, atol=1e-6)
        assert np.isclose(got[name][1], e, rtol=1e-5)


def test_factor_in_panels():
    rng = np.random.default_rng(0)
    X = np.c_[np.ones(900), rng.normal(size=(900, 599))]
    X[:, 50], X[:, 300] = X[:, 3] + X[:, 7], 1 - X[:, 9]
    gram = X.T @ X
    lower, kept = newton.factor(gram)
    assert np.flatnonzero(~kept).tolist() == [50, 300]
    inner = gram[np.ix_(kept, kept)]
    assert np.allclose(lower[np.ix_(kept, kept)] @ lower[np.ix_(kept, kept)].T, inner)
    errors = newton.standard_errors(gram, kept)
    assert np.allclose(errors[kept] ** 2, np.diag(np.linalg.inv(inner)))
    assert np.isnan(errors[[50, 300]]).all()


def test_wide_fits_have_standard_errors(spark):
    """More columns than normal equations in the engine take; every term has the same rate."""
    width, each = 4500, 8
    df = spark.range(width * each).select(
        F.expr(f"cast(id % {each} < 3 + id div {each} % 2 as double)").alias("y"),
        F.array(F.concat(F.lit("t"), (F.col("id") / each).cast("int").cast("string"))).alias("terms"))
    got = keyed(fits.logistic_table(df, F.col("y"), [f"t{i}" for i in range(1, width)]),
                ["term"], "estimate", "std.error", "p.value")
    assert len(got) == width
    for name, wins in (("t1", 4), ("t2", 3), ("t4499", 4)):
        estimate, error, p = got[name]
        odds = (wins / (each - wins)) / (3 / 5)
        assert np.isclose(estimate, odds, rtol=1e-6)
        assert np.isclose(error, np.sqrt(1 / wins + 1 / (each - wins) + 1 / 3 + 1 / 5), rtol=1e-6)
        assert np.isclose(p, newton.p_value(np.log(odds) / error), atol=1e-6)


def ridge(X, y, penalty):
    """Newton steps with the penalty on scaled columns, per row."""
    n, b = len(y), np.zeros(X.shape[1])
    weight = penalty * n * X.var(0, ddof=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-X @ b))
        hess = X.T @ (X * (p * (1 - p))[:, None]) + np.diag(weight)
        b += np.linalg.solve(hess, X.T @ (y - p) - weight * b)
    return b


def test_grid_of_folds_and_penalties_equals_single_fits(spark):
    rng, players, x = sample(1500)
    X = matrix(players, x, TERMS)
    y = (rng.random(len(x)) < 1 / (1 + np.exp(-X @ rng.normal(size=X.shape[1])))).astype(float)
    fold = np.arange(len(x)) % 3
    df = frame(spark, players, x, y).withColumn("fold", (F.col("i") % 3).cast("int"))
    penalties = [0.0, 1e-3, 0.3]
    got = keyed(fits.cross_validate(df, F.col("y"), TERMS, ["x"], penalties, 3, "logistic"),
                ["penalty"], "mean", "std")
    for penalty in penalties:
        losses = []
        for k in range(3):
            b = ridge(X[fold != k], y[fold != k], penalty)
            eta = X[fold == k] @ b
            losses.append(np.mean(np.logaddexp(0, eta) - y[fold == k] * eta))
        assert np.allclose(got[penalty], (np.mean(losses), np.std(losses)), atol=1e-8)


def test_fits_share_passes_and_split_when_matrices_are_large(spark, monkeypatch):
    rng, players, x = sample(600)
    y = rng.random(len(x)) < 0.5
    data = newton.design(frame(spark, players, x, y).withColumn(
        "fold", (F.col("i") % 2).cast("int")), F.col("y"), TERMS, ["x"])
    together = newton.newton(data, [0.0, 0.1, 0.1], [-2, 0, 1])
    assert together.converged and together.passes < 12
    monkeypatch.setattr(newton, "CELLS", data.size ** 2)
    apart = newton.newton(data, [0.0, 0.1, 0.1], [-2, 0, 1])
    assert apart.passes > together.passes
    assert np.allclose(apart.betas, together.betas, atol=1e-7)


def test_no_rows_give_no_estimates(spark):
    table = fits.logistic_table(frame(spark, [], [], []), F.col("y"), ["p1_K"], ["x"])
    assert {r.estimate for r in table.collect()} == {None}


def test_rows_alike_are_read_once(spark):
    rng, players, x = sample(600)
    y = rng.random(len(x)) < 0.5
    df = frame(spark, players, x, y)
    data = newton.design(df, F.col("y"), TERMS)
    alike = {(bool(r.y), tuple(sorted(r.terms))) for r in df.collect()}
    counts = [r.n for r in data.rows.collect()]
    assert len(counts) == len(alike) < 600 and sum(counts) == 600
    thrice = newton.design(df.union(df).union(df), F.col("y"), TERMS)
    assert thrice.rows.count() == len(alike)
    once, more = (newton.newton(d, [0.0], [-2]) for d in (data, thrice))
    assert np.allclose(once.betas, more.betas, atol=1e-8)
    assert np.allclose(3 * once.matrices, more.matrices)
