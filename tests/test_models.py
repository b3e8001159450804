"""Model fits against small numpy solutions and planted effects."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import registry
from duelwise.models import cox, design, fits, jobs
from duelwise.sources.testdata import Feed

from .conftest import SMALL
from .helpers import keyed


def sample(n=3000, seed=3):
    rng = np.random.default_rng(seed)
    players = rng.integers(0, 6, (n, 2))
    x = rng.normal(size=n)
    return rng, players, x


def frame(spark, players, x, y, extra=None):
    rows = [(i, [f"p{a}_K", f"p{b}_D"], float(v), float(t))
            for i, ((a, b), v, t) in enumerate(zip(players, x, y))]
    return spark.createDataFrame(rows, "i long, terms array<string>, x double, y double")


def matrix(players, x, terms):
    names = [[f"p{a}_K", f"p{b}_D"] for a, b in players]
    return np.column_stack([np.ones(len(x)), x] + [[t in row for row in names] for t in terms]).astype(float)


TERMS = [f"p{i}_{r}" for i in range(1, 6) for r in ("D", "K")]


def irls(X, y):
    b = np.zeros(X.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ b))
        hess = X.T @ (X * (p * (1 - p))[:, None])
        step = np.linalg.solve(hess, X.T @ (y - p))
        b += step
        if np.abs(step).max() < 1e-12:
            break
    return b, np.sqrt(np.diag(np.linalg.inv(hess)))


def test_logistic_equals_numpy(spark):
    rng, players, x = sample()
    X = matrix(players, x, TERMS)
    truth = rng.normal(size=X.shape[1]) * 0.5
    y = rng.random(len(x)) < 1 / (1 + np.exp(-X @ truth))
    table = fits.fit_logistic(frame(spark, players, x, y), F.col("y"), TERMS, ["x"])[2]
    beta, error = irls(X, y.astype(float))
    got = keyed(table, ["term"], "estimate", "std.error", "statistic")
    for name, b, e in zip(["(Intercept)", "x", *TERMS], beta, error):
        assert np.isclose(np.log(got[name][0]), b, atol=1e-6)
        assert np.isclose(got[name][1], e, rtol=1e-4)
        assert np.isclose(got[name][2], b / e, atol=1e-3)
    assert np.abs(beta - truth).max() < 0.5


def test_the_other_solver_gives_estimates_only(spark):
    rng, players, x = sample()
    X = matrix(players, x, TERMS)
    y = rng.random(len(x)) < 1 / (1 + np.exp(-X @ (rng.normal(size=X.shape[1]) * 0.5)))
    df = frame(spark, players, x, y)
    model, columns, table = fits.fit_logistic(df, F.col("y"), TERMS, ["x"], solver="lbfgs")
    got = keyed(table, ["term"], "estimate", "std.error")
    beta, _ = irls(X, y.astype(float))
    for name, b in zip(["(Intercept)", "x", *TERMS], beta):
        assert np.isclose(np.log(got[name][0]), b, atol=1e-3) and got[name][1] is None
    p = keyed(fits.predict(model, df, columns), ["i"], "prediction")
    assert np.allclose([p[i] for i in range(len(x))], 1 / (1 + np.exp(-X @ beta)), atol=1e-3)


def test_aliased_terms_are_null(spark):
    rng, players, x = sample(800)
    y = rng.random(len(x)) < 0.5
    terms = [f"p{i}_K" for i in range(6)]  # one of them always holds
    table = fits.fit_logistic(frame(spark, players, x, y), F.col("y"), terms, ["x"])[2]
    got = keyed(table, ["term"], "estimate")
    assert got["p5_K"] is None and all(got[t] is not None for t in terms[:5])


def test_constant_terms_are_dropped(spark):
    rng, players, x = sample(200)
    df = frame(spark, players, x, x > 0).withColumn("terms", F.array_append("terms", F.lit("all")))
    assert design.varying_terms(df, ["all", "none", "p1_K"]) == ["p1_K"]


def test_ridge_linear_equals_closed_form(spark):
    rng, players, x = sample(1000)
    X = matrix(players, x, TERMS)
    y = X @ rng.normal(size=X.shape[1]) + rng.normal(size=len(x)) * 0.1
    penalty = 0.5
    model, _, table = fits.fit_ridge_linear(
        frame(spark, players, x, y), F.col("y"), TERMS, ["x"], penalty)
    n, Z = len(x), X[:, 1:]
    sd, sy = Z.std(axis=0, ddof=1), y.std(ddof=1)
    W = (Z - Z.mean(axis=0)) / sd
    v = (y - y.mean()) / sy
    # Spark penalises standardised coefficients of a standardised label.
    scaled = np.linalg.solve(W.T @ W / n + penalty / sy * np.eye(W.shape[1]), W.T @ v / n)
    beta = scaled * sy / sd
    got = keyed(table, ["term"], "estimate")
    assert np.allclose([got[t] for t in ["x", *TERMS]], beta, atol=1e-3)


def breslow(X, times, beta, penalty, sd):
    eta = X @ beta
    value, gradient = eta.sum(), X.sum(axis=0)
    for t in np.unique(times):
        risk = np.exp(eta[times >= t])
        d = (times == t).sum()
        value -= d * np.log(risk.sum())
        gradient = gradient - d * (risk @ X[times >= t]) / risk.sum()
    n = len(times)
    return (-value / n + penalty / 2 * ((sd * beta) ** 2).sum(),
            -gradient / n + penalty * sd**2 * beta)


def test_cox_gradient_and_optimum(spark):
    rng, players, x = sample(600)
    X = matrix(players, x, TERMS)[:, 2:]
    truth = rng.normal(size=X.shape[1]) * 0.6
    times = np.ceil(rng.exponential(np.exp(-X @ truth)) * 50).astype(int)
    df = frame(spark, players, x, times).withColumn("duration", F.col("y").cast("long"))
    df = design.with_fold(df, ["i"], 3)
    beta = rng.normal(size=(len(TERMS), 2)) * 0.1
    lookup = F.array(*[F.lit(t) for t in TERMS])
    rows = df.select("duration", "fold", F.filter(
        F.transform("terms", lambda t: (F.array_position(lookup, t) - 1).cast("int")),
        lambda i: i >= 0).alias("idx"))
    value, gradient, n = cox.evaluate(rows, beta, np.array([-1, -1]))
    for k in range(2):
        loss, slope = breslow(X, times, beta[:, k], 0.0, np.ones(len(TERMS)))
        assert np.isclose(-value[k] / n[k], loss) and np.allclose(-gradient[:, k] / n[k], slope)
    fit = cox.fit_cox(df, "duration", TERMS, folds=3, penalties=[1e-4, 1e-2, 1.0], rule="min")
    sd = X.std(axis=0, ddof=1)
    _, slope = breslow(X, times, fit.coefficients, fit.penalty, sd)
    assert np.abs(slope).max() < 1e-5
    assert fit.penalty < 1.0 and np.corrcoef(fit.coefficients, truth)[0, 1] > 0.9
    path = fit.path.collect()
    assert sum(r.chosen for r in path) == 1
    wide = cox.fit_cox(df, "duration", TERMS, folds=3, penalties=[1e-4, 1e-2, 1.0], rule="1se")
    assert wide.penalty >= fit.penalty


def test_split_is_stable_and_near_its_share(spark):
    df = spark.range(4000)
    parts = [design.train_test_split(d, ["id"]) for d in (df.repartition(3), df.coalesce(1))]
    ids = [sorted(r.id for r in train.collect()) for train, _ in parts]
    assert ids[0] == ids[1] and 2850 < len(ids[0]) < 3150
    assert parts[0][0].count() + parts[0][1].count() == 4000


def test_cross_validation_prefers_the_small_penalty(spark):
    rng, players, x = sample(600)
    df = design.with_fold(frame(spark, players, x, 3 * x + rng.normal(size=len(x)) * 0.1), ["i"], 3)
    grid = keyed(fits.cross_validate(df, F.col("y"), TERMS, ["x"], [1e-6, 10.0], 3), ["penalty"], "mean")
    assert grid[1e-6] < 0.2 < grid[10.0]
    assert fits.penalty_levels(3) == [1e-10, 1e-5, 1.0]


def test_one_pass_errors_equal_those_of_single_fits(spark):
    rng, players, x = sample(600)
    df = design.with_fold(frame(spark, players, x, 3 * x + rng.normal(size=len(x))), ["i"], 3).cache()
    got = keyed(fits.cross_validate(df, F.col("y"), TERMS, ["x"], [1e-3, 0.7], 3), ["penalty"], "mean", "std")
    for penalty in (1e-3, 0.7):
        errors = []
        for k in range(3):
            model, columns, _ = fits.fit_ridge_linear(
                df.filter(F.col("fold") != k), F.col("y"), TERMS, ["x"], penalty)
            held = fits.predict(model, df.filter(F.col("fold") == k), columns)
            errors.append(held.agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)))).first()[0])
        mean = sum(errors) / 3
        assert abs(got[penalty][0] - mean) < 1e-6, (got, errors)
        assert abs(got[penalty][1] - np.std(errors, ddof=1)) < 1e-6


@pytest.fixture(scope="module")
def small(spark):
    return Feed(spark, SMALL)


def test_expected_shares_sum_to_one(spark, small):
    rows = registry._xkill(small)
    sums = rows.groupBy("match_id", "event_id").agg(F.sum("xkill").alias("s")).collect()
    assert len(sums) == small.sequence.count()
    assert all(abs(r.s - 1) < 1e-9 for r in sums)


def test_model_can_be_saved(spark, small, tmp_path):
    from pyspark.ml import PipelineModel
    pairs = jobs.xkill_inputs(small.pairs)
    fit = jobs.xkill_fit(small.pairs)
    jobs.as_pipeline(fit[0], fit[1]).write().save(str(tmp_path / "model"))
    back = PipelineModel.load(str(tmp_path / "model"))
    keys = ["match_id", "event_id"]
    new = keyed(back.transform(pairs), keys, "prediction")
    assert new == keyed(fits.predict(fit[0], pairs, fit[1]), keys, "prediction")


def test_duel_design_has_one_player_and_one_level(spark, small):
    rows = jobs.duel_rows(registry._situations(small))
    assert rows.filter(F.size("terms") != 2).count() == 0
    assert rows.count() == registry._situations(small).filter("trade_sit <> 'NONE'").count()


def test_player_table_totals(spark):
    terms = spark.createDataFrame(
        [("(Intercept)", 1.0), ("a_FOR", 0.5), ("a_AGAINST", 0.2), ("b_FOR", 0.1), ("state4v3", 2.0)],
        "term string, estimate double")
    table = fits.player_table(terms, ["AGAINST", "FOR"], "FOR", "AGAINST")
    got = keyed(table, ["name"], "total")
    assert got == {"(Intercept)": 1.0, "a": 0.3, "b": 0.1, "state4v3": 2.0}
    ranked = [r.name for r in fits.side_ranking(table).collect()]
    assert ranked[0] == "a"


def test_confusion_and_common_levels(spark):
    df = spark.createDataFrame([(True, 0.9, "x"), (True, 0.2, "x"), (False, 0.7, "y")],
                               "win boolean, p double, s string")
    assert keyed(fits.confusion(df, "win", "p"), ["win"], "false", "true") == {
        True: (1, 1), False: (0, 1)}
    assert {r.s for r in fits.common_levels(df, "s", 1).collect()} == {"x"}


def test_grid_is_every_combination(spark):
    df = spark.createDataFrame([(1, "u"), (2, "u"), (2, "v")], "a int, b string")
    grid = fits.prediction_grid(df, ["a", "b"], {"t": (0, 20, 10)})
    assert grid.distinct().count() == grid.count() == 2 * 2 * 3


def test_cox_counts_equal_rows_once_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    sets = [[], [0], [1, 2], [2, 1], [0, 1, 2]]
    rows = [(int(rng.integers(1, 6)), int(rng.integers(0, 3)), sets[rng.integers(0, 5)])
            for _ in range(400)]
    df = spark.createDataFrame(rows, "duration long, fold int, idx array<int>").repartition(3)
    different = len({(t, f, tuple(sorted(s))) for t, f, s in rows})
    counted = [n for r in cox.packed(df).collect() for n in r.n]
    assert len(counted) == different < 100 and sum(counted) == 400
    X, times, fold = np.zeros((400, 3)), np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for i, (_, _, s) in enumerate(rows):
        X[i, s] = 1.0
    beta, left_out = rng.normal(size=(3, 4)), np.array([-1, 0, 1, 2])
    for chunk, part in ((cox.CHUNK, cox.SLICE), (8, 4)):
        monkeypatch.setattr(cox, "CHUNK", chunk)
        monkeypatch.setattr(cox, "SLICE", part)
        value, gradient, n = cox.evaluate(df, beta, left_out)
        for k, gone in enumerate(left_out):
            seen = fold != gone
            loss, slope = breslow(X[seen], times[seen], beta[:, k], 0.0, np.ones(3))
            assert n[k] == seen.sum() and np.isclose(-value[k] / n[k], loss)
            assert np.allclose(-gradient[:, k] / n[k], slope)
