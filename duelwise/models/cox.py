"""Ridge regression of event times (Cox model, Breslow ties), all penalties and folds at once.

Every row is an observed event. One evaluation makes two passes over the rows. The first
sums ``exp(eta)`` and the row count per distinct duration; the second sums the gradient,
given the cumulative hazard. Both read chunks of counted rows, see ``packed``. Both are partial sums inside a task followed by a grouped sum,
so the driver only sees one row per distinct duration or per term. A column of the
coefficient matrix is one pair of penalty and left-out fold: a pass serves all of them.
"""

from __future__ import annotations

import sys
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .design import assemble, correlations, deviations, settled
from .fits import terms_frame

# The task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_CELLS = 50_000_000  # of the driver's table by duration
MAX_HELD = 100_000      # durations that a task holds before it merges them
CHUNK, SLICE = 1 << 17, 1 << 13  # cells of a chunk, and those handled at once

PACKED = ("fold array<int>, time array<bigint>, n array<bigint>, whose array<int>, "
          "sizes array<int>, terms array<int>")
PACKED_NAMES = ["fold", "time", "n", "whose", "sizes", "terms"]


@dataclass
class CoxFit:
    """Coefficients at the chosen penalty, and held-out deviance per penalty."""

    terms: list[str]
    coefficients: np.ndarray
    penalty: float
    path: DataFrame
    table: DataFrame


def packed(rows: DataFrame) -> DataFrame:
    """Rows (duration, fold, idx) as chunks: each row has the cells of many rows.

    Equal rows are counted once, whatever their number. A chunk lists its different sets of
    terms (``terms``, cut by ``sizes``) and its cells in order of fold and duration: how many
    rows (``n``) have that duration and the set ``whose``. A pass then works out a set once,
    and a cell costs a sum.
    """
    counted = rows.groupBy(
        F.col("fold").cast("int").alias("fold"), F.col("duration").cast("long").alias("time"),
        F.array_sort("idx").alias("idx"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("fold", "time", "n", F.xxhash64("idx").alias("key"), "idx").mapInArrow(
        _pack, PACKED)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= CHUNK:
            yield _chunk(held)
            held = []
    if sum(map(len, held)):
        yield _chunk(held)


def _chunk(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row of ``PACKED`` from counted rows."""
    table = pa.Table.from_batches(batches).combine_chunks()
    fold, time, n, key = (table.column(c).to_numpy() for c in range(4))
    idx = table.column(4).combine_chunks()
    _, first, whose = np.unique(key, return_index=True, return_inverse=True)
    sets = idx.take(pa.array(first))
    if not sets.take(pa.array(whose)).equals(idx):
        # Two sets with one hash: every cell has its own.
        sets, whose = idx, np.arange(len(idx))
    order = np.lexsort((time, fold))
    cells = [fold[order], time[order], n[order], whose[order].astype(np.int32),
             pc.list_value_length(sets).to_numpy(zero_copy_only=False),
             sets.flatten().to_numpy(zero_copy_only=False)]
    kinds = [np.int32, np.int64, np.int64, np.int32, np.int32, np.int32]
    return pa.RecordBatch.from_arrays(
        [pa.ListArray.from_arrays(np.array([0, len(x)], np.int32), pa.array(x.astype(k)))
         for x, k in zip(cells, kinds)], names=PACKED_NAMES)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for row in range(len(batch)):
            yield [batch.column(c)[row].values.to_numpy() for c in PACKED_NAMES]


def _by_fold(fold: np.ndarray, left_out: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray]]:
    """Each fold of ordered cells, where its cells are, and the columns that see it."""
    starts = np.flatnonzero(np.append(True, fold[1:] != fold[:-1]))
    for low, high in zip(starts, [*starts[1:], len(fold)]):
        yield fold[low], slice(low, high), np.flatnonzero(left_out != fold[low])


def _run_sums(key: np.ndarray, n: np.ndarray, rows: np.ndarray, table: np.ndarray):
    """The different keys of an ordered array, and for each the sum of n * table[rows]."""
    new = np.append(True, key[1:] != key[:-1])
    run = np.cumsum(new) - 1
    out = np.zeros((run[-1] + 1, table.shape[1]))
    for low in range(0, len(key), SLICE):
        part = slice(low, low + SLICE)
        own, values = run[part], table[rows[part]]
        if (n[part] != 1).any():
            values *= n[part, None]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out[own[starts]] += np.add.reduceat(values, starts, axis=0)
    return key[new], out


def _row_sums(flat: np.ndarray, sizes: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Each row's sum of the coefficients of its terms: only terms that hold are touched."""
    out = np.zeros((len(sizes), beta.shape[1]))
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(beta[flat], (np.cumsum(sizes) - sizes)[some], axis=0)
    return out


def _term_sums(flat: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Each term's sum of values, one value per term that holds."""
    out = np.zeros((size, values.shape[1]))
    if len(flat):
        distinct, sums = _by_time(flat, values)
        out[distinct] = sums
    return out


def _by_time(times: np.ndarray, cells: np.ndarray):
    """Sums of the rows of each distinct time, in order."""
    order = np.argsort(times, kind="stable")
    distinct, starts = np.unique(times[order], return_index=True)
    return distinct, np.add.reduceat(cells[order], starts, axis=0)


def _frame(keys: np.ndarray, values: np.ndarray, columns: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.astype(np.int64)), *(pa.array(v) for v in values.T.copy())],
        names=["key", *columns])


def _hazard_sums(shared, left_out: np.ndarray, folds: np.ndarray, columns: list[str]):
    """Per duration: sum of exp(eta) per column and row count per fold set. Key -1: sum of eta."""
    def run(batches):
        beta = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        eta_total = np.zeros(len(left_out))
        for fold, time, n, whose, sizes, terms in _chunks(batches):
            eta = _row_sums(terms, sizes, beta)
            risk = np.exp(eta)
            times = np.unique(time)
            cells = np.zeros((len(times), len(columns)))
            for k, own, used in _by_fold(fold, left_out):
                rows = np.bincount(whose[own], n[own], len(sizes))
                eta_total[used] += rows @ eta[:, used]
                seen, sums = _run_sums(time[own], n[own], whose[own], risk[:, used])
                at = np.searchsorted(times, seen)
                cells[at[:, None], used] += sums
                count = np.bincount(np.searchsorted(times, time[own]), n[own], len(times))
                cells[:, len(left_out):] += count[:, None] * (folds != k)
            held.append((times, cells))
            if sum(len(t) for t, _ in held) > MAX_HELD:
                held = [_by_time(*map(np.concatenate, zip(*held)))]
        if held:
            times, sums = _by_time(*map(np.concatenate, zip(*held)))
            tail = np.concatenate([eta_total, np.zeros(len(folds))])
            yield _frame(np.append(times, -1), np.vstack([sums, tail]), columns)
    return run


def _gradient_sums(shared, left_out, columns: list[str]):
    def run(batches):
        beta, times, hazard = shared.value
        total = np.zeros_like(beta)
        for fold, time, n, whose, sizes, terms in _chunks(batches):
            risk = np.exp(_row_sums(terms, sizes, beta))
            rest = np.zeros_like(risk)
            at = np.searchsorted(times, time)
            for _, own, used in _by_fold(fold, left_out):
                order = np.argsort(whose[own], kind="stable")
                sets, sums = _run_sums(
                    whose[own][order], n[own][order], at[own][order], hazard[:, used])
                rows = np.bincount(whose[own], n[own], len(sizes))[sets, None]
                rest[sets[:, None], used] += rows - risk[sets[:, None], used] * sums
            total += _term_sums(terms, np.repeat(rest, sizes, axis=0), len(beta))
        yield _frame(np.arange(len(beta)), total, columns)
    return run


def _grouped(chunks: DataFrame, task, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    schema = "key bigint, " + ", ".join(f"{c} double" for c in columns)
    sums = (
        chunks.mapInArrow(task, schema)
        .groupBy("key")
        .agg(*[F.sum(c).alias(c) for c in columns])
        .toArrow()
    )
    keys = sums.column("key").to_numpy()
    order = np.argsort(keys)
    return keys[order], np.stack([sums.column(c).to_numpy() for c in columns], axis=1)[order]


def evaluate(rows: DataFrame, beta: np.ndarray, left_out: np.ndarray, slope: bool = True):
    """Log partial likelihood, its gradient and the row count, per column of ``beta``.

    ``rows`` are rows (duration, fold, idx), or their chunks, settled. Without ``slope`` the
    second pass is saved and the gradient is zero. Coefficients and hazards reach the tasks as
    Spark broadcasts, one copy per executor.
    """
    if "whose" not in rows.columns:
        rows = packed(rows)
    share = rows.sparkSession.sparkContext.broadcast
    width = beta.shape[1]
    folds, place = np.unique(left_out, return_inverse=True)
    columns = [f"r{k}" for k in range(width)] + [f"d{f}" for f in range(len(folds))]
    keys, cells = _grouped(
        rows, _hazard_sums(share(beta), left_out, folds, columns), columns)
    eta, times, cells = cells[0, :width], keys[1:], cells[1:]
    count = cells[:, width:]
    at_risk = np.cumsum(cells[::-1, :width], axis=0)[::-1]
    safe = np.where(at_risk > 0, at_risk, 1.0)
    hazard = np.cumsum(count[:, place] / safe, axis=0)
    likelihood = eta - (count[:, place] * np.log(safe)).sum(axis=0)
    if not slope:
        return likelihood, np.zeros_like(beta), count.sum(axis=0)[place]
    names = [f"g{k}" for k in range(width)]
    _, gradient = _grouped(
        rows, _gradient_sums(share((beta, times, hazard)), left_out, names), names)
    return likelihood, gradient, count.sum(axis=0)[place]


def evaluate_blocks(rows, beta: np.ndarray, left_out: np.ndarray, n_times: int, slope=True):
    """``evaluate`` on as many columns at a time as keep the driver's tables bounded."""
    block = max(1, MAX_CELLS // max(1, n_times))
    parts = [
        evaluate(rows, beta[:, i : i + block], left_out[i : i + block], slope)
        for i in range(0, beta.shape[1], block)
    ]
    return tuple(np.concatenate([p[j] for p in parts], axis=-1) for j in range(3))


def _minimise(objective, start: np.ndarray, inverses: list[np.ndarray], iterations: int, tol: float):
    """Quasi-Newton steps on every column at once, with step halving per column."""
    beta = start.copy()
    loss, slope = objective(beta)
    inverses = [m.copy() for m in inverses]
    step = np.ones(beta.shape[1])
    direction = -np.stack([m @ slope[:, k] for k, m in enumerate(inverses)], axis=1)
    for _ in range(iterations):
        if np.abs(slope).max() < tol:
            break
        trial = beta + step * direction
        trial_loss, trial_slope = objective(trial)
        fall = (slope * direction).sum(axis=0)
        good = trial_loss <= loss + 1e-4 * step * fall + 1e-12
        for k in range(beta.shape[1]):
            if not good[k]:
                step[k] *= 0.5
                continue
            moved, change = trial[:, k] - beta[:, k], trial_slope[:, k] - slope[:, k]
            curve = moved @ change
            if curve > 1e-14:
                left = np.eye(len(moved)) - np.outer(moved, change) / curve
                inverses[k] = left @ inverses[k] @ left.T + np.outer(moved, moved) / curve
            beta[:, k], loss[k], slope[:, k] = trial[:, k], trial_loss[k], trial_slope[:, k]
            direction[:, k], step[k] = -inverses[k] @ slope[:, k], 1.0
        if (step < 1e-6).all():
            break
    else:
        warnings.warn("Cox fit stopped before it converged", RuntimeWarning, stacklevel=2)
    return beta


def fit_cox(
    df: DataFrame, duration: str, terms: list[str], folds: int = 4,
    penalties: list[float] | None = None, levels: int = 10, rule: str = "1se",
    iterations: int = 60, tol: float = 1e-6,
) -> CoxFit:
    """Ridge Cox regression of ``duration`` on the indicator ``terms`` of each row.

    The loss is ``-logL / n + penalty / 2 * sum((sd * beta)^2)``. The penalty is chosen by
    held-out deviance over the ``fold`` column: the best (``rule="min"``) or the largest
    within one standard error of it (``"1se"``). ``df`` is read a few times: settle it first.
    The steps read its chunks.
    """
    rows = df.select(
        F.col(duration).cast("long").alias("duration"), "fold",
        F.filter(_term_index(terms)("terms"), lambda i: i >= 0).alias("idx"),
    )
    with settled(packed(rows)) as chunks:
        return _fit(df, chunks, terms, folds, penalties, levels, rule, iterations, tol)


def _term_index(terms: list[str]):
    """Places of terms among those given, by a hash lookup; -1 for others."""
    names = pa.array(terms, pa.string())

    def run(column: pa.Array) -> pa.Array:
        at = pc.fill_null(pc.index_in(column.flatten(), names), -1)
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, at)

    return F.arrow_udf(run, "array<int>")


def _fit(df, rows, terms, folds, penalties, levels, rule, iterations, tol) -> CoxFit:
    vectors = assemble(df, terms)
    spread, matrix = deviations(vectors), np.nan_to_num(correlations(vectors))
    np.fill_diagonal(matrix, 1.0)
    covariance = matrix * np.outer(spread, spread)
    n_times = rows.select(F.explode("time").alias("t")).agg(F.countDistinct("t")).first()[0]
    size = len(terms)

    if penalties is None:
        _, slope, n = evaluate(rows, np.zeros((size, 1)), np.array([-1]))
        top = np.abs(slope[:, 0] / np.where(spread > 0, spread, 1)).max() / n[0] / 1e-3
        penalties = np.geomspace(top, top * 1e-4, levels).tolist()
    fold_of = np.array([-1, *range(folds)]).repeat(len(penalties))
    level_of = np.tile(np.array(penalties), folds + 1)
    ridge = level_of[None, :] * (spread**2)[:, None]

    def objective(beta):
        likelihood, slope, n = evaluate_blocks(rows, beta, fold_of, n_times)
        loss = -likelihood / n + 0.5 * (ridge * beta**2).sum(axis=0)
        return loss, -slope / n + ridge * beta

    floor = 1e-8 * np.eye(size)
    inverses = [np.linalg.inv(covariance + np.diag(ridge[:, k]) + floor)
                for k in range(len(level_of))]
    beta = _minimise(objective, np.zeros((size, len(level_of))), inverses, iterations, tol)

    held = fold_of >= 0
    whole, _, n_all = evaluate_blocks(rows, beta[:, held], np.full(held.sum(), -1), n_times, False)
    inside, _, n_in = evaluate_blocks(rows, beta[:, held], fold_of[held], n_times, False)
    weights = (n_all - n_in).reshape(folds, -1)
    deviance = (-2 * (whole - inside)).reshape(folds, -1) / np.maximum(weights, 1)
    mean = np.average(deviance, axis=0, weights=weights)
    variance = np.average((deviance - mean) ** 2, axis=0, weights=weights)
    error = np.sqrt(variance / max(folds - 1, 1))
    best = int(np.argmin(mean))
    chosen = best
    if rule == "1se":
        near = [i for i in range(len(penalties)) if mean[i] <= mean[best] + error[best]]
        chosen = max(near, key=lambda i: penalties[i])
    spark = df.sparkSession
    path = terms_frame(
        spark,
        [(float(p), float(m), float(e), i == chosen)
         for i, (p, m, e) in enumerate(zip(penalties, mean, error))],
        "penalty double, deviance double, std_error double, chosen boolean",
    )
    values = beta[:, chosen]
    table = terms_frame(
        spark, [(t, float(b), float(np.exp(b))) for t, b in zip(terms, values)],
        "term string, estimate double, hazard_ratio double",
    )
    return CoxFit(terms, values, float(penalties[chosen]), path, table)
