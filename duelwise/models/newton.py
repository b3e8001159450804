"""Logistic fits by Newton steps over sums of products, for any number of terms and fits.

A row holds a handful of terms, so its part of the weighted cross-product matrix is a few
cells, whatever the number of columns. Tasks add up cells by block of rows, Spark adds them
over tasks, and what reaches the driver is a matrix of terms, never rows. All fits that are
asked for at once, such as every fold and penalty of a grid, share each pass. The matrix is
factorised in blocks of columns; a column that the earlier ones explain is found on the way
and has no estimate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .design import settled

#: Steps of a fit at most, and the change of a log-odds by which it has converged.
STEPS, CONVERGED = 50, 1e-8
#: Columns factorised at once; cells of matrices that a pass may hold.
PANEL, CELLS = 256, 1 << 26
#: Share of a column that must be its own; below, earlier columns explain it.
ALIAS = 1e-7
#: Rows handled at once in a task; cells that a task holds before it hands them on.
ROWS, HELD = 4096, 1 << 21

SUMS = "fit int, i int, j int, v double"
GRADIENT, LOSS, HELD_OUT, HELD_ROWS = -1, -2, -3, -4


@dataclass
class Design:
    """Rows (label, fold, terms, how many, numeric columns) and the columns of their matrix.

    Column 0 is the intercept, then the numeric columns, then a presence for each term.
    """

    rows: DataFrame
    terms: list[str]
    numeric: list[str]

    @property
    def size(self) -> int:
        return 1 + len(self.numeric) + len(self.terms)


def design(
    df: DataFrame, label: Column, terms: list[str], numeric: list[str] | None = None,
) -> Design:
    """A design of a frame, which is read once per step: settle it first.

    Rows without label, or without one of the numbers, are left out. Without numbers, rows
    that are alike become one with their count.
    """
    numeric = numeric or []
    fold = F.col("fold").cast("int") if "fold" in df.columns else F.lit(-1)
    held = F.col("terms") if terms else F.array().cast("array<string>")
    many = F.lit(1.0).alias("n")
    rows = df.select(
        label.cast("double").alias("label"), fold.alias("fold"), held.alias("terms"), many,
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(numeric)],
    ).dropna(subset=["label", *(f"x{i}" for i in range(len(numeric)))])
    if not numeric:
        rows = rows.groupBy("label", "fold", F.array_sort("terms").alias("terms")).agg(
            F.sum("n").alias("n"))
    return Design(rows, terms, numeric)


@contextmanager
def read_often(data: Design) -> Iterator[Design]:
    """The design with its counted rows settled; rows with numbers stay those of the frame."""
    if data.numeric:
        yield data
        return
    with settled(data.rows) as rows:
        yield replace(data, rows=rows)


def _cells(part: pa.RecordBatch, names: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, column, value) of the matrix of some rows, ordered by row."""
    n, numeric = len(part), part.num_columns - 4
    every = np.arange(n)
    row, col, val = [every], [np.zeros(n, np.int64)], [np.ones(n)]
    for i in range(numeric):
        row.append(every)
        col.append(np.full(n, 1 + i))
        val.append(part.column(4 + i).to_numpy(zero_copy_only=False))
    at = pc.index_in(pc.list_flatten(part.column(2)), names)
    known = at.is_valid()
    row.append(pc.list_parent_indices(part.column(2)).filter(known).to_numpy())
    col.append(at.filter(known).to_numpy() + 1 + numeric)
    val.append(np.ones(len(row[-1])))
    row, col, val = (np.concatenate(x) for x in (row, col, val))
    order = np.lexsort((col, row))
    return row[order], col[order], val[order]


def _pairs(
    starts: np.ndarray, counts: np.ndarray, col: np.ndarray, val: np.ndarray, size: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, key of the two columns, product) of the upper triangle, by length of rows."""
    for k in np.unique(counts):
        rows = np.flatnonzero(counts == k)
        at = starts[rows, None] + np.arange(k)
        a, b = np.triu_indices(k)
        yield rows, col[at[:, a]] * size + col[at[:, b]], val[at[:, a]] * val[at[:, b]]


def sums(
    data: Design, betas: np.ndarray, left_out: np.ndarray, plain: bool = False,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(matrices, gradients, losses, held-out means) of each fit, in one pass.

    Fit f has the coefficients betas[f] and does not see the rows of fold left_out[f], whose
    mean loss is the last part. With `plain` all weights are 1, for sums of squares.
    """
    size, fits = data.size, len(betas)
    names = pa.array(data.terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, held = [], [], 0
        gradient, scalars = np.zeros((fits, size)), np.zeros((fits, 3))

        def cells() -> pa.RecordBatch:
            key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            merged = np.stack([np.bincount(inverse, x, len(key)) for x in np.hstack(values)])
            fit, at = np.nonzero(merged)
            return frame(fit, key[at] // size, key[at] % size, merged[fit, at])

        def frame(fit, i, j, v) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(x).astype(np.int32)) for x in (fit, i, j)]
                + [pa.array(np.asarray(v, float))], names=["fit", "i", "j", "v"])

        for batch in batches:
            for first in range(0, len(batch), ROWS):
                part = batch.slice(first, ROWS)
                y, fold, n = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
                row, col, val = _cells(part, names)
                counts = np.bincount(row, minlength=len(part))
                starts = np.cumsum(counts) - counts
                eta = np.add.reduceat(val[:, None] * betas.T[col], starts)
                mean = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                seen = n[:, None] * (fold[:, None] != left_out)
                unseen = n[:, None] - seen
                loss = np.logaddexp(0, eta) - y[:, None] * eta
                scalars += np.stack([(loss * seen).sum(0), (loss * unseen).sum(0),
                                     unseen.sum(0)], 1)
                push = val[:, None] * ((y[:, None] - mean) * seen)[row]
                for f in range(fits):
                    gradient[f] += np.bincount(col, push[:, f], size)
                weight = (1.0 if plain else mean * (1 - mean)) * seen
                for rows, key, product in _pairs(starts, counts, col, val, size):
                    key, inverse = np.unique(key.ravel(), return_inverse=True)
                    keys.append(key)
                    values.append(np.stack([
                        np.bincount(inverse, (product * weight[rows, f, None]).ravel(), len(key))
                        for f in range(fits)]))
                    held += len(key) * fits
                if held > HELD:
                    yield cells()
                    keys, values, held = [], [], 0
        if keys:
            yield cells()
            fit, j = np.nonzero(gradient)
            yield frame(fit, np.full(len(fit), GRADIENT), j, gradient[fit, j])
            fit, what = np.divmod(np.arange(3 * fits), 3)
            yield frame(fit, LOSS - what, np.zeros(3 * fits), scalars.ravel())

    found = data.rows.mapInArrow(run, SUMS).groupBy("fit", "i", "j").agg(
        F.sum("v").alias("v")).toArrow()
    fit, i, j, v = (found.column(c).to_numpy() for c in range(4))
    matrix, gradient = np.zeros((fits, size, size)), np.zeros((fits, size))
    inside = i >= 0
    matrix[fit[inside], i[inside], j[inside]] = v[inside]
    matrix[fit[inside], j[inside], i[inside]] = v[inside]
    gradient[fit[i == GRADIENT], j[i == GRADIENT]] = v[i == GRADIENT]
    out = np.zeros((3, fits))
    for k, what in enumerate((LOSS, HELD_OUT, HELD_ROWS)):
        out[k, fit[i == what]] = v[i == what]
    held_out = np.divide(out[1], out[2], out=np.full(fits, np.nan), where=out[2] > 0)
    return matrix, gradient, out[0], held_out


def factor(matrix: np.ndarray, tolerance: float = ALIAS) -> tuple[np.ndarray, np.ndarray]:
    """(lower factor, kept) of a matrix of sums of products, in panels of columns.

    Columns that earlier ones explain, up to the tolerance of what they have beside the
    intercept, are not kept; their rows of the factor are 0. The intercept is column 0.
    """
    size = len(matrix)
    lower, kept = np.zeros_like(matrix), np.zeros(size, bool)
    diagonal = np.diag(matrix)
    own = diagonal - (matrix[0] ** 2 / matrix[0, 0] if matrix[0, 0] > 0 else 0.0)
    own = np.where(own > 1e-12 * diagonal, own, np.inf)
    own[0] = diagonal[0] if diagonal[0] > 0 else np.inf
    for low in range(0, size, PANEL):
        high = min(size, low + PANEL)
        # What the earlier panels leave of this one, from its diagonal down.
        left = matrix[low:, low:high] - lower[low:, :low] @ lower[low:high, :low].T
        for k in range(high - low):
            pivot = left[k, k]
            if pivot > tolerance * own[low + k]:
                kept[low + k] = True
                column = left[k:, k] / math.sqrt(pivot)
                lower[low + k:, low + k] = column
                left[k:, k + 1:] -= np.outer(column, column[1:high - low - k])
        gone = ~kept[low:high]
        lower[low:high][gone] = 0.0
    lower[~kept] = 0.0
    return lower, kept


def _step(matrix: np.ndarray, gradient: np.ndarray, kept: np.ndarray) -> np.ndarray:
    out = np.zeros(len(gradient))
    at = np.flatnonzero(kept)
    inner = matrix[np.ix_(at, at)]
    try:
        out[at] = np.linalg.solve(inner, gradient[at])
    except np.linalg.LinAlgError:
        out[at] = np.linalg.lstsq(inner, gradient[at], rcond=None)[0]
    return out


@dataclass
class Fits:
    """Coefficients (a row per fit), the matrices at them, columns kept, held-out losses."""

    betas: np.ndarray
    matrices: np.ndarray
    kept: np.ndarray
    held_out: np.ndarray
    converged: bool
    passes: int


def newton(
    data: Design, penalties: list[float], left_out: list[int], intercept: bool = True,
) -> Fits:
    """All fits at once; fit f has penalties[f] and is blind for fold left_out[f] (-2: none).

    A penalty is on the columns scaled by their deviation in the rows that the fit sees, and
    per row, as in Spark's own ridge fits; the intercept has none. A step that does not
    lessen the loss is halved. Fits whose matrices do not fit in `CELLS` go one after another.
    """
    many = max(1, CELLS // data.size ** 2)
    if len(penalties) > many:
        parts = [newton(data, penalties[k:k + many], left_out[k:k + many], intercept)
                 for k in range(0, len(penalties), many)]
        return Fits(*(np.concatenate([getattr(p, x) for p in parts]) for x in (
            "betas", "matrices", "kept", "held_out")), all(p.converged for p in parts),
            sum(p.passes for p in parts))
    fits, size = len(penalties), data.size
    blind = np.array(left_out)
    betas = np.zeros((fits, size))
    plain, *_ = sums(data, betas, blind, plain=True)
    weight = np.zeros((fits, size))
    kept = np.zeros((fits, size), bool)
    for f, penalty in enumerate(penalties):
        n = max(plain[f, 0, 0], 1.0)
        mean = plain[f, 0] / n
        variance = np.maximum(np.diag(plain[f]) / n - mean ** 2, 0.0) * n / max(n - 1, 1)
        weight[f] = penalty * n * variance
        weight[f, 0] = 0.0
        gram = plain[f]
        if not intercept:
            gram = gram.copy()
            gram[0] = gram[:, 0] = 0.0
        # With a penalty every column that varies has an estimate.
        kept[f] = factor(gram)[1] if penalty == 0 else variance > 1e-12
        kept[f, 0] = intercept and plain[f, 0, 0] > 0
    value = np.full(fits, np.inf)
    good, step = betas, np.zeros_like(betas)
    for passes in range(2, STEPS + 2):
        matrix, gradient, loss, held_out = sums(data, betas, blind)
        now = loss + (weight * betas ** 2).sum(1) / 2
        worse = now > value + 1e-9 * np.abs(value)
        if worse.any():
            step[worse] /= 2
            betas = np.where(worse[:, None], good + step, betas)
        ok = ~worse
        if ok.all() and np.abs(step).max(initial=0.0) < CONVERGED and passes > 2:
            return Fits(betas, matrix, kept, held_out, True, passes)
        value = np.where(ok, now, value)
        good = np.where(ok[:, None], betas, good)
        for f in np.flatnonzero(ok):
            step[f] = _step(matrix[f] + np.diag(weight[f]),
                            gradient[f] - weight[f] * betas[f], kept[f])
        betas = good + step
    return Fits(good, matrix, kept, held_out, False, STEPS + 1)


def standard_errors(matrix: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Roots of the diagonal of the inverse, over the kept columns; NaN elsewhere."""
    out = np.full(len(kept), np.nan)
    at = np.flatnonzero(kept)
    lower = np.linalg.cholesky(matrix[np.ix_(at, at)])
    total = np.zeros(len(at))
    for low in range(0, len(at), PANEL):
        # A panel of the inverse of the factor, which is 0 above row `low`.
        inverse = np.zeros((len(at) - low, min(PANEL, len(at) - low)))
        for row in range(low, len(at), PANEL):
            end = min(len(at), row + PANEL)
            given = np.eye(end - row, inverse.shape[1]) if row == low else (
                -lower[row:end, low:row] @ inverse[:row - low])
            inverse[row - low:end - low] = np.linalg.solve(lower[row:end, row:end], given)
        total[low:low + inverse.shape[1]] = (inverse ** 2).sum(0)
    out[at] = np.sqrt(total)
    return out


def p_value(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
