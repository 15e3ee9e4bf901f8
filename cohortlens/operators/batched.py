"""Linear models trained together: every setting, fold and trial is one column of a weight matrix.

One pass over the rows evaluates the losses and gradients of all columns: a task multiplies its rows with the whole matrix and adds up one
gradient per column, and the columns' sums are combined on the JVM. A quasi-Newton step with an orthant-wise l1 part then moves all
columns at once on the driver, which holds a few numbers per column and feature, never a row. The number of jobs is the number of steps,
whatever the size of the grid.

A column minimises ``mean loss + l2/2 |w|^2 + l1 |w|_1`` over the rows outside its fold; the intercept is not penalised.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps remembered per column, and numbers of one row block times columns that a task holds at once.
MEMORY = 7
BLOCK_CELLS = 2_000_000
#: Width of the rounded corner of the hinge.
CORNER = 0.05


def logistic_loss(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and its slope for margins ``z`` and classes 0 and 1."""
    return np.logaddexp(0.0, z) - y * z, 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))) - y


def hinge_loss(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """max(0, 1 - margin) with its corner rounded over ``CORNER``."""
    sign = 2 * y - 1
    short = 1 - sign * z
    inside = np.clip(short, 0, CORNER)
    return inside**2 / (2 * CORNER) + np.maximum(short - CORNER, 0), -sign * inside / CORNER


LOSSES = {"logistic": logistic_loss, "hinge": hinge_loss}


@dataclass
class Columns:
    """What each column of the batch is: penalties, the repeat and fold it leaves out (-1: none), intercept, tolerance."""

    l2: np.ndarray
    l1: np.ndarray
    rep: np.ndarray
    fold: np.ndarray
    intercept: np.ndarray
    tol: np.ndarray
    #: With ``C`` instead of ``l2``, a column's l2 is 1 / (C * its rows).
    c: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.rep)


def columns(settings: Sequence[dict], n_splits: int = 0, n_repeats: int = 0, tol: float = 1e-4) -> tuple[Columns, np.ndarray]:
    """Every setting for every (repeat, fold) and once for all rows; the number of each column's setting."""
    places = [(-1, -1), *[(r, f) for r in range(n_repeats) for f in range(n_splits)]]
    rows = [(i, s, r, f) for i, s in enumerate(settings) for r, f in places]

    def of(name: str, default: float) -> np.ndarray:
        return np.array([float(s.get(name, default)) for _, s, _, _ in rows])

    c = of("c", 0.0)
    return (
        Columns(
            of("l2", 0.0), of("l1", 0.0), np.array([r for *_, r, _ in rows]), np.array([f for *_, f in rows]),
            of("intercept", 1.0) > 0, of("tol", tol), c if c.any() else None,
        ),
        np.array([i for i, *_ in rows]),
    )


def _outside(folds: np.ndarray | None, batch: Columns, n: int) -> np.ndarray:
    """Whether each row is one that a column learns from: rows x columns."""
    if folds is None:
        return np.ones((n, len(batch)), bool)
    return (batch.rep < 0) | (folds[:, batch.rep] != batch.fold)


def _blocks(batches, m: int, folded: bool):
    """Values with a leading 1, classes, weights and folds of at most so many rows that rows x columns stay bounded."""
    for batch in batches:
        step = max(1, BLOCK_CELLS // max(m, 1))
        for at in range(0, len(batch), step):
            part = batch.iloc[at : at + step]
            x = np.stack(part["values"].to_numpy())
            folds = np.stack(part["folds"].to_numpy()) if folded else None
            yield np.column_stack([np.ones(len(x)), x]), part["label"].to_numpy(float)[:, None], part["weight"].to_numpy(float)[:, None], folds


def _summed(rows: DataFrame, partial: Callable, m: int, width: int) -> np.ndarray:
    """Sums over all rows of one vector per column: every task emits each vector once, the JVM combines them."""

    def emit(batches):
        total = np.zeros((m, width))
        for block in _blocks(batches, m, "folds" in names):
            total += partial(*block)
        yield pd.DataFrame({"j": np.arange(m, dtype=np.int32), "v": list(total)})

    names = rows.columns
    parts = rows.mapInPandas(emit, "j int, v array<double>")
    found = parts.groupBy("j").agg(Summarizer.sum(array_to_vector("v")).alias("v")).select("j", vector_to_array("v").alias("v"))
    out = np.zeros((m, width))
    for r in found.collect():  # one row per column of the batch
        out[r["j"]] = r["v"]
    return out


def _pass(rows: DataFrame, w: np.ndarray, loss: str, batch: Columns) -> np.ndarray:
    """Per column: sum of weights, sum of losses, gradient of (intercept, weights)."""

    def partial(x, y, weight, folds):
        use = _outside(folds, batch, len(x)) * weight
        value, slope = LOSSES[loss](x @ w.T, y)
        return np.column_stack([use.sum(axis=0), (use * value).sum(axis=0), (use * slope).T @ x])

    return _summed(rows, partial, len(w), w.shape[1] + 2)


def _hits(rows: DataFrame, w: np.ndarray, batch: Columns) -> np.ndarray:
    """Per column: rows of its fold, and those on the right side."""

    def partial(x, y, weight, folds):
        held = ~_outside(folds, batch, len(x))
        right = ((x @ w.T) > 0) == (y > 0.5)
        return np.column_stack([held.sum(axis=0), (held & right).sum(axis=0)])

    return _summed(rows, partial, len(w), 2)


class _Memory:
    """Curvature pairs of each column and the two-loop product of all columns at once."""

    def __init__(self) -> None:
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, s: np.ndarray, y: np.ndarray) -> None:
        sy = (s * y).sum(axis=1)
        good = sy > 1e-12 * np.maximum((y * y).sum(axis=1), 1e-300)
        rho = np.where(good, 1 / np.where(good, sy, 1.0), 0.0)
        self.pairs = [*self.pairs, (s * good[:, None], y * good[:, None], rho)][-MEMORY:]

    def direction(self, g: np.ndarray) -> np.ndarray:
        q, alphas = g.copy(), []
        for s, y, rho in reversed(self.pairs):
            a = rho * (s * q).sum(axis=1)
            q -= a[:, None] * y
            alphas.append(a)
        scale = np.full(len(g), np.nan)
        for s, y, _ in self.pairs:  # the last good pair of a column sets its scale
            yy = (y * y).sum(axis=1)
            scale = np.where(yy > 0, (s * y).sum(axis=1) / np.where(yy > 0, yy, 1.0), scale)
        scale = np.where(np.isnan(scale), 1 / np.maximum(np.linalg.norm(g, axis=1), 1.0), scale)
        q *= scale[:, None]
        for (s, y, rho), a in zip(self.pairs, reversed(alphas)):
            q += (a - rho * (y * q).sum(axis=1))[:, None] * s
        return -q


def _pseudo(w: np.ndarray, g: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """Steepest subgradient: at zero, the side on which the objective falls, if any."""
    at_zero = np.where(g + l1 < 0, g + l1, np.where(g - l1 > 0, g - l1, 0.0))
    return np.where(w > 0, g + l1, np.where(w < 0, g - l1, at_zero))


def fit(rows: DataFrame, batch: Columns, loss: str = "logistic", max_iter: int = 100) -> np.ndarray:
    """Weights (columns, 1 + features), the intercept first, of every column.

    ``rows`` holds (label, values, weight) and, if the batch has folds, ``folds`` with one fold number per repeat; it is read once per
    step, so it should be held. A column stops when its objective falls by less than its tolerance, relatively, or when no
    step lowers it; the run ends when all have stopped, or after ``max_iter`` passes.
    """
    p = len(rows.select("values").first()["values"])
    m = len(batch)
    w = np.zeros((m, p + 1))
    free = np.ones((m, p + 1))
    free[:, 0] = batch.intercept
    l1 = np.column_stack([np.zeros(m), np.repeat(batch.l1[:, None], p, axis=1)])

    def objective(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = _pass(rows, at, loss, batch)
        n = np.maximum(sums[:, :1], 1e-300)
        l2 = batch.l2 if batch.c is None else 1 / (batch.c * n[:, 0])
        value = sums[:, 1] / n[:, 0] + 0.5 * l2 * (at[:, 1:] ** 2).sum(axis=1) + (l1 * np.abs(at)).sum(axis=1)
        slope = sums[:, 2:] / n
        slope[:, 1:] += l2[:, None] * at[:, 1:]
        return value, slope * free

    memory = _Memory()

    def turned() -> tuple[np.ndarray, np.ndarray]:
        """Directions in which the objectives fall, and the pseudo-gradients there."""
        steepest = _pseudo(w, slope, l1)
        down = memory.direction(steepest)
        down = np.where((l1 > 0) & (down * steepest >= 0), 0.0, down) * free  # penalised weights only against the pseudo-gradient
        uphill = (down * steepest).sum(axis=1) >= 0
        down[uphill] = -steepest[uphill]
        return down, steepest

    value, slope = objective(w)
    down, steepest = turned()
    step, going = np.ones(m), np.ones(m, bool)
    for _ in range(max_iter - 1):
        side = np.where(w != 0, np.sign(w), -np.sign(steepest))
        trial = w + (step * going)[:, None] * down
        trial = np.where((l1 > 0) & (trial * side < 0), 0.0, trial)  # a penalised weight stops at zero
        new_value, new_slope = objective(trial)
        enough = new_value <= value + 1e-4 * (steepest * (trial - w)).sum(axis=1)
        done, short = going & enough, going & ~enough
        memory.add(np.where(done[:, None], trial - w, 0.0), np.where(done[:, None], new_slope - slope, 0.0))
        small = value - new_value <= batch.tol * np.maximum(np.abs(new_value), 1e-6)
        w, slope = np.where(done[:, None], trial, w), np.where(done[:, None], new_slope, slope)
        value = np.where(done, new_value, value)
        going &= ~((done & small) | (short & (step < 1e-8)))
        if not going.any():
            break
        # Columns that moved turn, the others try a shorter step along the old direction.
        fresh, fresh_steepest = turned()
        down, steepest = (np.where(short[:, None], old, new) for old, new in ((down, fresh), (steepest, fresh_steepest)))
        step = np.where(short, step * 0.3, 1.0)
    return w


def search(rows: DataFrame, settings: Sequence[dict], loss: str, n_splits: int, n_repeats: int, max_iter: int = 100,
           tol: float = 1e-4) -> tuple[list[float], np.ndarray]:
    """Mean held-out accuracy of every setting over all folds of all repeats, and its weights on all rows."""
    batch, setting = columns(settings, n_splits, n_repeats, tol)
    w = fit(rows, batch, loss, max_iter)
    whole = w[batch.fold < 0]
    if n_splits * n_repeats == 0:
        return [float("nan")] * len(settings), whole
    hits = _hits(rows, w, batch)
    held = (batch.fold >= 0) & (hits[:, 0] > 0)
    share = np.divide(hits[:, 1], hits[:, 0], out=np.zeros(len(hits)), where=held)
    return [float(share[held & (setting == i)].mean()) for i in range(len(settings))], whole


def margin(values: str, weights: np.ndarray) -> Callable[[DataFrame], DataFrame]:
    """frame -> frame with ``margin``, by one product per Arrow batch."""

    def product(v: pd.Series) -> pd.Series:
        return pd.Series(np.stack(v.to_numpy()) @ weights[1:] + weights[0])

    return lambda df: df.withColumn("margin", F.pandas_udf(product, "double")(values))
