"""Lasso over wide frames: paths and cross-validation from a table of cross products, by growing working sets.

The products of every fold are one table (fold, i, row). No task and no driver holds a whole matrix of them: a problem (the rows outside
one fold, or all rows) is solved in a task from the product rows of its working columns alone. A step of the path counts only once
no column outside the working set breaks its optimality condition, which is checked for every column; where one does, the columns that
lean hardest against it join the working set and the path goes on from there in the next round.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import durable
from ..functions.gram import column_stats, gram
from .frame import stratified_folds, to_arrays

ALL = "all"
FOUND = "problem step alpha mse columns coefs line lacking"


def descend(
    g: np.ndarray, c: np.ndarray, b: np.ndarray, alpha: float, usable: np.ndarray, tol: float = 1e-7, sweeps: int = 1000
) -> np.ndarray:
    """Coefficients at one penalty by coordinate descent, from covariances ``g`` of the columns and ``c`` with the response.

    Sweeps over the non-zero columns alternate with sweeps over all ``usable`` ones; ``b`` is the start.
    """
    b = b.copy()
    fit = g @ b
    diag = np.diag(g)
    active = usable
    for sweep in range(sweeps):
        moved = 0.0
        for j in active:
            rho = c[j] - fit[j] + diag[j] * b[j]
            new = math.copysign(max(abs(rho) - alpha, 0.0), rho) / diag[j]
            step = new - b[j]
            if step:
                fit += step * g[j]
                b[j] = new
                moved = max(moved, abs(step) * math.sqrt(diag[j]))
        full = active is usable
        if moved < tol:
            if full:
                break
            active = usable
        else:
            active = np.flatnonzero(b) if full and sweep else usable
    return b


@dataclass
class Sums:
    """Sums over some rows, in the units of the columns: count, columns, squares, products with the label, label, its square."""

    n: float
    s: np.ndarray
    diag: np.ndarray
    xy: np.ndarray
    y: float
    yy: float

    def without(self, other: Sums) -> Sums:
        return Sums(*[getattr(self, k) - getattr(other, k) for k in ("n", "s", "diag", "xy", "y", "yy")])


def solve_steps(
    train: Sums, test: Sums | None, columns: np.ndarray, products: np.ndarray, held_out: np.ndarray | None, spread: np.ndarray,
    alphas: Sequence[float], first: int, start: np.ndarray, width: int, tol: float = 1e-7,
) -> tuple[list[tuple[int, float | None, np.ndarray]], list[int]]:
    """(finished steps as (step, error on ``test``, coefficients of ``columns``), columns that the next step lacks).

    ``products`` are the rows of ``columns`` (sorted) over all columns. The second list is empty once the path is finished.
    A column that hardly varies against its own ``spread`` stays out, so no scale hides another.
    """
    mean = train.s / train.n
    c = (train.xy - mean * train.y) / train.n
    variance = train.diag / train.n - mean**2
    fit_for = (spread > 0) & (variance > 1e-12 * spread**2)
    outside = fit_for.copy()
    outside[columns] = False
    cov = products / train.n - mean[columns][:, None] * mean
    among = np.ascontiguousarray(cov[:, columns])
    usable = np.flatnonzero(fit_for[columns])
    out = []
    b = start
    for step in range(first, len(alphas)):
        b = descend(among, c[columns], b, alphas[step], usable, tol)
        pull = np.where(outside, np.abs(c - b @ cov), 0.0)
        # A column outside would move by (pull - alpha) / sqrt(variance) of its unit spread, the measure that ``tol`` bounds.
        broken = np.flatnonzero(pull - alphas[step] > tol * np.sqrt(np.maximum(variance, 0.0)))
        if len(broken):
            leaning = np.argsort(-pull, kind="stable")[: max(width, len(broken))]
            return out, sorted({*broken.tolist(), *leaning[pull[leaning] > 0].tolist()})
        error = None
        if test is not None:
            b0 = (train.y - b @ train.s[columns]) / train.n
            total = b0 * b0 * test.n + 2 * b0 * (b @ test.s[columns] - test.y) + test.yy
            total += b @ held_out[:, columns] @ b - 2 * b @ test.xy[columns]
            error = total / test.n
        out.append((step, error, b))
    return out, []


def lasso_tables(
    feat: DataFrame, folds: int = 10, n_alphas: int = 100, eps: float = 1e-3, seed: int = 42, width: int = 256
) -> tuple[DataFrame, DataFrame]:
    """(errors, coefficients): CV error mean/min/max per alpha, and alpha, feature, coef along the path on all rows.

    One pass over the data yields the products of every fold; training sums are the totals less the fold's own. All problems
    advance together: a round joins the product rows that each of them asks for and solves them in one task per problem. A working
    set starts with the ``width`` columns closest to the label and grows by at least as many; ``width`` moves work and
    memory, never the result. The driver holds a few numbers per column and problem.
    """
    spark = feat.sparkSession
    names = [r["feature"] for r in feat.select("feature", "ord").distinct().orderBy("ord").collect()]
    names = spark.createDataFrame(list(enumerate(names)), "pos int, feature string")
    assigned = stratified_folds(feat.select("case_id", "label").distinct(), folds, 1, seed).select("case_id", "fold")
    rows = to_arrays(feat).join(assigned, "case_id")
    columns = column_stats(rows)
    p = len(columns.mean) - 1
    scale = np.append(1.0, np.where(columns.spread > 0, columns.spread, 1.0))
    spread = columns.spread[:-1]
    table = durable(gram(rows, "fold", columns=columns))

    def rescaled(i: int, row: Sequence[float]) -> np.ndarray:
        return np.asarray(row) * scale[i] * scale

    # Per fold: the square of every column, and the whole rows of the constant and the label.
    edges: dict[str, dict[int, np.ndarray]] = {}
    squares: dict[str, np.ndarray] = {}
    whole_row = F.when(F.col("i").isin(0, p + 1), F.col("row")).alias("row")
    for r in table.select("grp", "i", F.element_at("row", F.col("i") + 1).alias("v"), whole_row).collect():
        squares.setdefault(r["grp"], np.zeros(p + 2))[r["i"]] = r["v"] * scale[r["i"]] ** 2
        if r["row"] is not None:
            edges.setdefault(r["grp"], {})[r["i"]] = rescaled(r["i"], r["row"])
    held = {
        g: Sums(e[0][0], e[0][1:-1], squares[g][1:-1], e[p + 1][1:-1], e[0][-1], squares[g][-1]) for g, e in edges.items()
    }
    total = Sums(*[sum(getattr(s, k) for s in held.values()) for k in ("n", "s", "diag", "xy", "y", "yy")])
    problems = {**held, ALL: None}
    cross = (total.xy - total.s * total.y / total.n) / total.n
    top = float(np.max(np.abs(cross)))
    alphas = [top * eps ** (i / (n_alphas - 1)) for i in range(n_alphas)]

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        (problem,) = key
        test = held.get(problem)
        train = total if test is None else total.without(test)
        part = part.sort_values("i")
        at = part["i"].to_numpy()
        everything = np.stack([rescaled(i, r)[1:-1] for i, r in zip(at, part["whole"])])
        out_of = None if test is None else np.stack([rescaled(i, r)[1:-1] for i, r in zip(at, part["own"])])
        begun = state[problem]
        start = np.array([begun["b"].get(int(j), 0.0) for j in at - 1])
        inside = everything if out_of is None else everything - out_of
        done, lacking = solve_steps(train, test, at - 1, inside, out_of, spread, alphas, begun["step"], start, width)
        found = []
        for step, error, b in done:
            line = np.zeros(p if test is None else 0)
            if test is None:
                line[at - 1] = b
            found.append((problem, step, alphas[step], error, (at - 1)[b != 0].tolist(), b[b != 0].tolist(), line.tolist(), []))
        if lacking:
            found.append((problem, None, None, None, [], [], [], lacking))
        return pd.DataFrame(found, columns=FOUND.split())

    whole = table.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("whole"))
    whole = durable(whole)
    kinds = "string int double double array<int> array<double> array<double> array<int>"
    schema = ", ".join(map(" ".join, zip(FOUND.split(), kinds.split())))
    first = np.argsort(-np.abs(cross) / np.where(spread > 0, spread, np.inf), kind="stable")[:width].tolist()
    state = {g: {"step": 0, "b": {}, "columns": set(first)} for g in problems}
    steps = None
    while state:
        asked = [(g, int(j) + 1) for g, s in state.items() for j in s["columns"]]
        asked = spark.createDataFrame(pd.DataFrame(asked, columns=["problem", "i"]), "problem string, i int")
        own = table.select(F.col("grp").alias("problem"), "i", F.col("row").alias("own"))
        parts = asked.join(whole, "i").join(own, ["problem", "i"], "left")
        found = durable(parts.groupBy("problem").applyInPandas(solve, schema))
        finished = found.filter(F.col("step").isNotNull()).drop("lacking")
        steps = finished if steps is None else steps.unionByName(finished)
        lacking = {r["problem"]: r["lacking"] for r in found.filter(F.col("step").isNull()).collect()}
        state = {g: {**s, "columns": s["columns"] | set(lacking[g])} for g, s in state.items() if g in lacking}
        last = finished.filter(F.col("problem").isin(list(state))).groupBy("problem")
        last = last.agg(F.max_by(F.struct("step", "columns", "coefs"), "step").alias("s"))
        reached = {r["problem"]: r["s"] for r in last.collect()} if state else {}
        for g, s in reached.items():
            state[g] |= {"step": s["step"] + 1, "b": dict(zip(s["columns"], s["coefs"]))}

    errors = steps.filter(F.col("problem") != ALL).groupBy("step", "alpha").agg(
        F.avg("mse").alias("mean"), F.min("mse").alias("min"), F.max("mse").alias("max")
    )
    path = steps.filter(F.col("problem") == ALL)
    cells = path.select("step", "alpha", F.posexplode("line").alias("pos", "coef"))
    return errors, cells.join(names, "pos").select("step", "alpha", "feature", "coef")
