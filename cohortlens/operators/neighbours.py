"""Exact nearest neighbours by a metric partition.

Train rows belong to the cell of their nearest pivot; a cell knows how many rows it has and how near and far from the pivot they
lie. No row of a cell is nearer to a test row than the triangle inequality says. So every test row visits the nearest cells that
hold k rows between them, which bounds its k-th distance, and then only those other cells whose bound does not exceed that distance.
On clustered data most cells are never visited; on data without structure all are, and the result is the same.

A visit is one group: a bounded block of test rows meets a bounded block of train rows of one cell in numpy, and at most k candidates
per row are passed on, in the second round only those within the bound. A task holds one such group at a time. Blocks of a cell of any
size are spread over tasks: each train block is a key of its own, and one that many test blocks visit is copied once per ``VISITS`` of
them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import durable
from ..functions.keys import hash_order

#: Rows of a block, train rows per cell aimed at, pivots at most (they are held by every task).
BLOCK_ROWS = 8192
CELL_ROWS = 8192
MAX_PIVOTS = 1024
#: Test rows whose distances to a train block are held at once, pairs whose exact distance is, and test blocks per copy of a train block.
VISIT_ROWS = 128
PAIRS = 32_768
VISITS = 1
#: Test rows that are routed at once: each may go to every cell.
ROUTE_ROWS = 256
#: Share by which a bound must exceed a distance to count: rounding never drops a neighbour.
SLACK = 1e-9


def choose_pivots(train: DataFrame, n_train: int) -> np.ndarray:
    """Rows of smallest hash, one per ``CELL_ROWS`` train rows; at most ``MAX_PIVOTS`` reach the driver."""
    n = min(MAX_PIVOTS, max(1, n_train // CELL_ROWS))
    if n == 1:
        found = train.select("values").first()
        return np.array([found["values"]] if found else [], dtype=float)
    found = train.select("case_id", "values").orderBy(hash_order("case_id", 0), "case_id").limit(n)
    return np.array([r["values"] for r in found.select("values").collect()], dtype=float)


def _distances(values: pd.Series, pivots: np.ndarray) -> np.ndarray:
    x = np.stack(values.to_numpy())
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def assign_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` with ``cell`` and ``reach``, the nearest pivot and the distance to it."""

    def nearest(values: pd.Series) -> pd.DataFrame:
        d = _distances(values, pivots)
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype(np.int32), "reach": d[np.arange(len(d)), cell]})

    placed = F.pandas_udf(nearest, "cell int, reach double")("values")
    return rows.withColumn("_place", placed).select(*rows.columns, "_place.cell", "_place.reach")


class Cells:
    """Pivots, sizes and distance ranges of the cells: a few numbers per cell."""

    def __init__(self, pivots: np.ndarray, stats: Sequence) -> None:
        n = len(pivots)
        self.pivots = pivots
        self.size, self.near, self.far = np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, -np.inf)
        for r in stats:
            self.size[r["cell"]], self.near[r["cell"]], self.far[r["cell"]] = r["n"], r["near"], r["far"]

    def bounds(self, d: np.ndarray) -> np.ndarray:
        """Least distance of each row to any member of each cell, from its distances to the pivots."""
        bound = np.maximum(0.0, np.maximum(d - self.far, self.near - d))
        return np.where(self.size > 0, bound, np.inf)

    def first(self, d: np.ndarray, k: int) -> np.ndarray:
        """Cells that a row visits first: the nearest ones that hold ``k`` rows between them."""
        order = np.argsort(self.bounds(d) + d * 1e-3, axis=1, kind="stable")
        held = np.cumsum(self.size[order], axis=1)
        take = (held - self.size[order] < k) & (self.size[order] > 0)
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, take, axis=1)
        return out


def _routed(test: DataFrame, cells: Cells, k: int, reached: bool) -> DataFrame:
    """``test`` once per cell that a row visits: first without, then with its distance ``limit``."""

    def route(batches):
        for whole in batches:
            for start in range(0, len(whole), ROUTE_ROWS):
                batch = whole.iloc[start : start + ROUTE_ROWS]
                d = _distances(batch["values"], cells.pivots)
                take = cells.first(d, k)
                limit = np.full(len(batch), np.inf)
                if reached:
                    limit = batch["limit"].to_numpy(float) * (1 + SLACK) + np.finfo(float).tiny
                    take = ~take & (cells.bounds(d) <= limit[:, None])
                at, cell = np.nonzero(take)
                yield batch.iloc[at].assign(limit=limit[at], cell=cell.astype(np.int32))[[*kept, "limit", "cell"]]

    kept = [c for c in test.columns if c != "limit"]
    kinds = ", ".join(f"{c} {test.schema[c].dataType.simpleString()}" for c in kept)
    return test.mapInPandas(route, f"{kinds}, limit double, cell int")


def _dealt(rows: DataFrame, sizes: DataFrame, prefix: str) -> DataFrame:
    """``rows`` with the hash block of about ``BLOCK_ROWS`` rows of the cell that they are in, and the number of rows of the cell."""
    blocks = F.ceil(F.col(f"{prefix}_n") / F.lit(BLOCK_ROWS)).cast("int")
    placed = rows.join(sizes.withColumnRenamed("_n", f"{prefix}_n"), "cell")
    return placed.withColumn(f"{prefix}_block", F.pmod(F.xxhash64("case_id"), blocks).cast("int"))


def _visited(train: DataFrame, routed: DataFrame, k: int, exclude_self: bool, reps: int) -> DataFrame:
    """(case_id, label, rep, neighbour, vote, d): the best ``k`` of each visit, none beyond the row's ``limit``."""
    routed = durable(routed)
    sizes = routed.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
    left = _dealt(routed, sizes, "l")
    # Every test block meets every train block of its cell; train blocks of one cell are keys of their own.
    r_blocks = F.ceil(F.col("r_n") / F.lit(BLOCK_ROWS)).cast("int")
    per_cell = train.groupBy("cell").agg(F.first(r_blocks).alias("_blocks"))
    copies = F.ceil(F.ceil(F.col("_n") / F.lit(BLOCK_ROWS)) / F.lit(VISITS)).cast("int")
    left = left.join(per_cell, "cell").withColumn("r_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    left = left.withColumn("_copy", F.pmod("l_block", F.ceil(F.ceil(F.col("l_n") / F.lit(BLOCK_ROWS)) / F.lit(VISITS)).cast("int")))
    right = train.join(sizes, "cell").withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    fields = ["case_id", "label", "values", *(["folds"] if reps else [])]
    key = ["cell", "r_block", "_copy"]
    none = {"case_id": [], "label": [], "rep": [], "neighbour": [], "vote": [], "d": []}

    def visit(tests: pd.DataFrame, trains: pd.DataFrame) -> pd.DataFrame:
        if not len(tests) or not len(trains):
            return pd.DataFrame(none)
        trains = trains.iloc[np.argsort(trains["case_id"].to_numpy(object), kind="stable")]  # ties go by id
        ids, votes = trains["case_id"].to_numpy(object), trains["label"].to_numpy()
        own, labels, limit = tests["case_id"].to_numpy(object), tests["label"].to_numpy(), tests["limit"].to_numpy(float)
        a, b = np.stack(tests["values"].to_numpy()), np.stack(trains["values"].to_numpy())
        folds = (np.stack(tests["folds"].to_numpy()), np.stack(trains["folds"].to_numpy())) if reps else None
        near = _Nearness(b)
        found = []
        for at in range(0, len(a), VISIT_ROWS):
            part = slice(at, at + VISIT_ROWS)
            hidden = np.zeros((len(a[part]), len(b)), bool)
            if exclude_self:
                for i, (low, high) in enumerate(zip(np.searchsorted(ids, own[part]), np.searchsorted(ids, own[part], "right"))):
                    hidden[i, low:high] = True
            masks = [hidden | (folds[0][part, rep][:, None] == folds[1][:, rep]) if reps else hidden for rep in range(max(reps, 1))]
            d = near.distances(a[part], masks, k)
            for rep, mask in enumerate(masks):
                i, j = _best(np.where(mask, np.inf, d), k)
                within = d[i, j] <= limit[part][i]
                i, j = i[within], j[within]
                found.append((own[part][i], labels[part][i], np.full(len(i), rep, np.int32), ids[j], votes[j], d[i, j]))
        columns = [np.concatenate(c) for c in zip(*found)]
        return pd.DataFrame(dict(zip(none, columns))).astype({"vote": np.int32})

    rows = left.select(*key, *fields, "limit").groupBy(*key).cogroup(right.select(*key, *fields).groupBy(*key))
    return rows.applyInPandas(visit, "case_id string, label int, rep int, neighbour string, vote int, d double")


class _Nearness:
    """Distances to a block of rows: products tell which pairs can be among the nearest, and only those are measured exactly."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows, self.centre = rows, rows.mean(axis=0)
        self.moved = rows - self.centre
        self.square = (self.moved**2).sum(axis=1)

    def distances(self, a: np.ndarray, masks: Sequence[np.ndarray], k: int) -> np.ndarray:
        """Distances of the rows ``a``; infinite where a pair is not among the ``k`` least of any mask (true: passed over)."""
        moved = a - self.centre
        square = (moved**2).sum(axis=1)
        about = square[:, None] + self.square - 2 * moved @ self.moved.T
        # Far above the rounding of products, squares and the move to the centre.
        error = 1e-12 * a.shape[1] * (square[:, None] + self.square.max() + float(np.abs(self.centre).max() ** 2))
        wanted = np.zeros(about.shape, bool)
        at = min(k, about.shape[1]) - 1
        for mask in masks:
            seen = np.where(mask, np.inf, about)
            wanted |= ~mask & ~(seen > np.partition(seen, at, axis=1)[:, at, None] + 2 * error)
        i, j = np.nonzero(wanted)
        d = np.full(about.shape, np.inf)
        for start in range(0, len(i), PAIRS):
            x, y = i[start : start + PAIRS], j[start : start + PAIRS]
            d[x, y] = np.sqrt(((a[x] - self.rows[y]) ** 2).sum(axis=1))
        return d


def _best(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` least finite numbers of each row; ties by column."""
    at = min(k, d.shape[1]) - 1
    reach = np.partition(d, at, axis=1)[:, at]
    i, j = np.nonzero((d <= reach[:, None]) & np.isfinite(d))
    order = np.lexsort((j, d[i, j], i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k]


def _closest(near: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("case_id", "rep").orderBy("d", "neighbour")
    return near.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)


def build_cells(train: DataFrame) -> tuple[DataFrame, Cells, int]:
    """Train rows with their blocks (cell, r_block, r_n), the cells' numbers, and the number of train rows."""
    n_train = train.count()
    pivots = choose_pivots(train, n_train)
    placed = assign_cells(train, pivots)
    if len(pivots) > 1:
        placed = durable(placed)
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"), F.min("reach").alias("near"), F.max("reach").alias("far"))
    cells = Cells(pivots, stats.withColumnRenamed("_n", "n").collect())
    return _dealt(placed.drop("reach"), stats.select("cell", "_n"), "r"), cells, n_train


def routes(train: DataFrame, test: DataFrame, k: int) -> tuple[DataFrame, int]:
    """(case_id, cell) of every visit of the test rows, and the number of cells with rows."""
    packed, cells, _ = build_cells(train)
    first, second, _ = _rounds(packed, cells, test, k, False, 0)
    both = first if second is None else first.union(second)
    return both.select("case_id", "cell"), int((cells.size > 0).sum())


def _rounds(packed: DataFrame, cells: Cells, test: DataFrame, k: int, exclude_self: bool, reps: int):
    """Routed test rows of both rounds (None where the first round meets every cell), and the candidates of the first."""
    # A row passes over itself, or over rows of its own fold: its first cells should then hold more than k.
    asked = 2 * k + 8 if reps else k + exclude_self
    first = _routed(test, cells, asked, False)
    near = _closest(_visited(packed, first, k, exclude_self, reps), k).drop("_rank")
    if (cells.size > 0).sum() == 1:
        return first, None, near
    near = durable(near)
    full = near.groupBy("case_id", "rep").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d"))
    full = full.withColumn("d", F.when(F.col("n") >= k, F.col("d")).otherwise(F.lit(float("inf"))))
    limits = full.groupBy("case_id").agg(F.max("d").alias("limit"), F.count(F.lit(1)).alias("reps"))
    limit = F.when(F.col("reps") == max(reps, 1), F.col("limit")).otherwise(F.lit(float("inf")))
    limits = limits.select("case_id", limit.alias("limit"))
    held = test.join(limits, "case_id", "left").fillna(float("inf"), ["limit"])
    return first, _routed(held, cells, asked, True), near


def nearest_neighbours(train: DataFrame, test: DataFrame, k: int, exclude_self: bool = False, reps: int = 0) -> DataFrame:
    """The k nearest train rows of every test row by Euclidean distance: (case_id, label, neighbour, vote, d, rank).

    Both frames hold (case_id, label, values), one row per case. With ``reps``, they also hold ``folds``, one fold number per repeat:
    neighbours never share the fold of the repeat, and the result has a column ``rep``; all repeats are found in one pass. Ties are
    settled by id. Fewer train rows than k give fewer neighbours; an empty train frame gives none.
    """
    columns = ["case_id", "label", "values", *(["folds"] if reps else [])]
    types = [F.col("case_id").cast("string").alias("case_id"), F.col("label").cast("int").alias("label"),
             F.col("values").cast("array<double>").alias("values"), *columns[3:]]
    same = train is test
    train = durable(train.select(*types))  # every step below reads it again
    packed, cells, n_train = build_cells(train)
    if same:
        test = train
    else:
        test = test.select(*types) if (cells.size > 0).sum() == 1 else durable(test.select(*types))
    if n_train == 0:
        none = test.filter(F.lit(False)).withColumns({"neighbour": F.lit(""), "vote": F.lit(0), "d": F.lit(0.0), "rank": F.lit(1)})
        return none.drop("values", "folds")
    _, second, near = _rounds(packed, cells, test, k, exclude_self, reps)
    if second is not None:
        near = near.union(_visited(packed, second, k, exclude_self, reps))
        near = _closest(near, k)
    else:
        near = near.withColumn("_rank", F.row_number().over(Window.partitionBy("case_id", "rep").orderBy("d", "neighbour")))
    near = near.withColumnRenamed("_rank", "rank")
    return near if reps else near.drop("rep")
