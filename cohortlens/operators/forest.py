"""Forests grown to full depth for their importances.

Values are coded once by at most 32 bins per column and packed, a byte each, in blocks of cases. The upper nodes of a tree grow level by
level: tasks add up the class counts per bin of every open node, other tasks find a node's best split, and the driver keeps these splits.
Once a node holds at most ``LOCAL_VALUES`` codes, its rows meet in one task, which grows all that is below. So a tree takes a few passes
over the blocks, whatever its depth, and neither the driver nor a task holds a whole tree's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import stored

BINS = 32
#: Codes (rows x columns) that a task grows a subtree from, and codes of a block of cases.
LOCAL_VALUES, BLOCK_VALUES = 1 << 22, 1 << 20


def bin_edges(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Per column the values that a split may cut behind: all but the largest of up to 32 values, else their quantiles."""
    cells = rows.select(F.posexplode("values").alias("at", "value"))
    probs = [i / BINS for i in range(1, BINS)]
    found = cells.groupBy("at").agg(
        F.percentile_approx("value", probs, 1000).alias("cuts"), F.max("value").alias("top"), F.approx_count_distinct("value").alias("n")
    )
    edges, few = [np.zeros(0)] * width, []
    for r in found.collect():
        edges[r["at"]] = np.unique([c for c in r["cuts"] if c < r["top"]])
        few += [r["at"]] if r["n"] <= 2 * BINS else []
    for r in cells.filter(F.col("at").isin(few)).groupBy("at").agg(F.collect_set("value").alias("all")).collect() if few else []:
        if len(r["all"]) <= BINS:
            edges[r["at"]] = np.sort(r["all"])[:-1]
    return edges


def binned(rows: DataFrame, width: int) -> DataFrame:
    """Blocks of cases (block, label, code): classes and bins as bytes, case after case. ``rows`` has case, label, values."""
    labels = np.sort([r["label"] for r in rows.select("label").distinct().collect()])
    if len(labels) > 256:
        raise ValueError("more than 256 classes")
    edges, most = bin_edges(rows, width), max(1, BLOCK_VALUES // width)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, most) for at in range(0, batch.num_rows, most)):
                values = part.column("values")
                if not (np.diff(values.offsets.to_numpy()) == width).all():
                    raise ValueError("a case lacks features, or has one twice")
                values = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                codes = np.stack([np.searchsorted(e, v) for e, v in zip(edges, values.T)], axis=1).astype(np.uint8)
                classes = np.searchsorted(labels, part.column("label").to_numpy()).astype(np.uint8)
                out = [[part.column("case")[0].as_py()], [classes.tobytes()], [codes.tobytes()]]
                yield pa.record_batch([pa.array(out[0], pa.int64()), *map(pa.array, out[1:])], ["block", "label", "code"])

    held = rows.select("case", "label", "values").mapInArrow(packed, "block bigint, label binary, code binary")
    return stored(held, "binned-cases")


def _split_gain(left: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Weight times fall of the Gini impurity, from class counts (classes, ...) of the left part and of the node."""
    gain = 0.0
    for sign, counts in ((1, left), (1, whole - left), (-1, whole)):
        gain = gain + sign * sum(c * c for c in counts) / np.maximum(sum(counts), 1)
    return gain


#: Gains up to this are rounding.
LEAST_GAIN = 1e-9


def grow(codes: np.ndarray, label: np.ndarray, weight: np.ndarray, classes: int, tried: int, depth: int, rng) -> np.ndarray:
    """Summed gains per column of the tree below one node: all nodes of a level at once, every node with columns of its own."""
    width = codes.shape[1]
    gains = np.zeros(width)
    rows, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
    for _ in range(depth):
        nodes = node.max(initial=0) + 1
        counts = np.bincount(label[rows].astype(np.int64) * nodes + node, weight[rows], nodes * classes).reshape(classes, nodes)
        mixed = (counts > 0).sum(axis=0) > 1
        if not mixed.any():
            break
        number, counts = np.cumsum(mixed) - 1, counts[:, mixed]
        keep = mixed[node]
        rows, node = rows[keep], number[node[keep]]
        before = np.cumsum(counts, axis=1) - counts  # rows are sorted by node below
        nodes = counts.shape[1]
        columns = rng.random((nodes, width)).argpartition(tried - 1, axis=1)[:, :tried]
        best, column, cut = np.full(nodes, LEAST_GAIN), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        tail = (label[rows].astype(np.int64) << 16) | weight[rows]
        for slot in range(tried):
            cell = node * BINS + codes[rows, columns[node, slot]]
            order = np.sort((cell << 24) | tail)
            cell, of, w = order >> 24, (order >> 16) & 255, order & 65535
            of_node = cell // BINS
            last = np.flatnonzero((cell[1:] != cell[:-1]) & (of_node[1:] == of_node[:-1]))
            if not len(last):
                continue
            at = of_node[last]
            left = np.stack([np.cumsum(np.where(of == c, w, 0))[last] for c in range(classes)]) - before[:, at]
            gain = _split_gain(left, counts[:, at])
            first = np.flatnonzero(np.diff(at, prepend=-1))
            top = np.maximum.reduceat(gain, first)
            hit = np.flatnonzero(gain == np.repeat(top, np.diff(first, append=len(at))))
            hit = hit[np.flatnonzero(np.diff(at[hit], prepend=-1))]
            better = top > best[at[first]]
            on = at[first][better]
            best[on], column[on], cut[on] = top[better], columns[on, slot], cell[last[hit[better]]] % BINS
        split = best > LEAST_GAIN
        gains += np.bincount(column[split], best[split], width)
        keep = split[node]
        rows, node = rows[keep], node[keep]
        node = 2 * (np.cumsum(split) - 1)[node] + (codes[rows, column[node]] > cut[node])
    return gains


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for block, label, code in zip(*(batch.column(c) for c in ("block", "label", "code"))):
            codes = np.frombuffer(code.as_py(), np.uint8).reshape(-1, width)
            yield block.as_py(), np.frombuffer(label.as_py(), np.uint8), codes


def _landed(splits: dict[int, tuple[int, int]], codes: np.ndarray) -> np.ndarray:
    """The node that every row comes to: 1 is the root, 2 i and 2 i + 1 are below node i."""
    node = np.ones(len(codes), np.int64)
    for at in sorted(splits):
        column, cut = splits[at]
        here = np.flatnonzero(node == at)
        node[here] = 2 * at + (codes[here, column] > cut)
    return node


class RandomForestClassifier:
    """Trees on bootstrap rows, each node with the best of ``sqrt`` of the columns by Gini impurity; ``fit`` gives their importances."""

    def __init__(self, numTrees: int, seed: int, maxDepth: int):
        self.trees, self.seed, self.depth = numTrees, seed, maxDepth

    def getNumTrees(self) -> int:
        return self.trees

    def getSeed(self) -> int:
        return self.seed

    def fit(self, blocks: DataFrame, width: int, counts: np.ndarray) -> np.ndarray:
        """Importances (tree, column), each row adding to 1 or all 0. ``blocks`` as ``binned`` gives them, ``counts`` rows per class."""
        seed, classes, tried = self.seed, len(counts), min(width, int(np.ceil(np.sqrt(width))))
        most = max(256, LOCAL_VALUES // width)
        trees = range(self.trees)
        gains = np.zeros((self.trees, width))
        splits: list[dict[int, tuple[int, int]]] = [{} for _ in trees]
        open_: list[list[int]] = [[1] if counts.sum() > most else [] for _ in trees]
        local: list[list[int]] = [[] if counts.sum() > most else [1] for _ in trees]
        if self.depth < 1:
            return gains

        def bag(tree: int, block: int, n: int) -> np.ndarray:
            return np.random.default_rng([seed, tree, block]).poisson(1.0, n)

        def columns_of(tree: int, node: int) -> np.ndarray:
            return np.random.default_rng([seed, tree, node, 1]).permutation(width)[:tried]

        def counted(batches):
            sums = [np.zeros((len(open_[t]), tried, BINS * classes)) for t in trees]
            picked = [np.array([columns_of(t, i) for i in open_[t]]) for t in trees]
            for block, label, codes in _blocks(batches, width):
                for t in trees:
                    if not open_[t]:
                        continue
                    weight, node = bag(t, block, len(codes)), _landed(splits[t], codes)
                    wanted = np.array(open_[t])
                    at = np.minimum(np.searchsorted(wanted, node), len(wanted) - 1)
                    here = np.flatnonzero((wanted[at] == node) & (weight > 0))
                    at = at[here]
                    for slot in range(tried):
                        key = (at * BINS + codes[here, picked[t][at, slot]]) * classes + label[here]
                        sums[t][:, slot] += np.bincount(key, weight[here], len(wanted) * BINS * classes).reshape(len(wanted), -1)
            for t in trees:
                for node, s in zip(open_[t], sums[t]):
                    yield pa.record_batch([pa.array([t], pa.int32()), pa.array([node]), pa.array([s.tobytes()])], ["tree", "node", "sums"])

        def chosen(key, table):
            tree, node = key[0].as_py(), key[1].as_py()
            sums = sum(np.frombuffer(s.as_py()) for s in table.column("sums")).reshape(tried, BINS, classes)
            left = np.moveaxis(np.cumsum(sums, axis=1), 2, 0)
            whole = left[:, :1, -1:]
            gain = np.where((sum(left) > 0) & (sum(left) < sum(whole)), _split_gain(left, whole), 0.0)
            slot, cut = np.unravel_index(np.argmax(gain), gain.shape)
            sides = [left[:, slot, cut], whole[:, 0, 0] - left[:, slot, cut]]
            out = {"tree": [tree], "node": [node], "column": [int(columns_of(tree, node)[slot])], "cut": [int(cut)], "gain": [float(gain[slot, cut])]}
            return pa.table(out | {"sides": [[s.tolist() for s in sides]]}).cast(best)

        best = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("column", pa.int32()), ("cut", pa.int32()), ("gain", pa.float64()),
                          ("sides", pa.list_(pa.list_(pa.float64())))])
        kind = "tree int, node bigint, column int, cut int, gain double, sides array<array<double>>"
        while any(open_):
            sums = blocks.mapInArrow(counted, "tree int, node bigint, sums binary")
            found = sums.groupBy("tree", "node").applyInArrow(chosen, kind).collect()
            open_ = [[] for _ in trees]
            for r in sorted(found, key=lambda r: r["node"]):
                if r["gain"] <= LEAST_GAIN:
                    continue
                t, node = r["tree"], r["node"]
                splits[t][node] = (r["column"], r["cut"])
                gains[t, r["column"]] += r["gain"]
                for child, side in zip((2 * node, 2 * node + 1), r["sides"]):
                    if child.bit_length() <= self.depth and sum(x > 0 for x in side) > 1:
                        (local if sum(side) <= most else open_)[t].append(child)

        def sent(batches):
            for block, label, codes in _blocks(batches, width):
                for t in trees:
                    weight, node = bag(t, block, len(codes)), _landed(splits[t], codes)
                    node[weight == 0] = 0
                    order = np.argsort(node, kind="stable")
                    ends = np.searchsorted(node[order], local[t], "right")
                    parts = [(i, order[a:b]) for i, a, b in zip(local[t], np.searchsorted(node[order], local[t]), ends) if b > a]
                    if not parts:
                        continue
                    out = [[x[at].tobytes() for _, at in parts] for x in (label, weight.astype(np.uint8), codes)]
                    ids = [pa.array([t] * len(parts), pa.int32()), pa.array([i for i, _ in parts], pa.int64())]
                    yield pa.record_batch([*ids, *map(pa.array, out)], ["tree", "node", "label", "weight", "code"])

        def finished(key, table):
            tree, node = key[0].as_py(), key[1].as_py()
            label, weight, codes = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8) for c in ("label", "weight", "code"))
            rng = np.random.default_rng([seed, tree, node, 2])
            below = grow(codes.reshape(-1, width), label, weight.astype(np.int64), classes, tried, depth - node.bit_length() + 1, rng)
            at = np.flatnonzero(below)
            return pa.table([pa.array([tree] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(below[at])], ["tree", "column", "gain"])

        depth = self.depth
        parts = blocks.mapInArrow(sent, "tree int, node bigint, label binary, weight binary, code binary")
        lower = parts.groupBy("tree", "node").applyInArrow(finished, "tree int, column int, gain double")
        for r in lower.groupBy("tree", "column").agg(F.sum("gain").alias("gain")).collect() if any(local) else []:
            gains[r["tree"], r["column"]] += r["gain"]
        return gains / np.maximum(gains.sum(axis=1, keepdims=True), 1e-300)
