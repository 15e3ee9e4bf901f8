"""Small volumes and brute-force counterparts."""

from __future__ import annotations

from collections import Counter

import numpy as np

AROUND = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]
FORWARD = [d for d in AROUND if d > (0, 0, 0)]


def volume(seed: int, shape=(5, 4, 6), levels: int = 3, fill: float = 0.7):
    rng = np.random.default_rng(seed)
    return rng.integers(1, levels + 1, shape), rng.random(shape) < fill


def level_frame(spark, cases: dict[str, tuple[np.ndarray, np.ndarray]]):
    rows = [
        (case, "A", *map(int, at), int(v) if mask[at] else None)
        for case, (grid, mask) in cases.items()
        for at, v in np.ndenumerate(grid)
    ]
    return spark.createDataFrame(rows, "case_id string, modality string, z int, y int, x int, level int")


def voxel_frame(spark, cases: dict[str, tuple[np.ndarray, np.ndarray]]):
    rows = [
        (case, "A", *map(int, at), float(v), int(mask[at]))
        for case, (grid, mask) in cases.items()
        for at, v in np.ndenumerate(grid)
    ]
    return spark.createDataFrame(rows, "case_id string, modality string, z int, y int, x int, value double, mask int")


def volume_frame(spark, cases, spacing=(2.0, 0.5, 0.75)):
    rows = [(case, "A", *map(float, spacing)) for case in cases]
    return spark.createDataFrame(
        rows, "case_id string, modality string, spacing_z double, spacing_y double, spacing_x double"
    )


def at_or_none(grid, mask, at):
    ok = all(0 <= p < n for p, n in zip(at, grid.shape)) and mask[at]
    return int(grid[at]) if ok else None


def brute_glcm(grid, mask):
    out = Counter()
    for at in map(tuple, np.argwhere(mask)):
        for d, step in enumerate(FORWARD):
            other = at_or_none(grid, mask, tuple(np.add(at, step)))
            if other is not None:
                out[d, int(grid[at]), other] += 1
                out[d, other, int(grid[at])] += 1
    return dict(out)


def brute_runs(grid, mask):
    out = Counter()
    for at in map(tuple, np.argwhere(mask)):
        for d, step in enumerate(FORWARD):
            if at_or_none(grid, mask, tuple(np.subtract(at, step))) == grid[at]:
                continue
            length, here = 1, at
            while at_or_none(grid, mask, tuple(np.add(here, step))) == grid[at]:
                here = tuple(np.add(here, step))
                length += 1
            out[d, int(grid[at]), length] += 1
    return dict(out)


def brute_zones(grid, mask):
    left = set(map(tuple, np.argwhere(mask)))
    out = Counter()
    while left:
        first = left.pop()
        stack, size = [first], 1
        while stack:
            here = stack.pop()
            for step in AROUND:
                near = tuple(np.add(here, step))
                if near in left and grid[near] == grid[first]:
                    left.remove(near)
                    stack.append(near)
                    size += 1
        out[int(grid[first]), size] += 1
    return dict(out)


def feature_rows(spark, x: np.ndarray, y: np.ndarray):
    rows = [
        (f"c{i:03d}", int(y[i]), f"f{j:02d}", j, float(x[i, j])) for i in range(len(x)) for j in range(x.shape[1])
    ]
    return spark.createDataFrame(rows, "case_id string, label int, feature string, ord int, value double")


def separable(seed: int = 0, n: int = 80, p: int = 4):
    """First column separates the classes, the rest is noise."""
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    x = rng.normal(size=(n, p))
    x[:, 0] += 3 * y
    return x, y
