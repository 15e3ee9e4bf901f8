"""Column conventions of the long tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE_KEYS = ("case_id", "modality", "filter")
COORDS = ("z", "y", "x")


def image_keys(df: DataFrame) -> list[str]:
    """Columns that name one image: case, modality and, for derived images, the filter."""
    return [c for c in IMAGE_KEYS if c in df.columns]


def hash_order(key: str, seed: int, *salt: str | Column) -> Column:
    """Reproducible pseudo-random order of rows: md5 of ``key|seed`` (equal in any SQL engine)."""
    parts = [F.col(key).cast("string"), F.lit(str(seed)), *salt]
    return F.md5(F.concat_ws("|", *parts))


def hash_chunk(hashed: Column, digits: int = 3) -> Column:
    """Leading hex digits of a hash: evenly filled chunks that follow the hash order."""
    return F.conv(F.substring(hashed, 1, digits), 16, 10).cast("int")


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit words with every bit spread over all."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def shuffled(i: np.ndarray, n: int, *key: int) -> np.ndarray:
    """Where each number goes in a permutation of 0 to n - 1 that ``key`` draws; any part of it can be had alone.

    A Feistel network permutes the next power of four; what falls outside is sent on until it is inside.
    """
    half = max(1, -(-(n - 1).bit_length() // 2))
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    rounds = np.random.SeedSequence(key).generate_state(8, np.uint64)
    out = np.asarray(i).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in rounds:
            left, right = right, left ^ (_mixed(right ^ k) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def k_from(p: int, n_feature: int | None = None, p_feature: float | None = None) -> int:
    """Number of features to keep: a count, else a share of ``p``, else half of it."""
    if n_feature is not None:
        return n_feature
    return int(p_feature * p) if p_feature is not None else p // 2
