"""Vectorised hashes of bytes, words and word windows for functions that run inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
BASE, BACK = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: White space that separates words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Texts are hashed together up to this many bytes, so that a task holds a few arrays of that length.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit word."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


VALUE = mix(np.arange(1, 257, dtype=U))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n."""
    if len(_POWERS["up"]) <= n:
        for name, base in (("up", BASE), ("down", BACK)):
            steps = np.full(max(n + 1, 1 << 16), base)
            steps[0] = U(1)
            _POWERS[name] = np.cumprod(steps, dtype=U)
    return _POWERS["up"][: n + 1], _POWERS["down"][: n + 1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; ``span_hash`` reads any span from it."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U)
    np.cumsum(VALUE[data] * up[: len(data)], out=out[1:], dtype=U)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes in each [start, end)."""
    _, down = powers(len(prefix) - 1)
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U))


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together stay below the limit; a longer text is alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the texts' bounds in them (one more than there are texts)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    blank = SPACE[data]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    first = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return span_hash(prefix_hash(data), start, end), np.searchsorted(start, first)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words (none if there are fewer)."""
    if len(words) < size:
        return np.zeros(0, U)
    total = np.zeros(len(words) - size + 1, U)
    for k in range(size):
        total = total * BASE + words[k : len(words) - size + 1 + k]
    return mix(total)


def shingle_sets(texts: list[bytes], size: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct word windows of each text; a shorter text is one window as a whole, an empty one has none."""
    for a, b in chunks(texts):
        words, bounds = word_hashes(texts[a:b])
        for i in range(b - a):
            own = words[bounds[i] : bounds[i + 1]]
            if len(own) >= size:
                yield np.unique(windows(own, size))
            elif len(own):
                yield mix(windows(own, len(own)) + U(len(own)))
            else:
                yield np.zeros(0, U)
