"""Benchmark decontamination: greedy string tiling of documents against test items.

Both sides are word sequences (ASCII letters lower-cased; letters, digits and non-ASCII characters make words). A *seed* is a
run of ``MIN_MATCH`` words, or a whole item that is shorter. Documents and items that share enough seeds are tiled: of all
common runs the longest whose words are still unmarked on both sides is marked, again and again, down to ``MIN_MATCH``; runs
are found by running Karp-Rabin hashes and extended word by word. The share of an item's words under tiles is its coverage;
it does not depend on the order of the passages, so a shuffled item is still found.

Distribution: each task drops windows that no item has by a bit table of fixed size (``FILTER_BITS``; only bit numbers are
collected, so its size does not grow with the benchmark - a larger benchmark passes more windows on to the join, which is
exact). What is left of a document - its words inside such windows, with their places - is joined on seeds by shuffle, then
once per candidate pair. Whole texts are never moved.

Defined cases: null or empty texts and items have no words and match nothing; repeated documents are reported each; repeated
items (same item_id and text) count once; words are compared by 64-bit hashes.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.hashing import chunks, mix, windows, word_hashes
from cohortlens.llm.license_scan import WORD_BYTES
from cohortlens.llm.tables import numbered, text_of, written

MIN_MATCH = 5
#: Least share of an item's words that tiles must cover.
THRESHOLD = 0.6
FILTER_BITS = 1 << 23


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([t.encode().lower().translate(WORD_BYTES) for t in texts])


def seeds(words: np.ndarray, size: int) -> np.ndarray:
    """Running hash of each window of ``size`` words."""
    return mix(windows(words, size) + np.uint64(size))


def _item_seeds(batches):
    for batch in batches:
        texts, ids = batch.column("text").to_pylist(), batch.column("item_id").to_pylist()
        words, bounds = _words(texts)
        rows: list[tuple] = []
        for i, item in enumerate(ids):
            own = words[bounds[i] : bounds[i + 1]]
            if len(own):
                size = min(MIN_MATCH, len(own))
                rows.append((item, size, own.view(np.int64), seeds(own, size).view(np.int64)))
        ids, sizes, own, found = zip(*rows) if rows else ((), (), (), ())
        longs = pa.list_(pa.int64())
        yield pa.record_batch(
            [pa.array(ids, batch.schema.field("item_id").type), pa.array(sizes, pa.int32()), pa.array(own, longs), pa.array(found, longs)],
            ["item_id", "size", "words", "seeds"],
        )


def _document_seeds(batches, filters: dict[int, np.ndarray]):
    """rid, places and hashes of the words inside passing windows, and the distinct passing seeds."""
    filters = {size: np.unpackbits(bits, bitorder="little").view(bool) for size, bits in filters.items()}
    mask = np.uint64(FILTER_BITS - 1)
    for batch in batches:
        texts, rids = batch.column("text").to_pylist(), batch.column("rid").to_pylist()
        out: tuple[list, ...] = ([], [], [], [])
        for a, b in chunks([t.encode() for t in texts]):
            words, bounds = _words(texts[a:b])
            for i in range(b - a):
                own = words[bounds[i] : bounds[i + 1]]
                inside, found = np.zeros(len(own) + 1, np.int64), []
                for size, bits in filters.items():
                    s = seeds(own, size)
                    at = np.flatnonzero(bits[(s & mask).astype(np.int64)])
                    found.append(s[at])
                    np.add.at(inside, at, 1)
                    np.add.at(inside, at + size, -1)
                place = np.flatnonzero(np.cumsum(inside)[:-1])
                if len(place):
                    for column, x in zip(out, (rids[a + i], place, own[place], np.unique(np.concatenate(found)))):
                        column.append(x.astype(np.int64) if isinstance(x, np.ndarray) else x)
        longs = pa.list_(pa.int64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(out, (pa.int64(), longs, longs, longs))], ["rid", "at", "words", "seeds"])


def tiles(document: np.ndarray, at: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place in the document, place in the item, length) of greedy string tiles of at least ``least`` words.

    ``at`` are the places of the document's words; words whose places do not follow each other are apart. A run that
    overlaps a marked tile is cut to its unmarked parts, which go back to the queue.
    """
    if len(item) < least or len(document) < least:
        return []
    by_seed: dict[int, list[int]] = {}
    for j, h in enumerate(windows(item, least).tolist()):
        by_seed.setdefault(h, []).append(j)
    whole = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] == least - 1)
    hashes = windows(document, least)[whole].tolist()
    doc, other, places = document.tolist(), item.tolist(), at.tolist()
    queue: list[tuple[int, int, int]] = []
    for i, h in zip(whole.tolist(), hashes):
        for j in by_seed.get(h, ()):
            if i and j and doc[i - 1] == other[j - 1] and places[i - 1] == places[i] - 1:
                continue  # a longer run starts earlier
            n = 0
            while (
                i + n < len(doc) and j + n < len(other) and doc[i + n] == other[j + n] and places[i + n] == places[i] + n
            ):
                n += 1
            if n >= least:
                queue.append((-n, i, j))
    heapq.heapify(queue)
    doc_marked, item_marked = bytearray(len(doc)), bytearray(len(other))
    out = []
    while queue:
        n, i, j = heapq.heappop(queue)
        n = -n
        taken = [k for k in range(n) if doc_marked[i + k] or item_marked[j + k]]
        if not taken:
            doc_marked[i : i + n] = item_marked[j : j + n] = b"\1" * n
            out.append((places[i], j, n))
            continue
        start = 0
        for k in [*taken, n]:
            if k - start >= least:
                heapq.heappush(queue, (start - k, i + start, j + start))
            start = k + 1
    return out


def _tile(batches):
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("at", "words", "item_words", "size")]
        out: tuple[list, ...] = ([], [], [], [])
        for at, words, item, size in zip(*columns):
            item = np.array(item, np.int64).view(np.uint64)
            found = tiles(np.array(words, np.int64).view(np.uint64), np.array(at), item, size)
            for column, x in zip(out, (len(found), sum(t[2] for t in found), len(item), max((t[2] for t in found), default=0))):
                column.append(x)
        yield pa.record_batch(
            [batch.column("rid"), batch.column("item_id"), *[pa.array(c, pa.int64()) for c in out]],
            ["rid", "item_id", "n_tiles", "covered", "item_words", "longest"],
        )


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_tiles, covered, item_words, longest, coverage of pairs with coverage of at least ``threshold``."""
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    items = benchmark.select("item_id", text_of(benchmark).alias("text")).distinct()
    items = items.mapInArrow(_item_seeds, f"item_id {item_kind}, size int, words array<bigint>, seeds array<bigint>")
    items = written(items, "items").withColumn("item", F.xxhash64("item_id", "words"))
    posted = items.select("item", "size", F.explode("seeds").alias("seed"))
    bits = posted.select("size", F.expr(f"seed & {FILTER_BITS - 1}").alias("bit")).distinct()
    filters: dict[int, np.ndarray] = {}
    for r in bits.collect():  # at most FILTER_BITS rows for each of MIN_MATCH sizes
        # Packed, eight bits to a byte: the driver keeps and ships them with every task.
        filters.setdefault(r["size"], np.zeros(FILTER_BITS >> 3, np.uint8))[r["bit"] >> 3] |= 1 << (r["bit"] & 7)
    docs = numbered(docs.select("doc_id", text_of(docs).alias("text")))
    found = docs.select("rid", "text").mapInArrow(
        lambda b: _document_seeds(b, filters), "rid bigint, at array<bigint>, words array<bigint>, seeds array<bigint>"
    )
    found = written(found, "document-seeds")
    # An item seed that stands twice in the item counts twice; tiles of n words hold n - size + 1 seeds.
    weights = posted.groupBy("item", "size", "seed").agg(F.count(F.lit(1)).alias("times"))
    hits = found.select("rid", F.explode("seeds").alias("seed")).join(weights, "seed")
    pairs = hits.groupBy("rid", "item").agg(F.sum(F.col("times") * F.col("size")).alias("most"))
    pairs = pairs.join(items.select("item", F.size("words").alias("n")), "item").filter(F.col("most") >= threshold * F.col("n"))
    pairs = pairs.select("rid", "item")
    sides = pairs.join(found.select("rid", "at", "words"), "rid").join(
        items.select("item", "item_id", F.col("words").alias("item_words"), "size"), "item"
    )
    tiled = sides.select("rid", "item_id", "at", "words", "item_words", "size").mapInArrow(
        _tile, f"rid bigint, item_id {item_kind}, n_tiles bigint, covered bigint, item_words bigint, longest bigint"
    )
    tiled = tiled.withColumn("coverage", F.col("covered") / F.col("item_words")).filter(F.col("coverage") >= threshold)
    return docs.select("rid", "doc_id").join(tiled, "rid").drop("rid")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that cover no item; columns as they came."""
    bad = contaminated(docs, benchmark, threshold).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")
