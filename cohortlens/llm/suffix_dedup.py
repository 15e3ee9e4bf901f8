"""Suffix-array dedup: remove every byte of a ``LENGTH``-byte string that starts anywhere else too.

The multi-document suffix order is built column by column: each round puts one more symbol in front of every string of a
collection and updates the order (hence the Burrows-Wheeler transform, the symbols in that order) and the array of common
prefixes; a common prefix of ``LENGTH`` is a repeated string. Two things make this a Spark job of bounded rounds:

* Only the first ``LENGTH`` symbols of a suffix matter, and equal strings have equal *anchors*: of its 32-byte pieces the one
  of least hash (the leftmost of equals). So a document is cut into one segment per anchor, reaching as far as a string
  around it can, and strings are compared column against column inside the collection of their anchor: 368 rounds,
  whatever the length of the documents. An anchor that occurs once needs no comparison.
* The collections are dealt to buckets of bounded size; a bucket is one task, its columns are read in sequence. The tables
  between the steps (anchors, segments, spans) are Spark's, so they spill and survive the loss of executors. Segments that
  are equal as a whole are found by a shuffle of their hashes and enter once. An anchor with more than ``GROUP_LIMIT``
  different segments is not put into one task: its strings are themselves shuffled and counted.

Hashes only choose what is compared, except in the equality of whole segments and of the strings of oversized groups.
Those use 64 bits beside the anchor's 64, and 128 bits.

Defined cases: a null text is empty; texts below ``LENGTH`` bytes stay; repeated rows are separate documents, so all of their
strings repeat; null or repeated ids are numbered first (that table is written); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.hashing import chunks, mix, prefix_hash, span_hash
from cohortlens.llm.tables import numbered, text_of, written

LENGTH = 200
PIECE = 32
#: Bytes that a string can reach before its anchor.
REACH = LENGTH - PIECE
WIDTH = REACH + LENGTH
#: A long text is searched in blocks of this many string starts.
BLOCK = 1 << 18
PLACE = np.uint64((1 << 24) - 1)
#: Texts are taken out of a batch this many characters at a time, so that a worker holds few of them as objects.
PORTION = 1 << 20
PAD = 255
BUCKET_SEGMENTS = 12_000
GROUP_LIMIT = 50_000


def _portions(batches) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts are together no longer than ``PORTION``, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_pylist()
        for a, b in chunks([range(n) for n in sizes], PORTION):
            yield batch.slice(a, b - a)


def anchors(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, anchor hash, segment hash) of every anchor, in order, block by block."""
    last = -1
    for at in range(0, len(data) - LENGTH + 1, BLOCK):
        lo = max(0, at - LENGTH)
        part = data[lo : at + BLOCK + 2 * LENGTH]
        prefix = prefix_hash(part)
        first = at - lo
        count = min(BLOCK, len(data) - LENGTH + 1 - at)
        place = np.arange(first, first + count + REACH, dtype=np.int64)
        piece = span_hash(prefix, place, place + PIECE)
        # Least piece of each string: the place in the low bits makes the leftmost of equal hashes the least.
        least = (piece & ~PLACE) | (place - first).astype(np.uint64)
        size, width = 1, REACH + 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        change = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        found = (least[change] & PLACE).astype(np.int64)
        keep = found + at > last
        found = found[keep]
        if len(found):
            last = int(found[-1]) + at
            start = np.maximum(found + first - REACH, 0)
            end = np.minimum(found + first + LENGTH, len(part))
            # The reach to the left tells two anchors of one short text apart, whose segments are both that whole text.
            yield found + at, piece[found], mix(span_hash(prefix, start, end) + (found + first - start).astype(np.uint64))


def _anchor_rows(batches, whole: bool):
    for batch in _portions(batches):
        texts, ids = batch.column("text").to_pylist(), batch.column("rid").to_numpy(zero_copy_only=False)
        out = [], [], [], []
        for rid, text in zip(ids, texts):
            data = np.frombuffer(text.encode(), np.uint8)
            for place, anchor, segment in anchors(data):
                for column, x in zip(out, (anchor, segment, np.full(len(place), rid), place)):
                    column.append(x.astype(np.int64) if x.dtype != np.uint64 else x.view(np.int64))
        if not out[0]:
            continue
        columns = [pa.array(np.concatenate(c)) for c in (out if whole else out[:1])]
        yield pa.record_batch(columns, ["anchor", "segment", "rid", "at"][: len(columns)])


def column_hits(matrix: np.ndarray, length: int = LENGTH, last: int = REACH) -> np.ndarray:
    """For rows of equally long segments: does the string at (row, column <= last) occur in another row there too?

    Rounds go from the last column to the first. ``order`` lists the rows by what follows the column, ``common[i]`` is the
    common prefix of neighbours i-1 and i. A stable sort by the new symbol is the next order; two rows that become
    neighbours share the symbol and the least common prefix between their old ranks. ``PAD`` never matches.
    """
    rows, width = matrix.shape
    hits = np.zeros((rows, last + 1), bool)
    if rows < 2:
        return hits
    columns = np.ascontiguousarray(matrix.T)
    order, common = np.arange(rows), np.zeros(rows, np.uint8)
    levels = rows.bit_length()
    table = np.zeros((levels, rows), np.uint8)
    log = np.zeros(rows + 1, np.int64)
    log[1:] = np.floor(np.log2(np.arange(1, rows + 1)) + 1e-12)
    for column in range(width - 1, -1, -1):
        symbols = columns[column][order]
        rank = np.argsort(symbols, kind="stable")
        table[0] = common
        for k in range(1, levels):
            half = 1 << (k - 1)
            table[k] = table[k - 1]
            np.minimum(table[k - 1][: rows - half], table[k - 1][half:], out=table[k][: rows - half])
        before, after = rank[:-1], rank[1:]
        span = after - before
        same = (span > 0) & (symbols[before] == symbols[after]) & (symbols[after] != PAD)
        k = log[np.where(same, span, 1)]
        least = np.minimum(table[k, np.minimum(before + 1, rows - 1)], table[k, np.maximum(after - (1 << k) + 1, 0)])
        common = np.zeros(rows, np.uint8)
        common[1:] = np.where(same, np.minimum(least, length - 1) + 1, 0)
        order = order[rank]
        if column <= last:
            found = np.flatnonzero(common >= length)
            hits[order[found], column] = True
            hits[order[found - 1], column] = True
    return hits


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _bucket_spans(group: pa.Table) -> pa.Table:
    """(rid, first, end): covered spans of the segments of one bucket."""
    rids, places, texts = (group.column(c).to_pylist() for c in ("rid", "at", "bytes"))
    matrix = np.full((len(rids), WIDTH), PAD, np.uint8)
    for i, (place, b) in enumerate(zip(places, texts)):
        start = REACH - min(place, REACH)
        matrix[i, start : start + len(b)] = np.frombuffer(b, np.uint8)
    hits = column_hits(matrix)
    out = [], [], []
    for i in np.flatnonzero(hits.any(1)):
        first, end = _runs(hits[i])
        base = places[i] - REACH
        out[0].extend([rids[i]] * len(first))
        out[1].extend((first + base).tolist())
        out[2].extend((end - 1 + base + LENGTH).tolist())
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("rid", "first", "end"), out)})


def _cut(batches):
    """One row per wanted segment: rid, at, anchor, big, bytes."""
    for batch in _portions(batches):
        wanted = batch.column("wanted")
        counts, own = wanted.value_lengths().to_numpy(), wanted.flatten()
        at, anchor, big = (own.field(c) for c in ("at", "anchor", "big"))
        places, cut, k = at.to_numpy(), [], 0
        for text, n in zip(batch.column("text").to_pylist(), counts.tolist()):
            data = text.encode()
            cut.extend(data[max(0, a - REACH) : a + LENGTH] for a in places[k : k + n].tolist())
            k += n
        rid = pa.array(np.repeat(batch.column("rid").to_numpy(zero_copy_only=False), counts), pa.int64())
        yield pa.record_batch([rid, at, anchor, big, pa.array(cut, pa.binary())], ["rid", "at", "anchor", "big", "bytes"])


def _strings(batches):
    """The strings of segments of oversized groups, by hash and start."""
    for batch in batches:
        for rid, a, b in zip(*(batch.column(c).to_pylist() for c in ("rid", "at", "bytes"))):
            base = a - min(a, REACH)
            n = max(0, min(len(b) - LENGTH, a - base) + 1)
            keys = [blake2b(b[i : i + LENGTH], digest_size=16).digest() for i in range(n)]
            columns = [pa.array(keys, pa.binary()), pa.array([rid] * n, pa.int64()), pa.array(range(base, base + n), pa.int64())]
            yield pa.record_batch(columns, ["key", "rid", "first"])


def _finish(batches):
    for batch in _portions(batches):
        sizes, spans, kept = [], [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
            data = text.encode()
            merged: list[list[int]] = []
            for s in sorted((x["first"], min(x["end"], len(data))) for x in found or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            cuts = [0, *[p for s in merged for p in s], len(data)]
            kept.append(b"".join(data[cuts[i] : cuts[i + 1]] for i in range(0, len(cuts), 2)))
            sizes.append(len(data))
            spans.append([{"first": a, "end": b} for a, b in merged])
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "spans", "kept"],
        )


def repeated_spans(
    docs: DataFrame, bucket_segments: int = BUCKET_SEGMENTS, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """(rid, first, end): spans of ``docs`` (rid, text) that repeated strings cover.

    They may overlap, and those of whole segments may end behind the text.
    """
    once = docs.select("rid", "text")
    often = once.mapInArrow(lambda b: _anchor_rows(b, False), "anchor bigint")
    often = often.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    rows = once.mapInArrow(lambda b: _anchor_rows(b, True), "anchor bigint, segment bigint, rid bigint, at bigint")
    rows = written(rows.join(often, "anchor", "left_semi"), "suffix-anchors")
    segments = rows.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("holder"))
    groups = segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max("n").alias("most"))
    known = segments.filter("n > 1").join(groups.select("anchor", "kinds"), "anchor")
    known = rows.join(known, ["anchor", "segment"])
    whole = known.select("rid", F.greatest(F.col("at") - REACH, F.lit(0)).alias("first"), (F.col("at") + LENGTH).alias("end"))
    # To be compared: segments that stand alone beside others of their anchor, and one holder of each repeated one.
    single = segments.filter("n = 1").join(groups.filter("kinds > 1").select("anchor", "kinds"), "anchor")
    single = rows.join(single.select("anchor", "segment", "kinds"), ["anchor", "segment"]).select("rid", "at", "anchor", "kinds")
    holder = known.filter("kinds > 1 and rid = holder").select("rid", "at", "anchor", "kinds")
    wanted = single.union(holder).withColumn("big", F.col("kinds") > group_limit)
    wanted = written(wanted.drop("kinds"), "suffix-wanted")
    total = wanted.filter("not big").count()
    by_doc = wanted.groupBy("rid").agg(F.collect_list(F.struct("at", "anchor", "big")).alias("wanted"))
    cut = docs.select("rid", "text").join(by_doc, "rid").mapInArrow(
        _cut, "rid bigint, at bigint, anchor bigint, big boolean, bytes binary"
    )
    cut = written(cut, "suffix-segments")
    buckets = max(1, -(-total // bucket_segments))
    dealt = cut.filter("not big").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).drop("anchor", "big")
    spans = dealt.groupBy("bucket").applyInArrow(_bucket_spans, "rid bigint, first bigint, end bigint")
    strings = cut.filter("big").mapInArrow(_strings, "key binary, rid bigint, first bigint")
    # Overlapping segments of a document hold the same string twice; that is one start.
    start = F.struct("rid", "first")
    twice = strings.groupBy("key").agg(F.min(start).alias("a"), F.max(start).alias("b")).filter("a <> b").select("key")
    direct = strings.join(twice, "key", "left_semi").select("rid", "first", (F.col("first") + LENGTH).alias("end"))
    return whole.union(spans).union(direct)


def suffix_dedup(docs: DataFrame, **limits: int) -> DataFrame:
    """doc_id, n_bytes, spans (removed, maximal, as byte ranges), kept (the other bytes): one row per document."""
    docs = numbered(docs.select("doc_id", text_of(docs).alias("text")))
    spans = repeated_spans(docs, **limits)
    found = spans.groupBy("rid").agg(F.collect_list(F.struct("first", "end")).alias("found"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.join(found, "rid", "left").select("doc_id", "text", "found").mapInArrow(
        _finish, f"doc_id {kind}, n_bytes bigint, spans array<struct<first:bigint,end:bigint>>, kept binary"
    )
