"""Target-distribution importance resampling over hashed word windows.

An untrained ``Split`` pre-tokenizer of the ``tokenizers`` library cuts ASCII-lowered texts into words with offsets. Offset
pairs - start of one word, end of the same or of one of the next two - mark every window of one to three words in the words
joined by single blanks; a window's bucket is the CRC-32 of those bytes. Bucket histograms of the raw documents and of the target
texts give each bucket a gain, the log ratio of its smoothed shares; a document's weight is the sum of its windows' gains, and
documents are drawn without replacement by weight plus Gumbel noise that is hashed from the id.

Distribution: one pass over the texts writes each document's buckets, sorted and packed as compressed differences (about a
quarter of the text's size); histograms are added up inside tasks and then by bucket (at most ``BUCKETS`` rows reach the driver and go
back as one array); weights are sums over the packed buckets. Ranks come from range-partitioned chunks whose row counts are
summed, never from one window over all rows.

Defined cases: a null or empty text has no words, no features and weight 0; repeated rows are weighed and drawn each (ties go to
the smaller doc_id, a null one first, then by row); a null doc_id is hashed as an empty string; without target texts or without
documents the histograms are empty, which smoothing allows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cohortlens.llm.tables import ascii_lower, numbered, text_of, written

#: What a word is, the longest window, the number of buckets, gain units per natural log, seed and share drawn.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 3
BUCKETS = 10_000
UNIT = 1000
SEED = 42
PERCENT = 5
LEAST_WORDS = 20
#: Rows of one chunk of the ranking, about, and the number of chunks from which on they grow instead.
CHUNK_ROWS, CHUNKS = 20_000, 4096


def word_splitter():
    """The untrained pre-tokenizer: words of a text, each with its offsets."""
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), "removed", invert=True)


def feature_buckets(words: list[tuple[str, tuple[int, int]]]) -> np.ndarray:
    """Buckets of all windows of one to three words, in no particular order."""
    raw = [w.encode() for w, _ in words]
    line = memoryview(b" ".join(raw))
    end = np.cumsum([len(w) + 1 for w in raw]) - 1
    start = np.concatenate(([0], end[:-1] + 1)) if raw else end
    starts, ends = start.tolist(), end.astype(int).tolist()
    crc = zlib.crc32
    found = [crc(line[a:b]) for k in range(WINDOW) for a, b in zip(starts, ends[k:])]
    return (np.array(found, np.uint32) % BUCKETS).astype(np.uint16)


def packed(buckets: np.ndarray) -> bytes:
    """Sorted buckets as compressed differences."""
    return zlib.compress(np.diff(np.sort(buckets), prepend=np.uint16(0)).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint16), dtype=np.int64)


def _features(batches):
    splitter = word_splitter()
    for batch in batches:
        columns = [], [], []
        for text in batch.column("text").to_pylist():
            words = splitter.pre_tokenize_str(text)
            found = feature_buckets(words)
            for column, value in zip(columns, (len(words), len(found), packed(found))):
                column.append(value)
        own = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))]
        yield pa.record_batch([batch.column("rid"), batch.column("doc_id"), *own], ["rid", "doc_id", "n_words", "n_features", "buckets"])


def _histogram(batches):
    """(bucket, n): one row per bucket that occurs in this task."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for data in batch.column("buckets").to_pylist():
            total += np.bincount(unpacked(data), minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used), pa.array(total[used])], ["bucket", "n"])


def features(docs: DataFrame) -> DataFrame:
    """rid, doc_id, n_words, n_features, buckets of every row of (rid, doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("rid", "doc_id", ascii_lower(text_of(docs)).alias("text"))
    return rows.mapInArrow(_features, f"rid bigint, doc_id {kind}, n_words bigint, n_features bigint, buckets binary")


def histogram(found: DataFrame) -> np.ndarray:
    """Features by bucket."""
    sums = found.select("buckets").mapInArrow(_histogram, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    rows = sums.toArrow()  # at most BUCKETS rows
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of every bucket: log ratio of the smoothed shares, in thousandths, rounded down."""
    s, t = float(raw.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    ratio = [(b + 1.0) * s / ((a + 1.0) * t) for a, b in zip(raw.tolist(), target.tolist())]
    return np.array([math.floor(UNIT * math.log(x)) for x in ratio], np.int64)


def _weights(batches, gain: np.ndarray):
    for batch in batches:
        weight = [int(gain[unpacked(x)].sum()) for x in batch.column("buckets").to_pylist()]
        keys = ["rid", "doc_id", "n_words", "n_features"]
        yield pa.record_batch([*[batch.column(k) for k in keys], pa.array(weight, pa.int64())], [*keys, "weight"])


def _ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """rid and rank of the ``drawn`` rows of highest score, ties to the smaller doc_id.

    Chunks follow the order and hold about equally many rows. They are read back, so that their counts and their rows agree.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col("rid").asc()]
    parts = min(CHUNKS, max(1, -(-rows.count() // CHUNK_ROWS)))
    rows = rows.repartitionByRange(parts, *order).withColumn("chunk", F.spark_partition_id())
    rows = written(rows, "importance-order")
    counts = sorted((r["chunk"], r["n"]) for r in rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for chunk, n in counts:
        if before < drawn:  # later chunks have no drawn row
            offsets.append((chunk, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(offsets, "chunk int, offset bigint")
    inside = F.row_number().over(W.partitionBy("chunk").orderBy(*order)).cast("bigint")
    placed = rows.join(F.broadcast(offsets), "chunk").withColumn("rank", inside + F.col("offset"))
    return placed.filter(F.col("rank") <= drawn).select("rid", "rank")


def importance_sample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (null where not drawn) of every document.

    ``percent`` of the documents with ``least_words`` words are drawn towards the distribution of the ``target`` texts.
    """
    docs = numbered(docs.select("doc_id", "text"))
    found = written(features(docs), "importance-features")
    wanted = features(target.select(F.lit(0).cast("bigint").alias("rid"), F.lit(0).alias("doc_id"), "text"))
    gain = gains(histogram(found), histogram(wanted))
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = f"rid bigint, doc_id {kind}, n_words bigint, n_features bigint, weight bigint"
    weighed = found.mapInArrow(lambda b: _weights(b, gain), kinds)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-UNIT * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weighed = written(weighed.withColumn("score", F.col("weight") + noise), "importance-weights")
    able = weighed.filter(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    if drawn == 0:
        return weighed.drop("rid").withColumn("rank", F.lit(None).cast("bigint"))
    return weighed.join(_ranked(able.select("rid", "doc_id", "score"), drawn), "rid", "left").drop("rid")
