"""LM scoring: context-tree weighting over bytes, beside an add-one unigram baseline over words.

A byte is eight binary decisions; each of the 255 decision nodes has a context tree over the preceding bytes, most recent
first, ``DEPTH`` deep. A tree node counts zeros and ones of the training texts; its Krichevsky-Trofimov estimate and the
product of its children are mixed half and half, from the deepest contexts up, so every depth has a weight that the
training data choose. The probability of a decision is the mixture of the estimates along its context, with these weights.
A text ends with an end symbol, and stands behind ``DEPTH`` of them. Texts are lower-cased (A-Z) first.

Distribution: tasks count byte windows (context and symbol) of their texts; the counts are summed by a shuffle. Windows are
dealt to buckets by their two most recent bytes: a bucket holds whole subtrees from depth two on. Depths zero and one have at
most 256 * 255 nodes, are summed from the buckets and shipped as constants. The result is one value per window that occurs
anywhere. To score, the windows and words above a frequency threshold, at most ``HOT_WINDOWS`` and ``HOT_WORDS``, are broadcast; all the
others of a document are joined by shuffle, so the model has no size limit.

Words are told apart by 64-bit hashes. Defined cases: a null text is empty (one token, the end); a null id counts as the
empty string in the fold rule; repeated rows are rows of their own; an empty table gives an empty result; without training
documents all counts are zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log10, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.hashing import chunks, word_hashes
from cohortlens.llm.tables import numbered, text_of, written

DEPTH = 5
END = 255
#: Most entries of the two broadcast tables: 16 bytes each.
HOT_WINDOWS, HOT_WORDS = 1 << 20, 1 << 19
BUCKET_WINDOWS = 200_000
FOLDS, HELD_FOLD = 7, 2
#: Key of the end token among word hashes.
END_WORD = np.uint64(0)
CHUNK = 1 << 20
#: Keys of new chunks that are kept before they are merged into the running counts.
MERGE_KEYS = 600_000


def window_codes(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(code, text number) of every symbol with its context, most recent byte first, symbol last."""
    pad = bytes([END])
    data = np.frombuffer(b"".join(pad * depth + t + pad for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    total = sizes + depth
    start = np.cumsum(total) - total
    of = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(of)) + np.repeat(start + depth - (np.cumsum(sizes) - sizes), sizes)
    code = np.zeros(len(data), np.uint64)
    wide = data.astype(np.uint64)
    for back in range(1, depth + 1):
        code[back:] |= wide[: len(data) - back] << np.uint64(8 * (depth - back + 1))
    return (code | wide)[at], of


def _sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t.encode().lower() for t in batch.column("text").to_pylist()]


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word, and of the end of every text."""
    words, bounds = word_hashes(texts)
    own = np.arange(len(texts))
    return np.append(words, np.full(len(texts), END_WORD)), np.append(np.repeat(own, np.diff(bounds)), own)


def _count(batches):
    """Counts per batch: kind 0 windows, kind 1 words; training occurrences and all occurrences.

    Chunks are merged into running counts, so a task holds the distinct keys of a batch and the arrays of one chunk.
    """
    for batch in batches:
        held = np.array(batch.column("held_out").to_pylist(), bool)
        texts = _texts(batch)
        running = {kind: [(np.zeros(0, np.uint64), np.zeros((0, 2), np.int64))] for kind in (0, 1)}
        for a, b in chunks(texts, CHUNK):
            train = ~held[a:b]
            for kind, read in ((0, window_codes), (1, _tokens)):
                keys, owner = read(texts[a:b])
                parts = running[kind]
                for flag in (True, False):
                    unique, n = np.unique(keys[train[owner] == flag], return_counts=True)
                    parts.append((unique, np.stack([n * flag, n], 1)))
                if sum(len(p[0]) for p in parts[1:]) > max(MERGE_KEYS, len(parts[0][0])):
                    running[kind] = [_sum_by_key(*(np.concatenate(x) for x in zip(*parts)))]
        for kind, parts in running.items():
            keys, n = _sum_by_key(*(np.concatenate(x) for x in zip(*parts)))
            columns = [pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.view(np.int64)), pa.array(n[:, 0]), pa.array(n[:, 1])]
            yield pa.record_batch(columns, ["kind", "key", "train", "total"])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight steps up."""
    low = np.zeros_like(x)
    for k in range(8):
        low += np.log(x + k)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * pi) + series - low


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(pi)


def weigh(zeros: np.ndarray, ones: np.ndarray, children: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(log weighted probability, weight of the node's own estimate); children: sum of theirs, None at full depth."""
    own = log_kt(zeros, ones)
    if children is None:
        return own, np.ones_like(own)
    half = np.log(0.5)
    mixed = np.logaddexp(half + own, half + children)
    return mixed, np.exp(half + own - mixed)


def _levels(keys: np.ndarray, train: np.ndarray, bit: int, depth: int, top: int) -> Iterator[tuple]:
    """From full depth up to ``top``: (node key, node of each window, zeros, ones, log weighted, own weight)."""
    symbol = keys & np.uint64(255)
    decision = np.uint64(1 << bit) | symbol >> np.uint64(8 - bit)
    one = (symbol >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
    below = None
    for d in range(depth, top - 1, -1):
        context = keys >> np.uint64(8 * (depth + 1 - d))
        node, first, of = np.unique(context << np.uint64(8) | decision, return_index=True, return_inverse=True)
        ones = np.bincount(of, train * one, len(node))
        zeros = np.bincount(of, train * ~one, len(node))
        children = None if below is None else np.bincount(of[below[0]], below[1], len(node))
        mixed, weight = weigh(zeros, ones, children)
        below = first, mixed
        yield node, of, zeros, ones, mixed, weight


def _subtree_roots(group: pa.Table) -> pa.Table:
    """Depth-two nodes of a bucket, summed to their parents: last byte, decision, zeros, ones, log weighted."""
    keys, train = (group.column(c).to_numpy() for c in ("key", "train"))
    out = []
    for bit in range(8):
        *_, (node, _, zeros, ones, mixed, _) = _levels(keys.view(np.uint64), train.astype(float), bit, DEPTH, 2)
        out.append(((node >> np.uint64(16) & np.uint64(255)), node & np.uint64(255), zeros, ones, mixed))
    byte, decision, zeros, ones, mixed = (np.concatenate(x) for x in zip(*out))
    return pa.table(
        {"byte": byte.astype(np.int32), "decision": decision.astype(np.int32), "zeros": zeros, "ones": ones, "mixed": mixed}
    )


def _values(group: pa.Table, top: dict[str, np.ndarray]) -> pa.Table:
    """(key, value): log10 probability of each window's symbol in its context."""
    keys, train = (group.column(c).to_numpy() for c in ("key", "train"))
    code, last = keys.view(np.uint64), (keys.view(np.uint64) >> np.uint64(8 * DEPTH)).astype(np.int64)
    total = np.zeros(len(keys))
    for bit in range(8):
        symbol = (code & np.uint64(255)).astype(np.int64)
        one = (symbol >> (7 - bit) & 1).astype(bool)
        decision = 1 << bit | symbol >> (8 - bit)
        chance = None
        for _, of, zeros, ones, _, weight in _levels(code, train.astype(float), bit, DEPTH, 2):
            own = (np.where(one, ones[of], zeros[of]) + 0.5) / (zeros + ones + 1.0)[of]
            chance = own if chance is None else weight[of] * own + (1 - weight[of]) * chance
        for ones, zeros, weight in (
            (top["ones1"][last, decision], top["zeros1"][last, decision], top["weight1"][last, decision]),
            (top["ones0"][decision], top["zeros0"][decision], top["weight0"][decision]),
        ):
            own = (np.where(one, ones, zeros) + 0.5) / (zeros + ones + 1.0)
            chance = weight * own + (1 - weight) * chance
        total += np.log10(chance)
    return pa.table({"key": keys, "value": total, "total": group.column("total").to_numpy()})


def _top(rows: list) -> dict[str, np.ndarray]:
    """Nodes of depths one and zero from the sums of their children."""
    zeros, ones, below = (np.zeros((256, 256)) for _ in range(3))
    for r in rows:
        at = r["byte"], r["decision"]
        zeros[at], ones[at], below[at] = r["zeros"], r["ones"], r["mixed"]
    mixed, weight = weigh(zeros, ones, below)
    seen = zeros + ones > 0
    zeros0, ones0 = zeros.sum(0), ones.sum(0)
    _, weight0 = weigh(zeros0, ones0, np.where(seen, mixed, 0.0).sum(0))
    return {"zeros1": zeros, "ones1": ones, "weight1": weight, "zeros0": zeros0, "ones0": ones0, "weight0": weight0}


def _hot(table: DataFrame, by: str, limit: int) -> int:
    """Least count such that at most ``limit`` rows reach it; counts are looked at in two binary digits."""
    count = F.greatest(F.col(by), F.lit(1))
    low = F.greatest(F.floor(F.log2(count)) - 1, F.lit(0)).cast("int")
    head = F.call_function("shiftleft", F.call_function("shiftright", count, low), low)
    bins = table.groupBy(head.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total, least = 0, 1 << 62
    for r in sorted(bins.collect(), key=lambda r: -r["b"]):  # two rows per power of two
        total += r["n"]
        if total > limit:
            return least
        least = r["b"]
    return 0


def _arrays(frame: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    data = frame.toArrow()
    return data.column(0).to_numpy().view(np.uint64), data.column(1).to_numpy()


class Lookup:
    """Values by 64-bit key. Level after level, each half as large, a key takes the slot of its hash if it is the first to
    ask; the few that find no slot at all are searched in order. Looking up is a few array reads per key."""

    LEVELS = 8

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.levels = []
        bits = max(4, int(len(keys) - 1).bit_length() + 1) if len(keys) else 4
        for level in range(self.LEVELS):
            shift = np.uint64(64 - max(4, bits - level))
            slot = self._slot(keys, level, shift)
            taken, first = np.unique(slot, return_index=True)
            own, value = np.zeros(1 << int(64 - shift), np.uint64), np.full(1 << int(64 - shift), np.nan)
            own[taken], value[taken] = keys[first], values[first]
            self.levels.append((shift, own, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    @staticmethod
    def _slot(keys: np.ndarray, level: int, shift: np.uint64) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * level & (1 << 64) - 1)
        return ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, NaN where there is none."""
        out = np.full(len(keys), np.nan)
        at = np.arange(len(keys))
        for level, (shift, own, value) in enumerate(self.levels):
            slot = self._slot(keys, level, shift)
            hit = (own[slot] == keys) & ~np.isnan(value[slot])
            out[at[hit]] = value[slot[hit]]
            keys, at = keys[~hit], at[~hit]
        if len(self.keys) and len(keys):
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[place] == keys
            out[at[hit]] = self.values[place[hit]]
        return out


def _lookup(broadcast) -> Lookup:
    """The broadcast table of this worker, built once."""
    if _TABLES.get(broadcast.id) is None:
        _TABLES[broadcast.id] = Lookup(*broadcast.value)
    return _TABLES[broadcast.id]


class _Broadcast:
    """A broadcast and the name of its table in a worker."""

    def __init__(self, spark, table: tuple[np.ndarray, np.ndarray]) -> None:
        import uuid

        self.id, self.held = uuid.uuid4().hex, spark.sparkContext.broadcast(table)

    @property
    def value(self):
        return self.held.value


_TABLES: dict[str, Lookup] = {}


def _late(keys: np.ndarray, owner: np.ndarray, texts: int) -> list[pa.Array]:
    """Keys to join and how often they stand, as one list per text."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(keys)))
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner[first], minlength=texts)))).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (keys[first].view(np.int64), times.astype(np.int64))]


def _score(batches, windows, words):
    """Per document: sums over broadcast entries, and the keys that are left to join."""
    names = ["n_tokens", "windows", "known", "words", "late_windows", "window_times", "late_words", "word_times"]
    for batch in batches:
        texts = _texts(batch)
        for a, b in chunks(texts, CHUNK):
            sums, late = [], []
            for read, table in ((window_codes, _lookup(windows)), (_tokens, _lookup(words))):
                keys, owner = read(texts[a:b])
                value = table(keys)
                miss = np.isnan(value)
                sums.append(np.bincount(owner, np.where(miss, 0.0, value), b - a))
                late += _late(keys[miss], owner[miss], b - a)
            # The last pass of the loop was over words: what they share with the table is known.
            known = np.bincount(owner, ~miss, b - a).astype(np.int64)
            count = np.bincount(owner, minlength=b - a)
            columns = [pa.array(x) for x in (count, sums[0], known, sums[1])] + late
            yield pa.record_batch(
                [batch.column(c).slice(a, b - a) for c in ("rid", "doc_id", "held_out")] + columns,
                ["rid", "doc_id", "held_out", *names],
            )


def context_tree_scores(docs: DataFrame, hot: tuple[int, int] = (HOT_WINDOWS, HOT_WORDS), bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every document."""
    spark = docs.sparkSession
    docs = numbered(docs.select("doc_id", text_of(docs).alias("text")))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS
    docs = docs.withColumn("held_out", fold == HELD_FOLD)
    counts = docs.select("text", "held_out").mapInArrow(_count, "kind byte, key bigint, train bigint, total bigint")
    counts = counts.groupBy("kind", "key").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))
    counts = written(counts, "tree-counts")
    grams = counts.filter("kind = 0").select("key", "train", "total")
    words = counts.filter("kind = 1 and train > 0").select("key", "train")
    sums = words.agg(F.sum("train").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = sums["n"] or 0, sums["v"]
    buckets = max(1, -(-grams.count() // bucket_windows))
    head = F.shiftrightunsigned("key", 8 * (DEPTH - 1))
    dealt = grams.withColumn("bucket", F.pmod(F.xxhash64(head), F.lit(buckets)))
    roots = dealt.groupBy("bucket").applyInArrow(_subtree_roots, "byte int, decision int, zeros double, ones double, mixed double")
    roots = roots.groupBy("byte", "decision").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "mixed")])
    top = _top(roots.toArrow().to_pylist())  # at most 256 * 255 rows
    values = dealt.groupBy("bucket").applyInArrow(lambda g: _values(g, top), "key bigint, value double, total bigint")
    values = written(values, "tree-values")
    logs = words.select("key", F.log10(F.col("train") + 1.0).alias("value"), "train")
    least_window, least_word = _hot(values, "total", hot[0]), _hot(logs, "train", hot[1])
    window_table = _Broadcast(spark, _arrays(values.filter(F.col("total") >= least_window).select("key", "value")))
    word_table = _Broadcast(spark, _arrays(logs.filter(F.col("train") >= least_word).select("key", "value")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("rid", "doc_id", "held_out", "text").mapInArrow(
        lambda b: _score(b, window_table, word_table),
        f"rid bigint, doc_id {kind}, held_out boolean, n_tokens bigint, windows double, known bigint, words double,"
        " late_windows array<bigint>, window_times array<bigint>, late_words array<bigint>, word_times array<bigint>",
    )
    scored = written(scored, "tree-scores")

    def joined(keys: str, times: str, model: DataFrame) -> DataFrame:
        rows = scored.select("rid", F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(times).alias("times"))).alias("r"))
        rows = rows.select("rid", "r.key", "r.times").join(model, "key")
        total = F.sum(F.col("times") * F.col("value")).alias(f"{keys}_sum")
        return rows.groupBy("rid").agg(total, F.sum("times").alias(f"{keys}_known"))

    out = scored.select("rid", "doc_id", "held_out", "n_tokens", "windows", "known", "words")
    rare = values.filter(F.col("total") < least_window).select("key", "value")
    out = out.join(joined("late_windows", "window_times", rare), "rid", "left")
    rare = logs.filter(F.col("train") < least_word).select("key", "value")
    out = out.join(joined("late_words", "word_times", rare), "rid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + zero("late_words_known")).cast("bigint").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("words") + zero("late_words_sum") - F.col("n_tokens") * log10(n + v + 1)).alias("base_score"),
        (F.col("windows") + zero("late_windows_sum")).alias("score"),
    )
