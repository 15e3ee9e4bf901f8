"""Cross-tokenizer alignment by galloping intersection of token ends, with links counted over the corpus.

Two tokenizers cut the same bytes: A is a byte-level BPE of the ``tokenizers`` library, B a SentencePiece model that puts a blank before
a text. A document's tokens give two ascending lists of byte offsets where tokens end. The shorter list drives: each of its
ends is looked for in the longer one from the place of the end before it, in exponentially growing steps and then by binary search. The
common ends slice both token sequences into groups, and the difference of the places (ranks) of two neighbouring ends is the range of tokens
of the longer list that overlap the token between them: the links.

* **Units.** Neither tokenizer has a token that goes on behind a blank that follows other text, so both always end before it. A document
  is therefore a row of units (a word with the white space before it). The units that are new to a task are laid end to end, their two
  lists of ends are intersected at once, and the task remembers groups and links of each. A vocabulary of B that breaks this, and a
  text whose bytes do not come back, are aligned whole.
* **Counts.** A document keeps its distinct (A id, B id) pairs and their times. They are added up inside tasks, then by pair; a pair is
  a *best* one if no pair of its B id is counted higher. The ``hot`` most frequent pairs are looked up in a broadcast table (never more
  than that many rows); the others leave as rows (document, pair, times), are joined by shuffle and summed.

Defined cases: a null or empty text, and a text whose bytes either tokenizer does not give back, has no tokens: all counts are 0 and
groups_sha256 is empty; repeated rows, and rows with a null doc_id, are aligned and counted each; texts are read whole, whatever
their length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from bisect import bisect_left
from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.context_tree import _hot
from cohortlens.llm.hashing import chunks
from cohortlens.llm.tables import discard, numbered, text_of, written

#: Rows of the broadcast table at most.
HOT = 1 << 19
#: Links of distinct units that a task remembers before it empties its tables, and characters of texts that are aligned together.
REMEMBERED, CHUNK = 1 << 21, 1 << 20
#: Distinct pairs that a task adds up before it emits them.
HELD_PAIRS = 1 << 20
#: B ids are below this; a pair is packed as A id * PACK + B id.
PACK = 1 << 31
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
#: A blank after other text and before other text: both tokenizers end a token before it.
CUT = re.compile(r"(?<=\S)(?= \s*\S)")
#: Texts without this, and without white space at the end, can be cut at every blank.
MORE_SPACE = re.compile(r"\s ")


def gallop(short: Sequence[int], long: Sequence[int]) -> list[int]:
    """Rank of each number of ``short`` in ``long`` (how many are smaller); both ascend, and the last of ``long`` is not exceeded."""
    ranks, at, n = [], 0, len(long)
    for x in short:
        step = 1
        while at + step <= n and long[at + step - 1] < x:
            step *= 2
        at = bisect_left(long, x, at + step // 2, min(at + step, n))
        ranks.append(at)
    return ranks


class Aligned(NamedTuple):
    """Tokens of A and of B up to each common end, and the numbers of linked tokens of A and of B."""

    upto_a: np.ndarray
    upto_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> Aligned:
    """Groups and links of two ascending arrays of token ends over the same bytes."""
    swap = len(ends_a) > len(ends_b)
    short, long = (ends_b, ends_a) if swap else (ends_a, ends_b)
    rank = np.array(gallop(short.tolist(), long.tolist()), np.int64)
    common = long[rank] == short if len(rank) else np.zeros(0, bool)
    first = np.concatenate(([0], (rank + common)[:-1]))[: len(rank)]
    n = rank - first + 1  # tokens of the longer list that overlap each token of the shorter one
    of_short = np.repeat(np.arange(len(n)), n)
    of_long = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
    upto_short, upto_long = np.flatnonzero(common) + 1, rank[common] + 1
    return Aligned(upto_long, upto_short, of_long, of_short) if swap else Aligned(upto_short, upto_long, of_short, of_long)


def byte_alphabet() -> dict[str, int]:
    """The characters of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            plain = all(c in alphabet for c in token)
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if plain else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.separable = not any(re.search("[^▁]▁", p) for p in pieces)
        self.lengths_a, self.lengths_b = ([len(x) for x in known] for known in (self.bytes_a, self.bytes_b))
        self.size_a, self.size_b = np.array(self.lengths_a), np.array(self.lengths_b)
        self._forget()

    def _forget(self) -> None:
        self.units: dict[str, int] = {}  # unit -> its number below, -1 if its bytes do not come back
        self.groups: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links
        self.first, self.pairs = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def cut(self, text: str) -> list[str]:
        """Units of a text with the blank before it."""
        if not self.separable:
            return [" " + text]
        if text[-1].isspace() or MORE_SPACE.search(" " + text):
            return CUT.split(" " + text)
        return [" " + part for part in text.split(" ")]

    def _given_back(self, units: list[str], of_a: list[list[int]], of_b: list[list[int]]) -> list[bool]:
        """Whether the tokens of both tokenizers are the bytes of each unit; all units at once, one by one only if some differ."""
        whole = [u.encode() for u in units]
        sizes, line = [len(w) for w in whole], b"".join(whole)
        same = all(
            [sum([size[i] for i in x]) for x in of] == sizes and b"".join([known[i] for x in of for i in x]) == line
            for of, known, size in ((of_a, self.bytes_a, self.lengths_a), (of_b, self.bytes_b, self.lengths_b))
        )
        if same:
            return [True] * len(units)
        return [
            b"".join([self.bytes_a[i] for i in x]) == w == b"".join([self.bytes_b[i] for i in y]) for w, x, y in zip(whole, of_a, of_b)
        ]

    def _remember(self, units: set[str]) -> None:
        new = [u for u in units if u not in self.units]
        a = self.a.encode_batch(new, add_special_tokens=False) if new else []
        b = self.b.encode([u[1:] for u in new], num_threads=1) if new else []
        of_a = [x.ids for x in a]
        good = self._given_back(new, of_a, b)
        if not all(good):
            self.units.update((u, -1) for u, ok in zip(new, good) if not ok)
            new, of_a, b = ([x for x, ok in zip(column, good) if ok] for column in (new, of_a, b))
        if not new:
            return
        self.units.update(zip(new, range(len(self.groups), len(self.groups) + len(new))))
        n_a, n_b = (np.array([len(x) for x in of]) for of in (of_a, b))
        ids_a, ids_b = (np.array([i for x in of for i in x], np.int64) for of in (of_a, b))
        found = align(np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b]))
        unit_of = np.repeat(np.arange(len(new)), n_a)
        n_links = np.bincount(unit_of[found.link_a], minlength=len(new))
        n_groups = np.bincount(unit_of[found.upto_a - 1], minlength=len(new))
        names_a, names_b = (list(map(str, ids.tolist())) for ids in (ids_a, ids_b))
        to_a, to_b = found.upto_a.tolist(), found.upto_b.tolist()
        groups = [
            ",".join(names_a[i:x]) + "|" + ",".join(names_b[j:y]) for i, x, j, y in zip([0, *to_a], to_a, [0, *to_b], to_b)
        ]
        cuts = [0, *np.cumsum(n_groups).tolist()]
        self.groups += [";".join(groups[x:y]) for x, y in zip(cuts, cuts[1:])]
        self.counts = np.concatenate((self.counts, np.column_stack((n_a, n_b, n_groups, n_links))))
        self.first = np.concatenate((self.first, len(self.pairs) + np.cumsum(n_links) - n_links))
        self.pairs = np.concatenate((self.pairs, ids_a[found.link_a] * PACK + ids_b[found.link_b]))

    def _document(self, units: list[int]) -> tuple[np.ndarray, str, np.ndarray, np.ndarray]:
        """Counts, groups_sha256, distinct pairs and their times of a row of units."""
        at = np.array(units, np.int64)
        digest = hashlib.sha256(";".join([self.groups[i] for i in units]).encode()).hexdigest() if units else ""
        n = self.counts[at, 3]
        places = np.arange(n.sum()) + np.repeat(self.first[at] - (np.cumsum(n) - n), n)
        return self.counts[at].sum(axis=0), digest, *np.unique(self.pairs[places], return_counts=True)

    def documents(self, texts: list[str]) -> list[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """Counts, groups_sha256, distinct pairs and their times of each text."""
        if len(self.pairs) > REMEMBERED:
            self._forget()
        cut = [self.cut(t) if t else [] for t in texts]
        self._remember(set().union(*cut))
        out = []
        for text, units in zip(texts, cut):
            numbers = [self.units[u] for u in units]
            if -1 in numbers:  # the whole text decides
                self._remember({" " + text})
                numbers = [i for i in [self.units[" " + text]] if i >= 0]
            out.append(self._document(numbers))
        return out


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker."""
    return Aligner(path_a, path_b)


def _aligned(batches, path_a: str, path_b: str):
    found = aligner(path_a, path_b)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for first, last in chunks(texts, CHUNK):
            counts, digests, pairs, times = zip(*found.documents(texts[first:last]))
            ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.int64))) for x in (pairs, times)]
            keys = [batch.column(c).slice(first, last - first) for c in ("rid", "doc_id")]
            own = [*map(pa.array, np.array(counts).T.copy()), pa.array(digests, pa.string())]
            yield pa.record_batch([*keys, *own, *lists], ["rid", "doc_id", *COUNTS, "groups_sha256", "pairs", "times"])


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and times of all documents of a batch, and the document of each."""
    pairs, times = batch.column("pairs"), batch.column("times")
    owner = np.repeat(np.arange(batch.num_rows), np.diff(pairs.offsets.to_numpy()))
    return pairs.flatten().to_numpy(), times.flatten().to_numpy(), owner


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(unique), np.int64)
    np.add.at(total, at, times)
    return unique, total


def _pairs(batches):
    """(pair, n): times of each pair, added up as far as one task can hold."""
    keys, times, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    for batch in batches:
        waiting.append(_lists(batch)[:2])
        size += len(waiting[-1][0])
        if size > HELD_PAIRS:
            keys, times = _summed(*(np.concatenate(x) for x in zip((keys, times), *waiting)))
            waiting, size = [], 0
            if len(keys) > HELD_PAIRS:
                yield pa.record_batch([pa.array(keys), pa.array(times)], ["pair", "n"])
                keys, times = keys[:0], times[:0]
    keys, times = _summed(*(np.concatenate(x) for x in zip((keys, times), *waiting)))
    yield pa.record_batch([pa.array(keys), pa.array(times)], ["pair", "n"])


_HOT_PAIRS: dict[str, tuple[np.ndarray, ...]] = {}


def _hot_pairs(hot) -> tuple[np.ndarray, ...]:
    """The broadcast table of this worker in the order of its pairs; one at a time is kept."""
    name, *columns = hot.value
    if name not in _HOT_PAIRS:
        order = np.argsort(columns[0])
        _HOT_PAIRS.clear()
        _HOT_PAIRS[name] = tuple(c[order] for c in columns)
    return _HOT_PAIRS[name]


def _looked_up(batches, hot):
    """Per document: links of best pairs and summed counts by the broadcast table, and all other pairs with their times."""
    pair, count, best = _hot_pairs(hot)
    kept = ["rid", "doc_id", *COUNTS, "groups_sha256"]
    for batch in batches:
        keys, times, owner = _lists(batch)
        at = np.minimum(np.searchsorted(pair, keys), max(len(pair) - 1, 0))
        hit = pair[at] == keys if len(pair) else np.zeros(len(keys), bool)
        n_best, total = np.zeros((2, batch.num_rows), np.int64)
        np.add.at(n_best, owner[hit], times[hit] * best[at[hit]])
        np.add.at(total, owner[hit], times[hit] * count[at[hit]])
        ends = np.concatenate(([0], np.cumsum(np.bincount(owner[~hit], minlength=batch.num_rows)))).astype(np.int32)
        late = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[~hit])) for x in (keys, times)]
        yield pa.record_batch(
            [*[batch.column(c) for c in kept], pa.array(n_best), pa.array(total), *late], [*kept, "known_best", "known_sum", "late", "late_times"]
        )


def aligned_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """rid, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times of every row of (rid, doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("rid", "doc_id", "text").mapInArrow(
        lambda b: _aligned(b, path_a, path_b),
        f"rid bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string,"
        " pairs array<bigint>, times array<bigint>",
    )


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, id_a, id_b, n, best): links of each pair in the corpus, and whether no pair of its B id has more."""
    sums = found.select("pairs", "times").mapInArrow(_pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    sums = written(sums.select("pair", F.expr(f"pair div {PACK}").alias("id_a"), (F.col("pair") % PACK).alias("id_b"), "n"), "pair-counts")
    most = sums.groupBy("id_b").agg(F.max("n").alias("most"))
    return sums.join(most, "id_b").select("pair", "id_a", "id_b", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    ``path_a`` is a byte-level .json of tokenizers, ``path_b`` a .model of sentencepiece; both must be on every executor.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = numbered(docs.select("doc_id", text_of(docs).alias("text")))
    found = written(aligned_documents(docs, path_a, path_b), "aligned-documents", "zstd")
    counts = written(pair_counts(found), "pair-best")
    least = _hot(counts, "n", hot)
    frequent = counts.filter(F.col("n") >= least).select("pair", "n", "best").toArrow()  # at most ``hot`` rows
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, *(c.to_numpy() for c in frequent.columns)))
    known = found.mapInArrow(
        lambda b: _looked_up(b, shared),
        f"rid bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string,"
        " known_best bigint, known_sum bigint, late array<bigint>, late_times array<bigint>",
    )
    known = written(known, "aligned-counts")
    discard(found)
    rare = counts.filter(F.col("n") < least).select("pair", "n", "best")
    late = known.select("rid", F.explode(F.arrays_zip(F.col("late").alias("pair"), F.col("late_times").alias("times"))).alias("x"))
    late = late.select("rid", "x.pair", "x.times").join(rare, "pair")
    late = late.groupBy("rid").agg(
        F.sum(F.col("times") * F.col("best")).alias("late_best"), F.sum(F.col("times") * F.col("n")).alias("late_sum")
    )
    out = known.drop("late", "late_times").join(late, "rid", "left")
    whole = {n: F.col(f"known_{s}") + F.coalesce(f"late_{s}", F.lit(0)) for n, s in (("n_best", "best"), ("count_sum", "sum"))}
    out = out.withColumns(whole)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
