"""Token counts: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies.

A tokenizer of the ``tokenizers`` library normalises a text, cuts it into pre-tokens and splits each pre-token on its own. The
number of pieces therefore depends on the pre-token alone:

* one pass over the texts writes each document's distinct pre-tokens and how often they occur in it (as numbers, by array operations);
* each distinct pre-token of the corpus is split once, by the library's own model, and only the number of its pieces is kept;
* the numbers are joined to the frequencies. The ``hot`` most frequent pre-tokens are looked up in a broadcast table (never more
  than that many rows, whatever the corpus); the others leave as rows (document, pre-token, times), are joined by shuffle and
  summed. No id is ever formed for a document.

Where the tokenizer drops white space, blanks and line feeds bound everything that it does. Runs between them are then handed to
the library many at once, and a task remembers their pre-tokens; other tokenizers are given the text whole. Strings of special
tokens inside a text are one token each, the library's default. Begin, end and other added tokens, truncation and padding take
no part.

Defined cases: a null text counts as empty; an empty text has no bytes and no tokens; repeated rows, and rows with a null doc_id,
are counted each; texts are read whole, whatever their length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import re
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.context_tree import _hot
from cohortlens.llm.hashing import chunks
from cohortlens.llm.tables import discard, numbered, text_of, written

#: Rows of the broadcast table at most.
HOT = 1 << 17
#: Characters of distinct runs that a task remembers before it empties its table, and of texts that are cut together.
REMEMBERED, CHUNK = 5 << 20, 1 << 21
LIMIT = 2048
KEYS = ["rid", "doc_id", "n_bytes"]


class Cutter:
    """Pre-tokens of texts, as the library cuts them."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in special):
            raise ValueError("added tokens that take blanks or whole words with them, or are normalised, are not supported")
        strings = sorted((t.content for t in special), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, strings))) if strings else None
        self.forget()
        self.separable = self.pre_tokens("a b\nc") == [p for x in "abc" for p in self.pre_tokens(x)]

    def pre_tokens(self, run: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        normalizer, cutter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        run = normalizer.normalize_str(run) if normalizer else run
        return [p for p, _ in cutter.pre_tokenize_str(run)] if cutter else [run] if run else []

    def runs(self, text: str) -> tuple[int, list[str]]:
        """Number of special tokens in a text, and the parts between them and (if possible) between blanks."""
        parts = self.special.split(text) if self.special else [text]
        if self.separable:
            runs = [r for p in parts for r in p.replace("\n", " ").split(" ")]
        else:
            runs = [p for p in parts if p]
        return len(parts) - 1, runs

    def many(self, runs: list[str]) -> tuple[list[str], np.ndarray]:
        """Pre-tokens of all runs, and how many each has, by one call of the library where the runs stand between blanks.

        A run that holds white space of another kind would be cut in two; the call is then made for each run.
        """
        normalizer, cutter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        line = " ".join(runs)
        line = normalizer.normalize_str(line) if normalizer else line
        parts = line.split(" ")
        if not self.separable or len(parts) != len(runs):
            found = [self.pre_tokens(r) for r in runs]
            return [p for own in found for p in own], np.fromiter(map(len, found), np.int64, len(found))
        found = cutter.pre_tokenize_str(line)
        ends = np.cumsum(np.array([len(p) for p in parts]) + 1)
        starts = np.array([a for _, (a, _) in found])
        return [p for p, _ in found], np.diff(np.searchsorted(starts, ends), prepend=0)

    def learn(self, runs: list[str]) -> None:
        """Remember the pre-tokens of runs, as numbers: those of the k-th run are ``held[first[k]:first[k + 1]]``."""
        # The library returns a pair for each pre-token. They hold no cycles, and searching them for some took a third of the time.
        searching = gc.isenabled()
        gc.disable()
        try:
            own, counts = self.many(runs)
        finally:
            if searching:
                gc.enable()
        names = self.names
        numbers = np.array([names.setdefault(p, len(names)) for p in own], np.int64)
        self.known.update(zip(runs, range(len(self.known), len(self.known) + len(runs))))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(counts)))
        self.held = np.concatenate((self.held, numbers))
        self.size += sum(map(len, runs))

    def frequencies(self, texts: list[str]) -> tuple[list[int], np.ndarray, pa.Array, np.ndarray]:
        """Special tokens of each text, bounds of the texts in what follows, their distinct pre-tokens and the times they occur."""
        parts = [self.special.split(t) for t in texts] if self.special else [[t] for t in texts]
        if self.separable:
            lines = pc.replace_substring(pa.array([" ".join(p) for p in parts], pa.string()), "\n", " ")
            cut = pc.split_pattern(lines, " ")
        else:
            cut = pa.array([self.runs(t)[1] for t in texts], pa.list_(pa.string()))
        runs = cut.flatten().dictionary_encode()
        if self.size > REMEMBERED:
            self.forget()
        distinct = runs.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := [r for r in distinct if r not in self.known]:
            self.learn(new)
        run = np.array([self.known[r] for r in distinct], np.int64)[runs.indices.to_numpy()]
        text = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))
        # Every run gives as many places as it has pre-tokens; a place is the text's number beside the pre-token's.
        start, count = self.first[run], self.first[run + 1] - self.first[run]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        width = max(1, len(self.names))
        places = np.sort(np.repeat(text, count) * width + self.held[np.repeat(start, count) + step])
        at = np.flatnonzero(np.diff(places, prepend=-1))
        text, number = np.divmod(places[at], width)
        used = np.zeros(width, bool)
        used[number] = True
        names = pa.array(compress(self.names, used.tolist()), pa.string())
        names = names.take(pa.array((np.cumsum(used) - 1)[number]))
        return [len(p) - 1 for p in parts], np.searchsorted(text, np.arange(len(texts) + 1)), names, np.diff(at, append=len(places))

    def forget(self) -> None:
        """Give the remembered runs free: the worker goes on to tasks that read none."""
        self.known: dict[str, int] = {}
        self.names: dict[str, int] = {}
        self.first, self.held, self.size = np.zeros(1, np.int64), np.zeros(0, np.int64), 0

    def pieces(self, pre_token: str) -> int:
        return len(self.tokenizer.model.tokenize(pre_token))


@lru_cache(maxsize=2)
def cutter(path: str) -> Cutter:
    """One per Python worker."""
    return Cutter(path)


def _frequencies(batches, path: str):
    cut = cutter(path)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in chunks(texts, CHUNK):
            special, bounds, names, times = cut.frequencies(texts[a:b])
            lists = (pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), x) for x in (names, pa.array(times, pa.int64())))
            columns = [pa.array(special, pa.int64()), *lists]
            keys = [batch.column(c).slice(a, b - a) for c in KEYS]
            yield pa.record_batch([*keys, *columns], [*KEYS, "special", "pre_tokens", "times"])


def pre_token_frequencies(docs: DataFrame, path: str) -> DataFrame:
    """rid, doc_id, n_bytes, special, pre_tokens, times of every row of (rid, doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("rid", "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "text")
    kinds = f"rid bigint, doc_id {kind}, n_bytes bigint, special bigint, pre_tokens array<string>, times array<bigint>"
    return rows.mapInArrow(lambda b: _frequencies(b, path), kinds)


def _counted(batches, path: str):
    """(pre_token, n, pieces) of distinct pre-tokens."""
    cut = cutter(path)
    cut.forget()
    for batch in batches:
        pieces = [cut.pieces(p) for p in batch.column("pre_token").to_pylist()]
        yield pa.record_batch([*batch.columns, pa.array(pieces, pa.int64())], ["pre_token", "n", "pieces"])


def _rows(found: DataFrame) -> DataFrame:
    """(rid, pre_token, times) of the listed pre-tokens."""
    pairs = F.explode(F.arrays_zip(F.col("pre_tokens").alias("pre_token"), F.col("times").alias("times"))).alias("x")
    return found.select("rid", pairs).select("rid", "x.pre_token", "x.times")


def pre_token_pieces(found: DataFrame, path: str) -> DataFrame:
    """(pre_token, n, pieces): every distinct pre-token of the documents, its frequency and the number of its pieces."""
    distinct = _rows(found).groupBy("pre_token").agg(F.sum("times").alias("n"))
    return distinct.mapInArrow(lambda b: _counted(b, path), "pre_token string, n bigint, pieces bigint")


def _known(batches, hot):
    """Per document: tokens by the broadcast table, and the frequencies of all other pre-tokens."""
    cutter.cache_clear()  # this worker may have cut texts before
    pre_tokens, pieces = hot.value
    for batch in batches:
        lists, special = batch.column("pre_tokens"), batch.column("special").to_numpy()
        names, times = lists.flatten(), batch.column("times").flatten().to_numpy()
        owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        at = pc.index_in(names, value_set=pre_tokens)
        hit = at.is_valid().to_numpy(zero_copy_only=False)
        total = special + np.bincount(owner[hit], times[hit] * pieces[at.drop_null().to_numpy()], batch.num_rows).astype(np.int64)
        ends = pa.array(np.cumsum([0, *np.bincount(owner[~hit], minlength=batch.num_rows)]), pa.int32())
        late = [pa.ListArray.from_arrays(ends, x) for x in (names.filter(pa.array(~hit)), pa.array(times[~hit]))]
        yield pa.record_batch([*[batch.column(c) for c in KEYS], pa.array(total), *late], [*KEYS, "known", "pre_tokens", "times"])


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document, by the tokenizer file at ``path`` (on every executor)."""
    if not path.endswith(".json"):
        raise ValueError("a tokenizer file of the tokenizers library (.json) is needed")
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = numbered(docs.select("doc_id", text_of(docs).alias("text")))
    found = written(pre_token_frequencies(docs, path), "pre-token-frequencies", "zstd")
    pieces = written(pre_token_pieces(found, path), "pre-tokens")
    least = _hot(pieces, "n", hot)
    frequent = pieces.filter(F.col("n") >= least).select("pre_token", "pieces").toArrow()  # at most ``hot`` rows
    table = frequent.column("pre_token").combine_chunks(), frequent.column("pieces").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kinds = f"rid bigint, doc_id {kind}, n_bytes bigint, known bigint, pre_tokens array<string>, times array<bigint>"
    known = written(found.mapInArrow(lambda b: _known(b, shared), kinds), "token-counts", "zstd")
    discard(found)
    rare = pieces.filter(F.col("n") < least).select("pre_token", "pieces")
    late = _rows(known).join(rare, "pre_token").groupBy("rid").agg(F.sum(F.col("times") * F.col("pieces")).alias("rest"))
    n = F.col("known") + F.coalesce("rest", F.lit(0))
    out = known.select("rid", "doc_id", "n_bytes", "known").join(late, "rid", "left").withColumn("n_tokens", n)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
