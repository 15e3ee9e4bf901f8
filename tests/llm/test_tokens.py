"""Token counts, alignment and importance resampling against the libraries and brute force."""

import hashlib
import math
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest
from llm.conftest import frame, sentence

from cohortlens.llm.alignment import PACK, Aligner, align, alignment, gallop
from cohortlens.llm.importance import feature_buckets, importance_sample, packed, unpacked, word_splitter
from cohortlens.llm.registry import tokenizer_file
from cohortlens.llm.token_counts import Cutter, token_counts

WORDS, BYTES, PIECES = map(tokenizer_file, ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ALPHABET = [*"ab  \n\t'sXéÉ▁  中é0 9\x00\x1f\r.,ıİß", "́", " ", " ", "<|endoftext|>", "<|startoftext|>", "don't ", "\U0001f600"]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


def documents(spark, odd_rows, n=120):
    rng = random.Random(9)
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(odd_texts(n))]
    rows += [(1000 + i, sentence(rng, rng.randrange(5, 300), 80).capitalize() + ". The end") for i in range(40)]
    rows += [(2000 + i, sentence(rng, 30, 80) + " <|endoftext|> " + "  x" * i) for i in range(10)]
    return rows, frame(spark, rows)


# Token counts


@pytest.mark.parametrize("path,hot", [(WORDS, 1 << 17), (WORDS, 20), (WORDS, 0), (BYTES, 50)])
def test_token_counts_are_the_library_s(spark, odd_rows, path, hot):
    from tokenizers import Tokenizer

    rows, docs = documents(spark, odd_rows)
    library = Tokenizer.from_file(path)
    want = Counter((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    got = token_counts(docs, path, limit=40, hot=hot).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 40) for r in got)


def test_runs_between_blanks_are_cut_alone():
    assert Cutter(WORDS).separable and not Cutter(BYTES).separable
    assert Cutter(WORDS).runs("a <|endoftext|>b\nc") == (1, ["a", "", "b", "c"])


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_a_texts_pre_tokens_are_those_of_its_runs(odd_rows, path):
    texts = [r[1] or "" for r in odd_rows] + ["a\tb  c", "It's 12ab, it's<|endoftext|>12AB", "\u0130 \ufb01 e\u0301"]
    cutter = Cutter(path)
    for _ in range(2):  # unknown runs, then known ones
        special, bounds, names, times = cutter.frequencies(texts)
        for i, text in enumerate(texts):
            n, runs = cutter.runs(text)
            own = slice(bounds[i], bounds[i + 1])
            assert special[i] == n and len(set(names[own].to_pylist())) == len(names[own])
            assert dict(zip(names[own].to_pylist(), times[own])) == Counter(p for r in runs for p in cutter.pre_tokens(r))


def test_no_cycle_search_while_runs_are_cut():
    import gc

    cutter, begun = Cutter(WORDS), []
    note = lambda phase, info: begun.append(phase)
    runs = [f"w{i}, {i}".replace(" ", "") for i in range(20_000)]
    gc.callbacks.append(note)
    try:
        cutter.learn(runs)
    finally:
        gc.callbacks.remove(note)
    assert gc.isenabled() and len(begun) <= 4  # a start and an end each; a search per 2,000 pairs before


def test_a_million_blanks_and_letters(spark):
    from tokenizers import Tokenizer

    texts = [" " * 1_000_000, "a" * 100_000, "ab \n" * 50_000]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(frame(spark, list(enumerate(texts))), WORDS).collect()}
    assert got == {i: len(Tokenizer.from_file(WORDS).encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


# Alignment


@pytest.mark.parametrize("seed", range(5))
def test_gallop(seed):
    rng = random.Random(seed)
    for _ in range(200):
        n = rng.randrange(1, 60)
        long = sorted({*rng.sample(range(200), n), 200})
        short = sorted({*rng.sample(range(200), rng.randrange(1, 20)), 200})
        assert gallop(short, long) == [bisect_left(long, x) for x in short]


def brute_links(ends_a, ends_b):
    spans = [[(a, b) for a, b in zip([0, *ends], ends)] for ends in (ends_a, ends_b)]
    return {(i, j) for i, (a, b) in enumerate(spans[0]) for j, (c, d) in enumerate(spans[1]) if max(a, c) < min(b, d)}


@pytest.mark.parametrize("seed", range(5))
def test_links_and_groups(seed):
    rng = random.Random(seed)
    for _ in range(100):
        ends_a, ends_b = (sorted({*rng.sample(range(1, 60), rng.randrange(0, 40)), 60}) for _ in range(2))
        got = align(np.array(ends_a), np.array(ends_b))
        links = list(zip(got.link_a.tolist(), got.link_b.tolist()))
        assert set(links) == brute_links(ends_a, ends_b) and len(links) == len(set(links))
        both = sorted(set(ends_a) & set(ends_b))
        assert [ends_a[i - 1] for i in got.upto_a] == both == [ends_b[j - 1] for j in got.upto_b]


def whole(text, a, b, bytes_a, bytes_b):
    """Ids and links of a text, from the definitions."""
    none = [], [], [], ""
    if not text:
        return none
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ends = []
    for own, known in zip(ids, (bytes_a, bytes_b)):
        parts = [known[i] for i in own]
        if b"".join(parts) != (" " + text).encode():
            return none
        ends.append([sum(map(len, parts[: i + 1])) for i in range(len(parts))])
    links = [(ids[0][i], ids[1][j]) for i, j in brute_links(*ends)]
    groups, at = [], (0, 0)
    for x in sorted(set(ends[0]) & set(ends[1])):
        to = ends[0].index(x) + 1, ends[1].index(x) + 1
        groups.append("|".join(",".join(map(str, own[s:e])) for own, s, e in zip(ids, at, to)))
        at = to
    return *ids, links, ";".join(groups)


@pytest.mark.parametrize("hot", [1 << 19, 30, 0])
def test_alignment_is_that_of_whole_texts(spark, odd_rows, hot):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    tables = Aligner(BYTES, PIECES)
    rows, docs = documents(spark, [r for r in odd_rows if len(r[1] or "") < 5000])
    found = [whole(r[1], a, b, tables.bytes_a, tables.bytes_b) for r in rows]
    counts = Counter(x for f in found for x in f[2])
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    want = Counter()
    for r, (ia, ib, links, groups) in zip(rows, found):
        n_best = sum(counts[x] == best[x[1]] for x in links)
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        n_groups = groups.count(";") + 1 if groups else 0
        want[r[0], len(ia), len(ib), n_groups, len(links), n_best, sum(counts[x] for x in links), digest] += 1
    got = alignment(docs, BYTES, PIECES, hot).collect()
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(tuple(r[c] for c in columns) for r in got) == want
    assert sum(f[0] != [] for f in found) > len(found) // 2  # most texts have tokens; those with U+2581 have none
    assert any(f[0] == [] and r[1] for f, r in zip(found, rows))


def test_token_bytes():
    tables = Aligner(BYTES, PIECES)
    assert tables.separable and len(tables.bytes_a) < PACK and len(tables.bytes_b) < PACK
    for text in ("a é 中 \x00\n\x7f ", "\U0001f600 don't"):
        ids = tables.a.encode(text, add_special_tokens=False).ids
        assert b"".join(tables.bytes_a[i] for i in ids) == text.encode()


# Importance resampling


def brute_features(text):
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(x.encode()) % 10_000 for x in runs]


def brute_sample(rows, target, percent, least):
    found = [(r[0], *brute_features(r[1])) for r in rows]
    raw, wanted = Counter(b for f in found for b in f[2]), Counter(b for t in target for b in brute_features(t)[1])
    s, t = sum(raw.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10_000) / ((raw[b] + 1) * (t + 10_000)))) for b in raw}
    out = []
    for doc_id, n, buckets in found:
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets)
        out.append([doc_id, n, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((o for o in out if o[1] >= least), key=lambda o: (-o[4], o[0] is not None, o[0]))
    drawn = able[: percent * len(able) // 100]
    return out, [(o[0], o[4]) for o in drawn]


@pytest.mark.parametrize("percent,least", [(5, 20), (40, 3), (100, 0), (1, 20)])
def test_importance_sample(spark, odd_rows, percent, least):
    rows, docs = documents(spark, odd_rows)
    target = [sentence(random.Random(1), 30, 40), None, "", "The END a b"]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id bigint, text string, buckets string")
    out, drawn = brute_sample(rows, target, percent, least)
    got = importance_sample(docs, benchmark, percent, least).collect()
    columns = ("doc_id", "n_words", "n_features", "weight", "score")
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(map(tuple, out))
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["score"]) for r in ranked] == drawn


def test_words_and_offsets():
    text = "é b, cc--d9\U0001f600"
    words = word_splitter().pre_tokenize_str(text)
    assert [w for w, _ in words] == ["é", "b", "cc", "d9\U0001f600"] and all(text[a:b] == w for w, (a, b) in words)
    buckets = feature_buckets(words)
    assert buckets.tolist() == brute_features(text)[1]
    assert unpacked(packed(buckets)).tolist() == sorted(buckets.tolist()) and not len(unpacked(packed(buckets[:0])))


def test_empty_tables(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    none = docs.filter("doc_id < 0")
    target = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert token_counts(none, WORDS).count() == 0 and alignment(none, BYTES, PIECES).count() == 0
    assert importance_sample(none, target).count() == 0
    got = {r["doc_id"]: (r["n_features"], r["rank"]) for r in importance_sample(docs, target.filter("item_id < 0"), 100, 0).collect()}
    assert got == {1: (3, 2), 2: (0, 1)} or got == {1: (3, 1), 2: (0, 2)}
