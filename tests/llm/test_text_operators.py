"""Quality rules, licences, joins, tiling and byte dedup against brute force."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.conftest import frame, sentence, word
from pyspark.sql import functions as F

from cohortlens.llm.components import components
from cohortlens.llm.decontamination import contaminated, tiles
from cohortlens.llm.jaccard_join import choose_boundary, jaccard_components, need, one_per_group, spare
from cohortlens.llm.license_rules import rules
from cohortlens.llm.license_scan import Scanner, license_scan, suppress
from cohortlens.llm.quality_rules import clean_documents, quality_rules
from cohortlens.llm.suffix_dedup import LENGTH, anchors, column_hits, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Quality rules


def base_counts(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark, odd_rows):
    rng = random.Random(0)
    rows = odd_rows + [(100 + i, "\n".join(sentence(rng, rng.randrange(9), 4) for _ in range(9)) + " #a|<é>") for i in range(40)]
    got = Counter(
        (r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        for r in quality_rules(frame(spark, rows)).collect()
    )
    want = Counter()
    for r in rows:
        n = base_counts(r[1])
        want[r[0], *n, n[0] < 10 or 100 * n[4] > 20 * n[0]] += 1
    assert got == want


def test_line_frequency(spark):
    rng = random.Random(1)
    notice, rows = "Read 12 more  Notices here", []
    rows += [(i, f"{sentence(rng, 40)}\nread 7 more notices HERE") for i in range(5)]  # boilerplate in five different texts
    near = [sentence(rng, 30) for _ in range(4)]
    rows += [(20 + i, "\n".join([*near, f"extra {i}"])) for i in range(8)]  # near copies: same body, so nothing is boilerplate
    rows += [(40, f"{notice}\n{notice}\n{notice}\nshort tail of a few words more than ten in this line here")]
    rows += [(50, f"{sentence(rng, 40)}\n{notice}", "en", "elsewhere")]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in quality_rules(docs, max_docs=5).collect()}
    assert [got[i]["removed_lines"] for i in range(5)] == [1] * 5 and all(got[i]["kept"] for i in range(5))
    assert all(got[20 + i]["removed_lines"] == 0 for i in range(8))
    assert got[40]["removed_lines"] == 3 and got[50]["removed_lines"] == 0
    clean = {r["doc_id"]: r for r in clean_documents(docs, max_docs=5).collect()}
    assert clean[0]["text"] == rows[0][1].split("\n")[0] and clean[0]["n_chars"] == len(clean[0]["text"])
    assert clean[50]["text"] == rows[14][1] and set(clean) == {i for i, r in got.items() if r["kept"]}


def test_depleted_documents_go(spark):
    rng = random.Random(2)
    notice = sentence(rng, 40)
    rows = [(i, f"{sentence(rng, 60)}\n{notice}") for i in range(6)] + [(9, f"{notice}\n{sentence(rng, 11)}")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules(frame(spark, rows), max_docs=5).collect()}
    assert got[9] is False and all(got[i] for i in range(6))


def test_long_notices_and_footers_beside_near_copies(spark):
    """A notice longer than every article, a footer that near copies hold more often than articles, and edited near copies."""
    rng = random.Random(3)
    notice, footer, body = sentence(rng, 90), "all rights are reserved here", sentence(rng, 60)
    rows = [(i, f"{sentence(rng, 30)}\n{notice}", "en", "notices") for i in range(8)]
    rows += [(100 + i, f"{sentence(rng, 40)}\n{footer}", "en", "hot") for i in range(10)]
    rows += [(200 + i, f"{body}\n{sentence(rng, 5)}\n{footer}", "en", "hot") for i in range(15)]
    lines = [sentence(rng, 60 - 6 * k).split() for k in range(6)]
    for i in range(80):
        copy = [list(x) for x in lines]
        copy[i % 6][rng.randrange(20)] = f"edit{word(i)}"
        rows.append((300 + i, "\n".join(" ".join(x) for x in copy), "en", "copies"))
    got = {r["doc_id"]: r for r in quality_rules(frame(spark, rows), max_docs=5).collect()}
    assert all(got[i]["removed_lines"] == 1 and got[i]["removed_words"] == 90 for i in range(8))
    assert all(got[i]["removed_lines"] == 1 and got[i]["removed_words"] == 5 and got[i]["kept"] for i in range(100, 110))
    assert all(got[i]["removed_lines"] == 1 and got[i]["kept"] for i in range(200, 215))
    assert all(got[i]["removed_lines"] == 0 and got[i]["kept"] for i in range(300, 380))


# Licences


def test_license_base_and_labels(spark, odd_rows):
    phrases = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
    texts = [
        "The MIT-License, and: mit\nlicense", "permit license", "GNU General  Public License v3", "Licensed under CC BY-SA 4.0",
        "SPDX-License-Identifier: Apache-2.0", "general apache license public license", "émit license mit license9",
    ]
    rows = odd_rows + [(200 + i, t) for i, t in enumerate(texts)]
    got = license_scan(frame(spark, rows)).collect()
    for r, (_, text, *_) in zip(sorted(got, key=lambda r: (r["doc_id"] or -1)), sorted(rows, key=lambda r: (r[0] or -1))):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)) if r["doc_id"] != 3 else None
        if words is None:
            continue
        found = sorted(
            (i, label) for p, label in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split()
        )
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_base"]) == (len(words), len(found))
            assert (r["first_word"], r["last_word"]) == ((found[0][0], found[-1][0]) if found else (None, None))
            assert r["base_labels"] == ",".join(sorted({x for _, x in found}))
            assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert (labels[202], labels[203], labels[204]) == ("gpl,gpl-3.0", "cc-by-sa", "apache-2.0")


def test_rules_pass_their_own_gate():
    assert len(rules()) > 300
    scanner = Scanner()
    for text in ("licensed\nunder the apache  license, version 2.0", "this work is licensed under the gnu general\tpublic license"):
        assert scanner.hits(text)


@pytest.mark.parametrize("word", ["copyright", "license", "licensed under", "spdx-license-identifier:"])
def test_long_runs_of_blanks_take_time_in_proportion(word):
    scanner = Scanner()
    start = time.process_time()
    hits = scanner.hits(f"{word}{' ' * 300_000}. copyright \n (c) \t 2001")
    assert time.process_time() - start < 20  # a second or two; tried cut by cut it would be hours
    assert [scanner.rules[i][0].label for _, _, i in hits] == ["copyright"]


def test_suppression_equals_the_definition():
    rng = random.Random(0)
    for _ in range(500):
        found = [(a, a + rng.randrange(1, 12), rng.randrange(5)) for a in (rng.randrange(30) for _ in range(rng.randrange(12)))]
        priority = [rng.randrange(3) for _ in range(5)]
        kept = []
        for h in sorted(found, key=lambda h: (-priority[h[2]], h[0] - h[1], h)):
            if not any(k[0] <= h[0] and k[1] >= h[1] for k in kept):
                kept.append(h)
        assert kept == suppress(found, priority)


# Jaccard join


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    lists = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            lists[g].append(i)
    for i, s in sets.items():
        for j, c in Counter(j for g in s for j in lists[g]).items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(45):
        base = sentence(rng, rng.choice([1, 3, 4, 5, 6, 8, 9, 10, 12, 13, 15, 17, 20, 26, 40, 80]), 60).split()
        for _ in range(rng.choice([1, 2, 3, 8, 30])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = word(rng.randrange(60))
            rows.append((len(rows) * 3 + 1, " ".join(copy + ["Wb"] * (rng.random() < 0.3))))
    rows += [(9000, None), (9001, ""), (9002, " \n")]
    docs = frame(spark, rows)
    want = brute_components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()}
    assert got == want
    assert sorted(r["doc_id"] for r in one_per_group(docs).collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_one_per_group_reads_and_contracts_each_table_once(spark, monkeypatch):
    """The same links are not contracted twice, and the measured rows stand once in the plan that keeps one per group."""
    from cohortlens.llm import jaccard_join

    rng = random.Random(21)
    rows = [(i, sentence(rng, 60, 3000)) for i in range(6)]
    rows += [(10 + i, rows[i][1] + " tail") for i in range(3)] + [(20, rows[0][1]), (21, ""), (22, None), (22, "")]
    links = []
    monkeypatch.setattr(jaccard_join, "components", lambda edges: links.append(edges) or components(edges))
    kept = one_per_group(frame(spark, rows))
    assert len(links) == len({id(x) for x in links}) > 0
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[doc_id#\d+L?,_row#\d+L?,n#\d+L?,cls#", plan)) == 1
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 21, 22, 22]


def test_seed_filters_are_packed(spark, monkeypatch):
    """The bit tables of all seed sizes are shipped with every task: one bit for a number, not one byte."""
    from cohortlens.llm import decontamination

    kinds = []
    monkeypatch.setattr(decontamination.np, "zeros", lambda n, *a, f=np.zeros: kinds.append(f(n, *a).nbytes) or f(n, *a))
    items = spark.createDataFrame([(1, "a b c d e f g h"), (2, "x y"), (3, "z")], "item_id bigint, text string")
    docs = [(1, "q a b c d e f g h q"), (2, "nothing of it"), (3, "there is x y in it"), (4, "z"), (5, None)]
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(frame(spark, docs), items).collect()}
    assert found == {(1, 1), (3, 2), (4, 3)}
    assert kinds and max(kinds) <= decontamination.FILTER_BITS // 8



def test_sizes_and_boundary():
    for a in range(1, 60):
        assert a - spare(a) == -(-80 * a // 100)
        for b in range(a, 60):
            c = need(a, b)
            assert 100 * c >= 80 * (a + b - c) and 100 * (c - 1) < 80 * (a + b - c + 1)
    assert choose_boundary({}) == 0
    assert 0 < choose_boundary({n: 100 for n in range(1, 25)}) < 24


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80), (80, 70), (5, 5)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 70: 70, 80: 70, 90: 70}


# Tiling


def brute_tiles(doc, item, least):
    taken_d, taken_i, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in taken_d and j + n not in taken_i:
                    n += 1
                best = max(best, (n, -i, -j))
        if best[0] < least:
            return sorted(n for _, _, n in out)
        n, i, j = best[0], -best[1], -best[2]
        taken_d |= set(range(i, i + n))
        taken_i |= set(range(j, j + n))
        out.append((i, j, n))


def test_tiles_are_greedy():
    rng = random.Random(4)
    for _ in range(150):
        doc, item = ([rng.randrange(4) for _ in range(rng.randrange(30))] for _ in range(2))
        got = sorted(
            n for _, _, n in tiles(np.array(doc, np.uint64), np.arange(len(doc)), np.array(item, np.uint64), 3)
        )
        want = brute_tiles(doc, item, 3)
        assert got[-1:] == want[-1:] and all(n >= 3 for n in got)


def test_reordered_passages_are_caught(spark):
    rng = random.Random(6)
    items = [(i, sentence(rng, 40, 5000)) for i in range(12)]
    w = items[0][1].split()
    shuffled = " ".join(w[30:] + ["x"] + w[:15] + ["y"] + w[15:30])
    half = " ".join(items[1][1].split()[:18])
    rows = [
        (1, f"{sentence(rng, 50, 5000)} {items[2][1].upper()}, {sentence(rng, 50, 5000)}"), (2, shuffled), (3, half),
        (4, sentence(rng, 300, 5000)), (5, items[3][1] + " " + items[4][1]),
    ]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in contaminated(frame(spark, rows), benchmark).collect()}
    assert set(got) == {(1, 2), (2, 0), (5, 3), (5, 4)}
    assert got[2, 0]["n_tiles"] == 3 and got[2, 0]["coverage"] == 1.0


# Byte dedup


def brute_dedup(rows):
    data = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(b[i : i + LENGTH] for _, b in data for i in range(len(b) - LENGTH + 1))
    out = Counter()
    for d, b in data:
        covered = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - LENGTH + 1):
            if count[b[i : i + LENGTH]] > 1:
                covered[i : i + LENGTH] = True
        kept = bytes(x for x, c in zip(b, covered) if not c)
        spans = int((covered[:-1] & ~np.concatenate(([False], covered[:-2]))).sum()) if len(b) else 0
        out[d, len(b), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def dedup_rows():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefg hij\né") for _ in range(n))
    parts = [text(n) for n in (150, 199, 200, 201, 230, 400, 900)]
    rows = [
        (i, "".join(rng.choice([text(rng.randrange(60)), rng.choice(parts)]) for _ in range(rng.randrange(6)))) for i in range(80)
    ]
    rows += [(200, "a" * 1000), (201, "abc" * 67), (202, "abc" * 66 + "ab"), (203, "ab" * 150), (204, None), (205, "")]
    return rows + [(206, "xyz" * 67 + text(30)), (207, text(90) + "q" * 199), (208, "z" * 200), (209, "y" * 201)]


@pytest.mark.parametrize("limits", [{}, {"bucket_segments": 40, "group_limit": 3}])
@pytest.mark.parametrize("odd", [False, True])
def test_suffix_dedup(spark, limits, odd):
    rows = dedup_rows()
    rows += [(None, rows[3][1] + "k"), (3, rows[3][1])] if odd else []
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])
    out = suffix_dedup(frame(spark, rows), **limits)
    got = Counter(tuple(r) for r in out.select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256)).collect())
    assert got == brute_dedup(rows)


def test_a_batch_is_cut_in_portions(monkeypatch):
    import pyarrow as pa

    from cohortlens.llm import suffix_dedup as s

    texts = ["é" * 300, "", "abc" * 200, "x" * 500]
    wanted = [[{"at": a, "anchor": a + i, "big": i == 2} for a in range(0, len(t), 50)] for i, t in enumerate(texts)]
    kind = pa.list_(pa.struct([("at", pa.int64()), ("anchor", pa.int64()), ("big", pa.bool_())]))
    batch = pa.record_batch([pa.array(range(4), pa.int64()), pa.array(texts), pa.array(wanted, kind)], ["rid", "text", "wanted"])
    want = [(i, w["at"], w["anchor"], w["big"], t.encode()[max(0, w["at"] - s.REACH) : w["at"] + LENGTH])
            for i, (t, own) in enumerate(zip(texts, wanted)) for w in own]
    for portion, parts in ((1 << 20, 1), (700, 3), (1, 3)):  # the empty text goes with its neighbour
        monkeypatch.setattr(s, "PORTION", portion)
        cut = list(s._cut([batch]))
        assert [tuple(r.values()) for b in cut for r in b.to_pylist()] == want and len(cut) >= parts


def test_column_hits_equal_the_definition():
    rng = np.random.default_rng(0)
    for _ in range(30):
        matrix = rng.integers(97, 99, (rng.integers(1, 12), 20)).astype(np.uint8)
        matrix[rng.random(matrix.shape) < 0.05] = 255
        got = column_hits(matrix, 6, 14)
        for c in range(15):
            cells = [bytes(r[c : c + 6]) for r in matrix]
            for i, x in enumerate(cells):
                assert got[i, c] == (255 not in x and cells.count(x) > 1)


def test_anchors_cross_blocks(monkeypatch):
    from cohortlens.llm import suffix_dedup as s

    data = np.random.default_rng(1).integers(97, 103, 5000).astype(np.uint8)
    whole = [np.concatenate(x) for x in zip(*anchors(data))]
    monkeypatch.setattr(s, "BLOCK", 700)
    parts = [np.concatenate(x) for x in zip(*anchors(data))]
    assert all((a == b).all() for a, b in zip(whole, parts))
