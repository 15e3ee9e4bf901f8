"""Context trees, co-training, mixing, sharding and extraction against brute force; the registry and the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.conftest import frame, sentence, word

import __spark_entry__ as contract
import corpus_pipeline
from cohortlens.llm import cotraining, mixing, registry
from cohortlens.llm.context_tree import DEPTH, END, Lookup, context_tree_scores
from cohortlens.llm.dom import article_blocks, read
from cohortlens.llm.sharding import SHARDS, TIE_BITS, _codes, kd_shards, DIMENSIONS
from cohortlens.llm.wrapper_induction import Tree, extract_pages, match, skeleton
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


# Context trees


def brute_tree(texts, train):
    """log10 probability of each text by context-tree weighting, with plain dictionaries and recursion."""
    count = defaultdict(lambda: [0, 0])
    below = defaultdict(set)
    grams = set()

    def decisions(data):
        full = bytes([END]) * DEPTH + data + bytes([END])
        for at in range(DEPTH, len(full)):
            context = full[at - DEPTH : at][::-1]
            for bit in range(8):
                yield context, (1 << bit) | full[at] >> (8 - bit), full[at] >> (7 - bit) & 1

    for data, learn in zip(texts, train):
        for context, node, bit in decisions(data):
            for d in range(DEPTH + 1):
                count[context[:d], node][bit] += learn
                if d:
                    below[context[: d - 1], node].add(context[:d])
            grams.add((context, node))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def weighted(context, node):
        if (context, node) not in memo:
            own = kt(*count[context, node])
            if len(context) == DEPTH:
                memo[context, node] = own, 1.0
            else:
                rest = sum(weighted(c, node)[0] for c in below[context, node])
                mixed = np.logaddexp(math.log(0.5) + own, math.log(0.5) + rest)
                memo[context, node] = mixed, math.exp(math.log(0.5) + own - mixed)
        return memo[context, node]

    out = []
    for data in texts:
        total = 0.0
        for context, node, bit in decisions(data):
            p = None
            for d in range(DEPTH, -1, -1):
                c = count[context[:d], node]
                own = (c[bit] + 0.5) / (sum(c) + 1)
                weight = weighted(context[:d], node)[1]
                p = own if p is None else weight * own + (1 - weight) * p
            total += math.log10(p)
        out.append(total)
    return out


@pytest.mark.parametrize("hot", [(1 << 20, 1 << 20), (40, 5)])
def test_context_tree(spark, hot):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["The", "cat", "sat", "été", "on", word(rng.randrange(50))]) for _ in range(rng.randrange(14)))) for i in range(30)]
    rows += [(100, None), (101, "  \n"), (102, "THE cat"), (3, rows[3][1])]
    train = [zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in rows]
    texts = [(t or "").encode().lower() for _, t in rows]
    tokens = [[*t.split(), None] for t in texts]
    seen = Counter(w for ws, learn in zip(tokens, train) if learn for w in ws)
    n, v = sum(seen.values()), len(seen)
    want = Counter()
    for (d, _), learn, ws, score in zip(rows, train, tokens, brute_tree(texts, train)):
        base = sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws)
        want[d, not learn, len(ws), sum(seen[w] > 0 for w in ws), n, round(base, 6), round(score, 6)] += 1
    got = context_tree_scores(frame(spark, rows), hot=hot, bucket_windows=100)
    assert Counter((*r[:5], round(r["base_score"], 6), round(r["score"], 6)) for r in got.collect()) == want


def test_lookup():
    rng = np.random.default_rng(0)
    for size in (0, 1, 5, 3000):
        keys = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        table = Lookup(keys, np.arange(len(keys), dtype=float))
        assert (table(keys) == np.arange(len(keys))).all()
        assert np.isnan(table(keys + np.uint64(1 << 63))).all()


# Co-training and mixing


def quality_corpus():
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        good, toxic = rng.random() < 0.6, rng.random() < 0.2
        words = [word(rng.randrange(300)) for _ in range(30)]
        if not good:
            words = [w + "!!" if rng.random() < 0.6 else w for w in words]
        if toxic:
            words += ["vile", "slur"]
        rows.append((i, " ".join(words), "en", f"s{rng.randrange(4)}"))
        labels.append((i, int(good), int(toxic), ""))
    return rows, labels


def test_cotraining_on_hidden_labels(spark):
    rows, labels = quality_corpus()
    known = spark.createDataFrame(labels[:250], "doc_id bigint, quality int, toxic int, score string")
    got = {r["doc_id"]: r for r in cotraining.cotrained_scores(frame(spark, rows), known, rounds=2).collect()}
    hidden = labels[250:]
    assert np.mean([(got[i]["score"] >= 0.5) == bool(q) for i, q, _, _ in hidden]) > 0.9
    assert np.mean([(got[i]["toxic_score"] >= 0.5) == bool(t) for i, _, t, _ in hidden]) > 0.9
    assert all(r["kept"] == (r["score"] >= 0.5 and r["toxic_score"] < 0.5) for r in got.values())


def test_pseudo_labels_come_from_the_other_view():
    """A confident content view changes the metadata counts only, and the other way round."""
    import pyarrow as pa

    rows = pa.record_batch(
        [
            pa.array([b"\1\0", b"\2\0"], pa.binary()), pa.array([[3], [4]], pa.list_(pa.int32())),
            pa.array([None, None], pa.int32()), pa.array([None, None], pa.int32()), pa.array([1, 1], pa.int32()),
        ],
        ["content", "metadata", "quality", "toxic", "fold"],
    )
    weights = {v: np.zeros((n, 2)) for v, n in cotraining.VIEWS.items()}
    weights["content"][1, 0] = 9.0
    flat = {v: np.zeros(2) for v in cotraining.VIEWS}
    scale = {v: np.array([[1.0, 1.0], [0.0, 0.0]]) for v in cotraining.VIEWS}
    out = [b.to_pylist() for b in cotraining._count([rows], cotraining.Model(weights, flat, scale, np.zeros(2)))]
    assert [(r["view"], r["feature"], r["c1"]) for part in out for r in part] == [("metadata", 3, 1), ("metadata", -1, 1)]


@pytest.mark.parametrize("max_rate", [None, 1.0])
def test_rates_match_targets(spark, max_rate):
    rng = np.random.default_rng(1)
    p = rng.dirichlet((0.5, 0.3, 0.4), 400)
    tokens = rng.integers(0, 500, 400)
    members = spark.createDataFrame(
        [(int(t), *map(float, x)) for t, x in zip(tokens, p)], "tokens bigint, p0 double, p1 double, p2 double"
    )
    weights = [0.5, 0.2, 0.3]
    got = mixing.fit_rates(members, weights, max_rate=max_rate, total=20_000.0 if max_rate else None).toPandas()
    rates = got.rate.to_numpy()
    totals = (got.tokens.to_numpy() * rates) @ got[["p0", "p1", "p2"]].to_numpy()
    assert rates.min() >= 0 and rates.max() <= (max_rate or np.inf)
    assert totals / totals.sum() == pytest.approx(weights, abs=1e-3)
    assert totals.sum() == pytest.approx(20_000 if max_rate else tokens.sum(), rel=1e-3)


def test_steps_of_the_rates_do_not_nest_without_end(spark, monkeypatch):
    """The driver analyses and compiles the plan of every look; it must not grow with the steps, and the rates stay the same."""
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    tokens = rng.integers(5, 400, 400)
    rows = [(i, int(t), *map(float, q)) for i, (t, q) in enumerate(zip(tokens, p))]
    members = spark.createDataFrame(rows, "rid bigint, tokens bigint, p0 double, p1 double, p2 double").coalesce(1)

    def rates():
        got = mixing.fit_rates(members, [0.92, 0.05, 0.03], max_rate=1.0, whole=0)
        assert got.columns == [*members.columns, "rate"]
        return got._jdf.queryExecution().optimizedPlan().toString().count("greatest("), got.orderBy("rid").toPandas().rate

    monkeypatch.setattr(mixing, "STEPS_NESTED", 2, raising=False)
    nested, found = rates()
    monkeypatch.setattr(mixing, "STEPS_NESTED", 1000, raising=False)
    deep, want = rates()
    assert nested < 2 < deep
    assert found.to_numpy() == pytest.approx(want.to_numpy(), rel=1e-9, abs=1e-12)


def test_posteriors_are_naive_bayes(spark):
    rows, labels = quality_corpus()
    known = mixing.quality_domains(spark.createDataFrame(labels[:300], "doc_id bigint, quality int, toxic int, score string"))
    got = mixing.mix_to_targets(frame(spark, rows), known, {"high": 0.6, "low": 0.3, "toxic": 0.1}).toPandas().set_index("doc_id")
    truth = {i: "toxic" if t else "high" if q else "low" for i, q, t, _ in labels}
    columns = ["p_high", "p_low", "p_toxic"]
    assert got[columns].sum(axis=1).to_numpy() == pytest.approx(np.ones(len(got)))
    best = got[columns].idxmax(axis=1)
    assert np.mean([best[i] == f"p_{truth[i]}" for i in range(300, 600)]) > 0.75
    assert (got.sort_index().n_tokens == [len(r[1].split()) for r in rows]).all()


@pytest.mark.parametrize("n_toxic, labelled", [(8, True), (0, True), (8, False)])
def test_scarce_unwanted_text_leaves_good_text_whole(spark, n_toxic, labelled):
    """One per cent or no toxic text, 15 per cent low text, or no labels at all: clean documents stay."""
    rng = random.Random(21)
    kinds = ["toxic"] * n_toxic + ["low"] * 120 + ["high"] * (800 - 120 - n_toxic)
    rows = [(i, " ".join(f"{kind}{word(rng.randrange(60))}" for _ in range(40)), "en", "s0") for i, kind in enumerate(kinds)]
    rows.append((5000, "words of no labelled document whatsoever", "en", "s0"))
    labels = [(i, int(k == "high"), int(k == "toxic"), "x") for i, k in enumerate(kinds) if labelled and i % 2]
    known = mixing.quality_domains(spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, score string"))
    kept = {r["doc_id"] for r in mixing.mixed_documents(frame(spark, rows), known, corpus_pipeline.MIX).select("doc_id").collect()}
    good = {i for i, k in enumerate(kinds) if k == "high"}
    assert len(good & kept) >= 0.99 * len(good) and 5000 in kept
    low = sum(kinds[i] == "low" for i in kept - {5000})
    assert low == 120 if not labelled else 15 < low < 70


# Sharding


def test_shards_equal_a_recursive_split(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, rng.randrange(1, 200)), rng.choice(["en", "de", None]), rng.choice(["hot"] * 3 + ["a", "b"])) for i in range(900)]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in kd_shards(docs).collect()}
    codes = docs.select("doc_id", F.array(*_codes(docs, DIMENSIONS)).alias("codes"), "text")
    half = F.lit(1 << TIE_BITS)
    tie = F.shiftleft(F.pmod(F.xxhash64("text"), half), TIE_BITS) + F.pmod(F.xxhash64("doc_id", F.lit("doc")), half)
    items = [(r["doc_id"], r["codes"], r["tie"], len(r["text"].encode()) + 16) for r in codes.withColumn("tie", tie).collect()]
    want = {}

    def split(part, first, shards):
        if shards == 1 or not part:
            want.update({x[0]: first for x in part})
            return
        widths = [max(x[1][k] for x in part) - min(x[1][k] for x in part) for k in range(len(DIMENSIONS))]
        dim = widths.index(max(widths))
        part = sorted(part, key=lambda x: (x[1][dim], x[2]))
        goal, at = sum(x[3] for x in part) * (shards // 2) // shards, 0
        done = 0
        while done + part[at][3] <= goal:
            done, at = done + part[at][3], at + 1
        at += 2 * (goal - done) > part[at][3]
        split(part[:at], first, shards // 2)
        split(part[at:], first + shards // 2, shards - shards // 2)

    split(items, 0, SHARDS)
    assert {i: r["shard"] for i, r in got.items()} == want
    by_shard = defaultdict(list)
    for r in got.values():
        by_shard[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by_shard.values())
    assert all(r["text_crc32"] == zlib.crc32(rows[i][1].encode()) and r["size"] == len(rows[i][1].encode()) + 16 for i, r in got.items())


def test_repeated_rows_are_divided(spark):
    rows = [(7, "one and the same text", "en", "hot")] * 4000
    got = Counter(r["shard"] for r in kd_shards(frame(spark, rows)).collect())
    assert len(got) == SHARDS and max(got.values()) - min(got.values()) <= 1


def test_numbers_fill_the_range_of_codes(spark):
    docs = spark.range(100).selectExpr("id AS doc_id", "'en' AS lang", "cast(null AS string) AS source", "id + 10 AS n_chars")
    ends = docs.select(*[c.alias(n) for c, n in zip(_codes(docs, DIMENSIONS), DIMENSIONS)]).agg(
        F.min("n_chars"), F.max("n_chars"), F.max("source")
    )
    assert ends.first()[:] == (0, (1 << 20) - 1, 0)


# Extraction


def page(article, notice, extra=""):
    return (
        "<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body class='has-sidebar'>"
        f"<header>Top</header><nav><ul><li>x<li>y</ul></nav><div class=cookie-notice>We use cookies</div><div id=wrap><article>"
        f"<h1>{article[0]}</h1>" + "".join(f"<p>{x}" for x in article[1:]) + f"<div class=box>{notice}</div></article>{extra}</div>"
        "<div class='comments'><p>first!</p></div><aside>side</aside><form><p>Name</p></form><footer>end</footer></body></html>"
    )


def test_article_of_a_page():
    html = page(["A &amp; B", "one <b>two\n three<br>four", "fi<i>ve</i>&nbsp;six&#33;"], "n")
    found = read(html)
    assert [found.blocks[k][1] for k in article_blocks(found)] == ["A & B", "one two three four", "five six!", "n"]


@pytest.mark.parametrize("html", ["", "<", "<p", "a<!-- x", "<script>x", "</p></p>", "<div>" * 5000 + "deep", "<a href='x>y</a> z", "plain &lt; text"])
def test_broken_markup(html):
    found = read(html)
    assert all(t for _, t, _ in found.blocks) and article_blocks(found) is not None


@pytest.mark.parametrize(
    "html, wanted",
    [
        ("<main><div>{0}</div><article>short teaser</article></main>", "{0}"),
        ("<div>{0}</div><article>short teaser</article>", "{0}"),
        ("<div><article>{0}</article><article>{1}</article><article>{2}</article></div>", "{0}|{1}|{2}"),
        ("<div class=text>{0}</div><p>{1}</p><div class=text>{2}</div><div class='entry body'><p>{3}</p></div>", "{0}|{1}|{2}|{3}"),
        ("<article><p>{0}</p><article>{1}</article></article><div>unmarked</div><ul><li><a href=x>link</a></ul>", "{0}|{1}"),
        ("<article><a href=x>{0}</a></article><p>short teaser</p>", "{0}"),
    ],
)
def test_all_parts_of_an_article_stay(html, wanted):
    rng = random.Random(6)
    parts = [sentence(rng, 30) for _ in range(4)]
    found = read(f"<html><body><nav>top</nav>{html.format(*parts)}<footer>end</footer></body></html>")
    got = [found.blocks[k][1] for k in article_blocks(found)]
    wanted = wanted.format(*parts).split("|")
    assert [x for x in got if x in parts] == wanted and set(got) <= {*wanted, "short teaser"}


@pytest.mark.parametrize("depth", [70, 100, 3000])
def test_deep_elements_close_themselves(depth):
    """Text after nested elements stays in the article, boilerplate inside them stays out, trees of any depth are matched."""
    deep = "<div>" * depth + "<nav>links</nav><div class='ad'>buy</div>deep text" + "</div>" * depth
    found = read(f"<body><div id=top><article>{deep}<p>first after</p><p>second after</p></article></div><p>foot</p></body>")
    assert [found.blocks[k][1] for k in article_blocks(found)] == ["deep text", "first after", "second after"]
    labels, parents, _ = skeleton(found)
    assert match(Tree(labels, parents), Tree(labels, parents)) == {i: i for i in range(len(labels))}


def test_constant_slots_are_template(spark):
    rng = random.Random(3)
    rows = []
    for i in range(9):
        extra = "<section><p>more</p></section>" if i % 2 else ""
        rows.append((i, f"https://site.example/p{i}", page([sentence(rng, 5), *(sentence(rng, 20) for _ in range(i % 3 + 1))], "Subscribe to our list now", extra)))
    same = page(["one title", *["same text " + sentence(rng, 12)] * 2], "Only here")
    rows += [(100 + i, "http://copies.example/", same) for i in range(6)]  # copies are one page: nothing is template
    rows += [(200, "http://alone.example/a", rows[0][2])]
    docs = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in extract_pages(docs).collect()}
    assert all("Subscribe" not in got[i]["text"] and got[i]["n_template"] == 1 for i in range(9))
    assert all(got[100 + i]["text"].endswith("\nOnly here") for i in range(6)) and got[200]["text"].endswith("list now")
    assert got[0]["text"].count("\n") == 1


def test_tree_matching_is_largest():
    def brute(a, b, i, j):
        if a.labels[i] != b.labels[j]:
            return 0
        best = [[0] * (len(b.children[j]) + 1) for _ in range(len(a.children[i]) + 1)]
        for x, u in enumerate(a.children[i], 1):
            for y, v in enumerate(b.children[j], 1):
                best[x][y] = max(best[x - 1][y], best[x][y - 1], best[x - 1][y - 1] + brute(a, b, u, v))
        return best[-1][-1] + 1

    rng = random.Random(1)
    for _ in range(200):
        trees = []
        for _ in range(2):
            n = rng.randrange(1, 9)
            trees.append(Tree([0] + [rng.randrange(2) for _ in range(n)], [-1] + [rng.randrange(k + 1) for k in range(n)]))
        pairs = match(*trees)
        assert len(pairs) == brute(*trees, 0, 0)
        assert all(trees[0].labels[i] == trees[1].labels[j] for j, i in pairs.items())
        assert all(j == 0 or pairs[trees[1].parents[j]] == trees[0].parents[i] for j, i in pairs.items())


def test_long_child_lists_are_matched_in_full():
    """A list of 260 children against 260: the optional first item shifts the rest, none may be lost for the length of the list."""
    items = [1, 2, 1, 3] * 65
    left = Tree([0, *items], [-1] + [0] * len(items))
    right = Tree([0, 3, *items], [-1] + [0] * (len(items) + 1))
    assert match(left, right) == {0: 0} | {j + 1: j for j in range(1, len(items) + 1)}


# Registry and pipeline


def test_registry_names():
    names = set(contract.queries())
    assert {n for n in names if n.startswith("op")} == set(registry.REGISTRY) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in registry.REGISTRY) == list(range(1, 11))
    assert {"op3_jaccard_join", "op10_line_frequency"} <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", ["op3_jaccard_join", "op10_line_frequency"])
def test_queries_equal_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    want = con.execute(contract.oracle_sql()[name]).df()
    got = contract.queries()[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    a, b = (x[columns].sort_values("doc_id").reset_index(drop=True) for x in (got, want))
    assert a.equals(b.astype(a.dtypes.to_dict()))


def test_pipeline_stages_take_effect(spark, tmp_path):
    """The kept ids of every stage against brute force; the draw of the mixing stage against its rates."""
    from cohortlens.llm.decontamination import contaminated
    from llm.test_text_operators import base_counts, brute_components

    rng = random.Random(12)
    rows = [(i, sentence(rng, 40, 3000), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1] + " tail", "en", "s0") for i in range(10)]
    rows += [(200, "too short", "en", "s0"), (201, "same five words here again " * 9, "en", "s0")]
    items = [(1, " ".join(rows[5][1].split()[3:33])), (2, sentence(rng, 30, 3000))]
    folder = str(tmp_path)
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, int(i % 4 > 0), int(i % 9 == 0)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    texts = {r[0]: r[1] for r in rows}
    counts = {i: base_counts(t) for i, t in texts.items()}
    first = {i for i, n in counts.items() if n[0] >= 10 and 100 * n[4] <= 20 * n[0]}
    assert kept[0] == first
    second = {i for i, (_, c) in brute_components([(i, texts[i]) for i in sorted(first)]).items() if i == c}
    assert kept[1] == second and kept[2] == second - {5}
    assert kept[3] <= kept[2] and kept[4] == kept[3] and len(kept[3]) > 0.5 * len(kept[2])
    ran = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in ran.collect()} == kept[4] and "shard" in ran.columns
    assert contaminated(ran.join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id").select("doc_id", "text"), spark.read.parquet(f"{folder}/benchmark.parquet")).count() == 0
