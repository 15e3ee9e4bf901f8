"""HTML extraction by wrapper induction.

Pages of one host are cut to skeletons (element names with their classes, runs of equal leaf siblings folded into one) and
aligned by simple tree matching: the wrapper starts as the largest skeleton, each other one is matched against it and adds
what it has more. A wrapper node is a slot. A text that fills its slot on most pages of the host is template; what varies is
content. Content is looked for where the elements, roles and names of the page allow it (``dom.article_blocks``).

Pages that copy each other would make their own article look constant, so pages are told apart by their longest block: a
template text must stand in at least ``MIN_PAGES`` different pages and in half of those that fill the slot.

Distribution: only skeletons and hashes are shuffled by host, in parts of at most about ``PART_PAGES`` pages, so a host of any
size is many tasks; slots are named by their path, which joins the parts. Counts are aggregates. The text of the pages is
read again and joined once with the numbers of the blocks to leave out.

Defined cases: a null or empty page has empty text; a null url is a host of its own; a host with fewer than ``MIN_PAGES``
different pages has no template; repeated rows each get their text; broken markup is read as far as it goes.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.dom import Page, article_blocks, read
from cohortlens.llm.tables import numbered, written

PART_PAGES = 256
MIN_PAGES = 3


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Tree:
    """Nodes in document order: label, parent, children."""

    def __init__(self, labels: Sequence[int], parents: Sequence[int]) -> None:
        self.labels, self.parents = list(labels), list(parents)
        self.children: list[list[int]] = [[] for _ in self.labels]
        for i, p in enumerate(self.parents):
            if p >= 0:
                self.children[p].append(i)

    def add(self, label: int, parent: int) -> int:
        self.labels.append(label)
        self.parents.append(parent)
        self.children.append([])
        self.children[parent].append(len(self.labels) - 1)
        return len(self.labels) - 1


def skeleton(page: Page) -> tuple[list[int], list[int], list[int]]:
    """(labels, parents, skeleton node of each page node)."""
    labels, parents, of = [], [], [0] * len(page.nodes)
    last: dict[int, tuple[int, str]] = {}
    for i, n in enumerate(page.nodes):
        up = of[n.parent] if n.parent >= 0 else -1
        leaf = not n.children or all(not page.nodes[c].children for c in n.children)
        before = last.get(up)
        if leaf and before and before[1] == n.label:
            of[i] = before[0]
            continue
        of[i] = len(labels)
        labels.append(_hash(n.label))
        parents.append(up)
        last[up] = (of[i], n.label if leaf else "")
    return labels, parents, of


def _kinds(tree: Tree, known: dict) -> tuple[list[int], list[int]]:
    """(kind, nodes) of the subtree at every node: equal subtrees have one kind, in all trees that share ``known``."""
    kinds, sizes = [0] * len(tree.labels), [1] * len(tree.labels)
    for i in range(len(tree.labels) - 1, -1, -1):  # children stand behind their parents
        shape = (tree.labels[i], *[kinds[c] for c in tree.children[i]])
        kinds[i] = known.setdefault(shape, len(known))
        sizes[i] += sum(sizes[c] for c in tree.children[i])
    return kinds, sizes


def _weights(left: list[int], right: list[int], sizes: dict[tuple[int, int], int]):
    """Function: row of weights of one child on the left against all on the right."""
    kinds, place = np.unique(right, return_inverse=True)
    rows: dict[int, np.ndarray] = {}

    def row(u: int) -> np.ndarray:
        if u not in rows:
            rows[u] = np.array([sizes.get((u, v), 0) for v in kinds.tolist()], np.int64)
        return rows[u][place]

    return [lambda u=u: row(u) for u in left]


def _next_row(before: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Row of the table of the best total of every pair of beginnings."""
    here = before.copy()
    np.maximum(before[1:], before[:-1] + weights, out=here[1:])
    return np.maximum.accumulate(here)


def _total(left: list[int], right: list[int], sizes: dict[tuple[int, int], int]) -> int:
    if not left or not right:
        return 0
    table = np.zeros(len(right) + 1, np.int64)
    for weights in _weights(left, right, sizes):
        table = _next_row(table, weights())
    return int(table[-1])


def _aligned(left: list[int], right: list[int], sizes: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """Positions matched, last first. One row of the table in about the root of their number is held, the others are made again on the way back."""
    weights = _weights(left, right, sizes)
    step = max(1, int(len(left) ** 0.5))
    marks, table = [], np.zeros(len(right) + 1, np.int64)
    for x, row in enumerate(weights):
        if x % step == 0:
            marks.append(table)
        table = _next_row(table, row())
    pairs, x, y, at, rows = [], len(left), len(right), -1, []
    while x and y:
        if (x - 1) // step != at:
            at = (x - 1) // step
            rows = [marks[at]]
            for row in weights[at * step : min(len(left), (at + 1) * step)]:
                rows.append(_next_row(rows[-1], row()))
        here, above = rows[x - at * step], rows[x - at * step - 1]
        if here[y] == above[y]:
            x -= 1
        elif here[y] == here[y - 1]:
            y -= 1
        else:
            x, y = x - 1, y - 1
            pairs.append((x, y))
    return pairs


def match(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: the largest set of node pairs (b -> a) that keeps labels, ancestors and order of siblings.

    A pair of subtrees is weighed once per pair of kinds, and equal subtrees match node by node, so long child lists cost a table of
    numbers whose rows are made one at a time.
    """
    if a.labels[0] != b.labels[0]:
        return {}
    known: dict[tuple, int] = {}
    (kinds_a, nodes_a), (kinds_b, _) = _kinds(a, known), _kinds(b, known)
    of_a, of_b = ({k: i for i, k in enumerate(kinds)} for kinds in (kinds_a, kinds_b))  # a node of every kind

    def lists(k: int, m: int) -> tuple[list[int], list[int]]:
        return [kinds_a[c] for c in a.children[of_a[k]]], [kinds_b[c] for c in b.children[of_b[m]]]

    sizes: dict[tuple[int, int], int] = {}
    # A pair is reached from pairs of parents; no recursion, whatever the depth. Parts are of smaller kinds than the whole.
    reached = {(kinds_a[0], kinds_b[0])}
    todo = list(reached)
    while todo:
        k, m = todo.pop()
        if k == m:
            continue
        left, right = lists(k, m)
        by_label: dict[int, list[int]] = {}
        for v in set(right):
            by_label.setdefault(b.labels[of_b[v]], []).append(v)
        for u in set(left):
            new = [(u, v) for v in by_label.get(a.labels[of_a[u]], ()) if (u, v) not in reached]
            reached.update(new)
            todo.extend(new)
    for k, m in sorted(reached):
        sizes[k, m] = nodes_a[of_a[k]] if k == m else _total(*lists(k, m), sizes) + 1

    out: dict[int, int] = {}
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    pairs = [(0, 0)]
    while pairs:
        i, j = pairs.pop()
        out[j] = i
        key = kinds_a[i], kinds_b[j]
        if key[0] == key[1]:
            pairs.extend(zip(a.children[i], b.children[j]))
            continue
        if key not in chosen:
            chosen[key] = _aligned(*lists(*key), sizes)
        pairs.extend((a.children[i][x], b.children[j][y]) for x, y in chosen[key])
    return out


def _skeletons(batches):
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for rid, html in zip(batch.column("rid").to_pylist(), batch.column("html").to_pylist()):
            page = read(html)
            blocks = article_blocks(page)
            labels, parents, of = skeleton(page)
            longest = max((page.blocks[k][1] for k in blocks), key=lambda t: (len(t), t), default="")
            row = (
                rid,
                np.array(labels, np.int64).tobytes(),
                np.array(parents, np.int32).tobytes(),
                _hash(longest),
                [of[page.blocks[k][0]] for k in blocks],
                [_hash(page.blocks[k][1]) for k in blocks],
            )
            for column, x in zip(out, row):
                column.append(x)
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        names = ["labels", "parents", "page", "slots", "texts"]
        yield pa.record_batch(
            [pa.array(out[0], kinds[0]), batch.column("host"), *[pa.array(c, k) for c, k in zip(out[1:], kinds[1:])]],
            ["rid", "host", *names],
        )


def _paths(tree: Tree) -> list[int]:
    """A name for every wrapper node: its labels from the root, and its number among equal siblings."""
    paths = [0] * len(tree.labels)
    for i, kids in enumerate(tree.children):
        seen: dict[int, int] = {}
        for c in kids:
            k = seen[tree.labels[c]] = seen.get(tree.labels[c], 0) + 1
            paths[c] = _hash(f"{paths[i]}/{tree.labels[c]}:{k}")
    return paths


def _align(group: pa.Table) -> pa.Table:
    """One row per content block of a part of a host: host, rid, number of the block, slot, text, page."""
    rows = group.to_pylist()
    shapes: dict[tuple[bytes, bytes], Tree] = {}
    for r in rows:
        key = (r["labels"], r["parents"])
        if key not in shapes:
            shapes[key] = Tree(np.frombuffer(key[0], np.int64).tolist(), np.frombuffer(key[1], np.int32).tolist())
    order = sorted(shapes, key=lambda k: (-len(k[0]), k))
    wrapper = Tree(shapes[order[0]].labels, shapes[order[0]].parents)
    places: dict[tuple[bytes, bytes], list[int]] = {}
    for key in order:
        tree = shapes[key]
        found = match(wrapper, tree)
        place = [found.get(i, -1) for i in range(len(tree.labels))]
        for i, p in enumerate(place):
            if p < 0:
                place[i] = wrapper.add(tree.labels[i], place[tree.parents[i]]) if i else 0
        places[key] = place
    paths = _paths(wrapper)
    out: dict[str, list] = {"host": [], "rid": [], "at": [], "slot": [], "text": [], "page": []}
    for r in rows:
        place = places[r["labels"], r["parents"]]
        for k, (node, text) in enumerate(zip(r["slots"], r["texts"])):
            for column, x in zip(out.values(), (r["host"], r["rid"], k, paths[place[node]], text, r["page"])):
                column.append(x)
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.table({n: pa.array(c, k) for (n, c), k in zip(out.items(), kinds)})


def template_blocks(pages: DataFrame) -> DataFrame:
    """(rid, gone): numbers of the content blocks of a page that are template. ``pages`` is (rid, host, html)."""
    kinds = "rid bigint, host string, labels binary, parents binary, page bigint, slots array<int>, texts array<bigint>"
    cut = written(pages.select("rid", "host", "html").mapInArrow(_skeletons, kinds), "page-skeletons")
    parts = cut.groupBy("host").agg(F.count(F.lit(1)).alias("n")).filter(f"n >= {MIN_PAGES}")
    parts = parts.select("host", F.expr(f"(n + {PART_PAGES - 1}) div {PART_PAGES}").alias("parts"))
    dealt = cut.join(parts, "host").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts"))).drop("parts")
    rows = dealt.groupBy("host", "part").applyInArrow(
        _align, "host string, rid bigint, at int, slot bigint, text bigint, page bigint"
    )
    rows = written(rows, "page-slots")
    filled = rows.select("host", "slot", "page").distinct().groupBy("host", "slot").agg(F.count(F.lit(1)).alias("of"))
    texts = rows.select("host", "slot", "text", "page").distinct().groupBy("host", "slot", "text")
    texts = texts.agg(F.count(F.lit(1)).alias("n")).filter(f"n >= {MIN_PAGES}")
    constant = texts.join(filled, ["host", "slot"]).filter("2 * n >= of").select("host", "slot", "text")
    gone = rows.join(constant, ["host", "slot", "text"], "left_semi")
    return gone.groupBy("rid").agg(F.collect_set("at").alias("gone"))


def _blocks(batches):
    for batch in batches:
        texts = []
        for html in batch.column("html").to_pylist():
            page = read(html)
            texts.append([page.blocks[k][1] for k in article_blocks(page)])
        yield pa.record_batch(
            [batch.column("rid"), batch.column("page_id"), batch.column("url"), pa.array(texts, pa.list_(pa.string()))],
            ["rid", "page_id", "url", "blocks"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_blocks, n_template: the main text of every page."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]+)", 1))
    pages = numbered(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host")), "page_id")
    gone = template_blocks(pages)
    kind = pages.schema["page_id"].dataType.simpleString()
    read_ = pages.select("rid", "page_id", "url", "html").mapInArrow(
        _blocks, f"rid bigint, page_id {kind}, url string, blocks array<string>"
    )
    joined = read_.join(gone, "rid", "left")
    left = F.filter("blocks", lambda _, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i))
    return joined.select(
        "page_id",
        "url",
        F.array_join(left, "\n").alias("text"),
        F.size("blocks").alias("n_blocks"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_template"),
    )
