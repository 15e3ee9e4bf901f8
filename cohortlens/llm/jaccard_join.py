"""N-gram Jaccard join: size-aware, heavy sets by inverted lists, light sets by fixed-size subsets.

A document's set holds its distinct word windows; equal sets are one *class* and are handled once. Two sets of sizes a and
b link at threshold t when they share at least ``need(a, b)`` windows.

* **Light sets** (size up to the boundary) enumerate, for every partner size, all subsets of exactly ``need(a, b)``
  windows. Two sets that meet in a subset are linked without a check, so a group needs only a star of links.
* **Heavy sets** scan inverted lists. A set of n windows can spare ``n - ceil(t n)`` of them, so a link shows among any
  ``n - ceil(t n) + 1``. First the windows of smallest hash decide which sets can have a partner at all: enough of them
  must occur in another set. The others order their windows by document frequency, rarest first, and only the lists of
  that prefix are scanned. A long list is not paired with itself: pivots (1 of each salt) are compared with the members
  that are not yet connected to them, links are contracted to components, a list whose members are all connected is
  dropped, and the number of salts grows until no list is left. A pair is passed over in a list whose rank leaves too few
  windows for a link. Every pair is thus compared in the first list that it shares, or already connected; no link between
  components is lost.
* **The boundary** is the size that makes enumerated subsets plus scanned list entries least, over the measured sizes.

Defined cases: a null or empty text has no windows and is linked with nothing; fewer words than the window count as one
window; repeated rows are one class; a null doc_id takes part, and its component is the smallest non-null id (or null).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.functions.durable import durable
from cohortlens.llm.components import components, tasks_for
from cohortlens.llm.hashing import mix, shingle_sets
from cohortlens.llm.tables import discard, numbered, text_of, written

WINDOW = 5
NUM, DEN = 80, 100
#: Largest size for which subsets are considered at all.
MAX_LIGHT = 24
#: List entries that one task of the first scan compares.
BLOCK_ENTRIES = 2_000_000
#: Pivots of a list in the first round; each round takes that many times more.
FIRST_SALTS = 16
COUNTED = np.uint32(1 << 31)


def need(a: int, b: int) -> int:
    """Smallest intersection that links sets of sizes a and b."""
    return -(-NUM * (a + b) // (NUM + DEN))


def spare(n: int | np.ndarray) -> int | np.ndarray:
    """Windows that a set of n can miss in a partner."""
    return n - (-(-NUM * n // DEN))


def _slack(n):
    """How many of its first windows must be shared, at least, in the first scan; the prefix is longer by one less."""
    return np.maximum(1, n // 20)


def _classes_of(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
    for s in shingle_sets(texts, WINDOW):
        yield blake2b(s.tobytes(), digest_size=16).digest(), s


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode().lower() for t in batch.column("text").to_pylist()]


def _measure(batches, keys: list[str]):
    for batch in batches:
        found = [(len(s), c) for c, s in _classes_of(_texts(batch))]
        n, c = (list(x) for x in zip(*found)) if found else ([], [])
        yield pa.record_batch(
            [*[batch.column(k) for k in keys], pa.array(n, pa.int64()), pa.array(c, pa.binary())], [*keys, "n", "cls"]
        )


def _blocks(batches, buckets: int, boundary: int):
    """Per batch and bucket of the hash range: first windows of the heavy sets, and counts already known to be shared."""
    for batch in batches:
        sets = {}
        for c, s in _classes_of(_texts(batch)):
            if len(s) >= boundary and c not in sets:
                sets[c] = s[: spare(len(s)) + int(_slack(len(s)))]
        if not sets:
            continue
        names = np.frombuffer(b"".join(sets), "S16")
        tokens = mix(np.concatenate(list(sets.values())))
        owner = np.repeat(np.arange(len(names)), [len(s) for s in sets.values()])
        unique, first, which, times = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
        counts = np.bincount(owner[times[which] > 1], minlength=len(names)).astype(np.uint32)
        marks = owner[first].astype(np.uint32) | np.where(times > 1, COUNTED, np.uint32(0))
        where = (unique >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)  # the order of unique is that of where
        cuts = np.searchsorted(where, np.arange(buckets + 1).astype(np.uint64))
        out = []
        for k in range(buckets):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                own, local = np.unique(marks[a:b] & ~COUNTED, return_inverse=True)
                local = local.astype(np.uint32) | (marks[a:b] & COUNTED)
                out.append((k, unique[a:b].astype(np.uint32).tobytes(), local.tobytes(), names[own].tobytes(), None))
        out.append((int(first[0]) % buckets, None, None, names.tobytes(), counts.tobytes()))
        columns = list(zip(*out))
        kinds = [pa.int32(), *[pa.binary()] * 4]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "tokens", "owners", "names", "counts"])


def _shared_in_bucket(group: pa.Table) -> pa.Table:
    """(cls, shared): windows of each set that another set has, in one bucket.

    A class whose copies lie in several batches may count a window more than once: it then stays a candidate longer.
    """
    names, tokens, owners, marks, extra = [], [], [], [], []
    for r in group.to_pylist():
        own = np.frombuffer(r["names"], "S16")
        names.append(own)
        if r["counts"] is not None:
            extra.append((sum(map(len, names[:-1])), np.frombuffer(r["counts"], np.uint32)))
            continue
        mark = np.frombuffer(r["owners"], np.uint32)
        tokens.append(np.frombuffer(r["tokens"], np.uint32))
        owners.append((mark & ~COUNTED).astype(np.int64) + sum(map(len, names[:-1])))
        marks.append((mark & COUNTED) != 0)
    all_names = np.concatenate(names)
    ids, local = np.unique(all_names, return_inverse=True)
    total = np.zeros(len(ids), np.int64)
    for at, counts in extra:
        np.add.at(total, local[at : at + len(counts)], counts)
    if tokens:
        token, owner, mark = np.concatenate(tokens), local[np.concatenate(owners)], np.concatenate(marks)
        order = np.lexsort((owner, token))
        token, owner, mark = token[order], owner[order], mark[order]
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(token))))
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])))
        shared = (np.add.reduceat(new.astype(np.int64), start) > 1) | np.logical_or.reduceat(mark, start)
        counted = np.logical_or.reduceat(mark, np.flatnonzero(new))  # this set has counted the window itself
        take = shared[run[new]] & ~counted
        total += np.bincount(owner[new][take], minlength=len(ids))
    keep = total > 0
    raw = ids[keep].tobytes()
    found = [raw[i : i + 16] for i in range(0, len(raw), 16)]
    return pa.table({"cls": pa.array(found, pa.binary()), "shared": pa.array(total[keep], pa.int64())})


def _sets(batches):
    for batch in batches:
        found = {c: s for c, s in _classes_of(_texts(batch)) if len(s)}
        sets = pa.array([s.view(np.int64) for s in found.values()], pa.list_(pa.int64()))
        yield pa.record_batch(
            [pa.array(list(found), pa.binary()), pa.array([len(s) for s in found.values()], pa.int64()), sets], ["cls", "n", "shingles"]
        )


def subsets_of(n: int, boundary: int) -> list[tuple[int, int, int]]:
    """(smaller size, larger size, subset size) for every partner size of a light set of n windows."""
    sizes = [m for m in range(1, boundary + 1) if need(n, m) <= min(n, m)]
    return [(min(n, m), max(n, m), need(n, m)) for m in sizes]


def choose_boundary(sizes: dict[int, int]) -> int:
    """Boundary of least cost: enumerated subsets of the light sets against list entries of the heavy ones.

    ``sizes`` counts sets of up to ``MAX_LIGHT`` windows; larger sets are heavy anyway. A window of a heavy set is moved
    about three times (first scan, frequency, prefix).
    """
    light = heavy = 0
    best = (0, 0)
    for n in range(1, MAX_LIGHT + 1):
        light += sizes.get(n, 0) * sum(comb(n, c) for _, _, c in subsets_of(n, MAX_LIGHT))
        heavy += sizes.get(n, 0) * 3 * n
        best = min(best, (light - heavy, n))
    return best[1]


def _subset_keys(batches, boundary: int):
    for batch in batches:
        keys, names, lows = [], [], []
        for c, s in zip(batch.column("cls").to_pylist(), batch.column("shingles").to_pylist()):
            for low, high, size in subsets_of(len(s), boundary):
                for part in combinations(s, size):
                    head = np.array([low, high, *part], np.int64).tobytes()
                    keys.append(blake2b(head, digest_size=16).digest())
                    names.append(c)
                    lows.append(len(s) == low)
            if len(keys) > 50_000:
                yield _key_batch(keys, names, lows)
                keys, names, lows = [], [], []
        yield _key_batch(keys, names, lows)


def _key_batch(keys: list[bytes], names: list[bytes], lows: list[bool]) -> pa.RecordBatch:
    columns = [pa.array(keys, pa.binary()), pa.array(names, pa.binary()), pa.array(lows, pa.bool_())]
    return pa.record_batch(columns, ["key", "cls", "low"])


def light_links(sets: DataFrame, boundary: int) -> DataFrame:
    """Links (a, b) between sets of up to ``boundary`` windows.

    A key stands for a pair of sizes and a subset. Whoever shares it with a set of the smaller size is linked to it, so
    the smallest of those is the centre of a star; larger sets alone prove nothing to each other.
    """
    kinds = "key binary, cls binary, low boolean"
    keys = sets.filter(F.col("n") <= boundary).mapInArrow(lambda b: _subset_keys(b, boundary), kinds)
    centre = keys.groupBy("key").agg(F.min(F.when(F.col("low"), F.col("cls"))).alias("a"), F.count(F.lit(1)).alias("c"))
    centre = centre.filter("c > 1 and a is not null").drop("c")
    return keys.join(centre, "key").filter("a <> cls").select("a", F.col("cls").alias("b")).distinct()


def prefix_lists(sets: DataFrame) -> DataFrame:
    """Inverted lists (token, cls, n, left) over the rarest windows of each set, without windows of one set only.

    ``left`` counts the set's windows from this one on in the order of rarity. If two sets meet first in this list, they
    share at most the lesser ``left``.
    """
    tokens = sets.select("cls", "n", F.explode("shingles").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = tokens.join(often, "token").groupBy("cls", "n").agg(F.collect_list(F.struct("df", "token")).alias("own"))
    alone = F.col("n") - F.size("own")
    least = F.col("n") - F.expr(f"({NUM} * n + {DEN - 1}) div {DEN}") + 1
    rare = shared.withColumn("take", (least - alone).cast("int")).filter("take > 0")
    ordered = F.slice(F.array_sort("own"), 1, F.col("take"))
    listed = rare.select("cls", "n", F.size("own").alias("common"), F.posexplode(ordered).alias("at", "x"))
    return listed.select(F.col("x.token").alias("token"), "cls", "n", (F.col("common") - F.col("at")).alias("left"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return both.filter(DEN * common >= NUM * union).select("a", "b")


def linked_roots(lists: DataFrame, sets: DataFrame, boundary: int, known: DataFrame) -> DataFrame:
    """(node, root) of the components that ``known`` and the links among the sets of each list make."""
    links = durable(known.select("a", "b"))
    found = None
    lists = durable(lists.withColumn("comp", F.col("cls")))
    salts = FIRST_SALTS
    while rows := lists.count():
        tasks = tasks_for(rows)
        lists = lists.coalesce(tasks)
        salt = F.pmod(F.xxhash64("cls", F.lit(salts)), F.lit(salts))
        pivots = lists.groupBy("token", salt.alias("salt")).agg(F.min(F.struct("cls", "n", "left", "comp")).alias("p"))
        pivots = durable(pivots.select("token", "p.*").coalesce(tasks))
        pivot = pivots.select(*[F.col(c).alias(f"p_{c}") for c in pivots.columns])
        met = lists.join(pivot, lists["token"] == pivot["p_token"]).filter(
            (F.col("comp") != F.col("p_comp"))
            & (F.greatest("n", "p_n") > boundary)
            & ((NUM + DEN) * F.least("left", "p_left") >= NUM * (F.col("n") + F.col("p_n")))
        )
        pairs = met.select(F.least("cls", "p_cls").alias("a"), F.greatest("cls", "p_cls").alias("b"))
        pairs = pairs.coalesce(tasks).distinct().coalesce(tasks)
        links = durable(links.union(_verified(pairs, sets).coalesce(tasks)))
        found = components(links)
        roots = found.withColumnRenamed("node", "cls")
        rest = lists.join(pivots.select("token", "cls"), ["token", "cls"], "left_anti").drop("comp").coalesce(tasks)
        rest = rest.join(roots, "cls", "left").select("token", "cls", "n", "left", F.coalesce("root", "cls").alias("comp"))
        rest = durable(rest.coalesce(tasks))
        apart = rest.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y")
        lists = durable(rest.join(apart.select("token"), "token", "left_semi").coalesce(tasks))
        salts *= FIRST_SALTS
    return components(links) if found is None else found


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The columns of ``docs`` but text, with n and cls; and cls, rep, class_size, root (of the group of linked texts) of the classes."""
    keys = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keys)
    measured = written(docs.mapInArrow(lambda b: _measure(b, keys), f"{kinds}, n bigint, cls binary"), "jaccard-sizes")
    classes = measured.filter("n > 0").groupBy("cls", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("class_size"))
    classes = written(classes, "jaccard-classes")
    sizes = classes.groupBy(F.least("n", F.lit(MAX_LIGHT + 1)).alias("n")).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    found = sizes.collect()  # at most MAX_LIGHT + 1 rows
    boundary = choose_boundary({r["n"]: r["c"] for r in found})
    buckets = max(1, sum(r["t"] for r in found) // (4 * BLOCK_ENTRIES))
    lowest = -(-NUM * (boundary + 1) // DEN)  # smallest partner of a heavy set
    kinds = "bucket int, tokens binary, owners binary, names binary, counts binary"
    blocks = docs.mapInArrow(lambda b: _blocks(b, buckets, lowest), kinds)
    shared = blocks.groupBy("bucket").applyInArrow(_shared_in_bucket, "cls binary, shared bigint")
    shared = shared.groupBy("cls").agg(F.sum("shared").alias("shared"))
    alive = classes.join(shared, "cls", "left").filter(
        (F.col("shared") >= F.greatest(F.lit(1), F.expr("n div 20"))) | (F.col("n") <= boundary)
    )
    alive = durable(alive.select("cls", "rep"))
    reps = alive.select(F.col("rep").alias("rep_id")).distinct()
    mine = docs.join(reps, docs["doc_id"].eqNullSafe(reps["rep_id"]), "left_semi")
    sets = mine.mapInArrow(_sets, "cls binary, n bigint, shingles array<bigint>").dropDuplicates(["cls"])
    sets = written(sets.join(alive.select("cls"), "cls", "left_semi"), "jaccard-sets")
    light = light_links(sets, boundary)
    heavy = sets.filter(F.col("n") >= lowest)
    roots = linked_roots(prefix_lists(heavy), heavy, boundary, light)
    discard(sets)
    named = classes.select("cls", "rep", "class_size").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    return measured, named.withColumn("root", F.coalesce("root", "cls"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, class_size: one row per document."""
    measured, named = _linked(docs.select("doc_id", text_of(docs).alias("text")))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    out = measured.join(named.join(least, "root").select("cls", "component_id", "class_size"), "cls", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
    )


def one_per_group(docs: DataFrame) -> DataFrame:
    """Documents with one kept per group of linked texts: a row of the smallest id, once; columns as they came.

    Empty texts are linked with nothing and stay. Rows are told apart by a number, so that only the numbers of kept rows
    are gathered by group; the text crosses one shuffle, the semi join on that number.
    """
    docs = numbered(docs, name="_row")
    measured, named = _linked(docs.select("doc_id", "_row", text_of(docs).alias("text")))
    linked = measured.join(named.select("cls", "root"), "cls", "left")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    alone = F.when(F.col("n") == 0, F.col("_row")).alias("_alone")
    kept = linked.groupBy("root", alone).agg(F.min_by("_row", order).alias("_row")).select("_row")
    return docs.join(kept, "_row", "left_semi").drop("_row")
