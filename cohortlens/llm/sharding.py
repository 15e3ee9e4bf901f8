"""Sharding: a k-d tree over document metadata whose leaves hold equal bytes.

A node that stands for k shards is split in floor(k/2) : ceil(k/2) of its bytes, along its widest metadata dimension
(range of the scaled code). The split point is the weighted quantile of a 62-bit key (20-bit dimension code, then a hash
of the text and one of the row that break ties, so equal texts stand side by side and one hot value can still be divided). It is
found digit by digit: each pass sums bytes per (node, digit), partial sums first, and only one row per node reaches the
driver; it ends once each node's split falls on a single row. Leaves therefore differ by about one document per level.

Built-in functions only. Defined cases: null text counts as empty, null metadata has code 0, rows are told apart by doc_id
or, where that repeats or is null, by a number of their own, so repeated rows are divided like any others, fewer documents than shards leave shards empty, an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortlens.llm.tables import numbered, text_of, written

SHARDS = 40
ROW_BYTES = 16
CODE_BITS = 20
TIE_BITS = 21
#: (bits, bits below) of each digit of the key, first digit first. A node has at most 2048 values of a digit.
DIGITS = ((10, 52), (10, 42), (11, 31), (10, 21), (11, 10), (10, 0))
#: Rows numbered by one task when slots are dealt.
SLOT_ROWS = 20_000
DIMENSIONS = ("lang", "source", "n_chars")


@dataclass
class Split:
    """One inner node of a level: its shards, dimension and growing key prefix."""

    first: int
    shards: int
    dim: int
    rest: int
    prefix: int = 0
    below: int = 0
    inclusive: bool = False

    @property
    def left(self) -> int:
        return self.shards // 2


def _codes(docs: DataFrame, dims: tuple[str, ...]) -> list[Column]:
    """A 20-bit code per dimension: hashed for strings, logarithm of the value for numbers, scaled to the table's own range.

    Both kinds then fill the code's range, so their widths can be compared.
    """
    top = (1 << CODE_BITS) - 1
    hashed = {n for n in dims if docs.schema[n].dataType.typeName() in ("string", "boolean")}
    logs = {n: F.log2(1 + F.greatest(F.col(n).cast("double"), F.lit(0.0))) for n in dims if n not in hashed}
    ends = [f(c).alias(f"{at}_{n}") for n, c in logs.items() for at, f in (("lo", F.min), ("hi", F.max))]
    span = docs.agg(*ends).first() if ends else {}
    out = []
    for name in dims:
        if name in hashed:
            code = F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(1 << CODE_BITS))
        else:
            lo, hi = (span[f"{at}_{name}"] or 0.0 for at in ("lo", "hi"))
            code = F.floor((logs[name] - lo) / (hi - lo) * top) if hi > lo else F.lit(0)
        out.append(F.when(F.col(name).isNull(), F.lit(0)).otherwise(code).cast("bigint"))
    return out


def _per_node(values: dict[int, int], shards: int, default: int = 0) -> Column:
    """Value of the row's node, from a constant array of one entry per shard."""
    return F.get(F.array(*[F.lit(values.get(i, default)).cast("bigint") for i in range(shards)]), F.col("node"))


def _key(splits: list[Split], shards: int, n_dims: int) -> Column:
    codes = F.array(*[F.col(f"code{i}") for i in range(n_dims)])
    dim = _per_node({s.first: s.dim for s in splits}, shards).cast("int")
    return F.shiftleft(F.get(codes, dim), 2 * TIE_BITS) + F.col("tie")


def _descend(rows: DataFrame, splits: list[Split], digit: tuple[int, int]) -> bool:
    """Extend each split's prefix by the digit in which its share of bytes ends; True if each ends in a single row."""
    bits, below = digit
    found = rows.filter(F.shiftright("key", bits + below) == F.col("prefix"))
    found = found.groupBy("node", F.shiftright("key", below).alias("head")).agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")
    )
    order = W.partitionBy("node").orderBy("head").rowsBetween(W.unboundedPreceding, 0)
    ends = found.withColumn("upto", F.sum("size").over(order))
    rest = _per_node({s.first: s.rest for s in splits}, max(s.first for s in splits) + 1)
    ends = ends.withColumn("rest", rest).filter((F.col("upto") - F.col("size") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
    by_node = {r["node"]: r for r in ends.collect()}  # one row per node
    for s in splits:
        r = by_node[s.first]
        s.prefix, s.rest = r["head"], s.rest - (r["upto"] - r["size"])
        s.below, s.inclusive = below, 2 * s.rest > r["size"]
    return all(r["n"] == 1 for r in by_node.values())


def kd_leaves(rows: DataFrame, n_dims: int, shards: int = SHARDS) -> DataFrame:
    """``rows`` (size, tie, code0..) with ``node``: the leaf, 0 to shards-1."""
    rows = rows.withColumn("node", F.lit(0))  # the root
    nodes = {0: shards}
    while any(k > 1 for k in nodes.values()):
        spread = [(F.max(f"code{i}") - F.min(f"code{i}")).alias(f"w{i}") for i in range(n_dims)]
        stats = rows.groupBy("node").agg(F.sum("size").alias("size"), *spread).collect()  # one row per node
        splits = []
        for r in stats:
            if (k := nodes[r["node"]]) > 1:
                widths = [r[f"w{i}"] for i in range(n_dims)]
                splits.append(Split(r["node"], k, widths.index(max(widths)), r["size"] * (k // 2) // k))
        if not splits:
            return rows
        chosen = rows.filter(F.col("node").isin([s.first for s in splits])).withColumn("key", _key(splits, shards, n_dims))
        for digit in DIGITS:
            prefix = _per_node({s.first: s.prefix for s in splits}, shards)
            if _descend(chosen.withColumn("prefix", prefix), splits, digit):
                break
        # The last key that stays left: all keys of the prefix, or none of them.
        ends = {s.first: ((s.prefix + s.inclusive) << s.below) - 1 for s in splits}
        last = _per_node(ends, shards, (1 << 63) - 1)
        step = _per_node({s.first: s.left for s in splits}, shards)
        rows = rows.withColumn("key", _key(splits, shards, n_dims))
        rows = rows.withColumn("node", F.when(F.col("key") <= last, F.col("node")).otherwise(F.col("node") + step).cast("int"))
        # Each level is written: its nodes would otherwise be derived again, nested ever deeper, by every later pass.
        rows = written(rows.drop("key"), "shard-level")
        nodes = {
            at: n
            for first, k in nodes.items()
            for at, n in (((first, k),) if k == 1 else ((first, k // 2), (first + k // 2, k - k // 2)))
        }
    return rows


def slots(rows: DataFrame, shard: str = "shard", key: str = "doc_id") -> DataFrame:
    """Gapless numbers from 0 inside each shard, dealt by chunks of about ``SLOT_ROWS`` rows with summed offsets."""
    total = rows.count()
    chunks = max(1, -(-total // SLOT_ROWS))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(key, "tie"), F.lit(chunks)))
    sizes = rows.groupBy(shard, "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(shard).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(shard, "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = W.partitionBy(shard, "chunk").orderBy(key, "tie")
    return (
        rows.withColumn("at", F.row_number().over(order))
        .join(offsets, [shard, "chunk"])
        .withColumn("slot", (F.col("offset") + F.col("at") - 1).cast("bigint"))
        .drop("chunk", "at", "offset")
    )


def kd_shards(docs: DataFrame, dims: tuple[str, ...] = DIMENSIONS, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: every row in a leaf of nearly equal bytes."""
    codes = [c.alias(f"code{i}") for i, c in enumerate(_codes(docs, dims))]
    text = text_of(docs)
    half = F.lit(1 << TIE_BITS)
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text).cast("bigint").alias("text_crc32"),
        F.shiftleft(F.pmod(F.xxhash64(text), half), TIE_BITS).alias("tie"),
        *codes,
    )
    rows = numbered(written(rows, "shard-rows"))
    rows = rows.withColumn("tie", F.col("tie") + F.pmod(F.xxhash64("rid", F.lit("doc")), half)).drop("rid")
    placed = kd_leaves(rows, len(dims), shards).withColumnRenamed("node", "shard")
    return slots(placed).select("doc_id", "size", "text_crc32", "shard", "slot")
