"""Running totals and order statistics inside groups of any size.

A plain window puts a whole group into one task. Here the ordered axis is cut into chunks first: chunk totals are
summed on a table of at most ``chunks`` rows per group, and the running window is confined to (group, chunk).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

CHUNKS = 1024


def value_chunk(value: Column, lo: Column, hi: Column, chunks: int = CHUNKS) -> Column:
    """Equal-width chunk number of ``value`` in [lo, hi]; never decreases with the value."""
    scaled = F.floor((value - lo) / (hi - lo) * chunks)
    return F.when(hi > lo, F.least(scaled, F.lit(chunks - 1))).otherwise(F.lit(0)).cast("int")


def range_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: str = "_chunk") -> DataFrame:
    """Add chunk numbers that follow ``order`` inside ``keys`` and hold about equally many rows, however the values lie.

    The bounds come from Spark's range partitioner; the table is checkpointed, so every later use sees the same ones.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(df.repartitionByRange(parts, *keys, *order).withColumn(chunk, F.spark_partition_id()))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, Column],
    chunk: str = "_chunk",
    descending: bool = False,
) -> DataFrame:
    """Add inclusive running sums per group along ``order``; ``chunk`` must follow the same order.

    ``order`` has to be unique inside a group, otherwise tied rows are summed in no fixed order.
    """
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    earlier = Window.partitionBy(*keys).orderBy(direction(chunk)).rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = df.groupBy(*keys, chunk).agg(*[F.sum(c).alias(f"_in_{n}") for n, c in totals.items()])
    offsets = per_chunk.select(
        *keys, chunk, *[F.coalesce(F.sum(f"_in_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in totals]
    )
    inside = (
        Window.partitionBy(*keys, chunk).orderBy(*map(direction, order)).rowsBetween(Window.unboundedPreceding, 0)
    )
    out = df.join(offsets, [*keys, chunk])
    for n, c in totals.items():
        out = out.withColumn(n, F.col(f"_off_{n}") + F.sum(c).over(inside))
    return out.drop(*[f"_off_{n}" for n in totals])


def octave_code(value: Column, parts: int = 256) -> Column:
    """Whole number that never decreases with the value: sign and logarithm, ``parts`` steps per power of two.

    The steps do not depend on the data, so an outlier cannot push all other values into one of them.
    """
    size = F.floor((F.log2(F.abs(value)) + 1100) * parts)
    signed = F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size)
    return F.when(F.isnan(value), F.lit((1 << 63) - 1)).otherwise(signed).cast("long")


def _holding(sums: DataFrame, keys: Sequence[str], digit: str, ranks: Column) -> DataFrame:
    """The rows of ``sums`` (``_within`` per digit, ``_before`` the group) that hold a wanted rank, ``_before`` moved on."""
    earlier = Window.partitionBy(*keys).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("_within").over(earlier), F.lit(0))
    held = F.exists(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_within")))
    return sums.withColumn("_before", start).filter(held)


def group_quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    probs: Mapping[str, float],
    value: str = "value",
    weight: str | None = None,
    chunks: int = CHUNKS,
) -> DataFrame:
    """Exact linearly interpolated quantiles of every group; ``weight`` counts a row several times. Nulls are left out.

    Digit by digit: sums per (group, octave step), which are combined before the shuffle, show the steps that hold a wanted
    rank; the same is done with ``chunks`` equal slices of those steps, between the least and largest value inside. Only the
    values of the slices found are ordered. Rows are never shuffled by value, whatever the distribution.
    """
    keys = list(keys)
    count = F.lit(1).cast("long") if weight is None else F.col(weight)
    coded = rows.select(*keys, F.col(value).alias("_v"), count.alias("_w")).filter("_v is not null")
    coded = coded.withColumn("_code", octave_code(F.col("_v")))

    def low(p: float) -> Column:
        return F.floor(F.lit(float(p)) * (F.col("_total") - 1))

    def high(p: float) -> Column:
        return F.ceil(F.lit(float(p)) * (F.col("_total") - 1))

    ranks = F.array(*[f(p) for p in dict.fromkeys(probs.values()) for f in (low, high)])
    steps = coded.groupBy(*keys, "_code").agg(
        F.sum("_w").alias("_within"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    steps = steps.withColumn("_total", F.sum("_within").over(Window.partitionBy(*keys))).withColumn("_before", F.lit(0))
    steps = _holding(steps, keys, "_code", ranks).drop("_within")
    fine = coded.join(steps, [*keys, "_code"])
    fine = fine.withColumn("_part", value_chunk(F.col("_v"), F.col("_lo"), F.col("_hi"), chunks))
    slices = fine.groupBy(*keys, "_code", "_part", "_total", "_before").agg(F.sum("_w").alias("_within"))
    slices = _holding(slices, [*keys, "_code"], "_part", ranks).select(*keys, "_code", "_part", F.col("_before").alias("_start"))
    place = [*keys, "_code", "_part"]
    left = fine.join(slices, place).groupBy(*place, "_v", "_total", "_start").agg(F.sum("_w").alias("_w"))
    inside = Window.partitionBy(*place).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = left.withColumn("_upto", F.col("_start") + F.sum("_w").over(inside)).withColumn("_from", F.col("_upto") - F.col("_w"))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_upto")), F.col("_v")))

    picks = []
    for name, p in probs.items():
        picks += [at(low(p)).alias(f"_l_{name}"), at(high(p)).alias(f"_h_{name}")]
    found = ranked.groupBy(*keys).agg(*picks, F.first("_total").alias("_total"))
    out = []
    for name, p in probs.items():
        part = F.lit(float(p)) * (F.col("_total") - 1) - low(p)
        out.append((F.col(f"_l_{name}") * (1 - part) + F.col(f"_h_{name}") * part).alias(name))
    return found.select(*keys, *out)


def value_counts(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """One row per group and distinct value with its count ``n`` (combined before the shuffle)."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
