"""Feature scores on the long form (case_id, label, feature, ord, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import durable
from ..functions.keys import hash_order
from ..functions.ordered import running_totals, value_chunk
from .frame import min_max, to_arrays


def select_k_best(scores: DataFrame, k: int) -> DataFrame:
    """The k best scores with their ``rank``. Missing scores are lowest, ties go to the larger ``ord``."""
    score = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    best = Window.partitionBy().orderBy(score.desc_nulls_last(), F.col("ord").desc())
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def chi2_scores(feat: DataFrame) -> DataFrame:
    """Chi-square of class sums after min-max scaling (feature, ord, score).

    Scaled class sums follow from raw sums, counts and the range, so one pass over the data is enough.
    """
    per_class = feat.groupBy("feature", "ord", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    w = Window.partitionBy("feature", "ord")
    lo, hi = F.min("lo").over(w), F.max("hi").over(w)
    scaled = per_class.withColumn("_lo", lo).withColumn("_span", hi - lo)
    observed = F.when(F.col("_span") > 0, (F.col("s") - F.col("n") * F.col("_lo")) / F.col("_span")).otherwise(0.0)
    scaled = scaled.withColumn("o", observed)
    expected = F.col("n") / F.sum("n").over(w) * F.sum("o").over(w)
    gap = F.col("o") - F.col("e")
    return (
        scaled.withColumn("e", expected)
        .groupBy("feature", "ord")
        .agg(F.sum(F.when(F.col("e") > 0, gap * gap / F.col("e"))).alias("score"))
    )


def f_scores(feat: DataFrame) -> DataFrame:
    """One-way analysis-of-variance F (feature, ord, score); null where the feature is constant.

    Class means and centred sums of squares come from mergeable variances, so large means lose no digits.
    """
    per_class = feat.groupBy("feature", "ord", "label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count(F.lit(1))).alias("ss")
    )
    w = Window.partitionBy("feature", "ord")
    grand = F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)
    gap = F.col("m") - F.col("g")
    sums = (
        per_class.withColumn("g", grand)
        .groupBy("feature", "ord")
        .agg(
            F.sum(F.col("n") * gap * gap).alias("between"),
            F.sum("ss").alias("within"),
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("k"),
        )
    )
    score = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    ok = (F.col("within") > 0) & (F.col("k") > 1)
    return sums.select("feature", "ord", F.when(ok, score).alias("score"))


# Fixed value: Euler-Mascheroni constant, psi(1) = -EULER.
EULER = 0.5772156649015329


def digamma(n: Column, exact: int = 64) -> Column:
    """psi(n) of a positive integer: harmonic sum for small n, asymptotic series (error below 1e-15) above."""
    x = n.cast("double")
    harmonic = F.aggregate(
        F.sequence(F.lit(1), F.least(n.cast("int"), F.lit(exact))),
        F.lit(-EULER),
        lambda acc, i: acc + F.when(i < n, 1.0 / i).otherwise(0.0),
    )
    inv = 1 / (x * x)
    series = F.log(x) - 1 / (2 * x) - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv / 240)))
    return F.when(n <= exact, harmonic).otherwise(series)


def mi_scores(feat: DataFrame, k: int = 3, chunks: int = 1024) -> DataFrame:
    """Mutual information of a continuous feature and the class (feature, ord, score), after Ross (2014).

    Ordered work is cut into value chunks. The k-th neighbour distance inside the class uses the k rows next to every
    chunk as a halo; the number of points within that distance is a difference of two distributed running counts.
    """
    span = feat.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    chunk = value_chunk(F.col("value"), F.col("_lo"), F.col("_hi"), chunks)
    rows = feat.join(span, "feature").withColumn("_chunk", chunk)

    # Distinct values with their multiplicity; equal values share their neighbours.
    points = rows.groupBy("feature", "ord", "label", "_lo", "_hi", "_chunk", "value").agg(F.count(F.lit(1)).alias("c"))
    # Five branches read the points and three read their neighbour distances.
    points = durable(points)
    group = ["feature", "label"]
    inside = Window.partitionBy(*group, "_chunk").orderBy("value")
    size = (
        points.groupBy(*group).agg(F.sum("c").alias("n_label")).filter("n_label > 1")
    )
    first = F.row_number().over(inside)
    last = F.row_number().over(Window.partitionBy(*group, "_chunk").orderBy(F.col("value").desc()))
    rim = points.withColumn("_f", first).withColumn("_l", last).filter((F.col("_f") <= k) | (F.col("_l") <= k))
    rims = rim.groupBy(*group, "_chunk").agg(
        F.array_sort(F.collect_list(F.when(F.col("_f") <= k, F.struct("value", "c")))).alias("head"),
        F.array_sort(F.collect_list(F.when(F.col("_l") <= k, F.struct("value", "c")))).alias("tail"),
    )
    by_chunk = Window.partitionBy(*group).orderBy("_chunk")
    pad = rims.select(
        *group,
        "_chunk",
        F.flatten(F.collect_list("tail").over(by_chunk.rowsBetween(-k, -1))).alias("_before"),
        F.flatten(F.collect_list("head").over(by_chunk.rowsBetween(1, k))).alias("_after"),
    )
    near = Window.partitionBy(*group, "_chunk").orderBy("value")
    here = F.struct("value", "c")
    around = (
        points.join(size, group)
        .join(pad, [*group, "_chunk"])
        .withColumn("_p", F.concat("_before", F.collect_list(here).over(near.rowsBetween(-k, -1))))
        .withColumn("_n", F.concat(F.collect_list(here).over(near.rowsBetween(1, k)), "_after"))
    )
    value = F.col("value")
    gaps = F.concat(
        F.transform("_p", lambda q: F.struct((value - q["value"]).alias("d"), q["value"].alias("at"), q["c"].alias("c"))),
        F.transform("_n", lambda q: F.struct((q["value"] - value).alias("d"), q["value"].alias("at"), q["c"].alias("c"))),
        F.array(F.struct(F.lit(0.0).alias("d"), value.alias("at"), (F.col("c") - 1).alias("c"))),
    )
    k_here = F.least(F.lit(k), F.col("n_label") - 1)
    reach = F.aggregate(
        F.array_sort(gaps),
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("struct<d:double,at:double>").alias("hit")),
        lambda acc, g: F.struct(
            (acc["seen"] + g["c"]).alias("seen"),
            F.coalesce(
                acc["hit"], F.when(acc["seen"] + g["c"] >= k_here, F.struct(g["d"].alias("d"), g["at"].alias("at")))
            ).alias("hit"),
        ),
    )["hit"]
    queries = around.select(
        "feature", "ord", "label", "value", "c", "n_label", "_lo", "_hi", k_here.alias("k_here"), reach.alias("_hit")
    )
    queries = durable(queries)
    # The open interval around the point; the side of the k-th neighbour ends at that neighbour itself. A zero radius
    # keeps the tied points. ``place`` puts a mark before (0) or after (1) the data at the same spot.
    r, hit = F.col("_hit.d"), F.col("_hit.at")
    left = F.when(hit < value, hit).otherwise(value - r)
    right = F.when(hit > value, hit).otherwise(value + r)
    before, after = F.lit(0.0), F.lit(1.0)
    ends = F.array(
        F.struct(left.alias("at"), F.when(r > 0, after).otherwise(before).alias("place"), F.lit(-1).alias("sign")),
        F.struct(right.alias("at"), F.when(r > 0, before).otherwise(after).alias("place"), F.lit(1).alias("sign")),
    )
    shared = ["feature", "_lo", "_hi", "value", "label"]
    marks = queries.select(*shared, F.explode(ends).alias("_e")).select(*shared, "_e.*", F.lit(0).cast("long").alias("w"))
    data = queries.select(
        *shared, F.col("value").alias("at"), F.lit(0.5).alias("place"), F.lit(0).alias("sign"), F.col("c").alias("w")
    )
    line = marks.unionByName(data)
    bounded = F.least(F.greatest(F.col("at"), F.col("_lo")), F.col("_hi"))
    line = line.withColumn("_chunk", value_chunk(bounded, F.col("_lo"), F.col("_hi"), chunks))
    counted = running_totals(line, ["feature"], ["at", "place", "value", "label", "sign"], {"upto": F.col("w")})
    within = (
        counted.filter("sign <> 0")
        .groupBy("feature", "label", "value")
        .agg(F.sum(F.col("upto") * F.col("sign")).alias("m"))
    )
    c, n = F.col("c"), F.col("n")
    sums = (
        queries.join(within, ["feature", "label", "value"])
        .groupBy("feature", "ord")
        .agg(
            F.sum("c").alias("n"),
            F.sum(c * digamma(F.col("k_here"))).alias("k"),
            F.sum(c * digamma(F.col("n_label"))).alias("l"),
            F.sum(c * digamma(F.col("m"))).alias("m"),
        )
    )
    score = digamma(n) + (F.col("k") - F.col("l") - F.col("m")) / n
    return sums.select("feature", "ord", F.greatest(score, F.lit(0.0)).alias("score"))


def relief_weights(feat: DataFrame, n_anchors: int = 100, seed: int = 42) -> DataFrame:
    """Relief weights (feature, ord, score): mean over sampled anchors of |a - miss| - |a - hit| on [0, 1] features.

    The anchors are the operator's own bounded sample. Every task measures its rows against them with numpy and keeps
    one candidate per anchor and class side; distances are L1, ties go to the smaller case id.
    """
    names = feat.select("feature", "ord").distinct()
    rows = to_arrays(min_max(feat))
    anchors = rows.orderBy(hash_order("case_id", seed), "case_id").limit(n_anchors).collect()
    ids = np.array([a["case_id"] for a in anchors], dtype=object)
    sides = np.array([a["label"] for a in anchors])
    points = np.array([a["values"] for a in anchors], dtype=float)

    def nearest(batches):
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.sort_values("case_id", kind="stable")
            x = np.stack(batch["values"].to_numpy())
            case, label = batch["case_id"].to_numpy(), batch["label"].to_numpy()
            found = []
            for a in range(len(points)):
                gap = np.abs(x - points[a])
                far = gap.sum(axis=1)
                for side, mask in (("hit", (label == sides[a]) & (case != ids[a])), ("miss", label != sides[a])):
                    at = np.flatnonzero(mask)
                    if len(at):
                        best = at[np.argmin(far[at])]
                        found.append((a, side, float(far[best]), case[best], gap[best]))
            yield pd.DataFrame(found, columns=["anchor", "side", "distance", "case_id", "gap"])

    schema = "anchor int, side string, distance double, case_id string, gap array<double>"
    best = (
        rows.select("case_id", "label", "values")
        .mapInPandas(nearest, schema)
        .groupBy("anchor", "side")
        .agg(F.min(F.struct("distance", "case_id", "gap")).alias("b"))
    )
    signed = F.when(F.col("side") == "miss", F.col("gap")).otherwise(-F.col("gap"))
    order = F.row_number().over(Window.partitionBy().orderBy("ord")) - 1
    return (
        best.select("side", F.posexplode("b.gap").alias("pos", "gap"))
        .groupBy("pos")
        .agg((F.sum(signed) / len(anchors)).alias("score"))
        .join(names.withColumn("pos", order), "pos")
        .select("feature", "ord", "score")
    )
