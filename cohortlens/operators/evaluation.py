"""Evaluation of probabilities, long form (label, method, prob[, split]).

Everything starts from one count table (method, prob, pos, neg), combined before the shuffle; curves are running totals
over it, so a method with most of the rows never meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import range_chunks, running_totals

# Report metrics in their printed order.
METRIC_NAMES = [
    "accuracy", "f1_score", "recall", "precision", "auc", "sensitivity", "specificity",
    "positive_prediction", "negative_prediction", "positive_llr", "negative_llr",
]


def group_keys(pred: DataFrame) -> list[str]:
    """Columns that name one curve."""
    return [c for c in ("split", "method") if c in pred.columns]


def to_long(pred: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Wide prediction frame to (ids, label, method, prob)."""
    keep = [c for c in pred.columns if c not in methods]
    return pred.unpivot(keep, list(methods), "method", "prob")


def score_counts(pred: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score."""
    return pred.groupBy(*group_keys(pred), "prob").agg(
        F.sum(F.col("label").cast("long")).alias("pos"), F.sum((1 - F.col("label")).cast("long")).alias("neg")
    )


def _cumulated(pred: DataFrame) -> DataFrame:
    """Score table with true/false positives at ``prob`` or above, and the totals P and N."""
    keys = group_keys(pred)
    chunked = range_chunks(score_counts(pred), keys, ["prob"])
    totals = chunked.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    run = running_totals(
        chunked, keys, ["prob"], {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True
    )
    return run.join(totals, keys).drop("_chunk")


def roc_curve(pred: DataFrame) -> DataFrame:
    """One point per distinct score, plus the start (0, 0) with a null threshold."""
    keys = group_keys(pred)
    points = _cumulated(pred).select(
        *keys, F.col("prob").alias("threshold"), (F.col("fp") / F.col("N")).alias("fpr"), (F.col("tp") / F.col("P")).alias("tpr")
    )
    start = pred.select(*keys).distinct().select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return start.unionByName(points)


def auc(pred: DataFrame) -> DataFrame:
    """Area under the curve: every negative counts the positives above it and half of those level with it."""
    keys = group_keys(pred)
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    area = won / F.first("P") / F.first("N")
    return _cumulated(pred).groupBy(*keys).agg(area.alias("auc"))


def rank_methods(pred: DataFrame, top: int = 3) -> DataFrame:
    """Methods by falling area; ``rank`` 1 is the best, ``top`` flags those that are drawn."""
    order = Window.partitionBy().orderBy(F.col("auc").desc(), F.col("method"))
    ranked = auc(pred).withColumn("rank", F.row_number().over(order))
    return ranked.withColumn("top", F.col("rank") <= top)


def youden_cutoff(pred: DataFrame) -> DataFrame:
    """Largest score that maximises sensitivity + specificity. Infinite if none beats chance: nobody is positive."""
    keys = group_keys(pred)
    j = F.col("tp") / F.col("P") + (1 - F.col("fp") / F.col("N"))
    best = _cumulated(pred).groupBy(*keys).agg(F.max(F.struct(j.alias("j"), F.col("prob").alias("prob"))).alias("b"))
    cutoff = F.when(F.col("b.j") > 1, F.col("b.prob")).otherwise(F.lit(float("inf")))
    return best.select(*keys, cutoff.alias("cutoff"))


def _confusion(pred: DataFrame, cutoff: DataFrame) -> DataFrame:
    keys = group_keys(pred)
    on = [k for k in keys if k in cutoff.columns]
    called = F.col("prob") >= F.col("cutoff")
    counts = score_counts(pred).join(cutoff, on)
    return counts.groupBy(*keys).agg(
        F.sum(F.when(~called, F.col("neg")).otherwise(0)).alias("tn"),
        F.sum(F.when(called, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~called, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(called, F.col("pos")).otherwise(0)).alias("tp"),
    )


def confusion_matrix(pred: DataFrame, cutoff: DataFrame) -> DataFrame:
    """Cells with count and share; scores at the cutoff are positive."""
    keys = group_keys(pred)
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    cells = F.array(*[F.struct(F.lit(c).alias("cell"), F.col(c).alias("n")) for c in ("tn", "fp", "fn", "tp")])
    return (
        _confusion(pred, cutoff)
        .select(*keys, total.alias("_all"), F.explode(cells).alias("_c"))
        .select(*keys, "_c.cell", "_c.n", (F.col("_c.n") / F.col("_all")).alias("share"))
    )


def metrics_report(pred: DataFrame, cutoff: DataFrame) -> DataFrame:
    """The report metrics (keys, metric, value), NaN where a denominator is zero."""
    keys = group_keys(pred)
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    nan = F.lit(float("nan"))

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom != 0, top / bottom).otherwise(nan)

    recall = ratio(tp, tp + fn)
    precision = ratio(tp, tp + fp)
    specificity = ratio(tn, tn + fp)
    values = {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "f1_score": ratio(2 * tp, 2 * tp + fp + fn),
        "recall": recall,
        "precision": precision,
        "auc": F.col("auc"),
        "sensitivity": recall,
        "specificity": specificity,
        "positive_prediction": precision,
        "negative_prediction": ratio(tn, tn + fn),
        "positive_llr": ratio(recall, ratio(fp, fp + tn)),
        "negative_llr": ratio(ratio(fn, tp + fn), specificity),
    }
    cells = F.array(
        *[F.struct(F.lit(m).alias("metric"), values[m].cast("double").alias("value")) for m in METRIC_NAMES]
    )
    joined = _confusion(pred, cutoff).join(auc(pred), keys)
    return joined.select(*keys, F.explode(cells).alias("_m")).select(*keys, "_m.*")


def calibration_curve(pred: DataFrame, n_bins: int = 10) -> DataFrame:
    """Mean label and mean score per equal bin of [0, 1]; a score on an inner edge belongs to the lower bin."""
    keys = group_keys(pred)
    edge = F.ceil(F.col("prob") * n_bins).cast("int") - 1
    counts = score_counts(pred).withColumn("bin", F.least(F.greatest(edge, F.lit(0)), F.lit(n_bins - 1)))
    n = F.col("pos") + F.col("neg")
    return counts.groupBy(*keys, "bin").agg(
        (F.sum("pos") / F.sum(n)).alias("prob_true"), (F.sum(F.col("prob") * n) / F.sum(n)).alias("prob_pred")
    )


def decision_curve(pred: DataFrame, treat_all: str = "report", steps: int = 100) -> DataFrame:
    """Net benefit at thresholds 0.00 to 0.99 (score above the threshold is positive).

    ``treat_all='report'`` repeats the report's own line, ``'standard'`` the published prevalence form. Scores fall into
    ``steps`` + 1 threshold bins first, so the thresholds only meet a table of that size.
    """
    keys = group_keys(pred)
    reached = F.aggregate(
        F.array(*[F.lit(i / steps) for i in range(steps)]),
        F.lit(0),
        lambda acc, t: acc + F.when(F.col("prob") > t, 1).otherwise(0),
    )
    counts = score_counts(pred)
    binned = counts.groupBy(*keys, reached.alias("above")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    every = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    sums = (
        binned.withColumn("i", every)
        .groupBy(*keys, "i")
        .agg(
            F.sum(F.when(F.col("above") > F.col("i"), F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("above") > F.col("i"), F.col("neg")).otherwise(0)).alias("fp"),
            F.sum("pos").alias("P"),
            F.sum(F.col("pos") + F.col("neg")).alias("n"),
        )
    )
    t = F.col("i") / F.lit(float(steps))
    odds = t / (1 - t)
    tp, fp, n = F.col("tp"), F.col("fp"), F.col("n")
    if treat_all == "standard":
        everyone = F.col("P") / n - (1 - F.col("P") / n) * odds
    else:
        everyone = tp / n - (1 - fp / n) * odds
    return sums.select(
        *keys, t.alias("t"), (tp / n - fp / n * odds).alias("net_benefit"), everyone.alias("treat_all"), F.lit(0.0).alias("treat_none")
    )


def pr_curve(pred: DataFrame) -> DataFrame:
    """Precision and recall at every distinct score."""
    keys = group_keys(pred)
    tp, fp = F.col("tp"), F.col("fp")
    return _cumulated(pred).select(
        *keys, F.col("prob").alias("threshold"), (tp / (tp + fp)).alias("precision"), (tp / F.col("P")).alias("recall")
    )


def average_precision(pred: DataFrame) -> DataFrame:
    """Sum of precision times recall gain."""
    gain = F.col("pos") / F.col("P") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return _cumulated(pred).groupBy(*group_keys(pred)).agg(F.sum(gain).alias("average_precision"))


def log_loss(pred: DataFrame, eps: float = 1e-15) -> DataFrame:
    """Mean negative log likelihood with scores kept inside [eps, 1 - eps]."""
    p = F.least(F.greatest(F.col("prob"), F.lit(eps)), F.lit(1 - eps))
    loss = -(F.col("pos") * F.log(p) + F.col("neg") * F.log(1 - p))
    total = F.sum(F.col("pos") + F.col("neg"))
    return score_counts(pred).groupBy(*group_keys(pred)).agg((F.sum(loss) / total).alias("log_loss"))


def run_summary(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, key, value) rows; every frame gives its first column as key and the rest as ``name=value`` text."""
    out = None
    for section, df in sections.items():
        key, *rest = df.columns
        text = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rest])
        part = df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), text.alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
