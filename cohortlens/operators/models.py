"""Binary classifiers on the ML form (case_id, label, features vector).

Fitters return a function frame -> (case_id, label, prob); Spark ML does the training. ``C``-style penalties of the form
C * loss + penalty become ``regParam = 1 / (C * n)``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import durable, settled
from ..functions.gram import covariance, local_gram
from . import batched
from .evaluation import auc
from .frame import stratified_folds
from .neighbours import nearest_neighbours

Scorer = Callable[[DataFrame], DataFrame]

# Full search grids. Shorter ones can be passed to every fitter.
LOGISTIC_C = [10 ** (-4 + 8 * i / 9) for i in range(10)]
SVM_C = [1, 10, 100, 1000]
LINEAR_PENALTIES = {"l2": 0.0, "l1": 1.0}
LINEAR_L1_RATIO = [i / 9 for i in range(10)]
LINEAR_ALPHA = [1e-4, 1e-3, 1e-2, 1e-1, 1.0]
KNN_K = [1, 2, 3, 4, 5, 6, 7, 8, 9]
KNN_WEIGHTS = ["uniform", "distance"]
TREE_IMPURITY = ["gini", "entropy"]
FOREST_TREES = list(range(20, 100, 5))
FOREST_DEPTH = [1 + 109 * i / 9 for i in range(10)]
FOREST_FEATURES = ["sqrt", "log2"]
FOREST_MIN_ROWS = [2, 5, 10]
BOOST_ROUNDS = list(range(5, 210, 20))
BOOST_RATE = [0.01 + 0.99 * i / 9 for i in range(10)]
MAX_TREE_DEPTH = 30


def _probability(model, column: str = "probability") -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        return out.select("case_id", "label", vector_to_array(column)[1].alias("prob"))

    return score


def grid_search(estimator, grid: list, df: DataFrame, n_splits: int = 10, n_repeats: int = 3, seed: int = 42,
                parallelism: int = 4):
    """Mean cross-validated accuracy of every setting over repeated stratified folds.

    Returns (table of config, score), best parameter map. The first of equal scores wins.
    """
    folds = stratified_folds(df, n_splits, n_repeats, seed)
    evaluator = MulticlassClassificationEvaluator(metricName="accuracy")
    total = np.zeros(len(grid))
    data = settled(df.join(folds.drop("label"), "case_id"))
    try:
        for rep in range(n_repeats):
            cv = CrossValidator(
                estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator, numFolds=n_splits,
                foldCol="fold", parallelism=parallelism,
            )
            total += np.array(cv.fit(data.filter(F.col("rep") == rep)).avgMetrics)
    finally:
        data.unpersist()
    text = ["; ".join(sorted(f"{p.name}={v}" for p, v in g.items())) for g in grid]
    rows = [(i, t, float(s / n_repeats)) for i, (t, s) in enumerate(zip(text, total))]
    table = df.sparkSession.createDataFrame(rows, "config int, params string, score double")
    return table, grid[int(np.argmax(total))]


def _weighted(estimator, train: DataFrame):
    """The estimator, with row weights where the table has them."""
    return estimator.setWeightCol("weight") if "weight" in train.columns else estimator


def _searched(estimator, grid: list, train: DataFrame, n_splits: int, n_repeats: int, seed: int):
    best = grid[0] if len(grid) == 1 else grid_search(estimator, grid, train, n_splits, n_repeats, seed)[1]
    return estimator.fit(train, best)


def _batch_rows(train: DataFrame, n_splits: int, n_repeats: int, seed: int) -> DataFrame:
    """Rows for batched training: label, values, weight (1 unless given) and one fold number per repeat, held."""
    weight = F.col("weight").cast("double") if "weight" in train.columns else F.lit(1.0)
    rows = train.select("case_id", "label", vector_to_array("features").alias("values"), weight.alias("weight"))
    if n_splits * n_repeats:
        folds = stratified_folds(train, n_splits, n_repeats, seed).groupBy("case_id").agg(
            F.sort_array(F.collect_list(F.struct("rep", "fold"))).alias("_f")
        )
        rows = rows.join(folds.select("case_id", F.col("_f.fold").alias("folds")), "case_id")
    return settled(rows)


def linear_search(train: DataFrame, settings: Sequence[dict], loss: str = "logistic", n_splits: int = 10, n_repeats: int = 3,
                  seed: int = 42, max_iter: int = 100) -> tuple[DataFrame, np.ndarray]:
    """Mean accuracy of every linear setting over repeated stratified folds, and the weights of the best on all rows.

    A setting holds ``c`` or ``l1`` and ``l2``, and perhaps ``intercept`` and ``tol``. All settings and folds, and the fits on all
    rows, are trained together; the first of equal scores wins. A single setting is not scored.
    """
    if len(settings) == 1:
        n_splits = n_repeats = 0
    rows = _batch_rows(train, n_splits, n_repeats, seed)
    try:
        scores, weights = batched.search(rows, settings, loss, n_splits, n_repeats, max_iter)
    finally:
        rows.unpersist()
    text = ["; ".join(f"{k}={v}" for k, v in sorted(s.items())) for s in settings]
    table = [(i, t, s) for i, (t, s) in enumerate(zip(text, scores))]
    return train.sparkSession.createDataFrame(table, "config int, params string, score double"), weights[int(np.argmax(scores))]


def _margins(weights: np.ndarray) -> Callable[[DataFrame], DataFrame]:
    product = batched.margin("values", weights)
    return lambda df: product(df.select("case_id", "label", vector_to_array("features").alias("values")))


def _logistic(weights: np.ndarray) -> Scorer:
    margins = _margins(weights)
    return lambda df: margins(df).select("case_id", "label", (1 / (1 + F.exp(-F.col("margin")))).alias("prob"))


def logistic_cv(train: DataFrame, c_values: Sequence[float] = tuple(LOGISTIC_C), n_splits: int = 10, seed: int = 42) -> Scorer:
    """L2 logistic regression with the strength chosen by one round of stratified folds."""
    return _logistic(linear_search(train, [{"c": c} for c in c_values], "logistic", n_splits, 1, seed)[1])


def _platt(weights: np.ndarray, train: DataFrame) -> Scorer:
    """Logistic calibration of a margin."""
    margins = _margins(weights)
    lone = margins(train).select("case_id", "label", array_to_vector(F.array("margin")).alias("features"))
    (shift, slope) = linear_search(lone, [{"l2": 0.0, "tol": 1e-8}])[1]
    link = F.exp(-(F.lit(float(slope)) * F.col("margin") + F.lit(float(shift))))
    return lambda df: margins(df).select("case_id", "label", (1 / (1 + link)).alias("prob"))


def svm_linear(train: DataFrame, c_values: Sequence[float] = tuple(SVM_C), n_splits: int = 10, n_repeats: int = 3,
               seed: int = 42) -> Scorer:
    """Linear support vector machine with calibrated probabilities."""
    return _platt(linear_search(train, [{"c": c} for c in c_values], "hinge", n_splits, n_repeats, seed)[1], train)


def svm_poly(train: DataFrame, c_values: Sequence[float] = tuple(SVM_C), degree: int = 3, n_splits: int = 10,
             n_repeats: int = 3, seed: int = 42) -> Scorer:
    """Polynomial machine as a linear one on the explicit expansion; meant for selected features."""
    grow = PolynomialExpansion(inputCol="features", outputCol="expanded", degree=degree)

    def expand(df: DataFrame) -> DataFrame:
        return grow.transform(df).select("case_id", "label", F.col("expanded").alias("features"))

    score = svm_linear(expand(train), c_values, n_splits, n_repeats, seed)
    return lambda df: score(expand(df))


def rff_matrix(p: int, n_components: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases of random Fourier features for exp(-gamma |a - b|^2)."""
    rng = np.random.default_rng(seed)
    return rng.normal(0, math.sqrt(2 * gamma), (p, n_components)), rng.uniform(0, 2 * math.pi, n_components)


def rff_transform(df: DataFrame, gamma: float, n_components: int, seed: int = 42) -> DataFrame:
    """Replace ``features`` by random Fourier features; one matrix product per Arrow batch."""
    head = df.select(F.size(vector_to_array("features")).alias("p")).first()
    weights, phase = rff_matrix(head["p"], n_components, gamma, seed)
    scale = math.sqrt(2 / n_components)

    def lift(values: pd.Series) -> pd.Series:
        return pd.Series(list(scale * np.cos(np.stack(values.to_numpy()) @ weights + phase)))

    lifted = F.pandas_udf(lift, "array<double>")(vector_to_array("features"))
    return df.withColumn("features", array_to_vector(lifted))


def svm_rbf(train: DataFrame, gamma: float, n_components: int = 256, c_values: Sequence[float] = tuple(SVM_C),
            n_splits: int = 10, n_repeats: int = 3, seed: int = 42) -> Scorer:
    """Radial machine on random Fourier features."""
    score = svm_linear(rff_transform(train, gamma, n_components, seed), c_values, n_splits, n_repeats, seed)
    return lambda df: score(rff_transform(df, gamma, n_components, seed))


def svm_search(train: DataFrame, kernels: Sequence[str] = ("rbf", "linear", "poly"), c_values: Sequence[float] = tuple(SVM_C),
               gamma: float | None = None, n_components: int = 256, degree: int = 3, n_splits: int = 10, n_repeats: int = 3,
               seed: int = 42) -> Scorer:
    """Support vector machine of the best kernel and strength by repeated stratified folds, with calibrated probabilities.

    ``gamma`` defaults to 1 / (features * variance of all values). The first kernel, then the first strength, wins a tie.
    """
    if gamma is None:
        v = F.explode(vector_to_array("features"))
        size = train.select(F.size(vector_to_array("features")).alias("p")).first()["p"]
        gamma = 1 / (size * (train.select(v.alias("v")).agg(F.var_pop("v").alias("s")).first()["s"] or 1.0))
    grow = PolynomialExpansion(inputCol="features", outputCol="expanded", degree=degree)
    lifts: dict[str, Callable[[DataFrame], DataFrame]] = {
        "linear": lambda df: df,
        "rbf": lambda df: rff_transform(df, gamma, n_components, seed),
        "poly": lambda df: grow.transform(df).select("case_id", "label", F.col("expanded").alias("features")),
    }
    settings, best = [{"c": c} for c in c_values], None
    for kernel in kernels:
        lifted = lifts[kernel](train)
        table, weights = linear_search(lifted, settings, "hinge", n_splits, n_repeats, seed)
        score = max(r["score"] for r in table.collect())
        if best is None or score > best[0]:
            best = (score, kernel, weights)
    lift = lifts[best[1]]
    scorer = _platt(best[2], lift(train))
    return lambda df: scorer(lift(df))


def gaussian_process(train: DataFrame, gamma: float = 0.5, n_components: int = 256,
                     c_values: Sequence[float] = (1.0,), seed: int = 42) -> Scorer:
    """Radial Gaussian-process classifier in its feature form: logistic regression on random Fourier features."""
    score = logistic_cv(rff_transform(train, gamma, n_components, seed), c_values, seed=seed)
    return lambda df: score(rff_transform(df, gamma, n_components, seed))


def elasticnet_grid(alphas: Sequence[float] = tuple(LINEAR_ALPHA), l1_ratios: Sequence[float] = tuple(LINEAR_L1_RATIO)) -> list[dict]:
    """Settings of every strength and share of the l1 part."""
    return [{"l1": a * r, "l2": a * (1 - r)} for a in alphas for r in l1_ratios]


def linear_elasticnet(train: DataFrame, alphas: Sequence[float] = tuple(LINEAR_ALPHA),
                      l1_ratios: Sequence[float] = tuple(LINEAR_L1_RATIO), n_splits: int = 10, n_repeats: int = 3,
                      seed: int = 42) -> Scorer:
    """Log-loss linear model with an elastic-net grid; ratios 0 and 1 are the l2 and l1 penalties."""
    return _logistic(linear_search(train, elasticnet_grid(alphas, l1_ratios), "logistic", n_splits, n_repeats, seed)[1])


def decision_tree(train: DataFrame, impurities: Sequence[str] = tuple(TREE_IMPURITY), min_rows: Sequence[int] = (1,),
                  max_depth: int = 10, n_splits: int = 10, n_repeats: int = 3, seed: int = 42) -> Scorer:
    """Decision tree; the smallest leaf stands in for the smallest split."""
    est = _weighted(DecisionTreeClassifier(seed=seed, maxDepth=min(max_depth, MAX_TREE_DEPTH)), train)
    grid = (
        ParamGridBuilder().addGrid(est.impurity, list(impurities)).addGrid(est.minInstancesPerNode, list(min_rows)).build()
    )
    return _probability(_searched(est, grid, train, n_splits, n_repeats, seed))


def random_forest(train: DataFrame, trees: Sequence[int] = tuple(FOREST_TREES), depths: Sequence[float] = tuple(FOREST_DEPTH),
                  subsets: Sequence[str] = tuple(FOREST_FEATURES), min_rows: Sequence[int] = tuple(FOREST_MIN_ROWS),
                  bootstrap: Sequence[bool] = (True, False), n_splits: int = 10, n_repeats: int = 3, seed: int = 42) -> Scorer:
    """Random forest; depths above Spark's limit of 30 are clamped."""
    est = _weighted(RandomForestClassifier(seed=seed), train)
    depths = sorted({min(int(d), MAX_TREE_DEPTH) for d in depths})
    grid = (
        ParamGridBuilder()
        .addGrid(est.numTrees, list(trees))
        .addGrid(est.maxDepth, depths)
        .addGrid(est.featureSubsetStrategy, list(subsets))
        .addGrid(est.minInstancesPerNode, [max(1, m // 2) for m in min_rows])
        .addGrid(est.bootstrap, list(bootstrap))
        .build()
    )
    return _probability(_searched(est, grid, train, n_splits, n_repeats, seed))


def adaboost(train: DataFrame, rounds: int = 50, rate: float = 1.0, algorithm: str = "SAMME.R", seed: int = 42) -> Scorer:
    """Boosted stumps. Row weights live in a column and are written to the checkpoint folder after every round.

    SAMME votes with ln((1 - err)/err); SAMME.R adds half log-odds of the stump probabilities.
    """
    begin = F.col("weight").cast("double") if "weight" in train.columns else F.lit(1.0)
    data = durable(train.withColumn("weight", begin))
    stages = []
    eps = 1e-10
    for r in range(rounds):
        stump = DecisionTreeClassifier(maxDepth=1, weightCol="weight", seed=seed + r).fit(data)
        out = stump.transform(data)
        wrong = F.when(F.col("prediction") != F.col("label"), F.col("weight")).otherwise(0.0)
        sums = out.agg((F.sum(wrong) / F.sum("weight")).alias("err"), F.avg("weight").alias("mean")).first()
        err = min(max(sums["err"], eps), 1.0)
        if err >= 0.5 and algorithm == "SAMME" and stages:
            break
        if algorithm == "SAMME":
            alpha = rate * math.log((1 - err) / err) if err < 1 else 0.0
            factor = F.when(F.col("prediction") != F.col("label"), F.lit(math.exp(alpha))).otherwise(1.0)
        else:
            alpha = rate
            factor = F.exp(-alpha * (F.col("label") * 2 - 1) * _half_log_odds("probability"))
        stages.append((stump, alpha))
        if err <= eps:
            break
        columns = [c for c in train.columns if c != "weight"]
        data = durable(out.select(*columns, (F.col("weight") * factor / sums["mean"]).alias("weight")))

    def score(df: DataFrame) -> DataFrame:
        out = df.select("case_id", "label", "features").withColumn("_vote", F.lit(0.0))
        for stump, alpha in stages:
            step = stump.transform(out)
            if algorithm == "SAMME":
                vote = F.lit(alpha) * (F.col("prediction") * 2 - 1)
            else:
                vote = _half_log_odds("probability")
            out = step.withColumn("_vote", F.col("_vote") + vote).select("case_id", "label", "features", "_vote")
        weight = sum(abs(a) for _, a in stages) if algorithm == "SAMME" else len(stages)
        margin = F.col("_vote") / F.lit(float(weight) or 1.0)
        return out.select("case_id", "label", (1 / (1 + F.exp(-2 * margin))).alias("prob"))

    return score


def _half_log_odds(column: str):
    p = F.least(F.greatest(vector_to_array(column)[1], F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p)) / 2


def gaussian_nb(train: DataFrame, test: DataFrame, smoothing: float = 1e-9) -> DataFrame:
    """Gaussian naive Bayes on the long form: (case_id, label, prob) of ``test``.

    Per class and feature mean and variance are one aggregate; a case's log likelihoods are sums over its features.
    """
    stats = train.groupBy("feature", "label").agg(
        F.avg("value").alias("mean"), F.var_pop("value").alias("var"), F.count(F.lit(1)).alias("n")
    )
    spread = train.groupBy("feature").agg(F.var_pop("value").alias("v")).agg(F.max("v").alias("widest")).first()["widest"]
    by_class = stats.groupBy("feature").pivot("label", [0, 1]).agg(
        F.first("mean").alias("mean"), (F.first("var") + smoothing * spread).alias("var"), F.first("n").alias("n")
    )
    v = F.col("value")

    def density(c: int):
        mean, var = F.col(f"{c}_mean"), F.col(f"{c}_var")
        return -0.5 * (F.log(2 * math.pi * var) + (v - mean) * (v - mean) / var)

    prior = F.log(F.first("1_n") / F.first("0_n"))
    odds = test.join(by_class, "feature").groupBy("case_id", "label").agg(
        (F.sum(density(1) - density(0)) + prior).alias("_odds")
    )
    return odds.select("case_id", "label", (1 / (1 + F.exp(-F.col("_odds")))).alias("prob"))


def qda(train: DataFrame, ridge: float = 0.0) -> Scorer:
    """Quadratic discriminant on (case_id, label, values array); class means and covariances in one pass."""
    grams = local_gram(train, "label")
    parts = []
    total = sum(m[0, 0] for m in grams.values())
    for g in ("0", "1"):
        n, mean, cross = covariance(grams[g])
        cov = cross[:-1, :-1] / (n - 1) + ridge * np.eye(len(mean) - 1)
        inverse = np.linalg.pinv(cov)
        parts.append((mean[:-1], inverse, math.log(n / total) - 0.5 * np.linalg.slogdet(cov)[1]))

    def probability(values: pd.Series) -> pd.Series:
        x = np.stack(values.to_numpy())
        scores = []
        for mean, inverse, base in parts:
            d = x - mean
            scores.append(base - 0.5 * np.einsum("ij,jk,ik->i", d, inverse, d))
        return pd.Series(1 / (1 + np.exp(np.clip(scores[0] - scores[1], -700, 700))))

    return lambda df: df.select(
        "case_id", "label", F.pandas_udf(probability, "double")("values").alias("prob")
    )


def gbt(train: DataFrame, rounds: int = 20, max_depth: int = 3, seed: int = 42) -> Scorer:
    """Gradient-boosted trees."""
    return _probability(_weighted(GBTClassifier(maxIter=rounds, maxDepth=max_depth, seed=seed), train).fit(train))


def mlp(train: DataFrame, hidden: Sequence[int] = (16,), max_iter: int = 100, seed: int = 42) -> Scorer:
    """Feed-forward network."""
    p = train.select(F.size(vector_to_array("features")).alias("p")).first()["p"]
    est = MultilayerPerceptronClassifier(layers=[p, *hidden, 2], maxIter=max_iter, seed=seed)
    return _probability(est.fit(train))


# ---------------------------------------------------------------------------------------------- neighbours

def _votes(near: DataFrame, weights: str, keys: Sequence[str]) -> DataFrame:
    """Running share ``prob`` of (weighted) positive votes among the first 1, 2, ... neighbours of each group of ``keys``.

    With distance weights, coincident neighbours alone decide: they come first, so the first one tells whether there are any.
    """
    first = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    if weights == "distance":
        exact = F.first("d").over(first) == 0
        w = F.when(exact, (F.col("d") == 0).cast("double")).otherwise(1 / F.col("d"))
    else:
        w = F.lit(1.0)
    voted = near.withColumn("_w", w)
    return voted.withColumn("prob", F.sum(F.col("_w") * F.col("vote")).over(first) / F.sum("_w").over(first)).drop("_w")


def knn_predict(train: DataFrame, test: DataFrame, k: int = 5, weights: str = "uniform") -> DataFrame:
    """Share of (weighted) positive votes among the k nearest: (case_id, label, prob).

    With distance weights, coincident neighbours alone decide.
    """
    voted = _votes(nearest_neighbours(train, test, k), weights, ["case_id"])
    last = voted.groupBy("case_id", "label").agg(F.max_by("prob", "rank").alias("prob"))
    return last.select("case_id", "label", "prob")


def knn_search(train: DataFrame, ks: Sequence[int] = tuple(KNN_K), weights: Sequence[str] = tuple(KNN_WEIGHTS), n_splits: int = 10,
               n_repeats: int = 3, seed: int = 42) -> DataFrame:
    """(k, weights, score): mean accuracy over repeated stratified folds of every number of neighbours and weighting.

    The longest neighbour lists of all folds and repeats are found in one pass; shorter ones are their beginnings.
    """
    folds = stratified_folds(train, n_splits, n_repeats, seed).groupBy("case_id").agg(
        F.sort_array(F.collect_list(F.struct("rep", "fold"))).alias("_f")
    )
    rows = durable(train.join(folds.select("case_id", F.col("_f.fold").alias("folds")), "case_id"))
    near = durable(nearest_neighbours(rows, rows, max(ks), reps=n_repeats))
    fold = rows.select(F.col("case_id").cast("string").alias("case_id"), F.posexplode("folds").alias("rep", "fold"))
    out = None
    for kind in weights:
        voted = _votes(near, kind, ["case_id", "rep"])
        # A case with fewer than k neighbours keeps the vote of all it has.
        wanted = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
        voted = voted.select("case_id", "rep", "label", "rank", "prob", wanted).filter("rank <= k")
        voted = voted.groupBy("case_id", "rep", "label", "k").agg(F.max_by("prob", "rank").alias("prob"))
        hit = ((F.col("prob") > 0.5).cast("int") == F.col("label")).cast("double")
        part = voted.join(fold, ["case_id", "rep"]).groupBy("k", "rep", "fold").agg(F.avg(hit).alias("hit"))
        part = part.groupBy("k").agg(F.avg("hit").alias("score")).select("k", F.lit(kind).alias("weights"), "score")
        out = part if out is None else out.unionByName(part)
    return out


def knn_tuned(train: DataFrame, ks: Sequence[int] = tuple(KNN_K), weights: Sequence[str] = tuple(KNN_WEIGHTS), n_splits: int = 10,
              n_repeats: int = 3, seed: int = 42) -> Callable[[DataFrame], DataFrame]:
    """Nearest neighbours by the best setting of ``knn_search``; the smaller k, then the first weighting, wins a tie."""
    table = knn_search(train, ks, weights, n_splits, n_repeats, seed).collect()  # one row per setting
    best = max(table, key=lambda r: (r["score"], -r["k"], -list(weights).index(r["weights"])))
    return lambda df: knn_predict(train, df, best["k"], best["weights"])


def smote(df: DataFrame, k: int = 5, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """Original rows plus synthetic minority rows up to ``ratio`` of the majority (case_id, label, values).

    Minority rows and neighbours are used in turn by hash order, the position between both by a second hash.
    """
    sizes = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    minor = min(sizes, key=lambda c: (sizes[c], c))
    n_minor, n_new = sizes[minor], max(0, int(ratio * max(sizes.values())) - min(sizes.values()))
    few = df.filter(F.col("label") == minor).select("case_id", "label", "values")
    near = nearest_neighbours(few, few, k, exclude_self=True)
    near = near.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("d", "neighbour"))).alias("near"))
    copies = (
        F.lit(n_new // n_minor) + F.when(F.col("_rank") <= n_new % n_minor, 1).otherwise(0)
    ).cast("int")
    from .frame import _class_ranks

    order = _class_ranks(few.select("case_id", "label"), seed).select("case_id", "_rank")
    plan = few.join(order, "case_id").join(near, "case_id").withColumn("_copies", copies).filter("_copies > 0")
    plan = plan.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    digest = F.md5(F.concat_ws("|", F.col("case_id"), F.col("_i").cast("string"), F.lit(str(seed))))
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(16**8))
    pick = F.pmod(F.conv(F.substring(digest, 9, 7), 16, 10).cast("long"), F.size("near")).cast("int")
    plan = plan.withColumn("_share", share).withColumn("neighbour", F.get("near", pick)["neighbour"])
    other = few.select(F.col("case_id").alias("neighbour"), F.col("values").alias("_other"))
    mixed = F.zip_with("values", "_other", lambda a, b: a + (b - a) * F.col("_share"))
    made = plan.join(other, "neighbour").select(
        F.concat_ws("-", F.col("case_id"), F.lit("synthetic"), F.col("_i")).alias("case_id"), "label", mixed.alias("values")
    )
    return df.select("case_id", "label", "values").unionByName(made)


# ---------------------------------------------------------------------------------------------- tuning


def _unit(seed: int, trial: int, name: str) -> float:
    digest = hashlib.md5(f"{seed}|{trial}|{name}".encode()).hexdigest()
    return int(digest[:12], 16) / float(16**12)


def random_search(train: DataFrame, valid: DataFrame, n_trials: int = 300, seed: int = 42, max_iter: int = 100):
    """Random search of logistic settings by validation area. Returns (trial table, scorer of the best trial).

    All trials are trained together, and scored in one pass over the validation rows.
    """
    settings = [
        {
            "c": 10 ** (-2 + 2 * _unit(seed, t, "C")),
            "tol": 1e-6 + (1e-3 - 1e-6) * _unit(seed, t, "tol"),
            "intercept": _unit(seed, t, "intercept") < 0.5,
        }
        for t in range(n_trials)
    ]
    rows = _batch_rows(train, 0, 0, seed)
    try:
        weights = batched.search(rows, settings, "logistic", 0, 0, max_iter)[1]
    finally:
        rows.unpersist()

    def margins(batches):
        for batch in batches:
            x = np.stack(batch["values"].to_numpy())
            for t, w in enumerate(weights):
                yield pd.DataFrame({"method": str(t), "label": batch["label"], "prob": 1 / (1 + np.exp(-(x @ w[1:] + w[0])))})

    scored = valid.select("label", vector_to_array("features").alias("values"))
    areas = auc(scored.mapInPandas(margins, "method string, label int, prob double")).select("method", "auc").collect()
    area = {int(r["method"]): r["auc"] for r in areas}
    table = [(t, s["c"], s["tol"], s["intercept"], area[t]) for t, s in enumerate(settings)]
    best = max(range(n_trials), key=lambda t: (area[t], -t))
    schema = "trial int, c double, tol double, intercept boolean, auc double"
    return train.sparkSession.createDataFrame(table, schema), _logistic(weights[best])


def prediction_frame(scored: dict[str, DataFrame]) -> DataFrame:
    """Ids, label and one probability column per method, as one pivoted union instead of a join per method."""
    out = None
    for method, df in scored.items():
        part = df.select("case_id", "label", F.lit(method).alias("method"), "prob")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("case_id", "label").pivot("method", list(scored)).agg(F.first("prob"))


