"""Feature selection: single selectors, their chain, and the stored supports.

A selector returns support rows (feature, ord, score, keep). Data are long (case_id, label, feature, ord, value).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.classification import RandomForestClassifier as ShallowForest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import durable, settled
from ..functions.gram import column_stats, covariance, gram
from ..functions.keys import k_from, shuffled
from .forest import RandomForestClassifier, binned
from .frame import stratified_folds, to_arrays, to_vectors, with_class_weights
from .lasso import descend, lasso_tables
from .models import MAX_TREE_DEPTH, knn_predict
from .scoring import chi2_scores, f_scores, mi_scores, relief_weights, select_k_best


def feature_names(feat: DataFrame) -> list[str]:
    """Feature names in ``ord`` order."""
    return [r["feature"] for r in feat.select("feature", "ord").distinct().orderBy("ord").collect()]


def _top_k(scores: DataFrame, k: int) -> DataFrame:
    kept = select_k_best(scores, k).select("feature", F.lit(True).alias("_kept"))
    return scores.join(kept, "feature", "left").select(
        "feature", "ord", "score", F.coalesce("_kept", F.lit(False)).alias("keep")
    )


def _support(feat: DataFrame, names: Sequence[str], scores, keep) -> DataFrame:
    rows = [(n, i, None if s is None else float(s), bool(b)) for i, (n, s, b) in enumerate(zip(names, scores, keep))]
    table = feat.sparkSession.createDataFrame(rows, "feature string, pos int, score double, keep boolean")
    ords = feat.select("feature", "ord").distinct()
    return table.join(ords, "feature").select("feature", "ord", "score", "keep")


# ---------------------------------------------------------------------------------------------- filters


def chi2_select(feat: DataFrame, **k) -> DataFrame:
    return _top_k(chi2_scores(feat), k_from(len(feature_names(feat)), **k))


def f_select(feat: DataFrame, **k) -> DataFrame:
    return _top_k(f_scores(feat), k_from(len(feature_names(feat)), **k))


def mi_select(feat: DataFrame, **k) -> DataFrame:
    return _top_k(mi_scores(feat), k_from(len(feature_names(feat)), **k))


def relief_select(feat: DataFrame, n_anchors: int = 100, seed: int = 42, **k) -> DataFrame:
    """Keep weights strictly above the (k+1)-th largest; with k = p everything above the smallest."""
    weights = relief_weights(feat, n_anchors, seed)
    p = len(feature_names(feat))
    at = min(k_from(p, **k), p - 1) + 1
    ranked = weights.withColumn("_r", F.row_number().over(Window.partitionBy().orderBy(F.col("score").desc())))
    limit = ranked.filter(F.col("_r") == at).select(F.col("score").alias("_limit"), F.lit(1).alias("_one"))
    joined = weights.withColumn("_one", F.lit(1)).join(limit, "_one")
    return joined.select("feature", "ord", "score", (F.col("score") > F.col("_limit")).alias("keep"))


def mrmr_ranking(feat: DataFrame, k: int, floor: float = 0.001) -> DataFrame:
    """Greedy relevance over redundancy: (rank, feature, score).

    One pass gives the correlations of all columns; they stay a table of one row per column, and each greedy step fetches
    the row of its pick, p numbers. A feature is constant only if its own values are all equal, whatever the others' scale.
    """
    names = feature_names(feat)
    rows = to_arrays(feat).persist()
    columns = column_stats(rows)
    n = rows.count()
    table = gram(rows, columns=columns).persist()

    def correlations(i: int) -> np.ndarray:
        return np.array(table.filter(F.col("i") == i + 1).first()["row"][1:]) / max(n - 1, 1)

    usable = columns.spread[:-1] > 0
    to_label = correlations(len(names))[:-1]
    relevance = to_label**2 * (n - 2) / np.maximum(1 - to_label**2, 1e-300)
    chosen: list[int] = []
    redundancy = np.zeros(len(names))
    out = []
    for rank in range(min(k, int(usable.sum()))):
        score = relevance if not chosen else relevance / np.maximum(redundancy / len(chosen), floor)
        score = np.where(usable, score, -np.inf)
        pick = int(np.argmax(score))
        out.append((rank + 1, names[pick], float(score[pick])))
        chosen.append(pick)
        usable[pick] = False
        redundancy += np.maximum(np.abs(correlations(pick)[:-1]), floor)
    table.unpersist()
    rows.unpersist()
    return feat.sparkSession.createDataFrame(out, "rank int, feature string, score double")


def mrmr_select(feat: DataFrame, **k) -> DataFrame:
    ranking = mrmr_ranking(feat, k_from(len(feature_names(feat)), **k))
    ords = feat.select("feature", "ord").distinct()
    return ords.join(ranking, "feature", "left").select("feature", "ord", "score", F.col("rank").isNotNull().alias("keep"))


# ---------------------------------------------------------------------------------------------- lasso


def _lasso_path(
    m: np.ndarray, alphas: Sequence[float], spread: np.ndarray, tol: float = 1e-7, sweeps: int = 1000
) -> tuple[np.ndarray, float]:
    """Coefficients for falling penalties, by coordinate descent on the cross products, and the mean response.

    ``spread`` is each column's own; a column stays out if it hardly varies against that, so no scale hides another.
    """
    n, mean, cross = covariance(m)
    g, c = cross[:-1, :-1] / n, cross[:-1, -1] / n
    b = np.zeros(len(c))
    path = []
    usable = np.flatnonzero((spread[:-1] > 0) & (np.diag(g) > 1e-12 * spread[:-1] ** 2))
    for alpha in alphas:
        b = descend(g, c, b, alpha, usable, tol, sweeps)
        path.append(b)
    return np.array(path), mean


def lasso_select(feat: DataFrame, folds: int = 10, n_alphas: int = 100, seed: int = 42) -> DataFrame:
    """Non-zero coefficients at the penalty with the smallest mean error."""
    errors, coefs = lasso_tables(feat, folds, n_alphas, seed=seed)
    best = errors.orderBy("mean", "step").limit(1).select("step")
    ords = feat.select("feature", "ord").distinct()
    return coefs.join(best, "step").join(ords, "feature").select(
        "feature", "ord", F.col("coef").alias("score"), (F.col("coef") != 0).alias("keep")
    )


# ---------------------------------------------------------------------------------------------- wrappers


#: Trees that are grown together, and lots of them that are under way at a time. Only their upper nodes come to the driver.
TREES_AT_ONCE, LOTS_AT_ONCE = 4, 4


def rf_importance(feat: DataFrame, trees: int = 100, seed: int = 0, max_depth: int = MAX_TREE_DEPTH) -> DataFrame:
    """Forest importances with their deviation over the trees (feature, ord, score, std); trees grow as deep as Spark lets them.

    The forest grows in lots of ``TREES_AT_ONCE`` trees, each with a seed of its own, of which only the importances are kept.
    Where the rows of a case come more than once, each copy is a case of its own.
    """
    known = feat.select("feature", "ord").distinct().orderBy("ord").collect()
    held = numbered_cases(feat, len(known))
    blocks = binned(held, len(known))
    counts = np.array([r["count"] for r in held.groupBy("label").count().collect()])

    def grown(first: int) -> np.ndarray:
        lot = RandomForestClassifier(numTrees=min(TREES_AT_ONCE, trees - first), seed=seed + first, maxDepth=max_depth)
        return lot.fit(blocks, len(known), counts)

    with ThreadPool(LOTS_AT_ONCE) as pool:
        each = np.concatenate(pool.map(grown, range(0, trees, TREES_AT_ONCE), chunksize=1))
    mean, std = each.sum(axis=0) / (each.sum() or 1.0), each.std(axis=0)
    rows = [(r["feature"], r["ord"], float(m), float(s)) for r, m, s in zip(known, mean, std)]
    kind = f"feature string, ord {feat.schema['ord'].dataType.simpleString()}, score double, std double"
    return feat.sparkSession.createDataFrame(rows, kind)


def rf_importance_select(feat: DataFrame, trees: int = 100, seed: int = 0, max_depth: int = MAX_TREE_DEPTH, **k) -> DataFrame:
    """Keep importances at or above the (k+1)-th largest, so k + 1 features without ties."""
    scores = rf_importance(feat, trees, seed, max_depth)
    p = scores.count()
    at = min(k_from(p, **k), p - 1) + 1
    ranked = scores.withColumn("_r", F.row_number().over(Window.partitionBy().orderBy(F.col("score").desc())))
    limit = ranked.filter(F.col("_r") == at).select(F.col("score").alias("_limit"), F.lit(1).alias("_one"))
    joined = scores.withColumn("_one", F.lit(1)).join(limit, "_one")
    return joined.select("feature", "ord", "score", (F.col("score") >= F.col("_limit")).alias("keep"))


def _cv_accuracy(data: DataFrame, columns: Sequence[int], estimator, folds: int) -> float:
    """Mean accuracy over the folds of the ``fold`` column on some vector positions."""
    sliced = VectorSlicer(inputCol="all", outputCol="features", indices=list(map(int, columns))).transform(data)
    evaluator = MulticlassClassificationEvaluator(metricName="accuracy")
    scores = []
    for f in range(folds):
        model = estimator.fit(sliced.filter(F.col("fold") != f))
        scores.append(evaluator.evaluate(model.transform(sliced.filter(F.col("fold") == f))))
    return float(np.mean(scores))


def _folded_vectors(feat: DataFrame, folds: int, seed: int) -> DataFrame:
    assigned = stratified_folds(feat.select("case_id", "label").distinct(), folds, 1, seed).select("case_id", "fold")
    return settled(to_vectors(feat, "all").join(assigned, "case_id"))


def rfe_cv(feat: DataFrame, step: int = 1, folds: int = 5, seed: int = 42, max_iter: int = 20) -> DataFrame:
    """Recursive elimination with a linear machine: drop the smallest squared weights, keep the best-scoring size.

    Each fold eliminates on its own training rows; the winning size is then reached on all rows.
    """
    names = feature_names(feat)
    data = _folded_vectors(feat, folds, seed)
    svm = LinearSVC(maxIter=max_iter, tol=1e-4, regParam=0.01, standardization=False)
    evaluator = MulticlassClassificationEvaluator(metricName="accuracy")

    def eliminate(train: DataFrame, test: DataFrame | None, stop: int):
        left = list(range(len(names)))
        scores = {}
        while True:
            cut = VectorSlicer(inputCol="all", outputCol="features", indices=left)
            model = svm.fit(cut.transform(train))
            if test is not None:
                scores[len(left)] = evaluator.evaluate(model.transform(cut.transform(test)))
            if len(left) <= stop:
                return left, scores
            weight = np.array(model.coefficients.toArray()) ** 2
            drop = set(np.argsort(weight, kind="stable")[: min(step, len(left) - stop)])
            left = [c for i, c in enumerate(left) if i not in drop]

    per_fold = [
        eliminate(data.filter(F.col("fold") != f), data.filter(F.col("fold") == f), 1)[1] for f in range(folds)
    ]
    mean = {size: float(np.mean([s[size] for s in per_fold])) for size in per_fold[0]}
    best = min(size for size in mean if mean[size] == max(mean.values()))
    kept = set(eliminate(data, None, best)[0])
    data.unpersist()
    return _support(feat, names, [mean[best]] * len(names), [i in kept for i in range(len(names))])


def sequential_select(
    feat: DataFrame, direction: str = "forward", estimator: str = "lasso", folds: int = 5, seed: int = 42, **k
) -> DataFrame:
    """Greedy forward or backward selection by cross-validated score of lasso, knn, svm or random_forest."""
    names = feature_names(feat)
    p = len(names)
    k_keep = min(k_from(p, **k), p)
    if estimator == "lasso":
        current, final = _lasso_sequence(feat, direction, folds, seed, k_keep)
    else:
        score = _candidate_score(feat, estimator, folds, seed)
        current = [] if direction == "forward" else list(range(p))
        while len(current) != k_keep:
            if direction == "forward":
                options = [sorted([*current, c]) for c in range(p) if c not in current]
            else:
                options = [[x for x in current if x != c] for c in current]
            current = max(options, key=score)
        final = score(current)
    return _support(feat, names, [final if i in current else None for i in range(p)], [i in current for i in range(p)])


def _subset_score(products: dict[str, np.ndarray], spread: np.ndarray) -> float:
    """Best mean explained share of variance over 10 penalties, from each fold's products of (1, columns, label)."""
    total = sum(products.values())
    n, _, cross = covariance(total)
    top = float(np.max(np.abs(cross[:-1, -1]))) / n
    alphas = [top * 10 ** (-3 * i / 9) for i in range(10)]
    r2 = []
    for held in products.values():
        path, mean = _lasso_path(total - held, alphas, spread, 1e-5)
        var = held[-1, -1] / held[0, 0] - (held[0, -1] / held[0, 0]) ** 2
        vs = [np.concatenate([[mean[-1] - b @ mean[:-1]], b, [-1.0]]) for b in path]
        r2.append([1 - v @ held @ v / held[0, 0] / var for v in vs])
    return float(np.max(np.mean(r2, axis=0)))


def _lasso_sequence(feat: DataFrame, direction: str, folds: int, seed: int, k_keep: int) -> tuple[list[int], float]:
    """Columns that a greedy search keeps, and their score.

    The cross products of every fold are one table (fold, i, row), summed in one pass over the data and kept there. A candidate is a row
    of a table of its own: tasks score candidates, each from the products of its few columns. For that, each step fetches the product
    rows of the columns that it holds: (columns held + 2) times (features) numbers per fold, never the whole table while searching forward.
    """
    assigned = stratified_folds(feat.select("case_id", "label").distinct(), folds, 1, seed).select("case_id", "fold")
    rows = to_arrays(feat).join(assigned, "case_id")
    stats = column_stats(rows)
    p = len(stats.mean) - 1
    scale = np.append(1.0, np.where(stats.spread > 0, stats.spread, 1.0))
    table = durable(gram(rows, "fold", columns=stats))
    groups = sorted(r["grp"] for r in table.select("grp").distinct().collect())
    # Of every column: its product with itself; of the constant and the label: their whole rows.
    own = {g: np.zeros(p + 2) for g in groups}
    for r in table.select("grp", "i", F.element_at("row", F.col("i") + 1).alias("v")).collect():
        own[r["grp"]][r["i"]] = r["v"]
    known: dict[int, dict[str, np.ndarray]] = {}

    def fetch(columns: Sequence[int]) -> None:
        new = [c for c in columns if c not in known]
        for r in table.filter(F.col("i").isin(new)).collect() if new else []:
            known.setdefault(r["i"], {})[r["grp"]] = np.array(r["row"])

    fetch([0, p + 1])
    spark, tasks = feat.sparkSession, int(feat.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def best(current: list[int], options: list[int], drop: bool) -> tuple[int, float]:
        fetch([c + 1 for c in current])
        held, diagonal, spread = dict(known), own, stats.spread  # what the tasks need, nothing else

        def products(columns: list[int]) -> dict[str, np.ndarray]:
            at = np.array([0, *[c + 1 for c in columns], p + 1])
            out = {}
            for g in groups:
                m = np.zeros((len(at), len(at)))
                for a, i in enumerate(at):
                    if i in held:
                        m[a, :] = m[:, a] = held[i][g][at]
                    m[a, a] = diagonal[g][i]
                out[g] = m * scale[at][:, None] * scale[at]
            return out

        def scored(batches):
            for batch in batches:
                found = []
                for c in batch["candidate"]:
                    columns = [x for x in current if x != c] if drop else sorted([*current, int(c)])
                    found.append(_subset_score(products(columns), spread[[*columns, -1]]))
                yield pd.DataFrame({"candidate": batch["candidate"], "score": found})

        table = spark.createDataFrame([(c,) for c in options], "candidate int").repartition(min(tasks, len(options)), "candidate")
        top = table.mapInPandas(scored, "candidate int, score double").orderBy(F.col("score").desc(), "candidate").first()
        return top["candidate"], top["score"]

    current = [] if direction == "forward" else list(range(p))
    score = float("nan")
    while len(current) != k_keep:
        drop = direction != "forward"
        pick, score = best(current, current if drop else [c for c in range(p) if c not in current], drop)
        current = [c for c in current if c != pick] if drop else sorted([*current, pick])
    if current and score != score:  # nothing was left to add or drop
        score = best(current[1:], current[:1], False)[1]
    return current, score


def _candidate_score(feat: DataFrame, estimator: str, folds: int, seed: int) -> Callable[[Sequence[int]], float]:
    data = _folded_vectors(feat, folds, seed)
    if estimator == "knn":

        def knn(columns: Sequence[int]) -> float:
            picked = F.array(*[vector_to_array("all")[c] for c in columns])
            rows = data.select("case_id", "label", "fold", picked.alias("values"))
            right = []
            for f in range(folds):
                out = knn_predict(rows.filter(F.col("fold") != f), rows.filter(F.col("fold") == f), 3)
                hit = (F.col("prob") > 0.5).cast("int") == F.col("label")
                right.append(out.agg(F.avg(hit.cast("double"))).first()[0])
            return float(np.mean(right))

        return knn
    models = {
        "svm": lambda: LinearSVC(maxIter=20, tol=1e-4, regParam=0.01, standardization=False),
        "random_forest": lambda: ShallowForest(numTrees=20, seed=0),
    }
    if estimator not in models:
        raise ValueError(f"unknown estimator {estimator!r}")
    return lambda columns: _cv_accuracy(data, columns, models[estimator](), folds)


#: Values, real and shadow, that a block of cases holds at most (of at least ``LEAST_CASES`` cases).
BLOCK_VALUES, LEAST_CASES = 1 << 19, 64


def numbered_cases(feat: DataFrame, width: int) -> DataFrame:
    """(case, label, weight, values) with the cases numbered from 0 without gaps; ``width`` values by ``ord``, weights by class.

    Where the rows of a case come more than once, each copy is a case of its own.
    """
    arrays = to_arrays(feat.select("case_id", "label", "feature", "ord", "value"))
    own = arrays.withColumn("copies", F.greatest(F.lit(1), F.floor(F.size("values") / width)).cast("int"))
    own = own.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    values = F.filter("values", lambda _, i: i % F.col("copies") == F.col("copy"))
    own = own.withColumn("values", F.when(F.col("copies") == 1, F.col("values")).otherwise(values)).drop("copies", "copy")
    held = durable(with_class_weights(own))
    sizes = dict(held.groupBy(F.spark_partition_id()).count().collect())
    first = np.cumsum([0, *(sizes.get(i, 0) for i in range(max(sizes, default=0)))]).tolist()  # one number per partition
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    case = F.array(*map(F.lit, first))[F.spark_partition_id()].cast("bigint") + inside
    return held.select(case.alias("case"), "label", F.col("weight").cast("double").alias("weight"), "values")


def _matrix(values, columns: Sequence[int], width: int) -> np.ndarray:
    """The chosen columns of a list column; every list must have ``width`` values."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    if not (np.diff(values.offsets.to_numpy()) == width).all():
        raise ValueError("a case lacks features, or has one twice")
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)[:, list(columns)]


def _scattered(batches, n: int, block: int, columns: Sequence[int], width: int, seeds: Sequence[int]):
    """(block, at, value): the values of the columns, once per seed, at the cases that a permutation of each column gives them to."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cases, own = batch.column("case").to_numpy(), _matrix(batch.column("values"), columns, width)
        for copy, seed in enumerate(seeds):
            to = np.stack([shuffled(cases, n, seed, c) for c in columns], axis=1)
            at = (to % block) * (len(columns) * len(seeds)) + copy * len(columns) + np.arange(len(columns))
            home = (to // block).ravel()
            order = np.argsort(home, kind="stable")
            cuts = np.flatnonzero(np.diff(home[order], prepend=-1))
            ends = pa.array([*cuts, len(order)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel()[order])) for x in (at, own)]
            yield pa.record_batch([pa.array(home[order][cuts]), *lists], ["block", "at", "value"])


def _gathered(real: pa.Table, cells: pa.Table, columns: Sequence[int], width: int, copies: int) -> pa.Table:
    """(label, weight, values) of one block: the columns, then their shadows."""
    real = real.sort_by("case")
    shadows = np.empty(real.num_rows * len(columns) * copies)
    for at, value in zip(*(cells.column(c).chunks for c in ("at", "value"))):
        shadows[at.flatten().to_numpy()] = value.flatten().to_numpy()
    both = np.hstack([_matrix(real.column("values"), columns, width), shadows.reshape(real.num_rows, -1)])
    ends = pa.array(np.arange(real.num_rows + 1) * both.shape[1], pa.int32())
    lists = pa.ListArray.from_arrays(ends, pa.array(both.ravel()))
    return pa.table([real.column("label"), real.column("weight"), lists], ["label", "weight", "values"])


def with_shadows(cases: DataFrame, n: int, columns: Sequence[int], width: int, seeds: Sequence[int]) -> DataFrame:
    """(label, weight, features): the chosen columns of ``numbered_cases``, then for every seed their shadows.

    A shadow is its column permuted over all cases, each by a permutation of its own. Values travel as packed lists, one per block of
    cases they go to, and a task holds one block at a time.
    """
    columns, copies = list(columns), len(seeds)
    block = max(LEAST_CASES, BLOCK_VALUES // (len(columns) * (1 + copies)))
    label = cases.schema["label"].dataType.simpleString()
    cells = cases.select("case", "values").mapInArrow(
        lambda b: _scattered(b, n, block, columns, width, seeds), "block bigint, at array<bigint>, value array<double>"
    )
    real = cases.withColumn("block", F.floor(F.col("case") / block))
    both = real.groupBy("block").cogroup(cells.groupBy("block")).applyInArrow(
        lambda a, b: _gathered(a, b, columns, width, copies), f"label {label}, weight double, values array<double>"
    )
    return both.select("label", "weight", array_to_vector("values").alias("features")).coalesce(max(1, -(-n // block)))


def _binomial_tail(hits: int, n: int) -> float:
    """P(X >= hits) for n fair coins."""
    return sum(math.comb(n, i) for i in range(hits, n + 1)) / 2**n


def _discoveries(tails: Sequence[float], alpha: float) -> list[bool]:
    """Step-up false-discovery rule: the largest rank i whose tail is at most alpha * i / n, and all smaller tails."""
    n = len(tails)
    passed = [t for i, t in enumerate(sorted(tails), 1) if t <= alpha * i / n]
    return [bool(passed) and t <= passed[-1] for t in tails]


#: Shadows that every round has at least.
LEAST_SHADOWS = 5


def boruta_decisions(hits: Sequence[int], decided: Sequence[int], rounds: int, alpha: float) -> list[int]:
    """1 confirmed, -1 rejected, 0 open, after ``rounds`` rounds.

    Two-sided test of the hits of all features that are not rejected: a tail must pass the false-discovery rule over these features,
    and alpha divided by the number of rounds, because it is looked at in every round.
    """
    alive = [i for i, d in enumerate(decided) if d >= 0]
    out = list(decided)
    tails = {
        1: [_binomial_tail(hits[i], rounds) for i in alive],
        -1: [_binomial_tail(rounds - hits[i], rounds) for i in alive],
    }
    for verdict, own in tails.items():
        for i, tail, found in zip(alive, own, _discoveries(own, alpha)):
            if decided[i] == 0 and found and tail <= alpha / rounds:
                out[i] = verdict
    return out


def boruta_select(feat: DataFrame, max_iter: int = 100, alpha: float = 0.05, trees: int = 100, seed: int = 1, max_depth: int = 5) -> DataFrame:
    """Features whose forest importance beats the best shadow more often than chance; ``score`` is the number of such rounds.

    Every round shuffles the features that are not rejected into shadows, fits one balanced forest on both, and decides
    features by ``boruta_decisions``; rejected ones leave, so later rounds are smaller. It ends when all are decided. Features that are
    still open after ``max_iter`` rounds are not kept.
    """
    names = feature_names(feat)
    held = numbered_cases(feat, len(names)).persist()
    n = held.count()
    hits, decided = [0] * len(names), [0] * len(names)
    for r in range(max_iter):
        alive = [i for i, d in enumerate(decided) if d >= 0]
        if not any(d == 0 for d in decided):
            break
        sets = -(-LEAST_SHADOWS // len(alive))
        rows = with_shadows(held, n, alive, len(names), [seed + r * sets + copy for copy in range(sets)]).persist()
        forest = ShallowForest(numTrees=trees, maxDepth=max_depth, seed=seed + r, weightCol="weight")
        gain = forest.fit(rows).featureImportances.toArray()
        rows.unpersist()
        best = gain[len(alive) :].max()
        for at, i in enumerate(alive):
            hits[i] += bool(gain[at] > best)
        decided = boruta_decisions(hits, decided, r + 1, alpha)
    held.unpersist()
    return _support(feat, names, hits, [d == 1 for d in decided])


# ---------------------------------------------------------------------------------------------- chain

SELECTORS: dict[str, Callable[..., DataFrame]] = {
    "chi2": chi2_select,
    "anova": f_select,
    "mutual_information": mi_select,
    "mrmr": mrmr_select,
    "relief": relief_select,
    "rfe": rfe_cv,
    "lasso": lasso_select,
    "random_forest": rf_importance_select,
    "sequential": sequential_select,
    "boruta": boruta_select,
}


def keep_features(feat: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of the kept features."""
    return feat.join(kept.select("feature"), "feature", "left_semi").select(*feat.columns)


def run_selection(train: DataFrame, methods: Sequence[tuple[str, dict]]) -> DataFrame:
    """Supports (step, method, feature, ord, score, keep) of a chain; every step is fitted on the survivors."""
    out = None
    current = train
    for step, (method, options) in enumerate(methods, start=1):
        found = SELECTORS[method](current, **options).select(
            F.lit(step).alias("step"), F.lit(method).alias("method"), "feature", "ord", "score", "keep"
        ).persist()
        out = found if out is None else out.unionByName(found)
        current = keep_features(current, found.filter("keep"))
    return out


def apply_support(feat: DataFrame, support: DataFrame) -> DataFrame:
    """Restrict any frame to the survivors of the last step."""
    last = support.agg(F.max("step").alias("step"))
    return keep_features(feat, support.filter("keep").join(last, "step", "left_semi"))


def survivors(support: DataFrame) -> DataFrame:
    """Number of kept features per step."""
    return support.groupBy("step", "method").agg(F.sum(F.col("keep").cast("long")).alias("n_kept"))


def correlation_matrix(feat: DataFrame) -> DataFrame:
    """Pearson correlations (f1, f2, r) of all features; null beside a constant one.

    The cross products of the centred, scaled columns are summed in one pass and stay a table of one row per column;
    pairs of cases or of rows are never formed, and the matrix does not reach the driver.
    """
    names = feature_names(feat)
    rows = to_arrays(feat)
    columns = column_stats(rows)
    flat = F.array(*[F.lit(bool(s == 0)) for s in columns.spread[:-1]])
    label = F.array(*[F.lit(n) for n in names])
    lines = gram(rows, columns=columns).filter((F.col("i") >= 1) & (F.col("i") <= len(names)))
    cells = lines.select(F.col("i"), F.col("row")[0].alias("_0"), F.posexplode(F.slice("row", 2, len(names))).alias("j", "xy"))
    count = F.lit(float(max(rows.count() - 1, 1)))
    constant = F.get(flat, F.col("i") - 1) | F.get(flat, F.col("j"))
    return cells.select(
        F.get(label, F.col("i") - 1).alias("f1"), F.get(label, F.col("j")).alias("f2"),
        F.when(~constant, F.col("xy") / count).alias("r"),
    )
