"""Frames, scores, selection, learners, evaluation and pipelines."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from helpers import feature_rows, separable
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortlens.functions import keys
from cohortlens.functions.gram import covariance, local_gram
from cohortlens.operators import batched, evaluation, forest, frame, models, neighbours, scoring, selection
from cohortlens.operators.lasso import lasso_tables
from cohortlens.plans import pipelines
from cohortlens.sources import checks, tables


@pytest.fixture(scope="module")
def feat(spark):
    return feature_rows(spark, *separable()).persist()


@pytest.fixture(scope="module")
def vectors(feat):
    return frame.to_vectors(feat).persist()


def kept(support):
    return sorted(r["feature"] for r in support.filter("keep").collect())


def test_constant_feature_scales_to_zero_and_is_filtered(spark):
    x = np.column_stack([np.arange(10.0), np.full(10, 3.0)])
    df = feature_rows(spark, x, np.arange(10) % 2)
    assert {r["value"] for r in frame.min_max(df).filter("feature = 'f01'").collect()} == {0.0}
    assert frame.exclude_low_variance(df, 0.01).select("feature").distinct().count() == 1


def test_missing_values_are_rejected(spark):
    df = spark.createDataFrame([("a", 0, 0, None), ("a", 0, 1, 1.0)], "case_id string, label int, ord int, value double")
    with pytest.raises(Exception, match="null or NaN"):
        frame.to_arrays(df).collect()


def test_split_and_folds_are_stratified(feat):
    cases = feat.select("case_id", "label").distinct()
    split = frame.stratified_split(cases, 0.25)
    table = {(r["split"], r["label"]): r["count"] for r in split.groupBy("split", "label").count().collect()}
    assert table == {("test", 0): 10, ("test", 1): 10, ("train", 0): 30, ("train", 1): 30}
    folds = frame.stratified_folds(cases, 5, 2)
    assert folds.count() == 160 and folds.select("case_id", "rep").distinct().count() == 160
    sizes = [r["count"] for r in folds.groupBy("rep", "fold", "label").count().collect()]
    assert set(sizes) == {8}


def test_split_of_a_single_class(spark):
    df = spark.createDataFrame([(str(i), 1) for i in range(7)], "case_id string, label int")
    assert frame.stratified_split(df, 0.3).filter("split = 'test'").count() == 3


def test_mutual_information_with_ties_and_small_chunks(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 60)
    x = np.column_stack([rng.normal(size=60) + y, rng.integers(0, 5, 60), np.full(60, 1.0)])
    df = feature_rows(spark, x, y)
    psi = np.concatenate([[np.nan], -0.5772156649015329 + np.concatenate([[0], np.cumsum(1 / np.arange(1, 100))])])
    want = []
    for j in range(3):
        total = 0.0
        for i in range(60):
            same = [k for k in range(60) if y[k] == y[i] and k != i]
            k = min(3, len(same))
            r = np.sort(np.abs(x[same, j] - x[i, j]))[k - 1]
            gap = np.abs(x[:, j] - x[i, j])
            m = (gap < r).sum() if r > 0 else (gap <= 0).sum()
            total += psi[k] - psi[len(same) + 1] - psi[m]
        want.append(max(0.0, psi[60] + total / 60))
    for chunks in (3, 1024):
        got = {r["ord"]: r["score"] for r in scoring.mi_scores(df, chunks=chunks).collect()}
        assert [got[j] for j in range(3)] == pytest.approx(want, abs=1e-9)


def test_digamma_above_the_harmonic_limit(spark):
    row = spark.range(1).select(scoring.digamma(F.lit(1000)).alias("p"), scoring.digamma(F.lit(64)).alias("q")).first()
    harmonic = lambda n: sum(1 / i for i in range(1, n)) - 0.5772156649015329
    assert row["p"] == pytest.approx(harmonic(1000), abs=1e-12) and row["q"] == pytest.approx(harmonic(64), abs=1e-12)


def test_cross_products_equal_numpy(feat):
    x, y = separable()
    n, mean, cross = covariance(local_gram(frame.to_arrays(feat))["all"])
    full = np.column_stack([x, y])
    assert n == 80 and mean == pytest.approx(full.mean(0))
    assert cross / (n - 1) == pytest.approx(np.cov(full.T))


@pytest.mark.parametrize("method", ["chi2", "anova", "mutual_information", "mrmr"])
def test_top_k_filters_find_the_signal(feat, method):
    support = selection.SELECTORS[method](feat, n_feature=2)
    assert "f00" in kept(support) and len(kept(support)) == 2


def test_k_equal_to_p_keeps_everything(feat):
    assert len(kept(selection.f_select(feat, n_feature=4))) == 4
    assert len(kept(selection.rf_importance_select(feat, 10, n_feature=4))) == 4


def test_relief_and_forest_cut_offs(feat):
    assert "f00" in kept(selection.relief_select(feat, 30, n_feature=2))
    assert len(kept(selection.rf_importance_select(feat, 20, n_feature=1))) == 2


def test_lasso_path_starts_at_zero_and_ends_at_least_squares(feat):
    x, y = separable()
    errors, coefs = selection.lasso_tables(feat, folds=4, n_alphas=20, eps=1e-6)
    table = coefs.toPandas()
    assert errors.count() == 20 and (table[table.step == 0].coef.abs() < 1e-9).all()
    design = np.column_stack([np.ones(80), x])
    want = np.linalg.lstsq(design, y, rcond=None)[0][1:]
    assert table[table.step == 19].sort_values("feature").coef.to_numpy() == pytest.approx(want, abs=1e-4)
    assert "f00" in kept(selection.lasso_select(feat, 4, 20))


def test_lasso_by_working_sets_is_optimal_in_every_column(spark):
    """A set of 8 of 60 columns at the start: several rounds, the same path as with all columns at once, and optimal by numpy."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 60)) * np.exp(rng.normal(size=60)) + rng.normal(size=60) * 10
    x[:, 59] = x[:, 3] * 2  # a column repeated in another unit
    x[:, 58] = 4.0  # a constant one
    unit = (x - x.mean(0)) / np.maximum(x.std(0), 1e-9)
    y = (unit[:, 3] - unit[:, 17] + rng.normal(size=90) > 0).astype(int)
    rows = [(f"c{i:02d}", int(y[i]), f"f{j:02d}", j * 3, float(x[i, j])) for i in range(90) for j in range(60)]
    feat = spark.createDataFrame(rows, "case_id string, label int, feature string, ord int, value double")
    (errors, coefs), (errors_all, coefs_all) = (lasso_tables(feat, 3, 12, 1e-2, width=w) for w in (8, 60))
    got, want = errors.toPandas().sort_values("step"), errors_all.toPandas().sort_values("step")
    assert len(got) == 12 and got[["mean", "min", "max"]].to_numpy() == pytest.approx(want[["mean", "min", "max"]].to_numpy(), rel=1e-5)
    table = coefs.toPandas()
    assert len(table) == 12 * 60
    centred, target = x - x.mean(0), y - y.mean()
    for alpha, part in table.groupby("alpha"):
        b = part.sort_values("feature").coef.to_numpy()
        assert b[58] == 0
        pull = centred.T @ (target - centred @ b) / 90
        slack = 1e-5 * centred.std(axis=0) + 1e-12
        assert (np.abs(pull) - alpha <= slack).all()
        assert (np.abs(pull - np.sign(b) * alpha)[b != 0] <= slack[b != 0]).all()
    folds = frame.stratified_folds(feat.select("case_id", "label").distinct(), 3, 1, 42).toPandas().set_index("case_id").fold
    of = folds.loc[[f"c{i:02d}" for i in range(90)]].to_numpy()
    first = got[got.step == 0]  # no coefficient: the mean of the others
    mse = [np.mean((y[of == f] - y[of != f].mean()) ** 2) for f in range(3)]
    assert first["max"].iloc[0] == pytest.approx(max(mse), rel=0.05)


def test_cross_products_by_group_hold_one_matrix(spark):
    rng = np.random.default_rng(2)
    x, g = rng.normal(size=(50, 300)), rng.integers(0, 4, 50)
    rows = spark.createDataFrame([(x[i].tolist(), int(i % 2), int(g[i])) for i in range(50)], "values array<double>, label int, g int")
    found = local_gram(rows.repartition(3), "g")
    for k in range(4):
        design = np.column_stack([np.ones(50), x, np.arange(50) % 2])[g == k]
        assert found[str(k)] == pytest.approx(design.T @ design)


def test_wrappers(feat):
    assert "f00" in kept(selection.sequential_select(feat, "forward", "lasso", 3, n_feature=1))
    assert "f00" in kept(selection.rfe_cv(feat, step=2, folds=2, max_iter=5))


def test_boruta_confirms_the_signal_and_rejects_noise(feat):
    rows = {r["feature"]: r for r in selection.boruta_select(feat, max_iter=20, trees=15).collect()}
    assert [f for f, r in rows.items() if r["keep"]] == ["f00"]
    rounds = rows["f00"]["score"]
    assert rounds >= 7 and all(r["score"] < rounds for f, r in rows.items() if f != "f00")


def test_shuffled_is_a_permutation_that_can_be_had_in_parts():
    for n in (1, 2, 3, 17, 64, 1000):
        whole = keys.shuffled(np.arange(n), n, 7, 1)
        assert sorted(whole) == list(range(n))
        assert list(whole[n // 2 :]) == list(keys.shuffled(np.arange(n // 2, n), n, 7, 1))
    places = np.stack([keys.shuffled(np.arange(40), 40, 7, k) for k in range(2000)])
    assert abs(places.mean(0) - 19.5).max() < 1.5 and abs(np.corrcoef(places.T) - np.eye(40) + 1 / 39 * (1 - np.eye(40))).max() < 0.1


def test_shadows_hold_each_column_permuted(feat, monkeypatch):
    monkeypatch.setattr(selection, "BLOCK_VALUES", 1)
    monkeypatch.setattr(selection, "LEAST_CASES", 7)
    names = selection.feature_names(feat)
    cases = selection.numbered_cases(feat, len(names)).persist()
    real = {r["case"]: r for r in cases.collect()}
    n, columns = len(real), [0, 2, 3]
    assert sorted(real) == list(range(n))
    rows = [(r["label"], r["weight"], r["features"].toArray()) for r in selection.with_shadows(cases, n, columns, len(names), [5, 6]).collect()]
    own = np.array([[real[i]["values"][c] for c in columns] for i in range(n)])
    got = np.array([r[2] for r in rows])
    assert Counter((a, b, *x[:3]) for a, b, x in rows) == Counter((real[i]["label"], real[i]["weight"], *own[i]) for i in range(n))
    for k in range(3, 9):
        assert sorted(got[:, k]) == sorted(own[:, k % 3]) and list(got[:, k]) != list(got[:, k % 3])
    order = [np.argsort(got[:, k], kind="stable").tolist() for k in range(3, 9)]
    assert all(a != b for i, a in enumerate(order) for b in order[:i])  # no two shadows share a permutation


def test_repeated_cases_are_cases_of_their_own(feat):
    names = selection.feature_names(feat)
    once = Counter((r["label"], *r["values"]) for r in selection.numbered_cases(feat, len(names)).collect())
    some = feat.filter(F.col("case_id") == feat.agg(F.min("case_id")).first()[0])
    twice = Counter((r["label"], *r["values"]) for r in selection.numbered_cases(feat.unionByName(some), len(names)).collect())
    assert sum((twice - once).values()) == 1 and not once - twice


def test_boruta_decisions():
    assert selection._discoveries([0.001, 0.02, 0.2, 0.9], 0.05) == [True, True, False, False]
    assert selection._discoveries([0.2, 0.9], 0.05) == [False, False]
    assert selection.boruta_decisions([5, 0, 3], [0, 0, 0], 5, 0.05) == [0, 0, 0]  # 1/32 is no more than 0.05/5 in no feature
    assert selection.boruta_decisions([10, 0, 5], [0, 0, 0], 10, 0.05) == [1, -1, 0]
    assert selection.boruta_decisions([10, 0, 5], [0, -1, 1], 10, 0.05) == [1, -1, 1]  # what is decided stays


@pytest.mark.parametrize("direction,n", [("forward", 3), ("backward", 6)])
def test_lasso_sequence_is_that_of_all_subsets(spark, direction, n):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(70, 8)) * np.array([1, 10, 0.1, 1, 1, 1, 1, 1]) + np.array([0, 5, 0, 0, 0, 100, 0, 0])
    y = (x[:, 1] / 10 + x[:, 2] * 6 + 0.5 * x[:, 6] + rng.normal(size=70) > 0.5).astype(int)
    rows = [(f"c{i:02d}", int(y[i]), f"f{j}", j, float(x[i, j])) for i in range(70) for j in range(8)]
    feat = spark.createDataFrame(rows, "case_id string, label int, feature string, ord int, value double")
    folds = frame.stratified_folds(feat.select("case_id", "label").distinct(), 5, 1, 42).toPandas().set_index("case_id").fold
    of = folds.loc[[f"c{i:02d}" for i in range(70)]].to_numpy()
    design = np.column_stack([np.ones(70), x, y])

    def score(columns):
        at = [0, *[c + 1 for c in columns], 9]
        products = {str(f): design[of == f][:, at].T @ design[of == f][:, at] for f in range(5)}
        return selection._subset_score(products, design.std(axis=0, ddof=1)[at[1:]])

    current = [] if direction == "forward" else list(range(8))
    while len(current) != n:
        options = [sorted({*current} ^ {c}) for c in range(8) if (c in current) == (direction == "backward")]
        current = max(options, key=score)
    got = selection.sequential_select(feat, direction, "lasso", n_feature=n).filter("keep").collect()
    assert sorted(int(r["feature"][1:]) for r in got) == current
    assert [r["score"] for r in got] == pytest.approx([score(current)] * n, abs=1e-5)


def test_chain_and_support_persistence(spark, feat, folder):
    support = selection.run_selection(feat, [("anova", {"n_feature": 3}), ("chi2", {"n_feature": 1})])
    tables.save_support(support, f"{folder}/support")
    again = tables.load_support(spark, f"{folder}/support")
    assert {r["step"]: r["n_kept"] for r in selection.survivors(again).collect()} == {1: 3, 2: 1}
    assert selection.apply_support(feat, again).select("feature").distinct().count() == 1


def area(scored):
    return evaluation.auc(scored.withColumn("method", F.lit("m"))).first()["auc"]


@pytest.mark.parametrize(
    "fit",
    [
        lambda t: models.logistic_cv(t, (1.0,)),
        lambda t: models.svm_linear(t, (1,)),
        lambda t: models.decision_tree(t, ("gini",)),
        lambda t: models.random_forest(t, (10,), (3,), ("sqrt",), (2,), (True,)),
        lambda t: models.adaboost(t, 3, algorithm="SAMME"),
        lambda t: models.adaboost(t, 3, algorithm="SAMME.R"),
        lambda t: models.gaussian_process(t, 0.2, 32),
    ],
    ids=["logistic", "svm", "tree", "forest", "samme", "samme.r", "gp"],
)
def test_learners_separate_and_give_probabilities(vectors, fit):
    out = fit(vectors)(vectors).persist()
    assert out.filter("prob < 0 or prob > 1 or prob is null").count() == 0
    assert area(out) > 0.85


def test_quadratic_discriminant_and_bayes(feat):
    rows = frame.to_arrays(feat)
    assert area(models.qda(rows)(rows)) > 0.9
    assert area(models.gaussian_nb(feat, feat)) > 0.9


@pytest.mark.parametrize("block,cell,exclude_self", [(16, 10_000, True), (16, 8, True), (2048, 4, False)])
def test_neighbours_across_blocks_and_cells(feat, monkeypatch, block, cell, exclude_self):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    monkeypatch.setattr(neighbours, "CELL_ROWS", cell)
    monkeypatch.setattr(neighbours, "VISITS", 2)
    rows = frame.to_arrays(feat)
    found = neighbours.nearest_neighbours(rows, rows, 3, exclude_self).collect()
    got = {(r["case_id"], r["neighbour"], r["rank"]) for r in found}
    x, _ = separable()
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    if exclude_self:
        np.fill_diagonal(d, np.inf)
    want = {(f"c{i:03d}", f"c{j:03d}", n + 1) for i in range(80) for n, j in enumerate(np.argsort(d[i])[:3])}
    assert got == want


def clustered(spark, n, seed=0, copies=0):
    """Rows around 40 far apart centres; the first ``copies`` rows are equal."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 100, (40, 5))[rng.integers(0, 40, n)] + rng.normal(0, 1, (n, 5))
    x[:copies] = x[0]
    rows = [(f"r{i:04d}", int(v[0] > 0), [float(e) for e in v]) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "case_id string, label int, values array<double>")


def test_most_cells_are_never_visited(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 16)
    x, rows = clustered(spark, 1200)
    visits, cells = neighbours.routes(rows, rows, 4)
    assert cells > 50 and visits.count() < 0.25 * len(x) * cells
    got = {(r["case_id"], r["neighbour"]) for r in neighbours.nearest_neighbours(rows, rows, 4).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert got == {(f"r{i:04d}", f"r{j:04d}") for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[:4]}


def test_neighbours_among_copies_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 8)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    x, rows = clustered(spark, 120, 3, copies=60)  # one cell holds half of all rows
    got = {(r["case_id"], r["neighbour"]) for r in neighbours.nearest_neighbours(rows, rows, 3).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert got == {(f"r{i:04d}", f"r{j:04d}") for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[:3]}
    few, none = rows.limit(2), rows.filter("label > 5")
    assert neighbours.nearest_neighbours(few, rows, 5).count() == 2 * len(x)
    assert neighbours.nearest_neighbours(none, rows, 5).count() == 0 == neighbours.nearest_neighbours(rows, none, 5).count()


def test_visits_hold_blocks_of_rows_and_pass_on_what_is_near_enough(feat, monkeypatch):
    """Rows are not packed to lists (a batch of lists has no bound), and a visit passes on nothing beyond the row's limit."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 1000)
    rows = frame.to_arrays(feat)
    train, cells, n = neighbours.build_cells(rows)
    assert train.count() == n == 80 and dict(train.dtypes)["values"] == "array<double>"
    asked = neighbours._routed(rows, cells, 3, False)
    near = neighbours._visited(train, asked, 3, False, 0)
    everything, limit = near.count(), near.agg(F.expr("median(d)")).first()[0]
    held = neighbours._visited(train, asked.withColumn("limit", F.lit(limit)), 3, False, 0).agg(F.count("*"), F.max("d")).first()
    assert 0 < held[0] < everything and held[1] <= limit


def test_products_of_far_away_rows_lose_no_neighbour():
    rng = np.random.default_rng(0)
    for shift in (0.0, 1e6):
        b, a = rng.normal(size=(50, 8)) + shift, rng.normal(size=(9, 8)) + shift
        mask = rng.random((9, 50)) < 0.3
        whole = np.where(mask, np.inf, np.sqrt(((a[:, None, :] - b) ** 2).sum(axis=2)))
        d = neighbours._Nearness(b).distances(a, [mask], 4)
        got, wanted = neighbours._best(np.where(mask, np.inf, d), 4), neighbours._best(whole, 4)
        assert all((x == y).all() for x, y in zip(got, wanted)) and (d[wanted] == whole[wanted]).all()


def test_forest_importance_holds_few_trees_at_a_time(feat, monkeypatch):
    grown = []

    class Forest(selection.RandomForestClassifier):
        def fit(self, *args):
            grown.append((self.getNumTrees(), self.getSeed()))
            return super().fit(*args)

    monkeypatch.setattr(selection, "RandomForestClassifier", Forest)
    rows = {r["feature"]: r for r in selection.rf_importance(feat, 10, seed=7).collect()}
    assert sum(n for n, _ in grown) == 10 and max(n for n, _ in grown) <= 4 and len({s for _, s in grown}) == len(grown)
    assert max(rows, key=lambda f: rows[f]["score"]) == "f00" and abs(sum(r["score"] for r in rows.values()) - 1) < 1e-9


def test_neighbour_search_is_that_of_every_fold(feat, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 10)
    rows = frame.to_arrays(feat)
    got = {(r["k"], r["weights"]): r["score"] for r in models.knn_search(rows, (1, 4, 9), n_splits=4, n_repeats=2).collect()}
    folds = frame.stratified_folds(rows, 4, 2, 42).toPandas()
    x, y = separable()
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    want = {key: [] for key in got}
    for (rep, fold), held in folds.groupby(["rep", "fold"]):
        test = sorted(int(c[1:]) for c in held.case_id)
        train = [i for i in range(80) if i not in test]
        for k, kind in want:
            hits = []
            for i in test:
                near = sorted(train, key=lambda j: (d[i, j], j))[:k]
                w = [1.0 if kind == "uniform" else 1 / d[i, j] for j in near]
                hits.append((sum(a * y[j] for a, j in zip(w, near)) / sum(w) > 0.5) == y[i])
            want[k, kind].append(np.mean(hits))
    assert got == pytest.approx({key: np.mean(v) for key, v in want.items()})
    assert area(models.knn_tuned(rows, (1, 9), n_splits=4, n_repeats=1)(rows)) > 0.9


def test_smote_balances(feat):
    few = frame.to_arrays(feat).filter("label = 1 or case_id < 'c020'")
    sizes = {r["label"]: r["count"] for r in models.smote(few, 3).groupBy("label").count().collect()}
    assert sizes == {0: 40, 1: 40}


def batch_rows(spark, n=160, p=5, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.7 * rng.normal(size=n) > 0.2).astype(float)
    folds = np.stack([rng.integers(0, 4, n), rng.integers(0, 4, n)], axis=1)
    rows = [(float(b), [float(e) for e in a], 1.0, [int(e) for e in f]) for a, b, f in zip(x, y, folds)]
    return x, y, folds, spark.createDataFrame(rows, "label double, values array<double>, weight double, folds array<int>").coalesce(3)


def test_batched_columns_are_optimal_alone(spark):
    x, y, folds, rows = batch_rows(spark)
    settings = [{"c": 0.1}, {"c": 100.0}, {"c": 1.0, "intercept": False}]
    mixed = [{"l1": 0.05, "l2": 0.02}, {"l1": 0.2}, {"l2": 0.3}]
    for batch, of in (batched.columns(settings, 4, 2, 1e-12), batched.columns(mixed, 4, 2, 1e-12)):
        w = batched.fit(rows, batch, max_iter=250)
        assert len(w) == 27
        for j in range(len(w)):
            use = np.ones(len(y), bool) if batch.fold[j] < 0 else folds[:, batch.rep[j]] != batch.fold[j]
            prob = 1 / (1 + np.exp(-(x[use] @ w[j, 1:] + w[j, 0])))
            slope = x[use].T @ (prob - y[use]) / use.sum()
            l2 = batch.l2[j] if batch.c is None else 1 / (batch.c[j] * use.sum())
            slope = slope + l2 * w[j, 1:]
            assert np.abs(slope[w[j, 1:] != 0] + batch.l1[j] * np.sign(w[j, 1:][w[j, 1:] != 0])).max(initial=0) < 1e-4
            assert np.abs(slope[w[j, 1:] == 0]).max(initial=0) <= batch.l1[j] + 1e-4
            if batch.intercept[j]:
                assert abs((prob - y[use]).mean()) < 1e-4
            else:
                assert w[j, 0] == 0
    assert (w[of == 1][:, 1:] == 0).any() and (w[of == 2][:, 1:] != 0).all()


def test_batched_hinge_lowers_its_objective_as_far_as_a_long_descent(spark):
    x, y, _, rows = batch_rows(spark)
    batch, _ = batched.columns([{"l2": 0.05}], tol=1e-10)
    w = batched.fit(rows, batch, "hinge", 200)[0]

    def objective(v):
        loss, slope = batched.hinge_loss(x @ v[1:] + v[0], y)
        g = np.concatenate([[slope.mean()], x.T @ slope / len(y) + 0.05 * v[1:]])
        return loss.mean() + 0.025 * (v[1:] ** 2).sum(), g

    v = np.zeros(6)
    for i in range(20_000):
        v -= 0.05 * objective(v)[1]
    assert objective(w)[0] <= objective(v)[0] + 1e-5


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
    finally:
        found = spark.sparkContext.statusTracker().getJobIdsForGroup(name)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(found)


def test_jobs_do_not_grow_with_the_grid(spark):
    rows = batch_rows(spark)[-1].persist()
    batched.search(rows, [{"c": 1.0}], "logistic", 4, 2, 2)  # everything is held and compiled before jobs are counted
    counts = [
        jobs_of(spark, f"grid-{n}", lambda n=n: batched.search(rows, [{"c": 1.0 + i, "tol": 0.0} for i in range(n)], "logistic", 4, 2, 4))
        for n in (1, 40)
    ]
    rows.unpersist()
    assert counts[0] == counts[1] > 0


def test_search_scores_are_those_of_single_fits(spark, vectors):
    settings = [{"c": 0.01}, {"c": 10.0}]
    table, weights = models.linear_search(vectors, settings, n_splits=4, n_repeats=2, seed=5)
    found = [r["score"] for r in table.orderBy("config").collect()]
    folds = frame.stratified_folds(vectors, 4, 2, 5).toPandas().pivot(index="case_id", columns="rep", values="fold")
    x, y = separable()
    order = [f"c{i:03d}" for i in range(80)]
    for setting, score in zip(settings, found):
        hits = []
        for rep in range(2):
            of = folds.loc[order, rep].to_numpy()
            for f in range(4):
                part = [(float(y[i]), [float(e) for e in x[i]], 1.0) for i in np.flatnonzero(of != f)]
                rows = spark.createDataFrame(part, "label double, values array<double>, weight double").coalesce(1)
                w = batched.fit(rows, batched.columns([setting])[0])[0]
                hits.append(np.mean(((x[of == f] @ w[1:] + w[0]) > 0) == (y[of == f] > 0.5)))
        assert score == pytest.approx(np.mean(hits), abs=0.02)
    assert len(weights) == 5


def test_kernel_search_prefers_the_kernel_that_separates(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (160, 2))
    y = (np.hypot(x[:, 0], x[:, 1]) < 0.7).astype(int)
    rows = [(f"c{i:03d}", int(b), [float(e) for e in a]) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "case_id string, label int, values array<double>")
    vectors = df.select("case_id", "label", array_to_vector("values").alias("features"))
    score = models.svm_search(vectors, ("linear", "rbf", "poly"), (1, 100), n_components=64, n_splits=4, n_repeats=1)
    assert area(score(vectors)) > 0.97


def test_random_search_trains_all_trials_at_once(vectors):
    table, score = models.random_search(vectors, vectors, 12)
    rows = table.collect()
    assert len(rows) == 12 and all(0.01 <= r["c"] <= 1 and r["auc"] > 0.8 for r in rows)
    assert area(score(vectors)) == pytest.approx(max(r["auc"] for r in rows))


def test_grid_search_and_model_reuse(vectors, folder):
    est = LogisticRegression(maxIter=5)
    grid = [{est.regParam: 0.01}, {est.regParam: 0.1}]
    table, best = models.grid_search(est, grid, vectors, 3, 1)
    assert table.count() == 2 and best in grid
    first = tables.fit_or_load(est, vectors, f"{folder}/model")
    again = tables.fit_or_load(est, vectors, f"{folder}/model")
    assert first.coefficients == again.coefficients


def predictions(spark, rows):
    return spark.createDataFrame(rows, "label int, method string, prob double")


def test_curve_with_ties(spark):
    pred = predictions(spark, [(1, "m", 0.9), (0, "m", 0.9), (1, "m", 0.5), (0, "m", 0.1)])
    points = {(r["threshold"], r["fpr"], r["tpr"]) for r in evaluation.roc_curve(pred).collect()}
    assert points == {(None, 0.0, 0.0), (0.9, 0.5, 0.5), (0.5, 0.5, 1.0), (0.1, 1.0, 1.0)}
    assert evaluation.auc(pred).first()["auc"] == pytest.approx(0.625)
    assert evaluation.youden_cutoff(pred).first()["cutoff"] == 0.5


def test_equal_scores_beat_nobody(spark):
    pred = predictions(spark, [(1, "m", 0.3), (0, "m", 0.3)])
    cutoff = evaluation.youden_cutoff(pred)
    assert evaluation.auc(pred).first()["auc"] == 0.5 and cutoff.first()["cutoff"] == float("inf")
    values = {r["metric"]: r["value"] for r in evaluation.metrics_report(pred, cutoff).collect()}
    assert values["recall"] == 0 and np.isnan(values["precision"]) and np.isnan(values["positive_llr"])


def test_calibration_edges(spark):
    pred = predictions(spark, [(0, "m", 0.0), (1, "m", 0.1), (1, "m", 1.0)])
    got = {r["bin"]: r["prob_true"] for r in evaluation.calibration_curve(pred).collect()}
    assert got == {0: 0.5, 9: 1.0}


def test_results_do_not_depend_on_partitions(spark, feat):
    for parts in (1, 8):
        scores = {r["feature"]: round(r["score"], 9) for r in scoring.f_scores(feat.repartition(parts)).collect()}
        if parts == 1:
            first = scores
    assert scores == first


def test_completeness_and_clinical_fallback(spark):
    cohort = spark.createDataFrame([("1", 0), ("2", 1)], "case_id string, label int")
    files = [("1", "A", "image"), ("1", "A", "mask"), ("2", "A", "image")]
    inventory = spark.createDataFrame(files, "case_id string, modality string, kind string")
    assert [tuple(r) for r in checks.missing_pairs(cohort, ["A"], inventory).collect()] == [("2", "A", "mask")]
    record = '{"Models":{"LabelDetailModel":{"table":{"7":{"性别":"F","年龄":"61","转移":"1"}}}}}'
    records = spark.createDataFrame([("1", record)], "case_id string, record string")
    fallback = spark.createDataFrame([("2", "M", "50", "0")], "case_id string, gender string, age string, label string")
    out = checks.clinical_lookup(cohort.select("case_id"), records, fallback).orderBy("case_id")
    assert [tuple(r) for r in out.collect()] == [("1", "F", "61", "1"), ("2", "M", "50", "0")]


def test_wide_table_round_trip(spark, feat, folder):
    wide = frame.to_wide(feat, ["f00", "f01", "f02", "f03"]).withColumnRenamed("case_id", "case_ids")
    tables.write_table(wide, f"{folder}/wide", "csv")
    back = tables.read_features(spark, f"{folder}/wide")
    assert back.select(*feat.columns).exceptAll(feat).isEmpty() and back.count() == feat.count()


def test_csv_cells_that_are_no_numbers_are_errors(spark, folder):
    spark.createDataFrame([("0012", "1", "x1"), ("b", "0", "2.5")], "case_ids string, label string, f string").write.option("header", True).csv(f"{folder}/bad")
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_features(spark, f"{folder}/bad").collect()
    spark.createDataFrame([("0012", "1"), ("b", "0")], "case_id string, label string").write.option("header", True).csv(f"{folder}/cohort")
    cohort = tables.read_cohort(spark, f"{folder}/cohort", "csv")
    assert {tuple(r) for r in cohort.collect()} == {("0012", 1), ("b", 0)}


def test_stage_reuse(spark, folder):
    made = []
    for _ in range(2):
        out = tables.materialize(spark, lambda: made.append(1) or spark.range(3).toDF("id"), f"{folder}/stage")
    assert out.count() == 3 and len(made) == 1


def test_stale_stages_are_written_anew(spark, folder):
    source, made = f"{folder}/source", []

    def stage(factor):
        rows = spark.read.parquet(source)
        make = lambda: made.append(factor) or rows.selectExpr(f"id * {factor} AS x")
        out = tables.materialize(spark, make, f"{folder}/scaled", [rows, {"factor": factor}])
        return sorted(r["x"] for r in out.collect())

    spark.range(3).write.mode("overwrite").parquet(source)
    assert stage(2) == [0, 2, 4] and stage(2) == [0, 2, 4] and made == [2]
    assert stage(3) == [0, 3, 6] and made == [2, 3]  # another setting
    spark.range(4).write.mode("overwrite").parquet(source)
    assert stage(3) == [0, 3, 6, 9] and stage(3) == [0, 3, 6, 9] and made == [2, 3, 3]  # another input


@pytest.mark.parametrize("on_train", [False, True])
def test_run_from_features(feat, folder, on_train):
    config = pipelines.RunConfig(
        methods=[("anova", {"n_feature": 2})], classifiers=[0, 4, 8, 9], classifier_options={0: {"c_values": (1.0,)}},
        scale_on_train=on_train, cutoff_from="train" if on_train else "test",
    )
    out = pipelines.run_from_features(feat, config, folder)
    assert out["ranking"].count() == 4 and out["ranking"].filter("rank = 1").first()["auc"] > 0.9
    assert out["metrics"].count() == 22 and out["predictions"].count() == 320


def test_range_chunks_are_even(spark):
    from cohortlens.functions.ordered import range_chunks

    df = spark.range(4000).select(F.lit("m").alias("k"), (F.pow("id", F.lit(4)) / 4000.0**4 * 1e-3).alias("v"))
    sizes = [r["count"] for r in range_chunks(df, ["k"], ["v"]).groupBy("_chunk").count().collect()]
    assert max(sizes) <= 2 * 4000 / len(sizes)


def test_mrmr_does_not_depend_on_scale(spark):
    rng = np.random.default_rng(0)
    y = np.arange(60) % 2
    columns = [(y + rng.normal(0, 0.3, 60)) * 1e-5, rng.normal(0, 1e9, 60), rng.normal(0, 1, 60), np.full(60, 3.0)]
    rows = [(str(i), int(y[i]), f"f{j}", j, float(c[i])) for j, c in enumerate(columns) for i in range(60)]
    feat = spark.createDataFrame(rows, "case_id string, label int, feature string, ord int, value double")
    ranked = [r["feature"] for r in selection.mrmr_ranking(feat, 4).orderBy("rank").collect()]
    assert ranked[0] == "f0" and sorted(ranked) == ["f0", "f1", "f2"]


def test_correlations_of_many_features(spark):
    """More features than the former limit of the heat map; the matrix stays a table."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 130)) * 10.0 ** rng.integers(-6, 6, 130)
    rows = [(str(i), i % 2, f"f{j:03d}", j, float(x[i, j])) for i in range(12) for j in range(130)]
    feat = spark.createDataFrame(rows, "case_id string, label int, feature string, ord int, value double")
    got = selection.correlation_matrix(feat).toPandas().pivot(index="f1", columns="f2", values="r").to_numpy()
    assert got == pytest.approx(np.corrcoef(x.T), abs=1e-9)


def brute_tree_gains(codes, y, w, depth):
    """Gains of a tree that tries every column, node by node."""
    gini = lambda at: sum(w[at][y[at] == c].sum() ** 2 for c in set(y)) / max(w[at].sum(), 1)
    gains = np.zeros(codes.shape[1])
    at = np.arange(len(y))
    if depth == 0 or len(set(y)) < 2:
        return gains
    splits = [(gini(at[codes[:, c] <= b]) + gini(at[codes[:, c] > b]) - gini(at), c, b) for c in range(codes.shape[1]) for b in set(codes[:, c])]
    gain, c, b = max(splits, key=lambda s: s[0])
    if gain < 1e-9:
        return gains
    gains[c] = gain
    left = codes[:, c] <= b
    return gains + sum(brute_tree_gains(codes[s], y[s], w[s], depth - 1) for s in (left, ~left))


def test_subtrees_are_those_of_node_by_node_growth():
    rng = np.random.default_rng(6)
    for classes in (2, 3):
        codes, y = rng.integers(0, 32, (150, 4)).astype(np.uint8), rng.integers(0, classes, 150).astype(np.uint8)
        w = rng.integers(1, 4, 150)
        for depth in (1, 2, 30):
            got = forest.grow(codes, y, w, classes, 4, depth, rng)
            # Equal gains may be resolved otherwise deep down, so a whole tree is compared by its sum: the impurity of the root.
            want = brute_tree_gains(codes, y, w, depth)
            assert got.sum() == pytest.approx(want.sum()) and (depth > 2 or got == pytest.approx(want))


def test_forest_grows_the_same_trees_by_levels_and_in_one_task(spark, monkeypatch):
    """Of two columns every node tries both, so a tree depends on its bag alone, not on where its nodes are grown."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 2))
    rows = [(i, int(x[i].sum() + rng.normal() > 0), x[i].tolist()) for i in range(900)]
    monkeypatch.setattr(forest, "BLOCK_VALUES", 200)
    blocks = forest.binned(spark.createDataFrame(rows, "case long, label int, values array<double>"), 2)
    assert blocks.count() >= 9
    counts = np.bincount([r[1] for r in rows])
    gains = []
    for most in (1, 1 << 20):
        monkeypatch.setattr(forest, "LOCAL_VALUES", most)
        gains.append(forest.RandomForestClassifier(3, 5, 3).fit(blocks, 2, counts))
    assert gains[0] == pytest.approx(gains[1]) and len(set(gains[0][:, 0])) == 3 and gains[0].sum(axis=1) == pytest.approx(np.ones(3))


def test_bin_edges_of_few_and_of_many_values(spark):
    rows = [([float(i % 3), float(i), 7.0, 0.0 if i else 1.0],) for i in range(1000)]
    few, many, one, rare = forest.bin_edges(spark.createDataFrame(rows, "values array<double>"), 4)
    assert few.tolist() == [0, 1] and one.tolist() == [] and rare.tolist() == [0] and len(many) == 31
    sizes = np.diff(np.concatenate([[0], np.searchsorted(np.arange(1000.0), many, "right"), [1000]]))
    assert sizes.min() > 25 and sizes.max() < 40


def test_forest_importance_counts_copies_as_cases(spark):
    """Rows that come twice made vectors of twice the length."""
    rows = [(f"c{i}", i % 2, f"f{j}", j, float(i % 2) if j == 1 else float(i * 7 % 5)) for i in range(40) for j in range(3)]
    rows += [r for r in rows if r[0] in ("c3", "c8")]
    scores = selection.rf_importance(spark.createDataFrame(rows, "case_id string, label int, feature string, ord int, value double"), 12)
    assert {r["feature"] for r in scores.collect() if r["score"] > 0.5} == {"f1"}


def test_forest_selection_reads_the_features_no_more_often_than_the_scores(feat, monkeypatch):
    """The number of features is that of the scores: the feature table, costly where it is large, is not evaluated for it."""
    monkeypatch.setattr(selection, "feature_names", None)
    assert len(kept(selection.rf_importance_select(feat, 4, n_feature=2))) == 3
