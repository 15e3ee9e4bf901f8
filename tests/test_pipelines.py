"""Whole runs on small volumes."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from helpers import volume_frame, voxel_frame

from cohortlens.plans import pipelines

SMALL = {"classes": ["first_order", "shape3d"], "filters": ["original"]}


@pytest.fixture(scope="module")
def cases():
    rng = np.random.default_rng(11)
    return {
        f"{i}": (rng.normal(3 * (i % 2), 1, (4, 4, 4)), (rng.random((4, 4, 4)) < 0.8).astype(int)) for i in range(16)
    }


def test_run_training(spark, cases, folder):
    vox, vol = voxel_frame(spark, cases), volume_frame(spark, cases)
    cohort = spark.createDataFrame([(c, int(c) % 2) for c in cases], "case_id string, label int")
    files = spark.createDataFrame(
        [(c, "A", k) for c in cases for k in ("image", "mask")], "case_id string, modality string, kind string"
    )
    config = pipelines.RunConfig(
        modalities=["A"], methods=[("anova", {"n_feature": 3})], classifiers=[8], variance_threshold=1e-6, **SMALL
    )
    out = pipelines.run_training(cohort, vox, vol, files, config, folder)
    assert out["ranking"].count() == 1 and out["support"].filter("keep").count() == 3

    def extracted():
        return sorted(spark.read.parquet(f"{folder}/features").inputFiles())

    first = extracted()
    pipelines.run_training(cohort, vox, vol, files, config, folder)
    assert extracted() == first
    pipelines.run_training(cohort, vox, vol, files, replace(config, binwidth=0.25), folder)
    assert not set(extracted()) & set(first)
    with pytest.raises(ValueError, match="has no mask"):
        pipelines.run_training(cohort, vox, vol, files.filter("not (case_id = '3' and kind = 'mask')"), config, folder)


def test_run_with_gate_weights_and_lasso_tables(spark, cases, folder):
    """A case whose mask has another size is left out and told; one classifier more trains that one alone."""
    vox, vol = voxel_frame(spark, cases), volume_frame(spark, cases)
    cohort = spark.createDataFrame([(c, int(c) % 2) for c in cases], "case_id string, label int")
    files = spark.createDataFrame(
        [(c, "A", k) for c in cases for k in ("image", "mask")], "case_id string, modality string, kind string"
    )
    dims = [(c, "A", 4, 4, 5 if c == "6" else 4) for c in cases]
    dims = spark.createDataFrame(dims, "case_id string, modality string, n_z int, n_y int, n_x int")
    config = pipelines.RunConfig(
        modalities=["A"], methods=[("anova", {"n_feature": 3}), ("lasso", {"folds": 2, "n_alphas": 5})], classifiers=[8],
        variance_threshold=1e-6, balance="weights", **SMALL,
    )
    out = pipelines.run_training(cohort, vox, vol, files, config, folder, dims)
    assert [r["case_id"] for r in out["geometry"].collect()] == ["6"]
    assert {r["case_id"] for r in out["predictions"].collect()} == set(cases) - {"6"}
    assert out["lasso_errors_2"].count() == 5 and out["lasso_coefficients_2"].count() == 15
    told = {r["key"]: r["value"] for r in out["summary"].collect()}
    assert told["seed"] == "setting=42" and told["balance"] == "setting=weights" and told["folder"] == f"path={folder}"
    assert told["extracted"] == "n_features=34"
    bayes = sorted(spark.read.parquet(f"{folder}/predictions/naive_bayes").inputFiles())
    more = replace(config, classifiers=[8, 5], classifier_options={5: {"impurities": ["gini"], "min_rows": [1]}})
    out = pipelines.run_training(cohort, vox, vol, files, more, folder, dims)
    assert out["ranking"].count() == 2
    assert sorted(spark.read.parquet(f"{folder}/predictions/naive_bayes").inputFiles()) == bayes
    written = spark.read.option("header", True).csv(f"{folder}/predictions_test")
    assert written.count() == out["predictions"].filter("split = 'test'").count()


def test_balance_of_training_rows(spark):
    rows = [(f"c{i:02d}", int(i < 5), [float(i), float(-i)]) for i in range(20)]
    arrays = spark.createDataFrame(rows, "case_id string, label int, values array<double>")
    plain, vectors = pipelines.balanced_rows(arrays, None)
    assert plain.count() == 20 and "weight" not in vectors.columns
    weights = {r["label"]: r["weight"] for r in pipelines.balanced_rows(arrays, "weights")[1].collect()}
    assert weights == {0: pytest.approx(20 / (2 * 15)), 1: pytest.approx(20 / (2 * 5))}
    made, vectors = pipelines.balanced_rows(arrays, "smote", 3)
    assert {r["label"]: r["count"] for r in made.groupBy("label").count().collect()} == {0: 15, 1: 15}
    assert vectors.count() == 30
    feat = spark.createDataFrame([("x", "b", 7), ("x", "a", 3)], "case_id string, feature string, ord int")
    long = {(r["feature"], r["ord"]): r["value"] for r in pipelines._long_again(arrays.filter("case_id = 'c04'"), feat).collect()}
    assert long == {("a", 3): 4.0, ("b", 7): -4.0}
    with pytest.raises(ValueError, match="unknown balance"):
        pipelines.balanced_rows(arrays, "other")


def test_mri_gate_and_files(spark, cases, folder):
    few = {c: cases[c] for c in ("0", "1")}
    vox, vol = voxel_frame(spark, few), volume_frame(spark, few)
    out = pipelines.prepare_mri(vox, vol, (1.0, 0.5, 0.75), expected=34, path=f"{folder}/mri", **SMALL)
    assert spark.read.option("header", True).csv(f"{folder}/mri/modality=A").count() == out.count() == 2 * 34
    with pytest.raises(ValueError, match="34 features of modality A, not 35"):
        pipelines.prepare_mri(vox, vol, (1.0, 0.5, 0.75), expected=35, **SMALL)


def test_ct_clinical_fields_fall_back(spark, cases):
    few = {c: cases[c] for c in ("0", "1", "2")}
    vox, vol = voxel_frame(spark, few), volume_frame(spark, few)
    clinical = spark.createDataFrame([(c, "F", "50", "0") for c in few], "case_id string, gender string, age string, label string")
    record = '{"Models":{"LabelDetailModel":{"table":{"t":{"性别":"M","年龄":"61"}}}}}'
    records = spark.createDataFrame([("1", record)], "case_id string, record string")
    dims = spark.createDataFrame([("0", "A", 4, 4, 4), ("1", "A", 4, 4, 4), ("2", "A", 1, 4, 4)], "case_id string, modality string, n_z int, n_y int, n_x int")
    got, _ = pipelines.prepare_ct(vox, vol, clinical, (1.0, 0.5, 0.75), mask_dims=dims, records=records, **SMALL)
    told = {(r["case_id"], r["gender"], r["age"], r["label"]) for r in got.select("case_id", "gender", "age", "label").distinct().collect()}
    assert told == {("0", "F", "50", "0"), ("1", "M", "61", "0")}


def test_cohort_preparation(spark, cases):
    few = {c: cases[c] for c in ("0", "1")}
    vox, vol = voxel_frame(spark, few), volume_frame(spark, few)
    clinical = spark.createDataFrame([(c, "F") for c in few], "case_id string, gender string")
    features, misses = pipelines.prepare_ct(vox, vol, clinical, (1.0, 0.5, 0.75), expected=34, **SMALL)
    assert misses.count() == 0 and features.count() == 2 * 2 * 34
    assert pipelines.prepare_mri(vox, vol, (1.0, 0.5, 0.75), **SMALL).count() == 2 * 34
