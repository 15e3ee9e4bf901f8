"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from conftest import DATA

import __spark_entry__ as contract

QUICK = [
    "missing_pairs", "clinical_lookup", "geometry_check", "change_window", "clip_percentile", "auto_binwidth",
    "discretize", "regrid_origin", "filter_gradient", "first_order_features", "shape3d", "glcm_features",
    "glrlm_features", "glszm_matrix", "ngtdm_features", "gldm_features", "preprocess", "class_distribution",
    "f_scores", "chi2_scores", "mrmr_select", "run_selection", "knn_predict", "gaussian_nb", "auc", "metrics_report",
    "decision_curve", "run_summary",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def test_every_text_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_training_data_part(tmp_path, pipeline):
    repo, copy = Path(contract.__file__).parent, tmp_path / "copy"
    shutil.copytree(repo / "cohortlens", copy / "cohortlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (pipeline and (repo / "corpus_pipeline.py").exists()):
        shutil.copy(repo / name, copy)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'pipeline' not in q; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 100


def test_entry(spark):
    assert contract.entry(spark).count() == 10


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    got = contract.queries()[name](spark, DATA).toPandas()
    want = duck.execute(contract.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    exact = [c for c in columns if got[c].dtype != float]
    order = exact + [c for c in columns if c not in exact]
    got, want = (df[columns].sort_values(order).reset_index(drop=True) for df in (got, want))
    for c in columns:
        if c in exact:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c
        else:
            assert got[c].tolist() == pytest.approx(want[c].astype(float).tolist(), abs=2e-6, nan_ok=True), c


def test_glcm_features_are_all_24(spark, folder):
    """MCC belongs to the family, in the query and in its text; a region of one level and one without pairs are defined."""
    rng = np.random.default_rng(4)
    rows = [(0, rng.normal(0, 0.2, 64)), (1, np.full(64, 0.31)), (2, np.tile([0.1, 0.4], 32)), (3, np.append(0.5, np.full(63, -1.0)))]
    rows = [(i, [float(v) for v in values], 0) for i, values in rows]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    got = contract.queries()["glcm_features"](spark, folder).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    want = con.execute(contract.oracle_sql()["glcm_features"]).fetchall()
    got, want = ({tuple(r[:3]): r[3] for r in rows} for rows in (got, want))
    assert len({f for _, _, f in got}) == 24 and len(got) == 24 * 6
    assert got == pytest.approx(want, abs=2e-6)
    assert got["1", "A", "MCC"] == 1 and got["2", "A", "MCC"] == 1 and 0 < got["0", "A", "MCC"] < 1
