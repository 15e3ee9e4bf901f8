"""Voxel operators against brute force on small volumes."""

from __future__ import annotations

import math

import numpy as np
import pytest
from helpers import brute_glcm, brute_runs, brute_zones, level_frame, volume, volume_frame, voxel_frame
from pyspark.sql import functions as F

from cohortlens.functions.durable import durable, passing, stored
from cohortlens.functions.ordered import group_quantiles, octave_code, running_totals, value_counts
from cohortlens.functions.stencil import gather_neighbours, pack_lines
from cohortlens.operators import extract, filters, prepare, shape, texture
from cohortlens.operators.first_order import first_order
from cohortlens.session import tune

KEYS = ["case_id", "modality"]


@pytest.fixture(scope="module")
def cases():
    flat = (np.ones((3, 3, 3), dtype=int), np.ones((3, 3, 3), dtype=bool))
    return {"a": volume(1), "b": volume(2, (7, 3, 3), 2, 0.5), "flat": flat}


@pytest.fixture(scope="module")
def levels(spark, cases):
    return level_frame(spark, cases).persist()


def counts(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r["case_id"], {})[tuple(r[c] for c in columns)] = r["n"]
    return out


@pytest.mark.parametrize("depth", [2, 16])
def test_neighbours_do_not_depend_on_the_slab_depth(spark, cases, levels, depth):
    grid, mask = cases["a"]
    near = gather_neighbours(levels.filter("case_id = 'a'"), "level", KEYS, depth=depth)
    for r in near.collect():
        for i, got in enumerate(r["nb"]):
            at = (r["z"] + i // 9 - 1, r["y"] + i // 3 % 3 - 1, r["x"] + i % 3 - 1)
            ok = all(0 <= p < n for p, n in zip(at, grid.shape)) and mask[at]
            assert got == (int(grid[at]) if ok else None)
    assert near.count() == mask.sum()


def test_lines_with_gaps_are_filled(spark):
    df = spark.createDataFrame(
        [("c", "A", 0, 0, 1, 5), ("c", "A", 0, 0, 3, 7)], "case_id string, modality string, z int, y int, x int, level int"
    )
    row = pack_lines(df, ["level"], KEYS).first()
    assert (row["lo"], row["level"]) == (1, [5, None, 7])


def test_cooccurrence_and_runs(cases, levels):
    near = texture.level_neighbours(levels)
    assert counts(texture.glcm_matrix(near), "dir", "i", "j") == {c: brute_glcm(*v) for c, v in cases.items()}
    runs = texture.glrlm_matrix(near)
    assert counts(runs, "dir", "level", "len") == {c: brute_runs(*v) for c, v in cases.items()}


@pytest.mark.parametrize("block", [(1, 64, 256), (2, 64, 256), (16, 64, 256), (16, 2, 256), (3, 2, 2), (1, 1, 1)])
def test_zones_merge_across_cuts(cases, levels, block):
    depth, rows, columns = block
    got = counts(texture.glszm_matrix(levels, depth, rows=rows, columns=columns), "level", "size")
    assert got == {c: brute_zones(*v) for c, v in cases.items()}


def test_zones_touch_at_corners_of_blocks_only_where_voxels_do(spark):
    """Two blocks of 2 x 2 x 2: corners that touch are one zone, voxels two apart are two, whatever else the table holds."""
    rows = [("c", "A", 1, 1, 1, 5, 0), ("c", "A", 2, 2, 2, 5, 0), ("d", "A", 1, 2, 2, 5, 0), ("d", "A", 2, 1, 1, 5, 0)]
    rows += [("e", "A", 0, 0, 0, 5, 0), ("e", "A", 2, 2, 2, 5, 0), ("f", "A", 1, 1, 1, 5, 0), ("f", "A", 2, 2, 2, 6, 0)]
    schema = "case_id string, modality string, z int, y int, x int, level int, size int"
    got = texture.glszm_matrix(spark.createDataFrame(rows, schema), 2, rows=2, columns=2)
    got = {(r["case_id"], r["level"], r["size"]): r["n"] for r in got.collect()}
    assert got == {("c", 5, 2): 1, ("d", 5, 2): 1, ("e", 5, 1): 2, ("f", 5, 1): 1, ("f", 6, 1): 1}
    assert texture.glszm_matrix(spark.createDataFrame([], schema)).isEmpty()
    with pytest.raises(Exception, match="outside 0"):
        texture.glszm_matrix(spark.createDataFrame([("c", "A", -1, 0, 0, 5, 0)], schema)).collect()


def test_flat_region_gives_defined_features(levels):
    near = texture.level_neighbours(levels.filter("case_id = 'flat'"))
    glcm = {r["feature"]: r["value"] for r in texture.glcm_features(texture.glcm_matrix(near), mcc=True).collect()}
    assert glcm["Correlation"] == 1 and glcm["JointEntropy"] == 0 and glcm["Imc1"] == 0 and glcm["MCC"] == 1
    tone = {r["feature"]: r["value"] for r in texture.ngtdm_features(texture.ngtdm_matrix(near)).collect()}
    assert tone == {"Coarseness": 1e6, "Contrast": 0, "Busyness": 0, "Complexity": 0, "Strength": 0}


def test_mcc_against_the_definition(cases, levels):
    near = texture.level_neighbours(levels.filter("case_id = 'a'"))
    got = {r["dir"]: r["value"] for r in texture.glcm_mcc(texture.glcm_matrix(near)).collect()}
    pairs = brute_glcm(*cases["a"])
    for d, value in got.items():
        p = np.zeros((3, 3))
        for (dd, i, j), n in pairs.items():
            if dd == d:
                p[i - 1, j - 1] = n
        p /= p.sum()
        px, py = p.sum(1), p.sum(0)
        q = np.array([[sum(p[i, k] * p[j, k] / px[i] / py[k] for k in range(3)) for j in range(3)] for i in range(3)])
        second = np.sort(np.linalg.eigvals(q).real)[-2]
        assert value == pytest.approx(math.sqrt(max(second, 0)), abs=1e-6)


def test_texture_ignores_translation(spark, levels):
    moved = levels.filter("case_id = 'a'").withColumn("z", F.col("z") + 15).withColumn("x", F.col("x") + 3)
    still = levels.filter("case_id = 'a'")
    for build in (texture.glcm_matrix, texture.glrlm_matrix, texture.gldm_matrix):
        a, b = (build(texture.level_neighbours(df)) for df in (still, moved))
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert texture.glszm_matrix(still).exceptAll(texture.glszm_matrix(moved)).isEmpty()


def test_quantiles_equal_numpy_on_skewed_values(spark):
    rng = np.random.default_rng(3)
    groups = {"heavy": np.exp(rng.normal(0, 4, 500)), "ties": rng.integers(0, 4, 300).astype(float), "one": np.array([2.5])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, value double")
    probs = {"p0": 0.0, "p1": 0.1, "p5": 0.5, "p9": 0.995, "p10": 1.0}
    counted = group_quantiles(value_counts(df, ["g"]), ["g"], probs, weight="n", chunks=16)
    for r in counted.collect() + group_quantiles(df, ["g"], probs, chunks=2).collect():
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(groups[r["g"]], p), rel=1e-12)


def test_quantiles_of_signs_spikes_outliers_and_nulls(spark):
    rng = np.random.default_rng(4)
    groups = {
        "outlier": np.append(rng.normal(size=400), [1e300, -1e300]),
        "spike": 1000 + rng.random(300) * 1e-9,
        "signs": np.array([-2.0, -1.0, -0.0, 0.0, 5e-324, -5e-324, 1.0, 2.0]),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("spike", None), ("empty", None)]
    got = group_quantiles(spark.createDataFrame(rows, "g string, value double"), ["g"], {"a": 0.03, "b": 0.5, "c": 0.9}).collect()
    assert {r["g"] for r in got} == set(groups)
    for r in got:
        assert [r["a"], r["b"], r["c"]] == pytest.approx(list(np.quantile(groups[r["g"]], [0.03, 0.5, 0.9])), rel=1e-12)


def test_octave_codes_follow_the_values(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), [0.0, np.inf, -np.inf, 1.0, np.nextafter(1, 0)]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").withColumn("code", octave_code(F.col("v")))
    codes = [r["code"] for r in df.orderBy("v").collect()]
    assert codes == sorted(codes) and len(set(codes)) > 450


def test_running_totals_cross_chunks(spark):
    df = spark.range(100).selectExpr("id % 2 g", "id", "cast(id / 10 as int) _chunk")
    down = running_totals(df, ["g"], ["id"], {"s": F.col("id")}, descending=True)
    for r in down.collect():
        assert r["s"] == sum(i for i in range(r["id"], 100) if i % 2 == r["g"])


def test_first_order_uses_mask_above_zero_for_the_extra_percentiles(spark):
    grid = np.arange(8, dtype=float).reshape(2, 2, 2)
    mask = np.array([1, 1, 1, 1, 2, 2, 0, 0]).reshape(2, 2, 2)
    got = {r["feature"]: r["value"] for r in first_order(voxel_frame(spark, {"c": (grid, mask)}), 1.0).collect()}
    assert got["Mean"] == 1.5 and got["Energy"] == 14 and got["Entropy"] == 2
    assert got["25Percentile"] == pytest.approx(1.25) and got["InterquartileRange"] == pytest.approx(1.5)
    assert len(got) == 20


def test_regrid_against_the_rule(spark):
    grid = np.arange(24, dtype=float).reshape(2, 3, 4)
    case = {"c": (grid, np.ones_like(grid, dtype=int))}
    spacing, target = (2.0, 0.5, 0.75), (0.9, 0.7, 0.4)
    for align in ("origin", "center"):
        out = prepare.regrid_nearest(voxel_frame(spark, case), volume_frame(spark, case, spacing), target, align, -9.0)
        got = {(r["z"], r["y"], r["x"]): r["value"] for r in out.collect()}
        n_out = [math.floor(n * s / t + 0.5) for n, s, t in zip(grid.shape, spacing, target)]
        want = {}
        for at in np.ndindex(*n_out):
            if align == "origin":
                src = tuple(math.floor(o * t / s + 0.5) for o, t, s in zip(at, target, spacing))
            else:
                src = tuple(math.floor((o + 0.5) * n / m) for o, n, m in zip(at, grid.shape, n_out))
            inside = all(i < n for i, n in zip(src, grid.shape))
            want[at] = grid[src] if inside else -9.0
        assert got == want


def test_point_filters_and_unknown_names(spark):
    grid = np.array([[[-4.0, 1.0, 2.0]]])
    vox = voxel_frame(spark, {"c": (grid, np.ones_like(grid, dtype=int))})
    values = {n: [r["value"] for r in filters.apply_filter(vox, n).orderBy("x").collect()] for n in ("square", "square_root")}
    assert values["square"] == pytest.approx([4, 0.25, 1])
    assert values["square_root"] == pytest.approx([-4, 2, math.sqrt(8)])
    with pytest.raises(ValueError):
        filters.apply_filter(vox, "sharpen")


def test_wavelet_of_a_constant_sits_in_the_low_band(spark):
    grid = np.full((6, 5, 4), 2.0)
    out = filters.wavelet(voxel_frame(spark, {"c": (grid, np.ones_like(grid, dtype=int))}))
    by_band = {r["filter"]: (r["lo"], r["hi"]) for r in out.groupBy("filter").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).collect()}
    assert len(by_band) == 8
    for band, (lo, hi) in by_band.items():
        want = 2.0 * math.sqrt(2) ** 3 if band == "wavelet-LLL" else 0.0
        assert lo == pytest.approx(want, abs=1e-9) and hi == pytest.approx(want, abs=1e-9)


def test_laplacian_of_a_parabola(spark):
    x = np.arange(41, dtype=float)
    grid = np.broadcast_to((x - 20) ** 2, (3, 3, 41)).copy()
    case = {"c": (grid, np.ones_like(grid, dtype=int))}
    out = filters.laplacian_of_gaussian(voxel_frame(spark, case), volume_frame(spark, case, (1, 1, 1)), 1.0)
    middle = out.filter("x = 20 and y = 1 and z = 1").first()["value"]
    assert middle == pytest.approx(2.0, rel=0.02)


def test_shape_of_a_box(spark):
    grid = np.zeros((4, 5, 6))
    mask = np.zeros_like(grid, dtype=int)
    mask[1:3, 1:4, 1:5] = 1
    case = {"c": (grid, mask)}
    got = {r["feature"]: r["value"] for r in shape.shape3d(voxel_frame(spark, case), volume_frame(spark, case)).collect()}
    sides = np.array([2 * 2.0, 3 * 0.5, 4 * 0.75])
    assert got["VoxelVolume"] == pytest.approx(sides.prod())
    assert got["SurfaceArea"] == pytest.approx(2 * (sides[0] * sides[1] + sides[0] * sides[2] + sides[1] * sides[2]))
    gaps = np.array([1 * 2.0, 2 * 0.5, 3 * 0.75])
    assert got["Maximum3DDiameter"] == pytest.approx(np.linalg.norm(gaps))
    assert got["Maximum2DDiameterSlice"] == pytest.approx(np.linalg.norm(gaps[1:]))
    assert len(got) == 14


def test_diameters_equal_all_pairs(spark, cases):
    grid, mask = cases["a"]
    case = {"c": (grid, mask.astype(int))}
    row = shape.diameters(voxel_frame(spark, case), volume_frame(spark, case)).first()
    pts = np.argwhere(mask) * np.array([2.0, 0.5, 0.75])
    d = np.linalg.norm(pts[:, None] - pts[None], axis=2)
    idx = np.argwhere(mask)
    assert row["d_3"] == pytest.approx(d.max())
    for k, axis in enumerate(("z", "y", "x")):
        same = idx[:, None, k] == idx[None, :, k]
        assert row[f"d_{axis}"] == pytest.approx(d[same].max())


def test_empty_region_yields_no_rows(spark):
    grid = np.zeros((2, 2, 2))
    vox = voxel_frame(spark, {"c": (grid, np.zeros_like(grid, dtype=int))})
    assert prepare.crop_to_roi(vox).count() == 0
    assert first_order(vox, 1.0).count() == 0


def test_number_of_features_per_modality(spark):
    rng = np.random.default_rng(5)
    case = {"c": (rng.normal(size=(5, 5, 5)), (rng.random((5, 5, 5)) < 0.8).astype(int))}
    out = extract.extract_features(voxel_frame(spark, case), volume_frame(spark, case), binwidth=0.5)
    assert out.select("feature").distinct().count() == out.count() == 15 * 95 + 14


def test_gaps_in_a_line_keep_their_place(spark):
    """A missing voxel must not move its neighbours together: far from the gap the Laplacian is that of the whole line."""
    from cohortlens.operators.filters import laplacian_of_gaussian

    schema = "case_id string, modality string, z int, y int, x int, value double, mask int"
    rows = [("c", "A", 0, 0, x, float(x * x), 1) for x in range(40)]
    volumes = spark.createDataFrame(
        [("c", "A", 1.0, 1.0, 1.0)], "case_id string, modality string, spacing_z double, spacing_y double, spacing_x double"
    )
    whole, holed = (
        {r["x"]: r["value"] for r in laplacian_of_gaussian(spark.createDataFrame(part, schema), volumes, 1.0).collect()}
        for part in (rows, [r for r in rows if r[4] != 8])
    )
    assert set(holed) == set(whole) - {8}
    assert all(abs(holed[x] - whole[x]) < 1e-9 for x in range(13, 40)) and abs(holed[7] - whole[7]) > 1e-6


def test_zones_are_labelled_in_lots_of_blocks(monkeypatch):
    """Many blocks in one batch are labelled a few at a time, with the same zones."""
    import pandas as pd

    blocks = pd.DataFrame({"case_id": list("abcde"), "cell": [np.arange(8)] * 5, "level": [np.repeat([1, 2], 4)] * 5})
    whole = list(texture._zones_of_blocks([blocks], ["case_id"], (2, 2, 8)))
    monkeypatch.setattr(texture, "ZONE_VOXELS", 16)
    parts = list(texture._zones_of_blocks([blocks], ["case_id"], (2, 2, 8)))
    assert len(whole) == 1 and len(parts) == 3
    assert pd.concat(parts, ignore_index=True).astype(str).equals(whole[0].astype(str))


def test_feature_classes_are_planned_one_by_one(spark, cases):
    """The plan of all classes reads their stored tables: it holds none of their windows and joins."""
    case = {"a": cases["a"]}
    vox = voxel_frame(spark, {k: (grid.astype(float), mask) for k, (grid, mask) in case.items()})
    out = extract.extract_features(vox, volume_frame(spark, case), ["first_order", "gldm"], ["original"], 0.5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and out.count() > 0


def test_shuffles_begin_with_many_small_partitions(spark):
    """What a task makes of a row of packed lines is bounded by the size of a shuffle partition."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    tune(spark)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "4m"
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) == 384
    spark.conf.set("spark.sql.shuffle.partitions", before)
    tune(spark)


def test_extraction_lot_by_lot_keeps_features_alone(spark, folder, monkeypatch):
    """Lots of whole cases give the features of one lot; what is stored on the way, and the shuffle files, go with the lot."""
    from pathlib import Path

    rng = np.random.default_rng(7)
    case = {f"c{i}": (rng.normal(size=(3, 3, 3)), (rng.random((3, 3, 3)) < 0.8).astype(int)) for i in range(4)}
    vox, volumes = voxel_frame(spark, case), volume_frame(spark, case)
    root = Path(folder)
    monkeypatch.setattr("cohortlens.functions.durable.checkpoint_dir", lambda _: folder)  # no other run writes there

    def run():
        before = set(root.iterdir())
        out = extract.extract_features(vox, volumes, ["shape3d", "first_order", "glszm", "gldm"], ["original", "square"], 0.5)
        rows = sorted(tuple(r) for r in out.collect())
        return rows, sorted(p.name.rsplit("-", 1)[0] for p in set(root.iterdir()) - before)

    whole, tables = run()
    assert tables == ["features-first-order", "features-gldm", "features-glszm", "features-shape"]
    monkeypatch.setattr(extract, "LOT_VOXELS", 60)
    lots = extract.case_lots(vox, 2)
    assert len(lots) > 1 and sorted(r["case_id"] for lot in lots for r in vox.filter(lot).select("case_id").distinct().collect()) == sorted(case)
    parts, tables = run()
    assert [r[:2] for r in parts] == [r[:2] for r in whole] and [r[2] for r in parts] == pytest.approx([r[2] for r in whole])
    assert len(tables) == 4 * len(lots) and all(t.startswith("features-") for t in tables)


def test_passing_restores_the_setting_and_removes_its_tables_when_it_fails(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), passing(spark):
        gone, kept = (stored(spark.range(3), "t", keep=keep) for keep in (False, True))
        assert spark.conf.get(key) == "true" and durable(gone).count() == 3
        raise ValueError
    assert spark.conf.get(key) == before and kept.count() == 3
    with pytest.raises(Exception, match="NOT_EXIST|not exist"):
        gone.count()
