"""Voxel preparation on long voxel tables (case_id, modality[, filter], z, y, x, value, mask)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import hash_order, image_keys
from ..functions.ordered import group_quantiles


def binarize_mask(vox: DataFrame, threshold: float = 0) -> DataFrame:
    """Mask becomes 1 above ``threshold``, else 0."""
    return vox.withColumn("mask", F.when(F.col("mask") > threshold, 1).otherwise(0))


def change_window(vox: DataFrame, center: float = 40, width: float = 400) -> DataFrame:
    """Map the intensity window to [0, 255] and clamp."""
    lo = (2 * center - width) / 2 + 0.5
    hi = (2 * center + width) / 2 + 0.5
    scaled = (F.col("value") - F.lit(lo)) * F.lit(255.0 / (hi - lo))
    return vox.withColumn("value", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0)))


def clip_percentile(vox: DataFrame, lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """Clip every image to its own quantiles, taken over the whole volume."""
    keys = image_keys(vox)
    bounds = group_quantiles(vox, keys, {"_p_lo": lo, "_p_hi": hi})
    clipped = F.least(F.greatest(F.col("value"), F.col("_p_lo")), F.col("_p_hi"))
    return vox.join(bounds, keys).withColumn("value", clipped).drop("_p_lo", "_p_hi")


def crop_to_roi(vox: DataFrame, label_tag: int = 1) -> DataFrame:
    """Keep the bounding box of the region of interest; images without one disappear."""
    keys = image_keys(vox)
    ends = [f(a).alias(f"_{n}_{a}") for a in ("z", "y", "x") for n, f in (("lo", F.min), ("hi", F.max))]
    box = vox.filter(F.col("mask") == label_tag).groupBy(*keys).agg(*ends)
    inside = F.lit(True)
    for a in ("z", "y", "x"):
        inside = inside & F.col(a).between(F.col(f"_lo_{a}"), F.col(f"_hi_{a}"))
    return vox.join(box, keys).filter(inside).select(*vox.columns)


def normalize_image(vox: DataFrame, scale: float = 1.0) -> DataFrame:
    """(v - mean) / population std of all voxels of the image; a flat image is only centred."""
    keys = image_keys(vox)
    stats = vox.groupBy(*keys).agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std"))
    centred = F.col("value") - F.col("_mean")
    out = F.when(F.col("_std") > 0, centred / F.col("_std")).otherwise(centred) * F.lit(float(scale))
    return vox.join(stats, keys).withColumn("value", out).select(*vox.columns)


def auto_binwidth(vox: DataFrame, n_cases: int = 10, seed: int = 42, label_tag: int = 1, bins: int = 10) -> DataFrame:
    """Bin width per modality from up to ``n_cases`` sampled cases: (max of maxima - mean of minima) / bins.

    The sample is the ``n_cases`` smallest hashes; the rank filter is applied inside every task before the shuffle.
    """
    first = Window.partitionBy("modality").orderBy(hash_order("case_id", seed), "case_id")
    picked = (
        vox.filter(F.col("mask") == label_tag)
        .select("modality", "case_id")
        .distinct()
        .withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") <= n_cases)
        .drop("_rank")
    )
    ranges = (
        vox.filter(F.col("mask") == label_tag)
        .join(picked, ["modality", "case_id"], "left_semi")
        .groupBy("modality", "case_id")
        .agg(F.max("value").alias("_hi"), F.min("value").alias("_lo"))
    )
    width = (F.max("_hi") - F.avg("_lo")) / F.lit(float(bins))
    return ranges.groupBy("modality").agg(width.alias("binwidth"))


def discretize(vox: DataFrame, binwidth: float, label_tag: int = 1) -> DataFrame:
    """Add ``level``: fixed-width grey level inside the region, null outside."""
    keys = image_keys(vox)
    inside = F.col("mask") == label_tag
    low = vox.filter(inside).groupBy(*keys).agg(F.min("value").alias("_low"))
    width = F.lit(float(binwidth))
    level = (F.floor(F.col("value") / width) - F.floor(F.col("_low") / width) + 1).cast("int")
    return vox.join(low, keys).withColumn("level", F.when(inside, level)).drop("_low")


def median_spacing(volumes: DataFrame) -> DataFrame:
    """Median spacing per axis over all volumes."""
    axes = volumes.select(
        F.explode(
            F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"spacing_{a}").alias("value")) for a in ("z", "y", "x")])
        ).alias("s")
    ).select("s.axis", "s.value")
    return group_quantiles(axes, ["axis"], {"spacing": 0.5})


def _feeds(source: Callable[[Column], Column], i: Column, n_in: Column) -> Callable[[Column], Column]:
    return lambda o: F.least(source(o), n_in - 1) == i


def regrid_nearest(
    vox: DataFrame,
    volumes: DataFrame,
    spacing: Sequence[float],
    align: str = "origin",
    fill: float = 0.0,
) -> DataFrame:
    """Nearest-neighbour resampling to ``spacing`` (z, y, x).

    ``origin`` samples at floor(o*s_out/s_in + 0.5), ``center`` at floor((o+0.5)*n_in/n_out). The mapping is turned
    round: each source voxel lists the output positions it feeds, so the voxels are never joined to an output grid.
    Output positions past the source are emitted by the last voxel of the line with the fill value.
    """
    if align not in ("origin", "center"):
        raise ValueError("align must be 'origin' or 'center'")
    keys = image_keys(vox)
    vol_keys = [c for c in keys if c in volumes.columns]
    sizes = vox.groupBy(*keys).agg(*[(F.max(a) + 1).alias(f"_n_{a}") for a in ("z", "y", "x")])
    out = vox.select(*keys, "z", "y", "x", "value", "mask").join(sizes.join(volumes, vol_keys), keys)
    outside = F.lit(False)
    for axis, target in zip(("z", "y", "x"), spacing):
        n_in, i = F.col(f"_n_{axis}"), F.col(axis)
        s_in, s_out = F.col(f"spacing_{axis}"), F.lit(float(target))
        n_out = F.floor(n_in * s_in / s_out + 0.5)
        if align == "origin":
            ratio, shift = s_in / s_out, 0.5
            source = lambda o, s=s_in, t=s_out: F.floor(o * t / s + 0.5)
        else:
            ratio, shift = n_out / n_in, 0.0
            source = lambda o, n=n_in, m=n_out: F.floor((o + 0.5) * n / m)
        start = F.greatest(F.floor((i - shift) * ratio) - 2, F.lit(0))
        stop = F.when(i == n_in - 1, n_out - 1).otherwise(F.least(F.ceil((i + 1 - shift) * ratio) + 2, n_out - 1))
        near = F.when(stop >= start, F.sequence(start, stop)).otherwise(F.array().cast("array<bigint>"))
        fed = F.filter(near, _feeds(source, i, n_in))
        out = out.withColumn(f"_to_{axis}", F.explode(fed))
        outside = outside | (source(F.col(f"_to_{axis}")) > n_in - 1)
    return out.select(
        *keys,
        *[F.col(f"_to_{a}").cast("int").alias(a) for a in ("z", "y", "x")],
        F.when(outside, F.lit(float(fill))).otherwise(F.col("value")).alias("value"),
        F.when(outside, F.lit(0)).otherwise(F.when(F.col("mask") >= 0.5, 1).otherwise(0)).alias("mask"),
    )
