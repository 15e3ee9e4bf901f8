"""Views of the driver tables in the engine's input schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding is a 4x4x4 cube; modality B reads it backwards, the mask belongs to A's geometry."""
    e = F.col("embedding")
    sides = F.array(
        F.struct(F.lit("A").alias("modality"), e.alias("v")),
        F.struct(F.lit("B").alias("modality"), F.reverse(e).alias("v")),
    )
    cubes = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("case_id"), e, F.explode(sides).alias("s")
    )
    cells = cubes.select(
        "case_id", "s.modality", F.posexplode(F.arrays_zip(F.col("s.v").alias("v"), e.alias("e"))).alias("i", "c")
    )
    i = F.col("i")
    return cells.select(
        "case_id",
        "modality",
        F.floor(i / 16).cast("int").alias("z"),
        (F.floor(i / 4) % 4).cast("int").alias("y"),
        (i % 4).cast("int").alias("x"),
        F.col("c.v").cast("double").alias("value"),
        F.when(F.col("c.e").cast("double") > -0.05, 1).otherwise(0).alias("mask"),
    )


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacing 2.0 between slices, 0.5 or 0.75 in the plane."""
    plane = F.lit(0.5) + F.lit(0.25) * (F.col("vec_id") % 2)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("case_id"),
        F.explode(F.array(F.lit("A"), F.lit("B"))).alias("modality"),
        F.lit(2.0).alias("spacing_z"),
        plane.alias("spacing_y"),
        plane.alias("spacing_x"),
    )


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with a binary label."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("case_id"), (F.col("label") >= 5).cast("int").alias("label")
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image and mask files on hand; every 17th case lacks the mask of modality B."""
    cases = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("modality")
    )
    files = cases.select("vec_id", "modality", F.explode(F.array(F.lit("image"), F.lit("mask"))).alias("kind"))
    lost = (F.col("vec_id") % 17 == 0) & (F.col("modality") == "B") & (F.col("kind") == "mask")
    return files.filter(~lost).select(F.col("vec_id").cast("string").alias("case_id"), "modality", "kind")


def features(spark: SparkSession, sf_dir: str, constant: bool = True) -> DataFrame:
    """Long feature table of the embeddings, plus one constant feature."""
    values = F.col("embedding").cast("array<double>")
    if constant:
        values = F.concat(values, F.array(F.lit(1.0)))
    return (
        table(spark, sf_dir, "embeddings")
        .select(
            F.col("vec_id").cast("string").alias("case_id"),
            (F.col("label") >= 5).cast("int").alias("label"),
            F.posexplode(values).alias("ord", "value"),
        )
        .select("case_id", "label", F.format_string("f%02d", "ord").alias("feature"), "ord", "value")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four score columns of every line item, long form (label, method, prob)."""
    wide = table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.array(
            F.struct(F.lit("m1").alias("method"), (F.col("l_quantity") / 50.0).alias("prob")),
            F.struct(F.lit("m2").alias("method"), (F.col("l_discount") * 10.0).alias("prob")),
            F.struct(F.lit("m3").alias("method"), (1.0 - F.col("l_tax") * 10.0).alias("prob")),
            F.struct(
                F.lit("m4").alias("method"), F.least(F.lit(1.0), F.col("l_extendedprice") / 105000.0).alias("prob")
            ),
        ).alias("s"),
    )
    return wide.select("label", F.explode("s").alias("s")).select("label", "s.method", "s.prob")


def predictions_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with many ties, long form with a split column."""
    wide = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("case_id"),
        F.col("quality").cast("int").alias("label"),
        F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train").alias("split"),
        F.array(
            F.struct(F.lit("m1").alias("method"), ((F.col("doc_id") * 37 % 101) / 100.0).alias("prob")),
            F.struct(F.lit("m2").alias("method"), (F.col("toxic") * 0.5 + 0.25).alias("prob")),
        ).alias("s"),
    )
    return wide.select("case_id", "label", "split", F.explode("s").alias("s")).select(
        "case_id", "label", "split", "s.method", "s.prob"
    )


def wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cases."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("case_id"),
        (F.col("event_type") == "purchase").cast("int").alias("label"),
        F.col("value").alias("v1"),
        (F.col("value") * F.col("value")).alias("v2"),
    )


def corner_voxels(spark: SparkSession, sf_dir: str, odd_only: bool = False) -> DataFrame:
    """``voxels`` whose region is confined to one corner of the cube: for all cases, or for those of odd number."""
    corner = (F.col("z") >= 1) & (F.col("y") <= 2) & (F.col("x") >= 2)
    if odd_only:
        corner = corner | (F.col("case_id").cast("int") % 2 == 0)
    return voxels(spark, sf_dir).withColumn("mask", F.when(corner, F.col("mask")).otherwise(0))
