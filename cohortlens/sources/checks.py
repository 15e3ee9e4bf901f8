"""Completeness, clinical and geometry checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Path of the record table and its field names.
RECORD_PATH = "$.Models.LabelDetailModel.table"
RECORD_FIELDS = {"gender": "性别", "age": "年龄", "label": "转移"}


def missing_pairs(cohort: DataFrame, modalities: Sequence[str], inventory: DataFrame) -> DataFrame:
    """(case_id, modality, kind) of every image or mask that a cohort case lacks."""
    wanted = cohort.select("case_id", F.explode(F.array(*map(F.lit, modalities))).alias("modality"))
    wanted = wanted.withColumn("kind", F.explode(F.array(F.lit("image"), F.lit("mask"))))
    return wanted.join(inventory, ["case_id", "modality", "kind"], "left_anti")


def first_record(record: str = "record", path: str = RECORD_PATH, fields: dict[str, str] | None = None) -> list:
    """Columns of the first entry of the record table inside a JSON document."""
    fields = RECORD_FIELDS if fields is None else fields
    inner = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))
    entry = F.get(F.map_values(F.from_json(F.get_json_object(record, path), inner)), F.lit(0))
    return [F.try_element_at(entry, F.lit(field)).alias(name) for name, field in fields.items()]


def clinical_lookup(
    cases: DataFrame,
    json_records: DataFrame,
    fallback: DataFrame,
    path: str = RECORD_PATH,
    fields: dict[str, str] | None = None,
) -> DataFrame:
    """Per case the JSON record's fields, or the fallback row's if there is no record.

    ``json_records`` is (case_id, record); ``fallback`` has the same field columns. A missing field of an existing
    record falls back too.
    """
    names = list(RECORD_FIELDS if fields is None else fields)
    parsed = json_records.select("case_id", *first_record("record", path, fields))
    plain = fallback.select("case_id", *[F.col(n).cast("string").alias(f"_f_{n}") for n in names])
    joined = cases.join(parsed, "case_id", "left").join(plain, "case_id", "left")
    return joined.select(*cases.columns, *[F.coalesce(n, f"_f_{n}").alias(n) for n in names])


def image_dims(vox: DataFrame) -> DataFrame:
    """Size of every image as (n_z, n_y, n_x)."""
    return vox.groupBy("case_id", "modality").agg(*[(F.max(a) + 1).alias(f"n_{a}") for a in ("z", "y", "x")])


def geometry_check(image: DataFrame, mask: DataFrame) -> DataFrame:
    """Image and mask sizes side by side with ``ok``; a missing partner is not ok."""
    axes = ("z", "y", "x")
    sizes = mask.select("case_id", "modality", *[F.col(f"n_{a}").alias(f"mask_{a}") for a in axes])
    joined = image.join(sizes, ["case_id", "modality"], "full")
    same = F.lit(True)
    for a in axes:
        same = same & F.coalesce(F.col(f"n_{a}") == F.col(f"mask_{a}"), F.lit(False))
    return joined.withColumn("ok", same)


def matching_geometry(image: DataFrame, mask: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases whose images all fit their masks, the odd images of the others)."""
    sizes = geometry_check(image, mask)
    whole = sizes.groupBy("case_id").agg(F.every("ok").alias("_ok")).filter("_ok").select("case_id")
    return whole, sizes.filter("not ok")


def feature_count_check(features: DataFrame, expected: int, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Cases whose number of distinct features differs from ``expected``."""
    counts = features.groupBy(*keys).agg(F.count_distinct("feature").alias("n_features"))
    return counts.filter(F.col("n_features") != expected)
