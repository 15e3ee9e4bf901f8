"""Feature-frame preparation on the long form (case_id, label, feature, ord, value).

Per-feature statistics are grouped aggregates joined back, never windows over all cases of a feature: the aggregate is
combined before the shuffle, and the join broadcasts or splits skewed partitions at run time by measured size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import hash_chunk, hash_order
from ..functions.ordered import running_totals


def exclude_low_variance(feat: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Keep features whose sample variance exceeds the threshold."""
    kept = feat.groupBy("feature").agg(F.var_samp("value").alias("_v")).filter(F.col("_v") > threshold)
    return feat.join(kept.select("feature"), "feature", "left_semi").select(*feat.columns)


def fit_scaler(feat: DataFrame) -> DataFrame:
    """Per-feature statistics (feature, mean, std, lo, hi)."""
    return feat.groupBy("feature").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
    )


def apply_scaler(feat: DataFrame, stats: DataFrame, method: int = 0) -> DataFrame:
    """Scale with given statistics: 0 standardises, anything else maps to [0, 1]. Flat features become 0."""
    v = F.col("value")
    if method == 0:
        scaled = F.when(F.col("std") > 0, (v - F.col("mean")) / F.col("std")).otherwise(0.0)
    else:
        scaled = F.when(F.col("hi") > F.col("lo"), (v - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return feat.join(stats, "feature").withColumn("value", scaled).select(*feat.columns)


def standardize(feat: DataFrame) -> DataFrame:
    """(v - mean) / sample std per feature."""
    return apply_scaler(feat, fit_scaler(feat), 0)


def min_max(feat: DataFrame) -> DataFrame:
    """Map every feature to [0, 1]."""
    return apply_scaler(feat, fit_scaler(feat), 1)


def preprocess(
    feat: DataFrame, drop_columns: Sequence[str] = (), variance_threshold: float = 0.01, method: int = 0
) -> DataFrame:
    """Variance filter, then scaling. One statistics pass serves both."""
    kept = feat.filter(~F.col("feature").isin(list(drop_columns))) if drop_columns else feat
    stats = fit_scaler(kept).filter(F.col("std") * F.col("std") > variance_threshold)
    return apply_scaler(kept, stats, method)


def _class_ranks(df: DataFrame, seed: int, *salt: str) -> DataFrame:
    """Add ``_rank``, 1-based per class in hash order."""
    hashed = df.withColumn("_hash", hash_order("case_id", seed, *salt))
    chunked = hashed.withColumn("_chunk", hash_chunk(F.col("_hash")))
    ranked = running_totals(chunked, ["label"], ["_hash", "case_id"], {"_rank": F.lit(1)})
    return ranked.drop("_hash", "_chunk")


def stratified_split(df: DataFrame, test_size: float, seed: int = 42) -> DataFrame:
    """Add ``split``: ceil(test_size * n) test rows, shared among the classes by largest remainder."""
    sizes = df.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy()
    by_rest = Window.partitionBy().orderBy(F.col("_rest").desc(), F.col("label"))
    plan = (
        sizes.withColumn("_all", F.sum("_n").over(every))
        .withColumn("_test", F.ceil(F.lit(float(test_size)) * F.col("_all")))
        .withColumn("_share", F.col("_test") * F.col("_n") / F.col("_all"))
        .withColumn("_base", F.floor("_share"))
        .withColumn("_rest", F.col("_share") - F.col("_base"))
        .withColumn("_open", F.col("_test") - F.sum("_base").over(every))
        .withColumn("_quota", F.col("_base") + (F.row_number().over(by_rest) <= F.col("_open")).cast("long"))
        .select("label", "_quota")
    )
    split = F.when(F.col("_rank") <= F.col("_quota"), "test").otherwise("train")
    return _class_ranks(df, seed).join(plan, "label").withColumn("split", split).select(*df.columns, "split")


def split_by_list(df: DataFrame, split_table: DataFrame) -> DataFrame:
    """Add ``split`` from a saved (case_id, split) table; cases outside the list are dropped."""
    return df.join(split_table.select("case_id", "split"), "case_id").select(*df.columns, "split")


def class_distribution(df: DataFrame) -> DataFrame:
    """Total, positive and negative rows for the data and every split."""
    out = df.rollup("split").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.col("label").cast("long")).alias("positive"),
        F.sum((1 - F.col("label")).cast("long")).alias("negative"),
    )
    return out.withColumn("split", F.coalesce("split", F.lit("data")))


def shuffle_rows(df: DataFrame, seed: int = 42) -> DataFrame:
    """Rows in a reproducible random order."""
    return df.orderBy(hash_order("case_id", seed), "case_id")


def class_weights(df: DataFrame) -> DataFrame:
    """Balanced weight per class: n / (classes * class rows)."""
    sizes = df.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy()
    weight = F.sum("_n").over(every) / (F.count(F.lit(1)).over(every) * F.col("_n"))
    return sizes.select("label", weight.alias("weight"))


def with_class_weights(df: DataFrame) -> DataFrame:
    """Add the balanced ``weight`` column to every row."""
    return df.join(class_weights(df), "label")


def stratified_folds(df: DataFrame, n_splits: int = 10, n_repeats: int = 1, seed: int = 42) -> DataFrame:
    """Repeated stratified fold numbers: (case_id, label, rep, fold)."""
    repeats = F.explode(F.array(*[F.lit(r) for r in range(n_repeats)]))
    rows = df.select("case_id", "label").withColumn("rep", repeats)
    hashed = rows.withColumn("_hash", hash_order("case_id", seed, F.col("rep").cast("string")))
    chunked = hashed.withColumn("_chunk", hash_chunk(F.col("_hash")))
    ranked = running_totals(chunked, ["rep", "label"], ["_hash", "case_id"], {"_rank": F.lit(1)})
    fold = F.pmod(F.col("_rank") - 1, F.lit(n_splits)).cast("int")
    return ranked.select("case_id", "label", "rep", fold.alias("fold"))


def combine_modalities(feat: DataFrame) -> DataFrame:
    """One name per (feature, filter, modality), so that the modalities of a case stand side by side."""
    parts = [c for c in ("feature", "filter", "modality") if c in feat.columns]
    return feat.select("case_id", F.concat_ws("_", *parts).alias("feature"), "value")


def to_wide(feat: DataFrame, features: Sequence[str], keys: Sequence[str] = ("case_id", "label")) -> DataFrame:
    """One column per listed feature, in the listed order."""
    keys = [k for k in keys if k in feat.columns]
    return feat.groupBy(*keys).pivot("feature", list(features)).agg(F.first("value"))


def to_arrays(feat: DataFrame) -> DataFrame:
    """One row per case with ``values`` ordered by ``ord``; missing or NaN values raise, they are never imputed."""
    checked = F.when(F.isnan("value") | F.col("value").isNull(), F.raise_error(F.lit("null or NaN feature value")))
    keys = [k for k in ("case_id", "label", "split", "fold") if k in feat.columns]
    packed = F.sort_array(F.collect_list(F.struct("ord", checked.otherwise(F.col("value")).alias("value"))))
    return feat.groupBy(*keys).agg(packed.alias("_p")).select(*keys, F.col("_p.value").alias("values"))


def to_vectors(feat: DataFrame, features: str = "features") -> DataFrame:
    """ML form: one vector per case."""
    arrays = to_arrays(feat)
    rest = [c for c in arrays.columns if c != "values"]
    return arrays.select(*rest, array_to_vector("values").alias(features))
