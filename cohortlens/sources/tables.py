"""Table readers and writers, stage reuse, model and support persistence."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _read(spark: SparkSession, path: str, fmt: str, strings: Sequence[str] = ()) -> DataFrame:
    """Any format with a schema of its own. Of CSV the header alone is read for the names: all but ``strings`` are doubles."""
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    names = spark.read.option("header", True).csv(path).columns
    fields = [T.StructField(n, T.StringType() if n in strings else T.DoubleType()) for n in names]
    # FAILFAST: a cell that is no number is an error, not a missing value; headers of all files must agree.
    reader = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
    return reader.schema(T.StructType(fields)).csv(path)


def read_cohort(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(case_id string, label int)."""
    return _read(spark, path, fmt, ["case_id"]).select(F.col("case_id").cast("string"), F.col("label").cast("int"))


def unpivot_features(wide: DataFrame, id_column: str = "case_ids") -> DataFrame:
    """Wide feature frame to (case_id, label, feature, ord, value)."""
    names = [c for c in wide.columns if c not in (id_column, "label")]
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("feature"), F.lit(i).alias("ord"), F.col(f"`{n}`").cast("double").alias("value"))
            for i, n in enumerate(names)
        ]
    )
    keys = [F.col(id_column).cast("string").alias("case_id")]
    if "label" in wide.columns:
        keys.append(F.col("label").cast("int").alias("label"))
    kept = [k for k in ("case_id", "label") if k == "case_id" or "label" in wide.columns]
    return wide.select(*keys, F.explode(cells).alias("_c")).select(*kept, "_c.*")


def read_features(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Long features from a ready wide table with ``case_ids`` and ``label``."""
    return unpivot_features(_read(spark, path, fmt, ["case_ids"]))


def with_ord(feat: DataFrame) -> DataFrame:
    """Add ``ord``, the position of the feature in name order, from the distinct names."""
    order = F.row_number().over(Window.partitionBy().orderBy("feature")) - 1
    return feat.join(feat.select("feature").distinct().withColumn("ord", order), "feature")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a result table, replacing an earlier one; CSV gets a header."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_per_modality(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """One folder of files per modality."""
    df.write.mode("overwrite").option("header", True).partitionBy("modality").format(fmt).save(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on its own file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _input_files(df: DataFrame) -> list[tuple[str, str, int, int]]:
    """(folder, name, bytes, time of change) of the files that a table reads; one listing per folder."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        for entry in path.getFileSystem(conf).listStatus(path):
            name = entry.getPath().getName()
            if not name.startswith(("_", ".")):
                out.append((folder, name, entry.getLen(), entry.getModificationTime()))
    return sorted(out)


def fingerprint(depends: Sequence[object]) -> str:
    """Hash of settings and of input tables (schema and files). A table without files is known by its schema alone."""
    digest = hashlib.sha256()
    for part in depends:
        if isinstance(part, DataFrame):
            part = [part.schema.json(), _input_files(part)]
        told = json.dumps(part, sort_keys=True, default=lambda x: getattr(x, "__qualname__", None) or str(x))
        digest.update(told.encode() + b"\0")
    return digest.hexdigest()


def materialize(
    spark: SparkSession, make: Callable[[], DataFrame], path: str, depends: Sequence[object] = ()
) -> DataFrame:
    """Read a finished stage, or compute and write it first.

    ``depends`` are the settings and input tables of the stage. A marker named by their hash is left beside the files once
    they are complete; without it (other settings, changed input, a broken run) the stage is written anew.
    """
    marker = f"{path}/_stage-{fingerprint(depends)}"
    if not path_exists(spark, marker):
        make().write.mode("overwrite").parquet(path)
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(marker)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target).close()
    return spark.read.parquet(path)


def fit_or_load(estimator, df: DataFrame, path: str):
    """Load a saved model, or fit and save it."""
    from pyspark.ml.util import DefaultParamsReader

    spark = df.sparkSession
    if path_exists(spark, f"{path}/metadata/_SUCCESS"):
        return DefaultParamsReader.loadParamsInstance(path, spark)
    model = estimator.fit(df)
    model.write().overwrite().save(path)
    return model


def save_support(support: DataFrame, path: str) -> None:
    """Keep a selection log."""
    support.write.mode("overwrite").parquet(path)


def load_support(spark: SparkSession, path: str) -> DataFrame:
    """Read a selection log."""
    return spark.read.parquet(path)
