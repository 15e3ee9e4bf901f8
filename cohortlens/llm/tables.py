"""Reading, writing and small column helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlens.functions.durable import checkpoint_dir

#: White space that separates words, as a Java or Python character class.
BLANK = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: later stages read it after any executor is lost."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the table that ``written`` made, once nothing reads it any more. It then no longer takes up disk."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def text_of(df: DataFrame) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text: runs of anything but white space."""
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(df: DataFrame, key: str = "doc_id", name: str = "rid") -> DataFrame:
    """``df`` with ``name``: the key itself where it is a unique integer, else a number of the row (the table is written then)."""
    if df.schema[key].dataType.typeName() in ("long", "integer", "short", "byte"):
        odd = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull())
        if odd.isEmpty():
            return df.withColumn(name, F.col(key).cast("bigint"))
    return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered-rows")
