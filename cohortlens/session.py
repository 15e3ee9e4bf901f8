"""Session settings the engine is built for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive plans choose broadcasts by measured size, split skewed join partitions and merge small ones. Every step of such a plan
# prints it: whole, the texts of long plans fill the driver. A row of packed lines becomes hundreds of rows of voxel pairs, so what one
# task holds is bounded by small shuffle partitions; there must be enough of them to begin with, empty ones are merged.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.maxPlanStringLength": "100000",
}

#: Partitions that a shuffle begins with are 16 times the session's number, up to this many.
MOST_PARTITIONS = 512


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(parts, min(16 * parts, MOST_PARTITIONS))))
    return spark


def local_session(cpus: int = 8, name: str = "cohortlens", memory: str = "12g") -> SparkSession:
    """Session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
