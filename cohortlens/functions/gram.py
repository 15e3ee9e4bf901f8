"""Cross-product matrices: the sufficient statistics of correlations, least squares and covariances."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


ROWS_OUT = 256  # matrix rows per emitted batch


@dataclass
class Columns:
    """Per column of (values, label): mean, and spread (0 where all values are equal)."""

    mean: np.ndarray
    spread: np.ndarray


def column_stats(rows: DataFrame, values: str = "values") -> Columns:
    """Means and spreads in one pass; p + 1 numbers each reach the driver."""
    label = F.col("label").cast("double") if "label" in rows.columns else F.lit(0.0)
    v = array_to_vector(F.concat(F.col(values).cast("array<double>"), F.array(label)))
    s = rows.select(v.alias("v")).select(Summarizer.metrics("mean", "std", "min", "max").summary(F.col("v")).alias("s"))
    s = s.select("s.*").first()
    if s["mean"] is None:
        return Columns(np.zeros(0), np.zeros(0))
    mean, std, lo, hi = (s[k].toArray() for k in ("mean", "std", "min", "max"))
    return Columns(mean, np.where(lo == hi, 0.0, std))


def gram(rows: DataFrame, group: str | None = None, values: str = "values", columns: Columns | None = None) -> DataFrame:
    """(grp, i, row): row i of sum v v' with v = (1, values, label), per group.

    With ``columns``, values and label are centred and scaled to unit spread first, so that columns of any size keep their
    digits. Every task adds up its own matrix with numpy and emits it once; rows are then summed as vectors on the JVM with
    partial combination. Nothing but (columns)^2 numbers per group leaves a task.
    """
    shift = columns.mean if columns is not None else 0.0
    scale = np.where(columns.spread > 0, columns.spread, 1.0) if columns is not None else 1.0

    def lines(g: str, m: np.ndarray):
        for at in range(0, len(m), ROWS_OUT):
            part = m[at : at + ROWS_OUT]
            yield pd.DataFrame({"grp": g, "i": np.arange(at, at + len(part)), "row": list(part)})

    def partial(batches):
        current, held = None, None
        for batch in batches:
            for g, part in batch.groupby("grp"):
                if g != current and held is not None:
                    yield from lines(current, held)
                    held = None
                x = np.stack(part["v"].to_numpy())
                x = (np.column_stack([x, part["label"].to_numpy(dtype=float)]) - shift) / scale
                x = np.column_stack([np.ones(len(x)), x])
                if held is None:
                    held = x.T @ x
                else:
                    held += x.T @ x
                current = g
        if held is not None:
            yield from lines(current, held)

    key = F.col(group).cast("string") if group else F.lit("all")
    label = F.col("label") if "label" in rows.columns else F.lit(0)
    parts = rows.select(key.alias("grp"), label.alias("label"), F.col(values).alias("v"))
    if group:
        parts = parts.sortWithinPartitions("grp")
    parts = parts.mapInPandas(partial, "grp string, i int, row array<double>")
    summed = parts.groupBy("grp", "i").agg(Summarizer.sum(array_to_vector("row")).alias("row"))
    return summed.select("grp", "i", vector_to_array("row").alias("row"))


def stacked(rows: DataFrame) -> np.ndarray:
    """The matrix of one group on the driver, by Arrow: (columns + 2)^2 numbers, however many rows were summed."""
    found = rows.select("i", "row").toArrow()
    order = np.argsort(found.column("i").to_numpy())
    flat = found.column("row").combine_chunks().flatten().to_numpy()
    return flat.reshape(len(order), -1)[order]


def local_gram(
    rows: DataFrame, group: str | None = None, values: str = "values", columns: Columns | None = None
) -> dict[str, np.ndarray]:
    """The matrices of all groups on the driver."""
    held = gram(rows, group, values, columns).persist()
    out = {r["grp"]: stacked(held.filter(F.col("grp") == r["grp"])) for r in held.select("grp").distinct().collect()}
    held.unpersist()
    return out


def covariance(m: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and centred sums of products of (values, label) from one matrix."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    return int(round(n)), mean, m[1:, 1:] - n * np.outer(mean, mean)
