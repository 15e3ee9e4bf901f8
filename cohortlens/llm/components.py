"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.functions.durable import durable


#: Rows for one task: a round over few edges shall not write a file per shuffle partition in every exchange.
ROWS_PER_TASK = 20_000


def tasks_for(rows: int) -> int:
    """Partitions for a table of so many small rows."""
    return max(1, -(-rows // ROWS_PER_TASK))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of the component.

    Star contraction: each round links larger neighbours of a node to its smallest one, then smaller ones; the number of
    rounds grows with the logarithm of the diameter. A round is checkpointed, and ends the loop when the table no longer
    changes (count and hash sum). Hot nodes are aggregated on the map side; joins on them are split by adaptive execution.
    The number of tasks follows the number of edges.
    """
    table = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(table)
    while mark[0]:
        tasks = tasks_for(mark[0])
        table = table.coalesce(tasks)
        both = table.union(table.select(F.col("b"), F.col("a"))).coalesce(tasks)
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.coalesce(tasks).distinct().coalesce(tasks)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select("a", F.col("m").alias("b"))).filter("a <> b").coalesce(tasks)
        table = durable(small.distinct().coalesce(tasks))
        before, mark = mark, _mark(table)
        if before == mark:
            break
    roots = table.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return table.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _mark(table: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    r = table.agg(F.count(F.lit(1)), F.sum(h % 1_000_003), F.sum(F.shiftrightunsigned(h, 40))).first()
    return tuple(r)
