"""Neighbourhood gathering on dense voxel tables.

Voxels are packed to one row per image line, so what is shuffled and ordered are lines, not voxels. Volumes are cut
along z into slabs and along y into bands of fixed size, and the lines next to a cut go to both sides. Inside a slab, lag/lead over y and
over z bring the eight neighbouring lines next to every line; unpacking then reads all 27 values of a voxel by position.
Neither a volume nor a self-join ever has to meet in one task. Lines must be present for the whole box that is passed
in, as image arrays are; gaps inside a line are filled with null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLAB = 16
#: Lines of a slice that one task holds beside the rims.
BAND = 256
CENTRE = 13

# The 13 forward directions (dz, dy, dx): those that are lexicographically positive.
DIRECTIONS = [
    (dz, dy, dx)
    for dz in (-1, 0, 1)
    for dy in (-1, 0, 1)
    for dx in (-1, 0, 1)
    if (dz, dy, dx) > (0, 0, 0)
]


def spot(dz: int, dy: int, dx: int) -> int:
    """Position of an offset in the gathered array."""
    return (dz + 1) * 9 + (dy + 1) * 3 + dx + 1


def neighbour(dz: int, dy: int, dx: int) -> Column:
    """Gathered value at an offset."""
    return F.col("nb")[spot(dz, dy, dx)]


def pack_lines(vox: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per (image, z, y): first x as ``lo`` and one array per column."""
    lines = vox.groupBy(*keys, "z", "y").agg(
        F.sort_array(F.collect_list(F.struct("x", *columns))).alias("_c"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    dense = F.size("_c") == F.col("hi") - F.col("lo") + 1
    by_x = F.map_from_entries(F.transform("_c", lambda c: F.struct(c["x"], c)))
    filled = F.transform(F.sequence("lo", "hi"), lambda x: F.try_element_at(by_x, x))
    lines = lines.withColumn("_c", F.when(dense, F.col("_c")).otherwise(filled))
    return lines.select(*keys, "z", "y", "lo", *[F.col(f"_c.{c}").alias(c) for c in columns])


def _beside(df: DataFrame, within: Sequence[str], axis: str, names: Sequence[str]) -> DataFrame:
    """Add the named columns of the adjacent rows: ``<name>_<axis>0`` before and ``<name>_<axis>2`` after."""
    w = Window.partitionBy(*within).orderBy(axis)
    pack = F.struct(F.col(axis).alias("at"), *names)
    both = df.withColumn("_before", F.lag(pack).over(w)).withColumn("_after", F.lead(pack).over(w))
    for side, step, mark in (("_before", -1, "0"), ("_after", 1, "2")):
        near = F.col(f"{side}.at") == F.col(axis) + step
        both = both.withColumns({f"{n}_{axis}{mark}": F.when(near, F.col(f"{side}.{n}")) for n in names})
    return both.drop("_before", "_after")


def neighbour_lines(
    vox: DataFrame, column: str, keys: Sequence[str], carry: Sequence[str] = (), depth: int = SLAB, rows: int = BAND
) -> DataFrame:
    """Packed lines with their neighbours: ``l``, ``l_y0``, ``l_y2`` along y, each again with ``_z0``/``_z2``.

    ``carry`` columns come along for the centre line. One row per line makes this the cheap form to persist.
    """
    lines = pack_lines(vox, [column, *carry], keys)

    def homes(at: Column, size: int) -> Column:
        return F.array_distinct(F.array(*[F.floor(c / size) for c in (at, F.greatest(at - 1, F.lit(0)), at + 1)]))

    z, y = F.col("z"), F.col("y")
    held = lines.select(
        *keys, "z", "y", F.struct("lo", F.col(column).alias("v")).alias("l"), *carry, F.explode(homes(z, depth)).alias("_slab")
    )
    held = held.withColumn("_band", F.explode(homes(y, rows))).repartition(*keys, "_slab", "_band")
    held = _beside(held, [*keys, "_slab", "_band", "z"], "y", ["l"])
    held = _beside(held, [*keys, "_slab", "_band", "y"], "z", ["l", "l_y0", "l_y2"])
    own = (F.col("_slab") == F.floor(z / depth)) & (F.col("_band") == F.floor(y / rows))
    return held.filter(own).drop("_slab", "_band")


def neighbour_lines_in_slice(vox: DataFrame, column: str, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Packed lines with their neighbours along y only."""
    lines = pack_lines(vox, [column, *carry], keys)
    held = lines.select(*keys, "z", "y", F.struct("lo", F.col(column).alias("v")).alias("l"), *carry)
    return _beside(held.repartition(*keys, "z"), [*keys, "z"], "y", ["l"])


def unpack_neighbours(
    lines: DataFrame, column: str, keys: Sequence[str], carry: Sequence[str] = (), planar: bool = False
) -> DataFrame:
    """Voxels with a value in ``column`` and ``nb``, the values at the 27 (in a slice 9) offsets around them.

    Index (dz+1)*9 + (dy+1)*3 + dx+1; null where there is no row or value.
    """
    names = ["l_y0", "l", "l_y2"]
    if not planar:
        names = [f"{n}{mark}" for mark in ("_z0", "", "_z2") for n in names]
    cells = lines.select("*", F.posexplode("l.v").alias("_pos", column)).filter(F.col(column).isNotNull())
    x = F.col("l.lo") + F.col("_pos")
    around = [F.get(F.col(f"{n}.v"), x - F.col(f"{n}.lo") + dx) for n in names for dx in (-1, 0, 1)]
    return cells.select(
        *keys,
        "z",
        "y",
        x.alias("x"),
        column,
        *[F.get(F.col(c), F.col("_pos")).alias(c) for c in carry],
        F.array(*around).alias("nb"),
    )


def gather_neighbours(
    vox: DataFrame, column: str, keys: Sequence[str], carry: Sequence[str] = (), depth: int = SLAB
) -> DataFrame:
    """Voxels of one table with the 27 values around them."""
    return unpack_neighbours(neighbour_lines(vox, column, keys, carry, depth), column, keys, carry)


def gather_in_slice(vox: DataFrame, column: str, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Voxels with the 9 values around them in their slice."""
    return unpack_neighbours(neighbour_lines_in_slice(vox, column, keys, carry), column, keys, carry, planar=True)
