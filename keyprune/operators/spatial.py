"""Planar geometry on a square grid: cells, joins within a distance, cell filters."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(x: Column | str, size: float) -> Column:
    return F.floor((F.col(x) if isinstance(x, str) else x) / size + 0.5)


def cells(points: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """gx, gy, n_points of the grid cells that hold points."""
    return points.groupBy(cell(x, size).alias("gx"), cell(y, size).alias("gy")).agg(F.count("*").alias("n_points"))


def boxes(cell_rows: DataFrame, size: float, by: list[str]) -> DataFrame:
    """The rectangle around the cells of each group."""
    return cell_rows.groupBy(*by).agg(((F.min("gx") - 0.5) * size).alias("xmin"), ((F.min("gy") - 0.5) * size).alias("ymin"), ((F.max("gx") + 0.5) * size).alias("xmax"), ((F.max("gy") + 0.5) * size).alias("ymax"))


def ring(cell_rows: DataFrame, distance: float, size: float) -> DataFrame:
    """The cells that hold all points within distance of a point in one of the given cells."""
    k = math.ceil(distance / size)
    steps = F.sequence(F.lit(-k), F.lit(k))
    return cell_rows.select("gx", "gy").select("gx", "gy", F.explode(steps).alias("dx")).select("gx", "gy", "dx", F.explode(steps).alias("dy")).select((F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy")).distinct()


def within(a: DataFrame, b: DataFrame, distance: float, a_xy: tuple[str, str], b_xy: tuple[str, str]) -> DataFrame:
    """Pairs closer than distance: b's rows go to their cell and its eight neighbours, an equi-join meets them, the exact test follows."""
    near = F.sequence(F.lit(-1), F.lit(1))
    left = a.withColumns({"__gx": cell(a_xy[0], distance), "__gy": cell(a_xy[1], distance)})
    right = b.withColumn("__dx", F.explode(near)).withColumn("__dy", F.explode(near)).withColumns({"__gx": cell(b_xy[0], distance) + F.col("__dx"), "__gy": cell(b_xy[1], distance) + F.col("__dy")})
    dx, dy = F.col(a_xy[0]) - F.col(b_xy[0]), F.col(a_xy[1]) - F.col(b_xy[1])
    return left.join(right.drop("__dx", "__dy"), ["__gx", "__gy"]).filter(F.sqrt(dx * dx + dy * dy) < distance).drop("__gx", "__gy")


#: The rows of a cell are dealt to so many groups, each of which meets all rows around the cell: many copies of a point are not one group's.
SHARES = 4
_GROUP = ("__gx", "__gy", "__share")


def dealt(rows: DataFrame, size: float, xy: tuple[str, str], by: list[str]) -> DataFrame:
    """The rows dealt by their cell, and within it by a hash of the columns `by`; `gathered` then moves them no more."""
    keyed = rows.withColumns({"__gx": cell(F.col(xy[0]), size), "__gy": cell(F.col(xy[1]), size), "__share": F.pmod(F.xxhash64(*by), F.lit(SHARES).cast("long"))})
    return keyed.repartition(_parts(rows), *_GROUP)


def gathered(rows: DataFrame, others: DataFrame, size: float, xy: tuple[str, str], row: Column, name: str) -> DataFrame:
    """Dealt rows, each with an array of `row` of all others of its cell and the eight around it: what is moved follows the number of others,
    not that of pairs. Rows with none are left out."""
    step = F.sequence(F.lit(-1), F.lit(1))
    shares = F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))
    keyed = others.select(row.alias(name), cell(F.col(xy[0]), size).alias("__gx"), cell(F.col(xy[1]), size).alias("__gy")).dropna(subset=["__gx", "__gy"])
    sent = keyed.withColumn("__dx", F.explode(step)).withColumn("__dy", F.explode(step)).withColumn("__share", F.explode(shares))
    sent = sent.select(name, (F.col("__gx") + F.col("__dx")).alias("__gx"), (F.col("__gy") + F.col("__dy")).alias("__gy"), "__share")
    return rows.join(sent.repartition(_parts(rows), *_GROUP).groupBy(*_GROUP).agg(F.collect_list(name).alias(name)), list(_GROUP))


def apart(rows: DataFrame) -> DataFrame:
    """The same rows and partitions, and an end to Spark's fused loop: without it a task holds all rows that one row's nested arrays make, before
    the first of them is written."""
    return rows.coalesce(1 << 20)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def restrict(points: DataFrame, cell_rows: DataFrame, distance: float, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Points that can lie within distance of a point in the cells: a semi-join on the ring of cells."""
    keys = ring(cell_rows, distance, size)
    return points.withColumns({"gx": cell(x, size), "gy": cell(y, size)}).join(keys, ["gx", "gy"], "left_semi").drop("gx", "gy")


def key_of(x: Column | str, y: Column | str, size: float) -> Column:
    """A cell's key, as plans.fragments.cell_sql states it."""
    return cell(x, size) * 4294967296 + cell(y, size) + 2147483648


def cells_of(keys: DataFrame) -> DataFrame:
    """gx, gy of cells' keys."""
    return keys.select(F.shiftright("pk", 32).alias("gx"), (F.col("pk").bitwiseAND(F.lit(0xFFFFFFFF)) - 2147483648).alias("gy"))


def widened(keys: DataFrame, distance: float, size: float) -> DataFrame:
    """The keys of all cells within distance of the given ones."""
    return ring(cells_of(keys), distance, size).select((F.col("gx") * 4294967296 + F.col("gy") + 2147483648).alias("pk"))


def as_wkt(keys: DataFrame, size: float) -> DataFrame:
    """pk, wkt: each cell as a polygon, counter-clockwise."""
    c = cells_of(keys.select("pk")).select("gx", "gy")
    edge = lambda g, d: ((F.col(g) + d) * size).cast("string")
    corner = lambda x, y: F.concat(edge("gx", x), F.lit(" "), edge("gy", y))
    ring_ = F.concat_ws(", ", *(corner(x, y) for x, y in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5))))
    return c.select((F.col("gx") * 4294967296 + F.col("gy") + 2147483648).alias("pk"), F.concat(F.lit("POLYGON (("), ring_, F.lit("))")).alias("wkt"))


def wkb_of_box(xmin: float, ymin: float, xmax: float, ymax: float) -> bytes:
    """A rectangle in well-known binary: little-endian, one polygon of one ring."""
    corners = (xmin, ymin, xmax, ymin, xmax, ymax, xmin, ymax, xmin, ymin)
    return struct.pack("<BIII10d", 1, 3, 1, 5, *corners)


def box_of_wkb(data: bytes) -> tuple[float, float, float, float]:
    """The rectangle around a polygon's outer ring in well-known binary of either byte order."""
    order = "<" if data[0] else ">"
    kind, _, n = struct.unpack_from(order + "III", data, 1)
    if kind != 3:
        raise ValueError("not a polygon")
    at = struct.unpack_from(f"{order}{2 * n}d", data, 13)
    return min(at[::2]), min(at[1::2]), max(at[::2]), max(at[1::2])
