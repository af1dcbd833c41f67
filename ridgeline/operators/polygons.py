"""Polygons with holes and several parts: a scan-line edge table that burns them into a grid, and clipping against a box.

parts is an array of parts; a part is an array of closed rings, the outer one and its holes; a ring is
an array of (x, y). Inside is even-odd over all rings of a part, so neither their order nor their
orientation counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.geodesy import Grid
from ridgeline.functions.session import written

PARTS = "array<array<array<struct<x: double, y: double>>>>"


def in_cells(parts: Column, grid: Grid) -> Column:
    """Coordinates in metres as cells from the grid's corner: x along columns, y along rows."""
    point = lambda p: F.struct(((p["x"] - grid.xmin) / grid.res).alias("x"), ((grid.ymax - p["y"]) / grid.res).alias("y"))
    return F.transform(parts, lambda rings: F.transform(rings, lambda ring: F.transform(ring, point)))


def _edges(ring: Column) -> Column:
    ends = F.filter(F.sequence(F.lit(0), F.greatest(F.size(ring) - 1, F.lit(0))), lambda i: i > 0)
    return F.transform(ends, lambda i: F.struct(F.get(ring, i - 1).alias("a"), F.get(ring, i).alias("b")))


def spans(polygons: DataFrame, height: int, width: int) -> DataFrame:
    """polygons(parts) in cells -> (row, first, last): stretches of cells whose centres lie in a polygon, one row for each stretch of each part.

    The edge table has an edge once for each row of cells whose centre line it crosses, the upper
    end included. A row's crossings are sorted within their part, and every other gap between two
    is inside. The work grows with edges and crossings, not with cells times vertices.
    """
    known = written(polygons.where("parts is not null").select("parts").withColumn("polygon", F.monotonically_increasing_id()))
    rings = known.select("polygon", F.posexplode("parts").alias("part", "rings")).select("polygon", "part", F.explode("rings").alias("ring"))
    edge = rings.select("polygon", "part", F.explode(_edges(F.col("ring"))).alias("e")).select("polygon", "part", *[F.col(f"e.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"])
    upper, lower = F.least("ay", "by"), F.greatest("ay", "by")
    first, last = F.greatest(F.ceil(upper - 0.5), F.lit(0)), F.least(F.ceil(lower - 0.5) - 1, F.lit(height - 1))
    rows = edge.withColumn("rows", F.when(first <= last, F.sequence(first, last))).withColumn("row", F.explode("rows"))
    at = (F.col("bx") - F.col("ax")) * (F.col("row") + 0.5 - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")
    line = Window.partitionBy("polygon", "part", "row").orderBy("x")
    gap = rows.select("polygon", "part", "row", at.alias("x")).select("row", "x", F.lead("x").over(line).alias("to"), F.row_number().over(line).alias("n")).where("n % 2 = 1")
    c0, c1 = F.greatest(F.ceil(F.col("x") - 0.5), F.lit(0)), F.least(F.ceil(F.col("to") - 0.5) - 1, F.lit(width - 1))
    return gap.select(F.col("row").cast("int").alias("row"), c0.cast("int").alias("first"), c1.cast("int").alias("last")).where("first <= last")


def burnt(polygons: DataFrame, height: int, width: int, tile: int = 256) -> DataFrame:
    """polygons(parts) in cells -> (row, col) of the cells whose centre lies in any of them, once each.

    Stretches are cut at tiles' borders and joined where they overlap before they are spelled out, so
    polygons on top of each other cost no more than one.
    """
    cut = spans(polygons, height, width).withColumn("tile", F.explode(F.sequence(F.floor(F.col("first") / tile), F.floor(F.col("last") / tile))))
    cut = cut.select("row", "tile", F.greatest("first", F.col("tile") * tile).alias("first"), F.least("last", (F.col("tile") + 1) * tile - 1).alias("last"))
    line = Window.partitionBy("row", "tile").orderBy("first", "last")
    before = F.max("last").over(line.rowsBetween(Window.unboundedPreceding, -1))
    new = cut.withColumn("first", F.greatest("first", F.coalesce(before + 1, F.col("first")))).where("first <= last")
    return new.select("row", F.explode(F.sequence("first", "last")).alias("col"))


def polygon_mask(cells: DataFrame, polygons: DataFrame) -> DataFrame:
    """cells(row, col) with glacier: whether the centre lies in a polygon(parts), in cell units.

    NULL polygons, parts without a ring and rings without an area hit nothing; without polygons all is false.
    """
    box = cells.agg(F.coalesce(F.max("row"), F.lit(-1)).alias("r"), F.coalesce(F.max("col"), F.lit(-1)).alias("c")).first()
    hits = burnt(polygons, int(box["r"]) + 1, int(box["c"]) + 1).withColumn("glacier", F.lit(True))
    return cells.join(hits, ["row", "col"], "left").withColumn("glacier", F.coalesce("glacier", F.lit(False)))


def _clipped(e: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a segment has a point in the box, borders included: the stretch of it between each pair of sides, as shares of its length."""
    lo, hi = [F.lit(0.0)], [F.lit(1.0)]
    outside = F.lit(False)
    for c, least, most in (("x", box[0], box[2]), ("y", box[1], box[3])):
        a, d = e["a"][c], e["b"][c] - e["a"][c]
        outside = outside | (F.when(d == 0, (a < least) | (a > most)).otherwise(False))
        first, second = F.try_divide(least - a, d), F.try_divide(most - a, d)
        lo.append(F.coalesce(F.least(first, second), F.lit(0.0)))
        hi.append(F.coalesce(F.greatest(first, second), F.lit(1.0)))
    return ~outside & (F.greatest(*lo) <= F.least(*hi))


def _holds(rings: Column, x: float, y: float) -> Column:
    """Even-odd over all rings."""
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (F.lit(x) < (e["b"]["x"] - e["a"]["x"]) * F.try_divide(y - e["a"]["y"], e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    edges = F.flatten(F.transform(rings, _edges))
    return F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def meets_box(parts: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Whether polygon and box have a point in common: an edge reaches into the box, or the box lies within a part. NULL parts meet none."""
    box = (xmin, ymin, xmax, ymax)
    edge = lambda rings: F.exists(F.flatten(F.transform(rings, _edges)), lambda e: _clipped(e, box))
    return F.coalesce(F.exists(parts, lambda rings: edge(rings) | _holds(rings, xmin, ymin)), F.lit(False))
