"""3 x 3 stencils over cell(row, col, z): two windows, one along rows and one along columns.

Both windows split the grid by row or column, so a shuffle moves each cell once and no task holds
more than one line of the grid. NULL z is nodata, and so is a cell that is missing: the windows take
the row before as the neighbour, so gaps are filled first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.session import written


def densify(cells: DataFrame, height: int, width: int) -> DataFrame:
    """All cells of the grid; missing ones get NULLs."""
    frame = cells.sparkSession.range(height * width).select((F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    return frame.join(cells, ["row", "col"], "left")


def dense(cells: DataFrame) -> DataFrame:
    """cells, or where some cell of their box is missing or repeated, all cells of the box once each.

    Of a repeated cell the row with the greatest z counts. That no cell is missing shows in their
    number and in the exclusive or of their hashes; neither takes a shuffle.
    """
    sign = F.bit_xor(F.xxhash64(F.col("row").cast("long"), F.col("col").cast("long"))).alias("sign")
    box = cells.agg(F.count("*").alias("n"), sign, *[f(c).alias(f"{k}_{c}") for c in ("row", "col") for k, f in (("lo", F.min), ("hi", F.max))]).first()
    if not box["n"]:
        return cells
    height, width = (box[f"hi_{c}"] - box[f"lo_{c}"] + 1 for c in ("row", "col"))
    if box["n"] == height * width:
        whole = cells.sparkSession.range(height * width).select((F.floor(F.col("id") / width) + box["lo_row"]).alias("row"), (F.col("id") % width + box["lo_col"]).alias("col"))
        if whole.agg(sign).first()["sign"] == box["sign"]:
            return cells
    others = [c for c in cells.columns if c not in ("row", "col", "z")]
    once = cells.groupBy("row", "col").agg(F.max(F.struct("z", *others)).alias("__s")).select("row", "col", "__s.*")
    shifted = once.withColumns({c: F.col(c) - box[f"lo_{c}"] for c in ("row", "col")})
    return densify(shifted, height, width).withColumns({c: (F.col(c) + box[f"lo_{c}"]).cast("int") for c in ("row", "col")})


def _lines(cells: DataFrame) -> tuple[DataFrame, Window, Window]:
    cells = dense(cells)
    across, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    return cells.withColumn("nd", F.col("z").isNull() | F.isnan("z")).withColumn("z0", F.when(F.col("nd"), F.lit(0.0)).otherwise(F.col("z").cast("double"))), across, down


def dilated_nodata(cells: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row, col, nodata): nodata there or in one of the eight cells around; outside the grid is not nodata."""
    d, across, down = _lines(cells)
    d = d.withColumn("n1", F.max(F.col("nd").cast("int")).over(across.rowsBetween(-1, 1)))
    return d.select("row", "col", *keep, (F.max("n1").over(down.rowsBetween(-1, 1)) == 1).alias("nodata"))


def terrain(cells: DataFrame, res: float) -> DataFrame:
    """(row, col, z, slope, aspect, roughness, nodata) from one pass in each direction.

    slope: Horn's gradient in degrees, the border mirrored without its own cell. aspect: downslope
    direction clockwise from north, NULL where flat. roughness: population deviation of the nine
    heights, the border repeated. All NULL where nodata lies in reach.
    """
    d, across, down = _lines(cells)
    left, right = F.lag("z0").over(across), F.lead("z0").over(across)
    d = d.select("*", left.alias("l"), right.alias("r"), F.max(F.col("nd").cast("int")).over(across.rowsBetween(-1, 1)).alias("n1"))
    l, r, z = F.col("l"), F.col("r"), F.col("z0")  # noqa: E741
    d = d.select(
        "row", "col", "z", "n1",
        (F.coalesce(r, l) - F.coalesce(l, r)).alias("de"),
        (F.coalesce(l, r) + 2 * z + F.coalesce(r, l)).alias("sm"),
        (F.coalesce(l, z) + z + F.coalesce(r, z)).alias("s1"),
        (F.coalesce(l * l, z * z) + z * z + F.coalesce(r * r, z * z)).alias("s2"),
    )
    for c in ("de", "sm", "s1", "s2"):
        d = d.withColumn(f"{c}_n", F.lag(c).over(down)).withColumn(f"{c}_s", F.lead(c).over(down))
    d = d.withColumn("nodata", F.max("n1").over(down.rowsBetween(-1, 1)) == 1)
    pick = lambda c, a, b: F.coalesce(F.col(f"{c}_{a}"), F.col(f"{c}_{b}"))
    east = (pick("de", "n", "s") + 2 * F.col("de") + pick("de", "s", "n")) / (8 * res)
    north = (pick("sm", "n", "s") - pick("sm", "s", "n")) / (8 * res)
    nine = lambda c: F.coalesce(F.col(f"{c}_n"), F.col(c)) + F.col(c) + F.coalesce(F.col(f"{c}_s"), F.col(c))
    d = d.select("row", "col", "z", "nodata", east.alias("e"), north.alias("n"), (nine("s1") / 9).alias("m1"), (nine("s2") / 9).alias("m2"))
    valid = lambda x: F.when(~F.col("nodata"), x)
    return d.select(
        "row", "col", "z",
        valid(F.degrees(F.atan(F.sqrt(F.col("e") * F.col("e") + F.col("n") * F.col("n"))))).alias("slope"),
        valid(F.when((F.col("e") != 0) | (F.col("n") != 0), F.pmod(90 - F.degrees(F.atan2(-F.col("n"), -F.col("e"))), F.lit(360.0)))).alias("aspect"),
        valid(F.sqrt(F.greatest(F.col("m2") - F.col("m1") * F.col("m1"), F.lit(0.0)))).alias("roughness"),
        "nodata",
    )


def hillshade(cells: DataFrame, res: float, azimuth: float = 315.0, altitude: float = 45.0, exaggeration: float = 2.0) -> DataFrame:
    """(row, col, shade): light on the surface, stretched so that the darkest cell is 0 and the brightest 1; nodata counts as height 0.

    Gradients are central differences, one-sided at the border. An even light is left as it is.
    """
    d, across, down = _lines(cells)
    z = F.col("z0") * exaggeration
    slope = lambda w: (F.coalesce(F.lead("z0").over(w), F.col("z0")) - F.coalesce(F.lag("z0").over(w), F.col("z0"))) * exaggeration / (res * F.greatest(F.lit(1), F.lead(F.lit(1), 1, 0).over(w) + F.lag(F.lit(1), 1, 0).over(w)))
    d = d.select("row", "col", z.alias("z"), slope(across).alias("e"), slope(down).alias("s"))
    a, h = math.radians(90 - azimuth), math.radians(altitude)
    light = (-F.col("e") * math.cos(a) * math.cos(h) + F.col("s") * math.sin(a) * math.cos(h) + math.sin(h)) / F.sqrt(F.col("e") * F.col("e") + F.col("s") * F.col("s") + 1)
    d = written(d.select("row", "col", light.alias("light")))  # read twice: for the extremes and to be stretched
    low, span = F.col("low"), F.col("high") - F.col("low")
    stretched = F.when(span > 1e-6, (F.col("light") - low) / span).otherwise(F.col("light"))
    return d.crossJoin(F.broadcast(d.agg(F.min("light").alias("low"), F.max("light").alias("high")))).select("row", "col", F.least(F.greatest(stretched, F.lit(0.0)), F.lit(1.0)).alias("shade"))


def for_display(value: Column, lo: float = 0.0, hi: float = 10.0) -> Column:
    """Held to a range, as a map shows it; NULL stays NULL."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(lo)), F.lit(hi)))


def window_of(cells: DataFrame, row: int, col: int, reach: int = 250, tile: int | None = None) -> DataFrame:
    """The cells within `reach` of a cell, with row and col counted from the window's corner; a range filter that reaches the scan.

    With `tile`, the side of the tiles that cells are laid out by in tile_row and tile_col, other
    tiles are not even opened.
    """
    r0, c0 = max(row - reach, 0), max(col - reach, 0)
    found = cells.where(F.col("row").between(r0, row + reach) & F.col("col").between(c0, col + reach))
    if tile:
        found = found.where(F.col("tile_row").between(r0 // tile, (row + reach) // tile) & F.col("tile_col").between(c0 // tile, (col + reach) // tile)).drop("tile_row", "tile_col")
    return found.withColumn("row", F.col("row") - r0).withColumn("col", F.col("col") - c0)
