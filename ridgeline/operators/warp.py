"""Grids onto other grids: bilinear warping between coordinate systems, and mosaics of tiles that each have a transform of their own."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.geodesy import Grid
from ridgeline.functions.session import written

#: Arrays of x and y of a target grid -> the same points in the source's coordinate system.
Inverse = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def blocks(cells: DataFrame, tile: int) -> DataFrame:
    """cells(row, col, z) -> (sr, sc, block): a row for each tile that has a valid cell, its heights as bytes, NaN where there is none."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.full((tile, tile), np.nan)
        out[pdf["row"].to_numpy() % tile, pdf["col"].to_numpy() % tile] = pdf["z"].to_numpy()
        return pd.DataFrame({"sr": [key[0]], "sc": [key[1]], "block": [out.tobytes()]})

    at = lambda c: F.floor(F.col(c) / tile).cast("int")
    return cells.where("z is not null and not isnan(z)").select(at("row").alias("sr"), at("col").alias("sc"), "row", "col", F.col("z").cast("double").alias("z")).groupBy("sr", "sc").applyInPandas(run, "sr int, sc int, block binary")


def _places(source: Grid, target: Grid, inverse: Inverse, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the centres of target cells lie among the centres of source cells."""
    x, y = inverse(target.xmin + (col + 0.5) * target.res, target.ymax - (row + 0.5) * target.res)
    return (source.ymax - y) / source.res - 0.5, (x - source.xmin) / source.res - 0.5


def footprints(source: Grid, target: Grid, inverse: Inverse, tile: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Numbers of target tiles -> (tr, tc, sr, sc): the source tiles that each may need. A tile's border bounds what it covers."""
    across, down = math.ceil(target.width / tile), math.ceil(source.height / tile)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        side, low, high = np.arange(tile), np.zeros(tile, int), np.full(tile, tile - 1)
        border = np.concatenate([np.stack([low, side]), np.stack([high, side]), np.stack([side, low]), np.stack([side, high])], axis=1)
        for b in batches:
            out = []
            for k in b["id"]:
                tr, tc = divmod(int(k), across)
                places = _places(source, target, inverse, border[0] + tr * tile, border[1] + tc * tile)
                if not all(np.isfinite(p).any() for p in places):
                    continue
                (r0, r1), (c0, c1) = ((int(np.floor(np.nanmin(p))) // tile, int(np.ceil(np.nanmax(p))) // tile) for p in places)
                out += [(tr, tc, r, c) for r in range(max(r0, 0), min(r1, down - 1) + 1) for c in range(max(c0, 0), min(c1, math.ceil(source.width / tile) - 1) + 1)]
            yield pd.DataFrame(out, columns=["tr", "tc", "sr", "sc"])

    return run


def warp(cells: DataFrame, source: Grid, target: Grid, inverse: Inverse, tile: int = 256) -> DataFrame:
    """cells(row, col, z) of the grid `source` -> (row, col, z) of those cells of the grid `target` that get a height.

    inverse brings points of the target's coordinate system to the source's. A target cell gets the
    bilinear mean of the four source cells around its centre; nodata and what lies beyond the
    source's edge drop out and weights are renormalised; a centre outside of the source gets nothing.
    The target's extent crops. Each target tile is one task's work: it meets the source tiles of its
    footprint by an equi-join, so no task holds more than these.
    """
    spark = cells.sparkSession
    n = math.ceil(target.height / tile) * math.ceil(target.width / tile)
    wanted = spark.range(n).mapInPandas(footprints(source, target, inverse, tile), "tr int, tc int, sr int, sc int")
    stored = written(blocks(cells, tile))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = pdf["sr"].min() * tile, pdf["sc"].min() * tile
        z = np.full(((pdf["sr"].max() + 1) * tile - r0 + 2, (pdf["sc"].max() + 1) * tile - c0 + 2), np.nan)  # with a margin
        for r, c, block in zip(pdf["sr"], pdf["sc"], pdf["block"], strict=True):
            z[r * tile - r0 + 1 : (r + 1) * tile - r0 + 1, c * tile - c0 + 1 : (c + 1) * tile - c0 + 1] = np.frombuffer(block).reshape(tile, tile)
        row, col = (x.ravel() for x in np.mgrid[key[0] * tile : min((key[0] + 1) * tile, target.height), key[1] * tile : min((key[1] + 1) * tile, target.width)])
        fr, fc = _places(source, target, inverse, row, col)
        there = (fr >= -0.5) & (fr <= source.height - 0.5) & (fc >= -0.5) & (fc <= source.width - 0.5)
        row, col, fr, fc = row[there], col[there], fr[there], fc[there]
        r, c = np.floor(fr), np.floor(fc)
        total, weight = np.zeros(len(row)), np.zeros(len(row))
        for i in (0, 1):
            for j in (0, 1):
                w = (fr - r if i else 1 - (fr - r)) * (fc - c if j else 1 - (fc - c))
                at = (r + i).astype(int) - r0 + 1, (c + j).astype(int) - c0 + 1
                inside = (at[0] >= 0) & (at[0] < z.shape[0]) & (at[1] >= 0) & (at[1] < z.shape[1])
                v = np.where(inside, z[np.clip(at[0], 0, z.shape[0] - 1), np.clip(at[1], 0, z.shape[1] - 1)], np.nan)
                w = np.where(np.isnan(v), 0, w)
                total, weight = total + w * np.where(np.isnan(v), 0, v), weight + w
        got = weight > 0
        return pd.DataFrame({"row": row[got], "col": col[got], "z": total[got] / weight[got]})

    return wanted.join(stored, ["sr", "sc"]).groupBy("tr", "tc").applyInPandas(run, "row int, col int, z double")


def union_grid(tiles: DataFrame) -> Grid:
    """The grid over all tiles(rank, xmin, ymax, res, width, height), at the resolution of the first by rank."""
    d = tiles.agg(F.min("xmin"), F.min(F.col("ymax") - F.col("height") * F.col("res")), F.max(F.col("xmin") + F.col("width") * F.col("res")), F.max("ymax"), F.min_by("res", "rank")).first()
    return Grid.over(*d)


def mosaic_tiles(tiles: DataFrame, cells: DataFrame, target: Grid) -> DataFrame:
    """tiles(tile, rank, xmin, ymax, res, nodata), cells(tile, row, col, z) -> (row, col, z) of the grid `target`: the first tile by rank
    with a valid height at each cell's centre.

    Each tile has its own origin, resolution and nodata value (NULL and NaN are nodata too; a NULL
    nodata value means no other). A source cell knows which target centres lie in it, so cells are
    spread by arithmetic alone and only what competes for a target cell is shuffled, after a partial
    aggregate. Target cells that no tile has a height for are missing.
    """
    known = cells.join(tiles.select("tile", "rank", "xmin", "ymax", "res", "nodata"), "tile")
    known = known.where("z is not null and not isnan(z) and not z <=> nodata")
    edge = lambda start, k: F.ceil((start + k * F.col("res")) / target.res - 0.5)
    reach = lambda start, k, most: F.sequence(F.greatest(edge(start, k), F.lit(0)), F.least(edge(start, k + 1) - 1, F.lit(most - 1)))
    has = lambda start, k, most: F.greatest(edge(start, k), F.lit(0)) <= F.least(edge(start, k + 1) - 1, F.lit(most - 1))
    down, along = target.ymax - F.col("ymax"), F.col("xmin") - target.xmin
    met = known.where(has(down, F.col("row"), target.height) & has(along, F.col("col"), target.width))
    rows = met.withColumn("trow", F.explode(reach(down, F.col("row"), target.height)))
    spread = rows.select("rank", "z", "trow", F.explode(reach(along, F.col("col"), target.width)).alias("tcol"))
    return spread.groupBy(F.col("trow").cast("int").alias("row"), F.col("tcol").cast("int").alias("col")).agg(F.min_by("z", "rank").alias("z"))
