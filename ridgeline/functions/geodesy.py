"""Projections as closed-form column expressions: Lambert-93, spherical Mercator, and the grid's affine transform."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed values of Lambert-93 on GRS80.
E = math.sqrt(2 / 298.257222101 - 1 / 298.257222101**2)
N, C, XS, YS, LON0 = 0.7256077650532670, 11754255.426096, 700000.0, 12655612.049876, 3.0
EARTH = 6378137.0


@dataclass(frozen=True)
class Grid:
    """Where a grid lies: the western and northern edge, the side of a cell, and its size in cells; row 0 is the northern edge."""

    xmin: float
    ymax: float
    res: float
    width: int
    height: int
    crs: str = "EPSG:2154"
    nodata: float = -9999.0

    @classmethod
    def over(cls, xmin: float, ymin: float, xmax: float, ymax: float, res: float) -> Grid:
        """The grid of an extent, its sides rounded to whole cells, half to even."""
        return cls(xmin, ymax, res, round((xmax - xmin) / res), round((ymax - ymin) / res))

    def write(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([asdict(self)], GRID).write.mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Grid:
        """From its one row; the layers themselves are not read."""
        return cls(**spark.read.schema(GRID).parquet(path).first().asDict())


GRID = "xmin double, ymax double, res double, width int, height int, crs string, nodata double"


def lambert93(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to metres."""
    s = F.sin(F.radians(lat))
    iso = F.log(F.tan(math.pi / 4 + F.radians(lat) / 2) * F.pow((1 - E * s) / (1 + E * s), F.lit(E / 2)))
    r, t = C * F.exp(-N * iso), N * F.radians(lon - LON0)
    return XS + r * F.sin(t), YS - r * F.cos(t)


class Arrays:
    """The functions that a projection takes from pyspark.sql.functions, over numpy arrays."""

    sqrt, atan, exp, log, sin, pow, degrees = np.sqrt, np.arctan, np.exp, np.log, np.sin, np.power, np.degrees

    @staticmethod
    def lit(x: float) -> float:
        return x


def lambert93_inverse(x: Column, y: Column, rounds: int = 6, f: Any = F) -> tuple[Column, Column]:
    """Metres to degrees (lon, lat); the latitude by a fixed number of iterations. With f = Arrays over arrays."""
    r = f.sqrt((x - XS) * (x - XS) + (y - YS) * (y - YS))
    lon = LON0 + f.degrees(f.atan((x - XS) / (YS - y)) / N)
    iso = -f.log(r / C) / N
    lat = 2 * f.atan(f.exp(iso)) - math.pi / 2
    for _ in range(rounds):
        s = E * f.sin(lat)
        lat = 2 * f.atan(f.exp(iso) * f.pow((1 + s) / (1 - s), f.lit(E / 2))) - math.pi / 2
    return lon, f.degrees(lat)


def mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / EARTH), F.degrees(2 * F.atan(F.exp(y / EARTH)) - math.pi / 2)


def to_pixel(x: Column, y: Column, xmin: float, ymax: float, res: float) -> tuple[Column, Column]:
    """(row, col), rounded half to even; row 0 is the northern edge."""
    return F.rint((F.lit(ymax) - y) / res).cast("int"), F.rint((x - xmin) / res).cast("int")


def to_world(row: Column, col: Column, xmin: float, ymax: float, res: float) -> tuple[Column, Column]:
    """Upper left corner of a cell."""
    return xmin + col * res, ymax - row * res
