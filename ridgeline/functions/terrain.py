"""Per-cell cost factors as column expressions. NULL is nodata; a NULL operand gives NULL unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODATA = -9999.0


def clean(z: Column) -> Column:
    """Sentinel, NaN and impossible heights to NULL."""
    return F.when(~F.isnan(z) & (z >= -100), z)


def walking_speed(gradient: Column) -> Column:
    """km/h off trail on a signed gradient, 0.01 at least."""
    return F.greatest(6 * F.exp(-3.5 * F.abs(gradient + 0.05)) * 0.6, F.lit(0.01))


def slope_cost(slope: Column) -> Column:
    """Time on a slope in degrees against flat ground; five times that above 45, another fifty times above 60."""
    gradient = F.tan(F.radians(F.least(F.greatest(slope, F.lit(0.0)), F.lit(89.9))))
    flat = 6 * F.exp(F.lit(-0.175)) * 0.6
    base = flat / walking_speed(gradient) * F.when(slope > 45, 5.0).otherwise(1.0) * F.when(slope > 60, 50.0).otherwise(1.0)
    return F.when(slope.isNotNull(), base)


def altitude_cost(z: Column, acclimatized: bool = False) -> Column:
    rate = 0.03 if acclimatized else 0.063
    loss = F.greatest(F.lit(0.0), z - 1500) * rate / 1000
    return F.when(z.isNotNull(), 1 / F.greatest(1 - loss, F.lit(0.3)))


def aspect_cost(aspect: Column, slope: Column, z: Column, month: int) -> Column:
    """Summer: soft snow on steep high south faces; otherwise hard snow on north faces. Flat ground (NULL aspect) is neutral."""
    a = F.radians(aspect)
    if month in (6, 7, 8, 9):
        return F.when((slope > 30) & (z > 2500) & aspect.isNotNull(), 1 + 0.5 * F.greatest(F.cos(a - F.lit(3.141592653589793)), F.lit(0.0))).otherwise(1.0)
    return F.when((slope > 25) & aspect.isNotNull(), 1 + 0.3 * F.greatest(F.cos(a), F.lit(0.0))).otherwise(1.0)


def glacier_cost(glacier: Column, slope: Column) -> Column:
    """1 off the glacier or without a mask; on it by steepness."""
    ladder = F.when(slope < 10, 1.3).when(slope < 20, 2.0).when(slope < 30, 4.0).otherwise(10.0)
    return F.when(F.coalesce(glacier, F.lit(False)), ladder).otherwise(1.0)


def roughness_cost(roughness: Column) -> Column:
    return F.when(roughness.isNotNull(), 1 + 0.8 * F.least(roughness, F.lit(5.0)))


def routing_cost(cost: Column) -> Column:
    """Nodata is impassable; all else is held to [0, 1e6]."""
    return F.when(cost.isNull() | F.isnan(cost), F.lit(float("inf"))).otherwise(F.least(F.greatest(cost, F.lit(0.0)), F.lit(1e6)))
