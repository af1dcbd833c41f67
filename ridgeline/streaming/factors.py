"""Cost factors over a stream of cells: stateless, so the batch operator runs unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ridgeline.operators.surface import cost_surface


def cost_stream(cells: DataFrame, month: int = 7, acclimatized: bool = False) -> DataFrame:
    """A streaming cells(slope, aspect, z, roughness, glacier) with factors and cost; nothing is kept between batches."""
    return cost_surface(cells, month, acclimatized)
