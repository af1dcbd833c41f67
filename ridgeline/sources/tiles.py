"""Layers as tables laid out by tiles: a window reads its tiles alone, and layers of one layout are joined without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators.focal import window_of
from ridgeline.operators.surface import aligned

#: The table property that keeps the side of a tile.
TILE = "ridgeline.tile"


def save_layer(cells: DataFrame, table: str, value: str, tile: int = 4096, buckets: int = 64, path: str | None = None) -> None:
    """cells(row, col, value) as a table: a folder for each tile, and in it a file for each bucket of cells.

    Choose both so that a file has some 100,000 cells. Layers that are to be joined need the same
    number of buckets. path is where the table lies, if not in the warehouse.
    """
    at = lambda c: F.floor(F.col(c) / tile).cast("int").alias(f"tile_{c}")
    d = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), value, at("row"), at("col")).repartition(buckets, "row", "col")
    writer = d.write.partitionBy("tile_row", "tile_col").bucketBy(buckets, "row", "col").sortBy("row", "col").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    cells.sparkSession.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{TILE}' = '{tile}')")


def tile_of(spark: SparkSession, table: str) -> int:
    return int(spark.sql(f"SHOW TBLPROPERTIES {table} ('{TILE}')").first()["value"])


def window(spark: SparkSession, table: str, row: int, col: int, reach: int = 250) -> DataFrame:
    """window_of() a saved layer; folders of other tiles are not listed."""
    return window_of(spark.table(table), row, col, reach, tile_of(spark, table))


def aligned_layers(spark: SparkSession, layers: dict[str, str], mask: str | None = None) -> DataFrame:
    """aligned() over saved layers, column -> table: buckets meet buckets, so nothing is shuffled."""
    return aligned({value: spark.table(table) for value, table in layers.items()}, spark.table(mask) if mask else None)
