"""Raster tiles as they land in a folder: each is taken once, and what cannot be read is set aside with its reason."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ridgeline.sources.tiff import read_header

TILE = "path string, bytes long, width int, height int, xmin double, ymax double, res double, reason string"
BINARY = "path string, modificationTime timestamp, length long, content binary"


def _looked_at(path: str, content: bytes) -> tuple:
    """A tile's size and place, or why it cannot be read: header and all cells are decoded."""
    try:
        h = read_header(io.BytesIO(content))
        for k, (offset, size) in enumerate(zip(h.offsets, h.sizes, strict=True)):
            if offset + size > len(content):
                raise ValueError("the file ends too early")
            h.decoded(k, content[offset : offset + size])
        return path, len(content), h.width, h.height, h.xmin, h.ymax, h.res, None
    except (ValueError, OverflowError, struct.error, zlib.error) as e:
        return path, len(content), None, None, None, None, None, str(e) or "no TIFF file"


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string())
    for b in batches:
        rows = [_looked_at(p, c) for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], [x.split()[0] for x in TILE.split(", ")])


def land_tiles(spark: SparkSession, incoming: str, ledger: str) -> None:
    """Takes all tiles (*.tif) of the folder `incoming` that no earlier call has taken, and ends.

    Under `ledger` lie the stream's checkpoint, which knows by their paths what has been taken, and
    a table for each outcome: see landed() and quarantined(). A tile is checked by one task. A batch
    that is repeated after a failure replaces what it wrote before. A tile that was set aside has to
    come again under another name.
    """

    def take(batch: DataFrame, number: int) -> None:
        batch.select("path", "content").mapInArrow(_checked, TILE).write.mode("overwrite").parquet(f"{ledger}/tiles/batch={number}")

    tiles = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.tif").option("maxFilesPerTrigger", 10_000).load(incoming)
    tiles.writeStream.foreachBatch(take).option("checkpointLocation", f"{ledger}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def _tiles(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.schema(f"{TILE}, batch long").parquet(f"{ledger}/tiles")


def landed(spark: SparkSession, ledger: str) -> DataFrame:
    """(path, bytes, width, height, xmin, ymax, res, batch) of the tiles that can be read."""
    return _tiles(spark, ledger).where("reason is null").drop("reason")


def quarantined(spark: SparkSession, ledger: str) -> DataFrame:
    """(path, bytes, reason, batch) of those that cannot."""
    return _tiles(spark, ledger).where("reason is not null").select("path", "bytes", "reason", "batch")
