"""Raster files as a Spark data source: a task reads some of a file's tiles, and filters on row and col choose which."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ridgeline.functions.geodesy import Grid
from ridgeline.functions.terrain import NODATA
from ridgeline.sources import tiff

FORMAT = "ridgeline_raster"
SUFFIXES = (".tif", ".tiff")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def raster_files(path: str) -> list[tuple[str, tiff.Header]]:
    """The raster file at a path, or those in a folder and below it, with their headers; sorted, and aligned with the first."""
    fs, root = opened(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    names = [root] if info.type == pafs.FileType.File else sorted(i.path for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.type == pafs.FileType.File and i.path.lower().endswith(SUFFIXES) and "/_" not in i.path[len(root) :])
    out = []
    for name in names:
        with fs.open_input_file(name) as f:
            out.append((name, tiff.read_header(f)))
    return out


def grid_of(files: list[tuple[str, tiff.Header]]) -> Grid:
    """The grid over all files, which share a resolution and whose corners lie whole cells apart."""
    if not files:
        raise ValueError("there is no raster file")
    hs = [h for _, h in files]
    res, xmin, ymax = hs[0].res, min(h.xmin for h in hs), max(h.ymax for h in hs)
    for name, h in files:
        apart = (h.xmin - xmin) / res, (ymax - h.ymax) / res
        if h.res != res or any(abs(a - round(a)) > 1e-6 for a in apart):
            raise ValueError(f"{name} is not aligned with the other files")
    right, low = max(h.xmin + h.width * res for h in hs), min(h.ymax - h.height * res for h in hs)
    nodata = next((h.nodata for h in hs if h.nodata is not None), NODATA)
    return Grid(xmin, ymax, res, round((right - xmin) / res), round((ymax - low) / res), nodata=nodata)


@dataclass
class Tiles(InputPartition):
    """Tiles of one file: (place in the file, bytes, number), and where the file lies in the grid."""

    path: str
    header: tiff.Header
    row: int
    col: int
    tiles: list[tuple[int, int, int]]


class RasterReader(DataSourceReader):
    def __init__(self, path: str, value: str, per_task: int) -> None:
        self.path, self.value, self.per_task = path, value, per_task
        self.window = {"row": [0, 1 << 62], "col": [0, 1 << 62]}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on row and col choose tiles; Spark still applies all filters to cells."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in self.window:
                w = self.window[column]
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    w[0] = max(w[0], int(f.value) + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    w[1] = min(w[1], int(f.value) - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[Tiles]:
        files = raster_files(self.path)
        grid, (r0, r1), (c0, c1) = grid_of(files), self.window["row"], self.window["col"]
        out = []
        for name, h in files:
            row, col = round((grid.ymax - h.ymax) / grid.res), round((h.xmin - grid.xmin) / grid.res)
            tiles = [(h.offsets[t], h.sizes[t], t) for t in h.tiles(r0 - row, r1 - row, c0 - col, c1 - col)]
            slim = tiff.Header(**{**h.__dict__, "offsets": (), "sizes": ()})
            out += [Tiles(name, slim, row, col, tiles[k : k + self.per_task]) for k in range(0, len(tiles), self.per_task)]
        return out

    def read(self, partition: Tiles) -> Iterator[pa.RecordBatch]:
        h = partition.header
        with opened(self.path)[0].open_input_file(partition.path) as f:
            for offset, size, number in partition.tiles:
                f.seek(offset)
                r, c, z = h.decoded(number, f.read(size))
                v = z.astype(float).ravel()
                row, col = (x.ravel().astype(np.int32) for x in np.mgrid[r : r + z.shape[0], c : c + z.shape[1]])
                null = np.isnan(v) | (v == (np.nan if h.nodata is None else h.nodata))
                yield pa.RecordBatch.from_arrays([pa.array(row + np.int32(partition.row)), pa.array(col + np.int32(partition.col)), pa.array(v, mask=null)], ["row", "col", self.value])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class RasterWriter(DataSourceArrowWriter):
    """Each task writes files of its own into a folder that readers pass over; commit moves those of tasks that succeeded."""

    def __init__(self, path: str, options: dict[str, str]) -> None:
        self.path, self.staging = path, f"_staging-{uuid.uuid4().hex}"
        self.grid = Grid(*(float(options[k]) for k in ("xmin", "ymax", "res")), int(options["width"]), int(options["height"]))
        self.side, self.kind, self.block = int(options["block"]), options["kind"], int(options.get("tile", 256))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        fs.create_dir(f"{root}/{self.staging}", recursive=True)
        nodata, files, key, z = (None if self.kind == "uint8" else self.grid.nodata), [], None, None

        def flush() -> None:
            if key is not None:
                r, c = (k * self.side for k in key)
                name = f"block-{key[0]}-{key[1]}-{uuid.uuid4().hex[:8]}.tif"
                with fs.open_output_stream(f"{root}/{self.staging}/{name}") as f:
                    f.write(tiff.encoded(z, self.grid.xmin + c * self.grid.res, self.grid.ymax - r * self.grid.res, self.grid.res, nodata, side=self.block))
                files.append(name)

        for b in iterator:
            row, col, v = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            br, bc = row // self.side, col // self.side
            cuts = np.flatnonzero(np.diff(br) | np.diff(bc)) + 1
            for at, to in zip([0, *cuts], [*cuts, len(row)], strict=True):
                if at < to:
                    if key != (here := (int(br[at]), int(bc[at]))):
                        flush()
                        key = here
                        shape = [min(self.side, n - k * self.side) for n, k in zip((self.grid.height, self.grid.width), key, strict=True)]
                        z = np.full(shape, 0 if nodata is None else nodata, np.dtype(self.kind).newbyteorder("<"))
                    x = v[at:to].astype(float)
                    z[row[at:to] - key[0] * self.side, col[at:to] - key[1] * self.side] = np.where(np.isnan(x), 0 if nodata is None else nodata, x)
        flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        for m in messages:
            for name in m.files if m else ():
                fs.move(f"{root}/{self.staging}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        if fs.get_file_info(f"{root}/{self.staging}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.staging}")


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"row int, col int, {self.options.get('value', 'z')} double"

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options["path"], schema.fieldNames()[2], int(self.options.get("tiles", 16)))

    def writer(self, schema, overwrite: bool) -> RasterWriter:
        return RasterWriter(self.options["path"], self.options)


def registered(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach it."""
    spark.dataSource.register(RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_raster(spark: SparkSession, path: str, value: str = "z", tiles: int = 16) -> DataFrame:
    """cell(row, col, value) of a raster file, or of all in a folder side by side; nodata and NaN are NULL.

    A task reads `tiles` tiles at most, by their place in the file; where row and col are bounded,
    only tiles with such cells are read. Files of one band, deflated or plain, in tiles or strips.
    """
    registered(spark)
    return spark.read.format(FORMAT).option("value", value).option("tiles", tiles).load(path)


def write_raster(cells: DataFrame, path: str, grid: Grid, value: str = "z", block: int = 1024, kind: str = "float32") -> None:
    """cells(row, col, value) as a folder of files of block x block cells, which read_raster() lays side by side.

    Values are float32 with the grid's nodata value, or with kind uint8 without one, where NULL is 0. A
    block without a cell has no file. A file is one task's work and becomes visible with all others.
    """
    registered(cells.sparkSession)
    at = lambda c: F.floor(F.col(c) / block)
    d = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias(value)).repartition(at("row"), at("col")).sortWithinPartitions(at("row"), at("col"))
    options = {"xmin": repr(float(grid.xmin)), "ymax": repr(float(grid.ymax)), "res": repr(float(grid.res)), "width": grid.width, "height": grid.height, "block": block, "kind": kind}
    d.write.format(FORMAT).mode("append").options(**options).save(path)
