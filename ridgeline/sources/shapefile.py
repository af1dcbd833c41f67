"""Shapefiles of polygons as a Spark data source: a task reads a range of records, found by the index file."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ridgeline.functions.geodesy import lambert93
from ridgeline.operators.polygons import PARTS
from ridgeline.sources.raster import opened

FORMAT = "ridgeline_shapefile"
#: Fixed values of the format: types of a record, bytes of the files' headers and of an entry of the index.
NULL_SHAPE, POLYGONS, HEADER, ENTRY = 0, (5, 15, 25), 100, 8
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_PARTS = pa.list_(pa.list_(pa.list_(_POINT)))
ARROW = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

Ring = list[tuple[float, float]]


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    start: int
    length: int


def fields_of(header: bytes) -> list[Field]:
    """The columns of an attribute table, from its header."""
    out, at, start = [], 32, 1
    while at + 32 <= len(header) and header[at] != 0x0D:
        name, letter, length, decimals = header[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(header[at + 11]), header[at + 16], header[at + 17]
        kind = {"L": "boolean", "F": "double"}.get(letter, "string") if letter != "N" else "double" if decimals or length > 18 else "bigint"
        out.append(Field(name, kind, start, length))
        at, start = at + 32, start + length
    return out


def value_of(f: Field, raw: bytes, encoding: str) -> object:
    text = raw[f.start : f.start + f.length].decode(encoding, "replace").strip("\0 ")
    if f.kind == "string":
        return text or None
    if f.kind == "boolean":
        return {"t": True, "y": True, "f": False, "n": False}.get(text[:1].lower())
    try:
        return float(text) if f.kind == "double" else int(text)
    except ValueError:  # blanks or stars stand for no number
        return None


def _turn(ring: Ring) -> float:
    """Twice the area, positive if the ring runs clockwise."""
    return sum((bx - ax) * (by + ay) for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False))


def _holds(ring: Ring, x: float, y: float) -> bool:
    return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False)) % 2 == 1


def parts_of(rings: list[Ring]) -> list[list[Ring]]:
    """Clockwise rings begin parts; the others are holes of the smallest part around them, or parts if there is none."""
    parts = [[r] for r in rings if _turn(r) >= 0]
    for hole in (r for r in rings if _turn(r) < 0):
        around = [p for p in parts if _turn(p[0]) > 0 and _holds(p[0], *hole[0])]
        min(around, key=lambda p: _turn(p[0])).append(hole) if around else parts.append([hole])
    return parts


def polygon_of(content: bytes) -> list[list[Ring]] | None:
    """Parts of a record; None without a geometry. ValueError if it is broken or of another type."""
    try:
        kind = struct.unpack_from("<i", content)[0]
        if kind == NULL_SHAPE:
            return None
        if kind not in POLYGONS:
            raise ValueError(f"no polygon: type {kind}")
        n_rings, n_points = struct.unpack_from("<2i", content, 36)
        if n_rings < 0 or n_points < 0 or 44 + 4 * n_rings + 16 * n_points > len(content):
            raise ValueError("the record ends too early")
        starts = [*struct.unpack_from(f"<{n_rings}i", content, 44), n_points]
        flat = struct.unpack_from(f"<{2 * n_points}d", content, 44 + 4 * n_rings)
    except struct.error as e:
        raise ValueError("the record ends too early") from e
    if starts != sorted(starts) or starts[0] < 0:
        raise ValueError("rings are out of order")
    points = list(zip(flat[::2], flat[1::2], strict=True))
    return parts_of([points[a:b] for a, b in zip(starts, starts[1:], strict=False)])


@dataclass
class Records(InputPartition):
    first: int
    end: int


class ShapeReader(DataSourceReader):
    def __init__(self, path: str, fields: list[Field], header: tuple[int, int], encoding: str, per_task: int) -> None:
        self.path, self.fields, self.header, self.encoding, self.per_task = path, fields, header, encoding, per_task

    def partitions(self) -> list[Records]:
        fs, root = opened(self.path + ".shx")
        n = (fs.get_file_info(root).size - HEADER) // ENTRY
        return [Records(k, min(k + self.per_task, n)) for k in range(0, n, self.per_task)] or [Records(0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        fs, root = opened(self.path)
        start, size = self.header
        with fs.open_input_file(root + ".shx") as index, fs.open_input_file(root + ".shp") as shapes, fs.open_input_file(root + ".dbf") as table:
            index.seek(HEADER + ENTRY * partition.first)
            entries = index.read(ENTRY * (partition.end - partition.first))
            for lo in range(partition.first, partition.end, 256):
                rows = []
                for k in range(lo, min(lo + 256, partition.end)):
                    offset, words = struct.unpack_from(">2i", entries, ENTRY * (k - partition.first))
                    table.seek(start + size * k)
                    raw, parts, error = table.read(size), None, None
                    try:
                        shapes.seek(2 * offset)
                        if struct.unpack(">2i", shapes.read(8)) != (k + 1, words):
                            raise ValueError("the index does not fit the record")
                        parts = polygon_of(shapes.read(2 * words))
                    except (ValueError, OSError, struct.error) as e:
                        error = str(e) or "the record ends too early"
                    if len(raw) < size:
                        error = error or "no attributes"
                    if raw[:1] != b"*":  # deleted
                        shaped = parts and [[[{"x": x, "y": y} for x, y in ring] for ring in rings] for rings in parts]
                        rows.append((k, *[value_of(f, raw, self.encoding) for f in self.fields], shaped, error))
                if rows:
                    kinds = [pa.int64(), *[ARROW[f.kind] for f in self.fields], _PARTS, pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["record", *[f.name for f in self.fields], "parts", "error"])


class ShapeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _table(self) -> tuple[list[Field], tuple[int, int], str]:
        base = self.options["path"]
        fs, root = opened(base)
        with fs.open_input_file(root + ".dbf") as f:
            header = f.read(32)
            start, size = struct.unpack_from("<2H", header, 8)
            header += f.read(start - 32)
        encoding = "latin-1"
        if fs.get_file_info(root + ".cpg").type == pafs.FileType.File:
            with fs.open_input_file(root + ".cpg") as f:
                encoding = f.read().decode("ascii", "replace").strip() or encoding
        return fields_of(header), (start, size), encoding

    def schema(self) -> str:
        columns = ", ".join(f"`{f.name}` {f.kind}" for f in self._table()[0])
        return f"record bigint, {columns + ', ' if columns else ''}parts {PARTS}, error string"

    def reader(self, schema) -> ShapeReader:
        return ShapeReader(self.options["path"], *self._table(), int(self.options.get("records", 4096)))


def is_geographic(path: str) -> bool:
    """Whether coordinates are degrees, by the file's projection; without one they are."""
    fs, root = opened(path)
    if fs.get_file_info(root + ".prj").type != pafs.FileType.File:
        return True
    with fs.open_input_file(root + ".prj") as f:
        text = f.read().decode("utf-8", "replace").strip().upper()
    if text.startswith("PROJCS") and not ("LAMBERT" in text and "93" in text):
        raise ValueError(f"a coordinate system that is not known: {text[:60]}")
    return not text.startswith("PROJCS")


def read_shapefile(spark: SparkSession, path: str, records: int = 4096) -> DataFrame:
    """(record, attributes, parts, error) of a file of polygons, given without or with .shp; parts in Lambert-93, as read_polygons() has them.

    A task reads `records` records. Deleted records are left out; a record without a geometry has
    NULL parts; one that is broken has NULL parts, and error says why.
    """
    base = path.removesuffix(".shp")
    spark.dataSource.register(ShapeSource)
    d = spark.read.format(FORMAT).option("records", records).load(base)
    if not is_geographic(base):
        return d
    metres = lambda p: F.struct(*[v.alias(c) for c, v in zip("xy", lambert93(p["x"], p["y"]), strict=True)])
    return d.withColumn("parts", F.transform("parts", lambda rings: F.transform(rings, lambda r: F.transform(r, metres))))
