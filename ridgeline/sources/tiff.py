"""Tags, tiles and compression of single-band GeoTIFF files, of which any part can be read by itself."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

#: Fixed values of the format: tag numbers, and type number -> struct code.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT, SCALE, TIEPOINT, GEOKEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
KINDS = {1: "u", 2: "i", 3: "f"}
NONE, DEFLATE, OLD_DEFLATE = 1, 8, 32946


@dataclass(frozen=True)
class Header:
    """What a file says of its one band; a strip counts as a tile of the whole width."""

    width: int
    height: int
    dtype: str
    compression: int
    predictor: int
    tile_width: int
    tile_height: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    xmin: float = 0.0
    ymax: float = 0.0
    res: float = 1.0
    nodata: float | None = None

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    def tiles(self, r0: int, r1: int, c0: int, c1: int) -> list[int]:
        """The tiles with a cell in these rows and columns, ends included."""
        r0, r1, c0, c1 = max(r0, 0), min(r1, self.height - 1), max(c0, 0), min(c1, self.width - 1)
        if r0 > r1 or c0 > c1:
            return []
        return [r * self.across + c for r in range(r0 // self.tile_height, r1 // self.tile_height + 1) for c in range(c0 // self.tile_width, c1 // self.tile_width + 1)]

    def decoded(self, tile: int, data: bytes) -> tuple[int, int, np.ndarray]:
        """(first row, first column, values) of a tile from its bytes, cut at the edge of the grid."""
        r, c = (x * n for x, n in zip(divmod(tile, self.across), (self.tile_height, self.tile_width), strict=True))
        item = np.dtype(self.dtype).itemsize
        if self.compression in (DEFLATE, OLD_DEFLATE):
            data = zlib.decompress(data)
        elif self.compression != NONE:
            raise ValueError(f"compression {self.compression} is not known")
        rows = len(data) // (self.tile_width * item)
        raw = np.frombuffer(data, np.uint8)[: rows * self.tile_width * item].reshape(rows, -1)
        if self.predictor == 3:  # of each row the bytes of one weight after those of the other, the greatest first, as differences
            planes = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(rows, item, self.tile_width)
            z = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{item}")[..., 0]
        else:
            z = raw.view(self.dtype)
            if self.predictor == 2:  # differences along rows, of the bits as whole numbers
                whole = np.dtype(self.dtype).str[0] + f"u{item}"
                z = np.cumsum(raw.view(whole), axis=1, dtype=f"u{item}").view(f"{z.dtype.str[1:]}")
            elif self.predictor != 1:
                raise ValueError(f"predictor {self.predictor} is not known")
        return r, c, z[: self.height - r, : self.width - c]


def read_header(f: BinaryIO) -> Header:
    """The header of a file, classic or big, of either byte order. Raises ValueError where it is none, or of a kind that is not known."""
    start = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    if order is None or len(start) < 8:
        raise ValueError("no TIFF file")
    version = struct.unpack_from(order + "H", start, 2)[0]
    if version not in (42, 43):
        raise ValueError("no TIFF file")
    big = version == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), start, 8 if big else 4)[0]
    entry, count, word = (20, "Q", 8) if big else (12, "H", 4)

    def bytes_at(offset: int, n: int) -> bytes:
        f.seek(offset)
        data = f.read(n)
        if len(data) < n:
            raise ValueError("the file ends too early")
        return data

    n = struct.unpack(order + count, bytes_at(at, struct.calcsize(order + count)))[0]
    table = bytes_at(at + struct.calcsize(order + count), n * entry)
    tags: dict[int, tuple] = {}
    for k in range(n):
        tag, kind, many = struct.unpack_from(order + ("HHQ" if big else "HHI"), table, k * entry)
        if kind in TYPES:
            code = order + TYPES[kind] * many if kind == 5 else f"{order}{many}{TYPES[kind] if kind != 2 else 's'}"
            size, where = struct.calcsize(code), k * entry + entry - word
            inline = table[where : where + size] if size <= word else bytes_at(struct.unpack_from(order + ("Q" if big else "I"), table, where)[0], size)
            tags[tag] = struct.unpack(code, inline)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, bits = one(WIDTH), one(HEIGHT), one(BITS, 1)
    tiled = TILES in tags
    offsets, sizes = tags.get(TILES if tiled else STRIPS), tags.get(TILE_SIZES if tiled else STRIP_SIZES)
    if not width or not height or offsets is None or sizes is None or len(offsets) != len(sizes):
        raise ValueError("the file does not say where its cells are")
    if one(SAMPLES, 1) != 1 or bits not in (8, 16, 32, 64) or one(FORMAT, 1) not in KINDS:
        raise ValueError("only files of one band of whole bytes are known")
    scale, tie, nodata = tags.get(SCALE, (1.0, 1.0)), tags.get(TIEPOINT, (0.0,) * 6), one(NODATA)
    if scale[0] != scale[1]:
        raise ValueError("cells are not square")
    text = (nodata or b"").split(b"\0")[0].strip()
    return Header(
        width, height, f"{order}{KINDS[one(FORMAT, 1)]}{bits // 8}", one(COMPRESSION, 1), one(PREDICTOR, 1), one(TILE_WIDTH) if tiled else width, one(TILE_HEIGHT) if tiled else min(one(STRIP_ROWS, height), height),
        offsets, sizes, tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[0], scale[0], float(text) if text else None,
    )


def encoded(z: np.ndarray, xmin: float, ymax: float, res: float, nodata: float | None, epsg: int = 2154, side: int = 256) -> bytes:
    """A little-endian file with one band: deflated tiles of side x side cells, rows as differences."""
    z = np.ascontiguousarray(z)
    height, width = z.shape
    down, across = -(-height // side), -(-width // side)
    padded = np.pad(z, ((0, down * side - height), (0, across * side - width)), mode="edge")
    whole, tiles = f"<u{z.itemsize}", []
    for r in range(down):
        for c in range(across):
            bits = np.ascontiguousarray(padded[r * side : (r + 1) * side, c * side : (c + 1) * side]).view(whole)
            tiles.append(zlib.compress(np.diff(bits, axis=1, prepend=np.zeros((side, 1), whole)).astype(whole).tobytes()))
    head = 8
    offsets = head + np.concatenate([[0], np.cumsum([len(t) for t in tiles])[:-1]]).astype(int)
    keys = (1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg)
    kind = {v: k for k, v in KINDS.items()}[z.dtype.kind]
    tags = [
        (WIDTH, "I", (width,)), (HEIGHT, "I", (height,)), (BITS, "H", (8 * z.itemsize,)), (COMPRESSION, "H", (DEFLATE,)), (PHOTOMETRIC, "H", (1,)), (SAMPLES, "H", (1,)), (PREDICTOR, "H", (2,)),
        (TILE_WIDTH, "I", (side,)), (TILE_HEIGHT, "I", (side,)), (TILES, "I", tuple(offsets.tolist())), (TILE_SIZES, "I", tuple(len(t) for t in tiles)), (FORMAT, "H", (kind,)),
        (SCALE, "d", (res, res, 0.0)), (TIEPOINT, "d", (0.0, 0.0, 0.0, xmin, ymax, 0.0)), (GEOKEYS, "H", keys),
    ]
    numbers, data = {v: k for k, v in TYPES.items()}, b"".join(tiles)
    directory = head + len(data) + len(data) % 2
    more, entries = b"", b""
    after = directory + 2 + 12 * (len(tags) + (nodata is not None)) + 4
    rows = [(t, numbers[code], len(v), struct.pack(f"<{len(v)}{code}", *v)) for t, code, v in tags]
    if nodata is not None:
        text = f"{nodata:g}".encode() + b"\0"
        rows.append((NODATA, 2, len(text), text))
    for tag, code, n, value in rows:
        if len(value) > 4:
            entries += struct.pack("<HHII", tag, code, n, after + len(more))
            more += value + b"\0" * (len(value) % 2)
        else:
            entries += struct.pack("<HHI", tag, code, n) + value.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, directory) + data + b"\0" * (len(data) % 2) + struct.pack("<H", len(rows)) + entries + b"\0" * 4 + more
