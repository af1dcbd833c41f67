"""Raster files and shapefiles made here and read back."""

import json
import struct
import zlib

import numpy as np
import pytest

from ridgeline.functions.geodesy import Grid
from ridgeline.sources import geo, raster, shapefile, tiff
from ridgeline.streaming import landing


def values(d):
    return {(r["row"], r["col"]): r["z"] for r in d.collect()}


def test_raster_files_round_trip(spark, tmp_path):
    grid = Grid(1000.0, 5000.0, 2.0, 700, 300)
    d = spark.range(700 * 300).selectExpr("int(id div 700) as row", "int(id % 700) as col", "case when id % 97 <> 0 then double(float(2000 + id / 7)) end as z").where("row < 250 or col > 300")
    raster.write_raster(d, f"{tmp_path}/dem", grid, block=256)
    back = raster.read_raster(spark, f"{tmp_path}/dem")
    want, got = values(d), values(back)
    assert {k: v for k, v in got.items() if v is not None} == {k: v for k, v in want.items() if v is not None}
    assert raster.grid_of(raster.raster_files(f"file://{tmp_path}/dem")) == grid
    assert not [p for p in (tmp_path / "dem").iterdir() if p.suffix != ".tif"]


def test_window_reads_its_tiles_alone(spark, tmp_path):
    z = np.arange(1024 * 1024, dtype="<f4").reshape(1024, 1024)
    (tmp_path / "a.tif").write_bytes(tiff.encoded(z, 0.0, 0.0, 1.0, -9999.0, side=128))
    d = raster.read_raster(spark, str(tmp_path / "a.tif"), tiles=1)
    window = d.where("row between 100 and 149 and col between 230 and 279")
    assert d.rdd.getNumPartitions() == 64 and window.rdd.getNumPartitions() == 4
    assert values(window) == {(r, c): float(z[r, c]) for r in range(100, 150) for c in range(230, 280)}
    assert d.where("row = 5 and col > 1023").rdd.getNumPartitions() <= 1


def test_masks_have_no_nodata(spark, tmp_path):
    d = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (1, 1, 0.0)], "row int, col int, z double")
    raster.write_raster(d, f"{tmp_path}/mask", Grid(0.0, 0.0, 1.0, 2, 2), kind="uint8")
    assert values(raster.read_raster(spark, f"{tmp_path}/mask")) == {(0, 0): 1.0, (0, 1): 0.0, (1, 0): 0.0, (1, 1): 0.0}


@pytest.mark.parametrize("order", ["<", ">"])
def test_strips_of_either_byte_order_and_the_float_predictor(spark, tmp_path, order):
    z = (np.random.default_rng(1).normal(size=(5, 7)) * 1000).astype("f4")
    rows = []
    for strip in (z[:3], z[3:]):
        planes = np.stack([np.frombuffer(np.ascontiguousarray(strip).astype(">f4").tobytes(), np.uint8).reshape(*strip.shape, 4)[..., k] for k in range(4)], axis=1).reshape(len(strip), -1)
        rows.append(zlib.compress(np.diff(planes, axis=1, prepend=np.zeros((len(strip), 1), np.uint8)).astype(np.uint8).tobytes()))
    data = b"".join(rows)
    shorts = [(256, 7), (257, 5), (258, 32), (259, 8), (277, 1), (278, 3), (317, 3), (339, 3)]
    at = 8 + len(data)
    longs = [(273, (8, 8 + len(rows[0]))), (279, tuple(map(len, rows)))]
    after = at + 2 + 12 * 10 + 4
    entries = {t: struct.pack(order + "HHIHH", t, 3, 1, v, 0) for t, v in shorts} | {t: struct.pack(order + "HHII", t, 4, 2, after + 8 * k) for k, (t, _) in enumerate(longs)}
    directory = struct.pack(order + "H", 10) + b"".join(entries[t] for t in sorted(entries)) + b"\0" * 4 + b"".join(struct.pack(order + "II", *v) for _, v in longs)
    (tmp_path / "s.tif").write_bytes((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + data + directory)
    assert values(raster.read_raster(spark, str(tmp_path / "s.tif"))) == {(r, c): float(z[r, c]) for r in range(5) for c in range(7)}


def test_what_is_no_raster_is_said(spark, tmp_path):
    (tmp_path / "x.tif").write_bytes(b"nothing of the kind")
    with pytest.raises(Exception, match="no TIFF file"):
        raster.read_raster(spark, str(tmp_path / "x.tif")).count()
    with pytest.raises(Exception, match="not aligned"):
        raster.grid_of([("a", tiff.read_header(__import__("io").BytesIO(tiff.encoded(np.zeros((2, 2), "f4"), x, 0.0, 1.0, None)))) for x in (0.0, 0.5)])


def ring(*points):
    return [*points, points[0]]


def write_shapefile(base, records, names, prj=None):
    """records: lists of rings (None: no geometry); names: an attribute of each."""
    contents = []
    for rings in records:
        if rings is None:
            contents.append(struct.pack("<i", 0))
            continue
        points = [p for r in rings for p in r]
        starts = [sum(len(r) for r in rings[:k]) for k in range(len(rings))]
        box = min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)
        contents.append(struct.pack(f"<i4d2i{len(starts)}i{2 * len(points)}d", 5, *box, len(rings), len(points), *starts, *[v for p in points for v in p]))
    shp, shx, at = b"", b"", 50
    for k, c in enumerate(contents):
        shp += struct.pack(">2i", k + 1, len(c) // 2) + c
        shx += struct.pack(">2i", at, len(c) // 2)
        at += 4 + len(c) // 2
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50).ljust(100, b"\0")
    base.with_suffix(".shp").write_bytes(head + shp)
    base.with_suffix(".shx").write_bytes(head + shx)
    field = lambda n, t, size, dec: n.encode().ljust(11, b"\0") + t.encode() + b"\0" * 4 + bytes([size, dec]) + b"\0" * 14
    fields = field("name", "C", 10, 0) + field("area_km2", "N", 8, 2) + field("id", "N", 6, 0) + b"\r"
    rows = b"".join((b"*" if n == "gone" else b" ") + (n or "").encode("latin-1").ljust(10) + (f"{k / 4:8.2f}".encode() if k else b" " * 8) + f"{k:6d}".encode() for k, n in enumerate(names))
    base.with_suffix(".dbf").write_bytes(struct.pack("<4BIHH", 3, 26, 1, 1, len(names), 32 + len(fields), 25).ljust(32, b"\0") + fields + rows)
    if prj:
        base.with_suffix(".prj").write_text(prj)


OUTER, HOLE = ring((6.8, 45.8), (6.8, 45.9), (6.9, 45.9), (6.9, 45.8)), ring((6.84, 45.84), (6.86, 45.84), (6.86, 45.86), (6.84, 45.86))
ISLE = ring((7.0, 45.8), (7.0, 45.81), (7.01, 45.8))


def test_shapefile_is_its_geojson_twin(spark, tmp_path):
    write_shapefile(tmp_path / "ice", [[OUTER, HOLE, ISLE], None, [ISLE], [ISLE]], ["Mer", "none", "gone", "é"], 'GEOGCS["WGS 84"]')
    feature = lambda n, c: json.dumps({"properties": {"name": n}, "geometry": c and {"type": "MultiPolygon", "coordinates": c}})
    (tmp_path / "twin.json").write_text("\n".join([feature("Mer", [[OUTER, HOLE], [ISLE]]), feature("none", None), feature("é", [[ISLE]])]))
    twin = {r["name"]: r["parts"] for r in geo.read_polygons(spark, str(tmp_path / "twin.json"), "name string").collect()}
    d = shapefile.read_shapefile(spark, str(tmp_path / "ice.shp"), records=1)
    assert d.rdd.getNumPartitions() == 4
    got = {r["name"]: r for r in d.collect()}
    assert {n: r["parts"] for n, r in got.items()} == twin and all(r["error"] is None for r in got.values())
    assert (got["Mer"]["area_km2"], got["é"]["area_km2"], got["é"]["id"], got["é"]["record"]) == (None, 0.75, 3, 3)


def test_broken_records_are_reported(spark, tmp_path):
    write_shapefile(tmp_path / "ice", [[OUTER], [OUTER, HOLE], [ISLE]], ["a", "b", "c"], 'PROJCS["RGF93 / Lambert-93"]')
    raw = bytearray((tmp_path / "ice.shp").read_bytes())
    first = struct.unpack_from(">i", raw, 104)[0] * 2
    struct.pack_into("<i", raw, 100 + 8 + first + 8 + 36, 999_999)  # more rings than there is room for
    (tmp_path / "ice.shp").write_bytes(raw[:-10])
    got = {r["name"]: r for r in shapefile.read_shapefile(spark, str(tmp_path / "ice")).collect()}
    assert [p["x"] for p in got["a"]["parts"][0][0]] == [p[0] for p in OUTER] and got["a"]["error"] is None
    assert got["b"]["parts"] is None and "too early" in got["b"]["error"] and got["c"]["parts"] is None and got["c"]["error"]
    (tmp_path / "ice.prj").write_text('PROJCS["WGS 84 / UTM zone 32N"]')
    with pytest.raises(ValueError, match="not known"):
        shapefile.read_shapefile(spark, str(tmp_path / "ice"))


def test_tiles_land_once_and_bad_ones_are_set_aside(spark, tmp_path):
    whole = tiff.encoded(np.zeros((40, 30), "f4"), 5.0, 9.0, 1.0, -9999.0, side=16)
    incoming, ledger = tmp_path / "in", f"{tmp_path}/ledger"
    incoming.mkdir()
    (incoming / "a.tif").write_bytes(whole)
    (incoming / "b.tif").write_bytes(whole[: len(whole) // 2])
    (incoming / "c.txt").write_text("no tile")
    names = lambda d: {r["path"].rsplit("/", 1)[1] for r in d.collect()}
    landing.land_tiles(spark, str(incoming), ledger)
    assert names(landing.landed(spark, ledger)) == {"a.tif"} and names(landing.quarantined(spark, ledger)) == {"b.tif"}
    (incoming / "d.tif").write_bytes(whole)
    (incoming / "e.tif").write_bytes(whole.replace(whole[8:40], bytes(32)))
    landing.land_tiles(spark, str(incoming), ledger)
    landing.land_tiles(spark, str(incoming), ledger)
    assert sorted((r["path"].rsplit("/", 1)[1], r["batch"], r["width"], r["height"], r["xmin"]) for r in landing.landed(spark, ledger).collect()) == [("a.tif", 0, 30, 40, 5.0), ("d.tif", 1, 30, 40, 5.0)]
    assert names(landing.quarantined(spark, ledger)) == {"b.tif", "e.tif"} and landing.quarantined(spark, ledger).where("reason = ''").count() == 0
