"""Polygons, boxes, warps, mosaics, layouts and lines on small hand-made grids."""

import json
import random
from dataclasses import replace
from functools import partial

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import geodesy
from ridgeline.operators import focal, path, polygons, surface, warp
from ridgeline.sources import geo, tiles

SQUARE = [(1, 1), (7, 1), (7, 7), (1, 7), (1, 1)]
HOLE = [(3, 3), (5, 3), (5, 5), (3, 5), (3, 3)]
SMALL = [(10, 0.2), (11.9, 0.2), (11.9, 2.1), (10, 0.2)]


def cells(spark, height, width):
    return spark.range(height * width).selectExpr(f"int(id div {width}) as row", f"int(id % {width}) as col")


def parts(spark, *each):
    """A row for each polygon, given as parts of rings of (x, y); None is a polygon without a geometry."""
    return spark.createDataFrame([(p and [[[(float(x), float(y)) for x, y in ring] for ring in part] for part in p],) for p in each], f"parts {polygons.PARTS}")


def mask(d):
    return {(r["row"], r["col"]) for r in d.where("glacier").collect()}


def odd(rings, x, y):
    return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for r in rings for (ax, ay), (bx, by) in zip(r, r[1:])) % 2 == 1


def test_holes_stay_out_and_second_parts_are_burnt(spark):
    got = mask(polygons.polygon_mask(cells(spark, 9, 14), parts(spark, [[SQUARE, HOLE], [SMALL]], None, [[[]]])))
    assert got == {(r, c) for r in range(9) for c in range(14) if odd([SQUARE, HOLE], c + 0.5, r + 0.5) or odd([SMALL], c + 0.5, r + 0.5)}
    assert (1, 1) in got and (3, 3) not in got and (0, 11) in got


def test_masks_of_random_polygons(spark):
    g = random.Random(2)
    shapes = []
    for _ in range(12):
        at = g.uniform(-3, 22), g.uniform(-3, 22)
        ring = [(at[0] + g.uniform(-6, 6), at[1] + g.uniform(-6, 6)) for _ in range(g.randint(3, 9))]
        shapes.append([[[*ring, ring[0]]]])
    want = {(r, c) for r in range(20) for c in range(20) if any(odd(p, c + 0.5, r + 0.5) for s in shapes for p in s)}
    assert mask(polygons.polygon_mask(cells(spark, 20, 20), parts(spark, *shapes))) == want
    assert {tuple(r) for r in polygons.burnt(parts(spark, *shapes, *shapes), 20, 20, 7).collect()} == want  # twice is as once
    assert polygons.burnt(parts(spark, *shapes, *shapes), 20, 20, 7).count() == len(want)
    assert mask(polygons.polygon_mask(cells(spark, 3, 3), parts(spark, None))) == set()
    assert polygons.polygon_mask(cells(spark, 3, 3).limit(0), parts(spark, [[SQUARE]])).count() == 0


def test_polygon_files_say_what_they_cannot_hold(spark, tmp_path):
    feature = lambda kind, c: json.dumps({"properties": {"id": 1}, "geometry": {"type": kind, "coordinates": c}})
    ring = [[6.8, 45.8], [6.9, 45.8], [6.9, 45.9], [6.8, 45.8]]
    (tmp_path / "a.json").write_text("\n".join([feature("Polygon", [ring, ring]), feature("MultiPolygon", [[ring], [ring, ring]]), json.dumps({"properties": {"id": 2}, "geometry": None})]))
    got = geo.read_polygons(spark, str(tmp_path / "a.json"), "id bigint").collect()
    assert [r["parts"] and [len(p) for p in r["parts"]] for r in got] == [[2], [1, 2], None]
    (tmp_path / "b.json").write_text(feature("Point", [6.8, 45.8]))
    with pytest.raises(Exception, match="no polygon: Point"):
        geo.read_polygons(spark, str(tmp_path / "b.json"), "id bigint").collect()


@pytest.mark.parametrize(
    ("ring", "meets"),
    [
        ([(0, 0), (10, 0), (0, 10), (0, 0)], False),  # its extent covers the box, its area ends before
        ([(0, 0), (20, 0), (0, 20), (0, 0)], True),  # holds the box
        ([(7, 7), (7.5, 7), (7.5, 7.5), (7, 7)], True),  # lies in it
        ([(0, 6.5), (20, 6.6), (20, 6.7), (0, 6.5)], True),  # runs through it
        ([(8, 0), (9, 0), (8, 6), (8, 0)], True),  # touches a corner's side
        ([(20, 20), (21, 20), (21, 21), (20, 20)], False),
    ],
)
def test_boxes_are_met_exactly(spark, ring, meets):
    d = parts(spark, [[ring]], [[[(50, 50), (51, 50), (51, 51), (50, 50)]], [ring]])
    assert {r[0] for r in d.select(polygons.meets_box(F.col("parts"), 6, 6, 8, 8)).collect()} == {meets}
    assert geo.within(d, 6, 6, 8, 8).count() == 2 * meets


def test_box_in_a_hole_is_not_met(spark):
    d = parts(spark, [[[(0, 0), (20, 0), (20, 20), (0, 20), (0, 0)], [(4, 4), (10, 4), (10, 10), (4, 10), (4, 4)]]], None)
    assert [r[0] for r in d.select(polygons.meets_box(F.col("parts"), 6, 6, 8, 8)).collect()] == [False, False]


@pytest.mark.parametrize("tile", [3, 64])
def test_warps_keep_planes_and_leave_out_nodata(spark, tile):
    source, target = geodesy.Grid(100.0, 50.0, 1.0, 12, 10), geodesy.Grid(97.0, 52.0, 0.5, 40, 30)
    plane = spark.createDataFrame([(r, c, float(3 * c - 2 * r)) for r in range(10) for c in range(12) if (r, c) != (4, 5)] + [(4, 5, None)], "row int, col int, z double")
    got = {(r["row"], r["col"]): r["z"] for r in warp.warp(plane, source, target, lambda x, y: (x, y), tile).collect()}
    for (row, col), z in got.items():
        fr, fc = 50 - (52 - (row + 0.5) * 0.5) - 0.5, 97 + (col + 0.5) * 0.5 - 100 - 0.5
        if 0 <= fr <= 9 and 0 <= fc <= 11 and max(abs(fr - 4), abs(fc - 5)) >= 1:
            assert z == pytest.approx(3 * fc - 2 * fr)
    assert (4, 6) in got and (3, 6) not in got and (4, 5) not in got  # half a cell beyond the outer centres, no further
    assert len(got) == 24 * 20 and got[4, 6] == 0.0


def test_warp_follows_the_projection(spark):
    degrees, metres = geodesy.Grid(6.84, 45.92, 0.001, 40, 40), geodesy.Grid(998000.0, 6541500.0, 100.0, 20, 20)
    d = cells(spark, 40, 40).withColumn("z", 6.84 + (F.col("col") + 0.5) / 1000)  # the longitude itself
    got = warp.warp(d, degrees, metres, partial(geodesy.lambert93_inverse, f=geodesy.Arrays), 8)
    lon, _ = geodesy.lambert93_inverse(998050 + F.col("col") * 100.0, 6541450 - F.col("row") * 100.0)
    assert got.count() == 400 and got.where(F.abs(F.col("z") - lon) > 1e-9).count() == 0
    assert warp.warp(d.limit(0), degrees, metres, partial(geodesy.lambert93_inverse, f=geodesy.Arrays), 8).count() == 0


def test_mosaics_of_tiles_with_transforms_of_their_own(spark):
    t = spark.createDataFrame([("a", 1, 0.0, 10.0, 1.0, 2, 2, -9999.0), ("b", 0, 1.5, 10.0, 2.0, 1, 1, -1.0), ("c", 2, 8.0, 10.0, 1.0, 1, 1, None)], "tile string, rank int, xmin double, ymax double, res double, width int, height int, nodata double")
    z = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, 2.0), ("a", 1, 0, -9999.0), ("a", 1, 1, -1.0), ("b", 0, 0, 7.0), ("c", 0, 0, float("nan"))], "tile string, row int, col int, z double")
    got = lambda d, g: {(r["row"], r["col"]): r["z"] for r in warp.mosaic_tiles(t, d, g).collect()}
    grid = replace(warp.union_grid(t), res=1.0)
    assert (grid.xmin, grid.ymax) == (0.0, 10.0)
    grid = geodesy.Grid(0.0, 10.0, 1.0, 9, 2)
    assert got(z, grid) == {(0, 0): 1.0, (0, 1): 7.0, (0, 2): 7.0, (1, 1): 7.0, (1, 2): 7.0}
    assert got(z.replace(7.0, -1.0), grid) == {(0, 0): 1.0, (0, 1): 2.0, (1, 1): -1.0}  # -1 is nodata in b alone


def test_saved_layers_prune_and_join_without_a_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        g = cells(spark, 64, 64).withColumn("v", F.col("row") * 64.0 + F.col("col"))
        for name in ("a", "b", "c"):
            tiles.save_layer(g.withColumnRenamed("v", name), f"layer_{name}", name, 16, 4, f"{tmp_path}/{name}")
        d = tiles.aligned_layers(spark, {n: f"layer_{n}" for n in "abc"})
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and d.where("a = b and b = c").count() == 64 * 64
        w = tiles.window(spark, "layer_a", 20, 20, 5)
        assert "PartitionFilters: []" not in w._jdf.queryExecution().executedPlan().toString()
        assert w.count() == 121 and len(w.inputFiles()) > 0 and w.select(F.input_file_name()).distinct().count() <= 4 * 4
        assert {r[0] for r in w.select(F.regexp_extract(F.input_file_name(), r"tile_row=(\d+)", 1)).distinct().collect()} == {"0", "1"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("a", "b", "c"):
            spark.sql(f"DROP TABLE IF EXISTS layer_{name}")


def test_folder_layers_are_pruned_by_a_window(spark, tmp_path):
    geo.write_layer(cells(spark, 40, 40).withColumn("z", F.col("row") * 1.0), f"{tmp_path}/dem", "z", 10)
    w = focal.window_of(geo.read_layer(spark, f"{tmp_path}/dem", "z"), 15, 15, 3, 10)
    assert w.count() == 49 and w.select(F.input_file_name()).distinct().count() == 1


def test_path_goes_to_the_layers(spark):
    p = spark.createDataFrame([(0, 1, 1), (1, 2, 2), (2, 99, 99)], "seq int, row int, col int")
    layers = cells(spark, 50, 50).withColumn("z", F.col("row") * 1.0)
    d = path.gathered(p, layers, "z")
    assert [tuple(r) for r in d.orderBy("seq").select("seq", "z").collect()] == [(0, 1.0), (1, 2.0), (2, None)]
    assert "BroadcastHashJoin" in d._jdf.queryExecution().executedPlan().toString()
    assert path.gathered(p, layers, "z", most=1).orderBy("seq").collect() == d.orderBy("seq").collect()


def test_layers_are_kept_where_a_path_meets_them(spark):
    p = spark.createDataFrame([(0, 1, 1), (1, 2, 2), (2, 1, 1), (3, 99, 99)], "seq int, row int, col int")
    layers = cells(spark, 50, 50)
    d = path.met(p, layers)
    assert sorted((r["row"], r["col"]) for r in d.collect()) == [(1, 1), (2, 2)] == sorted((r["row"], r["col"]) for r in path.met(p, layers, most=1).collect())
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_repeated_cells_hide_no_gap(spark):
    rows = [(r, c, float(r + c)) for r in range(3) for c in range(5) if (r, c) != (1, 2)] + [(0, 0, -5.0)]
    d = focal.terrain(spark.createDataFrame(rows, "row int, col int, z double"), 1.0)
    got = {(r["row"], r["col"]): r["slope"] for r in d.collect()}
    assert len(got) == 15 and got[1, 1] is None and got[1, 3] is None and got[0, 0] is not None
    assert focal.dense(spark.createDataFrame(rows, "row int, col int, z double")).where("row = 0 and col = 0").first()["z"] == 0.0


def test_features_of_lines_and_tracks_keep_apart_and_in_order(spark, tmp_path):
    line = lambda name, c: {"properties": {"name": name}, "geometry": {"type": "LineString", "coordinates": c}}
    (tmp_path / "l.json").write_text(json.dumps({"features": [line("b", [[1, 2], [3, 4]]), line("a", [[5, 6]])]}))
    got = geo.read_line(spark, str(tmp_path / "l.json")).orderBy("feature", "seq").collect()
    assert [(r["name"], r["seq"], r["lon"]) for r in got] == [("b", 0, 1.0), ("b", 1, 3.0), ("a", 0, 5.0)] and len({r["feature"] for r in got}) == 2
    point = lambda k: f'<trkpt lat="{k}" lon="{k + 1}"><ele>{k}</ele></trkpt>'
    segments = "".join(f"<trkseg>{''.join(map(point, ks))}</trkseg>" for ks in ((3, 1), (2,)))
    (tmp_path / "t.gpx").write_text(f"<gpx><trk><name>x</name>{segments}</trk><trk><name>y</name><trkseg>{point(9)}</trkseg></trk></gpx>")
    got = geo.read_gpx(spark, str(tmp_path / "t.gpx")).orderBy("track", "seq").collect()
    assert [tuple(r)[1:5] for r in got] == [("x", 0, 0, 3.0), ("x", 0, 1, 1.0), ("x", 1, 2, 2.0), ("y", 0, 0, 9.0)]


def test_mosaic_of_one_grid_still_takes_the_first(spark):
    t = spark.createDataFrame([(1, 0, 0, 5.0), (0, 0, 0, 2.0)], "tile_rank int, row int, col int, z double")
    assert surface.mosaic(t).first()["z"] == 2.0
