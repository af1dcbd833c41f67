"""Stencils, thresholds, paths and routes on small hand-made grids, and the projections."""

import heapq
import json
import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import catalog
from ridgeline.functions import geodesy, terrain
from ridgeline.operators import focal, path, routing, surface
from ridgeline.sources import geo

SF = "/root/testdata/sf0.001"


def grid(spark, f, n=5):
    return spark.createDataFrame([(r, c, f(r, c)) for r in range(n) for c in range(n)], "row int, col int, z double")


@pytest.mark.parametrize(("f", "aspect"), [(lambda r, c: -float(r), 180.0), (lambda r, c: float(c), 270.0), (lambda r, c: float(r), 0.0), (lambda r, c: -float(c), 90.0)])
def test_planes_face_downhill(spark, f, aspect):
    d = focal.terrain(grid(spark, f), 1.0).where("row = 2 and col = 2").first()
    assert d["slope"] == pytest.approx(45) and d["aspect"] % 360 == pytest.approx(aspect)


def test_flat_and_nodata(spark):
    assert focal.terrain(grid(spark, lambda r, c: 7.0), 1.0).where("slope <> 0 or aspect is not null or roughness <> 0").count() == 0
    assert focal.dilated_nodata(grid(spark, lambda r, c: None if (r, c) == (2, 2) else 1.0)).where("nodata").count() == 9
    assert focal.dilated_nodata(grid(spark, lambda r, c: None if (r, c) == (0, 0) else 1.0)).where("nodata").count() == 4


def test_thresholds(spark):
    d = spark.createDataFrame([(45.0,), (45.0001,), (60.0,), (60.0001,), (None,)], "s double").select(terrain.slope_cost(F.col("s")).alias("c"), terrain.glacier_cost(F.lit(True), F.col("s")).alias("g"))
    a, b, c, e, n = [r["c"] for r in d.collect()]
    assert b / a == pytest.approx(5, rel=1e-3) and e / c == pytest.approx(50) and n is None


def test_lambert_goes_there_and_back(spark):
    x, y = geodesy.lambert93(F.lit(6.88), F.lit(45.9))
    d = spark.range(1).select(x.alias("x"), y.alias("y"))
    lon, lat = geodesy.lambert93_inverse(F.col("x"), F.col("y"))
    back = d.select(lon.alias("lon"), lat.alias("lat")).first()
    assert back["lon"] == pytest.approx(6.88, abs=1e-9) and back["lat"] == pytest.approx(45.9, abs=1e-9)


def test_mosaic_takes_the_first_valid(spark):
    t = spark.createDataFrame([(0, 0, 0, None), (1, 0, 0, 5.0), (0, 0, 1, 1.0), (1, 0, 1, 2.0), (0, 0, 2, None)], "tile_rank int, row int, col int, z double")
    assert {(r["col"], r["z"]) for r in surface.mosaic(t).collect()} == {(0, 5.0), (1, 1.0), (2, None)}


def test_empty_levels_are_reported(spark):
    d = surface.histogram(spark.createDataFrame([(1.0,), (200.0,)], "v double"), "v").orderBy("bucket")
    assert [r["n"] for r in d.collect()] == [1, 0, 0, 0, 1]


def test_route_crosses_tiles_and_stops_at_walls(spark):
    cells = spark.createDataFrame([(r, c, 1.0) for r in range(7) for c in range(7)], "row int, col int, cost double")
    far = {(r["row"], r["col"]): r["d"] for r in routing.cost_distance(cells, [(0, 0)], tile=3).collect()}
    assert all(far[r, c] == pytest.approx(max(r, c) - min(r, c) + math.sqrt(2) * min(r, c)) for r, c in far)
    wall = cells.withColumn("cost", F.when(F.col("col") != 3, F.col("cost")))
    assert routing.route(wall, (0, 0), (6, 6), tile=3).count() == 0
    line = [(r["row"], r["col"]) for r in routing.route(cells, (0, 0), (6, 6), tile=3).orderBy("seq").collect()]
    assert line == [(i, i) for i in range(7)]


@pytest.mark.parametrize("free", [1.0, 0.0])
def test_a_route_is_one_path_where_costs_tie(spark, free):
    """Many paths cost the same, with free cells also in circles: still each cell is a neighbour of the one before, once."""
    cells = spark.createDataFrame([(r, c, free if 0 < r < 6 else 1.0) for r in range(7) for c in range(7)], "row int, col int, cost double")
    cost = {(r["row"], r["col"]): r["cost"] for r in cells.collect()}
    line = [(r["seq"], r["row"], r["col"], r["d"]) for r in routing.route(cells, (0, 0), (3, 6), tile=3).orderBy("seq").collect()]
    assert [x[0] for x in line] == list(range(len(line))) and line[0][1:3] == (0, 0) and line[-1][1:3] == (3, 6)
    steps = [(math.hypot(a[1] - b[1], a[2] - b[2]), (cost[a[1:3]] + cost[b[1:3]]) / 2) for a, b in zip(line, line[1:])]
    assert all(length < 1.5 for length, _ in steps) and sum(x * w for x, w in steps) == pytest.approx(line[-1][3])
    assert len(set(line)) == len(line)


def test_a_missing_cell_is_nodata(spark):
    g = grid(spark, lambda r, c: float(r))
    gap = focal.terrain(g.where("not (row = 2 and col = 2)"), 1.0)
    whole = focal.terrain(g.withColumn("z", F.when(~((F.col("row") == 2) & (F.col("col") == 2)), F.col("z"))), 1.0)
    rows = lambda d: sorted(map(repr, d.select("row", "col", "slope", "nodata").collect()))
    assert rows(gap) == rows(whole) and gap.where("nodata").count() == 9


def test_percentiles_of_ties_and_nulls(spark):
    rows = [("a", 1.0)] * 5 + [("a", 2.0), ("a", None), ("b", None), ("c", 7.0)]
    got = {r["layer"]: (r["q0"], r["q1"]) for r in surface.percentiles(spark.createDataFrame(rows, "layer string, v double"), (0.5, 0.9)).collect()}
    assert got == {"a": (1.0, pytest.approx(1.5)), "c": (7.0, 7.0)}


def farthest(points, tolerance):
    """Douglas and Peucker, by recursion."""
    if len(points) < 3:
        return points
    (ax, ay), (bx, by) = points[0][1:], points[-1][1:]
    length = math.hypot(bx - ax, by - ay)
    far = [abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / length if length else math.hypot(x - ax, y - ay) for _, x, y in points]
    k = max(range(1, len(points) - 1), key=lambda i: (far[i], -i))
    return farthest(points[: k + 1], tolerance)[:-1] + farthest(points[k:], tolerance) if far[k] > tolerance else [points[0], points[-1]]


def test_simplified_lines(spark):
    rng = random.Random(5)
    lines = {p: [(i, float(i), rng.uniform(0, 30)) for i in range(n)] for p, n in ((1, 60), (2, 1), (3, 2), (4, 25))}
    lines[5] = [(0, 0.0, 0.0), (1, 9.0, 9.0), (2, 0.0, 0.0)]
    d = spark.createDataFrame([(p, *v) for p, vs in lines.items() for v in vs], "path long, seq int, x double, y double")
    assert sorted(map(tuple, path.simplify(d, 5.0).collect())) == sorted((p, *v) for p, vs in lines.items() for v in farthest(vs, 5.0))
    assert path.simplify(d.limit(0)).count() == 0


def test_checks_of_a_route(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, 1.0), (1, 1, 1, 1, math.inf), (1, 2, 3, 1, 1.0)], "path int, seq int, row int, col int, cost double")
    stats = path.statistics(path.segments(cells.withColumns({"x": F.col("col") * 1000.0, "y": F.col("row") * 1000.0, "z": F.col("row") * 400.0})), cost="cost")
    got = path.grid_checks(cells, stats, (0, 0), (3, 2)).first().asDict()
    assert got == {"path": 1, "not_empty": True, "starts": True, "ends": False, "continuous": False, "n_impassable": 1, "plausible_length": True, "plausible_climb": True}


def test_heights_in_degrees(spark):
    p = spark.createDataFrame([(1, 1, 1004644.0, 6539230.0, 2512.04), (1, 0, 1004653.0, 6539227.0, 2500.0)], "path int, seq int, x double, y double, z double")
    stats = path.statistics(path.segments(p).withColumn("cost", F.lit(1.0)), cost="cost")
    j = json.loads(path.geojson_3d(p, stats, "a", 1.0).first()["json"])
    assert j["type"] == "FeatureCollection" and j["features"][0]["properties"]["elev_max"] == 2512
    lon, lat, z = j["features"][0]["geometry"]["coordinates"][1]
    x, y = geodesy.lambert93(F.lit(lon), F.lit(lat))
    back = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert z == 2512.0 and back["x"] == pytest.approx(1004644, abs=0.02) and back["y"] == pytest.approx(6539230, abs=0.02)


def test_optional_mask_and_alignment(spark, tmp_path):
    a, b = grid(spark, lambda r, c: 1.0, 3), grid(spark, lambda r, c: 2.0, 2).withColumnRenamed("z", "slope")
    assert geo.read_mask(spark, f"{tmp_path}/none") is None
    d = surface.aligned({"z": a, "slope": b}, geo.read_mask(spark, f"{tmp_path}/none"))
    assert d.count() == 4 and d.where("glacier").count() == 0
    geo.write_mask(b.select("row", "col", (F.col("row") == 0).alias("glacier")), f"{tmp_path}/mask")
    assert surface.aligned({"z": a, "slope": b}, geo.read_mask(spark, f"{tmp_path}/mask")).where("glacier").count() == 2


def test_sources_in_order(spark, tmp_path):
    some = spark.range(1)
    assert geo.first_available(None, some.limit(0), some) is some
    with pytest.raises(ValueError):
        geo.first_available(None)
    for name in ("b/two.json", "b/one.json", "c/other.txt"):
        (Path(tmp_path) / name).parent.mkdir(exist_ok=True)
        (Path(tmp_path) / name).write_text('{"features":[{"properties":{"name":"t","url":"http://t","bbox":"0,0,1,1"}}]}')
    assert geo.first_file(spark, str(tmp_path), ".json").endswith("b/one.json")
    with pytest.raises(ValueError):
        geo.first_file(spark, str(tmp_path), ".shp")
    assert tuple(geo.read_catalogue(spark, f"{tmp_path}/b/one.json").first()) == ("t", "http://t", "0,0,1,1")


def test_tile_request(spark):
    rows = [("http://h/p?a=1&WIDTH=5&a=2", "0,0,100,50"), ("http://h/p?width=5", None), ("", "0,0,1,1"), (None, None)]
    d = spark.createDataFrame(rows, "url string, box string")
    got = [r[0] and tuple(r[0]) for r in d.select(geo.tile_request(F.col("url"), F.col("box"), 2.0)).collect()]
    assert got == [("http://h/p?a=1&WIDTH=50&HEIGHT=25", 50, 25), ("http://h/p?width=5&WIDTH=500&HEIGHT=500", 500, 500), None, None]


def dijkstra(cost, start):
    d, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        x, k = heapq.heappop(heap)
        if x > d[k]:
            continue
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                n = k[0] + i, k[1] + j
                if (i or j) and math.isfinite(cost.get(n, math.inf)):
                    y = x + math.hypot(i, j) * (cost[k] + cost[n]) / 2
                    if y < d.get(n, math.inf):
                        d[n] = y
                        heapq.heappush(heap, (y, n))
    return d


def test_route_to_a_goal_leaves_far_tiles_alone(spark):
    g = random.Random(4)
    cost = {(r, c): math.inf if g.random() < 0.1 else g.uniform(1, 3) for r in range(24) for c in range(24)} | {(0, 0): 1.0, (4, 5): 1.0, (23, 22): 2.0}
    del cost[10, 10]
    cells = spark.createDataFrame([(*k, w) for k, w in cost.items()], "row int, col int, cost double")
    want = dijkstra(cost, (0, 0))
    far = {(r["row"], r["col"]): r["d"] for r in routing.cost_distance(cells, [(0, 0)], tile=6).collect()}
    assert far.keys() == cost.keys() and all(far[k] == pytest.approx(want.get(k, math.inf)) for k in cost)
    for end in ((4, 5),):
        line = routing.route(cells, (0, 0), end, tile=6).orderBy("seq").collect()
        assert (line[0]["row"], line[0]["col"]) == (0, 0) and (line[-1]["row"], line[-1]["col"]) == end and line[-1]["d"] == pytest.approx(want[end])
        assert all(max(abs(a["row"] - b["row"]), abs(a["col"] - b["col"])) == 1 for a, b in zip(line, line[1:]))
    touched = lambda goal: sum(np.isfinite(np.frombuffer(r["d"]).reshape(8, 8)[1:-1, 1:-1]).any() for r in routing._fields(cells, [(0, 0)], 6, goal).collect())
    assert touched((4, 5)) <= 4 < routing._blocks(cells, [(0, 0)], 6).count() == 16  # and none beyond the grid


def test_a_ribbon_is_crossed_in_few_rounds(spark):
    """A grid narrower than a tile: tiles as long as their cells allow, and few jobs a round."""
    g = random.Random(7)
    cost = {(r, c): g.uniform(1, 6) for r in range(240) for c in range(4)}
    cells = spark.createDataFrame([(*k, w) for k, w in cost.items()], "row int, col int, cost double")
    want = dijkstra(cost, (0, 0))
    spark.sparkContext.setJobGroup("ribbon", "")
    line = routing.route(cells, (0, 0), (239, 3), tile=12).orderBy("seq").collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("ribbon"))
    spark.sparkContext.setJobGroup("other", "")
    assert [r["seq"] for r in line] == list(range(len(line))) and all(r["d"] == pytest.approx(want[r["row"], r["col"]]) for r in line) and (line[-1]["row"], line[-1]["col"]) == (239, 3)
    assert all(max(abs(a["row"] - b["row"]), abs(a["col"] - b["col"])) == 1 for a, b in zip(line, line[1:]))
    assert jobs < 100


@pytest.mark.parametrize("free", [0.0, 1.0])
def test_searching_a_tile_finds_fewest_steps_among_equals(free):
    """Costs of which many paths have the same sum, also none; the width of what is taken at once changes nothing."""
    g = random.Random(3)
    cost = np.array([[g.choice((free, 1.0, 2.0)) for _ in range(9)] for _ in range(30)])
    near = np.array([i * 11 + j for i, j, _ in routing.STEPS])
    flat = np.pad(np.pad(cost, 1, constant_values=np.nan).ravel(), 12, constant_values=np.nan)
    edges = np.stack([length * (flat + np.roll(flat, -o)) / 2 for o, (_, _, length) in zip(near, routing.STEPS)], axis=1)
    best, first = {}, 12 + 11 + 1
    heap = [(0.0, 0, first)]
    while heap:
        x, s, k = heapq.heappop(heap)
        if k not in best:
            best[k] = (x, s)
            for o, w in zip(near.tolist(), edges[k]):
                if w == w:
                    heapq.heappush(heap, (x + w, s + 1, k + o))
    for width in (0.0, 1.0, 50.0):
        d, hops = np.full(len(flat), math.inf), np.full(len(flat), 1 << 30, np.int32)
        d[first], hops[first] = 0.0, 0
        routing._settle(d, hops, edges, near, np.array([first]), width)
        assert {int(k): (d[k], hops[k]) for k in np.flatnonzero(np.isfinite(d))} == best


def test_least_cost_of_one_cell(spark):
    """As the whole field has it, across tiles and where no way leads; a cell that is missing has no row."""
    g = random.Random(5)
    cost = {(r, c): math.inf if c == 4 and r != 20 or r == 27 else g.uniform(1, 3) for r in range(30) for c in range(8)}
    cells = spark.createDataFrame([(*k, w) for k, w in cost.items()], "row int, col int, cost double")
    want = dijkstra(cost, (0, 0))
    for end in ((0, 7), (29, 7), (30, 0)):
        got = [tuple(r) for r in routing.least_cost(cells, (0, 0), end, tile=8).collect()]
        assert got == ([(*end, pytest.approx(want.get(end, math.inf)))] if end in cost else [])


@pytest.mark.parametrize("name", ["route_report"])
def test_jobs_do_not_grow_with_the_rows_of_a_grid(spark, name):
    """1500 rows of 100 cells are one tile."""
    spark.sparkContext.setJobGroup(name, "")
    found = catalog.queries()[name](spark, "/root/testdata/sf0.1").collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setJobGroup("other", "")
    assert len(found) == 1 and found[0]["n_pixels"] >= 1500 and jobs < 60


def test_distances_along_a_ribbon_take_few_jobs(spark):
    cells = spark.createDataFrame([(r, c, 1.0) for r in range(240) for c in range(4)], "row int, col int, cost double")
    spark.sparkContext.setJobGroup("distances", "")
    far = routing.cost_distance(cells, [(0, 0)], tile=12).agg(F.max("d")).first()[0]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("distances"))
    spark.sparkContext.setJobGroup("other", "")
    assert far == pytest.approx(236 + 3 * math.sqrt(2)) and jobs < 50


def test_single_point_path(spark):
    p = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0)], "path long, seq int, x double, y double, z double")
    s = path.statistics(path.segments(p)).first()
    assert (s["dist_2d_m"], s["max_step"], s["glacier_pct"], s["elev_start"]) == (0, 0, -1, 5)


def test_halves_are_judged_as_sql_does(spark):
    """Values on a tie and next to one, among them those whose decimal text is no tie while their tenfold is."""
    values = [y for k in range(400) for x in (k / 10 + 100.05, k / 100 + 7.005, k + 0.5) for y in (x, math.nextafter(x, 0), math.nextafter(x, math.inf))]
    con = duckdb.connect()
    want = [con.execute("SELECT round_even(?::DOUBLE, 0), round_even(?::DOUBLE, 1), round_even(?::DOUBLE, 2)", [x] * 3).fetchone() for x in values]
    d = spark.createDataFrame([(x,) for x in values], "x double").select(*[path.half_even("x", n).alias(f"d{n}") for n in range(3)])
    assert [tuple(r) for r in d.collect()] == want


def test_exported_properties_are_rounded_as_sql_does(spark):
    cost = math.nextafter(112.05, math.inf)
    p = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0, cost)], "path long, seq int, x double, y double, z double, cost double")
    j = json.loads(path.geojson(p, path.statistics(path.segments(p), cost="cost"), "a", 1.0).first()["json"])
    assert j["features"][0]["properties"]["cost_total"] == duckdb.connect().execute("SELECT round_even(?::DOUBLE, 1)", [cost]).fetchone()[0] == 112.0


def test_layers_and_tracks_round_trip(spark, tmp_path):
    g = grid(spark, lambda r, c: None if r == 1 else float(r + c))
    geo.write_layer(g, f"{tmp_path}/dem", "z", 2)
    assert geo.is_cached(spark, f"{tmp_path}/dem", "z") and not geo.is_cached(spark, f"{tmp_path}/none", "z")
    assert sorted(map(tuple, geo.read_layer(spark, f"{tmp_path}/dem", "z").select("row", "col", "z").collect()), key=lambda r: r[:2]) == [tuple(r) for r in g.collect()]
    points = [(1, k, 45.0 + k / 10, 6.2, 1000.0 + k) for k in range(5)]
    geo.write_gpx(spark.createDataFrame(points[::-1], "path long, seq int, lat double, lon double, ele double"), f"{tmp_path}/gpx")
    assert [tuple(r)[3:] for r in geo.read_gpx(spark, f"{tmp_path}/gpx").orderBy("track", "seq").collect()] == [p[1:] for p in points]
    (Path(tmp_path) / "l.json").write_text('{"features":[{"properties":{"name":"a"},"geometry":{"type":"LineString","coordinates":[[1,2,3],[4,5]]}}]}')
    assert [tuple(r) for r in geo.read_line(spark, f"{tmp_path}/l.json").orderBy("seq").select("seq", "lon", "lat", "z").collect()] == [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, None)]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, name):
    """Each query against its SQL; the values are rounded on both sides."""
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "supplier", "events", "pages", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    d = catalog.queries()[name](spark, SF)
    cols = sorted(d.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted(repr(tuple(float(v) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)) for r in rows)
    assert plain(tuple(r) for r in d.select(*cols).collect()) == plain([tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in want])
