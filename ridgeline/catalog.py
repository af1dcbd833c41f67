"""The registered queries and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial, reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import geodesy, terrain
from ridgeline.functions.session import scratch, written
from ridgeline.operators import focal, path, polygons, routing, surface, warp
from ridgeline.plans import inputs
from ridgeline.sources import geo, raster, tiles
from ridgeline.streaming import factors, landing

Query = Callable[[SparkSession, str], DataFrame]


def r(c: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _stencil(column: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = focal.terrain(inputs.grid(spark, sf_dir, holes=True), inputs.RES)
        corner = F.col("row").isin(0) & F.col("col").isin(0, inputs.WIDTH - 1)
        d = d.where(~corner) if column == "aspect" else d
        return d.select("row", "col", r(column).alias(column))

    return run


def _factor(name: str, f: Callable[[], Column], digits: int = 4) -> Query:
    return lambda spark, sf_dir: inputs.layers(spark, sf_dir).select("key", r(f(), digits).alias(name))


def nodata_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return focal.dilated_nodata(inputs.grid(spark, sf_dir, holes=True)).select("row", "col", "nodata")


def cost_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = surface.cost_surface(inputs.layers(spark, sf_dir))
    return d.select("key", r("cost", 2).alias("cost"), r(terrain.routing_cost(F.col("cost")), 2).alias("routing_cost"))


def cost_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid, Horn's slope, slope cost, five levels."""
    d = focal.terrain(inputs.grid(spark, sf_dir), inputs.RES).withColumn("cost", terrain.slope_cost(F.round("slope", 6)))
    return surface.histogram(d, "cost").select("bucket", "n", r("pct").alias("pct"))


def layer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = surface.layer_statistics(inputs.layers(spark, sf_dir), ("slope", "aspect", "roughness"), {"slope": 80.0, "aspect": 360.0, "roughness": 5.0})
    rules = spark.createDataFrame([("slope", 0.0, 90.0, 75.0), ("aspect", 0.0, 360.0, 360.0), ("roughness", 0.0, 25.0, 5.0)], "layer string, at_least double, at_most double, median_at_most double")
    d = d.join(F.broadcast(rules), "layer").withColumn("ok", F.col("lo").between(F.col("at_least"), F.col("at_most")) & (F.col("hi") <= F.col("at_most")) & (F.col("median") <= F.col("median_at_most")))
    return d.select("layer", "n", *[r(c).alias(c) for c in ("nodata_pct", "lo", "hi", "mean", "median", "p95", "p99", "p999", "extreme_pct")], "n_extreme", "ok")


def factor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = surface.layer_statistics(surface.cost_surface(inputs.layers(spark, sf_dir)), surface.FACTORS)
    return d.select("layer", "n", r("median").alias("median"), r("hi", 2).alias("hi"))


def log_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = surface.cost_surface(inputs.layers(spark, sf_dir)).withColumn("cost", F.round("cost", 6))
    return surface.log_histogram(d, "cost")


def glacier_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.layers(spark, sf_dir)
    pct = 100.0 * F.col("n_glacier") / F.col("n")
    return d.agg(F.count_if("glacier").alias("n_glacier"), F.count("*").alias("n")).select("n_glacier", r(pct).alias("pct"), r(F.col("n_glacier") * inputs.RES * inputs.RES / 1e6, 6).alias("km2"), (pct < 1).alias("too_small"), (pct > 50).alias("too_large"))


def dem_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.grid(spark, sf_dir, holes=True)
    share = 100.0 * F.count_if(F.col("z").isNull()) / F.count("*")
    return d.agg(F.count("z").alias("n_valid"), r(share).alias("nodata_pct"), r(F.min("z")).alias("lo"), r(F.max("z")).alias("hi"), (F.max("z") < 3000).alias("low_top"), (F.min("z") < 0).alias("below_sea"), (share > 50).alias("sparse"), F.lit(inputs.RES > 10).alias("coarse"))


def bad_value_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), r(terrain.clean(F.col("c_acctbal").cast("double") - 0), 2).alias("z"))
    return d


def project_l93(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geodesy.lambert93(F.col("lon"), F.col("lat"))
    return inputs.points(spark, sf_dir).select("key", r(x, 3).alias("x"), r(y, 3).alias("y"))


def world_to_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geodesy.lambert93(F.col("lon"), F.col("lat"))
    row, col = geodesy.to_pixel(x, y, inputs.XMIN, inputs.YMAX, 1.0)
    d = inputs.points(spark, sf_dir).select("key", row.alias("row"), col.alias("col"))
    return d.withColumn("in_grid", F.col("row").between(0, 5999) & F.col("col").between(0, 5999))


def pixel_to_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geodesy.to_world(F.col("row"), F.col("col"), inputs.XMIN, inputs.YMAX, inputs.RES)
    return inputs.grid(spark, sf_dir).select("row", "col", x.alias("x"), y.alias("y"))


def l93_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There and back: the degrees that went in."""
    x, y = geodesy.lambert93(F.col("lon"), F.col("lat"))
    d = inputs.points(spark, sf_dir).select("key", x.alias("x"), y.alias("y"))
    lon, lat = geodesy.lambert93_inverse(F.col("x"), F.col("y"))
    return d.select("key", r(lon, 7).alias("lon"), r(lat, 7).alias("lat"))


def mercator_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.grid(spark, sf_dir).select("row", "col", (760000.0 + F.col("col")).alias("x"), (5750000.0 - F.col("row")).alias("y"))
    lon, lat = geodesy.mercator_inverse(F.col("x"), F.col("y"))
    return d.select("row", "col", r(lon, 7).alias("lon"), r(lat, 7).alias("lat"))


def mosaic_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.mosaic(inputs.tiles(spark, sf_dir)).select("row", "col", r("z").alias("z"))


def resample_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the resolution along both axes, a quarter cell off; as many targets as the grid has room for."""
    g = inputs.grid(spark, sf_dir, holes=True)
    height = g.agg((F.max("row") + 1).alias("h")).first()["h"] or 0
    return surface.resample(g, (height - 1) // 2, (inputs.WIDTH - 1) // 2, 2.0, 0.25).select("row", "col", r("z").alias("z"))


def polygon_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons.polygon_mask(inputs.grid(spark, sf_dir).select("row", "col"), inputs.polygons(spark, sf_dir))


def warp_l93(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid in degrees, with nodata, warped to Lambert-93 and cropped to its extent; tiles of 32 cells."""
    h = inputs.height(spark, sf_dir).first()["h"]
    source, target = replace(inputs.DEGREES, height=h), replace(inputs.METRES, height=h)
    found = warp.warp(inputs.grid(spark, sf_dir, holes=True), source, target, partial(geodesy.lambert93_inverse, f=geodesy.Arrays), 32)
    return found.select("row", "col", r("z").alias("z"))


def mosaic_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles with transforms and nodata values of their own, on the grid over all of them."""
    tiles, cells = inputs.stored_tiles(spark, sf_dir)
    return warp.mosaic_tiles(tiles, cells, warp.union_grid(tiles)).select("row", "col", r("z").alias("z"))


def crop_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return focal.window_of(inputs.grid(spark, sf_dir), 40, 60, 50).select("row", "col", r("z").alias("z"))


def hillshade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return focal.hillshade(inputs.grid(spark, sf_dir, holes=True), inputs.RES).select("row", "col", r("shade").alias("shade"))


def roughness_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.layers(spark, sf_dir).select("key", F.when(F.col("slope") > 10, F.col("roughness") * 3 - 5).alias("v"))
    return d.select("key", r(focal.for_display(F.col("v"))).alias("roughness"))


def terrain_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From heights and polygons to costs: stencils and a mask, layers saved apart by tiles and joined again bucket by bucket, five factors."""
    g = inputs.grid(spark, sf_dir, holes=True)
    t = written(focal.terrain(g, inputs.RES))
    ice = polygons.polygon_mask(g.select("row", "col"), inputs.polygons(spark, sf_dir))
    saved = {}
    for name, cells in {"z": g, **{c: t.select("row", "col", c) for c in ("slope", "aspect", "roughness")}, "glacier": ice}.items():
        saved[name] = f"ridgeline_{uuid4().hex}"
        tiles.save_layer(cells, saved[name], name, buckets=8, path=scratch(spark))
    d = surface.cost_surface(tiles.aligned_layers(spark, {k: v for k, v in saved.items() if k != "glacier"}, saved["glacier"]))
    return d.select("row", "col", "glacier", r("cost", 0).alias("cost"))


def tiled_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of a layer saved by tiles of 32 cells."""
    name = f"ridgeline_{uuid4().hex}"
    tiles.save_layer(inputs.grid(spark, sf_dir), name, "z", 32, 4, scratch(spark))
    return tiles.window(spark, name, 12, 50, 10).select("row", "col", r("z").alias("z"))


def raster_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights written as raster files of 64 x 64 cells and read back; values have the files' precision."""
    h, folder = inputs.height(spark, sf_dir).first()["h"], scratch(spark)
    raster.write_raster(inputs.grid(spark, sf_dir, holes=True), folder, geodesy.Grid(inputs.XMIN, inputs.YMAX, inputs.RES, inputs.WIDTH, h), block=64)
    return raster.read_raster(spark, folder).where("col >= 10").select("row", "col", r("z", 2).alias("z"))


def landed_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights as raster files in a folder, taken from there by a stream of files: what each says of itself."""
    h, folder, ledger = inputs.height(spark, sf_dir).first()["h"], scratch(spark), scratch(spark)
    raster.write_raster(inputs.grid(spark, sf_dir), folder, geodesy.Grid(inputs.XMIN, inputs.YMAX, inputs.RES, inputs.WIDTH, h), block=64)
    landing.land_tiles(spark, folder, ledger)
    return landing.landed(spark, ledger).select("width", "height", r("xmin").alias("xmin"), r("ymax").alias("ymax"))


def path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = path.segments(inputs.tracks(spark, sf_dir))
    return d.select("path", "seq", *[r(c).alias(c) for c in ("dx", "dz", "d2", "d3", "slope")])


def path_cumdist(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = path.midpoints(path.segments(inputs.tracks(spark, sf_dir)))
    return d.select("path", "seq", r("dist").alias("dist"), r("mid").alias("mid"))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = path.segments(inputs.tracks(spark, sf_dir)).withColumn("cost", 1 + F.col("z") / 100).withColumn("on_ice", F.col("seq") % 3 == 0)
    return path.statistics(d, cost="cost", glacier="on_ice")


def path_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _stats(spark, sf_dir)
    return d.select("path", "n_pixels", *[r(c, 6).alias(c) for c in path.STATS if c != "n_pixels"], "top_seq")


def path_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path.checks(_stats(spark, sf_dir), 10.0)


def route_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every track as a feature collection, and what a reader finds in it."""
    d = path.geojson(inputs.tracks(spark, sf_dir), _stats(spark, sf_dir), "track", 10.0)
    properties = "name string, distance_m bigint, distance_km double, dplus_m bigint, dminus_m bigint, cost_total double, time_tobler_h double, glacier_pct double, resolution_m double, crs string"
    schema = f"type string, features array<struct<type string, geometry struct<type string, coordinates array<array<double>>>, properties struct<{properties}>>>"
    d = d.select("path", F.from_json("json", schema).alias("j")).select("path", F.col("j.type").alias("type"), F.get("j.features", F.lit(0)).alias("f"))
    line = F.col("f.geometry.coordinates")
    return d.select("path", "type", "f.properties.*", F.size(line).alias("n"), F.get(F.element_at(line, -1), F.lit(0)).alias("last_x"), F.get(F.element_at(line, 1), F.lit(1)).alias("first_y"))


def route_geojson_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As route_geojson(), in degrees and with heights, the tracks starting at a corner of the grid."""
    t = inputs.tracks(spark, sf_dir).withColumns({"x": F.col("x") + inputs.XMIN, "y": F.col("y") + inputs.YMAX})
    d = path.geojson_3d(t, _stats(spark, sf_dir), "track", 10.0)
    schema = "features array<struct<geometry struct<coordinates array<array<double>>>, properties struct<elev_min bigint, elev_max bigint, n_points bigint, crs string, variant string>>>"
    d = d.select("path", F.get(F.from_json("json", schema)["features"], F.lit(0)).alias("f"))
    first = F.element_at(F.col("f.geometry.coordinates"), 1)
    return d.select("path", "f.properties.*", F.get(first, F.lit(0)).alias("lon"), F.get(first, F.lit(1)).alias("lat"), F.get(first, F.lit(2)).alias("z"))


def route_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path.rounded(_stats(spark, sf_dir))


def track_gpx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks written as GPX and read back: the same points in the same order."""
    t = inputs.tracks(spark, sf_dir).selectExpr("path", "seq", "45.85D + seq / 10000D as lat", "6.84D + path / 1000D as lon", "z as ele")
    folder = scratch(spark)
    geo.write_gpx(t, folder)
    return geo.read_gpx(spark, folder).select(F.col("name").cast("long").alias("path"), "segment", "seq", r("lat", 7).alias("lat"), r("lon", 7).alias("lon"), r("ele").alias("ele"))


def simplify_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.tracks(spark, sf_dir).withColumn("y", F.col("z"))
    return path.simplify(d, 5.0).select("path", "seq", "x", "y")


def polygon_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named polygons within the grid's box, from a file in degrees."""
    d = geo.named(_polygons(spark, sf_dir), "glac_name", "name", "Name", "GLAC_NAME")
    ring = F.col("parts")[0][0]
    first = F.get(ring, F.lit(0))
    return d.select("id", "name", F.size(ring).alias("n"), r(first["x"], 2).alias("x"), r(first["y"], 2).alias("y"))


def ice_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a file of polygons in degrees, with holes and several parts, to a mask over the grid's cells."""
    folder = scratch(spark)
    geo.write_features(inputs.ice_features(spark, sf_dir), folder)
    found = geo.read_polygons(spark, folder, "id bigint").select(polygons.in_cells(F.col("parts"), inputs.ICE).alias("parts"))
    return polygons.polygon_mask(inputs.grid(spark, sf_dir).select("row", "col"), found)


def polygon_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons, holes and parts included, that reach into a box; many have an extent that does and an area that does not."""
    folder = scratch(spark)
    geo.write_features(inputs.ice_features(spark, sf_dir), folder)
    found = geo.read_polygons(spark, folder, "id bigint")
    x, y, side = inputs.ICE.xmin, inputs.ICE.ymax, 20 * inputs.ICE.res
    boxes = [geo.within(found, x + a * side + 7, y - b * side - 113, x + a * side + 7 + w, y - b * side - 113 + w).select("id", F.lit(k).alias("box")) for k, (a, b, w) in enumerate(inputs.BOXES)]
    return reduce(DataFrame.unionByName, boxes)


def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.total_area(_polygons(spark, sf_dir), "area_km2", "Area", "AREA").select(r("area", 2).alias("area"))


def _polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    geo.write_features(inputs.polygon_features(spark, sf_dir), folder)
    d = geo.read_polygons(spark, folder, "id bigint, glac_name string, area_km2 double")
    return geo.within(d, inputs.XMIN, inputs.YMAX - 6000, inputs.XMIN + 6000, inputs.YMAX)


def route_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of a catalogue file by activity and grade."""
    folder = scratch(spark)
    geo.write_features(inputs.route_features(spark, sf_dir), folder)
    d = geo.route_groups(geo.read_routes(spark, folder, lines=True))
    return d.select("activity", "global_rating", "n", "highest", r("climb").alias("climb"))


def grid_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid over all points, written and read as its one row."""
    d = project_l93(spark, sf_dir).agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    folder = scratch(spark)
    if d["lox"] is not None:
        geodesy.Grid.over(d["lox"], d["loy"], d["hix"], d["hiy"], 0.75).write(spark, folder)
    return spark.read.schema(geodesy.GRID).parquet(folder) if d["lox"] is not None else spark.createDataFrame([], geodesy.GRID)


def stream_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cost_product over a stream of the line items, as it stands when all that is there has come."""
    cells = inputs.layers(spark, sf_dir, stream=True)
    folder = scratch(spark)
    factors.cost_stream(cells).select("key", "cost").writeStream.format("parquet").option("path", folder).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key long, cost double").parquet(folder).select("key", r("cost", 2).alias("cost"))


def cost_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.cost_distance(inputs.cost_grid(spark, sf_dir), [(0, 0)]).select("row", "col", r("d").alias("d"))


def _far_end(cells: DataFrame) -> tuple[int, int]:
    k = cells.agg(F.max(F.struct("row", "col")).alias("k")).first()["k"]
    return k["row"], k["col"]


def route_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = inputs.cost_grid(spark, sf_dir)
    row, col = _far_end(g)
    return routing.least_cost(g, (0, 0), (row, col)).select(r("d").alias("cost"))


def route_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = inputs.cost_grid(spark, sf_dir)
    return routing.route(g, (0, 0), _far_end(g)).select("seq", "row", "col", r("d").alias("d"))


def _route(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """A route with what its cells hold, its statistics, and its end."""
    g = inputs.cost_grid(spark, sf_dir)
    end = _far_end(g)
    found = written(routing.route(g, (0, 0), end))
    layers = inputs.ice(surface.aligned({name: path.met(found, cells) for name, cells in {"z": inputs.grid(spark, sf_dir), "cost": g}.items()}).drop("glacier"))
    x, y = geodesy.to_world(F.col("row"), F.col("col"), inputs.XMIN, inputs.YMAX, inputs.RES)
    d = written(found.join(layers.select("row", "col", "z", "cost", "glacier"), ["row", "col"], "left").select(F.lit(0).alias("path"), "*", x.alias("x"), y.alias("y")))
    return d, path.statistics(path.segments(d), cost="cost", glacier="glacier"), end


def route_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route, heights, costs and ice along it, and the statistics of all that."""
    _, stats, _ = _route(spark, sf_dir)
    return stats.select("n_pixels", *[r(c).alias(c) for c in path.STATS if c != "n_pixels"])


def route_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, stats, end = _route(spark, sf_dir)
    return path.grid_checks(d, stats, (0, 0), end).drop("path")


def tile_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' urls asked for at another resolution, by boxes of many sizes; some have none."""
    p = inputs.table(spark, sf_dir, "pages").where("url is not null")
    url = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("WIDTH=1&a%20b=c+d*~&page=9&page=8&height=2#top"))
    box = F.expr("case when page_id % 5 <> 0 then concat('0,0,', page_id % 7 * 500 + 500, ',', page_id % 11 * 250 + 250) end")
    return p.select("page_id", geo.tile_request(url, box, 0.75).alias("t")).select("page_id", "t.*")


def tile_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_acctbal").cast("double") / 200).alias("lat"), (F.col("c_acctbal").cast("double") / 60 - 5).alias("lon"))
    return d.select("key", geo.fallback_tile(F.col("lat"), F.col("lon")).alias("tile"))


def missing_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "concat('t', o_custkey) as name")
    return geo.missing_tiles(d, d.where("o_orderkey % 3 = 0"))


def queries() -> dict[str, Query]:
    c = F.col
    named = (
        nodata_dilate, cost_product, cost_histogram, layer_stats, factor_stats, log_histogram, glacier_area, dem_checks, bad_value_clean, project_l93, world_to_pixel,
        pixel_to_world, l93_inverse, mercator_inverse, mosaic_first, resample_bilinear, polygon_mask, crop_window, hillshade, path_segments, path_cumdist, path_stats,
        path_checks, route_geojson, route_geojson_3d, route_rounded, track_gpx, simplify_dp, cost_distance, route_cost, route_path, route_report, route_checks, tile_request, tile_name,
        missing_tiles, roughness_display, terrain_cost, polygon_file, polygon_area, ice_mask, polygon_box, warp_l93, mosaic_tiles, tiled_window, raster_files, landed_tiles, route_groups, grid_metadata, stream_cost,
    )
    return {
        "slope_horn": _stencil("slope"),
        "aspect_horn": _stencil("aspect"),
        "roughness_std3": _stencil("roughness"),
        "cost_slope": _factor("cost", lambda: terrain.slope_cost(c("slope")), 2),
        "cost_altitude": _factor("cost", lambda: terrain.altitude_cost(c("z"))),
        "cost_altitude_acclimatized": _factor("cost", lambda: terrain.altitude_cost(c("z"), True)),
        "cost_aspect_summer": _factor("cost", lambda: terrain.aspect_cost(c("aspect"), c("slope"), c("z"), 7)),
        "cost_aspect_winter": _factor("cost", lambda: terrain.aspect_cost(c("aspect"), c("slope"), c("z"), 1)),
        "cost_glacier": _factor("cost", lambda: terrain.glacier_cost(c("glacier"), c("slope"))),
        "cost_roughness": _factor("cost", lambda: terrain.roughness_cost(c("roughness"))),
    } | {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    from ridgeline.plans.oracles import SQL

    return SQL
