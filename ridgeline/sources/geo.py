"""Sources and sinks of grids, tile catalogues, routes and tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.geodesy import lambert93, mercator_inverse
from ridgeline.functions.terrain import NODATA
from ridgeline.operators.polygons import meets_box


def read_layer(spark: SparkSession, path: str, value: str) -> DataFrame:
    """cell(row, col, value) from Parquet; sentinel and NaN turn into NULL. Missing paths raise at analysis."""
    v = F.col(value).cast("double")
    return spark.read.parquet(path).withColumn(value, F.when((v != NODATA) & ~F.isnan(v), v))


def write_layer(cells: DataFrame, path: str, value: str, tile: int = 512) -> None:
    """Float layer, partitioned by tile, so that window_of() with the same `tile` reads its tiles alone."""
    v = F.coalesce(F.col(value).cast("float"), F.lit(NODATA).cast("float"))
    tiled = cells.select("row", "col", v.alias(value), (F.col("row") / tile).cast("int").alias("tile_row"), (F.col("col") / tile).cast("int").alias("tile_col"))
    tiled.repartition("tile_row", "tile_col").write.partitionBy("tile_row", "tile_col").parquet(path)


def write_mask(cells: DataFrame, path: str, value: str = "glacier", tile: int = 512) -> None:
    """Boolean layer without a nodata value, partitioned as write_layer() does; NULL counts as false."""
    m = F.coalesce(F.col(value), F.lit(False))
    tiled = cells.select("row", "col", m.alias(value), (F.col("row") / tile).cast("int").alias("tile_row"), (F.col("col") / tile).cast("int").alias("tile_col"))
    tiled.repartition("tile_row", "tile_col").write.partitionBy("tile_row", "tile_col").parquet(path)


def read_mask(spark: SparkSession, path: str, value: str = "glacier") -> DataFrame | None:
    """The mask, or None where there is none."""
    return spark.read.parquet(path).select("row", "col", value) if exists(spark, path) else None


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)


def is_cached(spark: SparkSession, path: str, value: str) -> bool:
    """Whether the layer exists and has a valid cell."""
    return exists(spark, path) and not read_layer(spark, path, value).where(F.col(value).isNotNull()).isEmpty()


def first_available(*layers: DataFrame | None) -> DataFrame:
    """The first source that is there and has rows."""
    for d in layers:
        if d is not None and not d.isEmpty():
            return d
    raise ValueError("no source has data")


def missing_tiles(catalogue: DataFrame, landed: DataFrame) -> DataFrame:
    return catalogue.join(landed.select("name").distinct(), "name", "left_anti")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(name, url, bbox) of the features of a JSON feature collection."""
    schema = "features array<struct<properties: struct<name string, url string, bbox string>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features.properties").alias("p")).select("p.*")


def _encoded(text: Column) -> Column:
    """As in the query of a URL: a space is +, letters, digits and _ . - ~ stay, all else is %XX."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def tile_request(url: Column, bbox: Column, res: float, default: float = 1000.0) -> Column:
    """STRUCT(url, width, height): the url asking for as many pixels as its box "x0,y0,x1,y1" in metres has at this resolution.

    WIDTH and HEIGHT, in capitals, are replaced where they are or added at the end; of a repeated
    parameter the first value stays; values are decoded and encoded again; a fragment goes. Without
    a box a tile is `default` metres wide and high; without a url the result is NULL.
    """
    sides = F.transform(F.split(bbox, ","), lambda x: x.cast("double"))
    side = lambda a, b: F.bround(F.when(F.coalesce(bbox, F.lit("")) != "", F.get(sides, F.lit(b)) - F.get(sides, F.lit(a))).otherwise(F.lit(default)) / res, 0).cast("int")
    size = {"WIDTH": side(0, 2).cast("string"), "HEIGHT": side(1, 3).cast("string")}
    plain = F.substring_index(url, "#", 1)
    base, query = F.substring_index(plain, "?", 1), F.regexp_extract(plain, r"(?s)\?(.*)$", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.regexp_extract(p, "(?s)=(.*)$", 1)).alias("v")))
    first = F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(pairs, 1, i), lambda q: q["k"] == p["k"])) == 0)
    put = F.transform(first, lambda p: F.concat(_encoded(p["k"]), F.lit("="), F.when(p["k"] == "WIDTH", size["WIDTH"]).when(p["k"] == "HEIGHT", size["HEIGHT"]).otherwise(_encoded(p["v"]))))
    names = F.transform(first, lambda p: p["k"])
    added = [F.when(F.array_contains(names, k), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit(f"{k}="), v))) for k, v in size.items()]
    whole = F.concat(base, F.lit("?"), F.array_join(F.concat(put, *added), "&"))
    return F.when(F.coalesce(url, F.lit("")) != "", F.struct(whole.alias("url"), side(0, 2).alias("width"), side(1, 3).alias("height")))


def fallback_tile(lat: Column, lon: Column) -> Column:
    """Name of the public 30 m elevation tile with this point, by the south-west corner of its degree."""
    side = lambda v, plus, minus, n: F.concat(F.when(F.floor(v) >= 0, plus).otherwise(minus), F.lpad(F.abs(F.floor(v)).cast("string"), n, "0"))
    return F.concat(F.lit("Copernicus_DSM_COG_10_"), side(lat, "N", "S", 2), F.lit("_00_"), side(lon, "E", "W", 3), F.lit("_00_DEM"))


def read_features(spark: SparkSession, path: str, properties: str, lines: bool = False) -> DataFrame:
    """Properties, type and raw coordinates (JSON) of features; absent properties are NULL.

    path holds feature collections, one a file; with `lines`, a feature on each line, which Spark can
    split. Folders are searched through to the bottom.
    """
    feature = f"properties struct<{properties}>, geometry struct<type string, coordinates string>"
    reader = spark.read.option("recursiveFileLookup", True)
    if lines:
        f = reader.schema(feature).json(path)
    else:
        f = reader.schema(f"features array<struct<{feature.replace(' struct', ': struct')}>>").json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.*")
    return f.select("properties.*", F.col("geometry.type").alias("geometry_type"), "geometry.coordinates")


def write_features(features: DataFrame, path: str) -> None:
    """features(properties, geometry), a feature on each line; geometry.coordinates is JSON already."""
    geometry = F.concat(F.lit('{"type":"'), F.col("geometry.type"), F.lit('","coordinates":'), F.col("geometry.coordinates"), F.lit("}"))
    line = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json("properties"), F.lit(',"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit("}"))
    features.select(line.alias("value")).write.text(path)


def first_file(spark: SparkSession, folder: str, suffix: str) -> str:
    """The first file, by path, with this suffix in a folder or below it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder).agg(F.min("path").alias("path")).first()["path"]
    if found is None:
        raise ValueError(f"no {suffix} file in {folder}")
    return found


def read_polygons(spark: SparkSession, path: str, properties: str, lines: bool = True) -> DataFrame:
    """(properties, parts): polygons in degrees, as arrays of parts, rings and (x, y) in Lambert-93; a Polygon has one part.

    Without a geometry parts is NULL. Any other type is an error, since its area would silently be missing.
    """
    ring = "array<array<array<double>>>"
    one, many = F.from_json("coordinates", ring), F.from_json("coordinates", f"array<{ring}>")
    degrees = (
        F.when(F.col("geometry_type") == "Polygon", F.array(one)).when(F.col("geometry_type") == "MultiPolygon", many)
        .when(F.col("geometry_type").isNotNull(), F.raise_error(F.concat(F.lit("no polygon: "), F.col("geometry_type"))))
    )
    metres = lambda p: F.struct(*[v.alias(c) for c, v in zip("xy", lambert93(p[0], p[1]), strict=True)])
    parts = F.transform(degrees, lambda rings: F.transform(rings, lambda r: F.transform(r, metres)))
    return read_features(spark, path, properties, lines).withColumn("parts", parts).drop("geometry_type", "coordinates")


def within(polygons: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Polygons that have a point in this box; those without parts drop out. Extents that miss the box spare the look at edges."""
    flat = F.flatten(F.flatten("parts"))
    span = lambda f, c: f(F.transform(flat, lambda p: p[c]))
    near = (span(F.array_max, "x") >= xmin) & (span(F.array_min, "x") <= xmax) & (span(F.array_max, "y") >= ymin) & (span(F.array_min, "y") <= ymax)
    return polygons.where(F.when(near, meets_box(F.col("parts"), xmin, ymin, xmax, ymax)).otherwise(False))


def named(polygons: DataFrame, *candidates: str) -> DataFrame:
    """Polygons with a name, in the first of the candidate columns that is there."""
    return polygons.withColumn("name", attribute(polygons, *candidates).cast("string")).where("name is not null and name <> ''")


def total_area(polygons: DataFrame, *candidates: str) -> DataFrame:
    """(area): the sum over the first of the candidate columns that is there; NULL and NaN do not count."""
    a = attribute(polygons, *candidates).cast("double")
    return polygons.agg(F.coalesce(F.sum(F.when(~F.isnan(a), a)), F.lit(0.0)).alias("area"))


def read_line(spark: SparkSession, path: str) -> DataFrame:
    """(feature, name, seq, lon, lat, z) of LineString features; feature tells them apart and sorts them by file and place in it."""
    d = read_features(spark, path, "name string").where("geometry_type = 'LineString'").withColumn("feature", F.monotonically_increasing_id())
    d = d.select("feature", "name", F.posexplode(F.from_json("coordinates", "array<array<double>>")).alias("seq", "p"))
    return d.select("feature", "name", "seq", F.get("p", F.lit(0)).alias("lon"), F.get("p", F.lit(1)).alias("lat"), F.get("p", F.lit(2)).alias("z"))


#: What a catalogue of routes says of each; all but the name may be absent.
ROUTE = "type string, name string, document_id bigint, elevation int, activities array<string>, global_rating string, engagement_rating string, elevation_max int, height_diff_up int"


def read_routes(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """ROUTE with lon and lat: points given in metres of the spherical Mercator projection, though no file says so."""
    p = F.from_json("coordinates", "array<double>")
    lon, lat = mercator_inverse(F.get(p, F.lit(0)), F.get(p, F.lit(1)))
    return read_features(spark, path, ROUTE, lines).select("*", lon.alias("lon"), lat.alias("lat")).drop("geometry_type", "coordinates")


def route_groups(routes: DataFrame) -> DataFrame:
    """(activity, global_rating, n, highest, climb): routes by activity and grade, each route once for every activity of its; without an activity, or a grade, that is NULL."""
    return routes.select(F.explode_outer("activities").alias("activity"), "global_rating", "elevation_max", "height_diff_up").groupBy("activity", "global_rating").agg(F.count("*").alias("n"), F.max("elevation_max").alias("highest"), F.avg("height_diff_up").alias("climb"))


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """(track, name, segment, seq, lat, lon, ele) of tracks' points; track tells tracks apart, seq counts from 0 through all segments of one."""
    point = "array<struct<_lat: double, _lon: double, ele: double>>"
    d = spark.read.format("xml").option("rowTag", "trk").schema(f"name string, trkseg array<struct<trkpt: {point}>>").load(path).withColumn("track", F.monotonically_increasing_id())
    d = d.select("track", "name", F.posexplode("trkseg").alias("segment", "s"), "trkseg").select("track", "name", "segment", F.expr("aggregate(slice(trkseg, 1, segment), 0, (n, g) -> n + coalesce(size(g.trkpt), 0))").alias("before"), F.posexplode("s.trkpt").alias("at", "p"))
    return d.select("track", "name", "segment", (F.col("before") + F.col("at")).alias("seq"), F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), F.col("p.ele").alias("ele"))


def write_gpx(points: DataFrame, path: str) -> None:
    """points(path, seq, lat, lon, ele): a track with one segment for each path, its points in order of seq."""
    tracks = points.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon", "ele"))).alias("ps"))
    segment = F.struct(F.transform("ps", lambda p: F.struct(p["lat"].alias("_lat"), p["lon"].alias("_lon"), p["ele"].alias("ele"))).alias("trkpt"))
    tracks.select(F.col("path").cast("string").alias("name"), segment.alias("trkseg")).write.format("xml").option("rootTag", 'gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"').option("rowTag", "trk").save(path)


def attribute(d: DataFrame, *candidates: str) -> Column:
    """The first of the candidate columns that is there, else NULL: attribute names differ between polygon sets."""
    return next((F.col(c) for c in candidates if c in d.columns), F.lit(None))
