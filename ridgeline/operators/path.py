"""Metrics of ordered paths: windows along each path, then one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.geodesy import lambert93_inverse
from ridgeline.functions.session import discarded, written
from ridgeline.functions.terrain import walking_speed

STATS = ("n_pixels", "dist_2d_m", "dist_3d_m", "dplus", "dminus", "elev_start", "elev_end", "elev_min", "elev_max", "cost_total", "cost_mean", "cost_median", "glacier_pct", "time_h")


def segments(points: DataFrame, path: str = "path") -> DataFrame:
    """points(path, seq, x, y, z) with dx, dy, dz, d2, d3, slope, hours of the step from the point before, and cumulative distance."""
    w = Window.partitionBy(path).orderBy("seq")
    d = points.withColumns({f"d{c}": F.col(c) - F.lag(c).over(w) for c in "xyz"})
    d = d.withColumn("d2", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    d = d.withColumn("d3", F.sqrt(F.col("d2") * F.col("d2") + F.col("dz") * F.col("dz")))
    d = d.withColumn("slope", F.degrees(F.atan2(F.abs("dz"), F.col("d2"))))
    d = d.withColumn("hours", F.col("d2") / 1000 / walking_speed(F.try_divide("dz", "d2")))
    return d.withColumn("dist", F.sum(F.coalesce("d2", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def midpoints(steps: DataFrame, path: str = "path") -> DataFrame:
    """Where along the path the middle of each step lies."""
    w = Window.partitionBy(path).orderBy("seq")
    return steps.withColumn("mid", (F.col("dist") + F.lead("dist").over(w)) / 2).where("mid is not null")


def statistics(steps: DataFrame, path: str = "path", cost: str | None = None, glacier: str | None = None) -> DataFrame:
    """One row for each path; what has no column given is NULL (glacier: -1). A single point has zero distances."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    none = F.lit(None).cast("double")
    return steps.groupBy(path).agg(
        F.count("*").alias("n_pixels"),
        zero("d2").alias("dist_2d_m"),
        zero("d3").alias("dist_3d_m"),
        zero(F.greatest("dz", F.lit(0.0))).alias("dplus"),
        zero(F.greatest(-F.col("dz"), F.lit(0.0))).alias("dminus"),
        F.min_by("z", "seq").alias("elev_start"),
        F.max_by("z", "seq").alias("elev_end"),
        F.min("z").alias("elev_min"),
        F.max("z").alias("elev_max"),
        (F.sum(cost) if cost else F.max(none)).alias("cost_total"),
        (F.avg(cost) if cost else F.max(none)).alias("cost_mean"),
        (F.percentile(cost, F.lit(0.5)) if cost else F.max(none)).alias("cost_median"),
        (100.0 * F.count_if(F.col(glacier)) / F.count("*") if glacier else F.max(F.lit(-1.0))).alias("glacier_pct"),
        zero("hours").alias("time_h"),
        F.max_by("seq", F.struct("z", -F.col("seq"))).alias("top_seq"),
        F.coalesce(F.max(F.greatest(F.abs("dx"), F.abs("dy"))), F.lit(0.0)).alias("max_step"),
    )


def met(path: DataFrame, layer: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The layer's cells that path(row, col, ...) meets: a path of `most` cells at most goes to where the layer is, a longer one is joined by a shuffle. path is read twice, so it should be written."""
    cells = path.select("row", "col").distinct()
    return layer.join(F.broadcast(cells) if cells.limit(most + 1).count() <= most else cells, ["row", "col"], "left_semi")


def gathered(path: DataFrame, layers: DataFrame, *values: str, most: int = 1_000_000) -> DataFrame:
    """path(seq, row, col, ...) with the values of its cells; a cell outside the layers has NULLs. The order is that of seq.

    Only what the path meets (see met()) comes back from the layers. path is read three times, so it should be written.
    """
    return path.join(met(path, layers.select("row", "col", *values), most), ["row", "col"], "left")


def plausible(stats: DataFrame) -> tuple[Column, Column]:
    """Between 3 and 20 km, and 500 to 3000 m of climb, bounds excluded."""
    return ((F.col("dist_2d_m") > 3000) & (F.col("dist_2d_m") < 20000)).alias("plausible_length"), ((F.col("dplus") > 500) & (F.col("dplus") < 3000)).alias("plausible_climb")


def checks(stats: DataFrame, step: float, path: str = "path") -> DataFrame:
    """A boolean for each plausibility rule."""
    return stats.select(path, (F.col("n_pixels") > 0).alias("not_empty"), (F.col("max_step") <= step).alias("continuous"), *plausible(stats))


def grid_checks(cells: DataFrame, stats: DataFrame, start: tuple[int, int], end: tuple[int, int], path: str = "path") -> DataFrame:
    """cells(path, seq, row, col, cost) -> one row for each path: right ends, no step over one cell, cells without passage, and plausible()."""
    w = Window.partitionBy(path).orderBy("seq")
    jump = F.greatest(*[F.abs(F.col(c) - F.lag(c).over(w)) for c in ("row", "col")])
    is_at = lambda c, k: (c["row"] == k[0]) & (c["col"] == k[1])
    d = cells.withColumn("jump", jump).groupBy(path).agg(
        F.min_by(F.struct("row", "col"), "seq").alias("first"), F.max_by(F.struct("row", "col"), "seq").alias("last"),
        F.coalesce(F.max("jump"), F.lit(0)).alias("jump"), F.count_if(F.col("cost") == float("inf")).alias("n_impassable"),
    )
    found = d.join(stats, path)
    return found.select(path, (F.col("n_pixels") > 0).alias("not_empty"), is_at(F.col("first"), start).alias("starts"), is_at(F.col("last"), end).alias("ends"), (F.col("jump") <= 1).alias("continuous"), "n_impassable", *plausible(stats))


def half_even(c: Column | str, digits: int = 0) -> Column:
    """Half to even of the value times 10 ** digits, as SQL's round_even has it; bround() judges a value's shortest decimal text, which next to ties is another matter."""
    c = F.col(c) if isinstance(c, str) else c
    return F.rint(c * 10.0**digits) / 10.0**digits


def rounded(stats: DataFrame, path: str = "path") -> DataFrame:
    """As exported, half to even: metres whole, kilometres to two digits, cost, hours and percent to one."""
    return stats.select(
        path,
        half_even("dist_2d_m").cast("long").alias("distance_m"),
        half_even(F.col("dist_2d_m") / 1000, 2).alias("distance_km"),
        half_even("dplus").cast("long").alias("dplus_m"),
        half_even("dminus").cast("long").alias("dminus_m"),
        half_even("elev_min").cast("long").alias("elev_min"),
        half_even("elev_max").cast("long").alias("elev_max"),
        half_even("cost_total", 1).alias("cost_total"),
        half_even("time_h", 1).alias("time_tobler_h"),
        half_even("glacier_pct", 1).alias("glacier_pct"),
        F.col("n_pixels").alias("n_points"),
    )


def simplify(points: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """points(path, seq, x, y, ...) without vertices within `tolerance` of the line, by Douglas and Peucker; ends always stay.

    Rounds instead of recursion: every vertex carries the two vertices of the line it is held
    against; the farthest beyond the tolerance of each line (the first of several) splits it,
    until none does. A long path is spread over all tasks; only lines are aggregated.
    """
    ends = points.groupBy("path").agg(F.min("seq").alias("a"), F.max("seq").alias("b"))
    plain = points.select("path", "seq", "x", "y")
    at = lambda c: plain.select("path", F.col("seq").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    kept = written(ends.select("path", F.explode(F.array_distinct(F.array("a", "b"))).alias("seq")))
    open_ = written(plain.join(ends, "path").where("seq > a and seq < b"))
    while not open_.isEmpty():
        lines = open_.select("path", "a", "b").distinct().join(at("a"), ["path", "a"]).join(at("b"), ["path", "b"])
        dx, dy, px, py = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
        length = F.sqrt(dx * dx + dy * dy)
        far = F.when(length > 0, F.abs(dx * py - dy * px) / length).otherwise(F.sqrt(px * px + py * py))
        each = open_.join(lines, ["path", "a", "b"]).select("path", "a", "b", "seq", far.alias("far"))
        split = written(each.groupBy("path", "a", "b").agg(F.max("far").alias("far"), F.max_by("seq", F.struct("far", -F.col("seq"))).alias("m")).where(F.col("far") > tolerance).select("path", "a", "b", "m"))
        before = open_, kept
        halves = open_.join(split, ["path", "a", "b"]).where("seq <> m")
        open_ = written(halves.select("path", "seq", "x", "y", F.when(F.col("seq") < F.col("m"), F.col("a")).otherwise(F.col("m")).alias("a"), F.when(F.col("seq") < F.col("m"), F.col("m")).otherwise(F.col("b")).alias("b")))
        kept = written(kept.unionByName(split.select("path", F.col("m").alias("seq"))))
        discarded(split, *before)
    return points.join(kept, ["path", "seq"], "left_semi")


def _collection(points: DataFrame, properties: DataFrame, *coordinates: str) -> DataFrame:
    line = points.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", *coordinates))), lambda p: F.array(*[p[c] for c in coordinates])).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), "coordinates").alias("geometry"), "properties")
    return line.join(properties, "path").select("path", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("json"))


def geojson(points: DataFrame, stats: DataFrame, name: str, resolution: float, crs: str = "EPSG:2154") -> DataFrame:
    """points(path, seq, x, y) -> (path, json): a feature collection with one LineString for each path, in order of seq, in
    metres, with ten properties; crs is one of them, as the format itself knows degrees only."""
    columns = ("distance_m", "distance_km", "dplus_m", "dminus_m", "cost_total", "time_tobler_h", "glacier_pct")
    properties = F.struct(F.lit(name).alias("name"), *columns, F.lit(resolution).alias("resolution_m"), F.lit(crs).alias("crs"))
    return _collection(points, rounded(stats).select("path", properties.alias("properties")), "x", "y")


def geojson_3d(points: DataFrame, stats: DataFrame, name: str, resolution: float, variant: str = "simplified") -> DataFrame:
    """points(path, seq, x, y, z), in Lambert-93 -> (path, json): as geojson(), in degrees of seven digits with heights of one, and with extremes and number of points."""
    lon, lat = lambert93_inverse(F.col("x"), F.col("y"))
    degrees = points.select("path", "seq", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"), F.round("z", 1).alias("z"))
    columns = ("distance_m", "distance_km", "dplus_m", "dminus_m", "elev_min", "elev_max", "n_points", "time_tobler_h", "glacier_pct")
    properties = F.struct(F.lit(name).alias("name"), *columns, F.lit(resolution).alias("resolution_m"), F.lit("EPSG:4326").alias("crs"), F.lit(variant).alias("variant"))
    return _collection(degrees, rounded(stats).select("path", properties.alias("properties")), "lon", "lat", "z")
