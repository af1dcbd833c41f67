"""Grids, layers, tracks, points and polygons derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.geodesy import Grid

WIDTH, RES, XMIN, YMAX = 100, 0.5, 1002000.0, 6543000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str, holes: bool = False) -> DataFrame:
    """cell(row, col, z) from orders; with holes about 1 % is nodata."""
    z = F.col("o_totalprice") / 2e5 + 2499
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select((key / WIDTH).cast("int").alias("row"), (key % WIDTH).cast("int").alias("col"), (F.when(key % 97 != 0, z) if holes else z).alias("z"))


def layers(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """One cell for each line item, over every branch of the cost factors; as a stream of the table's files if asked for."""
    items = table(spark, sf_dir, "lineitem")
    if stream:
        items = spark.readStream.schema(items.schema).parquet(f"{sf_dir}/lineitem.parquet*")
    return items.selectExpr(
        "l_orderkey as key", "double(l_extendedprice) % 90 as slope", "case when l_linenumber = 1 then null else double(l_quantity) * 7.2 end as aspect",
        "double(1000 + l_partkey % 3500) as z", "double(l_tax) * 100 as roughness", "l_returnflag = 'R' as glacier",
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points(path, seq, x, y, z): the events of a user in order of time."""
    return table(spark, sf_dir, "events").selectExpr("user_id as path", "row_number() over (partition by user_id order by ts, event_id) as seq", "double(value) as z").selectExpr("path", "seq", "10.0D * seq as x", "0.0D as y", "z")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as key", "45.85D + (c_custkey % 100) / 2000D as lat", "6.84D + (c_custkey div 100) / 2000D as lon")


def height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(h): rows of the grid."""
    return table(spark, sf_dir, "orders").selectExpr("coalesce(max(o_orderkey), 0) div 100 + 1 as h")


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A skewed quadrilateral for each supplier, its corners off the cell centres, spread over the height of the grid."""
    s = table(spark, sf_dir, "supplier").crossJoin(F.broadcast(height(spark, sf_dir)))
    return s.selectExpr("s_suppkey as id", "double(s_suppkey * 7919 % 97) + 0.3D as cx", "double(s_suppkey * 104729 % h) + 0.2D as cy").selectExpr(
        "id", "array(array(array(named_struct('x', cx - 3.1D, 'y', cy - 1.2D), named_struct('x', cx + 1.3D, 'y', cy - 2.4D), named_struct('x', cx + 3.2D, 'y', cy + 1.1D), named_struct('x', cx - 1.4D, 'y', cy + 2.3D), named_struct('x', cx - 3.1D, 'y', cy - 1.2D)))) as parts"
    )


def polygon_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """features(properties, geometry): a small square in degrees for each supplier; some have no name, some no geometry."""
    s = table(spark, sf_dir, "supplier").selectExpr("*", "6.84D + (s_suppkey % 100) / 1000D as lon", "45.88D + (s_suppkey div 100) / 1000D as lat")
    ring = ", ".join(f"array(lon {x} 0.0002D, lat {y} 0.0002D)" for x, y in ("--", "+-", "++", "-+", "--"))
    return s.selectExpr(
        "named_struct('id', s_suppkey, 'glac_name', case when s_suppkey % 3 = 0 then null when s_suppkey % 7 = 0 then '' else s_name end, 'area_km2', double(s_acctbal)) as properties",
        f"case when s_suppkey % 11 <> 0 then named_struct('type', 'Polygon', 'coordinates', to_json(array(array({ring})))) end as geometry",
    )


#: The grid that ice_features() lie on, as far down as the orders' grid goes.
ICE = Grid(xmin=997550.0, ymax=6540750.0, res=20.0, width=WIDTH, height=0)
#: Rings around a centre, in ten-thousandths of a degree: an outer one, its hole, and a part of its own.
OUTER, HOLE, ISLE = ((-16, -12), (15, -13), (17, 11), (-13, 12), (-16, -12)), ((-6, -5), (7, -6), (5, 6), (-6, -5)), ((30, -4), (42, 3), (29, 9), (30, -4))


#: Boxes to ask for: how many steps right and down of the grid's corner, and their side in metres.
BOXES = ((0, 0, 400.0), (1, 0, 60.0), (2, 1, 900.0), (3, 0, 8.0), (1, 2, 25.0))


def ice_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """features(properties, geometry): for each supplier a polygon with a hole, in degrees; every third is a MultiPolygon with an isle."""
    s = table(spark, sf_dir, "supplier").crossJoin(F.broadcast(height(spark, sf_dir))).selectExpr("s_suppkey", "6.84D + (s_suppkey * 7919 % 97) * 20 / 77500D as lon", "45.9D - (s_suppkey * 104729 % h) * 20 / 111150D as lat")
    ring = lambda corners: "array(" + ", ".join(f"array(lon + {x}D / 10000, lat + {y}D / 10000)" for x, y in corners) + ")"
    one = f"array({ring(OUTER)}, {ring(HOLE)})"
    return s.selectExpr(
        "named_struct('id', s_suppkey) as properties",
        f"named_struct('type', if(s_suppkey % 3 = 0, 'MultiPolygon', 'Polygon'), 'coordinates', if(s_suppkey % 3 = 0, to_json(array({one}, array({ring(ISLE)}))), to_json({one}))) as geometry",
    )


def route_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """features(properties, geometry): a point in Mercator metres for each part; activities and grades are absent from some."""
    return table(spark, sf_dir, "part").selectExpr(
        "named_struct('type', 'route', 'name', p_name, 'document_id', p_partkey, 'activities', case when p_partkey % 4 = 0 then null when p_partkey % 4 = 1 then array('hiking') else array('hiking', 'skitouring') end, "
        "'global_rating', case when p_partkey % 3 <> 0 then p_brand end, 'elevation_max', 2000 + int(p_size) * 10, 'height_diff_up', int(p_size) * 20) as properties",
        "named_struct('type', 'Point', 'coordinates', to_json(array(760000D + p_partkey % 1000, 5750000D - p_partkey % 1000))) as geometry",
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of 90 rows that overlap by 30 all along the grid; every other one has holes, and a height of its own."""
    bands = F.array_distinct(F.array(F.greatest(F.floor((F.col("row") - 30) / 60), F.lit(0)), F.floor(F.col("row") / 60)))
    g = grid(spark, sf_dir).select("*", F.explode(bands).alias("tile_rank"))
    return g.selectExpr("int(tile_rank) as tile_rank", "row", "col", "case when tile_rank % 2 <> 0 or (row * 100 + col) % 13 <> 0 then z + 0.25D * (tile_rank % 2) end as z")


def cost_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("int(o_orderkey div 100) as row", "int(o_orderkey % 100) as col", "1 + double(o_totalprice) / 1e5D as cost")


def ice(cells: DataFrame) -> DataFrame:
    """cells with glacier, in stripes."""
    return cells.withColumn("glacier", F.pmod(F.col("row") + F.col("col"), F.lit(3)) == 0)


#: A grid of heights in degrees as large as the orders' grid, and the one in metres that it is warped to; heights in cells are the orders'.
DEGREES, METRES = Grid(xmin=6.84, ymax=45.9, res=0.0003, width=WIDTH, height=0, crs="EPSG:4326"), Grid(xmin=997500.0, ymax=6540700.0, res=31.0, width=80, height=0)


def stored_tiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """tiles(tile, rank, xmin, ymax, res, width, height, nodata) and their cells(tile, row, col, z): bands of 40 rows, every 30 rows one, that
    overlap; their origins, resolutions and nodata values differ, and every fifth band is missing."""
    g = grid(spark, sf_dir).selectExpr("*", "explode(array_distinct(array(greatest(floor((row - 10) / 30), 0), floor(row / 30)))) as tile").where("tile % 5 <> 4")
    cells = g.selectExpr("tile", "int(row - 30 * tile) as row", "col", "case when (row * 100 + col) % 11 <> 0 then z + tile % 2 when tile % 2 = 0 then -9999D else -1D end as z")
    tiles = cells.groupBy("tile").agg((F.max("row") + 1).alias("height")).selectExpr(
        "tile", "(tile * 7) % 13 * 1000 + tile as rank", "1000D + 3.25D * (tile % 3) as xmin", "5000D - 30 * tile - 0.4D * (tile % 4) as ymax", "case when tile % 3 = 1 then 1.5D else 1D end as res",
        "100 as width", "height", "case when tile % 2 = 0 then -9999D else -1D end as nodata",
    )
    return tiles, cells
