"""Cost surface, mosaic, resampling, polygon mask and layer statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import terrain as T
from ridgeline.functions.session import written

LEVELS = ((0.0, 2.0), (2.0, 5.0), (5.0, 20.0), (20.0, 100.0), (100.0, float("inf")))
FACTORS = ("f_slope", "f_altitude", "f_aspect", "f_glacier", "f_roughness")


def cost_surface(layers: DataFrame, month: int = 7, acclimatized: bool = False) -> DataFrame:
    """layers(slope, aspect, z, roughness, glacier) with the five factors and their product; NULL where slope is nodata."""
    valid = F.col("slope").isNotNull()
    fs = (
        T.slope_cost(F.col("slope")),
        T.altitude_cost(F.coalesce("z", F.lit(0.0)), acclimatized),
        T.aspect_cost(F.col("aspect"), F.col("slope"), F.coalesce("z", F.lit(0.0)), month),
        T.glacier_cost(F.col("glacier"), F.col("slope")),
        T.roughness_cost(F.coalesce("roughness", F.lit(0.0))),
    )
    d = layers.withColumns({n: F.when(valid, f) for n, f in zip(FACTORS, fs, strict=True)})
    product = F.col(FACTORS[0])
    for n in FACTORS[1:]:
        product = product * F.col(n)
    return d.withColumn("cost", product)


def aligned(layers: dict[str, DataFrame], mask: DataFrame | None = None) -> DataFrame:
    """Layers stored apart, name -> cell(row, col, <name>), side by side: the cells that all of them have, once each.

    mask(row, col, glacier) is optional, as a whole and cell by cell: where it is absent, glacier is false.
    """
    out = None
    for name, cells in layers.items():
        one = cells.select("row", "col", name)
        out = one if out is None else out.join(one, ["row", "col"])
    if mask is None:
        return out.withColumn("glacier", F.lit(False))
    return out.join(mask.select("row", "col", "glacier"), ["row", "col"], "left").withColumn("glacier", F.coalesce("glacier", F.lit(False)))


def histogram(values: DataFrame, value: str, levels: tuple[tuple[float, float], ...] = LEVELS) -> DataFrame:
    """(bucket, lo, hi, n, pct) over half-open levels, in one aggregate; empty levels are reported with 0."""
    v = F.col(value)
    total = values.agg(F.count(v).alias("total"), *[F.count_if((v >= lo) & (v < hi)).alias(f"n{i}") for i, (lo, hi) in enumerate(levels)])
    rows = F.array(*[F.struct(F.lit(i).alias("bucket"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.col(f"n{i}").alias("n")) for i, (lo, hi) in enumerate(levels)])
    return total.select("total", F.explode(rows).alias("r")).select("r.*", F.try_divide(100 * F.col("r.n"), F.col("total")).alias("pct"))


def log_histogram(values: DataFrame, value: str, lo: float = 0.0, hi: float = 4.0, bins: int = 79) -> DataFrame:
    """(bin, n) over equal bins of log10, 1 to `bins`; the last bin is closed, empty bins have 0."""
    x = F.log10(F.col(value))
    b = F.when(x == hi, bins).otherwise(F.floor((x - lo) / ((hi - lo) / bins)) + 1).cast("int")
    found = values.where((F.col(value) > 0) & x.between(lo, hi)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    frame = values.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return frame.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def percentiles(values: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """values(layer, v) -> (layer, q0, q1, ...): exact percentiles of the values that are not NULL, linear between neighbours.

    Distinct values are counted, sorted over range partitions and numbered by each partition's
    total; only partitions that hold a rank asked for are numbered inside. No task holds a layer.
    """
    counted = values.where("v is not null").groupBy("layer", "v").agg(F.count("*").alias("n"))
    sorted_ = written(counted.repartitionByRange("layer", "v").withColumn("part", F.spark_partition_id()))
    parts = sorted_.groupBy("layer", "part").agg(F.sum("n").alias("size"))  # a row for each layer and partition
    parts = parts.withColumns({"end": F.sum("size").over(Window.partitionBy("layer").orderBy("part")), "total": F.sum("size").over(Window.partitionBy("layer"))})
    parts = parts.withColumn("begin", F.col("end") - F.col("size"))
    at = F.col("share") * (F.col("total") - 1)
    asked = parts.select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in shares])).alias("k", "share")).withColumn("at", at)
    asked = asked.select("*", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank")).where("rank >= begin and rank < end").select("layer", "part", "begin", "k", "at", "rank")
    near = sorted_.join(F.broadcast(asked.select("layer", "part", "begin").distinct()), ["layer", "part"])
    near = near.withColumn("to", F.col("begin") + F.sum("n").over(Window.partitionBy("layer", "part").orderBy("v")))
    hit = near.drop("begin").join(F.broadcast(asked.drop("begin")), ["layer", "part"]).where("rank < to and rank >= to - n")
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    each = hit.groupBy("layer", "k").agg((low + (high - low) * (F.max("at") - F.floor(F.max("at")))).alias("q"))
    return each.groupBy("layer").agg(*[F.max(F.when(F.col("k") == k, F.col("q"))).alias(f"q{k}") for k in range(len(shares))])


#: Column -> share of the cells below it.
SHARES = {"median": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def layer_statistics(cells: DataFrame, layers: tuple[str, ...], most: dict[str, float] | None = None) -> DataFrame:
    """A row for each layer: valid cells, nodata share, extremes, mean, exact percentiles, and how many cells lie above its `most`."""
    pairs = ", ".join(f"'{c}', double({c})" for c in layers)
    d = cells.selectExpr(f"stack({len(layers)}, {pairs}) as (layer, v)")
    above = F.coalesce(*[F.when((F.col("layer") == c) & (F.col("v") > x), True) for c, x in (most or {}).items()], F.lit(False))
    base = d.groupBy("layer").agg(F.count("v").alias("n"), (100.0 * F.count_if(F.col("v").isNull()) / F.count("*")).alias("nodata_pct"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.count_if(above).alias("n_extreme"))
    base = base.withColumn("extreme_pct", F.try_divide(100 * F.col("n_extreme"), F.col("n")))
    q = percentiles(d, tuple(SHARES.values())).withColumnsRenamed({f"q{k}": name for k, name in enumerate(SHARES)})
    return base.join(q, "layer", "left")


def mosaic(tiles: DataFrame) -> DataFrame:
    """tiles(tile_rank, row, col, z) -> (row, col, z): the first tile with a valid height."""
    return tiles.groupBy("row", "col").agg(F.min_by("z", F.when(F.col("z").isNotNull(), F.col("tile_rank"))).alias("z"))


def resample(cells: DataFrame, height: int, width: int, step: float, offset: float = 0.0) -> DataFrame:
    """Bilinear heights at (row * step + offset, col * step + offset); nodata neighbours drop out and weights are renormalised.

    Source cells go to the targets they touch by an equi-join on four integer corners.
    """
    t = cells.sparkSession.range(height * width).select((F.col("id") / width).cast("int").alias("trow"), (F.col("id") % width).cast("int").alias("tcol"))
    t = t.withColumn("sr", F.col("trow") * step + offset).withColumn("sc", F.col("tcol") * step + offset)
    t = t.withColumn("fr", F.col("sr") - F.floor("sr")).withColumn("fc", F.col("sc") - F.floor("sc"))
    corner = lambda i, j: F.struct((F.floor("sr") + i).cast("int").alias("row"), (F.floor("sc") + j).cast("int").alias("col"), ((F.col("fr") if i else 1 - F.col("fr")) * (F.col("fc") if j else 1 - F.col("fc"))).alias("w"))
    four = t.select("trow", "tcol", F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])).alias("k")).select("trow", "tcol", "k.*").where("w > 0")
    hit = four.join(cells.where("z is not null"), ["row", "col"])
    return hit.groupBy("trow", "tcol").agg((F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("z")).select(F.col("trow").alias("row"), F.col("tcol").alias("col"), "z")
