"""DuckDB SQL for the registered queries, written apart from the operators: joins instead of windows, loops as recursive CTEs."""

from ridgeline.plans import inputs

GRID = "SELECT o_orderkey // 100 AS row, o_orderkey % 100 AS col, o_totalprice::DOUBLE / 2e5 + 2499 AS z FROM orders"
HOLES = "SELECT o_orderkey // 100 AS row, o_orderkey % 100 AS col, CASE WHEN o_orderkey % 97 <> 0 THEN o_totalprice::DOUBLE / 2e5 + 2499 END AS z FROM orders"
LAYERS = """SELECT l_orderkey AS key, l_extendedprice::DOUBLE % 90 AS slope, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity::DOUBLE * 7.2 END AS aspect,
 (1000 + l_partkey % 3500)::DOUBLE AS z, l_tax::DOUBLE * 100 AS roughness, l_returnflag = 'R' AS glacier FROM lineitem"""
TRACKS = """SELECT user_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, value::DOUBLE AS z FROM events"""
POINTS = "SELECT c_custkey AS key, 45.85::DOUBLE + (c_custkey % 100) / 2000::DOUBLE AS lat, 6.84::DOUBLE + (c_custkey // 100) / 2000::DOUBLE AS lon FROM customer"

F_SLOPE = "3.6 * exp(-0.175::DOUBLE) / greatest(3.6 * exp(-3.5 * abs(tan(radians(least(greatest(slope, 0), 89.9))) + 0.05)), 0.01) * CASE WHEN slope > 45 THEN 5 ELSE 1 END * CASE WHEN slope > 60 THEN 50 ELSE 1 END"
F_ALTITUDE = "1 / greatest(1 - greatest(0, z - 1500) * {rate} / 1000, 0.3)"
F_SUMMER = "CASE WHEN slope > 30 AND z > 2500 AND aspect IS NOT NULL THEN 1 + 0.5 * greatest(cos(radians(aspect) - pi()), 0) ELSE 1 END"
F_WINTER = "CASE WHEN slope > 25 AND aspect IS NOT NULL THEN 1 + 0.3 * greatest(cos(radians(aspect)), 0) ELSE 1 END"
F_GLACIER = "CASE WHEN NOT glacier THEN 1 WHEN slope < 10 THEN 1.3 WHEN slope < 20 THEN 2 WHEN slope < 30 THEN 4 ELSE 10 END"
F_ROUGH = "1 + 0.8 * least(roughness, 5)"
SURFACE = f"SELECT key, {F_SLOPE} AS f_slope, {F_ALTITUDE.format(rate=0.063)} AS f_altitude, {F_SUMMER} AS f_aspect, ({F_GLACIER})::DOUBLE AS f_glacier, {F_ROUGH} AS f_roughness FROM ({LAYERS})"
PRODUCT = "f_slope * f_altitude * f_aspect * f_glacier * f_roughness"


def _neighbours(cells: str) -> str:
    """Each cell with its nine neighbours by self-join; m*: mirrored border, e*: repeated border."""
    offsets = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    name = lambda i, j: f"{'nzs'[i + 1]}{'wze'[j + 1]}"
    cols, joins = [], []
    for i, j in offsets:
        n = name(i, j)
        row = f"CASE WHEN a.row + {i} < 0 THEN 1 WHEN a.row + {i} > h.r THEN h.r - 1 ELSE a.row + {i} END"
        col = f"CASE WHEN a.col + {j} < 0 THEN 1 WHEN a.col + {j} > 99 THEN 98 ELSE a.col + {j} END"
        joins.append(f"LEFT JOIN g m{n} ON m{n}.row = {row} AND m{n}.col = {col} LEFT JOIN g e{n} ON e{n}.row = least(greatest(a.row + {i}, 0), h.r) AND e{n}.col = least(greatest(a.col + {j}, 0), 99)")
        cols += [f"coalesce(m{n}.z, 0) AS m{n}", f"coalesce(e{n}.z, 0) AS e{n}"]
    nodata = " OR ".join(f"e{name(i, j)}.z IS NULL" for i, j in offsets)
    return f"WITH g AS ({cells}), h AS (SELECT max(row) AS r FROM g), k AS (SELECT a.row, a.col, {', '.join(cols)}, {nodata} AS nodata FROM g a CROSS JOIN h {' '.join(joins)}), q AS (SELECT *, ((mne + 2 * mze + mse) - (mnw + 2 * mzw + msw)) / 4.0 AS e, ((mnw + 2 * mnz + mne) - (msw + 2 * msz + mse)) / 4.0 AS n FROM k)"


NINE = ("enw", "enz", "ene", "ezw", "ezz", "eze", "esw", "esz", "ese")
SLOPE = "degrees(atan(sqrt(e * e + n * n)))"
MEAN = f"({' + '.join(NINE)}) / 9"
ROUGH = "sqrt((" + " + ".join(f"({c} - ({MEAN})) * ({c} - ({MEAN}))" for c in NINE) + ") / 9)"

LAT_E = "sqrt(2 / 298.257222101 - 1 / (298.257222101 * 298.257222101))"
L93 = f"""SELECT key, lat, lon, 700000 + rr * sin(t) AS x, 12655612.049876 - rr * cos(t) AS y FROM (SELECT *, 11754255.426096 * exp(-0.7256077650532670 * iso) AS rr, 0.7256077650532670 * radians(lon - 3) AS t FROM
 (SELECT *, ln(tan(pi() / 4 + radians(lat) / 2) * pow((1 - ecc * sin(radians(lat))) / (1 + ecc * sin(radians(lat))), ecc / 2)) AS iso FROM (SELECT *, {LAT_E} AS ecc FROM ({POINTS}))))"""

STEPS = f"SELECT *, 10::DOUBLE * seq AS x, 10::DOUBLE * seq - lag(10::DOUBLE * seq) OVER (PARTITION BY path ORDER BY seq) AS dx, z - lag(z) OVER (PARTITION BY path ORDER BY seq) AS dz FROM ({TRACKS})"
STATS = f"""SELECT path, count(*) AS n_pixels, coalesce(sum(dx), 0) AS dist_2d_m, coalesce(sum(sqrt(dx * dx + dz * dz)), 0) AS dist_3d_m, coalesce(sum(greatest(dz, 0)), 0) AS dplus,
 coalesce(sum(greatest(-dz, 0)), 0) AS dminus, arg_min(z, seq) AS elev_start, arg_max(z, seq) AS elev_end, min(z) AS elev_min, max(z) AS elev_max, sum(1 + z / 100) AS cost_total, avg(1 + z / 100) AS cost_mean,
 quantile_cont(1 + z / 100, 0.5) AS cost_median, 100.0 * count(*) FILTER (seq % 3 = 0) / count(*) AS glacier_pct, coalesce(sum(dx / 1000 / greatest(3.6 * exp(-3.5 * abs(dz / dx + 0.05)), 0.01)), 0) AS time_h,
 min(seq) FILTER (z = top) AS top_seq FROM (SELECT *, max(z) OVER (PARTITION BY path) AS top FROM ({STEPS})) GROUP BY path"""

DISTANCE = """WITH RECURSIVE c AS (SELECT o_orderkey // 100 AS r, o_orderkey % 100 AS c, 1 + o_totalprice::DOUBLE / 1e5 AS w FROM orders),
s(i, j, l) AS (VALUES (-1, -1, sqrt(2.0)), (-1, 0, 1.0), (-1, 1, sqrt(2.0)), (0, -1, 1.0), (0, 1, 1.0), (1, -1, sqrt(2.0)), (1, 0, 1.0), (1, 1, sqrt(2.0))),
e AS (SELECT a.r, a.c, b.r AS r2, b.c AS c2, l * (a.w + b.w) / 2 AS k FROM c a CROSS JOIN s JOIN c b ON b.r = a.r + i AND b.c = a.c + j),
p(r, c, d) USING KEY (r, c) AS (SELECT r, c, 0.0::DOUBLE FROM c WHERE r = 0 AND c = 0
 UNION SELECT n.r2, n.c2, n.d FROM (SELECT r2, c2, min(p.d + k) AS d FROM p JOIN e ON p.r = e.r AND p.c = e.c GROUP BY r2, c2) n LEFT JOIN recurring.p q ON q.r = n.r2 AND q.c = n.c2 WHERE q.d IS NULL OR n.d < q.d - 1e-12)"""


def _factor(f: str, digits: int = 4) -> str:
    return f"SELECT key, round(({f})::DOUBLE, {digits}) AS cost FROM ({LAYERS})"


def _levels(value: str, of: str, head: str = "") -> str:
    return f"""{head} SELECT bucket, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / (SELECT count({value}) FROM {of}), 4) AS pct FROM (SELECT unnest(range(5)) AS bucket) LEFT JOIN
 (SELECT CASE WHEN {value} < 2 THEN 0 WHEN {value} < 5 THEN 1 WHEN {value} < 20 THEN 2 WHEN {value} < 100 THEN 3 ELSE 4 END AS bucket, count(*) AS n FROM {of} WHERE {value} IS NOT NULL GROUP BY 1) USING (bucket)"""


def _quantiles(layer: str, of: str, lo: float, hi: float, median: float, most: float) -> str:
    q = ", ".join(f"round(quantile_cont({layer}, {p}), 4) AS {n}" for p, n in ((0.5, "median"), (0.95, "p95"), (0.99, "p99"), (0.999, "p999")))
    return f"""SELECT '{layer}' AS layer, count({layer}) AS n, round(100.0 * count(*) FILTER ({layer} IS NULL) / count(*), 4) AS nodata_pct, round(min({layer}), 4) AS lo, round(max({layer}), 4) AS hi, round(avg({layer}), 4) AS mean,
 {q}, count(*) FILTER ({layer} > {most}) AS n_extreme, round(100.0 * count(*) FILTER ({layer} > {most}) / count({layer}), 4) AS extreme_pct, min({layer}) BETWEEN {lo} AND {hi} AND max({layer}) <= {hi} AND quantile_cont({layer}, 0.5) <= {median} AS ok FROM ({of})"""


def _sliced(v: str, plus: str, minus: str, n: int) -> str:
    return f"CASE WHEN {v} >= 0 THEN '{plus}' ELSE '{minus}' END || lpad(abs(floor({v})::BIGINT)::VARCHAR, {n}, '0')"


RING = """SELECT s_suppkey * 7919 % 97 + 0.3::DOUBLE AS cx, s_suppkey * 104729 % h + 0.2::DOUBLE AS cy FROM supplier, (SELECT max(o_orderkey) // 100 + 1 AS h FROM orders)"""
CORNERS = ((-3.1, -1.2), (1.3, -2.4), (3.2, 1.1), (-1.4, 2.3), (-3.1, -1.2))
CROSS = " + ".join(
    f"CASE WHEN (cy + {ay} > y) <> (cy + {by} > y) AND x < ((cx + {bx}) - (cx + {ax})) * (y - (cy + {ay})) / ((cy + {by}) - (cy + {ay})) + (cx + {ax}) THEN 1 ELSE 0 END"
    for (ax, ay), (bx, by) in zip(CORNERS, CORNERS[1:], strict=False)
)

HIT = f"SELECT DISTINCT row, col FROM (SELECT row, col, col + 0.5 AS x, row + 0.5 AS y FROM g) JOIN p ON y BETWEEN cy - 2.5 AND cy + 2.5 AND x BETWEEN cx - 3.3 AND cx + 3.3 WHERE ({CROSS}) % 2 = 1"
ASPECT = "CASE WHEN e <> 0 OR n <> 0 THEN ((90 - degrees(atan2(-n, -e))) % 360 + 360) % 360 END"
#: What follows DISTANCE: the way back from the far end, cell by cell; w(id, n) counts its steps.
BACK = """, q AS (SELECT e.r2 * 100 + e.c2 AS id, arg_min(e.r * 100 + e.c, p.d + e.k) AS prev FROM p JOIN e ON p.r = e.r AND p.c = e.c GROUP BY 1),
w(id, n) AS (SELECT max(o_orderkey), 0 FROM orders UNION ALL SELECT prev, n + 1 FROM w JOIN q ON w.id = q.id WHERE w.id <> 0)"""
ALONG = f"""{DISTANCE}{BACK}, a AS (SELECT (SELECT max(n) FROM w) - n AS seq, id, id // 100 AS row, id % 100 AS col, o_totalprice::DOUBLE / 2e5 + 2499 AS z, 1 + o_totalprice::DOUBLE / 1e5 AS cost FROM w JOIN orders ON id = o_orderkey),
b AS (SELECT *, 0.5 * sqrt((row - lag(row) OVER o) * (row - lag(row) OVER o) + (col - lag(col) OVER o) * (col - lag(col) OVER o)) AS d2, z - lag(z) OVER o AS dz, greatest(abs(row - lag(row) OVER o), abs(col - lag(col) OVER o)) AS jump FROM a WINDOW o AS (ORDER BY seq)),
t AS (SELECT count(*) AS n_pixels, coalesce(sum(d2), 0) AS dist_2d_m, coalesce(sum(sqrt(d2 * d2 + dz * dz)), 0) AS dist_3d_m, coalesce(sum(greatest(dz, 0)), 0) AS dplus, coalesce(sum(greatest(-dz, 0)), 0) AS dminus, arg_min(z, seq) AS elev_start, arg_max(z, seq) AS elev_end,
 min(z) AS elev_min, max(z) AS elev_max, sum(cost) AS cost_total, avg(cost) AS cost_mean, quantile_cont(cost, 0.5) AS cost_median, 100.0 * count(*) FILTER ((row + col) % 3 = 0) / count(*) AS glacier_pct,
 coalesce(sum(d2 / 1000 / greatest(3.6 * exp(-3.5 * abs(dz / d2 + 0.05)), 0.01)), 0) AS time_h, arg_min(id, seq) AS first, arg_max(id, seq) AS last, coalesce(max(jump), 0) AS jump FROM b)"""
ROUNDED = """SELECT path, round_even(dist_2d_m, 0)::BIGINT AS distance_m, round_even(dist_2d_m / 1000, 2) AS distance_km, round_even(dplus, 0)::BIGINT AS dplus_m, round_even(dminus, 0)::BIGINT AS dminus_m, round_even(elev_min, 0)::BIGINT AS elev_min, round_even(elev_max, 0)::BIGINT AS elev_max,
 round_even(cost_total, 1) AS cost_total, round_even(time_h, 1) AS time_tobler_h, round_even(glacier_pct, 1) AS glacier_pct, n_pixels AS n_points"""
SQUARE = "SELECT s_suppkey AS id, s_name, s_acctbal::DOUBLE AS area, 6.84::DOUBLE + (s_suppkey % 100) / 1000::DOUBLE AS lon0, 45.88::DOUBLE + (s_suppkey // 100) / 1000::DOUBLE AS lat0 FROM supplier WHERE s_suppkey % 11 <> 0"


def _l93(points: str) -> str:
    """points(key, k, lon, lat, ...) with x and y in metres."""
    return f"""SELECT *, 700000 + rr * sin(t) AS x, 12655612.049876 - rr * cos(t) AS y FROM (SELECT *, 11754255.426096 * exp(-0.7256077650532670 * iso) AS rr, 0.7256077650532670 * radians(lon - 3) AS t FROM
 (SELECT *, ln(tan(pi() / 4 + radians(lat) / 2) * pow((1 - ecc * sin(radians(lat))) / (1 + ecc * sin(radians(lat))), ecc / 2)) AS iso FROM (SELECT *, {LAT_E} AS ecc FROM ({points}))))"""


VERTICES = _l93(f"SELECT id, s_name, area, k, lon0 + sx * 0.0002 AS lon, lat0 + sy * 0.0002 AS lat FROM ({SQUARE}) CROSS JOIN (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) c(k, sx, sy)")
IN_BOX = f"SELECT id, any_value(s_name) AS s_name, any_value(area) AS area, arg_min(x, k) AS x, arg_min(y, k) AS y FROM ({VERTICES}) GROUP BY id HAVING max(x) >= 1002000 AND min(x) <= 1008000 AND max(y) >= 6537000 AND min(y) <= 6543000"
#: ice_features() as vertices (id, part, ring, k, x, y) in Lambert-93, and their edges (ex, ey, fx, fy).
ICE_RINGS = ", ".join(f"({part}, {ring}, {k}, {x}, {y})" for part, ring, corners in ((0, 0, inputs.OUTER), (0, 1, inputs.HOLE), (1, 0, inputs.ISLE)) for k, (x, y) in enumerate(corners))
ICE_AT = "SELECT s_suppkey AS id, 6.84::DOUBLE + (s_suppkey * 7919 % 97) * 20 / 77500::DOUBLE AS lon0, 45.9::DOUBLE - (s_suppkey * 104729 % h) * 20 / 111150::DOUBLE AS lat0 FROM supplier, (SELECT max(o_orderkey) // 100 + 1 AS h FROM orders)"
ICE_VERTICES = _l93(f"SELECT id, part, ring, k, lon0 + dx::DOUBLE / 10000 AS lon, lat0 + dy::DOUBLE / 10000 AS lat FROM ({ICE_AT}) CROSS JOIN (VALUES {ICE_RINGS}) c(part, ring, k, dx, dy) WHERE part = 0 OR id % 3 = 0")
ICE_EDGES = f"WITH v AS ({ICE_VERTICES}), e AS (SELECT a.id, a.part, a.x AS ex, a.y AS ey, b.x AS fx, b.y AS fy FROM v a JOIN v b ON a.id = b.id AND a.part = b.part AND a.ring = b.ring AND b.k = a.k + 1)"
ODD = "count(*) FILTER ((ey > {y}) <> (fy > {y}) AND {x} < (fx - ex) * ({y} - ey) / (fy - ey) + ex) % 2 = 1"
BOXES = ", ".join(f"({k}, {inputs.ICE.xmin + a * 20 * inputs.ICE.res + 7}::DOUBLE, {inputs.ICE.ymax - b * 20 * inputs.ICE.res - 113}::DOUBLE, {w}::DOUBLE)" for k, (a, b, w) in enumerate(inputs.BOXES))
#: Which side of the line from (ex, ey) to (fx, fy) a point lies on.
SIDE = "sign(({bx} - {ax}) * ({y} - {ay}) - ({by} - {ay}) * ({x} - {ax}))"
PAIRS = "list_filter(string_split(coalesce(regexp_extract(url, '^[^?]*\\?(.*)$', 1), ''), '&'), lambda v: v <> '')"


def _degrees(points: str) -> str:
    """points(x, y, ...) in Lambert-93 with lon and lat."""
    d = f"SELECT *, 3 + degrees(atan((x - 700000) / (12655612.049876 - y)) / 0.7256077650532670) AS lon, -ln(sqrt((x - 700000) * (x - 700000) + (y - 12655612.049876) * (y - 12655612.049876)) / 11754255.426096) / 0.7256077650532670 AS iso, {LAT_E} AS ecc FROM ({points})"
    d = f"SELECT *, 2 * atan(exp(iso)) - pi() / 2 AS phi FROM ({d})"
    for _ in range(6):
        d = f"SELECT * EXCLUDE (phi), 2 * atan(exp(iso) * pow((1 + ecc * sin(phi)) / (1 - ecc * sin(phi)), ecc / 2)) - pi() / 2 AS phi FROM ({d})"
    return f"SELECT *, degrees(phi) AS lat FROM ({d})"


def _cut(px: str, py: str, qx: str, qy: str) -> str:
    """Whether the edge from a to b crosses the segment from p to q."""
    edge, line = (lambda x, y: SIDE.format(ax="ex", ay="ey", bx="fx", by="fy", x=x, y=y)), (lambda x, y: SIDE.format(ax=px, ay=py, bx=qx, by=qy, x=x, y=y))
    return f"({edge(px, py)} <> {edge(qx, qy)} AND {line('ex', 'ey')} <> {line('fx', 'fy')})"


DIAGONALS = f"{_cut('x0', 'y0', 'x1', 'y1')} OR {_cut('x0', 'y1', 'x1', 'y0')}"

SQL = {
    "slope_horn": f"{_neighbours(HOLES)} SELECT row, col, CASE WHEN NOT nodata THEN round({SLOPE}, 4) END AS slope FROM q",
    "aspect_horn": f"{_neighbours(HOLES)} SELECT row, col, CASE WHEN NOT nodata AND (e <> 0 OR n <> 0) THEN round(((90 - degrees(atan2(-n, -e))) % 360 + 360) % 360, 4) END AS aspect FROM q WHERE NOT (row = 0 AND col IN (0, 99))",
    "roughness_std3": f"{_neighbours(HOLES)} SELECT row, col, CASE WHEN NOT nodata THEN round({ROUGH}, 4) END AS roughness FROM q",
    "nodata_dilate": f"{_neighbours(HOLES)} SELECT row, col, nodata FROM q",
    "cost_slope": _factor(F_SLOPE, 2),
    "cost_altitude": _factor(F_ALTITUDE.format(rate=0.063)),
    "cost_altitude_acclimatized": _factor(F_ALTITUDE.format(rate=0.03)),
    "cost_aspect_summer": _factor(F_SUMMER),
    "cost_aspect_winter": _factor(F_WINTER),
    "cost_glacier": _factor(F_GLACIER),
    "cost_roughness": _factor(F_ROUGH),
    "cost_product": f"SELECT key, round({PRODUCT}, 2) AS cost, round(least(greatest({PRODUCT}, 0), 1e6), 2) AS routing_cost FROM ({SURFACE})",
    "cost_histogram": _levels("v", "w", f"{_neighbours(GRID)}, w AS (SELECT {F_SLOPE} AS v FROM (SELECT round({SLOPE}, 6) AS slope FROM q))"),
    "layer_stats": " UNION ALL ".join((_quantiles("slope", LAYERS, 0, 90, 75, 80), _quantiles("aspect", LAYERS, 0, 360, 360, 360), _quantiles("roughness", LAYERS, 0, 25, 5, 5))),
    "factor_stats": " UNION ALL ".join(f"SELECT '{f}' AS layer, count({f}) AS n, round(quantile_cont({f}, 0.5), 4) AS median, round(max({f}), 2) AS hi FROM ({SURFACE})" for f in ("f_slope", "f_altitude", "f_aspect", "f_glacier", "f_roughness")),
    "log_histogram": f"SELECT b.bin::INT AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(1, 80)) AS bin) b LEFT JOIN (SELECT CASE WHEN x = 4 THEN 79 ELSE floor(x / (4.0::DOUBLE / 79))::INT + 1 END AS bin, count(*) AS n FROM (SELECT log10(round({PRODUCT}, 6)) AS x FROM ({SURFACE})) WHERE x BETWEEN 0 AND 4 GROUP BY 1) f ON b.bin = f.bin",
    "glacier_area": f"SELECT n_glacier, round(pct, 4) AS pct, round(n_glacier * 0.25 / 1e6, 6) AS km2, pct < 1 AS too_small, pct > 50 AS too_large FROM (SELECT count(*) FILTER (glacier) AS n_glacier, 100.0 * count(*) FILTER (glacier) / count(*) AS pct FROM ({LAYERS}))",
    "dem_checks": f"SELECT count(z) AS n_valid, round(100.0 * count(*) FILTER (z IS NULL) / count(*), 4) AS nodata_pct, round(min(z), 4) AS lo, round(max(z), 4) AS hi, max(z) < 3000 AS low_top, min(z) < 0 AS below_sea, 100.0 * count(*) FILTER (z IS NULL) / count(*) > 50 AS sparse, false AS coarse FROM ({HOLES})",
    "bad_value_clean": "SELECT c_custkey AS key, CASE WHEN c_acctbal::DOUBLE >= -100 THEN round(c_acctbal::DOUBLE, 2) END AS z FROM customer",
    "project_l93": f"SELECT key, round(x, 3) AS x, round(y, 3) AS y FROM ({L93})",
    "world_to_pixel": f"SELECT *, row BETWEEN 0 AND 5999 AND col BETWEEN 0 AND 5999 AS in_grid FROM (SELECT key, round_even(6543000 - y, 0)::INT AS row, round_even(x - 1002000, 0)::INT AS col FROM ({L93}))",
    "pixel_to_world": f"SELECT row, col, 1002000.0::DOUBLE + col * 0.5 AS x, 6543000.0::DOUBLE - row * 0.5 AS y FROM ({GRID})",
    "l93_inverse": f"SELECT key, round(lon, 7) AS lon, round(lat, 7) AS lat FROM ({POINTS})",
    "mercator_inverse": f"SELECT row, col, round(degrees((760000.0 + col) / 6378137.0), 7) AS lon, round(degrees(2 * atan(exp((5750000.0 - row) / 6378137.0)) - pi() / 2), 7) AS lat FROM ({GRID})",
    "mosaic_first": f"""SELECT row, col, round(coalesce(CASE WHEN row >= 60 AND row % 60 < 30 AND (k % 2 = 0 OR (row * 100 + col) % 13 <> 0) THEN z + 0.25 * ((k + 1) % 2) END, CASE WHEN k % 2 = 1 OR (row * 100 + col) % 13 <> 0 THEN z + 0.25 * (k % 2) END), 4) AS z
 FROM (SELECT *, row // 60 AS k FROM ({GRID}))""",
    "resample_bilinear": f"""WITH g AS ({HOLES}), t AS (SELECT row // 2 AS r, col // 2 AS c, row AS r0, col AS c0 FROM g, (SELECT max(row) AS h FROM g) WHERE row % 2 = 0 AND col % 2 = 0 AND row // 2 < h // 2 AND col // 2 < 49)
 SELECT r AS row, c AS col, round(sum(w * z) / sum(w), 4) AS z FROM t CROSS JOIN (VALUES (0, 0, 0.5625::DOUBLE), (0, 1, 0.1875::DOUBLE), (1, 0, 0.1875::DOUBLE), (1, 1, 0.0625::DOUBLE)) o(i, j, w) JOIN g ON g.row = r0 + i AND g.col = c0 + j WHERE z IS NOT NULL GROUP BY r, c""",
    "warp_l93": f"""WITH g AS ({HOLES}), h AS (SELECT max(row) + 1 AS h FROM g), t AS (SELECT r, c, {inputs.METRES.xmin}::DOUBLE + (c + 0.5) * {inputs.METRES.res} AS x, {inputs.METRES.ymax}::DOUBLE - (r + 0.5) * {inputs.METRES.res} AS y
 FROM (SELECT unnest(range(h)) AS r FROM h), (SELECT unnest(range({inputs.METRES.width})) AS c)),
 p AS (SELECT r, c, ({inputs.DEGREES.ymax} - lat) / {inputs.DEGREES.res} - 0.5 AS fr, (lon - {inputs.DEGREES.xmin}) / {inputs.DEGREES.res} - 0.5 AS fc FROM ({_degrees("SELECT * FROM t")})),
 q AS (SELECT r, c, floor(fr) + i AS row, floor(fc) + j AS col, abs(1 - i - (fr - floor(fr))) * abs(1 - j - (fc - floor(fc))) AS w FROM p, h, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j) WHERE fr BETWEEN -0.5 AND h - 0.5 AND fc BETWEEN -0.5 AND 99.5)
 SELECT r::INT AS row, c::INT AS col, round(sum(w * z) / sum(w), 4) AS z FROM q JOIN g ON q.row = g.row AND q.col = g.col WHERE z IS NOT NULL AND w > 0 GROUP BY r, c""",
    "mosaic_tiles": f"""WITH g AS ({GRID}), h AS (SELECT max(row) AS h FROM g), t AS (SELECT k, (k * 7) % 13 * 1000 + k AS rank, 1000 + 3.25::DOUBLE * (k % 3) AS xmin, 5000 - 30 * k - 0.4::DOUBLE * (k % 4) AS ymax, CASE WHEN k % 3 = 1 THEN 1.5::DOUBLE ELSE 1 END AS res, least(40, h - 30 * k + 1) AS n
 FROM (SELECT unnest(range(h // 30 + 1)) AS k, h FROM h) WHERE k % 5 <> 4),
 b AS (SELECT min(xmin) AS x0, max(ymax) AS y0, arg_min(res, rank) AS res0, max(xmin + 100 * res) AS x1, min(ymax - n * res) AS y1 FROM t),
 p AS (SELECT r, c, x0 + (c + 0.5) * res0 AS x, y0 - (r + 0.5) * res0 AS y FROM b, (SELECT unnest(range(round_even((y0 - y1) / res0, 0)::INT)) AS r FROM b), (SELECT unnest(range(round_even((x1 - x0) / res0, 0)::INT)) AS c FROM b)),
 s AS (SELECT r, c, rank, k, floor((ymax - y) / res)::INT AS row, floor((x - xmin) / res)::INT AS col FROM p JOIN t ON x >= xmin AND x < xmin + 100 * res AND y <= ymax AND y > ymax - n * res)
 SELECT r::INT AS row, c::INT AS col, round(arg_min(z + k % 2, rank), 4) AS z FROM s JOIN g ON g.row = s.row + 30 * k AND g.col = s.col WHERE (g.row * 100 + g.col) % 11 <> 0 GROUP BY r, c""",
    "polygon_mask": f"WITH g AS ({GRID}), p AS ({RING}), hit AS ({HIT}) SELECT g.row, g.col, hit.row IS NOT NULL AS glacier FROM g LEFT JOIN hit ON g.row = hit.row AND g.col = hit.col",
    "crop_window": f"SELECT row, col - 10 AS col, round(z, 4) AS z FROM ({GRID}) WHERE row <= 90 AND col BETWEEN 10 AND 110",
    "tiled_window": f"SELECT row - 2 AS row, col - 40 AS col, round(z, 4) AS z FROM ({GRID}) WHERE row BETWEEN 2 AND 22 AND col BETWEEN 40 AND 60",
    "raster_files": f"SELECT row, col, round(z::FLOAT::DOUBLE, 2) AS z FROM ({HOLES}) WHERE col >= 10",
    "landed_tiles": f"SELECT least(64, 100 - c * 64)::INT AS width, least(64, h - r * 64)::INT AS height, round({inputs.XMIN} + c * 64 * {inputs.RES}, 4) AS xmin, round({inputs.YMAX} - r * 64 * {inputs.RES}, 4) AS ymax FROM (SELECT DISTINCT row // 64 AS r, col // 64 AS c FROM ({GRID})), (SELECT max(row) + 1 AS h FROM ({GRID}))",
    "hillshade": f"""WITH g AS (SELECT row, col, coalesce(z, 0) AS z FROM ({HOLES})), k AS (SELECT a.row, a.col, 2 * (coalesce(e.z, a.z) - coalesce(w.z, a.z)) / (0.5 * greatest(1, (e.z IS NOT NULL)::INT + (w.z IS NOT NULL)::INT)) AS ge,
 2 * (coalesce(s.z, a.z) - coalesce(n.z, a.z)) / (0.5 * greatest(1, (s.z IS NOT NULL)::INT + (n.z IS NOT NULL)::INT)) AS gs FROM g a LEFT JOIN g e ON e.row = a.row AND e.col = a.col + 1 LEFT JOIN g w ON w.row = a.row AND w.col = a.col - 1
 LEFT JOIN g s ON s.row = a.row + 1 AND s.col = a.col LEFT JOIN g n ON n.row = a.row - 1 AND n.col = a.col),
 l AS (SELECT row, col, (-ge * cos(radians(-225)) * cos(radians(45)) + gs * sin(radians(-225)) * cos(radians(45)) + sin(radians(45))) / sqrt(ge * ge + gs * gs + 1) AS light FROM k)
 SELECT row, col, round(least(greatest((light - lo) / (hi - lo), 0), 1), 4) AS shade FROM l, (SELECT min(light) AS lo, max(light) AS hi FROM l)""",
    "roughness_display": f"SELECT key, CASE WHEN slope > 10 THEN round(least(greatest(roughness * 3 - 5, 0), 10), 4) END AS roughness FROM ({LAYERS})",
    "terrain_cost": f"""{_neighbours(HOLES)}, p AS ({RING}), hit AS ({HIT}), l AS (SELECT q.row, q.col, CASE WHEN NOT nodata THEN {SLOPE} END AS slope, CASE WHEN NOT nodata THEN {ASPECT} END AS aspect, CASE WHEN NOT nodata THEN {ROUGH} END AS roughness,
 coalesce(g.z, 0) AS z, hit.row IS NOT NULL AS glacier FROM q JOIN g ON q.row = g.row AND q.col = g.col LEFT JOIN hit ON q.row = hit.row AND q.col = hit.col)
 SELECT row, col, glacier, CASE WHEN slope IS NOT NULL THEN round(({F_SLOPE}) * ({F_ALTITUDE.format(rate=0.063)}) * ({F_SUMMER}) * ({F_GLACIER}) * ({F_ROUGH}), 0) END AS cost FROM l""",
    "stream_cost": f"SELECT key, round({PRODUCT}, 2) AS cost FROM ({SURFACE})",
    "route_rounded": f"{ROUNDED} FROM ({STATS})",
    "route_geojson": f"""SELECT path, 'FeatureCollection' AS type, 'track' AS name, distance_m, distance_km, dplus_m, dminus_m, cost_total, time_tobler_h, glacier_pct, 10.0::DOUBLE AS resolution_m, 'EPSG:2154' AS crs, n_points::INT AS n, 10.0 * n_points::DOUBLE AS last_x, 0.0::DOUBLE AS first_y
 FROM ({ROUNDED} FROM ({STATS}))""",
    "track_gpx": f"SELECT path::BIGINT AS path, 0 AS segment, seq::INT - 1 AS seq, round(45.85::DOUBLE + seq / 10000::DOUBLE, 7) AS lat, round(6.84::DOUBLE + path / 1000::DOUBLE, 7) AS lon, round(z, 4) AS ele FROM ({TRACKS})",
    "route_path": f"{DISTANCE}{BACK} SELECT (SELECT max(n) FROM w) - n AS seq, id // 100 AS row, id % 100 AS col, round(d, 4) AS d FROM w JOIN p ON p.r = id // 100 AND p.c = id % 100",
    "route_report": f"{ALONG} SELECT n_pixels, {', '.join(f'round({c}, 4) AS {c}' for c in ('dist_2d_m', 'dist_3d_m', 'dplus', 'dminus', 'elev_start', 'elev_end', 'elev_min', 'elev_max', 'cost_total', 'cost_mean', 'cost_median', 'glacier_pct', 'time_h'))} FROM t",
    "route_checks": f"""{ALONG} SELECT n_pixels > 0 AS not_empty, first = 0 AS starts, last = (SELECT max(o_orderkey) FROM orders) AS ends, jump <= 1 AS continuous, 0::BIGINT AS n_impassable, dist_2d_m > 3000 AND dist_2d_m < 20000 AS plausible_length, dplus > 500 AND dplus < 3000 AS plausible_climb FROM t""",
    "polygon_file": f"SELECT id, s_name AS name, 5 AS n, round(x, 2) AS x, round(y, 2) AS y FROM ({IN_BOX}) WHERE id % 3 <> 0 AND id % 7 <> 0 AND s_name <> ''",
    "ice_mask": f"""{ICE_EDGES}, g AS (SELECT row, col, {inputs.ICE.xmin}::DOUBLE + (col + 0.5) * {inputs.ICE.res} AS x, {inputs.ICE.ymax}::DOUBLE - (row + 0.5) * {inputs.ICE.res} AS y FROM ({GRID})),
 b AS (SELECT id, part, min(ex) AS x0, max(ex) AS x1, min(ey) AS y0, max(ey) AS y1 FROM e GROUP BY id, part),
 n AS (SELECT row, col, g.x, g.y, id, part FROM g JOIN b ON g.x BETWEEN x0 AND x1 AND g.y BETWEEN y0 AND y1),
 hit AS (SELECT DISTINCT row, col FROM (SELECT row, col FROM n JOIN e ON n.id = e.id AND n.part = e.part GROUP BY row, col, n.id, n.part HAVING {ODD.format(x="any_value(x)", y="any_value(y)").replace("any_value(x)", "x").replace("any_value(y)", "y")}))
 SELECT g.row, g.col, hit.row IS NOT NULL AS glacier FROM g LEFT JOIN hit ON g.row = hit.row AND g.col = hit.col""",
    "polygon_box": f"""{ICE_EDGES}, b(box, x0, y0, w) AS (VALUES {BOXES}), c AS (SELECT box, x0, y0, x0 + w AS x1, y0 + w AS y1 FROM b),
 p AS (SELECT box, id, part, bool_or(ex BETWEEN x0 AND x1 AND ey BETWEEN y0 AND y1 OR {DIAGONALS}) OR {ODD.format(x="x0", y="y0")} AS met FROM e, c GROUP BY box, id, part)
 SELECT DISTINCT id, box::INT AS box FROM p WHERE met""",
    "polygon_area": f"SELECT round(coalesce(sum(area), 0), 2) AS area FROM ({IN_BOX})",
    "route_groups": """SELECT activity, global_rating, count(*) AS n, max(2000 + p_size * 10)::INT AS highest, round(avg(p_size * 20), 4) AS climb
 FROM (SELECT p_size, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS global_rating, unnest(CASE WHEN p_partkey % 4 = 0 THEN [NULL] WHEN p_partkey % 4 = 1 THEN ['hiking'] ELSE ['hiking', 'skitouring'] END) AS activity FROM part) GROUP BY ALL""",
    "grid_metadata": f"""SELECT xmin, ymax, 0.75::DOUBLE AS res, round_even((xmax - xmin) / 0.75, 0)::INT AS width, round_even((ymax - ymin) / 0.75, 0)::INT AS height, 'EPSG:2154' AS crs, -9999.0::DOUBLE AS nodata
 FROM (SELECT min(round(x, 3)) AS xmin, max(round(x, 3)) AS xmax, min(round(y, 3)) AS ymin, max(round(y, 3)) AS ymax FROM ({L93}))""",
    "simplify_dp": f"""WITH RECURSIVE t AS (SELECT path, seq, 10::DOUBLE * seq AS x, z AS y FROM ({TRACKS})),
 l(path, a, b) AS (SELECT path, min(seq), max(seq) FROM t GROUP BY path UNION ALL
 SELECT path, unnest([a, m]), unnest([m, b]) FROM (SELECT l.path, l.a, l.b, arg_max(v.seq, {{'far': abs((q.x - p.x) * (v.y - p.y) - (q.y - p.y) * (v.x - p.x)) / sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)), 'first': -v.seq}}) AS m,
 max(abs((q.x - p.x) * (v.y - p.y) - (q.y - p.y) * (v.x - p.x)) / sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y))) AS far
 FROM l JOIN t p ON p.path = l.path AND p.seq = l.a JOIN t q ON q.path = l.path AND q.seq = l.b JOIN t v ON v.path = l.path AND v.seq > l.a AND v.seq < l.b GROUP BY l.path, l.a, l.b) WHERE far > 5)
 SELECT path, seq, x, y FROM t SEMI JOIN (SELECT path, a AS seq FROM l UNION SELECT path, b FROM l) k USING (path, seq)""",
    "route_geojson_3d": f"""SELECT r.path, elev_min, elev_max, n_points, 'EPSG:4326' AS crs, 'simplified' AS variant, round(lon, 7) AS lon, round(lat, 7) AS lat, z
 FROM ({ROUNDED} FROM ({STATS})) r JOIN ({_degrees(f"SELECT path, {inputs.XMIN}::DOUBLE + 10 * seq AS x, {inputs.YMAX}::DOUBLE AS y, round(z, 1) AS z FROM ({TRACKS}) WHERE seq = 1")}) f ON f.path = r.path""",
    "path_segments": f"SELECT path, seq, dx, round(dz, 4) AS dz, dx AS d2, round(sqrt(dx * dx + dz * dz), 4) AS d3, round(degrees(atan2(abs(dz), dx)), 4) AS slope FROM ({STEPS})",
    "path_cumdist": f"SELECT path, seq, 10.0 * (seq - 1) AS dist, 10.0 * (seq - 1) + 5 AS mid FROM (SELECT *, count(*) OVER (PARTITION BY path) AS n FROM ({TRACKS})) WHERE seq < n",
    "path_stats": f"SELECT path, n_pixels, {', '.join(f'round({c}, 6) AS {c}' for c in ('dist_2d_m', 'dist_3d_m', 'dplus', 'dminus', 'elev_start', 'elev_end', 'elev_min', 'elev_max', 'cost_total', 'cost_mean', 'cost_median', 'glacier_pct', 'time_h'))}, top_seq FROM ({STATS})",
    "path_checks": f"SELECT path, n_pixels > 0 AS not_empty, far <= 10 AS continuous, dist_2d_m > 3000 AND dist_2d_m < 20000 AS plausible_length, dplus > 500 AND dplus < 3000 AS plausible_climb FROM ({STATS}) JOIN (SELECT path AS p, coalesce(max(dx), 0) AS far FROM ({STEPS}) GROUP BY path) ON path = p",
    "cost_distance": f"{DISTANCE} SELECT r AS row, c AS col, round(d, 4) AS d FROM p",
    "route_cost": f"{DISTANCE} SELECT round(d, 4) AS cost FROM p WHERE r * 100 + c = (SELECT max(o_orderkey) FROM orders)",
    "tile_request": f"""WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages WHERE url IS NOT NULL),
 b AS (SELECT page_id, u || CASE WHEN contains(u, '?') THEN '&' ELSE '?' END || 'WIDTH=1&a%20b=c+d*~&page=9&page=8&height=2' AS url, CASE WHEN page_id % 5 <> 0 THEN page_id % 7 * 500 + 500 ELSE 1000 END AS w, CASE WHEN page_id % 5 <> 0 THEN page_id % 11 * 250 + 250 ELSE 1000 END AS h FROM p),
 c AS (SELECT page_id, url, round_even(w / 0.75::DOUBLE, 0)::INT AS width, round_even(h / 0.75::DOUBLE, 0)::INT AS height, {PAIRS} AS parts FROM b),
 d AS (SELECT page_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS part FROM c),
 e AS (SELECT page_id, i, url_decode(replace(string_split(part, '=')[1], '+', ' ')) AS k, url_decode(replace(regexp_replace(part, '^[^=]*=?', ''), '+', ' ')) AS v FROM d),
 f AS (SELECT *, row_number() OVER (PARTITION BY page_id, k ORDER BY i) AS nth FROM e),
 z AS (SELECT page_id, string_agg(replace(url_encode(k), '%20', '+') || '=' || CASE WHEN k = 'WIDTH' THEN width::VARCHAR ELSE replace(url_encode(v), '%20', '+') END, '&' ORDER BY i) AS query FROM f JOIN c USING (page_id) WHERE nth = 1 GROUP BY page_id)
 SELECT page_id, string_split(url, '?')[1] || '?' || query || '&HEIGHT=' || height AS url, width, height FROM c JOIN z USING (page_id)""",
    "tile_name": f"SELECT key, 'Copernicus_DSM_COG_10_' || {_sliced('lat', 'N', 'S', 2)} || '_00_' || {_sliced('lon', 'E', 'W', 3)} || '_00_DEM' AS tile FROM (SELECT c_custkey AS key, c_acctbal::DOUBLE / 200 AS lat, c_acctbal::DOUBLE / 60 - 5 AS lon FROM customer)",
    "missing_tiles": "SELECT 't' || o_custkey AS name, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)",
}
