"""The catalogue of queries, and their SQL for the independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import algebra as A
from ..operators import depressions as D
from ..operators import hydrology as H
from ..operators import inundation as I
from ..operators import network as N
from ..operators import rating as R
from ..operators import terrain as T
from ..operators import vector as V
from ..operators.graph import cut
from ..operators.grid import cell_id, rowcol_of, xy_of
from ..schema import Grid
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def _r(c: str, n: int = 6):
    return F.round(F.col(c) + F.lit(0.0), n).alias(c)


# --- map algebra


@query(_with(X.CELL, X.HOLED) + "SELECT r AS row, c AS col, z AS value FROM holed")
def nodata_decode(spark, sf):
    coded = X.holed(spark, sf).select("row", "col", A.encode_nodata(F.col("value")).alias("value"))
    return coded.select("row", "col", A.decode_nodata(F.col("value")).alias("value"))


@query(_with(X.CELL, X.HOLED) + "SELECT a.r AS row, a.c AS col, CASE WHEN b.z IS NOT NULL THEN a.z END AS value FROM cell a LEFT JOIN holed b ON a.r = b.r AND a.c = b.c")
def mask_by_raster(spark, sf):
    return A.mask_by(X.cell(spark, sf).select("row", "col", "value"), X.holed(spark, sf))


@query(_with(X.CELL) + "SELECT r AS row, c AS col, CASE WHEN z * 60 BETWEEN -10 AND 10 THEN z * 60 END AS value FROM cell")
def range_to_null(spark, sf):
    return X.cell(spark, sf).select("row", "col", A.within(F.col("value") * 60, -10, 10).alias("value"))


@query(_with(X.CELL) + "SELECT r AS row, c AS col, round(CASE WHEN z > 0 THEN ln(z) END, 9) AS value FROM cell")
def log_scale(spark, sf):
    return X.cell(spark, sf).select("row", "col", F.round(A.log(F.col("value")), 9).alias("value"))


@query(_with(X.CELL, X.HOLED) + "SELECT r AS row, c AS col, round((z - (SELECT min(z) FROM holed)) / (SELECT max(z) - min(z) FROM holed), 9) AS value FROM holed")
def minmax_scale(spark, sf):
    return A.minmax_scale(X.holed(spark, sf).select("row", "col", "value")).select("row", "col", _r("value", 9))


def _layers(spark, sf):
    return X.hand(spark, sf).select("row", "col", F.col("hand").alias("a"), F.col("slope").alias("b"))


@query(_with(X.CELL, X.HAND) + "SELECT r AS row, c AS col, round(0.5e0 * hand + 2e0 * slope, 6) AS value FROM hand")
def combined_cost(spark, sf):
    return _layers(spark, sf).select("row", "col", F.round(A.combined_cost([(0.5, F.col("a")), (2.0, F.col("b")), (1.0, None)], as_sum=True), 6).alias("value"))


_COST = "cost AS (SELECT r, c, 1e0 / (0.5e0 * hand + 2e0 * slope) AS v FROM hand)"


@query(_with(X.CELL, X.HAND, _COST) + "SELECT r AS row, c AS col, round(v, 6) AS value FROM cost")
def combined_cost_reciprocal(spark, sf):
    return _layers(spark, sf).select("row", "col", F.round(A.combined_cost([(0.5, F.col("a")), (2.0, F.col("b"))]), 6).alias("value"))


@query(_with(X.CELL, X.HAND, _COST) + "SELECT r AS row, c AS col, round(CASE WHEN v < (SELECT quantile_cont(v, 0.025) FROM cost) THEN v ELSE 100000e0 END, 6) AS value FROM cost")
def cost_quantile_threshold(spark, sf):
    cost = _layers(spark, sf).select("row", "col", A.combined_cost([(0.5, F.col("a")), (2.0, F.col("b"))]).alias("value"))
    return A.keep_cheapest(cost).select("row", "col", _r("value"))


@query(_with(X.CELL) + "SELECT r AS row, c AS col, CASE WHEN abs(z) < 0.1e0 THEN 1e0 ELSE abs(z) END AS value FROM cell")
def clamp_low_cost(spark, sf):
    return X.cell(spark, sf).select("row", "col", A.clamp_low(F.abs("value"), 0.1).alias("value"))


@query(_with(X.CELL, X.HOLED) + "SELECT r AS row, c AS col, coalesce(z, 0) AS value FROM holed")
def null_to_zero(spark, sf):
    return X.holed(spark, sf).select("row", "col", F.coalesce("value", F.lit(0.0)).alias("value"))


@query(_with(X.CELL, X.HOLED) + "SELECT count(z) AS n, round(avg(z), 9) AS mean, round(stddev_pop(z), 9) AS std, min(z) AS low, max(z) AS high, round(quantile_cont(z, 0.001), 9) AS p001, round(quantile_cont(z, 0.999), 9) AS p999 FROM holed")
def raster_statistics(spark, sf):
    return A.statistics(X.holed(spark, sf)).select("n", _r("mean", 9), _r("std", 9), "low", "high", _r("p001", 9), _r("p999", 9))


@query(_with(X.CELL) + "SELECT r AS row, c AS col, c + 0.5e0 AS x, -(r + 0.5e0) AS y, r AS row2, c AS col2 FROM cell")
def xy_rowcol_roundtrip(spark, sf):
    g = X.grid(spark, sf)
    x, y = xy_of(g)
    at = X.cell(spark, sf).select("row", "col", x.alias("x"), y.alias("y"))
    row, col = rowcol_of(g, F.col("x"), F.col("y"))
    return at.withColumns({"row2": row, "col2": col})


# --- terrain


def _grad(table: str, value: str = "z", by: str = "") -> str:
    keep = f", {by}" if by else ""
    return (
        f"SELECT r, c, {value}{keep}, CASE WHEN r = 0 THEN s - {value} WHEN r = (SELECT h FROM dim) - 1 THEN {value} - n ELSE (s - n) / 2 END AS gy, "
        f"CASE WHEN c = 0 THEN e - {value} WHEN c = 63 THEN {value} - w ELSE (e - w) / 2 END AS gx FROM "
        f"(SELECT *, lag({value}) OVER (PARTITION BY c ORDER BY r) AS n, lead({value}) OVER (PARTITION BY c ORDER BY r) AS s, lag({value}) OVER (PARTITION BY r ORDER BY c) AS w, lead({value}) OVER (PARTITION BY r ORDER BY c) AS e FROM {table})"
    )


def _slope_sql(table: str) -> str:
    return _with(X.CELL, X.HOLED, X.DIM, f"g AS ({_grad(table)})") + "SELECT r AS row, c AS col, round(CASE WHEN z IS NOT NULL THEN sqrt(gx * gx + gy * gy) END, 9) AS value FROM g"


@query(_slope_sql("cell"))
def slope(spark, sf):
    return T.slope(X.cell(spark, sf), X.grid(spark, sf)).select("row", "col", _r("value", 9))


@query(_slope_sql("holed"))
def slope_nodata(spark, sf):
    return T.slope(X.holed(spark, sf), X.grid(spark, sf)).select("row", "col", _r("value", 9))


@query(_with(X.CELL, X.HOLED, X.DIM, f"g AS ({_grad('holed')})") + "SELECT r AS row, c AS col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS value FROM g WHERE z IS NOT NULL")
def slope_degrees(spark, sf):
    return T.slope(X.holed(spark, sf), X.grid(spark, sf)).join(X.holed(spark, sf).where(F.col("value").isNotNull()).select("row", "col"), ["row", "col"]).select("row", "col", F.round(A.degrees_of(F.col("value")), 6).alias("value"))


def _curvature_sql(unit: str) -> str:
    return (
        _with(X.CELL, X.HOLED, X.DIM, f"g AS ({_grad('holed')})", f"u AS (SELECT r, c, z, gx / {unit} AS ux, gy / {unit} AS uy FROM g)", f"a AS ({_grad('u', 'ux')})", f"b AS ({_grad('u', 'uy')})")
        + "SELECT u.r AS row, u.c AS col, round(CASE WHEN u.z IS NOT NULL THEN coalesce(a.gx + b.gy, 0) END, 6) AS value FROM u JOIN a ON a.r = u.r AND a.c = u.c JOIN b ON b.r = u.r AND b.c = u.c"
    )


@query(_curvature_sql("nullif(sqrt(gx * gx + gy * gy), 0)"))
def curvature_geometric(spark, sf):
    return T.curvature(X.holed(spark, sf), X.grid(spark, sf)).select("row", "col", _r("value"))


@query(_curvature_sql("1"))
def curvature_laplacian(spark, sf):
    return T.curvature(X.holed(spark, sf), X.grid(spark, sf), "laplacian").select("row", "col", _r("value"))


@query(
    _with(X.CELL, X.DIM, f"g AS ({_grad('cell')})", "m AS (SELECT sqrt(gx * gx + gy * gy) AS v FROM g)", "n AS (SELECT count(v) AS n FROM m)", "o AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM m)", "p AS (SELECT n * 0.9e0 + 0.4e0 + 0.9e0 * 0.2e0 AS p FROM n)")
    + "SELECT round((SELECT v FROM o WHERE i = floor(p)) + (p - floor(p)) * ((SELECT v FROM o WHERE i = floor(p) + 1) - (SELECT v FROM o WHERE i = floor(p))), 9) AS value FROM p"
)
def edge_threshold_mquantile(spark, sf):
    return spark.createDataFrame([(T.edge_threshold(X.cell(spark, sf), X.grid(spark, sf)),)], "value double").select(_r("value", 9))


def _diffusion_sql(flux: str) -> str:
    """Three iterations; flux is an expression of d."""
    steps, table = [], "holed"
    f = lambda d: flux.replace("d", f"({d})")
    for k in range(3):
        near = "SELECT r, c, z, lag(z) OVER (PARTITION BY c ORDER BY r) AS n, lead(z) OVER (PARTITION BY c ORDER BY r) AS s, lag(z) OVER (PARTITION BY r ORDER BY c) AS w, lead(z) OVER (PARTITION BY r ORDER BY c) AS e FROM " + table
        flow = f"SELECT r, c, z, (CASE WHEN r = (SELECT h FROM dim) - 1 THEN 0 ELSE {f('s - z')} END) - (CASE WHEN r = 0 THEN 0 ELSE {f('z - n')} END) AS ns, (CASE WHEN c = 63 THEN 0 ELSE {f('e - z')} END) - (CASE WHEN c = 0 THEN 0 ELSE {f('z - w')} END) AS ew FROM ({near})"
        steps.append(f"i{k} AS (SELECT r, c, z + 0.1e0 * CASE WHEN ns IS NULL AND ew IS NULL THEN NULL ELSE coalesce(ns, 0) + coalesce(ew, 0) END AS z FROM ({flow}))")
        table = f"i{k}"
    return _with(X.CELL, X.HOLED, X.DIM, *steps) + "SELECT r AS row, c AS col, round(z, 9) AS value FROM i2"


@query(_diffusion_sql("d / (1 + (d / 0.2e0) * (d / 0.2e0))"))
def diffusion_pm2_3it(spark, sf):
    return T.diffuse(X.holed(spark, sf), X.grid(spark, sf), 0.2, 3).select("row", "col", _r("value", 9))


@query(_diffusion_sql("d * exp(-(d / 0.2e0) * (d / 0.2e0))"))
def diffusion_pm1_3it(spark, sf):
    return T.diffuse(X.holed(spark, sf), X.grid(spark, sf), 0.2, 3, method="PeronaMalik1").select("row", "col", _r("value", 9))


@query(_diffusion_sql("d"))
def diffusion_linear_3it(spark, sf):
    return T.diffuse(X.holed(spark, sf), X.grid(spark, sf), 0.2, 3, method="linear").select("row", "col", _r("value", 9))


@query(_diffusion_sql("d / (1 + (d / 0.2e0) * (d / 0.2e0))"))
def diffusion_tiled(spark, sf):
    return T.diffuse_tiled(X.holed(spark, sf), X.grid(spark, sf), 0.2, 3, size=100).select("row", "col", _r("value", 9))


@query()
def nonlinear_filter(spark, sf):
    g = X.grid(spark, sf)
    cells = X.cell(spark, sf)
    return T.diffuse_tiled(cells, g, T.edge_threshold(cells, g, 0.9), 50, 0.1)


# --- flow

_NEAR = (
    "nb AS (SELECT * FROM (VALUES (0, -1, 1, 1), (1, 0, 1, 2), (2, 1, 1, 4), (3, 1, 0, 8), (4, 1, -1, 16), (5, 0, -1, 32), (6, -1, -1, 64), (7, -1, 0, 128)) t(k, dr, dc, code))"
)


def _d8_sql(table: str) -> str:
    return (
        f"drop_ AS (SELECT a.r, a.c, nb.k, nb.code, b.r * 64 + b.c AS dst, (a.z - b.z) / CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2e0) ELSE 1e0 END AS s FROM {table} a CROSS JOIN nb JOIN {table} b ON b.r = a.r + nb.dr AND b.c = a.c + nb.dc WHERE a.z > b.z), "
        "best AS (SELECT r, c, code, dst FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY s DESC, k) AS p FROM drop_) WHERE p = 1), "
        f"d8 AS (SELECT a.r, a.c, a.r * 64 + a.c AS id, CASE WHEN a.z IS NULL THEN NULL ELSE coalesce(b.code, 0) END AS code, coalesce(b.dst, a.r * 64 + a.c) AS dst FROM {table} a LEFT JOIN best b ON a.r = b.r AND a.c = b.c)"
    )


def _d8(spark, sf):
    g = X.grid(spark, sf)
    return g, cut(H.d8_pointer(X.holed(spark, sf), g))


@query(_with(X.CELL, X.HOLED, _NEAR, _d8_sql("holed")) + "SELECT r AS row, c AS col, CAST(code AS INTEGER) AS value FROM d8")
def d8_pointer(spark, sf):
    return H.d8_pointer(X.holed(spark, sf), X.grid(spark, sf))


@query(_with(X.CELL, X.HOLED, _NEAR, _d8_sql("holed")) + "SELECT r AS row, c AS col, CASE WHEN code IS NULL THEN NULL WHEN code = 0 THEN 1 ELSE 0 END AS value FROM d8")
def outlets(spark, sf):
    return H.outlets(_d8(spark, sf)[1])


_WALK = "walk AS (SELECT id, id AS root FROM d8 WHERE code = 0 UNION ALL SELECT d.id, w.root FROM walk w JOIN d8 d ON d.dst = w.id AND d.code <> 0), num AS (SELECT id AS root, row_number() OVER (ORDER BY id) AS label FROM d8 WHERE code = 0)"


def _rec(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


@query(_rec(X.CELL, X.HOLED, _NEAR, _d8_sql("holed"), _WALK) + "SELECT w.id // 64 AS row, w.id % 64 AS col, n.label AS value FROM walk w JOIN num n ON n.root = w.root")
def basins(spark, sf):
    g, d8 = _d8(spark, sf)
    return H.basins(d8, g)


@query(_rec(X.CELL, X.HOLED, _NEAR, _d8_sql("holed"), _WALK) + "SELECT n.label AS basin, count(*) AS cells FROM walk w JOIN num n ON n.root = w.root GROUP BY 1")
def basin_sizes(spark, sf):
    g, d8 = _d8(spark, sf)
    return H.basins(d8, g).groupBy(F.col("value").alias("basin")).agg(F.count("*").alias("cells"))


@query(_rec(X.CELL, X.HOLED, _NEAR, _d8_sql("holed"), _WALK) + "SELECT (w.root // 64) AS row, w.root % 64 AS col, n.label AS basin, count(*) AS cells FROM walk w JOIN num n ON n.root = w.root GROUP BY 1, 2, 3 HAVING count(*) > 2 AND count(*) * 100.00001e0 / (SELECT count(*) FROM cell) > 0.05e0")
def fmm_start_points(spark, sf):
    g, d8 = _d8(spark, sf)
    return N.travel_starts(cut(H.basins(d8, g)), H.outlets(d8), g, area_percent=0.05)


@query(_rec(X.CELL, X.HOLED, _NEAR, _d8_sql("holed"), "up AS (SELECT id, id AS pos FROM d8 WHERE code IS NOT NULL UNION ALL SELECT u.id, d.dst FROM up u JOIN d8 d ON d.id = u.pos WHERE d.code <> 0)") + "SELECT pos // 64 AS row, pos % 64 AS col, CAST(count(*) AS DOUBLE) AS value FROM up GROUP BY pos")
def flow_accumulation_d8(spark, sf):
    g, d8 = _d8(spark, sf)
    return H.accumulation_d8(d8, g)


_POUR = "pour AS (SELECT id, id % 97 AS label FROM d8 WHERE code IS NOT NULL AND id % 13 = 0)"
_DOWN = "down AS (SELECT id, id AS at, 0 AS n FROM d8 WHERE code IS NOT NULL UNION ALL SELECT w.id, d.dst, n + 1 FROM down w JOIN d8 d ON d.id = w.at WHERE d.code <> 0 AND w.at NOT IN (SELECT id FROM pour))"


@query(_rec(X.CELL, X.HOLED, _NEAR, _d8_sql("holed"), _POUR, _DOWN) + "SELECT w.id // 64 AS row, w.id % 64 AS col, max(p.label) AS value FROM down w LEFT JOIN pour p ON p.id = w.at GROUP BY w.id")
def segment_catchments(spark, sf):
    g, d8 = _d8(spark, sf)
    pour = d8.select("row", "col", F.when((cell_id(g) % 13 == 0) & F.col("value").isNotNull(), cell_id(g) % 97).alias("value"))
    return H.watershed(d8, pour, g)


@query(_rec(X.CELL, X.HOLED, _NEAR, _d8_sql("holed"), _POUR, _DOWN, "beds AS (SELECT w.id, max(h.z) AS bed FROM down w JOIN pour p ON p.id = w.at JOIN holed h ON h.r * 64 + h.c = p.id GROUP BY w.id)") + "SELECT h.r AS row, h.c AS col, round(h.z - b.bed, 9) AS value FROM holed h LEFT JOIN beds b ON b.id = h.r * 64 + h.c")
def hand_d8(spark, sf):
    g, d8 = _d8(spark, sf)
    streams = d8.select("row", "col", F.when((cell_id(g) % 13 == 0) & F.col("value").isNotNull(), 1).alias("value"))
    return H.height_above_drainage(X.holed(spark, sf).select("row", "col", "value"), d8, streams, g).select("row", "col", _r("value", 9))


_EDGE = "(r = 0 OR c = 0 OR c = 63 OR r = (SELECT h FROM dim) - 1 OR EXISTS (SELECT 1 FROM holed x WHERE x.z IS NULL AND abs(x.r - a.r) <= 1 AND abs(x.c - a.c) <= 1))"
_FILL = (
    f"seed AS MATERIALIZED (SELECT r * 64 + c AS id, z AS w FROM holed a WHERE z IS NOT NULL AND {_EDGE}), "
    "near AS MATERIALIZED (SELECT a.r * 64 + a.c AS src, b.r * 64 + b.c AS dst, b.z FROM holed a CROSS JOIN nb JOIN holed b ON b.r = a.r + dr AND b.c = a.c + dc WHERE a.z IS NOT NULL AND b.z IS NOT NULL), "
    "fill(id, w) USING KEY (id) AS (SELECT id, w FROM seed UNION SELECT n.dst, min(greatest(n.z, f.w)) FROM fill f JOIN near n ON n.src = f.id LEFT JOIN recurring.fill o ON o.id = n.dst WHERE o.w IS NULL OR greatest(n.z, f.w) < o.w GROUP BY n.dst)"
)


@query(_rec(X.CELL, X.HOLED, X.DIM, _NEAR, _FILL) + "SELECT id // 64 AS row, id % 64 AS col, round(w, 9) AS value FROM fill UNION ALL SELECT r, c, NULL FROM holed WHERE z IS NULL")
def fill_depressions(spark, sf):
    return H.fill_depressions(X.holed(spark, sf), X.grid(spark, sf)).select("row", "col", _r("value", 9))


_FLAT = (
    "flat AS MATERIALIZED (SELECT id // 64 AS r, id % 64 AS c, w AS z FROM fill), "
    + _d8_sql("flat")
    + ", far(id, n) USING KEY (id) AS (SELECT id, 0 FROM d8 WHERE code > 0 OR r IN (0, 39) OR c IN (0, 63) UNION SELECT d.id, min(f.n + 1) FROM far f JOIN flat a ON a.r * 64 + a.c = f.id CROSS JOIN nb JOIN flat b ON b.r = a.r + dr AND b.c = a.c + dc AND b.z = a.z JOIN d8 d ON d.id = b.r * 64 + b.c LEFT JOIN recurring.far o ON o.id = d.id WHERE o.n IS NULL OR f.n + 1 < o.n GROUP BY d.id), "
    "way AS (SELECT a.r * 64 + a.c AS id, arg_min(nb.code, nb.k) AS code FROM flat a JOIN far fa ON fa.id = a.r * 64 + a.c AND fa.n > 0 CROSS JOIN nb JOIN flat b ON b.r = a.r + dr AND b.c = a.c + dc AND b.z = a.z JOIN far fb ON fb.id = b.r * 64 + b.c AND fb.n = fa.n - 1 GROUP BY 1)"
)


@query(_rec(X.CELL, "holed AS MATERIALIZED (SELECT r, c, round(z * 8e0) / 8e0 AS z FROM cell WHERE r < 40)", "dim AS (SELECT 40 AS h)", _NEAR, _FILL, _FLAT) + "SELECT d.r AS row, d.c AS col, CAST(CASE WHEN d.code = 0 THEN coalesce(w.code, 0) ELSE d.code END AS INTEGER) AS value FROM d8 d LEFT JOIN way w ON w.id = d.id")
def d8_over_flats(spark, sf):
    g, dem = X.small(spark, sf)
    filled = cut(H.fill_depressions(dem.select("row", "col", (F.rint(F.col("value") * 8) / 8).alias("value")), g, 16))
    return H.drain_flats(filled, H.d8_pointer(filled, g), g, 16)


_SHARE = (
    "part AS (SELECT a.r * 64 + a.c AS src, b.r * 64 + b.c AS dst, pow((a.z - b.z) / CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2e0) ELSE 1e0 END, 1.1e0) * CASE WHEN dr <> 0 AND dc <> 0 THEN 0.354e0 ELSE 0.5e0 END AS p "
    "FROM dem a CROSS JOIN nb JOIN dem b ON b.r = a.r + dr AND b.c = a.c + dc WHERE a.z > b.z), "
    "share AS MATERIALIZED (SELECT src, dst, p / sum(p) OVER (PARTITION BY src) AS p FROM part), "
    "flow AS (SELECT r * 64 + c AS id, 1e0 AS v, 0 AS n FROM dem UNION ALL SELECT s.dst, sum(f.v * s.p), any_value(f.n) + 1 FROM flow f JOIN share s ON s.src = f.id GROUP BY s.dst)"
)


@query(_rec(X.CELL, "dem AS (SELECT * FROM cell WHERE r < 40)", _NEAR, _SHARE) + "SELECT id // 64 AS row, id % 64 AS col, round(sum(v), 6) AS value FROM flow GROUP BY id")
def flow_accumulation_fd8(spark, sf):
    g, dem = X.small(spark, sf)
    return H.accumulation_fd8(dem, g, size=16).select("row", "col", _r("value"))


# --- channels


@query(_with(X.CELL) + "SELECT r AS row, c AS col, CAST(coalesce(z > (SELECT avg(z) + 1.5e0 * stddev_pop(z) FROM cell), false) AS INTEGER) AS value FROM cell")
def skeleton_single(spark, sf):
    return N.skeleton(X.cell(spark, sf).select("row", "col", F.col("value").alias("curvature"), F.lit(None).cast("double").alias("fac")), fac_threshold=None)


@query(_with(X.CELL, X.HOLED) + "SELECT r AS row, c AS col, CAST(coalesce(z > (SELECT avg(z) + 0.2e0 * stddev_pop(z) FROM holed) AND (r * 37 + c * 11) % 101 > 30, false) AS INTEGER) AS value FROM holed")
def skeleton_combined(spark, sf):
    cells = X.holed(spark, sf).select("row", "col", F.col("value").alias("curvature"), ((F.col("row") * 37 + F.col("col") * 11) % 101).alias("fac"))
    return N.skeleton(cells, 30.0, 0.2)


_MASK = "mask AS (SELECT r, c, r * 64 + c AS id, z FROM cell WHERE z > 0.12e0 AND r < 120)"
_LABEL = (
    "adj AS MATERIALIZED (SELECT a.id AS src, b.id AS dst FROM mask a CROSS JOIN nb JOIN mask b ON b.r = a.r + dr AND b.c = a.c + dc), "
    "lab(id, l) USING KEY (id) AS (SELECT id, id FROM mask UNION SELECT x.dst, min(f.l) FROM lab f JOIN adj x ON x.src = f.id JOIN recurring.lab o ON o.id = x.dst WHERE f.l < o.l GROUP BY x.dst)"
)


def _mask(spark, sf):
    return Grid(120, 64), X.cell(spark, sf).where("row < 120").select("row", "col", F.when(F.col("value") > 0.12, 1).otherwise(0).alias("value"))


@query(_rec(X.CELL, _NEAR, _MASK, _LABEL) + "SELECT id // 64 AS row, id % 64 AS col, l AS label FROM lab")
def component_labels(spark, sf):
    g, m = _mask(spark, sf)
    return N.region_sizes(m, g, 48)[0]


@query(_rec(X.CELL, _NEAR, _MASK, _LABEL) + "SELECT l AS label, count(*) AS cells FROM lab GROUP BY l")
def component_sizes(spark, sf):
    g, m = _mask(spark, sf)
    return N.region_sizes(m, g, 48)[1]


@query(_rec(X.CELL, _NEAR, _MASK, _LABEL, "sz AS (SELECT count(*) AS n FROM lab GROUP BY l)", "o AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS i, count(*) OVER () AS k FROM sz)") + "SELECT min(n) + 2 * (max(n) - min(n)) / floor(sqrt(any_value(k))) AS value FROM o WHERE i > 1")
def component_threshold(spark, sf):
    g, m = _mask(spark, sf)
    return spark.createDataFrame([(float(N.size_threshold(N.region_sizes(m, g, 48)[1])),)], "value double")


@query(
    _rec(X.CELL, _NEAR, _MASK, _LABEL, "sz AS (SELECT l, count(*) AS n FROM lab GROUP BY l)", "big AS (SELECT m.r, m.c, m.z, lab.l FROM lab JOIN sz ON sz.l = lab.l JOIN mask m ON m.id = lab.id WHERE sz.n >= 5)")
    + "SELECT r AS row, c AS col FROM big a WHERE NOT EXISTS (SELECT 1 FROM big b WHERE b.l = a.l AND b.z > a.z AND b.r BETWEEN a.r - least(3, a.r - 1) AND a.r + least(3, 120 - a.r) AND b.c BETWEEN a.c - least(3, a.c - 1) AND a.c + least(3, 64 - a.c))"
)
def channel_heads(spark, sf):
    g, m = _mask(spark, sf)
    return N.channel_heads(m, X.cell(spark, sf).where("row < 120"), g, reach=3, least=5, size=48)


@query()
def geodesic_distance(spark, sf):
    g, d8 = _d8(spark, sf)
    basins_ = cut(H.basins(d8, g))
    starts = N.travel_starts(basins_, H.outlets(d8), g, area_percent=0.05)
    cells = basins_.join(X.cell(spark, sf).select("row", "col", (F.abs("value") + 0.1).alias("speed")), ["row", "col"]).select("row", "col", F.col("value").alias("basin"), "speed")
    return N.geodesic_distance(cells, starts)


@query(
    _with(X.CELL, "dem AS (SELECT r, c, round(z, 9) AS z, (r * 5 + c * 3) % 29 = 0 AS ch FROM cell WHERE r < 40)", "pair AS (SELECT a.r, a.c, least(abs(a.r - b.r), abs(a.c - b.c)) * 1.414e0 + abs(abs(a.r - b.r) - abs(a.c - b.c)) AS d, b.z FROM dem a JOIN dem b ON b.ch AND abs(a.r - b.r) <= 12 AND abs(a.c - b.c) <= 12)")
    + "SELECT r AS row, c AS col, round(min(d), 6) AS distance FROM pair GROUP BY r, c"
)
def nearest_channel_distance(spark, sf):
    g, dem = X.small(spark, sf)
    cells = dem.select("row", "col", "value", ((F.col("row") * 5 + F.col("col") * 3) % 29 == 0).cast("int").alias("channel"))
    return N.nearest_channel(cells, g, 16).select("row", "col", _r("distance"))


@query(
    _with(X.CELL, "dem AS (SELECT r, c, z, (r * 5 + c * 3) % 29 = 0 AS ch FROM cell WHERE r < 40)", "pair AS (SELECT a.r, a.c, a.z, round(least(abs(a.r - b.r), abs(a.c - b.c)) * 1.414e0 + abs(abs(a.r - b.r) - abs(a.c - b.c)), 6) AS d, b.z AS bed FROM dem a JOIN dem b ON b.ch AND abs(a.r - b.r) <= 12 AND abs(a.c - b.c) <= 12)")
    + "SELECT r AS row, c AS col, CASE WHEN arg_min(bed, d * 1000e0 + bed) < any_value(z) THEN 0 ELSE 1 END AS value FROM pair GROUP BY r, c"
)
def binary_hand_chamfer(spark, sf):
    g, dem = X.small(spark, sf)
    return N.binary_hand(dem.select("row", "col", "value", ((F.col("row") * 5 + F.col("col") * 3) % 29 == 0).cast("int").alias("channel")), g, 16)


_GRID = "area AS (SELECT r, c, r * 64 + c AS id, abs(z) + 0.05e0 AS v FROM cell WHERE r < 40)"
_DIST = (
    "step AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, (a.v + b.v) / 2 * CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2e0) ELSE 1e0 END AS d FROM area a CROSS JOIN nb JOIN area b ON b.r = a.r + dr AND b.c = a.c + dc), "
    "ends AS (SELECT unnest(range(6)) AS p), "
    "dist(p, id, d) USING KEY (p, id) AS (SELECT p, (p * 3) * 64 + p * 5, 0e0 FROM ends UNION SELECT f.p, s.dst, min(f.d + s.d) FROM dist f JOIN step s ON s.src = f.id LEFT JOIN recurring.dist o ON o.p = f.p AND o.id = s.dst WHERE o.d IS NULL OR f.d + s.d < o.d GROUP BY f.p, s.dst)"
)


def _ends(spark):
    return spark.range(6).select(F.col("id").alias("path_id"), (F.col("id") * 3).alias("r1"), (F.col("id") * 5).alias("c1"), (F.lit(39) - F.col("id")).alias("r2"), (F.lit(63) - F.col("id") * 2).alias("c2"))


@query(_rec(X.CELL, _NEAR, _GRID, _DIST) + "SELECT p AS path_id, round(d, 6) AS cost FROM dist WHERE id = (39 - p) * 64 + 63 - p * 2")
def least_cost_paths(spark, sf):
    from pyspark.sql.window import Window

    g, dem = X.small(spark, sf)
    area = cut(dem.select("row", "col", (F.abs("value") + 0.05).alias("value")))
    paths = N.least_cost_paths(area, _ends(spark), g, 8).join(area, ["row", "col"])
    w = Window.partitionBy("path_id").orderBy("seq")
    long = F.when((F.col("row") != F.lag("row").over(w)) & (F.col("col") != F.lag("col").over(w)), F.sqrt(F.lit(2.0))).otherwise(1.0)
    return paths.withColumn("d", (F.col("value") + F.lag("value").over(w)) / 2 * long).groupBy("path_id").agg(F.round(F.sum("d"), 6).alias("cost"))


_PATHS = "paths AS (SELECT event_id % 9 AS path_id, row_number() OVER (PARTITION BY event_id % 9 ORDER BY event_id) - 1 AS seq, CAST(floor(value) AS BIGINT) % 12 AS r, user_id % 3 AS c FROM events WHERE event_id < 200)"


@query(
    _with(_PATHS, "v AS (SELECT p.*, count(*) OVER (PARTITION BY r, c) AS n FROM paths p)", "w AS (SELECT *, lag(n) OVER (PARTITION BY path_id ORDER BY seq) AS b FROM v)", "s AS (SELECT DISTINCT path_id, r, c FROM paths WHERE seq = 0)")
    + ", brk AS (SELECT path_id, min(seq) AS at FROM w WHERE seq > 0 AND n <> b AND EXISTS (SELECT 1 FROM s WHERE s.r = w.r AND s.c = w.c AND s.path_id <= w.path_id) GROUP BY path_id), key AS (SELECT p.path_id, row_number() OVER (ORDER BY p.path_id) - 1 + (SELECT count(*) FROM brk WHERE brk.path_id < p.path_id) AS key FROM (SELECT DISTINCT path_id FROM paths) p) "
    "SELECT key.key, w.path_id, w.seq, w.r AS row, w.c AS col FROM w JOIN key ON key.path_id = w.path_id LEFT JOIN brk ON brk.path_id = w.path_id WHERE (brk.at IS NULL OR w.seq <= brk.at) AND (w.seq = 0 OR w.n = w.b OR w.seq = brk.at)"
)
def path_segments(spark, sf):
    from pyspark.sql.window import Window

    e = X.table(spark, sf, "events").where("event_id < 200").withColumn("path_id", F.col("event_id") % 9)
    seq = F.row_number().over(Window.partitionBy("path_id").orderBy("event_id")) - 1
    return N.path_segments(e.select("path_id", seq.cast("long").alias("seq"), (F.floor("value") % 12).cast("long").alias("row"), (F.col("user_id") % 3).cast("long").alias("col")))


@query()
def channel_cost(spark, sf):
    """The cost of the channel search from curvature, accumulation and nearest-channel elevation, cheap cells kept."""
    g = X.grid(spark, sf)
    curv = A.minmax_scale(T.curvature(X.cell(spark, sf), g).select("row", "col", A.within(F.col("value"), -10, 10).alias("value"))).withColumnRenamed("value", "curv")
    fac = A.minmax_scale(H.accumulation_d8(_d8(spark, sf)[1], g).select("row", "col", A.log(F.col("value")).alias("value"))).withColumnRenamed("value", "fac")
    weight = fac.agg(F.avg("fac")).first()[0]
    both = curv.join(fac, ["row", "col"]).withColumn("binary", F.lit(1.0))
    cost = both.select("row", "col", A.combined_cost([(weight, F.col("curv")), (1.0, F.col("fac")), (0.75, F.col("binary"))]).alias("value"))
    return A.keep_cheapest(cost)


# --- lines and polygons


@query(_with(X.LINE) + "SELECT path_id AS RiverID, arg_min(x, seq) AS START_X, arg_min(y, seq) AS START_Y, arg_max(x, seq) AS END_X, arg_max(y, seq) AS END_Y FROM line GROUP BY path_id HAVING count(*) >= 2")
def endpoints(spark, sf):
    return V.endpoints(V.as_lines(X.line(spark, sf)))


_EDGE_LEN = "ed AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS d FROM line WINDOW w AS (PARTITION BY path_id ORDER BY seq)), al AS (SELECT *, sum(d) OVER (PARTITION BY path_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS a FROM ed)"


@query(_with(X.LINE, _EDGE_LEN) + "SELECT path_id, round(sum(d), 6) AS length FROM ed GROUP BY path_id")
def line_length(spark, sf):
    return V.lengths(X.line(spark, sf)).select("path_id", _r("length"))


@query(
    _rec(X.LINE, "few AS (SELECT * FROM line WHERE path_id < 12)", "n AS (SELECT path_id FROM few GROUP BY path_id HAVING count(*) >= 2)")
    + ", walk AS (SELECT f.path_id, f.seq, f.x, f.y, CAST(0 AS BIGINT) AS part, 0e0 AS len FROM few f JOIN n ON n.path_id = f.path_id WHERE f.seq = 1 UNION ALL SELECT f.path_id, f.seq, f.x, f.y, CASE WHEN w.len + s.d > 1000e0 AND w.len > 0 THEN w.part + 1 ELSE w.part END, CASE WHEN w.len + s.d > 1000e0 AND w.len > 0 THEN s.d ELSE w.len + s.d END "
    "FROM walk w JOIN few f ON f.path_id = w.path_id AND f.seq = w.seq + 1 CROSS JOIN LATERAL (SELECT sqrt((f.x - w.x) * (f.x - w.x) + (f.y - w.y) * (f.y - w.y)) AS d) s) "
    "SELECT path_id, part, seq, x, y FROM walk UNION ALL SELECT a.path_id, b.part, a.seq, a.x, a.y FROM walk a JOIN walk b ON a.path_id = b.path_id AND b.seq = a.seq + 1 AND b.part <> a.part"
)
def split_lines(spark, sf):
    return V.split_lines(X.line(spark, sf).where("path_id < 12"), 1000.0)


@query()
def segment_lengths(spark, sf):
    return V.segments(X.line(spark, sf), 1000.0)


@query(
    _with(X.LINE, _EDGE_LEN, "t AS (SELECT path_id, max(a) AS total FROM al GROUP BY path_id)", "pt AS (SELECT al.*, t.total * p.p AS want, p.p, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(a) OVER w AS pa FROM al JOIN t ON t.path_id = al.path_id CROSS JOIN (VALUES (0.10e0), (0.85e0)) p(p) WINDOW w AS (PARTITION BY al.path_id, p.p ORDER BY seq))")
    + "SELECT path_id, p AS share, round(px + (want - pa) / d * (x - px), 6) AS x, round(py + (want - pa) / d * (y - py), 6) AS y FROM pt WHERE want > pa AND want <= a"
)
def points_along_lines(spark, sf):
    line = X.line(spark, sf)
    return V.point_along(line, 0.10).withColumn("share", F.lit(0.10)).unionByName(V.point_along(line, 0.85).withColumn("share", F.lit(0.85))).where("path_id IS NOT NULL").join(V.lengths(line).where("length > 0").select("path_id"), "path_id").select("path_id", "share", _r("x"), _r("y"))


@query()
def slope_10_85(spark, sf):
    g, line = X.flowline(spark, sf)
    return V.slope_10_85(line, X.small(spark, sf)[1], g)


_RING = "ring AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey AS DOUBLE) * 400 AS x1, CAST(n_nationkey AS DOUBLE) * 400 + 500 AS x2, 30e0 AS y1, 90e0 AS y2 FROM nation)"


def _rings(spark, sf):
    n = X.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("ring_id"), (F.col("n_nationkey") * 400.0).alias("a"))
    corner = F.array(*[F.struct((F.col("a") + dx).alias("x"), F.lit(y).alias("y")) for dx, y in ((0.0, 30.0), (500.0, 30.0), (500.0, 90.0), (0.0, 90.0), (0.0, 30.0))])
    return n.select("ring_id", F.posexplode(corner).alias("seq", "p")).select("ring_id", "seq", "p.x", "p.y")


@query(
    _with(X.LINE, _EDGE_LEN, _RING, "mid AS (SELECT *, (x + lag(x) OVER w) / 2 AS mx, (y + lag(y) OVER w) / 2 AS my FROM ed WINDOW w AS (PARTITION BY path_id ORDER BY seq))", "cen AS (SELECT path_id, sum(mx * d) / nullif(sum(d), 0) AS x, sum(my * d) / nullif(sum(d), 0) AS y FROM mid WHERE mx IS NOT NULL GROUP BY path_id)")
    + "SELECT path_id AS point_id, round(any_value(cen.x), 6) AS x, round(any_value(cen.y), 6) AS y, min(id) AS ring_id FROM cen LEFT JOIN ring ON cen.x >= x1 AND cen.x < x2 AND cen.y >= y1 AND cen.y < y2 GROUP BY path_id"
)
def centroid_within(spark, sf):
    points = V.centroids(X.line(spark, sf)).select(F.col("path_id").alias("point_id"), "x", "y")
    return V.points_within(points, _rings(spark, sf), 250.0).select("point_id", _r("x"), _r("y"), "ring_id")


@query(_with(_RING) + "SELECT id AS ring_id, (x2 - x1) * (y2 - y1) AS area FROM ring")
def polygon_area(spark, sf):
    return V.polygon_areas(_rings(spark, sf))


@query(
    _with(X.CELL, X.FLOWLINE, "seg AS (SELECT x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM fl WINDOW w AS (PARTITION BY path_id ORDER BY seq))", "p AS (SELECT r, c, c + 0.5e0 AS cx, 40e0 - (r + 0.5e0) AS cy FROM cell WHERE r < 40)", "t AS (SELECT p.*, x, y, px, py, greatest(0, least(1, coalesce(((cx - px) * (x - px) + (cy - py) * (y - py)) / nullif((x - px) * (x - px) + (y - py) * (y - py), 0), 0))) AS t FROM p CROSS JOIN seg WHERE px IS NOT NULL)")
    + "SELECT DISTINCT r AS row, c AS col FROM t WHERE (cx - (px + t * (x - px))) * (cx - (px + t * (x - px))) + (cy - (py + t * (y - py))) * (cy - (py + t * (y - py))) <= 4e0"
)
def rasterize_buffer(spark, sf):
    g, line = X.flowline(spark, sf)
    return V.rasterize_buffer(line, g, 2.0)


@query(
    _with(X.FLOWLINE, "v AS (SELECT path_id, seq, CAST(floor(40e0 - y) AS BIGINT) AS r, CAST(floor(x) AS BIGINT) AS c FROM fl)", "e AS (SELECT *, coalesce(lag(r) OVER w, r) AS pr, coalesce(lag(c) OVER w, c) AS pc FROM v WINDOW w AS (PARTITION BY path_id ORDER BY seq))", "s AS (SELECT *, greatest(abs(r - pr), abs(c - pc)) AS n FROM e)", "k AS (SELECT *, unnest(range(n + 1)) AS k FROM s)")
    + "SELECT CAST(floor(pr + coalesce(CAST(k AS DOUBLE) / nullif(n, 0), 0) * (r - pr) + 0.5e0) AS BIGINT) AS row, CAST(floor(pc + coalesce(CAST(k AS DOUBLE) / nullif(n, 0), 0) * (c - pc) + 0.5e0) AS BIGINT) AS col, max(path_id) AS value FROM k GROUP BY 1, 2"
)
def rasterize_lines(spark, sf):
    g, line = X.flowline(spark, sf)
    return V.rasterize_lines(line, g)


_REG = (
    "val AS (SELECT r, c, r * 64 + c AS id, CAST(floor(abs(z) * 10) AS BIGINT) AS v FROM cell WHERE r < 100 AND abs(z) >= 0.1e0), "
    "adj AS MATERIALIZED (SELECT a.id AS src, b.id AS dst FROM val a CROSS JOIN nb JOIN val b ON b.r = a.r + dr AND b.c = a.c + dc AND a.v = b.v), "
    "lab(id, l) USING KEY (id) AS (SELECT id, id FROM val UNION SELECT x.dst, min(f.l) FROM lab f JOIN adj x ON x.src = f.id JOIN recurring.lab o ON o.id = x.dst WHERE f.l < o.l GROUP BY x.dst)"
)


@query(_rec(X.CELL, _NEAR, _REG) + 'SELECT v AS "HYDROID", l AS region, count(*) AS cells, round(count(*) / 1e6, 9) AS "AreaSqKm" FROM lab JOIN val ON val.id = lab.id GROUP BY 1, 2')
def vectorized_area(spark, sf):
    cells = X.cell(spark, sf).where("row < 100").select("row", "col", F.floor(F.abs("value") * 10).alias("value"))
    return I.region_areas(cells, Grid(100, 64)).withColumn("AreaSqKm", F.round("AreaSqKm", 9))


@query(_rec(X.CELL, _NEAR, _REG) + 'SELECT v AS "HYDROID", l AS region, CAST(count(*) AS DOUBLE) AS area FROM lab JOIN val ON val.id = lab.id GROUP BY 1, 2')
def region_outlines(spark, sf):
    """The signed areas of the outlines of each region: what its cells are."""
    from pyspark.sql.window import Window

    g = Grid(100, 64)
    cells = X.cell(spark, sf).where("row < 100").select("row", "col", F.floor(F.abs("value") * 10).alias("value"))
    rings = V.outlines(N.same_value_regions(cells, g), g)
    w = Window.partitionBy("HYDROID", "region", "ring").orderBy("seq")
    cross = (F.col("y") * F.lead("x").over(w) - F.lead("y").over(w) * F.col("x")) / 2
    return rings.withColumn("cross", cross).groupBy("HYDROID", "region").agg(F.sum("cross").alias("area"))


# --- rating curves and maps


def _curve(spark, sf):
    hand = X.hand(spark, sf)
    steps = R.hypsometry(hand, X.attributes(spark, sf), X.STAGES, X.STEP, 1.0)
    return R.rating_curve(steps, X.attributes(spark, sf), X.roughness(spark, sf))


@query(_with(X.CELL, X.HAND) + 'SELECT hydroid AS "HYDROID", round(count(*) / 1e6, 9) AS "Area_km2" FROM hand GROUP BY hydroid')
def catchment_area(spark, sf):
    empty = spark.createDataFrame([], "HYDROID long, slope double, length double"), spark.createDataFrame([], "HYDROID long, COMID long")
    return R.river_attributes(X.hand(spark, sf), *empty, 1.0).select("HYDROID", F.round("Area_km2", 9).alias("Area_km2"))


@query(_with(X.CELL, X.HAND, X.HYPSO) + 'SELECT hydroid AS "HYDROID", k, h AS "Stage_m", n AS "NumCells", CAST(n AS DOUBLE) AS "SurfaceArea_m2", round(bed, 5) AS "BedArea_m2", round(vol, 5) AS "Volume_m3" FROM hyp')
def hypsometry(spark, sf):
    return R.hypsometry(X.hand(spark, sf), X.attributes(spark, sf), X.STAGES, X.STEP, 1.0).select("HYDROID", "k", "Stage_m", "NumCells", "SurfaceArea_m2", _r("BedArea_m2", 5), _r("Volume_m3", 5))


@query(_with(X.CELL, X.HAND, X.HYPSO, X.RA, X.ROUGH, X.CURVE) + 'SELECT hydroid AS "HYDROID", h AS "Stage_m", comid AS "COMID", round(wet, 6) AS "WetArea_m2", round(wp, 6) AS "WettedPerimeter_m", round(q, 6) AS "Discharge_cms" FROM curve')
def rating_curve(spark, sf):
    return _curve(spark, sf).select("HYDROID", "Stage_m", "COMID", _r("WetArea_m2"), _r("WettedPerimeter_m"), _r("Discharge_cms"))


_STAGE_OUT = 'SELECT hydroid AS "HYDROID", comid AS "COMID", q AS "Discharge_cms", round(stage, 6) AS "Stage_m" FROM stage'


@query(_with(X.CELL, X.HAND, X.HYPSO, X.RA, X.ROUGH, X.CURVE, X.FORECAST, X.STAGE) + _STAGE_OUT)
def flood_stage_forecast(spark, sf):
    return R.flood_stage(_curve(spark, sf), X.forecast(spark, sf)).select("HYDROID", "COMID", "Discharge_cms", _r("Stage_m"))


@query(_with(X.CELL, X.HAND, X.HYPSO, X.RA, X.ROUGH, X.CURVE, "fc AS (SELECT DISTINCT comid, 0.5e0 AS q FROM ra)", X.STAGE) + _STAGE_OUT)
def flood_stage_const(spark, sf):
    return R.flood_stage(_curve(spark, sf), constant=0.5).select("HYDROID", "COMID", "Discharge_cms", _r("Stage_m"))


def _stages(spark, sf):
    return X.attributes(spark, sf).select("HYDROID", (F.col("HYDROID") % 5 * 1.5).alias("Stage_m"))


@query(_with(X.CELL, X.HAND) + "SELECT r AS row, c AS col, round(CASE WHEN (hydroid % 5) * 1.5e0 > hand THEN (hydroid % 5) * 1.5e0 - hand END, 6) AS value FROM hand")
def inundate(spark, sf):
    return I.inundate(X.hand(spark, sf), _stages(spark, sf)).select("row", "col", _r("value"))


@query(_with(X.CELL, X.HAND) + "SELECT r AS row, c AS col, round(CASE WHEN hydroid % 3 <> 0 AND (hydroid % 5) * 1.5e0 > hand THEN (hydroid % 5) * 1.5e0 - hand END, 6) AS value FROM hand")
def inundate_missing_stage(spark, sf):
    return I.inundate(X.hand(spark, sf), _stages(spark, sf).where("HYDROID % 3 <> 0")).select("row", "col", _r("value"))


@query(_with(X.CELL, X.HAND, X.HYPSO, X.RA, X.ROUGH, X.CURVE, X.FORECAST, X.STAGE) + "SELECT h.r AS row, h.c AS col, round(CASE WHEN s.stage > h.hand THEN s.stage - h.hand END, 6) AS value FROM hand h LEFT JOIN stage s ON s.hydroid = h.hydroid")
def fim_end_to_end(spark, sf):
    stages = R.flood_stage(_curve(spark, sf), X.forecast(spark, sf))
    return I.inundate(X.hand(spark, sf), stages).select("row", "col", _r("value"))


_SEA = (
    "wet AS (SELECT r, c, r * 64 + c AS id, 0.1e0 - z AS d FROM holed WHERE z < 0.1e0), "
    "first AS (SELECT id FROM wet ORDER BY id LIMIT 1), "
    "adj AS MATERIALIZED (SELECT a.id AS src, b.id AS dst FROM wet a CROSS JOIN nb JOIN wet b ON b.r = a.r + dr AND b.c = a.c + dc), "
    "sea AS (SELECT id FROM first UNION SELECT x.dst FROM sea JOIN adj x ON x.src = sea.id)"
)


def _coastal(spark, sf):
    g, cells = X.grid(spark, sf), X.holed(spark, sf).select("row", "col", "value")
    first = cells.where("value < 0.1").agg(F.min(cell_id(g))).first()[0]
    return I.coastal(cells, g, 0.1, divmod(first, 64))


@query(_rec(X.CELL, X.HOLED, _NEAR, _SEA) + "SELECT h.r AS row, h.c AS col, round(CASE WHEN h.r * 64 + h.c IN (SELECT id FROM sea) THEN 0.1e0 - h.z END, 9) AS value FROM holed h")
def coastal_chand(spark, sf):
    return _coastal(spark, sf).select("row", "col", _r("value", 9))


@query(
    _rec(X.CELL, X.HOLED, X.HAND, _NEAR, _SEA, "p AS (SELECT r, c, CASE WHEN (hydroid % 5) * 1.5e0 > hand THEN (hydroid % 5) * 1.5e0 - hand END AS v FROM hand)", "q AS (SELECT r, c, CASE WHEN r * 64 + c IN (SELECT id FROM sea) THEN 0.1e0 - z END AS v FROM holed)")
    + "SELECT p.r AS row, p.c AS col, round(CASE WHEN p.v IS NULL OR q.v > p.v THEN q.v ELSE p.v END, 6) AS value FROM p JOIN q ON p.r = q.r AND p.c = q.c"
)
def compound_inundation(spark, sf):
    return I.compound(I.inundate(X.hand(spark, sf), _stages(spark, sf)), _coastal(spark, sf)).select("row", "col", _r("value"))


@query()
def fill_spill_merge(spark, sf):
    g, dem = X.small(spark, sf)
    return D.fill_spill_merge(dem.withColumn("water", F.lit(0.05)), g)


@query(_rec(X.CELL, "holed AS (SELECT * FROM cell WHERE r < 40)", "dim AS (SELECT 40 AS h)", _NEAR, _FILL) + "SELECT f.id // 64 AS row, f.id % 64 AS col, round(CASE WHEN f.w > h.z THEN f.w - h.z END, 6) AS value FROM fill f JOIN holed h ON h.r * 64 + h.c = f.id")
def fill_spill_merge_saturated(spark, sf):
    g, dem = X.small(spark, sf)
    return D.fill_spill_merge(dem.withColumn("water", F.lit(1000.0)), g).select("row", "col", _r("value"))


@query()
def depression_hierarchy(spark, sf):
    g, dem = X.small(spark, sf)
    return D.hierarchy_table(dem, g)
