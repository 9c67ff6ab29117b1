"""The rasters, curves and lines that the catalogue's queries run on, made from the given tables; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import Grid

WIDTH, STAGES, STEP = 64, 201, 1e-1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> Grid:
    return Grid(table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1, WIDTH)


def cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, value, label): the embeddings as a terrain."""
    e = table(spark, sf_dir, "embeddings")
    c = e.select(F.col("vec_id").cast("long").alias("row"), F.posexplode("embedding").alias("col", "value"), F.col("label").cast("long").alias("label"))
    return c.select("row", F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"), "label")


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terrain with cells without data."""
    gone = (F.col("label") == 9) & (F.col("col") % 7 == 0)
    return cell(spark, sf_dir).withColumn("value", F.when(~gone, F.col("value")))


def hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, hand, slope, hydroid)."""
    gone = (F.col("label") == 9) & (F.col("col") % 7 == 0)
    hydroid = 1 + F.floor(F.col("row") / 50) * 4 + F.floor(F.col("col") / 16)
    return cell(spark, sf_dir).select("row", "col", F.when(~gone, F.abs("value") * 20e0).alias("hand"), F.abs("value").alias("slope"), hydroid.cast("long").alias("hydroid"))


def small(spark: SparkSession, sf_dir: str) -> tuple[Grid, DataFrame]:
    """The first 40 rows."""
    return Grid(40, WIDTH), cell(spark, sf_dir).where("row < 40")


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hand(spark, sf_dir).select(F.col("hydroid").alias("HYDROID")).distinct()
    return h.select("HYDROID", (F.col("HYDROID") % 25).alias("COMID"), (F.lit(0.001) + F.col("HYDROID") * 0.0001).alias("Slope"), F.lit(1.5).alias("Length_km"), F.lit(0.8).alias("Area_km2"))


def roughness(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.element_at(F.array(*[F.lit(x) for x in (0.2, 0.1, 0.065, 0.045, 0.03)]), F.col("n_regionkey").cast("int") + 1)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("COMID"), n.alias("Roughness"))


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("COMID")).agg(F.min_by("value", "event_id").alias("q"))


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path_id, seq, x, y): each user's events as a line."""
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("path_id"), seq.cast("long").alias("seq"), F.col("event_id").cast("double").alias("x"), F.col("value").alias("y"))


def flowline(spark: SparkSession, sf_dir: str) -> tuple[Grid, DataFrame]:
    """Short lines over the first 40 rows."""
    g = Grid(40, WIDTH, y0=40.0)
    v = table(spark, sf_dir, "events").where("event_id < 60")
    return g, v.select(F.floor(F.col("event_id") / 6).cast("long").alias("path_id"), (F.col("event_id") % 6).cast("long").alias("seq"), ((F.col("event_id") * 7) % 61 + 0.25).cast("double").alias("x"), ((F.col("event_id") * 11) % 37 + 0.75).cast("double").alias("y"))


CELL = "cell AS (SELECT CAST(vec_id AS BIGINT) AS r, unnest(range(64)) AS c, CAST(unnest(embedding) AS DOUBLE) AS z, CAST(label AS BIGINT) AS label FROM embeddings)"
DIM = "dim AS (SELECT max(r) + 1 AS h, 64 AS w FROM cell)"
HOLED = "holed AS (SELECT r, c, CASE WHEN label = 9 AND c % 7 = 0 THEN NULL ELSE z END AS z FROM cell)"
HAND = "hand AS (SELECT r, c, CASE WHEN label = 9 AND c % 7 = 0 THEN NULL ELSE abs(z) * 20e0 END AS hand, abs(z) AS slope, CAST(1 + floor(r / 50e0) * 4 + floor(c / 16e0) AS BIGINT) AS hydroid FROM cell)"
RA = "ra AS (SELECT DISTINCT hydroid, hydroid % 25 AS comid, 0.001e0 + hydroid * 0.0001e0 AS slope, 1.5e0 AS len, 0.8e0 AS area FROM hand)"
ROUGH = "rough AS (SELECT CAST(n_nationkey AS BIGINT) AS comid, [0.2e0, 0.1e0, 0.065e0, 0.045e0, 0.03e0][n_regionkey + 1] AS n FROM nation)"
FORECAST = "fc AS (SELECT user_id AS comid, arg_min(value, event_id) AS q FROM events GROUP BY user_id)"
LINE = "line AS (SELECT user_id AS path_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(event_id AS DOUBLE) AS x, value AS y FROM events)"
FLOWLINE = "fl AS (SELECT event_id // 6 AS path_id, event_id % 6 AS seq, CAST((event_id * 7) % 61 AS DOUBLE) + 0.25e0 AS x, CAST((event_id * 11) % 37 AS DOUBLE) + 0.75e0 AS y FROM events WHERE event_id < 60)"
HYPSO = (
    "hyp AS (SELECT k.k, k.k * 1e-1 AS h, x.hydroid, count(c.hand) AS n, coalesce(sum(sqrt(1 + c.slope * c.slope)), 0) AS bed, coalesce(sum(k.k * 1e-1 - c.hand), 0) AS vol "
    "FROM (SELECT unnest(range(201)) AS k) k CROSS JOIN (SELECT DISTINCT hydroid FROM hand) x LEFT JOIN hand c ON c.hydroid = x.hydroid AND (c.hand < k.k * 1e-1 OR abs(c.hand) <= 1e-8) GROUP BY 1, 2, 3)"
)
CURVE = (
    "curve AS (SELECT h.hydroid, ra.comid, h.h, h.k, (vol / len / 1e3) AS wet, bed / len / 1e3 AS wp, "
    "(vol / len / 1e3) * pow(coalesce((vol / len / 1e3) / nullif(bed / len / 1e3, 0), 0), 2e0 / 3e0) * sqrt(ra.slope) / rough.n AS q "
    "FROM hyp h JOIN ra ON h.hydroid = ra.hydroid LEFT JOIN rough ON rough.comid = ra.comid)"
)
STAGE = (
    "got AS (SELECT c.hydroid, c.comid, f.q, max(c.k) FILTER (WHERE c.q <= f.q) AS lo, min(c.k) FILTER (WHERE c.q > f.q) AS hi FROM curve c JOIN fc f ON c.comid = f.comid GROUP BY 1, 2, 3), "
    "stage AS (SELECT g.hydroid, g.comid, g.q, CASE WHEN lo IS NULL THEN 0e0 WHEN hi IS NULL AND g.q > a.q THEN -32768e0 WHEN hi IS NULL THEN a.h ELSE a.h + (g.q - a.q) * (b.h - a.h) / (b.q - a.q) END AS stage "
    "FROM got g LEFT JOIN curve a ON a.hydroid = g.hydroid AND a.k = g.lo LEFT JOIN curve b ON b.hydroid = g.hydroid AND b.k = g.hi)"
)
