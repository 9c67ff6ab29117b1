"""Attribute tables: forecasts, roughness, rating curves; checked against their schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FLOOD_STAGE, RATING_CURVE, ROUGHNESS, require

IDS = ("COMID", "feature_id", "station_id")


def forecast(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(COMID, q) of a forecast with ``streamflow`` and the first of COMID, feature_id, station_id; only COMIDs of ``known``."""
    require(df, "streamflow")
    name = next((n for n in IDS if n in df.columns), None)
    if name is None:
        raise ValueError(f"a forecast needs one of the columns {IDS}; there are {df.columns}")
    out = df.select(F.col(name).cast("long").alias("COMID"), F.col("streamflow").cast("double").alias("q"))
    return out if known is None else out.join(known.select("COMID").distinct(), "COMID", "left_semi")


def read_forecast(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """A forecast file: CSV with a header, or Parquet. Other kinds have to be converted first."""
    if path.endswith(".csv"):
        return forecast(spark.read.csv(path, header=True, inferSchema=True), known)
    if path.rstrip("/").endswith(".parquet"):
        return forecast(spark.read.parquet(path), known)
    raise ValueError(f"a forecast must be .csv or .parquet: {path}")


def read_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    schema = {"roughness": ROUGHNESS, "src": RATING_CURVE, "flood_stage": FLOOD_STAGE}[kind]
    return spark.read.csv(path if path.endswith(".csv") else path + ".csv", header=True, schema=schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def narrowed(df: DataFrame, ids: tuple[str, ...] = ("HYDROID", "COMID")) -> DataFrame:
    """Doubles as floats, for storage; never ids."""
    return df.select([F.col(n).cast("float").alias(n) if t == "double" and n not in ids else F.col(n) for n, t in df.dtypes])
