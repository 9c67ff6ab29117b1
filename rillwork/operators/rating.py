"""Synthetic rating curves: hypsometry of the catchments, channel geometry, discharge; and flood stages from a forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import require


def hypsometry(cells: DataFrame, catchments: DataFrame, stages: int, step: float, cell_area: float) -> DataFrame:
    """(HYDROID, k, Stage_m, NumCells, SurfaceArea_m2, BedArea_m2, Volume_m3) for the stages k = 0 .. stages - 1 of k * step.

    cells has hand, slope and hydroid. A cell is wet at a stage if its hand is below it, or 0 (to 1e-8). Each cell is counted at its
    first wet stage only, and running sums do the rest, so the work doesn't grow with the number of stages: cells are shuffled once,
    after partial sums, as at most catchments x stages rows. catchments (HYDROID) says which ones to give.
    """
    require(cells, "hand", "slope", "hydroid")
    guess = F.greatest(F.lit(0), F.floor(F.col("hand") / step) - 1).cast("long")
    first = F.when(F.abs("hand") <= 1e-8, F.lit(0).cast("long"))
    for ahead in range(4):  # the guess is low by at most 3 after rounding
        k = guess + ahead
        first = first.when(k.cast("double") * step > F.col("hand"), k)
    wet = cells.where(F.col("hand").isNotNull() & F.col("hydroid").isNotNull()).withColumn("k", first).where(F.col("k") < stages)
    bed = F.sqrt(1 + F.coalesce("slope", F.lit(0.0)) * F.coalesce("slope", F.lit(0.0)))
    new = wet.groupBy(F.col("hydroid").alias("HYDROID"), "k").agg(F.count("*").alias("n"), F.sum(bed).alias("b"), F.sum("hand").alias("h"))
    dense = catchments.select("HYDROID").distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stages - 1).cast("long"))))
    run = Window.partitionBy("HYDROID").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.coalesce(F.sum(c).over(run), F.lit(0))
    sums = dense.join(new, ["HYDROID", "k"], "left").select("HYDROID", "k", total("n").alias("n"), total("b").alias("b"), total("h").alias("h"))
    stage = F.col("k").cast("double") * step
    return sums.select("HYDROID", "k", stage.alias("Stage_m"), F.col("n").alias("NumCells"), (F.col("n") * F.lit(cell_area)).alias("SurfaceArea_m2"), (F.col("b") * F.lit(cell_area)).alias("BedArea_m2"), (stage * F.col("n") * cell_area - F.col("h") * cell_area).alias("Volume_m3"))


def river_attributes(catchment_cells: DataFrame, segments: DataFrame, comids: DataFrame, cell_area: float, unit: float = 1.0, min_slope: float = 1e-6) -> DataFrame:
    """(HYDROID, Area_km2, Slope, Length_km, COMID).

    catchment_cells has hydroid, segments (HYDROID, slope, length), comids (HYDROID, COMID; of several the least counts).
    """
    area = catchment_cells.where(F.col("hydroid").isNotNull()).groupBy(F.col("hydroid").alias("HYDROID")).agg((F.count("*") * (cell_area * unit * unit / 1e6)).alias("Area_km2"))
    one = comids.groupBy("HYDROID").agg(F.min("COMID").alias("COMID"))
    line = segments.select("HYDROID", F.when(F.col("slope") < min_slope, F.lit(min_slope)).otherwise(F.col("slope")).alias("Slope"), (F.col("length") * unit / 1000).alias("Length_km"))
    return area.join(line, "HYDROID", "left").join(one, "HYDROID", "left")


def rating_curve(steps: DataFrame, attributes: DataFrame, roughness: DataFrame) -> DataFrame:
    """``steps`` of hypsometry() with the attributes, Manning's n and what follows of them: channel geometry and discharge."""
    joined = steps.join(attributes, "HYDROID", "left").join(roughness, "COMID", "left")
    per = F.col("Length_km") * 1e3
    geometry = joined.withColumns(
        {
            "TopWidth_m": F.try_divide("SurfaceArea_m2", per),
            "WettedPerimeter_m": F.try_divide("BedArea_m2", per),
            "WetArea_m2": F.try_divide("Volume_m3", per),
        }
    ).withColumn("HydraulicRadius_m", F.coalesce(F.try_divide("WetArea_m2", "WettedPerimeter_m"), F.lit(0.0)))
    flow = F.try_divide(F.col("WetArea_m2") * F.pow("HydraulicRadius_m", F.lit(2e0 / 3e0)) * F.sqrt("Slope"), F.col("Roughness"))
    return geometry.withColumns({"Discharge_cms": flow, "FloodAreaRatio": F.try_divide(F.try_divide("SurfaceArea_m2", "Area_km2"), F.lit(1e6))})


def check_discharge(curve: DataFrame) -> DataFrame:
    """``curve``, or a ValueError if no row of it has a discharge."""
    if curve.where(F.col("Discharge_cms").isNotNull()).isEmpty():
        raise ValueError("every discharge is missing: no catchment has a slope, a length and a roughness")
    return curve


def flood_stage(curve: DataFrame, forecast: DataFrame | None = None, constant: float | None = None) -> DataFrame:
    """(HYDROID, COMID, Discharge_cms, Stage_m): the stage at which each rating curve carries the forecast (COMID, q).

    Linear between the bracketing points; of a plateau the last one; 0 below the first discharge, -32768 above the last. Without a
    forecast for its COMID a catchment has no row. ``constant`` stands for every COMID, a null one excepted.
    """
    if (forecast is None) == (constant is None):
        raise ValueError("give a forecast or a constant discharge")
    c = curve.where(F.col("COMID").isNotNull())
    if constant is not None:
        q = c.withColumn("q", F.lit(float(constant)))
    else:
        one = forecast.where(F.col("q").isNotNull()).groupBy("COMID").agg(F.min("q").alias("q")) if "place" not in forecast.columns else forecast.where(F.col("q").isNotNull()).groupBy("COMID").agg(F.min_by("q", "place").alias("q"))
        q = c.join(one, "COMID")
    point = F.struct(F.col("Discharge_cms").alias("x"), F.col("Stage_m").alias("h"))
    below, above = F.col("Discharge_cms") <= F.col("q"), F.col("Discharge_cms") > F.col("q")
    found = q.groupBy("HYDROID", "COMID", "q").agg(F.max_by(F.when(below, point), F.when(below, F.col("Stage_m"))).alias("lo"), F.min_by(F.when(above, point), F.when(above, F.col("Stage_m"))).alias("hi"))
    lo, hi, x = F.col("lo"), F.col("hi"), F.col("q")
    stage = F.when(lo.isNull(), 0.0).when(hi.isNull() & (x > lo["x"]), -32768.0).when(hi.isNull(), lo["h"]).otherwise(lo["h"] + (x - lo["x"]) * (hi["h"] - lo["h"]) / F.nullif(hi["x"] - lo["x"], F.lit(0.0)))
    return found.select("HYDROID", "COMID", F.col("q").alias("Discharge_cms"), stage.alias("Stage_m"))
