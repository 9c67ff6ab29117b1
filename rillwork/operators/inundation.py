"""Inundation maps: fluvial, coastal, pluvial and compound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Grid
from .graph import cut
from .hydrology import with_regions
from .network import same_value_regions

#: Stages are one row per catchment; beyond so many rows they are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 2_000_000


def inundate(cells: DataFrame, stages: DataFrame) -> DataFrame:
    """(row, col, value): stage - hand where the stage of the cell's catchment (HYDROID, Stage_m) is higher; NULL where it is dry."""
    s = cut(stages.select(F.col("HYDROID").alias("hydroid"), F.col("Stage_m").alias("stage")))  # a row per catchment, counted and joined
    if s.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        s = F.broadcast(s)
    wet = cells.join(s, "hydroid", "left")
    return wet.select("row", "col", F.when(F.col("stage") > F.col("hand"), F.col("stage") - F.col("hand")).alias("value"))


def coastal(cells: DataFrame, grid: Grid, gage: float, ocean: tuple[int, int], size: int = 512) -> DataFrame:
    """(row, col, value): gage - elevation in the 8-connected wet region of the ocean cell (row, col); NULL elsewhere. A dry ocean cell gives
    no water at all."""
    depth = cells.select("row", "col", F.when(F.col("value") < gage, F.lit(float(gage)) - F.col("value")).alias("value"))
    regions = with_regions(depth, grid, size)
    sea = regions.where((F.col("row") == ocean[0]) & (F.col("col") == ocean[1])).select("region").first()
    reached = F.lit(False) if sea is None or sea[0] is None else F.col("region") == sea[0]
    return regions.select("row", "col", F.when(reached, F.col("value")).alias("value"))


def compound(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, col, value): the greater of two depths; where only one map is wet, that one. Depths of 0 and less are dry."""
    x = a.select("row", "col", F.when(F.col("value") > 0, F.col("value")).alias("x"))
    y = b.select("row", "col", F.when(F.col("value") > 0, F.col("value")).alias("y"))
    return x.join(y, ["row", "col"], "full").select("row", "col", F.greatest("x", "y").alias("value"))


def region_areas(cells: DataFrame, grid: Grid, size: int = 512) -> DataFrame:
    """(HYDROID, region, cells, AreaSqKm): the 8-connected regions of equal value over 0, named by their least cell id."""
    labels = same_value_regions(cells, grid, size)
    area = grid.cell * grid.cell * grid.unit * grid.unit / 1e6
    return labels.groupBy("HYDROID", "region").agg(F.count("*").alias("cells")).withColumn("AreaSqKm", F.col("cells") * area)


def align(source: DataFrame, source_grid: Grid, target_grid: Grid) -> DataFrame:
    """``source`` (row, col, value) bilinearly resampled to the cells of ``target_grid`` that it covers; cells without data are left out of the
    weights."""
    x = F.lit(target_grid.x0) + (F.col("col") + 0.5) * target_grid.cell
    y = F.lit(target_grid.y0) - (F.col("row") + 0.5) * target_grid.cell
    spark = source.sparkSession
    fc, fr = (x - source_grid.x0) / source_grid.cell - 0.5, (F.lit(source_grid.y0) - y) / source_grid.cell - 0.5
    target = spark.range(target_grid.height * target_grid.width).select(F.floor(F.col("id") / target_grid.width).alias("row"), F.pmod("id", F.lit(target_grid.width)).alias("col"))
    at = target.withColumns({"fr": fr, "fc": fc})
    corners = F.array(*[F.struct((F.floor("fr") + i).alias("sr"), (F.floor("fc") + j).alias("sc")) for i in (0, 1) for j in (0, 1)])
    near = at.withColumn("corner", F.explode(corners)).select("row", "col", "fr", "fc", "corner.sr", "corner.sc")
    s = source.where(F.col("value").isNotNull()).select(F.col("row").alias("sr"), F.col("col").alias("sc"), "value")
    weight = (1 - F.abs(F.col("fr") - F.col("sr"))) * (1 - F.abs(F.col("fc") - F.col("sc")))
    got = near.join(s, ["sr", "sc"]).withColumn("w", weight).where(F.col("w") > 0)
    return got.groupBy("row", "col").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
