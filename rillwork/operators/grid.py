"""Neighbours, places and tiles of a raster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import Grid

#: Direction: (row step, column step, bit code); the order decides ties.
DIRECTIONS = {"ne": (-1, 1, 1), "e": (0, 1, 2), "se": (1, 1, 4), "s": (1, 0, 8), "sw": (1, -1, 16), "w": (0, -1, 32), "nw": (-1, -1, 64), "n": (-1, 0, 128)}


def _beside(axis: str, step: int, name: str) -> Column:
    """The value one step along an axis; NULL beyond the edge and where the row is absent."""
    window = Window.partitionBy("col" if axis == "row" else "row").orderBy(axis)
    shift = F.lag if step < 0 else F.lead
    return F.when(shift(axis).over(window) == F.col(axis) + step, shift(name).over(window))


def with_neighbours(cells: DataFrame, value: str = "value", diagonal: bool = False, by_row_first: bool = False) -> DataFrame:
    """``cells`` with the neighbours' values as columns n, s, e, w (and ne, se, sw, nw): NULL beyond the edge, where there is no data, and
    where a row is absent. Two exchanges, by column and then by row, or the other way round: one is spared if the cells lie so already. No task holds more than one
    row or column of cells at a time."""
    if by_row_first and not diagonal:
        return with_neighbours_of(with_neighbours_of(cells, value, "col", "we"), value, "row", "ns")
    v = with_neighbours_of(cells, value, "row", "ns")
    columns = {"w": _beside("col", -1, value), "e": _beside("col", 1, value)}
    if diagonal:
        columns |= {a + b: _beside("col", 1 if b == "e" else -1, a) for a in "ns" for b in "ew"}
    return v.withColumns(columns)


def with_neighbours_of(cells: DataFrame, value: str, axis: str, names: str) -> DataFrame:
    return cells.withColumns({names[0]: _beside(axis, -1, value), names[1]: _beside(axis, 1, value)})


def with_next(cells: DataFrame, value: str, axis: str) -> DataFrame:
    """``cells`` with the values ``before`` and ``after`` along one axis: one exchange, or none if they lie by it already."""
    return cells.withColumns({"before": _beside(axis, -1, value), "after": _beside(axis, 1, value)})


def cell_id(grid: Grid, row: Column | None = None, col: Column | None = None) -> Column:
    return ((F.col("row") if row is None else row) * F.lit(grid.width) + (F.col("col") if col is None else col)).cast("long")


def xy_of(grid: Grid) -> tuple[Column, Column]:
    """Centre of a cell."""
    return F.lit(grid.x0) + (F.col("col") + 0.5) * grid.cell, F.lit(grid.y0) - (F.col("row") + 0.5) * grid.cell


def rowcol_of(grid: Grid, x: Column, y: Column) -> tuple[Column, Column]:
    return F.floor((F.lit(grid.y0) - y) / grid.cell).cast("long"), F.floor((x - F.lit(grid.x0)) / grid.cell).cast("long")


def sample(cells: DataFrame, points: DataFrame, grid: Grid) -> DataFrame:
    """``points`` (x, y, ...) with the raster's value below each; NULL outside."""
    row, col = rowcol_of(grid, F.col("x"), F.col("y"))
    return points.withColumns({"row": row, "col": col}).join(cells.select("row", "col", "value"), ["row", "col"], "left")


def numbered(df: DataFrame, key: str, name: str, block: int = 1 << 20) -> DataFrame:
    """``df`` with 1, 2, ... in the order of the distinct integer ``key``: row numbers within blocks of keys, and running totals of the blocks."""
    b = F.floor(F.col(key) / block)
    counts = df.groupBy(b.alias("__block")).count()
    before = counts.select("__block", (F.sum("count").over(Window.orderBy("__block")) - F.col("count")).alias("__before"))  # a row per million keys
    ranked = df.withColumn("__block", b).join(before, "__block")
    place = F.row_number().over(Window.partitionBy("__block").orderBy(key)) + F.col("__before")
    return ranked.withColumn(name, place.cast("long")).drop("__block", "__before")
