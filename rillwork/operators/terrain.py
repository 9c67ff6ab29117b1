"""Derivatives and noise filtering of a terrain model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Grid
from .algebra import plotting_quantile
from .grid import with_neighbours, with_next


def _difference(before: str, value: Column, after: str, at: Column, last: int, cell: float) -> Column:
    """Central difference inside, one-sided at the edge of the grid. A neighbour without data makes NULL: it is no edge."""
    b, a = F.col(before), F.col(after)
    return F.when(at == 0, (a - value) / cell).when(at == last, (value - b) / cell).otherwise((a - b) / (2 * cell))


def gradient(cells: DataFrame, grid: Grid, value: str = "value") -> DataFrame:
    """``cells`` with gy (down the rows) and gx."""
    near = with_neighbours(cells, value)
    z = F.col(value)
    gy = _difference("n", z, "s", F.col("row"), grid.height - 1, grid.cell)
    gx = _difference("w", z, "e", F.col("col"), grid.width - 1, grid.cell)
    return near.withColumns({"gy": gy, "gx": gx}).drop("n", "s", "e", "w")


def slope(cells: DataFrame, grid: Grid) -> DataFrame:
    """(row, col, value): the magnitude of the gradient, NULL where there is no data."""
    g = gradient(cells, grid)
    steep = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    return g.select("row", "col", F.when(F.col("value").isNotNull(), steep).alias("value"))


def curvature(cells: DataFrame, grid: Grid, method: str = "geometric") -> DataFrame:
    """(row, col, value): divergence of the unit gradient ("geometric") or of the gradient ("laplacian"). Undefined counts as 0; no data
    stays NULL."""
    if method not in ("geometric", "laplacian"):
        raise ValueError("method must be geometric or laplacian")
    g = gradient(cells, grid)
    if method == "geometric":
        steep = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
        g = g.withColumn("steep", steep).withColumns({"gx": F.try_divide("gx", "steep"), "gy": F.try_divide("gy", "steep")}).drop("steep")
    # gradient() leaves the cells by row, so the step along the row needs no exchange, and the one down the column a single one
    last = {"row": grid.height - 1, "col": grid.width - 1}
    for u, axis in (("gx", "col"), ("gy", "row")):
        g = with_next(g, u, axis).withColumn(u, _difference("before", F.col(u), "after", F.col(axis), last[axis], grid.cell)).drop("before", "after")
    return g.select("row", "col", F.when(F.col("value").isNotNull(), F.coalesce(F.col("gx") + F.col("gy"), F.lit(0.0))).alias("value"))


def edge_threshold(cells: DataFrame, grid: Grid, quantile: float = 0.9) -> float | None:
    """The quantile of the gradient's magnitude beyond which an edge is taken for real."""
    g = gradient(cells, grid)
    return plotting_quantile(g.select(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("g")), "g", quantile)


METHODS = ("PeronaMalik1", "PeronaMalik2", "linear")


def diffuse(cells: DataFrame, grid: Grid, kappa: float, iterations: int, step: float = 0.1, method: str = "PeronaMalik2") -> DataFrame:
    """Anisotropic diffusion, each iteration as window expressions; for a few iterations. See diffuse_tiled."""
    _check(method)

    def flux(d: Column) -> Column:
        if method == "linear":
            return d
        q = (d / kappa) * (d / kappa)
        return d / (1 + q) / grid.cell if method == "PeronaMalik2" else F.exp(-q) * d / grid.cell

    out = cells.select("row", "col", F.col("value").cast("double").alias("value"))
    z, row, col = F.col("value"), F.col("row"), F.col("col")
    for k in range(iterations):
        near = with_neighbours(out, by_row_first=k % 2 == 1)  # each iteration begins as the last one left the cells: one exchange each
        south = F.when(row == grid.height - 1, 0.0).otherwise(flux(F.col("s") - z))
        north = F.when(row == 0, 0.0).otherwise(flux(z - F.col("n")))
        east = F.when(col == grid.width - 1, 0.0).otherwise(flux(F.col("e") - z))
        west = F.when(col == 0, 0.0).otherwise(flux(z - F.col("w")))
        ns, ew = south - north, east - west
        change = F.when(ns.isNull() & ew.isNull(), None).otherwise(F.coalesce(ns, F.lit(0.0)) + F.coalesce(ew, F.lit(0.0)))
        out = near.select("row", "col", (z + step * change).alias("value"))
    return out


def _check(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")


def diffuse_array(z: np.ndarray, top: bool, bottom: bool, left: bool, right: bool, kappa: float, iterations: int, step: float, cell: float, method: str) -> np.ndarray:
    """The same on an array; the flags say which of its sides are edges of the grid. Other sides lose one cell an iteration."""
    z = z.astype(np.float64)
    for _ in range(iterations):
        d = np.diff(z, axis=0), np.diff(z, axis=1)
        flows = []
        for x in d:
            if method == "linear":
                flows.append(x)
            elif method == "PeronaMalik2":
                flows.append(x / (1 + (x / kappa) ** 2) / cell)
            else:
                flows.append(np.exp(-((x / kappa) ** 2)) * x / cell)
        down = np.pad(flows[0], ((0, 1), (0, 0)), constant_values=0.0 if bottom else np.nan) - np.pad(flows[0], ((1, 0), (0, 0)), constant_values=0.0 if top else np.nan)
        over = np.pad(flows[1], ((0, 0), (0, 1)), constant_values=0.0 if right else np.nan) - np.pad(flows[1], ((0, 0), (1, 0)), constant_values=0.0 if left else np.nan)
        lost = np.isnan(down) & np.isnan(over)
        z = np.where(lost, np.nan, z + step * (np.nan_to_num(down) + np.nan_to_num(over)))
    return z


def tiles_with_halo(cells: DataFrame, size: int, halo: int) -> DataFrame:
    """``cells`` with the tiles (tr, tc) whose halo they lie in; a cell far from a tile's border has one."""
    low = lambda x: F.floor((F.col(x) - halo) / size)
    high = lambda x: F.floor((F.col(x) + halo) / size)
    rows = cells.withColumn("tr", F.explode(F.sequence(low("row"), high("row"))))
    return rows.withColumn("tc", F.explode(F.sequence(low("col"), high("col"))))


def map_tiles(cells: DataFrame, grid: Grid, size: int, halo: int, kernel: Callable[[np.ndarray, int, int], np.ndarray]) -> DataFrame:
    """kernel(values with halo, first row, first column) on each tile; its core is the result. One exchange; NULL is NaN inside."""
    height, width = grid.height, grid.width

    def run(table: pa.Table) -> pa.Table:
        tr, tc = table["tr"][0].as_py(), table["tc"][0].as_py()
        r0, r1 = max(0, tr * size - halo), min(height, (tr + 1) * size + halo)
        c0, c1 = max(0, tc * size - halo), min(width, (tc + 1) * size + halo)
        r, c = table["row"].to_numpy(), table["col"].to_numpy()
        inside = (r >= r0) & (r < r1) & (c >= c0) & (c < c1)
        z = np.full((r1 - r0, c1 - c0), np.nan)
        z[r[inside] - r0, c[inside] - c0] = table["value"].to_numpy(zero_copy_only=False)[inside]
        out = kernel(z, r0, c0)
        core = (r // size == tr) & (c // size == tc)
        r, c = r[core], c[core]
        value = out[r - r0, c - c0]
        return pa.table({"row": r, "col": c, "value": pa.array(value, mask=np.isnan(value))})

    spread = tiles_with_halo(cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value")), size, halo)
    spread = spread.where((F.col("tr") >= 0) & (F.col("tc") >= 0) & (F.col("tr") * size < height) & (F.col("tc") * size < width))
    return spread.groupBy("tr", "tc").applyInArrow(run, "row long, col long, value double")


def diffuse_tiled(cells: DataFrame, grid: Grid, kappa: float, iterations: int = 50, step: float = 0.1, method: str = "PeronaMalik2", size: int = 512) -> DataFrame:
    """diffuse() for many iterations: tiles with a halo as wide as the iterations run on their own, with a single exchange."""
    _check(method)
    height, width, cell = grid.height, grid.width, grid.cell

    def kernel(z: np.ndarray, r0: int, c0: int) -> np.ndarray:
        h, w = z.shape
        return diffuse_array(z, r0 == 0, r0 + h == height, c0 == 0, c0 + w == width, kappa, iterations, step, cell, method)

    return map_tiles(cells, grid, size, iterations + 1, kernel)


def gaussian_smooth(cells: DataFrame, grid: Grid, sigma: float, radius: int = 2, size: int = 512) -> DataFrame:
    """Gaussian smoothing over (2 radius + 1)^2 cells that have data, with the weights they have."""

    def kernel(z: np.ndarray, r0: int, c0: int) -> np.ndarray:
        some, filled = ~np.isnan(z), np.nan_to_num(z)
        total, weight = np.zeros_like(filled), np.zeros_like(filled)
        h, w = z.shape
        for i in range(-radius, radius + 1):
            for j in range(-radius, radius + 1):
                g = np.exp(-(i * i + j * j) / (2 * sigma * sigma))
                a = slice(max(0, i), h + min(0, i)), slice(max(0, j), w + min(0, j))
                b = slice(max(0, -i), h + min(0, -i)), slice(max(0, -j), w + min(0, -j))
                total[b] += g * filled[a]
                weight[b] += g * some[a]
        return np.where(some, total / np.where(weight > 0, weight, 1), np.nan)

    return map_tiles(cells, grid, size, radius, kernel)
