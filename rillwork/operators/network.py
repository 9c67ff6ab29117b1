"""Channel networks: skeletons, geodesic distance, channel heads, least-cost paths and their segments, nearest-channel elevation."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import Grid
from .algebra import threshold_mask, with_statistics
from .graph import components, cut
from .grid import cell_id
from .hydrology import connected
from .tiles import NEIGHBOURS, fixpoint

UNREACHED = 1e18


def skeleton(cells: DataFrame, fac_threshold: float | None = 3000.0, curvature_deviations: float | None = 1.5) -> DataFrame:
    """(row, col, value): 1 where the curvature is over its mean plus so many standard deviations and the accumulation over its threshold.

    cells has curvature and fac; None leaves a test out. Never NULL.
    """
    curv = F.when(F.abs("curvature") < float("inf"), F.col("curvature"))
    s = with_statistics(cells.select("row", "col", curv.alias("curvature"), "fac"), __m=F.avg("curvature"), __s=F.stddev_pop("curvature"))
    tests: list[tuple[Column, Column]] = []
    if curvature_deviations is not None:
        tests.append((F.col("curvature"), F.col("__m") + curvature_deviations * F.col("__s")))
    if fac_threshold is not None:
        tests.append((F.when(F.col("curvature").isNotNull(), F.col("fac")), F.lit(float(fac_threshold))))
    return s.select("row", "col", threshold_mask(*tests).alias("value"))


def same_value_regions(cells: DataFrame, grid: Grid, size: int = 512) -> DataFrame:
    """(row, col, HYDROID, region): 8-connected regions of equal value over 0."""
    at = cells.where(F.col("value") > 0).select(cell_id(grid).alias("id"), "row", "col", F.col("value").cast("long").alias("HYDROID"))
    half = [(0, 1), (1, -1), (1, 0), (1, 1)]
    near = at.select("id", "HYDROID", F.explode(F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in half])).alias("p")).select(F.col("id").alias("a"), F.col("HYDROID").alias("ha"), "p.row", "p.col")
    edges = near.join(at.select("row", "col", F.col("id").alias("b"), F.col("HYDROID").alias("hb")), ["row", "col"]).where("ha = hb").select("a", "b")
    labels = components(at.select("id"), edges)
    return at.join(labels, "id").select("row", "col", "HYDROID", F.col("label").alias("region"))


def region_sizes(mask: DataFrame, grid: Grid, size: int = 512) -> tuple[DataFrame, DataFrame]:
    """(row, col, label) of the cells over 0, and (label, cells)."""
    labels = cut(connected(mask, grid, size).where(F.col("value").isNotNull()).select("row", "col", F.col("value").alias("label")))
    return labels, labels.groupBy("label").agg(F.count("*").alias("cells"))


def size_threshold(sizes: DataFrame) -> float:
    """The third edge of a histogram, with floor(sqrt(n)) bins, of the sizes of all regions but the largest."""
    r = sizes.agg(F.count("*").alias("n"), F.min("cells").alias("low"), F.max("cells").alias("top")).first()
    bins = math.isqrt(r["n"])
    if bins < 2:
        raise ValueError("at least four regions are needed")
    rest = sizes.where(F.col("cells") < r["top"]).agg(F.max("cells").alias("high"), F.count("*").alias("n")).first()
    high = r["top"] if rest["n"] < r["n"] - 1 else rest["high"]
    low = r["low"]
    if low == high:
        low, high = low - 0.5, high + 0.5
    return low + 2 * (high - low) / bins


def channel_heads(mask: DataFrame, distance: DataFrame, grid: Grid, reach: int = 30, least: float | None = None, most: int | None = None, symmetric: bool = False, size: int = 512) -> DataFrame:
    """(row, col) of the cells of large regions that no cell of the same region in the window around exceeds in distance. A cell without distance is a
    head. The window never takes in row 0 or column 0 from further down unless ``symmetric``; ``most`` keeps the first in row-major order."""
    labels, sizes = region_sizes(mask, grid, size)
    least = size_threshold(sizes) if least is None else least
    large = labels.join(sizes.where(F.col("cells") >= least).select("label"), "label").join(distance.select("row", "col", F.col("value").alias("d")), ["row", "col"], "left")
    large = cut(large)
    # candidates meet those of the same region in the window: joined by blocks of the window's size, so a region may be of any size
    block = lambda x: F.floor(F.col(x) / (reach + 1))
    b = large.where(F.col("d").isNotNull()).select(F.col("label").alias("l2"), F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("d").alias("d2"), block("row").alias("br"), block("col").alias("bc"))
    a = large.where(F.col("d").isNotNull()).withColumn("br", F.explode(F.sequence(block("row") - 1, block("row") + 1))).withColumn("bc", F.explode(F.sequence(block("col") - 1, block("col") + 1)))

    def inside(x: str, other: str, last: int) -> Column:
        if symmetric:
            return F.abs(F.col(other) - F.col(x)) <= reach
        low = F.col(x) - F.least(F.lit(reach), F.col(x) - 1)
        return (F.col(other) >= low) & (F.col(other) <= F.col(x) + F.least(F.lit(reach), F.lit(last) - F.col(x)))

    beaten = a.join(b, ["br", "bc"]).where((F.col("label") == F.col("l2")) & (F.col("d2") > F.col("d")) & inside("row", "r2", grid.height) & inside("col", "c2", grid.width)).select("row", "col").distinct()
    heads = large.join(beaten, ["row", "col"], "left_anti").select("row", "col")
    return heads if most is None else heads.orderBy("row", "col").limit(most)


def travel_starts(basins: DataFrame, outlets: DataFrame, grid: Grid, more_than: int = 2, area_percent: float = 0.1) -> DataFrame:
    """(row, col, basin, cells): the outlets of the basins that are large enough."""
    counts = basins.where(F.col("value").isNotNull()).groupBy(F.col("value").alias("basin")).agg(F.count("*").alias("cells"))
    large = counts.where((F.col("cells") > more_than) & (F.col("cells") * 100.00001 / (grid.height * grid.width) > area_percent))
    at = outlets.where("value = 1").select("row", "col").join(basins.select("row", "col", F.col("value").alias("basin")), ["row", "col"])
    return at.join(large, "basin").select("row", "col", "basin", "cells")


def geodesic_distance(cells: DataFrame, starts: DataFrame, dx: float = 0.01) -> DataFrame:
    """(row, col, value): travel time from each basin's outlet, |grad T| speed = 1, first-order upwind fast marching; NULL where none comes.

    cells has basin and speed (NULL or 0 is a barrier); starts (row, col, basin). The basins are independent tasks.
    """
    places = starts.select("basin", F.col("row").alias("r0"), F.col("col").alias("c0"))
    inside = cells.where(F.col("basin").isNotNull()).select("row", "col", "basin", F.col("speed").cast("double").alias("speed")).join(places, "basin")

    def march(t: pa.Table) -> pa.Table:
        r, c = t["row"].to_numpy(), t["col"].to_numpy()
        speed = {(i, j): v for i, j, v in zip(r.tolist(), c.tolist(), t["speed"].to_pylist()) if v is not None and v > 0}
        first = (t["r0"][0].as_py(), t["c0"][0].as_py())
        time, done = {first: 0.0}, set()
        heap = [(0.0, *first)]
        while heap:
            now, i, j = heapq.heappop(heap)
            if (i, j) in done:
                continue
            done.add((i, j))
            for p in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
                if p not in speed or p in done:
                    continue
                known = lambda q: time[q] if q in done else math.inf
                a = min(known((p[0] - 1, p[1])), known((p[0] + 1, p[1])))
                b = min(known((p[0], p[1] - 1)), known((p[0], p[1] + 1)))
                f = dx / speed[p]
                new = min(a, b) + f if abs(a - b) >= f else (a + b + math.sqrt(2 * f * f - (a - b) ** 2)) / 2
                if new < time.get(p, math.inf):
                    time[p] = new
                    heapq.heappush(heap, (new, *p))
        value = [time.get((i, j)) for i, j in zip(r.tolist(), c.tolist())]
        return pa.table({"row": r, "col": c, "value": pa.array(value, pa.float64())})

    cast = inside.select(*[F.col(x).cast("long").alias(x) for x in ("row", "col", "basin", "r0", "c0")], "speed")
    return cast.groupBy("basin").applyInArrow(march, "row long, col long, value double")


def nearest_channel(cells: DataFrame, grid: Grid, size: int = 512) -> DataFrame:
    """(row, col, distance, bed): the chamfer distance (1 and 1.414) to the nearest channel cell and its elevation; of equally near ones the
    lower. cells has value (elevation) and channel (1)."""

    def relax(inputs: np.ndarray, state: np.ndarray, halo: np.ndarray, r0: int, c0: int) -> np.ndarray:
        z, channel = inputs
        h, w = z.shape
        near = np.where(np.isnan(halo), np.inf, halo)
        on = channel == 1
        dist, bed = np.where(on, 0.0, np.inf), np.where(on, z, np.inf)
        heap = [(0.0, float(z[r, c]), int(r), int(c)) for r, c in zip(*np.nonzero(on))]
        for r in range(-1, h + 1):
            for c in range(-1, w + 1):
                if (r in (-1, h) or c in (-1, w)) and np.isfinite(near[0, r + 1, c + 1]):
                    heap.append((float(near[0, r + 1, c + 1]), float(near[1, r + 1, c + 1]), r, c))
        heapq.heapify(heap)
        while heap:
            d, b, r, c = heapq.heappop(heap)
            if 0 <= r < h and 0 <= c < w and (d, b) > (dist[r, c], bed[r, c]):
                continue
            for dr, dc in NEIGHBOURS:
                i, j = r + dr, c + dc
                if 0 <= i < h and 0 <= j < w:
                    new = (d + (1.414 if dr and dc else 1.0), b)
                    if new < (dist[i, j], bed[i, j]):
                        dist[i, j], bed[i, j] = new
                        heapq.heappush(heap, (*new, i, j))
        return np.stack([dist, bed])

    got = fixpoint(cells, grid, ["value", "channel"], ["distance", "bed"], relax, relax, size)
    finite = lambda x: F.when(F.col(x) < float("inf"), F.col(x))
    return got.select("row", "col", finite("distance").alias("distance"), finite("bed").alias("bed"))


def binary_hand(cells: DataFrame, grid: Grid, size: int = 512) -> DataFrame:
    """(row, col, value): 0 where the nearest channel cell lies lower, else 1; without any channel 0; NULL without data."""
    bed = nearest_channel(cells, grid, size)
    both = cells.join(bed, ["row", "col"])
    value = F.when(F.col("bed").isNull() | (F.col("bed") < F.col("value")), 0).otherwise(1)
    return both.select("row", "col", F.when(F.col("value").isNotNull(), value).alias("value"))


def _cheapest(cost: np.ndarray, a: tuple[int, int], b: tuple[int, int]) -> tuple[list[tuple[int, int]], float, float]:
    """(path, its cost, the least cost of any way out of the window on the way): edges cost the mean of their ends times their length."""
    h, w = cost.shape

    def spread(source: tuple[int, int]) -> tuple[np.ndarray, dict]:
        dist, back = np.full((h, w), np.inf), {}
        dist[source] = 0.0
        heap = [(0.0, *source)]
        while heap:
            d, r, c = heapq.heappop(heap)
            if d > dist[r, c]:
                continue
            for dr, dc in NEIGHBOURS:
                i, j = r + dr, c + dc
                if 0 <= i < h and 0 <= j < w:
                    new = d + (cost[r, c] + cost[i, j]) / 2 * (math.sqrt(2) if dr and dc else 1.0)
                    if new < dist[i, j]:
                        dist[i, j] = new
                        back[i, j] = (r, c)
                        heapq.heappush(heap, (new, i, j))
        return dist, back

    dist, back = spread(a)
    path, at = [b], b
    while at != a:
        at = back[at]
        path.append(at)
    other, _ = spread(b)
    edge = lambda x: min(x[0].min(), x[-1].min(), x[:, 0].min(), x[:, -1].min())
    return path[::-1], float(dist[b]), float(edge(dist) + edge(other))


def least_cost_paths(cells: DataFrame, ends: DataFrame, grid: Grid, margin: int = 64) -> DataFrame:
    """(path_id, seq, row, col): the cheapest 8-connected way between the ends (path_id, r1, c1, r2, c2) over cells (row, col, value > 0).

    Each path is a task on a window of cells around its ends. If leaving the window could be cheaper than the path found, the path is
    searched again in a window twice as wide: the result is that of the whole raster.
    """
    height, width = grid.height, grid.width
    bad = ends.where((F.least("r1", "r2", "c1", "c2") < 0) | (F.greatest("r1", "r2") >= height) | (F.greatest("c1", "c2") >= width))
    if not bad.isEmpty():
        raise ValueError("an end lies outside the grid")
    block = 256
    blocked = cells.select("row", "col", F.col("value").cast("double").alias("value"), F.floor(F.col("row") / block).alias("br"), F.floor(F.col("col") / block).alias("bc"))
    todo, done = cut(ends.select("path_id", *[F.col(c).cast("long").alias(c) for c in ("r1", "c1", "r2", "c2")])), None
    while True:
        low = lambda x: F.greatest(F.least(f"{x}1", f"{x}2") - margin, F.lit(0))  # noqa: E731, B023
        high = lambda x, n: F.least(F.greatest(f"{x}1", f"{x}2") + margin, F.lit(n - 1))  # noqa: E731, B023
        win = todo.withColumns({"ra": low("r"), "rb": high("r", height), "ca": low("c"), "cb": high("c", width)})
        spread = win.withColumn("br", F.explode(F.sequence(F.floor(F.col("ra") / block), F.floor(F.col("rb") / block)))).withColumn("bc", F.explode(F.sequence(F.floor(F.col("ca") / block), F.floor(F.col("cb") / block))))
        near = spread.join(blocked, ["br", "bc"]).where("row BETWEEN ra AND rb AND col BETWEEN ca AND cb").drop("br", "bc")

        def search(t: pa.Table) -> pa.Table:
            one = {c: t[c][0].as_py() for c in ("path_id", "r1", "c1", "r2", "c2", "ra", "rb", "ca", "cb")}
            cost = np.full((one["rb"] - one["ra"] + 1, one["cb"] - one["ca"] + 1), UNREACHED)
            value = t["value"].to_numpy(zero_copy_only=False)
            cost[t["row"].to_numpy() - one["ra"], t["col"].to_numpy() - one["ca"]] = np.where(np.isnan(value), UNREACHED, value)
            path, total, around = _cheapest(cost, (one["r1"] - one["ra"], one["c1"] - one["ca"]), (one["r2"] - one["ra"], one["c2"] - one["ca"]))
            whole = one["ra"] == 0 and one["ca"] == 0 and one["rb"] == height - 1 and one["cb"] == width - 1
            n = len(path)
            return pa.table({"path_id": [one["path_id"]] * n, "seq": list(range(n)), "row": [r + one["ra"] for r, _ in path], "col": [c + one["ca"] for _, c in path], "sure": [whole or total <= around] * n})

        got = cut(near.groupBy("path_id").applyInArrow(search, "path_id long, seq long, row long, col long, sure boolean"))
        sure = got.where("sure").drop("sure")
        done = sure if done is None else done.unionByName(sure)
        todo = cut(todo.join(got.where("NOT sure").select("path_id").distinct(), "path_id", "left_semi"))
        if todo.isEmpty():
            return done
        margin *= 2


def path_segments(paths: DataFrame) -> DataFrame:
    """(key, path_id, seq, row, col): paths cut where they join earlier ones.

    A path keeps its cells while as many paths visit a cell as visited the one before; others are left out, up to the first that an
    earlier path (or its own) starts at, which ends it. Keys count paths and breaks, so they have gaps.
    """
    visits = paths.groupBy("row", "col").agg(F.count("*").alias("visits"))
    starts = paths.where("seq = 0").groupBy("row", "col").agg(F.min("path_id").alias("started"))
    along = Window.partitionBy("path_id").orderBy("seq")
    v = paths.join(visits, ["row", "col"]).join(starts, ["row", "col"], "left").withColumn("before", F.lag("visits").over(along))
    stops = (F.col("seq") > 0) & (F.col("visits") != F.col("before")) & (F.col("started") <= F.col("path_id"))
    v = v.withColumn("brk", F.min(F.when(stops, F.col("seq"))).over(Window.partitionBy("path_id")))
    kept = v.where((F.col("brk").isNull() | (F.col("seq") <= F.col("brk"))) & ((F.col("seq") == 0) | (F.col("visits") == F.col("before")) | (F.col("seq") == F.col("brk"))))
    each = v.groupBy("path_id").agg(F.max(F.col("brk").isNotNull().cast("long")).alias("broke"))  # a row per path
    before = each.select("path_id", (F.row_number().over(Window.orderBy("path_id")) - 1 + F.coalesce(F.sum("broke").over(Window.orderBy("path_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("key"))
    return kept.join(before, "path_id").select(F.col("key").cast("long").alias("key"), "path_id", "seq", "row", "col")
