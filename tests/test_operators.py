"""Operators on small grids by hand, on invariants, and independent of the size of tiles."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.operators import algebra, depressions, graph, hydrology, inundation, network, rating, terrain, vector
from rillwork.operators.grid import numbered
from rillwork.operators.tiles import NEIGHBOURS
from rillwork.schema import Grid, require


def raster(spark, z):
    z = np.asarray(z, float)
    rows = [(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return Grid(*z.shape), spark.createDataFrame(rows, "row long, col long, value double")


def array(df, grid, column="value"):
    out = np.full((grid.height, grid.width), np.nan)
    for r in df.collect():
        if r[column] is not None:
            out[r["row"], r["col"]] = r[column]
    return out


def noise(h, w, seed=0, holes=0.0):
    rng = np.random.default_rng(seed)
    z = rng.random((h, w)).round(3)
    z[rng.random((h, w)) < holes] = np.nan
    return z


def test_slope_matches_numpy_and_tells_edges_from_holes(spark):
    z = noise(7, 6)
    z[3, 3] = np.nan
    g, cells = raster(spark, z)
    gy, gx = np.gradient(z, 1.0)
    want = np.sqrt(gx**2 + gy**2)
    want[np.isnan(z)] = np.nan
    assert np.allclose(array(terrain.slope(cells, g), g), want, equal_nan=True)


@pytest.mark.parametrize("method", ["geometric", "laplacian"])
def test_curvature(spark, method):
    z = noise(8, 9, 1, 0.05)
    z[0:3, 0:3] = 0.5  # flat: no direction
    g, cells = raster(spark, z)
    gy, gx = np.gradient(z, 1.0)
    with np.errstate(invalid="ignore"):
        s = np.sqrt(gx**2 + gy**2) if method == "geometric" else 1.0
        want = np.nan_to_num(np.gradient(gx / s, 1.0)[1] + np.gradient(gy / s, 1.0)[0])
    want[np.isnan(z)] = np.nan
    assert np.allclose(array(terrain.curvature(cells, g, method), g), want, equal_nan=True)
    with pytest.raises(ValueError):
        terrain.curvature(cells, g, "other")


@pytest.mark.parametrize("method", terrain.METHODS)
def test_diffusion_by_windows_and_by_tiles(spark, method):
    z = noise(17, 13, 2, 0.04)
    g, cells = raster(spark, z)
    a = array(terrain.diffuse(cells, g, 0.2, 3, method=method), g)
    for size in (5, 8, 64):
        assert np.allclose(array(terrain.diffuse_tiled(cells, g, 0.2, 3, method=method, size=size), g), a, equal_nan=True)
    full, cells = raster(spark, noise(9, 9, 3))
    assert array(terrain.diffuse_tiled(cells, full, 0.2, 20, method=method, size=4), full).sum() == pytest.approx(noise(9, 9, 3).sum())


def test_gaussian(spark):
    g, cells = raster(spark, np.full((6, 6), 2.0))
    assert np.allclose(array(terrain.gaussian_smooth(cells, g, 1.0, size=4), g), 2.0)


def test_plotting_quantile(spark):
    x = np.sort(np.random.default_rng(4).random(101))
    n, p = len(x), 0.9
    place = n * p + 0.4 + 0.2 * p
    k = int(place)
    want = x[k - 1] + (place - k) * (x[k] - x[k - 1])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    assert algebra.plotting_quantile(df, "v", p) == pytest.approx(want)
    assert algebra.plotting_quantile(df.limit(0), "v", p) is None


def filled(z):
    h, w = z.shape
    level, heap = np.full(z.shape, np.inf), []
    for r in range(h):
        for c in range(w):
            near = [(r + a, c + b) for a, b in NEIGHBOURS]
            if not np.isnan(z[r, c]) and any(not (0 <= i < h and 0 <= j < w) or np.isnan(z[i, j]) for i, j in near):
                level[r, c] = z[r, c]
                heap.append((z[r, c], r, c))
    heapq.heapify(heap)
    while heap:
        y, r, c = heapq.heappop(heap)
        for a, b in NEIGHBOURS:
            i, j = r + a, c + b
            if 0 <= i < h and 0 <= j < w and not np.isnan(z[i, j]) and max(y, z[i, j]) < level[i, j]:
                level[i, j] = max(y, z[i, j])
                heapq.heappush(heap, (level[i, j], i, j))
    return np.where(np.isnan(z), np.nan, level)


@pytest.mark.parametrize("size", [4, 7, 64])
def test_fill(spark, size):
    z = noise(15, 18, 5, 0.05)
    g, cells = raster(spark, z)
    assert np.allclose(array(hydrology.fill_depressions(cells, g, size), g), filled(z), equal_nan=True)


def test_d8_ties_plateaus_and_valley(spark):
    g, cells = raster(spark, [[5, 5, 5], [5, 3, 5], [5, 5, 5]])
    assert array(hydrology.d8_pointer(cells, g), g).tolist() == [[4, 8, 16], [2, 0, 32], [1, 128, 64]]
    g, cells = raster(spark, np.ones((2, 2)))
    assert array(hydrology.d8_pointer(cells, g), g).tolist() == [[0, 0], [0, 0]]
    g, cells = raster(spark, [[1, 9, 1], [9, 5, 9], [1, 9, 1]])
    assert array(hydrology.d8_pointer(cells, g), g)[1, 1] == 1  # four equal ways: the first in order


def test_valley_flows_to_its_mouth(spark):
    z = [[abs(c - 3) * 10 + (6 - r) for c in range(7)] for r in range(7)]
    g, cells = raster(spark, z)
    d8 = hydrology.d8_pointer(cells, g)
    assert array(hydrology.basins(d8, g), g).tolist() == [[1.0] * 7] * 7
    assert array(hydrology.accumulation_d8(d8, g), g)[6, 3] == 49
    streams = cells.where("col = 3").select("row", "col", F.lit(1).alias("value"))
    hand = array(hydrology.height_above_drainage(cells, d8, streams, g), g)
    assert (hand >= 0).all() and (hand[:, 3] == 0).all()


def test_fd8_is_one_flow_in_any_tiling(spark):
    z = noise(11, 14, 6, 0.05)
    g, cells = raster(spark, z)
    a = array(hydrology.accumulation_fd8(cells, g, size=64), g)
    for size in (3, 5):
        assert np.allclose(array(hydrology.accumulation_fd8(cells, g, size=size), g), a, equal_nan=True)
    d8 = array(hydrology.d8_pointer(cells, g), g)
    assert a[d8 == 0].sum() == pytest.approx((~np.isnan(z)).sum())  # all water ends in the pits


def test_quantiles_are_those_of_percentile(spark, monkeypatch):
    rng = np.random.default_rng(5)
    inf, shares = math.inf, [0.0, 0.001, 0.3, 0.5, 0.999, 1.0]
    columns = {
        "noise": rng.normal(size=3000).tolist() + [None] * 9,
        "few": rng.integers(0, 4, 500).astype(float).tolist(),
        "skew": np.exp(rng.normal(size=1000) * 60).tolist(),
        "odd": [inf, -inf, math.nan, -0.0, 0.0, 1e308, -1e308, 5e-324, 1e-323, None, 1.0, math.nextafter(1.0, 2)] * 7,
        "one": [3.5],
        "two": [1.0, 2.0],
        "none": [None],
        "infinite": [inf, inf, 1.0, math.nan],
    }
    for limit in (1 << 18, 3):
        monkeypatch.setattr(algebra, "DRIVER_VALUES", limit)
        monkeypatch.setattr(algebra, "BINS", 16)
        for name, x in columns.items():
            df = spark.createDataFrame([(v,) for v in x], "value double")
            want = df.agg(*(F.percentile("value", F.lit(p)) for p in shares)).first()
            got = algebra.quantiles(df, "value", shares)
            assert all(a == b or a is not None and math.isnan(a) and math.isnan(b) for a, b in zip(got, want)), (name, limit, got, want)
    assert algebra.quantiles(spark.range(101), "id", [0.5, 0.005]) == [50.0, 0.5]


def test_statistics_hold_no_map_of_all_values(spark):
    g, cells = raster(spark, noise(30, 40, 2, 0.1))
    got = algebra.statistics(cells)
    assert "percentile" not in got._jdf.queryExecution().toString()
    want = cells.agg(F.count("value"), F.avg("value"), F.stddev_pop("value"), F.min("value"), F.max("value"), F.percentile("value", F.lit(0.001)), F.percentile("value", F.lit(0.999))).first()
    assert got.columns == ["n", "mean", "std", "low", "high", "p001", "p999"] and tuple(got.first()) == pytest.approx(tuple(want), rel=1e-12)
    assert algebra.statistics(cells.where("false")).first()["p001"] is None
    cheap = algebra.keep_cheapest(cells, 0.25)
    assert "percentile" not in cheap._jdf.queryExecution().toString() and cheap.where("value < 100000").count() == cells.where(F.col("value") < cells.agg(F.percentile("value", F.lit(0.25))).first()[0]).count()


def test_regions_touch_at_corners(spark):
    g, cells = raster(spark, [[1, 0, 0, 0, 1, 1], [0, 1, 0, 0, 0, 1], [0, 0, 0, 0, 0, 0], [0, 0, 0, 1, 0, 0]])
    for size in (2, 3, 64):
        got = array(hydrology.connected(cells, g, size), g)
        assert got[0, 0] == got[1, 1] == 0 and got[0, 4] == got[0, 5] == got[1, 5] == 4 and got[3, 3] == 21 and np.nansum(~np.isnan(got)) == 6


def test_regions_over_many_tiles_take_no_rounds(spark, monkeypatch):
    z = np.zeros((61, 5))
    z[::2] = 1
    z[1::4, 4] = z[3::4, 0] = 1  # one snake over all tiles
    z[40, 2] = 0  # cut in two
    g, cells = raster(spark, z)
    sc = spark.sparkContext
    try:
        sc.setJobGroup("snake", "")
        got = array(hydrology.connected(cells, g, 2), g)
        coast = array(inundation.coastal(cells.select("row", "col", (1 - F.col("value")).alias("value")), g, 0.5, (60, 0), 2), g)
        jobs = len(sc.statusTracker().getJobIdsForGroup("snake"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 60  # 93 tiles; three jobs a round before
    lower = z > 0
    lower[:40], lower[40, :2] = False, False
    want = np.where(lower, 40 * 5 + 3, np.where(z > 0, 0, np.nan))
    assert np.array_equal(got, want, equal_nan=True) and np.array_equal(~np.isnan(coast), lower)
    monkeypatch.setattr(graph, "DRIVER_EDGES", 0)
    for size in (7, 16):
        assert np.array_equal(array(hydrology.connected(cells, g, size), g), got, equal_nan=True)


def test_regions_are_those_of_a_plain_search(spark):
    z = noise(23, 19, 4, 0.1)
    z = np.where(z > 0.55, z, np.where(np.isnan(z), z, 0))
    g, cells = raster(spark, z)
    want = np.full(z.shape, np.nan)
    for r, c in zip(*np.nonzero(np.nan_to_num(z) > 0)):
        if np.isnan(want[r, c]):
            todo, want[r, c] = [(r, c)], r * 19 + c
            while todo:
                i, j = todo.pop()
                for dr, dc in NEIGHBOURS:
                    a, b = i + dr, j + dc
                    if 0 <= a < 23 and 0 <= b < 19 and np.isnan(want[a, b]) and z[a, b] > 0:
                        want[a, b] = r * 19 + c
                        todo.append((a, b))
    for size in (1, 4, 512):
        assert np.array_equal(array(hydrology.connected(cells, g, size), g), want, equal_nan=True)


def test_coast(spark):
    g, cells = raster(spark, [[0, 5, 0], [0, 5, 0], [1, 5, 2], [9, 9, np.nan]])
    got = array(inundation.coastal(cells, g, 3.0, (0, 0), 2), g)
    assert got[:, 0].tolist()[:3] == [3, 3, 2] and np.isnan(got[:, 1:]).all()
    assert np.isnan(array(inundation.coastal(cells, g, 3.0, (0, 1), 2), g)).all()  # a dry ocean cell
    low, high = array(inundation.coastal(cells, g, 3.0, (0, 0)), g), array(inundation.coastal(cells, g, 6.0, (0, 0)), g)
    assert (np.nan_to_num(high) >= np.nan_to_num(low)).all()


def test_compound(spark):
    _, a = raster(spark, [[1, 0, np.nan, 4]])
    g, b = raster(spark, [[2, 3, 5, np.nan]])
    assert array(inundation.compound(a, b), g).tolist() == [[2, 3, 5, 4]]


def test_compound_with_a_coast_over_many_tiles(spark):
    z = np.zeros((41, 5))
    z[1::2] = 9  # dry walls
    z[1::4, 4] = z[3::4, 0] = 0  # with gaps at alternate ends
    g, cells = raster(spark, z)
    _, rain = raster(spark, np.where(np.arange(41)[:, None] % 2, 2.0, 0.25) + np.zeros(5))
    sc = spark.sparkContext
    try:
        sc.setJobGroup("compound", "")
        got = array(inundation.compound(rain, inundation.coastal(cells, g, 0.5, (0, 0), 2)), g)
        jobs = len(sc.statusTracker().getJobIdsForGroup("compound"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 60  # 63 tiles; three jobs a round before
    assert np.array_equal(got, np.where(np.arange(41)[:, None] % 2, 2.0, 0.5) + np.zeros(5))


def test_hypsometry_is_the_naive_count(spark):
    rng = np.random.default_rng(7)
    rows = [(i, None if i % 9 == 0 else float(rng.choice([0.0, 0.1, 0.3, 0.7000000000000001, rng.random() * 3])), float(rng.random()), int(i % 3)) for i in range(300)]
    cells = spark.createDataFrame(rows, "i long, hand double, slope double, hydroid long")
    got = {(r["HYDROID"], r["k"]): r for r in rating.hypsometry(cells, spark.createDataFrame([(0,), (1,), (2,), (5,)], "HYDROID long"), 21, 0.1, 4.0).collect()}
    for (h, k), r in got.items():
        wet = [(x, s) for _, x, s, d in rows if d == h and x is not None and (x < k * 0.1 or abs(x) <= 1e-8)]
        assert r["NumCells"] == len(wet) and r["SurfaceArea_m2"] == 4.0 * len(wet)
        assert r["Volume_m3"] == pytest.approx(4 * sum(k * 0.1 - x for x, _ in wet), abs=1e-9) and r["BedArea_m2"] == pytest.approx(4 * sum(math.sqrt(1 + s * s) for _, s in wet))
    assert len(got) == 84


def test_stage_lookup(spark):
    points = [(1, 10, 0.0, 0.0), (1, 10, 0.1, 0.0), (1, 10, 0.2, 0.0), (1, 10, 0.3, 1.0), (1, 10, 0.4, 2.0), (2, None, 0.0, 0.0), (3, 11, 0.0, 5.0), (3, 11, 0.1, 6.0)]
    curve = spark.createDataFrame(points, "HYDROID long, COMID long, Stage_m double, Discharge_cms double")

    def at(q):
        return {r["HYDROID"]: r["Stage_m"] for r in rating.flood_stage(curve, constant=q).collect()}

    assert at(0.0)[1] == 0.2 and at(0.5)[1] == pytest.approx(0.25) and at(2.0)[1] == 0.4 and at(2.1)[1] == -32768 and at(-1.0)[1] == 0
    assert 2 not in at(1.0) and at(1.0)[3] == 0
    got = rating.flood_stage(curve, spark.createDataFrame([(10, 1.5), (99, 3.0), (11, None)], "COMID long, q double")).collect()
    assert [(r["HYDROID"], r["Stage_m"]) for r in got] == [(1, pytest.approx(0.35))]
    with pytest.raises(ValueError):
        rating.flood_stage(curve)
    with pytest.raises(ValueError):
        rating.check_discharge(curve.withColumn("Discharge_cms", F.lit(None).cast("double")))


def test_splitting(spark):
    line = spark.createDataFrame([(1, i, x, 0.0) for i, x in enumerate([0.0, 4.0, 8.0, 30.0, 31.0])] + [(2, 0, 0.0, 0.0)], "path_id long, seq long, x double, y double")
    got = [(r["part"], r["x"]) for r in vector.split_lines(line, 10.0).orderBy("part", "x").collect()]
    assert got == [(0, 0.0), (0, 4.0), (0, 8.0), (1, 8.0), (1, 30.0), (2, 30.0), (2, 31.0)]
    assert [(r["HYDROID"], r["Length"]) for r in vector.segments(line, 10.0).orderBy("HYDROID").collect()] == [(1, 8.0), (2, 22.0), (3, 1.0)]


def test_merging_paths(spark):
    rows = [(0, s, s, 0) for s in range(5)] + [(1, 0, 0, 2), (1, 1, 1, 1), (1, 2, 2, 0), (1, 3, 3, 0), (1, 4, 4, 0)] + [(2, 0, 3, 0), (2, 1, 4, 0)]
    paths = spark.createDataFrame(rows, "path_id long, seq long, row long, col long")
    got = sorted((r["key"], r["path_id"], r["seq"]) for r in network.path_segments(paths).collect())
    assert got == [(0, 0, 0), (0, 0, 1), (0, 0, 4), (1, 1, 0), (1, 1, 1), (1, 1, 4), (2, 2, 0), (2, 2, 1)]


@pytest.mark.parametrize("margin", [1, 64])
def test_paths_leave_their_window(spark, margin):
    z = np.full((9, 9), 1.0)
    z[:8, 4] = 1000.0  # a wall with a gap at the bottom
    g, cells = raster(spark, z)
    ends = spark.createDataFrame([(1, 0, 3, 0, 5)], "path_id long, r1 long, c1 long, r2 long, c2 long")
    got = [(r["row"], r["col"]) for r in network.least_cost_paths(cells, ends, g, margin).orderBy("seq").collect()]
    assert got[0] == (0, 3) and got[-1] == (0, 5) and (8, 4) in got and len(got) == 17
    with pytest.raises(ValueError):
        network.least_cost_paths(cells, ends.withColumn("c2", F.lit(9)), g)


def test_travel_time_of_a_plane_front(spark):
    cells = spark.createDataFrame([(0, c, 1, 2.0) for c in range(30)] + [(1, 0, 2, 1.0), (1, 1, 2, 0.0)], "row long, col long, basin long, speed double")
    starts = spark.createDataFrame([(0, 0, 1), (1, 0, 2)], "row long, col long, basin long")
    got = {(r["row"], r["col"]): r["value"] for r in network.geodesic_distance(cells, starts).collect()}
    assert all(got[0, c] == pytest.approx(c * 0.005) for c in range(30)) and got[1, 0] == 0 and got[1, 1] is None


def test_heads(spark):
    g, mask = raster(spark, [[0] * 8] + [[0] + [1] * 6 + [0]] + [[0] * 8] * 2)
    distance = mask.select("row", "col", F.when(F.col("col") == 3, None).otherwise(F.col("col").cast("double")).alias("value"))
    got = {(r["row"], r["col"]) for r in network.channel_heads(mask, distance, g, reach=2, least=1).collect()}
    assert got == {(1, 3), (1, 6)}  # no distance: always a head
    assert network.channel_heads(mask, distance, g, reach=2, least=1, most=1).count() == 1
    with pytest.raises(ValueError):
        network.size_threshold(spark.createDataFrame([(1, 3)], "label long, cells long"))


def test_histogram_of_equal_sizes(spark):
    assert network.size_threshold(spark.createDataFrame([(i, 3) for i in range(5)], "label long, cells long")) == 3.5


@pytest.mark.parametrize("size", [3, 64])
def test_nearest_channel(spark, size):
    z = noise(10, 12, 9)
    on = np.zeros_like(z)
    on[2, 3] = on[8, 10] = on[9, 0] = 1
    g, cells = raster(spark, z)
    _, marks = raster(spark, on)
    got = array(network.nearest_channel(cells.join(marks.withColumnRenamed("value", "channel"), ["row", "col"]), g, size), g, "distance")
    for r in range(10):
        for c in range(12):
            want = min(min(abs(r - i), abs(c - j)) * 1.414 + abs(abs(r - i) - abs(c - j)) for i, j in zip(*np.nonzero(on)))
            assert got[r, c] == pytest.approx(want)


def test_water_fills_spills_and_is_kept(spark):
    for seed in range(6):
        z = noise(12, 13, seed, 0.03)
        full = depressions.spread_water(z, np.full(z.shape, 100.0))[0]
        assert np.allclose(full, filled(z) - z, equal_nan=True)
        some = depressions.spread_water(z, np.full(z.shape, 0.02))[0]
        assert (np.nan_to_num(some) <= np.nan_to_num(full) + 1e-9).all() and 0 < np.nansum(some) <= 0.02 * z.size + 1e-9
    pit = np.full((5, 5), 5.0)
    pit[2, 2] = 1.0
    g, cells = raster(spark, pit)
    got = array(depressions.fill_spill_merge(cells.withColumn("water", F.lit(0.25)), g), g)
    assert got[2, 2] == pytest.approx(2.25) and np.isnan(np.delete(got.ravel(), 12)).all()
    table = depressions.hierarchy_table(cells, g).collect()
    assert [(r["pit_cell"], r["pit_elev"], r["out_elev"], r["dep_vol"]) for r in table] == [(12, 1.0, 5.0, 4.0)]


def test_pointers_and_components(spark):
    chain = spark.createDataFrame([(i, max(0, i - 1)) for i in range(70)] + [(100, 100)], "id long, next long")
    assert {(r["id"], r["target"]) for r in graph.resolve(chain).collect()} == {(i, 0) for i in range(70)} | {(100, 100)}
    assert {r["id"]: r["total"] for r in graph.accumulate(chain.withColumn("weight", F.lit(1))).collect()} == {**{i: 70.0 - i for i in range(70)}, 100: 1.0}
    nodes, edges = spark.range(8), spark.createDataFrame([(1, 2), (2, 3), (6, 5)], "a long, b long")
    assert {r["id"]: r["label"] for r in graph.components(nodes, edges).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}


def test_numbers_in_blocks(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k long")
    assert [r["n"] for r in numbered(df, "k", "n", 10).orderBy("k").collect()] == list(range(1, 102))


def test_points_in_rings(spark):
    rings = spark.createDataFrame([(2, i, *p) for i, p in enumerate([(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0)])] + [(1, i, *p) for i, p in enumerate([(5.0, 5.0), (20.0, 5.0), (5.0, 20.0), (5.0, 5.0)])], "ring_id long, seq long, x double, y double")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 6.0, 6.0), (3, 19.0, 19.0)], "point_id long, x double, y double")
    assert {r["point_id"]: r["ring_id"] for r in vector.points_within(points, rings, 4.0).collect()} == {1: 2, 2: 1, 3: None}
    assert {r["ring_id"]: r["area"] for r in vector.polygon_areas(rings).collect()} == {1: 112.5, 2: 81.0}


def test_resampling(spark):
    g, cells = raster(spark, [[0, 1, 2], [0, 1, 2], [0, 1, 2]])
    fine = Grid(6, 6, 0.5)
    got = array(inundation.align(cells, Grid(3, 3, 1.0), fine), fine)
    assert got[2].tolist() == pytest.approx([0, 0.25, 0.75, 1.25, 1.75, 2.0])


def test_missing_columns(spark):
    with pytest.raises(ValueError):
        require(spark.range(1), "hand")


def test_flats_drain(spark):
    z = np.full((6, 7), 5.0)
    z[2:5, 1:6] = 3.0  # a plateau below its rim, with one way out
    z[3, 6] = 3.0
    z[0, 0] = np.nan
    g, cells = raster(spark, z)
    d8 = hydrology.d8_pointer(cells, g)
    for size in (2, 64):
        got = array(hydrology.drain_flats(cells, d8, g, size), g)
        assert got[3, 6] == 0 and (got[2:5, 1:6] > 0).all()
        routed = hydrology.drain_flats(cells, d8, g, size)
        roots = array(hydrology.basins(routed, g), g)
        assert len(set(roots[2:5, 1:6].ravel())) == 1


def test_outlines_with_a_hole_and_touching_corners(spark):
    g, cells = raster(spark, [[1, 1, 1, 0, 0], [1, 0, 1, 0, 0], [1, 1, 1, 0, 2], [0, 0, 0, 1, 2]])
    rings = vector.outlines(network.same_value_regions(cells, g), g).collect()
    area = {}
    for key in {(r["HYDROID"], r["ring"]) for r in rings}:
        p = [(r["x"], r["y"]) for r in sorted((r for r in rings if (r["HYDROID"], r["ring"]) == key), key=lambda r: r["seq"])]
        assert p[0] == p[-1]
        area.setdefault(key[0], []).append(-sum(a * d - c * b for (a, b), (c, d) in zip(p, p[1:])) / 2)
    assert sorted(area[1]) == [-1, 1, 9] and area[2] == [2]


def test_utm(spark):
    from rillwork.functions.projection import from_utm, to_utm, zone_of

    df = spark.createDataFrame([(3.0, 45.0), (2.2945, 48.8582), (0.0, -10.0)], "lon double, lat double")
    e, n = to_utm(F.col("lon"), F.col("lat"), 31)
    rows = df.select("lon", "lat", e.alias("e"), n.alias("n"), zone_of(F.col("lon")).alias("zone")).withColumns(dict(zip(("lon2", "lat2"), from_utm(F.col("e"), F.col("n"), 31)))).collect()
    assert rows[0]["e"] == pytest.approx(500000) and rows[0]["n"] == pytest.approx(4982950.400, abs=1e-3)
    assert (rows[1]["e"], rows[1]["n"]) == (pytest.approx(448251.795, abs=1e-2), pytest.approx(5411932.678, abs=1e-2))
    assert all(r["lon2"] == pytest.approx(r["lon"], abs=1e-8) and r["lat2"] == pytest.approx(r["lat"], abs=1e-8) and r["zone"] == 31 for r in rows)
