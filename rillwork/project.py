"""A project: named datasets in a folder, options per step, and the workflows that chain the steps.

Every step reads its inputs from the project (or from a DataFrame or path given in their place), writes Parquet, and keeps the name. Options
are taken from the call, else from the configuration, else from the step's defaults.
"""

from __future__ import annotations

import functools
import inspect
import json
import os
import time
import warnings
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import algebra, depressions, hydrology, inundation, network, rating, terrain, vector
from .operators.graph import cut
from .schema import Grid
from .sources import geotiff, tables


class Config:
    """Options by step: {"filter": {"iterations": 20}}. Unknown steps and options are warned of and left out."""

    def __init__(self, options: dict[str, dict] | None = None, **more: dict):
        self._options: dict[str, dict] = {}
        self.update(options, **more)

    def update(self, options: dict[str, dict] | None = None, **more: dict) -> None:
        for step, given in {**(options or {}), **more}.items():
            if step not in STEPS:
                warnings.warn(f"there is no step {step!r}", stacklevel=2)
                continue
            for name, value in given.items():
                if name in STEPS[step]:
                    self._options.setdefault(step, {})[name] = value
                else:
                    warnings.warn(f"step {step!r} has no option {name!r}", stacklevel=2)

    def of(self, step: str) -> dict:
        return dict(self._options.get(step, {}))

    def __repr__(self) -> str:
        return f"Config({json.dumps(self._options, sort_keys=True)})"


#: The options of each step.
STEPS: dict[str, list[str]] = {}


def step(*inputs: str) -> Callable:
    """A step with these input datasets, each of which a ``custom`` entry may replace; its result is written under the step's name."""

    def wrap(f: Callable) -> Callable:
        STEPS[f.__name__] = [p for p in inspect.signature(f).parameters if p not in ("self", *inputs)]

        @functools.wraps(f)
        def run(self: Project, custom: dict[str, DataFrame | str] | None = None, path: str | None = None, **options):
            custom = custom or {}
            if unknown := set(custom) - set(inputs):
                raise ValueError(f"{f.__name__} has no input {sorted(unknown)}; it has {inputs}")
            if custom and path is None:
                raise ValueError(f"give a path for the result of {f.__name__} on custom inputs")
            if extra := set(options) - set(STEPS[f.__name__]):
                raise TypeError(f"{f.__name__} has no option {sorted(extra)}")
            began = time.perf_counter()
            data = {n: self.read(custom.get(n, n)) for n in inputs}
            out = f(self, **data, **{**self.config.of(f.__name__), **options})
            written = self.write(f.__name__, out, path)
            seconds = time.perf_counter() - began
            self.log(f"{f.__name__}: " + (f"{seconds:.1f} s" if seconds < 60 else f"{seconds / 60:.1f} min" if seconds < 3600 else f"{seconds / 3600:.1f} h"))
            return written

        return run

    return wrap


class Project:
    def __init__(self, spark: SparkSession, folder: str | os.PathLike, grid: Grid, config: Config | dict | None = None, log: Callable[[str], None] = print):
        if config is not None and not isinstance(config, (Config, dict)):
            raise ValueError("config must be a Config, a dict or None")
        self.spark, self.folder, self.grid, self.log = spark, os.fspath(folder), grid, log
        self.config = config if isinstance(config, Config) else Config(config)
        self.paths: dict[str, str] = {}

    # datasets

    def add(self, name: str, data: DataFrame | str) -> None:
        """A dataset: a table, written to the folder, or the path of one."""
        if isinstance(data, DataFrame):
            self.write(name, data, None)
        else:
            self.paths[name] = os.fspath(data)

    def add_geotiff(self, name: str, path: str) -> None:
        self.write(name, geotiff.scan(self.spark, path).cells, None)

    def read(self, name: DataFrame | str) -> DataFrame:
        if isinstance(name, DataFrame):
            return name
        path = self.paths.get(name, name)
        if name not in self.paths and "/" not in name:
            raise ValueError(f"the project has no dataset {name!r}; there are {sorted(self.paths)}")
        return self.spark.read.parquet(path)

    def write(self, name: str, df: DataFrame, path: str | None) -> DataFrame:
        where = path or f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(where)
        if path is None:
            self.paths[name] = where
        return self.spark.read.parquet(where)

    def save_manifest(self, path: str | os.PathLike) -> None:
        g = self.grid
        Path(path).write_text(json.dumps({"folder": self.folder, "grid": [g.height, g.width, g.cell, g.x0, g.y0, g.crs, g.unit], "paths": self.paths}, indent=1, sort_keys=True))

    @classmethod
    def from_manifest(cls, spark: SparkSession, path: str | os.PathLike, config: Config | dict | None = None) -> Project:
        got = json.loads(Path(path).read_text())
        out = cls(spark, got["folder"], Grid(*got["grid"]), config)
        out.paths = got["paths"]
        return out

    def __repr__(self) -> str:
        return f"Project({self.folder!r}, {self.grid!r}, {self.config!r}, datasets={sorted(self.paths)})"

    # steps

    @step("dem")
    def filtered(self, dem, method="PeronaMalik2", quantile=0.9, step_size=0.1, iterations=50):
        kappa = terrain.edge_threshold(dem, self.grid, quantile)
        return terrain.diffuse_tiled(dem, self.grid, kappa, iterations, step_size, method)

    @step("filtered")
    def slope(self, filtered):
        return terrain.slope(filtered, self.grid)

    @step("filtered")
    def curvature(self, filtered, method="geometric"):
        return terrain.curvature(filtered, self.grid, method)

    @step("filtered")
    def filled(self, filtered, tile=512):
        return hydrology.fill_depressions(filtered, self.grid, tile)

    @step("filled")
    def accumulation(self, filled, exponent=1.1, tile=512):
        return hydrology.accumulation_fd8(filled, self.grid, exponent, tile)

    @step("filled", "filtered")
    def d8(self, filled, filtered, drain_flats=True, tile=512):
        d8 = cut(hydrology.d8_pointer(filled, self.grid))
        return algebra.mask_by(hydrology.drain_flats(filled, d8, self.grid, tile) if drain_flats else d8, filtered)

    @step("d8")
    def outlets(self, d8):
        return hydrology.outlets(d8)

    @step("d8")
    def basins(self, d8):
        return hydrology.basins(d8, self.grid)

    @step("curvature", "accumulation")
    def skeleton(self, curvature, accumulation, fac_threshold=3000.0, deviations=1.5):
        both = curvature.withColumnRenamed("value", "curvature").join(accumulation.withColumnRenamed("value", "fac"), ["row", "col"], "left")
        return network.skeleton(both, fac_threshold, deviations)

    @step("basins", "outlets", "curvature", "accumulation", "skeleton")
    def geodesic(self, basins, outlets, curvature, accumulation, skeleton, more_than=2, area_percent=0.1):
        fac = accumulation.withColumnRenamed("value", "fac")
        mean = fac.agg(F.avg("fac")).first()[0] or 0.0
        curv = algebra.minmax_scale(curvature).withColumnRenamed("value", "curv")
        speed = F.col("fac") + mean * F.col("skel") + mean * F.coalesce("curv", F.lit(0.0))
        cells = basins.withColumnRenamed("value", "basin").join(fac, ["row", "col"]).join(skeleton.withColumnRenamed("value", "skel"), ["row", "col"]).join(curv, ["row", "col"], "left")
        starts = network.travel_starts(basins, outlets, self.grid, more_than, area_percent)
        return network.geodesic_distance(cells.select("row", "col", "basin", speed.alias("speed")), starts)

    @step("skeleton", "geodesic")
    def channel_heads(self, skeleton, geodesic, reach=30, most=10000):
        return network.channel_heads(skeleton, geodesic, self.grid, reach, most=most)

    @step("channel_heads")
    def channel_head_points(self, channel_heads):
        return vector.as_points(channel_heads, self.grid, "Channel Heads")

    @step("flowline")
    def endpoints(self, flowline):
        return vector.endpoints(vector.as_lines(flowline))

    @step("dem", "flowline")
    def binary_hand(self, dem, flowline, tile=512):
        on = vector.rasterize_lines(flowline, self.grid).select("row", "col", F.lit(1).alias("channel"))
        return network.binary_hand(dem.join(on, ["row", "col"], "left").select("row", "col", "value", "channel"), self.grid, tile)

    @step("flowline")
    def flowline_mask(self, flowline, radius=5.0):
        return vector.rasterize_buffer(flowline, self.grid, radius).withColumn("value", F.lit(1))

    @step("curvature", "accumulation", "binary_hand")
    def channel_cost(self, curvature, accumulation, binary_hand, weight_curvature=None, weight_accumulation=1.0, weight_binary_hand=0.75, weight_flowline=1.0, use_flowline=False, no_flowline=False, share=0.025):
        """``use_flowline`` adds the dataset flowline_mask, and goes before ``no_flowline``, which leaves the nearest channel out."""
        fac = algebra.minmax_scale(accumulation.select("row", "col", algebra.log(F.col("value")).alias("value"))).withColumnRenamed("value", "fac")
        curv = algebra.minmax_scale(curvature.select("row", "col", algebra.within(F.col("value"), -10, 10).alias("value"))).withColumnRenamed("value", "curv")
        weight = weight_curvature if weight_curvature is not None else fac.agg(F.avg("fac")).first()[0]
        cells = curv.join(fac, ["row", "col"]).join(binary_hand.withColumnRenamed("value", "hand"), ["row", "col"])
        layers = [(weight, F.col("curv")), (weight_accumulation, F.col("fac")), (weight_binary_hand, None if no_flowline and not use_flowline else F.col("hand"))]
        if use_flowline:
            cells = cells.join(self.read("flowline_mask").withColumnRenamed("value", "on"), ["row", "col"], "left")
            layers.append((weight_flowline, F.coalesce("on", F.lit(0))))
        return algebra.keep_cheapest(cells.select("row", "col", algebra.combined_cost(layers).alias("value")), share)

    @step("channel_cost", "endpoints")
    def channel_paths(self, channel_cost, endpoints, margin=64):
        from .operators.grid import rowcol_of

        r1, c1 = rowcol_of(self.grid, F.col("START_X"), F.col("START_Y"))
        r2, c2 = rowcol_of(self.grid, F.col("END_X"), F.col("END_Y"))
        ends = endpoints.select(F.col("RiverID").alias("path_id"), r1.alias("r1"), c1.alias("c1"), r2.alias("r2"), c2.alias("c2"))
        return network.least_cost_paths(channel_cost, ends, self.grid, margin)

    @step("channel_paths")
    def channel_network(self, channel_paths):
        return network.path_segments(channel_paths)

    @step("filled", "d8", "channel_paths")
    def hand(self, filled, d8, channel_paths):
        streams = channel_paths.select("row", "col").distinct().withColumn("value", F.lit(1))
        return hydrology.height_above_drainage(filled, d8, streams, self.grid)

    def _vertices(self, cells: DataFrame) -> DataFrame:
        from .operators.grid import xy_of

        x, y = xy_of(self.grid)
        return cells.select(F.col("key").alias("path_id"), "seq", x.alias("x"), y.alias("y"))

    @step("channel_network")
    def segments(self, channel_network, longest=1000.0):
        lines = self._vertices(channel_network)
        return vector.split_lines(lines, longest).join(vector.segments(lines, longest), ["path_id", "part"])

    @step("segments", "d8")
    def catchments(self, segments, d8):
        lines = segments.select(F.col("HYDROID").alias("path_id"), "seq", "x", "y")
        return hydrology.watershed(d8, vector.rasterize_lines(lines, self.grid), self.grid)

    @step("catchments")
    def catchment_areas(self, catchments, tile=512):
        return inundation.region_areas(catchments, self.grid, tile)

    @step("catchments")
    def catchment_outlines(self, catchments, tile=512):
        return vector.outlines(network.same_value_regions(catchments, self.grid, tile), self.grid)

    @step("dem", "segments", "catchments")
    def river_attributes(self, dem, segments, catchments, comids=None, polygons=None, min_slope=1e-6):
        """COMIDs are those of the table ``comids`` (HYDROID, COMID), or of the catchment in ``polygons`` (COMID, seq, x, y; closed rings) that
        holds a segment's centroid (of several the least; null if none does). Without either each segment is its own COMID."""
        lines = segments.select(F.col("HYDROID").alias("path_id"), "seq", "x", "y")
        slopes = vector.slope_10_85(lines, dem, self.grid).join(vector.lengths(lines), "path_id").withColumnRenamed("path_id", "HYDROID")
        if comids is not None:
            ids = self.read(comids)
        elif polygons is not None:
            rings = self.read(polygons).withColumnRenamed("COMID", "ring_id")
            points = vector.centroids(lines).withColumnRenamed("path_id", "point_id")
            ids = vector.points_within(points, rings, self.grid.cell * 256).select(F.col("point_id").alias("HYDROID"), F.col("ring_id").cast("long").alias("COMID"))
        else:
            ids = slopes.select("HYDROID", F.col("HYDROID").cast("long").alias("COMID"))
        return rating.river_attributes(catchments.withColumnRenamed("value", "hydroid"), slopes, ids, self.grid.cell**2, self.grid.unit, min_slope)

    @step("dem", "hand", "catchments", "river_attributes", "roughness")
    def src(self, dem, hand, catchments, river_attributes, roughness, max_stage=20.0, increment=0.1):
        slope = terrain.slope(dem, self.grid).withColumnRenamed("value", "slope")
        cells = hand.withColumnRenamed("value", "hand").join(catchments.withColumnRenamed("value", "hydroid"), ["row", "col"]).join(slope, ["row", "col"])
        steps = rating.hypsometry(cells, river_attributes, round(max_stage / increment) + 1, increment, self.grid.cell**2)
        return rating.check_discharge(rating.rating_curve(steps, river_attributes, roughness))

    @step("src")
    def flood_stage(self, src, forecast=None, constant=None):
        given = None if forecast is None or constant is not None else tables.forecast(self.read(forecast), src)
        return rating.flood_stage(src, given, constant)

    @step("hand", "catchments", "flood_stage")
    def fim(self, hand, catchments, flood_stage):
        cells = hand.withColumnRenamed("value", "hand").join(catchments.withColumnRenamed("value", "hydroid"), ["row", "col"], "left")
        return inundation.inundate(cells, flood_stage)

    @step("dem")
    def pluvial(self, dem, depth=0.5):
        return depressions.fill_spill_merge(dem.withColumn("water", F.lit(float(depth))), self.grid)

    @step("dem")
    def coastal(self, dem, gage=None, ocean=None, tile=512):
        if gage is None or ocean is None:
            raise ValueError("give the gage's elevation and the ocean cell")
        return inundation.coastal(dem, self.grid, gage, ocean, tile)

    @step("pluvial", "coastal")
    def compound(self, pluvial, coastal):
        return inundation.compound(pluvial, coastal)

    # workflows

    def run_channel_extraction(self) -> DataFrame:
        """From the datasets dem and flowline to the channel network."""
        for name in ("filtered", "slope", "curvature", "filled", "accumulation", "d8", "outlets", "basins", "skeleton", "endpoints", "binary_hand", "channel_cost", "channel_paths"):
            getattr(self, name)()
        return self.channel_network()

    def run_inundation(self, comids=None, polygons=None, **stage) -> DataFrame:
        """From the datasets dem, flowline and roughness to the inundation map; ``stage`` goes to flood_stage, ``comids`` or ``polygons`` to
        river_attributes: a forecast is by COMID and needs one of them."""
        if stage.get("forecast") is not None and stage.get("constant") is None and comids is None and polygons is None:
            raise ValueError("a forecast needs the COMIDs of the segments: give comids or polygons")
        self.run_channel_extraction()
        for name in ("hand", "segments", "catchments"):
            getattr(self, name)()
        self.river_attributes(comids=comids, polygons=polygons)
        self.src()
        self.flood_stage(**stage)
        return self.fim()
