"""Files, configuration and the workflow from terrain to map."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.project import Config, Project
from rillwork.schema import Grid
from rillwork.sources import geotiff, shapefile, tables
from rillwork.streaming import forecasts


@pytest.mark.parametrize("compression", ["none", "lzw", "deflate"])
@pytest.mark.parametrize("dtype", ["float32", "float64", "int16"])
def test_geotiff(spark, tmp_path, compression, dtype):
    z = np.round(np.random.default_rng(1).random((150, 70)) * 500)
    z[3, 4] = np.nan
    data = geotiff.write_bytes(z, Grid(150, 70, 2.0, 100.0, 900.0), dtype, compression=compression)
    assert np.allclose(geotiff.read_array(data), z, equal_nan=True) and np.allclose(geotiff.read_array(data, 60, 131), z[60:131], equal_nan=True)
    (tmp_path / "a.tif").write_bytes(data)
    got = geotiff.scan(spark, str(tmp_path / "a.tif"), rows_a_task=40)
    assert got.grid == Grid(150, 70, 2.0, 100.0, 900.0) and got.cells.count() == 150 * 70 and got.cells.where("value IS NULL").count() == 1
    assert np.allclose(geotiff.read_array(geotiff.export(got, "float64")), z, equal_nan=True)


def test_lzw_of_long_runs_and_noise():
    for data in (b"", b"a" * 100_000, np.random.default_rng(2).integers(0, 256, 50_000).astype(np.uint8).tobytes(), b"abcab" * 9000):
        assert geotiff.lzw_decode(geotiff.lzw_encode(data)) == data


def test_no_tiff():
    with pytest.raises(ValueError):
        geotiff.read_header(b"nothing at all")


def test_shapefile(spark, tmp_path):
    lines = spark.createDataFrame([(3, 0, 0.0, 1.0), (3, 1, 2.0, 3.0), (5, 0, 9.0, 9.0), (5, 1, 8.0, 8.0), (7, 0, 1.0, 1.0)], "path_id long, seq long, x double, y double")
    shp, dbf = shapefile.export_lines(lines)
    (tmp_path / "a.shp").write_bytes(shp)
    (tmp_path / "a.dbf").write_bytes(dbf)
    got = sorted((r["path_id"], r["seq"], r["x"]) for r in shapefile.scan(spark, str(tmp_path / "a.shp")).collect())
    assert got == [(0, 0, 0.0), (0, 1, 2.0), (1, 0, 9.0), (1, 1, 8.0)]
    assert shapefile.scan(spark, str(tmp_path / "a.shp"), (7.0, 7.0, 10.0, 10.0)).select("path_id").distinct().count() == 1
    assert [r["HYDROID"] for r in shapefile.attributes(spark, str(tmp_path / "a.dbf")).orderBy("path_id").collect()] == [3, 5]


def test_forecasts(spark, tmp_path):
    df = spark.createDataFrame([(7, 1.5), (8, 2.5)], "feature_id long, streamflow double")
    known = spark.createDataFrame([(8,)], "COMID long")
    assert [tuple(r) for r in tables.forecast(df, known).collect()] == [(8, 2.5)]
    tables.write_csv(df, str(tmp_path / "f.csv"))
    assert tables.read_forecast(spark, str(tmp_path / "f.csv")).count() == 2
    for bad in (df.drop("streamflow"), df.drop("feature_id")):
        with pytest.raises(ValueError):
            tables.forecast(bad)
    with pytest.raises(ValueError):
        tables.read_forecast(spark, "forecast.xyz")
    assert dict(tables.narrowed(spark.createDataFrame([(1.0, 2.0)], "COMID double, q double")).dtypes) == {"COMID": "double", "q": "float"}


def test_configuration():
    given = {"filtered": {"iterations": 3}}
    config = Config(given)
    with pytest.warns(UserWarning):
        config.update({"filtered": {"nonsense": 1}, "nothing": {"a": 1}})
    assert config.of("filtered") == {"iterations": 3} and given == {"filtered": {"iterations": 3}} and "iterations" in repr(config)
    with pytest.raises(ValueError):
        Project(None, "x", Grid(1, 1), config=7)


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    r, c = np.mgrid[0:40, 0:48]
    z = abs(c - 24) * 0.5 + (40 - r) * 0.3 + np.sin(r * 1.3 + c * 0.7) * 0.1 + 5
    folder = tmp_path_factory.mktemp("project")
    grid = Grid(40, 48, 10.0, 1000.0, 5000.0)
    (folder / "dem.tif").write_bytes(geotiff.write_bytes(z, grid))
    p = Project(spark, folder / "data", grid, {"filtered": {"iterations": 3}, "skeleton": {"fac_threshold": 20.0}}, log=lambda _: None)
    p.add_geotiff("dem", str(folder / "dem.tif"))
    p.add("flowline", spark.createDataFrame([(0, 0, 1240.0, 4990.0), (0, 1, 1240.0, 4800.0), (0, 2, 1242.0, 4615.0)], "path_id long, seq long, x double, y double"))
    p.add("roughness", spark.createDataFrame([(i, 0.05) for i in range(1, 50)], "COMID long, Roughness double"))
    p.run_inundation(constant=5.0)
    return p


def test_workflow(project):
    depth = project.read("fim")
    assert depth.count() == 40 * 48 and 10 < depth.where("value > 0").count() < 400
    hand = project.read("hand")
    assert hand.where("value < -1e-9").isEmpty() and project.read("catchments").where("value IS NOT NULL").count() > 1000
    project.fim(custom={"flood_stage": project.read("flood_stage").withColumn("Stage_m", F.col("Stage_m") + 1)}, path=project.folder + "/higher")
    assert project.read(project.folder + "/higher").where("value > 0").count() > depth.where("value > 0").count()


def test_steps_refuse_what_they_can_t_do(project):
    dem = project.read("dem")
    with pytest.raises(ValueError):
        project.slope(custom={"filtered": dem})  # where to?
    with pytest.raises(ValueError):
        project.slope(custom={"other": dem}, path="/tmp/x")
    with pytest.raises(TypeError):
        project.filtered(nonsense=1)
    with pytest.raises(ValueError):
        project.read("unknown")
    with pytest.raises(ValueError):
        project.coastal()


def test_manifest(spark, project, tmp_path):
    project.save_manifest(tmp_path / "a=b.json")
    again = Project.from_manifest(spark, tmp_path / "a=b.json")
    assert again.grid == project.grid and again.read("fim").count() == 40 * 48 and "fim" in repr(again)


def test_stream(spark, project, tmp_path):
    curve = project.read("src")
    cells = project.read("hand").withColumnRenamed("value", "hand").join(project.read("catchments").withColumnRenamed("value", "hydroid"), ["row", "col"])
    spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 01:00:00", 5.0)], "COMID long, ts string, q double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("COMID long, ts timestamp, q double").parquet(str(tmp_path / "in"))
    seen = []
    q = forecasts.map_stream(stream, curve, cells, lambda df, _: seen.append(df.where("value > 0").count()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert seen == [project.read("fim").where("value > 0").count()]
    assert forecasts.latest(stream).isStreaming


def test_forecast_by_true_comids(project, spark):
    """Segments get the COMID of the catchment that holds their centroid, and a forecast of these COMIDs floods them."""
    rings = [(c, i, x, y) for c, (low, high) in {7001: (4000.0, 4800.0), 7002: (4800.0, 6000.0)}.items() for i, (x, y) in enumerate([(900.0, low), (2000.0, low), (2000.0, high), (900.0, high), (900.0, low)])]
    project.add("nwm", spark.createDataFrame(rings, "COMID long, seq long, x double, y double"))
    got = project.river_attributes(polygons="nwm", path=project.folder + "/attributes")
    assert got.count() > 0 and {r["COMID"] for r in got.collect()} <= {7001, 7002}
    rough = spark.createDataFrame([(7001, 0.05), (7002, 0.05)], "COMID long, Roughness double")
    src = project.src(custom={"river_attributes": got, "roughness": rough}, path=project.folder + "/src_true")
    project.add("nwm_forecast", spark.createDataFrame([(7001, 0.4), (7002, 0.4)], "COMID long, streamflow double"))
    stages = project.flood_stage(forecast="nwm_forecast", custom={"src": src}, path=project.folder + "/stage_true").collect()
    assert stages and all(r["COMID"] in (7001, 7002) and r["Stage_m"] != 0 for r in stages)
    with pytest.raises(ValueError):
        project.run_inundation(forecast="nwm_forecast")


def test_wide_attributes():
    with pytest.raises(ValueError):
        shapefile.write_attributes(["name"], [["x" * 255]])
    assert shapefile.read_attributes(shapefile.write_attributes(["name", "n"], [["\u00fc" * 100, 1], ["b", 2]]))[1][0][0] == "\u00fc" * 100
