"""Data model: rasters as tables of cells, vectors as rows with vertex arrays, and the schemas of the attribute tables.

Nodata is NULL everywhere inside the engine; sentinels and NaN are decoded when a raster is read and encoded when it is written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NODATA = -32768.0


@dataclass(frozen=True)
class Grid:
    """Registration of a raster: its size, and the affine transform of a north-up grid."""

    height: int
    width: int
    cell: float = 1.0
    x0: float = 0.0
    y0: float = 0.0
    crs: str = ""
    unit: float = 1.0  #: metres in a unit of the CRS

    def __post_init__(self) -> None:
        if self.height < 1 or self.width < 1 or self.cell <= 0:
            raise ValueError("a grid needs at least one cell of positive size")


@dataclass(frozen=True)
class Raster:
    """A grid and its cells: a table with the columns row, col and one or more values."""

    grid: Grid
    cells: DataFrame


def _struct(spec: str) -> T.StructType:
    kinds = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(), "string": T.StringType()}
    return T.StructType([T.StructField(n, kinds[k], True) for n, k in (x.split(":") for x in spec.split())])


ENDPOINTS = _struct("RiverID:bigint START_X:double START_Y:double END_X:double END_Y:double")
ROUGHNESS = _struct("COMID:bigint Roughness:double")
RIVER_ATTRIBUTES = _struct("HYDROID:int Area_km2:double Slope:double Length_km:double COMID:bigint")
RATING_CURVE = _struct(
    "HYDROID:int Stage_m:double NumCells:bigint SurfaceArea_m2:double BedArea_m2:double Volume_m3:double Area_km2:double Slope:double Length_km:double "
    "COMID:bigint Roughness:double TopWidth_m:double WettedPerimeter_m:double WetArea_m2:double HydraulicRadius_m:double Discharge_cms:double FloodAreaRatio:double"
)
FLOOD_STAGE = _struct("HYDROID:int COMID:bigint Discharge_cms:double Stage_m:double")
DEPRESSIONS = _struct(
    "dep_label:bigint parent:bigint lchild:bigint rchild:bigint pit_cell:bigint pit_elev:double out_cell:bigint out_elev:double cell_count:bigint dep_vol:double water_vol:double"
)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` if it has the columns, else a ValueError that names what is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df
