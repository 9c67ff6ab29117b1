"""An extension: forecasts that arrive as a stream give flood stages and maps as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.inundation import inundate
from ..operators.rating import flood_stage


def latest(forecasts: DataFrame, late: str = "1 hour") -> DataFrame:
    """(COMID, q) by the newest ``ts`` of each COMID, for a stream (COMID, ts, q)."""
    return forecasts.withWatermark("ts", late).groupBy("COMID").agg(F.max_by("q", "ts").alias("q"))


def map_stream(forecasts: DataFrame, curve: DataFrame, cells: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of forecasts (COMID, ts, q) becomes flood stages by ``curve`` and a map of ``cells``, which goes to ``sink``."""

    def one(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("COMID").agg(F.max_by("q", "ts").alias("q"))
        sink(inundate(cells, flood_stage(curve, newest)), number)

    return forecasts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
