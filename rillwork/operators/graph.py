"""Fixpoints over graphs: pointer jumping along trees, connected components. Lineage ends in the checkpoint folder each round."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges of a graph that the driver connects by itself at most (32 MB); more are connected in rounds.
DRIVER_EDGES = 2_000_000


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the session's ``spark.checkpoint.dir`` and read back; below the warehouse where that is unset on one machine. On a
    cluster it has to be set."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not where and sc.master != "local" and not (sc.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


def resolve(pointers: DataFrame) -> DataFrame:
    """(id, target): where the chain of each id ends. pointers: (id, next), where an end points to itself; without other cycles.

    Each round doubles the stretch that a pointer spans, so the rounds are the logarithm of the longest chain. Only ids that
    haven't arrived take part in the join of the next round.
    """
    ends = cut(pointers.where("id = next").select("id", F.col("next").alias("target")))
    open_ = cut(pointers.where("id <> next"))
    while True:
        n = open_.alias("n")
        arrived = open_.join(ends.select(F.col("id").alias("e"), "target"), F.col("next") == F.col("e")).select("id", "target")
        rest = open_.join(ends.select(F.col("id").alias("e")), F.col("next") == F.col("e"), "left_anti")
        jumped = rest.join(n.select(F.col("n.id").alias("via"), F.col("n.next").alias("far")), F.col("next") == F.col("via")).select("id", F.col("far").alias("next"))
        ends, open_ = cut(ends.unionByName(arrived)), cut(jumped)
        if open_.isEmpty():
            return ends


def accumulate(pointers: DataFrame, weight: str = "weight") -> DataFrame:
    """(id, total): the weight of each id and of all that flow to it. pointers: (id, next, weight), an end points to itself.

    Doubling: after k rounds a total covers what is less than 2^k steps upstream. What has come to an end leaves the join.
    """
    totals = pointers.select("id", F.col(weight).cast("double").alias("total"))
    open_ = cut(pointers.where("id <> next").select("id", "next"))
    totals = cut(totals)
    while not open_.isEmpty():
        sent = open_.join(totals, "id").groupBy(F.col("next").alias("id")).agg(F.sum("total").alias("more"))
        totals = cut(totals.join(sent, "id", "left").select("id", (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total")))
        far = open_.select(F.col("id").alias("via"), F.col("next").alias("far"))
        open_ = cut(open_.join(far, F.col("next") == F.col("via")).select("id", F.col("far").alias("next")))
    return totals


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label) of every node (id): the least id of its component under the edges (a, b). Alternating large and small stars."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return nodes.join(e.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("label"))
        before = now


def joined_ids(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of the edges (a, b), and for each the least id that they connect with it."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    root = np.arange(len(ids))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
    return ids, ids[root]


def least_connected(edges: DataFrame) -> DataFrame:
    """(id, least) of the ids of the edges (a, b) that aren't the least of their component: that one. To be broadcast if it is small."""
    spark = edges.sparkSession
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.limit(DRIVER_EDGES + 1).count() <= DRIVER_EDGES:
        got = edges.toArrow()
        ids, least = joined_ids(got["a"].to_numpy(), got["b"].to_numpy())
        other = ids != least
        return F.broadcast(spark.createDataFrame(pa.table({"id": ids[other], "least": least[other]}), "id long, least long"))
    ids = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    return cut(components(ids, edges).where("id <> label").select("id", F.col("label").alias("least")))
