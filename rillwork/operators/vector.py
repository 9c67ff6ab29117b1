"""Lines and polygons as rows: vertices are (path_id, seq, x, y), polygons are rings of vertices."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import Grid
from .grid import sample, xy_of


def _along():
    return Window.partitionBy("path_id").orderBy("seq")


def as_lines(vertices: DataFrame) -> DataFrame:
    """(path_id, geom): the vertices of each path as an array, for paths of two or more."""
    return vertices.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("geom")).where(F.size("geom") >= 2)


def as_points(cells: DataFrame, grid: Grid, kind: str) -> DataFrame:
    """(Type, Northing, Easting) of cells (row, col): their centres."""
    x, y = xy_of(grid)
    return cells.select(F.lit(kind).alias("Type"), y.alias("Northing"), x.alias("Easting"))


def endpoints(lines: DataFrame) -> DataFrame:
    """(RiverID, START_X, START_Y, END_X, END_Y) of lines (path_id, geom)."""
    a, b = F.element_at("geom", 1), F.element_at("geom", -1)
    return lines.select(F.col("path_id").alias("RiverID"), a["x"].alias("START_X"), a["y"].alias("START_Y"), b["x"].alias("END_X"), b["y"].alias("END_Y"))


def measured(vertices: DataFrame) -> DataFrame:
    """``vertices`` with ``edge``, the distance from the vertex before (0 at the first), and ``along``, the distance from the start."""
    dx, dy = F.col("x") - F.lag("x").over(_along()), F.col("y") - F.lag("y").over(_along())
    edge = vertices.withColumn("edge", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    return edge.withColumn("along", F.sum("edge").over(_along().rowsBetween(Window.unboundedPreceding, 0)))


def lengths(vertices: DataFrame) -> DataFrame:
    return measured(vertices).groupBy("path_id").agg(F.max("along").alias("length"))


def split_lines(vertices: DataFrame, longest: float = 1000.0) -> DataFrame:
    """(path_id, part, seq, x, y): each line cut at vertices so that no part is longer than ``longest``, unless it is one edge.

    A part takes vertices while its length allows; the vertex before the one that would exceed it ends it and starts the next. An edge
    that is too long by itself is a part of its own. The greedy walk is a fold over the line's vertices.
    """
    lines = as_lines(vertices)
    start = F.struct(F.lit(0).cast("long").alias("part"), F.lit(0.0).alias("length"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.array().cast("array<struct<part:bigint,seq:bigint,x:double,y:double>>").alias("out"))

    def walk(state: Column, v: Column) -> Column:
        d = F.sqrt((v["x"] - state["x"]) * (v["x"] - state["x"]) + (v["y"] - state["y"]) * (v["y"] - state["y"]))
        full = (state["length"] + d > longest) & (state["length"] > 0)
        part = F.when(full, state["part"] + 1).otherwise(state["part"])
        length = F.when(state["x"].isNull(), 0.0).when(full, d).otherwise(state["length"] + d)
        here = F.struct(part.alias("part"), v["seq"].cast("long").alias("seq"), v["x"].alias("x"), v["y"].alias("y"))
        last = F.element_at(state["out"], -1)
        again = F.struct(part.alias("part"), last["seq"].alias("seq"), last["x"].alias("x"), last["y"].alias("y"))
        out = F.concat(state["out"], F.when(full, F.array(again, here)).otherwise(F.array(here)))
        return F.struct(part.alias("part"), length.alias("length"), v["x"].alias("x"), v["y"].alias("y"), out.alias("out"))

    walked = lines.select("path_id", F.explode(F.aggregate("geom", start, walk)["out"]).alias("v"))
    return walked.select("path_id", "v.part", "v.seq", "v.x", "v.y")


def segments(vertices: DataFrame, longest: float = 1000.0) -> DataFrame:
    """(HYDROID, path_id, part, Length): parts numbered in the order of paths, their lengths to 4 decimals."""
    from .graph import cut
    from .grid import numbered

    parts = split_lines(vertices, longest)
    w = Window.partitionBy("path_id", "part").orderBy("seq")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    length = parts.withColumn("d", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))).groupBy("path_id", "part").agg(F.bround(F.sum("d"), 4).alias("Length"))
    keyed = cut(length.withColumn("key", F.col("path_id") * (1 << 20) + F.col("part")))
    return numbered(keyed, "key", "HYDROID", 1 << 36).select("HYDROID", "path_id", "part", "Length")


def point_along(vertices: DataFrame, share: float) -> DataFrame:
    """(path_id, x, y) at the share of each line's length."""
    m = measured(vertices)
    total = F.max("along").over(Window.partitionBy("path_id"))
    before = {c: F.lag(c).over(_along()) for c in ("x", "y", "along")}
    at = m.withColumns({"want": total * share, "px": before["x"], "py": before["y"], "pa": before["along"]})
    on = at.where((F.col("want") <= F.col("along")) & ((F.col("want") > F.col("pa")) | (F.col("pa").isNull() & (F.col("want") <= 0))))
    t = F.coalesce(F.try_divide(F.col("want") - F.col("pa"), F.col("edge")), F.lit(0.0))
    first = on.select("path_id", (F.coalesce("px", "x") + t * (F.col("x") - F.coalesce("px", "x"))).alias("x"), (F.coalesce("py", "y") + t * (F.col("y") - F.coalesce("py", "y"))).alias("y"), "seq")
    return first.groupBy("path_id").agg(F.min_by("x", "seq").alias("x"), F.min_by("y", "seq").alias("y"))


def slope_10_85(vertices: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """(path_id, slope): the drop between 10 % and 85 % of a line's length, by the distance."""
    low = sample(cells, point_along(vertices, 0.10), grid).select("path_id", F.col("value").alias("z10"))
    high = sample(cells, point_along(vertices, 0.85), grid).select("path_id", F.col("value").alias("z85"))
    rise = (F.col("z10") - F.col("z85")) * -1
    return lengths(vertices).join(low, "path_id").join(high, "path_id").select("path_id", F.try_divide(-rise, F.col("length") * 0.75).alias("slope"))


def centroids(vertices: DataFrame) -> DataFrame:
    """(path_id, x, y) of lines: the edges' midpoints weighted by their lengths."""
    m = measured(vertices)
    mid = {c: (F.col(c) + F.lag(c).over(_along())) / 2 for c in ("x", "y")}
    e = m.withColumns({"mx": mid["x"], "my": mid["y"]}).where(F.col("mx").isNotNull())
    return e.groupBy("path_id").agg(F.sum(F.col("mx") * F.col("edge")).alias("sx"), F.sum(F.col("my") * F.col("edge")).alias("sy"), F.sum("edge").alias("s")).select("path_id", F.try_divide("sx", "s").alias("x"), F.try_divide("sy", "s").alias("y"))


def points_within(points: DataFrame, rings: DataFrame, bucket: float) -> DataFrame:
    """(all of points, ring_id) left join: the ring (ring_id, seq, x, y) that holds a point (point_id, x, y); of several the least ring_id.

    Rings are spread over square buckets that their boxes touch, so that the join is by bucket; in each the crossing rule decides.
    """
    w = Window.partitionBy("ring_id").orderBy("seq")
    edges = rings.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)}).where(F.col("x2").isNotNull())
    shape = edges.groupBy("ring_id").agg(F.collect_list(F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")).alias("edges"), F.min("x").alias("xl"), F.max("x").alias("xh"), F.min("y").alias("yl"), F.max("y").alias("yh"))
    b = lambda c: F.floor(c / bucket)
    spread = shape.withColumn("bx", F.explode(F.sequence(b(F.col("xl")), b(F.col("xh"))))).withColumn("by", F.explode(F.sequence(b(F.col("yl")), b(F.col("yh")))))
    at = points.withColumns({"bx": b(F.col("x")), "by": b(F.col("y"))})
    px, py = F.col("x"), F.col("y")
    crossed = F.size(F.filter("edges", lambda e: ((e["y1"] > py) != (e["y2"] > py)) & (px < (e["x2"] - e["x1"]) * (py - e["y1"]) / F.when(e["y2"] == e["y1"], 1.0).otherwise(e["y2"] - e["y1"]) + e["x1"])))
    hits = at.join(spread, ["bx", "by"]).where(crossed % 2 == 1).groupBy("point_id").agg(F.min("ring_id").alias("ring_id"))
    return points.join(hits, "point_id", "left")


def rasterize_buffer(vertices: DataFrame, grid: Grid, radius: float) -> DataFrame:
    """(row, col) of the cells whose centre is within ``radius`` of a line: candidate cells of each edge's box, then the distance."""
    px, py = F.lag("x").over(_along()), F.lag("y").over(_along())
    e = vertices.withColumns({"px": px, "py": py}).where(F.col("px").isNotNull())
    row = lambda y: F.floor((F.lit(grid.y0) - y) / grid.cell)
    col = lambda x: F.floor((x - F.lit(grid.x0)) / grid.cell)
    rows = F.sequence(F.greatest(row(F.greatest("y", "py") + radius), F.lit(0)), F.greatest(row(F.least("y", "py") - radius), F.lit(0)))
    cols = F.sequence(F.greatest(col(F.least("x", "px") - radius), F.lit(0)), F.greatest(col(F.greatest("x", "px") + radius), F.lit(0)))
    cand = e.withColumn("row", F.explode(rows)).withColumn("col", F.explode(cols)).where((F.col("row") < grid.height) & (F.col("col") < grid.width))
    cx, cy = F.lit(grid.x0) + (F.col("col") + 0.5) * grid.cell, F.lit(grid.y0) - (F.col("row") + 0.5) * grid.cell
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((cx - F.col("px")) * dx + (cy - F.col("py")) * dy, dx * dx + dy * dy), F.lit(0.0))))
    ex, ey = cx - (F.col("px") + t * dx), cy - (F.col("py") + t * dy)
    return cand.where(ex * ex + ey * ey <= radius * radius).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct()


def rasterize_lines(vertices: DataFrame, grid: Grid, value: str = "path_id") -> DataFrame:
    """(row, col, value): cells on the lines, one step for each row or column that an edge crosses; where lines meet the greatest ``value`` wins."""
    fr, fc = (F.lit(grid.y0) - F.col("y")) / grid.cell, (F.col("x") - F.lit(grid.x0)) / grid.cell
    at = vertices.withColumns({"r": F.floor(fr), "c": F.floor(fc)})
    at = at.withColumns({"pr": F.coalesce(F.lag("r").over(_along()), F.col("r")), "pc": F.coalesce(F.lag("c").over(_along()), F.col("c"))})
    steps = F.greatest(F.abs(F.col("r") - F.col("pr")), F.abs(F.col("c") - F.col("pc")))
    on = at.withColumn("steps", steps).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), steps)))
    t = F.coalesce(F.try_divide(F.col("k").cast("double"), F.col("steps").cast("double")), F.lit(0.0))
    cell = on.select(F.floor(F.col("pr") + t * (F.col("r") - F.col("pr")) + 0.5).cast("long").alias("row"), F.floor(F.col("pc") + t * (F.col("c") - F.col("pc")) + 0.5).cast("long").alias("col"), F.col(value).alias("value"))
    inside = (F.col("row") >= 0) & (F.col("row") < grid.height) & (F.col("col") >= 0) & (F.col("col") < grid.width)
    return cell.where(inside).groupBy("row", "col").agg(F.max("value").alias("value"))


def polygon_areas(rings: DataFrame) -> DataFrame:
    """(ring_id, area) of closed rings by the shoelace formula."""
    w = Window.partitionBy("ring_id").orderBy("seq")
    cross = F.col("x") * F.lead("y").over(w) - F.lead("x").over(w) * F.col("y")
    return rings.withColumn("cross", cross).groupBy("ring_id").agg((F.abs(F.sum("cross")) / 2).alias("area"))


def outlines(regions: DataFrame, grid: Grid) -> DataFrame:
    """(HYDROID, region, ring, seq, x, y): closed rings around the regions (row, col, HYDROID, region), outer ones clockwise, holes the other way.

    The sides of cells that face another region are found by a join; only they are put together, region by region. The signed areas
    of a region's rings sum up to its cells.
    """
    sides = {"n": (-1, 0, 0, 0, 0, 1), "e": (0, 1, 0, 1, 1, 1), "s": (1, 0, 1, 1, 1, 0), "w": (0, -1, 1, 0, 0, 0)}
    side = F.explode(F.array(*[F.struct((F.col("row") + dr).alias("nr"), (F.col("col") + dc).alias("nc"), (F.col("row") + a).alias("r1"), (F.col("col") + b).alias("c1"), (F.col("row") + c).alias("r2"), (F.col("col") + d).alias("c2")) for dr, dc, a, b, c, d in sides.values()]))
    every = regions.select("HYDROID", "region", side.alias("s")).select("HYDROID", "region", "s.*")
    inside = regions.select(F.col("row").alias("nr"), F.col("col").alias("nc"), "region")
    border = every.join(inside, ["nr", "nc", "region"], "left_anti")
    x0, y0, cell = grid.x0, grid.y0, grid.cell

    def trace(t: pa.Table) -> pa.Table:
        nexts: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r1, c1, r2, c2 in sorted(zip(*(t[n].to_pylist() for n in ("r1", "c1", "r2", "c2")))):
            nexts.setdefault((r1, c1), []).append((r2, c2))
        rows, ring = [], 0
        for first in sorted(nexts):
            while nexts.get(first):
                at, points, before = first, [], None
                while True:
                    ways = nexts[at]
                    if before and len(ways) > 1:  # where two corners touch: turn right, so that the ring stays with its cell
                        right = (before[1], -before[0])
                        k = next((i for i, w in enumerate(ways) if (w[0] - at[0], w[1] - at[1]) == right), 0)
                    else:
                        k = 0
                    to = ways.pop(k)
                    step = (to[0] - at[0], to[1] - at[1])
                    if step != before:
                        points.append(at)
                    at, before = to, step
                    if at == first:
                        break
                points.append(points[0])
                rows += [(ring, i, x0 + c * cell, y0 - r * cell) for i, (r, c) in enumerate(points)]
                ring += 1
        a, b, c, d = zip(*rows)
        n = len(rows)
        return pa.table({"HYDROID": [t["HYDROID"][0].as_py()] * n, "region": [t["region"][0].as_py()] * n, "ring": a, "seq": b, "x": c, "y": d})

    typed = border.select(*[F.col(n).cast("long").alias(n) for n in ("HYDROID", "region", "r1", "c1", "r2", "c2")])
    return typed.groupBy("HYDROID", "region").applyInArrow(trace, "HYDROID long, region long, ring long, seq long, x double, y double")
