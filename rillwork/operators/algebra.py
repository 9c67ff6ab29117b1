"""Map algebra: cell-wise expressions, and those that need one statistic of the whole raster.

Whole-raster statistics are one-row aggregates joined back by a broadcast of that one row; no window without a partition is
used, so no step brings the raster into one task. Quantiles are exact: counts in bins tell which bin has the wanted rank, and
only its values go to the driver; beyond a number of them that bin is divided again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import NODATA
from .graph import cut

#: Bins of a range in one pass; distinct values that the driver sorts at most for a rank.
BINS, DRIVER_VALUES = 1 << 12, 1 << 18


def decode_nodata(value: Column, nodata: float = NODATA) -> Column:
    return F.when((value != nodata) & ~F.isnan(value), value)


def encode_nodata(value: Column, nodata: float = NODATA) -> Column:
    return F.coalesce(value, F.lit(nodata))


def mask_by(cells: DataFrame, other: DataFrame, value: str = "value") -> DataFrame:
    """``cells`` with ``value`` NULL where ``other`` (row, col, value) has no data."""
    mask = other.select("row", "col", F.col("value").alias("__mask"))
    return cells.join(mask, ["row", "col"], "left").withColumn(value, F.when(F.col("__mask").isNotNull(), F.col(value))).drop("__mask")


def within(value: Column, low: float, high: float) -> Column:
    return F.when(value.between(low, high), value)


def log(value: Column) -> Column:
    return F.when(value > 0, F.ln(value))


def threshold_mask(*tests: tuple[Column, Column]) -> Column:
    """1 where every value is over its limit, else 0, never NULL."""
    met = None
    for value, limit in tests:
        met = value > limit if met is None else met & (value > limit)
    return F.coalesce(met, F.lit(False)).cast("int")


def clamp_low(cost: Column, least: float, into: float = 1.0) -> Column:
    return F.when(cost < least, F.lit(into)).otherwise(cost)


def degrees_of(slope: Column) -> Column:
    return F.degrees(F.atan(slope))


def with_statistics(cells: DataFrame, **statistics: Column) -> DataFrame:
    """``cells`` with each statistic of the whole raster as a column."""
    one = cells.agg(*(c.alias(n) for n, c in statistics.items()))
    return cells.crossJoin(F.broadcast(one))


def minmax_scale(cells: DataFrame, value: str = "value") -> DataFrame:
    """(x - min) / (max - min); a constant raster has NULL everywhere."""
    s = with_statistics(cells, __low=F.min(value), __high=F.max(value))
    return s.withColumn(value, F.try_divide(F.col(value) - F.col("__low"), F.col("__high") - F.col("__low"))).drop("__low", "__high")


def combined_cost(weighted: Sequence[tuple[float, Column | None]], as_sum: bool = False) -> Column:
    """1 / (sum of weight times layer), or the sum; layers that are None are left out, a NULL in a layer makes NULL.

    A sum of 0 costs infinitely much; infinity is a value and counts in quantiles.
    """
    total = None
    for weight, layer in weighted:
        if layer is not None:
            term = F.lit(float(weight)) * layer
            total = term if total is None else total + term
    if total is None:
        raise ValueError("there is no layer")
    return total if as_sum else F.when(total == 0, F.lit(float("inf"))).otherwise(F.lit(1.0) / F.nullif(total, F.lit(0.0)))


def keep_cheapest(cells: DataFrame, share: float = 0.025, dear: float = 100000.0, cost: str = "value") -> DataFrame:
    """Costs of the cheapest share stay; all others, and NULL, become ``dear``. The limit is the exact linear quantile."""
    cells = cut(cells)
    limit = F.lit(quantiles(cells, cost, [share])[0]).cast("double")
    return cells.withColumn(cost, F.when(F.col(cost) < limit, F.col(cost)).otherwise(F.lit(dear)))


def _extent(value: Column) -> dict[str, Column]:
    finite = F.when(~F.isnan(value) & (F.abs(value) < math.inf), value)
    return {"__n": F.count(value), "__least": F.min(finite), "__most": F.max(finite)}


def quantiles(cells: DataFrame, value: str, shares: Sequence[float], extent: tuple[int, float | None, float | None] | None = None) -> list[float | None]:
    """The exact linear quantiles of what isn't NULL, as percentile() has them: infinities count, NaN is over all. None where there is
    nothing. ``cells`` is read three times, once more where a bin has more than DRIVER_VALUES values. ``extent``: the count, and the least and
    greatest finite value, if they are known."""
    v = F.col(value).cast("double")
    values = cells.where(v.isNotNull()).select(v.alias("v"))
    n, low, high = extent or values.agg(*(c.alias(k) for k, c in _extent(F.col("v")).items())).first()
    if not n:
        return [None] * len(shares)
    places = [(n - 1) * float(p) for p in shares]
    at: dict[int, float] = {}
    # ranges of which ranks are wanted: (low, high, values before them and in them, ranks); the first has all, also what isn't finite
    todo = [(-math.inf, math.nan, 0, n, sorted({f(x) for x in places for f in (math.floor, math.ceil)}))]
    v = F.col("v")
    while todo:
        within = [v >= lo if math.isnan(hi) else v.between(lo, hi) for lo, hi, *_ in todo]  # NaN is over all
        whole = [count <= DRIVER_VALUES for *_, count, _ in todo]
        key = F.lit(None)
        for k, (lo, hi, *_) in enumerate(todo):
            if whole[k]:
                slot = F.lit(0)
            elif math.isnan(hi):
                slot = F.when(F.isnan(v), F.lit(BINS + 3)).when(v == math.inf, F.lit(BINS + 2)).when(v == -math.inf, F.lit(-1)).otherwise(_bin(v, low, high))
            else:
                slot = _bin(v, lo, hi)
            key = F.when(within[k], F.struct(F.lit(k).alias("k"), slot.cast("long").alias("slot"), F.when(F.lit(whole[k]), v).alias("v"))).otherwise(key)
        got = values.select("v", key.alias("key")).where("key IS NOT NULL").groupBy("key.k", "key.slot", "key.v").agg(F.count("*").alias("n"), F.min(values["v"]).alias("low"), F.max(values["v"]).alias("high")).collect()
        later = []
        for k, (_, _, before, _, ranks) in enumerate(todo):
            mine = sorted((r for r in got if r["k"] == k), key=lambda r: (r["slot"], math.isnan(r["low"]), r["low"]))
            open_ = list(ranks)
            for r in mine:
                here = [x for x in open_ if x < before + r["n"]]
                open_ = open_[len(here) :]
                if here and (r["low"] == r["high"] or math.isnan(r["low"])):
                    at |= dict.fromkeys(here, r["low"])
                elif here:
                    later.append((r["low"], r["high"], before, r["n"], here))
                before += r["n"]
        todo = later
    out = []
    for x in places:
        lo, hi = at[math.floor(x)], at[math.ceil(x)]
        out.append(lo if lo == hi else (math.ceil(x) - x) * lo + (x - math.floor(x)) * hi)
    return out


def _bin(v: Column, low: float | None, high: float | None) -> Column:
    """Which of the bins of [low, high] holds v; greater values never have a lesser one, and low and high differ in theirs."""
    if low is None or low == high:
        return F.lit(0)
    scale = BINS / (high - low)
    if 0 < scale < math.inf and (high - low) * scale >= 1:
        return F.floor((v - F.lit(low)) * F.lit(scale))
    return F.when(v > F.lit(max(low, min(low / 2 + high / 2, math.nextafter(high, -math.inf)))), F.lit(1)).otherwise(F.lit(0))


def plotting_quantile(values: DataFrame, value: str, p: float, alpha: float = 0.4, beta: float = 0.4) -> float | None:
    """Quantile with plotting positions (alpha, beta), expressed by the linear one; NULLs don't count."""
    values = cut(values.where(F.col(value).isNotNull()).select(value))
    n = values.count()
    if n == 0:
        return None
    if n == 1:
        share = 0.0
    else:
        place = n * p + alpha + p * (1 - alpha - beta)
        share = min(1.0, max(0.0, (place - 1) / (n - 1)))
    return quantiles(values, value, [share])[0]


def statistics(cells: DataFrame, value: str = "value") -> DataFrame:
    """Count, mean, standard deviation (of the population), extremes and the 0.1 and 99.9 percentiles of what has data."""
    v = F.col(value)
    one = cut(cells.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), *(c.alias(k) for k, c in _extent(v).items())))
    p = quantiles(cells, value, [0.001, 0.999], tuple(one.select("__n", "__least", "__most").first()))
    return one.drop("__n", "__least", "__most").withColumns({k: F.lit(x).cast("double") for k, x in zip(("p001", "p999"), p)})
