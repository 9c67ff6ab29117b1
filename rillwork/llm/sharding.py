"""Sharding by a hypergeometric communication matrix: a uniform random shuffle into shards of exact sizes, with one exchange.

The matrix says how many rows each input partition sends to each shard. Its rows and columns have fixed sums (the partition
sizes and the shard sizes), and it is distributed as in a uniform permutation: multivariate hypergeometric. No node holds
it whole: it is drawn by halving the range of partitions again and again, each half by its own seed, so that a task finds its
own row in O(columns log partitions) compiled steps and a repeated task finds the same. A partition then permutes its rows (it deals
the column numbers in random order), the rows are exchanged, and each column permutes what it got. A column is one shard, or, where
there are many more shards than the exchange should have partitions, several: since the permutation of what a column got is uniform,
cutting it into its shards keeps all arrangements equally likely.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches, fresh, tidy

_NUMPY_MOST = 10**9 - 1


@dataclass(frozen=True)
class ShardConfig:
    """shards: their number; None: enough for at most ``shard_rows`` rows in each. together: shards of one partition of the exchange at
    most; there are as many partitions as the session sets for exchanges at least, unless there are fewer shards."""

    shards: int | None = None
    shard_rows: int = 8192
    together: int = 16
    seed: int = 3


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Of n rows drawn from good + bad, how many are good; for populations of any size.

    Beyond numpy's range by ratio of uniforms with Stadlober's constants, which is exact up to the rounding of the log gamma function.
    """
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if max(good, bad) <= _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n))
    least, most, total, m = min(good, bad), max(good, bad), good + bad, min(n, good + bad - n)
    if m <= 10:  # few draws: one by one
        left_good, left, z = good, total, 0
        for _ in range(m):
            hit = rng.integers(left) < left_good
            z += hit
            left_good, left = left_good - hit, left - 1
        return int(z if m == n else good - z)
    share = least / total
    center, width = m * share + 0.5, math.sqrt((total - m) * n * share * (1 - share) / (total - 1) + 0.5)
    spread = 1.7155277699214135 * width + 0.8989161620588988
    mode = (m + 1) * (least + 1) // (total + 2)
    log = lambda z: math.lgamma(z + 1) + math.lgamma(least - z + 1) + math.lgamma(m - z + 1) + math.lgamma(most - m + z + 1)
    top, at_mode = min(min(m, least) + 1, math.floor(center + 16 * width)), log(mode)
    while True:
        x, y = rng.random(), rng.random()
        w = center + spread * (y - 0.5) / x if x else -1
        if not 0 <= w < top:
            continue
        z = int(w)
        t = at_mode - log(z)
        if x * (4 - x) - 3 <= t or (x * (x - t) < 1 and 2 * math.log(x) <= t):
            break
    if good > bad:
        z = m - z
    return z if m == n else good - z


def split(rng: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """How n rows, drawn from groups of these sizes without replacement, fall on the groups. Groups beyond numpy's range are halved."""
    total = int(sizes.sum())
    if total < _NUMPY_MOST:
        return rng.multivariate_hypergeometric(sizes, n, method="marginals").astype(sizes.dtype)
    if len(sizes) == 1:
        return np.array([n], sizes.dtype)
    middle = len(sizes) // 2
    left = int(sizes[:middle].sum())
    k = hypergeometric(rng, left, total - left, n)
    return np.concatenate([split(rng, sizes[:middle], k), split(rng, sizes[middle:], n - k)])


def matrix_row(partition_sizes: np.ndarray, shard_sizes: np.ndarray, i: int, seed: int) -> np.ndarray:
    """Row i of the communication matrix."""
    before = np.concatenate([[0], np.cumsum(partition_sizes)])
    low, high, mine = 0, len(partition_sizes), shard_sizes
    while high - low > 1:
        middle = (low + high) // 2
        left = split(np.random.default_rng([seed, low, high]), mine, int(before[middle] - before[low]))
        low, high, mine = (low, middle, left) if i < middle else (middle, high, mine - left)
    return mine


def even_sizes(rows: int, shards: int) -> np.ndarray:
    return rows // shards + (np.arange(shards) < rows % shards).astype(np.int64)


def shuffle_to_shards(docs: DataFrame, config: ShardConfig = ShardConfig()) -> DataFrame:
    """``docs`` with the columns shard (0 ...) and shard_pos (0 ... in each shard), a uniform random arrangement by the seed.

    Sizes are exact: they differ by one at most, the first shards being larger. Every row stays, whatever it holds: nulls, long
    texts and repeated rows are carried as they are. Existing columns shard and shard_pos are replaced. An empty table gives
    an empty table; more shards than rows leave the last ones empty. The rows' order and partitions must be the same each
    time ``docs`` is computed, as they are for files; a partition that changes its size between the count and the exchange
    stops the job instead of giving wrong sizes.
    """
    docs = bounded_batches(tidy(docs, []))
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "shard_pos")])
    counted = docs.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    sizes = np.zeros(1 + max([r["p"] for r in counted], default=0), np.int64)
    for r in counted:
        sizes[r["p"]] = r["n"]
    total = int(sizes.sum())
    shards = config.shards if config.shards is not None else max(1, -(-total // config.shard_rows))
    if shards < 1:
        raise ValueError("there must be at least one shard")
    columns = max(min(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-shards // config.together))
    first = np.arange(columns + 1) * shards // columns  # of each column; shard s begins at row s q + min(s, r) of all
    q, r = divmod(total, shards)
    targets = np.diff(first * q + np.minimum(first, r))
    shared = docs.sparkSession.sparkContext.broadcast((sizes, targets))
    luck, origin, column = fresh(docs, "__luck"), fresh(docs, "__origin"), fresh(docs, "__column")
    seed = config.seed

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, targets = shared.value
        i = TaskContext.get().partitionId()
        n = int(sizes[i]) if i < len(sizes) else 0
        rng = np.random.default_rng([seed, i])
        dealt = rng.permutation(np.repeat(np.arange(len(targets), dtype=np.int32), matrix_row(sizes, targets, i, seed))) if n else np.zeros(0, np.int32)
        at = 0
        for b in batches:
            end = at + b.num_rows
            if end > n:
                break
            extra = [pa.array(dealt[at:end]), pa.array(rng.integers(-(1 << 63), (1 << 63) - 1, b.num_rows)), pa.array((i << 33) + np.arange(at, end))]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, column, luck, origin])
            at = end
        else:
            end = at
        if end != n:
            raise RuntimeError(f"partition {i} had {n} rows when counted; write the table before it is sharded")

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{column}` int", f"`{luck}` long", f"`{origin}` long"])
    exchanged = docs.mapInArrow(deal, schema).repartitionById(columns, F.col(column)).sortWithinPartitions(luck, origin)
    begins = F.floor(F.col(column).cast("long") * shards / columns) if columns < shards else F.col(column).cast("long")
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + begins * q + F.least(begins, F.lit(r))
    placed = exchanged.withColumn(luck, at)
    long_rows, at = r * (q + 1), F.col(luck)
    shard = F.when(at < long_rows, F.floor(at / (q + 1))).otherwise(F.floor((at - long_rows) / max(q, 1)) + r)
    pos = F.when(at < long_rows, at % (q + 1)).otherwise((at - long_rows) % max(q, 1))
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], shard.cast("int").alias("shard"), pos.cast("long").alias("shard_pos"))
