"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The documents of each source are put into a seeded order within shards, and cut there into blocks of ``block_tokens``.
Blocks are granted one after another to the source with the highest quotient weight / (2 granted + 1), up to what it has,
until the budget is spent; the blocks of each source are apportioned to its shards in the same way. In each shard the first
granted blocks of the seeded order are selected. Since they are a start of that order, a shard's selection is one cut-off
value, so the documents themselves are filtered in one scan and never shuffled.

Only (source, shard, luck, tokens) is shuffled. A source's number of shards follows its tokens, so that no window grows
with a hot source. The driver handles one row per source and shard (16 M tokens each).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Hashable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import cut, fresh, small, tidy

BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class MixConfig:
    """weights: by source, a number of at least 0; a source that isn't in it gets none. None: the square root of its tokens.
    budget: share of all blocks that is granted at most; sources whose supply is spent leave their part to the others, so the weights are
    met only if the supply of each is enough. None: as many blocks as the weights allow, see ``largest_fair``. Tokens are runs of other characters than blank, tab and line ends."""

    weights: tuple[tuple[str | None, float], ...] | None = None
    budget: float | None = 0.9
    block_tokens: int = 8192
    shard_tokens: int = 1 << 24
    seed: int = 11


def sainte_lague(weights: Mapping[Hashable, float], available: Mapping[Hashable, int], total: int) -> dict[Hashable, int]:
    """Seats of each key: the ``total`` highest quotients weight / (2 k + 1), k < available; ties to the lesser key.

    A bisection over the divisor grants all but a few at once, so the time doesn't depend on ``total``.
    """
    live = {k: w for k, w in weights.items() if w > 0 and available.get(k, 0) > 0}
    total = min(total, sum(available[k] for k in live))

    def granted(key: Hashable, divisor: float) -> int:
        w, most = live[key], available[key]
        if w / (2 * most - 1) > divisor:
            return most
        k = max(0, min(most, int((w / divisor + 1) / 2)))
        while k < most and w / (2 * k + 1) > divisor:
            k += 1
        while k and w / (2 * k - 1) <= divisor:
            k -= 1
        return k

    if not live or total <= 0:
        return dict.fromkeys(weights, 0)
    low, high = 0.0, max(live.values())
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if sum(granted(k, middle) for k in live) > total:
            low = middle
        else:
            high = middle
    seats = {k: granted(k, high) for k in live}
    heap = [(-w / (2 * seats[k] + 1), k) for k, w in live.items() if seats[k] < available[k]]
    heapq.heapify(heap)
    for _ in range(total - sum(seats.values())):
        _, k = heapq.heappop(heap)
        seats[k] += 1
        if seats[k] < available[k]:
            heapq.heappush(heap, (-live[k] / (2 * seats[k] + 1), k))
    return {k: seats.get(k, 0) for k in weights}


def largest_fair(weights: Mapping[Hashable, float], available: Mapping[Hashable, int]) -> int:
    """The largest total at which no source would be granted more than it has: the place in the ranking of all quotients before the first
    one beyond a source's supply."""
    live = {k: w for k, w in weights.items() if w > 0 and available.get(k, 0) > 0}
    if not live:
        return 0
    first = min((-w / (2 * available[k] + 1), k) for k, w in live.items())
    total = 0
    for key, w in live.items():
        k = max(0, min(available[key], int((w / -first[0] + 1) / 2)))
        while k < available[key] and (-w / (2 * k + 1), key) < first:
            k += 1
        while k and (-w / (2 * k - 1), key) >= first:
            k -= 1
        total += k
    return total


def _marked(docs: DataFrame, seed: int) -> tuple[Column, Column, Column]:
    """(source key, luck, tokens) of a row. The key of source x is "s" + x, of null "n"."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    luck = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))))
    return key, luck, F.coalesce(F.regexp_count("text", F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def _shard(luck: Column, shards: Column) -> Column:
    return F.pmod(F.conv(F.substring(luck, 1, 8), 16, 10).cast("long"), shards)


def block_quotas(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """(key, shard, blocks, quota, cutoff, shards): of each source and shard the blocks it has, those granted, and the greatest luck of
    a selected document (null if there is none)."""
    if config.block_tokens < 1 or config.shard_tokens < 1 or config.budget is not None and not 0 <= config.budget <= 1:
        raise ValueError("block_tokens and shard_tokens must be at least 1, budget 0 to 1 or None")
    spark, b = docs.sparkSession, config.block_tokens
    key, luck, tokens = _marked(docs, config.seed)
    rows = cut(docs.select(key.alias("key"), luck.alias("luck"), tokens.alias("tokens")))
    by_source = {r["key"]: r["t"] for r in rows.groupBy("key").agg(F.sum("tokens").alias("t")).collect()}
    counts = {k: max(1, -(-t // config.shard_tokens)) for k, t in by_source.items()}
    sources = spark.createDataFrame([(k, n) for k, n in counts.items()], "key string, shards long")
    sharded = rows.join(small(sources, BROADCAST_ROWS), "key").withColumn("shard", _shard(F.col("luck"), F.col("shards")))
    run = Window.partitionBy("key", "shard").orderBy("luck")  # a range frame: equal luck, that is repeated rows, falls in one block
    placed = cut(sharded.select("key", "shards", "shard", "luck", F.sum("tokens").over(run).alias("sum")))
    ends = placed.groupBy("key", "shards", "shard").agg(F.max("sum").alias("sum")).select("key", "shards", "shard", F.greatest(F.lit(1), F.ceil(F.col("sum") / b)).cast("long").alias("blocks")).collect()
    of_source: dict[str, dict[int, int]] = {}
    for r in ends:
        of_source.setdefault(r["key"], {})[r["shard"]] = r["blocks"]
    available = {k: sum(x.values()) for k, x in of_source.items()}
    if config.weights is None:
        weights = {k: math.sqrt(max(t, 1)) for k, t in by_source.items()}
    else:
        given = {"n" if k is None else f"s{k}": w for k, w in config.weights}
        weights = {k: given.get(k, 0.0) for k in by_source}
    total = largest_fair(weights, available) if config.budget is None else int(config.budget * sum(available.values()))
    seats = sainte_lague(weights, available, total)
    quota = [(k, s, x[s], q) for k, x in of_source.items() for s, q in sainte_lague({s: float(n) for s, n in x.items()}, x, seats[k]).items()]
    quotas = spark.createDataFrame(quota, "key string, shard long, blocks long, quota long")
    chosen = placed.join(small(quotas, BROADCAST_ROWS), ["key", "shard"])
    cutoff = F.max(F.when((F.col("quota") > 0) & (F.col("sum") <= F.col("quota") * b), F.col("luck")))
    return cut(chosen.groupBy("key", "shard", "blocks", "quota", "shards").agg(cutoff.alias("cutoff")))


def mix_sources(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The selected rows of ``docs``; columns unchanged.

    docs needs doc_id, text and source. A null source is a source of its own. A null or empty text has no token and lies in the
    block of its place. A document belongs to the block in which its last token lies, so blocks are equal up to one document;
    a document longer than a block fills several. The last block of a shard may be short; it counts as one. Rows with a null
    doc_id get their place by their text. Repeated rows share one place and are selected together; ties of quotients go to
    the lesser source. An empty table, or a budget under one block, selects nothing.
    """
    docs = tidy(docs, ["doc_id", "text", "source"])
    quotas = block_quotas(docs, config)
    cuts = quotas.select("key", "shard", "cutoff").where(F.col("cutoff").isNotNull())
    shards = quotas.groupBy("key").agg(F.max("shards").alias("shards"))
    names = {c: fresh(docs, f"__{c}") for c in ("key", "luck", "shards", "shard", "cutoff")}
    key, luck, _ = _marked(docs, config.seed)
    placed = docs.select("*", key.alias(names["key"]), luck.alias(names["luck"]))
    placed = placed.join(small(shards.withColumnsRenamed(names), BROADCAST_ROWS), names["key"])
    placed = placed.withColumn(names["shard"], _shard(F.col(names["luck"]), F.col(names["shards"])))
    selected = placed.join(small(cuts.withColumnsRenamed(names), BROADCAST_ROWS), [names["key"], names["shard"]])
    return selected.where(F.col(names["luck"]) <= F.col(names["cutoff"])).select(docs.columns)


def mix_sql(config: MixConfig = MixConfig()) -> str:
    """The same by ranking all quotients; for the default weights and a budget that isn't None."""
    return f"""
WITH marked AS (
  SELECT *, coalesce('s' || source, 'n') AS key, md5('{config.seed}:' || coalesce(CAST(doc_id AS VARCHAR), text, '')) AS luck,
    coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS tokens FROM documents
), totals AS (SELECT key, sum(tokens) AS t, greatest(1, CAST(ceil(sum(tokens) / {float(config.shard_tokens)}) AS BIGINT)) AS shards FROM marked GROUP BY key),
placed AS (
  SELECT m.*, t.t, CAST('0x' || substr(luck, 1, 8) AS BIGINT) % t.shards AS shard FROM marked m JOIN totals t ON m.key = t.key
), summed AS (SELECT *, sum(tokens) OVER (PARTITION BY key, shard ORDER BY luck) AS total FROM placed),
blocks AS (SELECT key, shard, any_value(t) AS t, greatest(1, CAST(ceil(max(total) / {float(config.block_tokens)}) AS BIGINT)) AS n FROM summed GROUP BY key, shard),
sources AS (SELECT key, any_value(t) AS t, CAST(sum(n) AS BIGINT) AS n FROM blocks GROUP BY key),
ranked AS (
  SELECT key, row_number() OVER (ORDER BY q DESC, key) AS place FROM (SELECT key, sqrt(greatest(t, 1)) / (2 * unnest(range(n)) + 1) AS q FROM sources)
), seats AS (SELECT key, count(*) AS n FROM ranked WHERE place <= (SELECT floor({config.budget} * sum(n)) FROM sources) GROUP BY key),
shares AS (
  SELECT key, shard, row_number() OVER (PARTITION BY key ORDER BY q DESC, shard) AS place
  FROM (SELECT key, shard, CAST(n AS DOUBLE) / (2 * unnest(range(n)) + 1) AS q FROM blocks)
), quotas AS (SELECT s.key, s.shard, count(*) AS quota FROM shares s JOIN seats ON s.key = seats.key WHERE s.place <= seats.n GROUP BY 1, 2)
SELECT doc_id, text, lang, source, n_chars FROM summed s JOIN quotas q ON s.key = q.key AND s.shard = q.shard WHERE total <= quota * {config.block_tokens}
"""
