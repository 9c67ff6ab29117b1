"""Exact deduplication against a history, with minimal perfect hashes over the history's distinct digests.

Only (digest, doc_id) is shuffled. The rows of each side are combined by digest, with partial sums before the exchange, so that
however often a text occurs, each side has one row of it; then they meet by a shard of the digest. Within each shard the history's
distinct digests become a minimal perfect hash of cascaded bit levels; every slot holds the full 32-byte digest and the locator
(doc_id) of the winning row. An incoming digest is looked up and compared byte for byte with its slot: a member is a repeat and
goes, the others are groups of their own. Texts travel at most once, and not at all where the table of repeated digests is
small enough to broadcast (its rows are counted).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import cut, fresh, small, tidy
from .text import mix

#: Rows in one shard, of both sides, at most on average; a shard's table takes about 60 bytes for each distinct digest.
SHARD_ROWS = 1_000_000
BROADCAST_ROWS = 500_000


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests (uint64 [n, 4]) with the digests in its slots."""

    def __init__(self, digests: np.ndarray, gamma: float = 1.5):
        self.sizes: list[int] = []
        bits, rest = [], np.arange(len(digests))
        while len(rest):
            if len(self.sizes) == 64:
                raise ValueError("the digests aren't distinct")
            size = max(64, int(len(rest) * gamma)) + 7 & ~7
            at = self._place(digests[rest], len(self.sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            self.sizes.append(size)
            rest = rest[~alone[at]]
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.bytes = np.packbits(flat, bitorder="little")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bytes), dtype=np.int64)])
        self.slots = np.zeros_like(digests)
        self.order = self._slot(digests)
        self.slots[self.order] = digests

    @staticmethod
    def _place(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        word = digests[:, level % 4] + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        return (mix(word ^ (digests[:, (level + 1) % 4] >> np.uint64(7))) % np.uint64(size)).astype(np.int64)

    def _slot(self, digests: np.ndarray) -> np.ndarray:
        slot, open_, base = np.full(len(digests), -1), np.arange(len(digests)), 0
        for level, size in enumerate(self.sizes):
            at = base + self._place(digests[open_], level, size)
            byte, bit = self.bytes[at >> 3], (at & 7).astype(np.uint8)
            hit = (byte >> bit) & 1 == 1
            below = np.bitwise_count(byte & ((np.uint8(1) << bit) - np.uint8(1)))
            slot[open_[hit]] = (self.before[at >> 3] + below)[hit]
            open_, base = open_[~hit], base + size
        return slot

    def lookup(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for one that isn't a member: the slot's digest differs."""
        slot = self._slot(digests)
        found = slot >= 0
        found[found] = (self.slots[slot[found]] == digests[found]).all(1)
        return np.where(found, slot, -1)


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(flat.to_pylist()), np.uint64).reshape(-1, 4)


def _resolve(history: pa.Table, incoming: pa.Table) -> pa.Table:
    """Of one shard: the history's winners of repeated digests, and the incoming winners of repeated digests that aren't members."""
    mine, theirs = _digests(history["digest"]), _digests(incoming["digest"])
    table = PerfectHash(mine)
    locator = np.empty(len(mine), np.int64)
    locator[table.order] = np.arange(len(mine))
    slot = table.lookup(theirs)
    hits = np.zeros(len(mine), np.int64)
    np.add.at(hits, locator[slot[slot >= 0]], incoming["n"].to_numpy()[slot >= 0])
    repeated = np.flatnonzero(hits + history["n"].to_numpy() > 1)
    new = np.flatnonzero((slot < 0) & (incoming["n"].to_numpy() > 1))
    a, b = history.take(pa.array(repeated)), incoming.take(pa.array(new))
    return pa.table(
        {
            "digest": pa.chunked_array([*a["digest"].chunks, *b["digest"].chunks], pa.binary()),
            "doc_id": pa.chunked_array([*a["doc_id"].chunks, *b["doc_id"].chunks], pa.int64()),
            "same": pa.chunked_array([*a["same"].chunks, *b["same"].chunks], pa.int64()),
            "old": pa.array(np.arange(len(a) + len(b)) < len(a)),
        }
    )


def _winners(keys: DataFrame) -> DataFrame:
    """Per digest the least doc_id (null last), the number of its rows with that doc_id, and of all."""
    each = keys.groupBy("digest", "doc_id").agg(F.sum("same").alias("same"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same"))
    return each.groupBy("digest").agg(least.alias("w"), F.sum("same").alias("n")).select("digest", "w.doc_id", "w.same", "n")


def repeated_digests(docs: DataFrame, is_history: Column) -> DataFrame:
    """(digest, doc_id, same, old): for each text that occurs in several rows the row that stays; ``same`` counts the rows with
    that doc_id, ``old`` says whether it is of the history."""
    keys = docs.where(F.col("text").isNotNull()).select(F.unhex(F.sha2("text", 256)).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(is_history, F.lit(False)).alias("old"), F.lit(1).cast("long").alias("same"))
    shards = max(1, -(-docs.count() // SHARD_ROWS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")
    history, incoming = _winners(keys.where("old")).select("*", shard), _winners(keys.where(~F.col("old"))).select("*", shard)
    return cut(history.groupBy("shard").cogroup(incoming.groupBy("shard")).applyInArrow(_resolve, "digest binary, doc_id long, same long, old boolean"))


def drop_exact_copies(docs: DataFrame, is_history: Column) -> DataFrame:
    """The rows of ``docs`` without repeated texts; columns unchanged.

    docs needs doc_id and text. ``is_history`` marks rows that an earlier run has accepted: their winner stays before any
    incoming row. Among the rows of one text, of one side, the least doc_id stays (null last); of fully tied rows (same text
    and doc_id) the one whose other columns hash least. Texts are compared as they are: no normalisation, case and blanks
    count. An empty text equals other empty texts; a null text equals nothing, so those rows all stay. A null mark or
    doc_id counts as incoming. An empty table gives an empty table. Of a text of any length 32 bytes travel.
    """
    docs = tidy(docs, ["doc_id", "text"])
    digest, old = fresh(docs, "__digest"), fresh(docs, "__old")
    marked = docs.select("*", F.unhex(F.sha2("text", 256)).alias(digest), F.coalesce(is_history, F.lit(False)).alias(old))
    repeated = repeated_digests(docs, is_history)
    w = small(repeated.select(F.col("digest").alias("w_d"), F.col("doc_id").alias("w_id"), F.col("same").alias("w_same"), F.col("old").alias("w_old")), BROADCAST_ROWS)
    clash = {c: fresh(marked, f"__{c}") for c in w.columns}
    w = w.withColumnsRenamed(clash)
    d, i, same, o = (F.col(clash[c]) for c in ("w_d", "w_id", "w_same", "w_old"))
    joined = marked.join(w, marked[digest] == d, "left")
    winner = i.eqNullSafe(F.col("doc_id").cast("long")) & (o == F.col(old))
    kept = joined.where(d.isNull() | (winner & (same == 1))).select(docs.columns)
    if repeated.where("same > 1").isEmpty():
        return kept
    rest = [F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("text",)]
    first = Window.partitionBy(digest).orderBy(F.xxhash64(*rest), F.concat_ws("\x1f", *rest))
    rank = fresh(joined, "__rank")
    tied = joined.where(winner & (same > 1)).withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1)
    return kept.unionByName(tied.select(docs.columns))


def earlier_half(column: str = "doc_id") -> Column:
    """The stand-in for "accepted by an earlier run" where one table holds everything: the even ids."""
    return F.pmod(F.col(column), F.lit(2)) == 0


DEDUP_SQL = """
SELECT doc_id, text, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY abs(doc_id % 2), doc_id) AS place FROM documents
) WHERE place = 1 OR text IS NULL
"""
