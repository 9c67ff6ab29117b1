"""Best-fit packing of documents into sequences of fixed length, improved by a swap-based local search.

Texts are tokenised once; only (doc_id, tokens) is shuffled, into packing shards of a bounded number of documents, so that the
work is linear in the corpus. In each shard the pieces are placed best fit, longest first. Then the emptiest bins, as many as
there are over the lower bound, give documents away to other underfull bins: a move, an exchange of one for one, of two for one
or of one for two, each of which makes the fuller bin fuller and so raises the sum of squared fills, until they are empty or no
exchange is left; the other underfull bins exchange too.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches, columns_of, tidy


@dataclass(frozen=True)
class PackConfig:
    """capacity: tokens in a sequence. separator: tokens that end each document. vocabulary: path of byte-level BPE ranks;
    pattern: the expression that splits text before it. shard_rows: documents packed together, on average."""

    capacity: int = 2048
    separator: int = 1
    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    shard_rows: int = 16384
    seed: int = 5


@cache
def _encoding(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Where no piece of the default pattern goes on: after a letter, number or sign (not an apostrophe) before a character of another kind.
_ANEW = r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}'])(?=[\s\p{L}\p{N}])"
STRETCH = 1 << 16


@cache
def _anew() -> tuple[regex.Pattern, regex.Pattern]:
    return regex.compile(_ANEW), regex.compile("(?r)" + _ANEW)


def token_count(text: str, vocabulary: str, pattern: str) -> int:
    """Tokens of a text. A long one is encoded in stretches that end where the pattern starts anew; where it doesn't for long, the
    whole run is one stretch. Other patterns than the default must not match across such places either."""
    encode, at, n = _encoding(vocabulary, pattern).encode_ordinary, 0, 0
    forth, back = _anew()
    while len(text) - at > STRETCH:
        found = back.search(text, at + 1, at + STRETCH) or forth.search(text, at + STRETCH - 1)
        if not found:
            break
        n += len(encode(text[at : found.start()]))
        at = found.start()
    return n + len(encode(text[at:]))


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first (ties: the earlier item), each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit g: some bin has a gap of g
    for i in np.lexsort((np.arange(len(sizes)), -sizes)).tolist():
        s = int(sizes[i])
        room = open_ >> s
        if room:
            gap = s + (room & -room).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                open_ &= ~(1 << gap)
        else:
            gap, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if gap > s:
            by_gap[gap - s].append(b)
            open_ |= 1 << gap - s
    return bins


class LocalSearch:
    """Empties bins by moves and exchanges that raise the sum of squared fills."""

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int):
        self.sizes, self.bins, self.capacity = sizes.astype(np.int64), [list(b) for b in bins], capacity
        self.fill = np.array([int(sizes[b].sum()) for b in bins], np.int64)
        self.least = -(-int(sizes.sum()) // capacity)
        self.exchanges = 0
        self.home = np.zeros(len(sizes), np.int64)
        for k, b in enumerate(bins):
            self.home[b] = k
        self._pair_up()

    def run(self) -> list[list[int]]:
        """Only as many bins as there are over the lower bound can ever be emptied, so the emptiest ones give first; then all other
        underfull bins exchange, and the next round begins, until no bin is left over or nothing moves. Each exchange raises the sum
        of squared fills, which has an upper bound, so it ends."""
        while int((self.fill > 0).sum()) > self.least:
            used = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
            donors = used[np.lexsort((used, self.fill[used]))].tolist()
            moved = False
            for a in donors:
                while self.fill[a] and self._improve(a):
                    moved = True
                if int((self.fill > 0).sum()) == self.least:
                    break
            if not moved:
                break
        return [b for b in self.bins if b]

    def _pair_up(self) -> None:
        """All pairs of items that share a bin: (i, j, size of both). Pairs that an exchange parts are seen by their homes; new ones wait."""
        pairs = [np.array(list(combinations(b, 2)), np.int64).reshape(-1, 2) for k, b in enumerate(self.bins) if self.fill[k] < self.capacity]
        self.pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        self.both = self.sizes[self.pairs].sum(1)
        self.fresh: list[tuple[int, int]] = []

    def _improve(self, a: int) -> bool:
        """The exchange that takes most out of bin a, with a bin at least as full; ties go to the kind tried first and the earliest items."""
        mine = sorted(self.bins[a], key=lambda i: (-self.sizes[i], i))
        gap = np.where((self.fill >= self.fill[a]) & (self.fill < self.capacity), self.capacity - self.fill, 0)
        gap[a] = 0
        for x in mine:  # a move, into the tightest room
            room = np.where(gap >= self.sizes[x], gap, self.capacity + 1)
            b = int(room.argmin())
            if room[b] <= self.capacity:
                self._swap(a, b, [x], [])
                return True
        best: tuple[int, list[int], list[int]] = (0, [], [])
        item_gap = gap[self.home]
        given = [[x] for x in mine] + [list(p) for p in combinations(mine, 2)]
        for g in given:
            best = self._best(best, g, self.sizes, item_gap, lambda k: [k])
        if len(self.fresh) > 4096:
            self._pair_up()
        if self.fresh:
            self.pairs = np.concatenate([self.pairs, np.array(self.fresh, np.int64)])
            self.both = np.concatenate([self.both, self.sizes[np.array(self.fresh)].sum(1)])
            self.fresh = []
        i, j = self.home[self.pairs[:, 0]], self.home[self.pairs[:, 1]]
        pair_gap = np.where(i == j, gap[i], 0)
        for g in given[: len(mine)]:
            best = self._best(best, g, self.both, pair_gap, lambda k: self.pairs[k].tolist())
        if not best[0]:
            return False
        self._swap(a, int(self.home[best[2][0]]), best[1], best[2])
        return True

    def _best(self, best, given, back, gap, names):
        gain = int(self.sizes[given].sum()) - back
        ok = np.flatnonzero((gain > best[0]) & (gain <= gap))
        if len(ok):
            k = int(ok[np.argmax(gain[ok])])
            return int(gain[k]), given, names(k)
        return best

    def _swap(self, a: int, b: int, given: list[int], taken: list[int]) -> None:
        self.exchanges += 1
        for source, target, items in ((a, b, given), (b, a, taken)):
            for i in items:
                self.bins[source].remove(i)
            for i in items:
                self.fresh += [(i, other) for other in self.bins[target] if other not in given and other not in taken]
                self.bins[target].append(i)
                self.home[i] = target
        self.fresh += [tuple(p) for items in (given, taken) for p in combinations(items, 2)]
        amount = int(self.sizes[given].sum()) - int(self.sizes[taken].sum())
        self.fill[a] -= amount
        self.fill[b] += amount


def pack_sizes(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers for sizes of 1 to capacity."""
    return LocalSearch(sizes, best_fit(sizes, capacity), capacity).run() if len(sizes) else []


_OUT = "doc_id long, piece long, start_token long, end_token long, shard long, bin long, bin_offset long"


def _pack_shard(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("luck", "ascending"), ("doc_id", "ascending"), ("tokens", "ascending")])
        doc, n = table["doc_id"].combine_chunks(), table["tokens"].to_numpy()
        shard = table["shard"][0].as_py()
        pieces = np.maximum(-(-n // capacity), 1)
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        end = np.minimum(start + capacity, n[row])
        size = end - start
        bin_, offset, used = np.full(len(row), -1), np.zeros(len(row), np.int64), 0
        for whole in np.flatnonzero(size == capacity).tolist():
            bin_[whole] = used
            used += 1
        rest = np.flatnonzero((size > 0) & (size < capacity))
        for b in pack_sizes(size[rest], capacity):
            at = 0
            for i in b:
                bin_[rest[i]], offset[rest[i]] = used, at
                at += int(size[rest[i]])
            used += 1
        none = bin_ < 0
        return pa.table(
            {
                "doc_id": doc.take(pa.array(row)),
                "piece": piece,
                "start_token": start,
                "end_token": end,
                "shard": np.full(len(row), shard),
                "bin": pa.array(bin_, pa.int64(), mask=none),
                "bin_offset": pa.array(offset, pa.int64(), mask=none),
            }
        )

    return run


def count_tokens(docs: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """(doc_id, luck, tokens): tokens with the separator; 0 for a null or empty text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, luck, text in columns_of(batches, "doc_id", "luck", "text"):
            n = [token_count(t, config.vocabulary, config.pattern) + config.separator if t else 0 for t in text.to_pylist()]
            yield pa.RecordBatch.from_arrays([doc_id, luck, pa.array(n, pa.int64())], names=["doc_id", "luck", "tokens"])

    luck = F.xxhash64(F.lit(config.seed), "doc_id", "text").alias("luck")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), luck, "text").mapInArrow(count, "doc_id long, luck long, tokens long")


def pack_documents(docs: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """Where each piece of each document lies: (doc_id, piece, start_token, end_token, shard, bin, bin_offset).

    docs needs doc_id and text; other columns aren't read. A document longer than the capacity is cut into full pieces, each a
    bin of its own, and a rest; all its tokens are in some bin. A bin is named by shard and bin and never holds more than the
    capacity. A null or empty text has one row with tokens 0 to 0 and no bin. A null doc_id is carried as null; repeated rows
    are packed one by one. Ties of length go by a seeded hash of doc_id and text. An empty table has no row.
    """
    if config.capacity < 1 or config.shard_rows < 1:
        raise ValueError("capacity and shard_rows must be at least 1")
    docs = bounded_batches(tidy(docs, ["doc_id", "text"]))
    shards = max(1, -(-docs.count() // config.shard_rows))
    counted = count_tokens(docs, config).withColumn("shard", F.pmod("luck", F.lit(shards)))
    return counted.groupBy("shard").applyInArrow(_pack_shard(config.capacity), _OUT)
