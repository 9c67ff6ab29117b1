"""Language-model scoring with a hidden Markov model over words.

Every word that the whole corpus has at least ``min_count`` times is a symbol of its own; each rarer word is one of 16 symbols
by its length, times the probability of its spelling (character pairs, counted over all words), so every text has a
probability. The number of symbols has no limit and grows with the corpus. Baum-Welch: each task runs forward and backward over
the texts of its partition, all texts in step, and emits expected counts; they are summed by ranges of symbols in a shuffle, and make
the next model, until the likelihood hardly gains. The first model is sticky (a state mostly stays), so that whole texts choose states
by their words and the states part at once; from a nearly uniform start they would stay alike for many iterations. Scores are exact:
the scaled forward recursion, in 64-bit numbers, sums over all paths of states, over the whole text. A long text is cut into chunks
that run in step: products of their matrices of moves and emissions give each chunk its start and end.

What moves: word counts of the corpus once (they grow with its vocabulary), then per iteration a partition's own symbols x
states numbers of 4 bytes, packed. Shuffle files are removed after each iteration, so the disks hold those of one. The texts are
encoded once, four bytes a word, and written to the checkpoint folder. The driver and each Python worker hold the model,
symbols x states of 4 bytes, and the hashes of the words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches, columns_of, cut, shuffles_removed, tidy
from .text import PLAIN_SYMBOLS, SYMBOLS, mix, spelled_words, word_hashes, word_symbols

LENGTHS = 16
#: Words that are run forward and backward together, and words of a text from which on it runs in chunks.
STEP_WORDS, LONG_WORDS = 1 << 19, 8192
#: Symbols of one range whose counts are summed together, and the row that holds the moves, starts and likelihood.
RANGE, REST = 1 << 14, -1
_CODE_POINTS = 0x110000


@dataclass(frozen=True)
class HmmConfig:
    """states: latent states. min_count: words seen so often have a symbol of their own. vocabulary: None, or at most so many of them, the
    most frequent. tolerance: Baum-Welch, each iteration over the whole corpus, ends when the log likelihood gains less than this share of
    itself. iterations: None, or how many there are instead. sticky: probability of the first model that a state stays.
    emission_prior, transition_prior: pseudo-counts."""

    states: int = 6
    min_count: int = 2
    vocabulary: int | None = None
    tolerance: float = 1e-3
    iterations: int | None = None
    sticky: float = 0.9
    emission_prior: float = 0.1
    transition_prior: float = 1.0
    seed: int = 17


@dataclass
class Hmm:
    start: np.ndarray  #: [state]
    move: np.ndarray  #: [state, next state]
    emit: np.ndarray  #: [symbol, state], float32


@dataclass
class Lexicon:
    hashes: np.ndarray  #: of the frequent words, sorted; symbol i is word i
    spell: np.ndarray  #: log probability of a symbol after another
    longer: float  #: log probability that a word of LENGTHS characters or more goes on

    @property
    def size(self) -> int:
        return len(self.hashes) + LENGTHS

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, log probability of the spelling of each word, offsets)."""
        hashes, lengths, spelling, offsets = spelled_words(texts, self.spell)
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        beyond = lengths - LENGTHS
        spelling = spelling + np.where(beyond >= 0, beyond * self.longer + math.log1p(-math.exp(self.longer)), 0)
        symbol = np.where(known, at, len(self.hashes) + np.minimum(lengths, LENGTHS) - 1)
        return symbol.astype(np.uint32), np.where(known, 0.0, spelling), offsets


def _corpus_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): 0 counts of words by hash, 1 of symbol pairs, 2 of words of LENGTHS characters or more, and what they exceed it by."""
    pairs, long_words, beyond = np.zeros(SYMBOLS * SYMBOLS, np.int64), 0, 0
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def words() -> pa.RecordBatch:
        every, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
        n = np.bincount(at, np.concatenate([c for _, c in held])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(every), np.int32)), pa.array(every.view(np.int64)), pa.array(n)], names=["kind", "key", "n"])

    for (text,) in columns_of(batches, "text"):
        texts = text.to_pylist()
        held.append(np.unique(word_hashes(texts)[0], return_counts=True))
        size += len(held[-1][0])
        for symbol, before, start, stop in word_symbols(texts):
            pairs += np.bincount(before[symbol > 0] * SYMBOLS + symbol[symbol > 0], minlength=len(pairs))
            over = stop - start - LENGTHS
            long_words, beyond = long_words + int((over >= 0).sum()), beyond + int(over[over > 0].sum())
        if size > 1 << 21:
            yield words()
            held, size = [], 0
    if held:
        yield words()
    seen = np.flatnonzero(pairs)
    key = np.concatenate([seen, [0, 1]])
    kind = np.concatenate([np.ones(len(seen), np.int32), np.full(2, 2, np.int32)])
    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), pa.array(np.concatenate([pairs[seen], [long_words, beyond]]))], names=["kind", "key", "n"])


def build_lexicon(docs: DataFrame, config: HmmConfig = HmmConfig()) -> Lexicon:
    """From the counts of all words of all documents. Under a limited vocabulary, ties of frequency go to the lesser hash."""
    if config.min_count < 1 or config.vocabulary is not None and config.vocabulary < 0:
        raise ValueError("min_count must be at least 1, vocabulary at least 0 or None")
    with shuffles_removed(docs.sparkSession):
        counts = cut(docs.select("text").mapInArrow(_corpus_counts, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words = counts.where((F.col("kind") == 0) & (F.col("n") >= config.min_count))
    if config.vocabulary is not None:
        words = words.orderBy(F.desc("n"), "key").limit(config.vocabulary)
    known = words.select("key").toArrow()
    rest = counts.where("kind > 0").toArrow()
    kind, key, n = (rest[c].to_numpy() for c in ("kind", "key", "n"))
    pairs = np.zeros(SYMBOLS * SYMBOLS)
    pairs[key[kind == 1]] = n[kind == 1]
    pairs = pairs.reshape(SYMBOLS, SYMBOLS)
    unigram = pairs.sum(0) + 0.1
    unigram[0] = 0
    unigram /= unigram.sum()
    with np.errstate(divide="ignore"):
        spell = np.log((pairs + 5 * unigram) / (pairs.sum(1, keepdims=True) + 5))
    spell[:, PLAIN_SYMBOLS:] -= math.log(-(-(_CODE_POINTS - PLAIN_SYMBOLS) // (SYMBOLS - PLAIN_SYMBOLS)))
    spell[:, 0] = 0  # never looked up within a word
    more = dict(zip(key[kind == 2].tolist(), n[kind == 2].tolist()))
    longer = math.log((more.get(1, 0) + 1) / (more.get(0, 0) + more.get(1, 0) + 2))
    return Lexicon(np.sort(known["key"].to_numpy().view(np.uint64)), spell, longer)


def first_model(lexicon: Lexicon, config: HmmConfig) -> Hmm:
    """Seeded and unequal, so that the states can part, and sticky, so that they do at once."""
    k, v = config.states, lexicon.size
    luck = (mix(np.arange(1, (v + k + 1) * k + 1, dtype=np.uint64) * np.uint64(config.seed * 2 + 1)) >> np.uint64(11)).astype(np.float64) / 2**53
    emit = (0.25 + luck[: v * k]).reshape(v, k)
    move = (0.5 + luck[v * k : (v + k) * k]).reshape(k, k)
    if k > 1:
        np.fill_diagonal(move, 0)
        move *= (1 - config.sticky) / move.sum(1, keepdims=True)
        np.fill_diagonal(move, config.sticky)
    return Hmm(np.full(k, 1 / k), move / move.sum(1, keepdims=True), (emit / emit.sum(0)).astype(np.float32))


def _in_step(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences sorted longest first (their order), and how many are still running at each time."""
    order = np.argsort(-lengths, kind="stable")
    running = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
    return order, running


def _by_time(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols in order of time then sequence, where each time starts, order of the sequences)."""
    lengths = np.diff(offsets)
    order, running = _in_step(lengths)
    starts = np.concatenate([[0], np.cumsum(running)])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    time = np.arange(len(symbols)) - np.repeat(offsets[:-1], lengths)
    place = starts[time] + np.repeat(rank, lengths)
    timed = np.empty(len(symbols), np.int64)
    timed[place] = symbols
    return timed, starts, order


def forward(model: Hmm, timed: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities [word, state] and scales [word], by time."""
    alpha = model.emit[timed].astype(np.float64)
    scale = np.empty(len(timed))
    move = model.move
    for t in range(len(starts) - 1):
        a, b = starts[t], starts[t + 1]
        now = alpha[a:b]
        if t:
            p = starts[t - 1]
            now *= alpha[p : p + b - a] @ move
        else:
            now *= model.start
        s = now.sum(1)
        scale[a:b] = s
        now /= s[:, None]
    return alpha, scale


@dataclass
class Stretch:
    """Forward probabilities of a stretch of one long sequence, and what backward needs. Words first ... first + chunks x size run in chunks."""

    emit: np.ndarray
    alpha: np.ndarray
    scale: np.ndarray
    first: int
    chunks: int
    size: int
    products: np.ndarray | None  #: [chunk, state, state]


def stretch_forward(model: Hmm, symbols: np.ndarray, before: np.ndarray | None) -> Stretch:
    """``before``: the forward probabilities of the word before the stretch, None at the start of a sequence."""
    emit, move = model.emit[symbols].astype(np.float64), model.move
    n, k = emit.shape
    alpha, scale, first, products = np.empty((n, k)), np.empty(n), 0, None
    if before is None:
        now = model.start * emit[0]
        scale[0] = now.sum()
        before = alpha[0] = now / scale[0]
        first = 1
    size = max(1, math.isqrt(n))
    chunks = (n - first) // size
    if chunks < 2:
        chunks = 0
    end = first + chunks * size
    if chunks:
        e, a, s = emit[first:end].reshape(chunks, size, k), alpha[first:end].reshape(chunks, size, k), scale[first:end].reshape(chunks, size)
        products = np.broadcast_to(np.eye(k), (chunks, k, k))
        for t in range(size):
            products = (products @ move) * e[:, t, None, :]
            products /= products.sum((1, 2), keepdims=True)
        now = np.empty((chunks, k))
        for c in range(chunks):
            now[c] = before
            before = before @ products[c]
            before /= before.sum()
        for t in range(size):
            now = (now @ move) * e[:, t]
            s[:, t] = now.sum(1)
            now /= s[:, t, None]
            a[:, t] = now
        before = alpha[end - 1]
    for t in range(end, n):
        now = (before @ move) * emit[t]
        scale[t] = now.sum()
        before = alpha[t] = now / scale[t]
    return Stretch(emit, alpha, scale, first, chunks, size, products)


def stretch_backward(model: Hmm, x: Stretch, last: np.ndarray) -> np.ndarray:
    """Scaled backward probabilities [word, state]; ``last`` is that of the last word."""
    n, back = len(x.alpha), model.move.T
    beta = np.empty_like(x.alpha)
    beta[n - 1] = last
    end = x.first + x.chunks * x.size

    def down(high: int, low: int) -> None:
        for t in range(high, low - 1, -1):
            beta[t] = (beta[t + 1] * x.emit[t + 1] / x.scale[t + 1]) @ back

    down(n - 2, max(end - 1, 0))
    if x.chunks:
        e, b, s = (y[x.first : end].reshape(x.chunks, x.size, -1) for y in (x.emit, beta, x.scale[:, None]))
        now = np.empty((x.chunks, beta.shape[1]))
        now[-1] = beta[end - 1]
        for c in range(x.chunks - 1, 0, -1):
            before = x.products[c] @ now[c]
            now[c - 1] = before / (x.alpha[x.first + c * x.size - 1] @ before)
        for t in range(x.size - 1, -1, -1):
            b[:, t] = now
            now = (now * e[:, t] / s[:, t]) @ back
        down(x.first - 1, 0)
    return beta


def _stretches(n: int) -> list[tuple[int, int]]:
    return [(a, min(n, a + STEP_WORDS)) for a in range(0, n, STEP_WORDS)]


def _long_counts(model: Hmm, symbols: np.ndarray, emissions: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(moves not yet times the model's, starts, log likelihood) of one long sequence, stretch by stretch; its emissions are added."""
    k = len(model.move)
    ends, total = [None], 0.0
    for a, b in _stretches(len(symbols)):
        x = stretch_forward(model, symbols[a:b], ends[-1])
        ends.append(x.alpha[-1].copy())
        total += float(np.log(x.scale).sum())
    moves, last = np.zeros((k, k)), np.ones(k)
    for (a, b), before in reversed(list(zip(_stretches(len(symbols)), ends))):
        if b < len(symbols) or a > 0:  # else it is still at hand
            x = stretch_forward(model, symbols[a:b], before)
        beta = stretch_backward(model, x, last)
        ahead = beta * x.emit / x.scale[:, None]
        moves += x.alpha[:-1].T @ ahead[1:]
        if before is not None:
            moves += np.outer(before, ahead[0])
        last = ahead[0] @ model.move.T
        gamma = x.alpha * beta
        seen, place = np.unique(symbols[a:b], return_inverse=True)
        for s in range(k):
            emissions[seen, s] += np.bincount(place, gamma[:, s])
    return moves, gamma[0], total


def _short(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the long sequences, those of the others, the others' symbols and offsets). The others come by length, so that those that
    run in step end at about one time."""
    lengths = np.diff(offsets)
    order = np.argsort(lengths, kind="stable")
    few = int(np.searchsorted(lengths[order], LONG_WORDS, side="right"))
    rest, long = order[:few], order[few:]
    at = np.concatenate([[0], np.cumsum(lengths[rest])])
    return long, rest, symbols[np.repeat(offsets[rest] - at[:-1], lengths[rest]) + np.arange(at[-1])], at


def log_likelihoods(model: Hmm, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each sequence symbols[offsets[i]:offsets[i + 1]]; 0 for an empty one."""
    out = np.zeros(len(offsets) - 1)
    long, rest, short, at = _short(symbols, offsets)
    for i in long:
        before = None
        mine = symbols[offsets[i] : offsets[i + 1]]
        for a, b in _stretches(len(mine)):
            x = stretch_forward(model, mine[a:b], before)
            before = x.alpha[-1]
            out[i] += np.log(x.scale).sum()
    out[rest] = _short_likelihoods(model, short, at)
    return out


def _short_likelihoods(model: Hmm, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1)
    for lo, hi in _groups(offsets):
        timed, starts, order = _by_time(symbols[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        _, scale = forward(model, timed, starts)
        logs, total = np.log(scale), np.zeros(hi - lo)
        for a, b in zip(starts[:-1], starts[1:]):
            total[: b - a] += logs[a:b]
        out[lo + order] = total
    return out


def _groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + STEP_WORDS, side="right")) - 1)
        yield lo, hi
        lo = hi


def expected_counts(model: Hmm, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(emissions [symbol, state], moves [state, state], starts [state], log likelihood) by forward and backward."""
    v, k = model.emit.shape
    emissions, moves, starts_, total = np.zeros((v, k)), np.zeros((k, k)), np.zeros(k), 0.0
    long, _, short, at = _short(symbols, offsets)
    for i in long:
        m, s, t = _long_counts(model, symbols[offsets[i] : offsets[i + 1]], emissions)
        moves, starts_, total = moves + m, starts_ + s, total + t
    symbols, offsets, move = short, at, model.move
    for lo, hi in _groups(offsets):
        timed, starts, _ = _by_time(symbols[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        if not len(timed):
            continue
        alpha, scale = forward(model, timed, starts)
        total += float(np.log(scale).sum())
        beta = np.ones((starts[1], k))  # of the time after the one at hand, its running sequences first
        for t in range(len(starts) - 2, -1, -1):
            a, b = starts[t], starts[t + 1]
            now = alpha[a:b]
            if t + 2 <= len(starts) - 1:
                c, d = b, starts[t + 2]
                ahead = beta[: d - c] * model.emit[timed[c:d]]
                ahead /= scale[c:d, None]
                moves += now[: d - c].T @ ahead
                beta[: d - c] = ahead @ move.T
            now *= beta[: b - a]  # alpha becomes the posterior; alpha of time t isn't needed any more
        starts_ += alpha[: starts[1]].sum(0, dtype=np.float64)
        for s in range(k):
            emissions[:, s] += np.bincount(timed, alpha[:, s], v)
    return emissions, moves * model.move, starts_, total


def next_model(emissions: np.ndarray, moves: np.ndarray, starts: np.ndarray, config: HmmConfig) -> Hmm:
    total = emissions.sum(1, keepdims=True, dtype=np.float64)
    emit = emissions + config.emission_prior * (total + 1) / (total.sum() + len(emissions))
    move, start = moves + config.transition_prior, starts + config.transition_prior
    return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), (emit / emit.sum(0)).astype(np.float32))


def _encode(lexicon_broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon: Lexicon = lexicon_broadcast.value
        for doc_id, text in columns_of(batches, "doc_id", "text"):
            symbols, spelling, offsets = lexicon.encode(text.to_pylist())
            total = np.concatenate([[0.0], np.cumsum(spelling)])
            blobs = [symbols[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(blobs, pa.binary()), pa.array(total[offsets[1:]] - total[offsets[:-1]])], names=["doc_id", "symbols", "spelling"])

    return run


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), np.uint32).astype(np.int64), np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])])


def _expect(model_broadcast):
    """Expected counts, to be summed by range: (range, packed symbols and counts by state). REST has one row of float64: the moves, the
    starts, the log likelihood. Of the symbols only those at hand are counted and given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Hmm = model_broadcast.value
        v, held, size = len(model.emit), [], 0
        squeeze = zstandard.ZstdCompressor(1)

        def counted() -> pa.RecordBatch:
            symbols, offsets = _sequences(pa.concat_arrays(held))
            seen = np.flatnonzero(np.bincount(symbols, minlength=v))
            place = np.zeros(v, np.int64)
            place[seen] = np.arange(len(seen))
            emissions, moves, starts, loglik = expected_counts(Hmm(model.start, model.move, model.emit[seen]), place[symbols], offsets)
            keys, blobs = [REST], [np.concatenate([moves.ravel(), starts, [loglik]]).tobytes()]
            for few in np.split(np.arange(len(seen)), np.flatnonzero(np.diff(seen // RANGE)) + 1):
                if len(few):
                    keys.append(int(seen[few[0]]) // RANGE)
                    blobs.append(squeeze.compress(np.uint32(len(few)).tobytes() + (seen[few] % RANGE).astype(np.uint16).tobytes() + emissions[few].astype(np.float32).T.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=["range", "counts"])

        for (symbols,) in columns_of(batches, "symbols"):
            held.append(symbols)
            size += symbols.nbytes // 4
            if size > 8 * STEP_WORDS:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    return run


def _sum_counts(k: int):
    """Of each range the sum: float64 [symbol, state]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, total = zstandard.ZstdDecompressor(), {}
        for key, counts in columns_of(batches, "range", "counts"):
            for i, x in zip(key.to_pylist(), counts.to_pylist()):
                if i == REST:
                    x = np.frombuffer(x)
                    total[i] = total[i] + x if i in total else x
                else:
                    x = expand.decompress(x)
                    n = int(np.frombuffer(x, np.uint32, 1)[0])
                    into = total.setdefault(i, np.zeros((RANGE, k)))
                    into[np.frombuffer(x, np.uint16, n, 4)] += np.frombuffer(x, np.float32, n * k, 4 + 2 * n).reshape(k, n).T
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype(np.float32 if i != REST else np.float64).tobytes() for i, x in total.items()], pa.binary())], names=["range", "counts"])

    return run


def train(encoded: DataFrame, lexicon: Lexicon, config: HmmConfig = HmmConfig()) -> tuple[Hmm, list[float]]:
    """The model after Baum-Welch over all of ``encoded``, and the log likelihood before each iteration."""
    if config.states < 1 or config.tolerance <= 0:
        raise ValueError("there must be at least one state, and a tolerance over 0")
    model, history, k = first_model(lexicon, config), [], config.states
    ranges = -(-lexicon.size // RANGE)
    while config.iterations is None or len(history) < config.iterations:
        shared = encoded.sparkSession.sparkContext.broadcast(model)
        with shuffles_removed(encoded.sparkSession):
            counts = encoded.select("symbols").mapInArrow(_expect(shared), "range int, counts binary")
            got = counts.repartition(max(1, min(ranges, 64)), "range").mapInArrow(_sum_counts(k), "range int, counts binary").toArrow()
        shared.destroy()  # with the driver's file, which unpersist leaves
        emissions, rest = np.zeros((ranges * RANGE, k), np.float32), np.zeros(k * k + k + 1)
        for i, x in zip(got["range"].to_pylist(), got["counts"].to_pylist()):
            if i == REST:
                rest = np.frombuffer(x)
            else:
                emissions[i * RANGE : (i + 1) * RANGE] = np.frombuffer(x, np.float32).reshape(RANGE, k)
        history.append(float(rest[-1]))
        model = next_model(emissions[: lexicon.size], rest[: k * k].reshape(k, k), rest[k * k : -1], config)
        if config.iterations is None and (len(history) > 1 and history[-1] - history[-2] < config.tolerance * abs(history[-1]) or history[-1] == 0):
            break
    return model, history


def score_documents(docs: DataFrame, config: HmmConfig = HmmConfig()) -> DataFrame:
    """(doc_id, n_words, log_likelihood, cross_entropy) of every row, under the model trained on all rows.

    docs needs doc_id and text; other columns aren't read. log_likelihood is in nats, of the whole text; cross_entropy is
    -log_likelihood / n_words. A null text, or one without a word, has 0 words, log_likelihood 0 and no cross-entropy (null). A null
    doc_id is carried; repeated rows count again in training and get equal scores. An empty table has no row. Texts of any length are
    scored whole.
    """
    docs = bounded_batches(tidy(docs, ["doc_id", "text"])).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sc = docs.sparkSession.sparkContext
    lexicon = build_lexicon(docs, config)
    words = sc.broadcast(lexicon)
    encoded = cut(docs.mapInArrow(_encode(words), "doc_id long, symbols binary, spelling double"))
    words.destroy()
    model, _ = train(encoded, lexicon, config)
    shared = sc.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def scored() -> pa.RecordBatch:
            doc_id, symbols, spelling = (pa.concat_arrays(x) for x in zip(*held))
            every, offsets = _sequences(symbols)
            n = np.diff(offsets)
            total = log_likelihoods(shared.value, every, offsets) + spelling.to_numpy()
            entropy = pa.array(-total / np.maximum(n, 1), mask=n == 0)
            return pa.RecordBatch.from_arrays([doc_id, pa.array(n), pa.array(total), entropy], names=["doc_id", "n_words", "log_likelihood", "cross_entropy"])

        for columns in columns_of(batches, "doc_id", "symbols", "spelling"):
            held.append(columns)
            size += columns[1].nbytes // 4
            if size > 2 * STEP_WORDS:
                yield scored()
                held, size = [], 0
        if held:
            yield scored()

    return encoded.mapInArrow(score, "doc_id long, n_words long, log_likelihood double, cross_entropy double")
