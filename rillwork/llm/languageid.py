"""Language identification with interpolated Kneser-Ney character language models.

One model per language is trained on a bounded, seeded sample of the rows whose language is given. All models share one
table per order: sorted 64-bit hashes of the n-grams, and beside them one log probability per language, so one binary
search serves all languages. A text gets the language of the lowest cross-entropy per character; it is rejected when
that cross-entropy lies outside what held-out texts of the language show.

Cost: the sample is counted in one small job; scoring is one pass without any shuffle, and the broadcast model is bounded
by the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import bounded_batches, columns_of, sliced, tidy
from .text import code_points, letters, mix

#: Positions that are looked up at once.
WINDOW = 1 << 18
_MULT = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class LanguageConfig:
    """order: characters in an n-gram, 2 to 6. docs_per_language: bound of the labelled sample. held_out: share of the sample
    that is kept from training, for calibration. reject: share of held-out texts of a known language that may be rejected.
    slack: nats per character added to every threshold."""

    order: int = 4
    docs_per_language: int = 1200
    held_out: float = 0.25
    reject: float = 0.001
    slack: float = 0.15
    seed: int = 7


@dataclass
class LanguageModel:
    languages: list[str]
    order: int
    keys: list[np.ndarray]  #: per order 1..N the sorted hashes of the n-grams
    logp: list[np.ndarray]  #: per order float32 [n-gram, language]
    context_keys: list[np.ndarray]  #: per context length 1..N-1
    backoff: list[np.ndarray]
    unknown: np.ndarray  #: log probability of a character that no language has
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))  #: variance between texts, and of one character
    threshold: float = np.inf
    slack: float = 0.0

    def limit(self, language: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = self.spread[language]
        return self.mean[language] + self.threshold * np.sqrt(v[:, 0] + v[:, 1] / np.maximum(n, 1)) + self.slack


def stream(texts: list[str | None], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, each run of other characters than letters as one blank, ``pad`` blanks before each
    text and one after; and the offsets of the texts. A text without letters is empty."""
    lowered = [(t or "").lower() for t in texts]
    codes = code_points("\n".join(lowered) + "\n") if lowered else np.zeros(0, np.uint32)
    sizes = np.array([len(t) + 1 for t in lowered], np.int64)
    letter = letters()[codes]
    before = np.concatenate([[False], letter[:-1]])
    doc = np.repeat(np.arange(len(texts)), sizes)
    keep = letter | before  # a blank stands only after a letter, so that the last one ends the text
    codes, doc = np.where(letter, codes, np.uint32(32))[keep], doc[keep]
    n = np.bincount(doc, minlength=len(texts))
    at = np.concatenate([[0], np.cumsum(n + pad * (n > 0))])
    out = np.full(at[-1], 32, np.uint32)
    out[np.arange(len(codes)) + pad * (np.cumsum(n > 0)[doc] if len(codes) else 0)] = codes
    return out, at


def _hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Of the ``order`` code points that end at each position from order - 1 on."""
    n = len(codes) - order + 1
    h = np.full(max(0, n), np.uint64(order), np.uint64)
    for k in range(order):
        h = (h + codes[k : k + n].astype(np.uint64)) * _MULT
        h ^= h >> np.uint64(29)
    return mix(h)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def _log_probabilities(model: LanguageModel, codes: np.ndarray) -> np.ndarray:
    """[position, language] for the positions from order - 1 on."""
    n = len(codes) - model.order + 1
    out = np.zeros((n, len(model.languages)), np.float32)
    open_ = np.arange(n)
    for k in range(model.order, 0, -1):
        if not len(open_):
            break
        h = _hashes(codes[model.order - k :], k)[open_]
        at, hit = _find(model.keys[k - 1], h)
        out[open_[hit]] += model.logp[k - 1][at[hit]]
        open_ = open_[~hit]
        if k > 1 and len(open_):
            context = _hashes(codes[model.order - k : -1], k - 1)[open_]
            at, hit = _find(model.context_keys[k - 2], context)
            out[open_[hit]] += model.backoff[k - 2][at[hit]]
    out[open_] += model.unknown
    return out


def cross_entropies(model: LanguageModel, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """([text, language] nats per character, the variance of one character's, characters)."""
    pad = model.order - 1
    total = np.zeros((len(texts), len(model.languages)))
    square = np.zeros_like(total)
    count = np.zeros(len(texts), np.int64)
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b] or "") <= WINDOW):
            size += len(texts[b] or "")
            b += 1
        codes, at = stream(texts[a:b], pad)
        count[a:b] = np.maximum(np.diff(at) - pad, 0)
        for lo in range(0, max(0, len(codes) - pad), WINDOW):
            lp = _log_probabilities(model, codes[lo : lo + WINDOW + pad])
            hi = lo + len(lp)
            for power, into in ((1, total), (2, square)):
                sums = np.concatenate([np.zeros((1, lp.shape[1])), np.cumsum(lp.astype(np.float64) ** power, axis=0)])
                begin, end = np.clip(at[:-1], lo, hi) - lo, np.clip(at[1:] - pad, lo, hi) - lo
                into[a:b] += sums[np.maximum(begin, end)] - sums[begin]
        a = b
    n = np.maximum(count, 1)[:, None]
    return -total / n, np.maximum(square / n - (total / n) ** 2, 0), count


def _gram_counts(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, lang in columns_of(batches, "text", "lang"):
            languages = np.array(lang.to_pylist(), object)
            texts = text.to_pylist()
            for name in dict.fromkeys(languages):
                for lo in range(0, len(texts), 256):
                    codes, at = stream([t for t, x in zip(texts[lo : lo + 256], languages[lo : lo + 256]) if x == name], order - 1)
                    n = len(codes) - order + 1
                    if n <= 0:
                        continue
                    packed = np.zeros((n, 2), np.int64)
                    for k in range(order):
                        packed[:, k // 3] = packed[:, k // 3] << 21 | codes[k : k + n]
                    inside = np.ones(n, bool)
                    for start in at[1:-1]:  # grams that begin in one text and end in the next
                        inside[max(0, start - order + 1) : start] = False
                    grams, counts = np.unique(packed[inside], axis=0, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": [name] * len(grams), "a": grams[:, 0], "b": grams[:, 1], "n": counts})

    return count


def kneser_ney(grams: dict[str, tuple[np.ndarray, np.ndarray]], order: int) -> LanguageModel:
    """The model of n-gram counts: per language code points [n-gram, order] and counts."""
    languages = sorted(grams)
    # per order and language: distinct grams with counts; below the highest order, the number of distinct characters before them
    levels: list[dict[str, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(order)]
    for name in languages:
        levels[-1][name] = grams[name]
        for k in range(order - 1, 0, -1):
            codes, counts = np.unique(levels[k][name][0][:, 1:], axis=0, return_counts=True)
            levels[k - 1][name] = (codes, counts)
    alphabet = len(np.unique(np.concatenate([levels[0][x][0] for x in languages]))) + 1
    model = LanguageModel(languages, order, [], [], [], [], np.zeros(len(languages), np.float32))
    row_hash = lambda codes: _hashes_of_rows(codes)
    for k in range(1, order + 1):
        level = levels[k - 1]
        every = np.unique(np.concatenate([level[x][0] for x in languages]), axis=0)
        h = row_hash(every)
        by = np.argsort(h)
        every, keys = every[by], h[by]
        prob = np.zeros((len(keys), len(languages)))
        if k == 1:
            lower = np.full_like(prob, 1 / alphabet)
        else:
            at, hit = _find(model.keys[k - 2], row_hash(every[:, 1:]))
            assert hit.all()
            lower = np.exp(model.logp[k - 2][at].astype(np.float64))
            context_hash = row_hash(every[:, :-1])
            context_keys = np.unique(context_hash)
            group = np.searchsorted(context_keys, context_hash)
            weights = np.ones((len(context_keys), len(languages)))
        for j, name in enumerate(languages):
            codes, counts = level[name]
            c = np.zeros(len(keys))
            c[np.searchsorted(keys, row_hash(codes))] = counts
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            d = float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.95))
            if k == 1:
                prob[:, j] = np.maximum(c - d, 0) / c.sum() + d * (c > 0).sum() / c.sum() * lower[:, j]
                model.unknown[j] = np.log(d * (c > 0).sum() / c.sum() / alphabet)
            else:
                total, kinds = np.bincount(group, c, len(context_keys)), np.bincount(group, c > 0, len(context_keys))
                seen = total > 0
                weights[seen, j] = d * kinds[seen] / total[seen]
                prob[:, j] = np.where(seen[group], np.maximum(c - d, 0) / np.maximum(total, 1)[group], 0) + weights[group, j] * lower[:, j]
        model.keys.append(keys)
        model.logp.append(np.log(prob).astype(np.float32))
        if k > 1:
            model.context_keys.append(context_keys)
            model.backoff.append(np.log(weights).astype(np.float32))
    return model


def _hashes_of_rows(codes: np.ndarray) -> np.ndarray:
    h = np.full(len(codes), np.uint64(codes.shape[1]), np.uint64)
    for k in range(codes.shape[1]):
        h = (h + codes[:, k].astype(np.uint64)) * _MULT
        h ^= h >> np.uint64(29)
    return mix(h)


def labelled_sample(docs: DataFrame, config: LanguageConfig) -> DataFrame:
    """At most ``docs_per_language`` rows of each given language, chosen by a seeded hash over all rows: (text, lang, held)."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return rows.select("text", "lang", F.lit(False).alias("held")).limit(0)
    luck = F.xxhash64(F.lit(config.seed), "doc_id", "text")
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, 1.5 * config.docs_per_language / n + 64 / n))])
    likely = rows.select("text", "lang", luck.alias("luck")).where((F.pmod("luck", F.lit(1 << 30)) / float(1 << 30)) < share[F.col("lang")])
    first = Window.partitionBy("lang").orderBy("luck", "text")
    ranked = likely.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= config.docs_per_language)
    held = F.pmod(F.xxhash64(F.lit(config.seed + 1), "luck"), F.lit(1000)) < int(1000 * config.held_out)
    return ranked.select("text", "lang", held.alias("held"))


def train_language_model(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> LanguageModel | None:
    """The calibrated model of the labelled rows, or None if there is no labelled text with letters."""
    if not 2 <= config.order <= 6:
        raise ValueError("order must be 2 to 6")
    sample = labelled_sample(tidy(docs, ["doc_id", "text", "lang"]), config).persist()
    try:
        counts = sample.where(~F.col("held")).mapInArrow(_gram_counts(config.order), "lang string, a long, b long, n long")
        counted = counts.groupBy("lang", "a", "b").agg(F.sum("n").alias("n")).toArrow()
        languages, grams = np.array(counted["lang"].to_pylist(), object), {}
        a, b, n = (counted[c].to_numpy() for c in "abn")
        for name in dict.fromkeys(languages):
            mine = languages == name
            parts = [(b if k >= 3 else a)[mine] >> 21 * ((min(3, config.order - 3 * (k // 3)) - 1) - k % 3) & 0x1FFFFF for k in range(config.order)]
            grams[name] = (np.stack(parts, 1).astype(np.uint32), n[mine])
        if not grams:
            return None
        model = kneser_ney(grams, config.order)
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            index = {x: i for i, x in enumerate(m.languages)}
            for text, lang in columns_of(batches, "text", "lang"):
                h, v, count = cross_entropies(m, text.to_pylist())
                j = np.array([index.get(x, -1) for x in lang.to_pylist()])
                ok = (j >= 0) & (count > 0)
                r = np.flatnonzero(ok)
                yield pa.RecordBatch.from_pydict({"j": j[r], "h": h[r, j[r]], "v": v[r, j[r]], "n": count[r]})

        held = sample.where("held").mapInArrow(own, "j long, h double, v double, n long").toArrow()
        if held.num_rows < 20 * len(model.languages):  # too few to keep any back
            held = sample.mapInArrow(own, "j long, h double, v double, n long").toArrow()
    finally:
        sample.unpersist()
    j, h, v, n = (held[c].to_numpy() for c in ("j", "h", "v", "n"))
    size = len(model.languages)
    model.mean, model.spread, model.slack = np.zeros(size), np.ones((size, 2)), config.slack
    scores = []
    for k in range(size):
        mine = j == k
        if not mine.any():
            continue
        hk, vk, nk = h[mine], v[mine], n[mine]
        model.mean[k] = np.average(hk, weights=np.minimum(nk, 2000))
        one = float(np.average(vk, weights=nk))
        between = max(float(np.mean((hk - model.mean[k]) ** 2 - one / nk)), 1e-4)
        model.spread[k] = between, one
        scores.append((hk - model.mean[k]) / np.sqrt(between + one / nk))
    model.threshold = float(np.quantile(np.concatenate(scores), 1 - config.reject, method="higher")) if scores else np.inf
    return model


def identify_languages(docs: DataFrame, config: LanguageConfig = LanguageConfig(), model: LanguageModel | None = None) -> DataFrame:
    """``docs`` with columns predicted_lang, cross_entropy (nats per character), margin (to the second language), n_scored and accepted.

    Null and empty texts, and texts without a letter, get no language (null), null figures and accepted = false; ties go to
    the language first in the alphabet; if no row is labelled, nothing is accepted. Repeated rows get equal results. Texts of
    any length are scored whole. An existing column of one of these names is replaced; other columns pass through. A null
    doc_id or source changes nothing; rows with a null lang are scored but not trained on.
    """
    docs = bounded_batches(tidy(docs, ["doc_id", "text", "lang"]))
    model = model or train_language_model(docs, config)
    new = {"predicted_lang": "string", "cross_entropy": "double", "margin": "double", "n_scored": "long", "accepted": "boolean"}
    kept = [c for c in docs.columns if c.lower() not in new]
    docs = docs.select(*kept)
    if model is None:
        return docs.withColumns({c: F.lit(False) if t == "boolean" else F.lit(None).cast(t) for c, t in new.items()})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in sliced(batches):
            h, _, n = cross_entropies(m, b.column(b.schema.get_field_index("text")).to_pylist())
            best = h.argmin(1)
            low = h[np.arange(len(h)), best]
            second = np.partition(h, 1, axis=1)[:, 1] if h.shape[1] > 1 else np.full(len(h), np.inf)
            some = n > 0
            columns = [
                pa.array(np.array(m.languages, object)[best], pa.string(), mask=~some),
                pa.array(low, mask=~some),
                pa.array(np.where(np.isfinite(second), second - low, 0), mask=~some),
                pa.array(n),
                pa.array(some & (low <= m.limit(best, n))),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, *new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{c} {t}" for c, t in new.items())])
    return docs.mapInArrow(score, schema)


def keep_identified(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """The rows of ``docs`` whose language is identified; lang becomes the predicted one. Rejected rows go (see identify_languages)."""
    docs = bounded_batches(tidy(docs, ["doc_id", "text", "lang"]))
    scored = identify_languages(docs, config)
    return scored.where("accepted").select(*[F.col("predicted_lang").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])
