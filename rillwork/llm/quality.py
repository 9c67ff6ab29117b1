"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, where the pairwise part is computed in linear time as
1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2). The model is fitted by AdaGrad on a bounded sample of labelled rows, the only
thing here that is bounded; scoring is one pass over all documents, whole texts, with no shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches, columns_of, tidy
from .text import PIECE, code_points, word_hashes

_KINDS = ("Lu", "Ll", "N", "Z", "P", "S")  #: upper, other letters, numbers, blanks, punctuation, symbols; line ends and the rest come last
STRUCTURE = ["log_chars", "upper", "letters", "numbers", "blanks", "punctuation", "symbols", "line_ends", "other", "word_length", "distinct_words", "most_common_word", "words_a_line"]


@dataclass(frozen=True)
class QualityConfig:
    """max_labelled: bound of the training sample, chosen by a seeded hash. bits: log2 of the word features; meta_bits: of those of sources,
    and of languages. rank: length of the vectors. keep_at: least probability of good quality that is kept."""

    max_labelled: int = 8000
    bits: int = 17
    meta_bits: int = 14
    rank: int = 8
    epochs: int = 8
    batch: int = 64
    rate: float = 0.05
    penalty: float = 1e-5
    keep_at: float = 0.5
    seed: int = 23


@dataclass
class FactorizationMachine:
    bias: float
    weight: np.ndarray
    vector: np.ndarray  #: [feature, rank]
    mean: np.ndarray  #: of the structure statistics
    scale: np.ndarray

    def scores(self, ids: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of rows of sparse features, each with distinct ids: linear in their number."""
        v = self.vector[ids] * values[:, None]
        first = segment_sums(self.weight[ids] * values, offsets)
        both, own = segment_sums(v, offsets), segment_sums(v * v, offsets)
        return self.bias + first + 0.5 * (both**2 - own).sum(1)


def segment_sums(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


@cache
def _kinds() -> np.ndarray:
    def kind(c: int) -> int:
        if c in (10, 13):
            return 6
        if c == 9:
            return 3
        cat = unicodedata.category(chr(c))
        return 0 if cat == "Lu" else 1 if cat[0] == "L" else next((k for k, x in enumerate(_KINDS) if k > 1 and cat[0] == x), 7)

    return np.fromiter((kind(c) for c in range(0x110000)), np.uint8, 0x110000)


def structure(texts: list[str | None], words: np.ndarray, offsets: np.ndarray, most: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """[text, statistic] in the order of STRUCTURE."""
    out = np.zeros((len(texts), len(STRUCTURE)))
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= PIECE):
            size += len(texts[end] or "")
            end += 1
        group = [t or "" for t in texts[at:end]]
        sizes = np.array([len(t) for t in group])
        doc = np.repeat(np.arange(len(group)), sizes)
        counts = np.bincount(doc * 8 + _kinds()[code_points("".join(group))], minlength=8 * len(group)).reshape(-1, 8)
        n = np.maximum(sizes, 1)
        out[at:end, 0] = np.log1p(sizes)
        out[at:end, 1:9] = counts / n[:, None]
        lines, number = counts[:, 6] + 1, np.diff(offsets[at : end + 1])
        out[at:end, 9] = np.log1p(counts[:, :3].sum(1) / np.maximum(number, 1))
        out[at:end, 10] = distinct[at:end] / np.maximum(number, 1)
        out[at:end, 11] = most[at:end] / np.maximum(number, 1)
        out[at:end, 12] = np.log1p(number / lines)
        at = end
    return out


def _meta_id(x: str | None, bits: int) -> int:
    """0 for null, else 1 ... by a hash of the whole value."""
    return 0 if x is None else xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) % ((1 << bits) - 1) + 1


def features(texts: list[str | None], sources: list[str | None], langs: list[str | None], bits: int, meta_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, values, offsets) of the word and metadata features, and the structure statistics [text, statistic].

    Words share 2^bits ids and are weighted by their counts to length 1 a text; 2^meta_bits ids follow for sources, and as many for
    languages; then one for each structure statistic.
    """
    words, at = word_hashes(texts)
    d = 1 << bits
    ids, values, sizes = [], [], []
    most, distinct = np.zeros(len(texts)), np.zeros(len(texts))
    meta = {}
    for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
        w, n = np.unique((words[a:b] >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
        if len(w):
            most[i], distinct[i] = n.max(), len(w)
        x = n / np.sqrt((n.astype(float) ** 2).sum()) if len(n) else n.astype(float)
        for part, (name, value) in enumerate((("source", sources[i]), ("lang", langs[i]))):
            if (name, value) not in meta:
                meta[name, value] = d + (part << meta_bits) + _meta_id(value, meta_bits)
        w = np.concatenate([w, [meta["source", sources[i]], meta["lang", langs[i]]]])
        ids.append(w)
        values.append(np.concatenate([x, [0.5, 0.5]]))
        sizes.append(len(w))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return np.concatenate(ids or [np.zeros(0, np.int64)]), np.concatenate(values or [np.zeros(0)]), offsets, structure(texts, words, at, most, distinct)


def with_structure(ids: np.ndarray, values: np.ndarray, offsets: np.ndarray, dense: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sparse rows with the (scaled) structure statistics put at their ends."""
    n, k = dense.shape
    sizes = np.diff(offsets)
    new = np.concatenate([[0], np.cumsum(sizes + k)])
    place = np.arange(len(ids)) + np.repeat(np.arange(n) * k, sizes)
    out_ids, out_values = np.empty(len(ids) + n * k, np.int64), np.empty(len(ids) + n * k)
    out_ids[place], out_values[place] = ids, values
    tail = (new[1:, None] - k + np.arange(k)).ravel()
    out_ids[tail], out_values[tail] = np.tile(base + np.arange(k), n), dense.ravel()
    return out_ids, out_values, new


def structure_base(config: QualityConfig) -> int:
    """The first id of the structure statistics."""
    return (1 << config.bits) + (2 << config.meta_bits)


def scaled(dense: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """In standard deviations, far ones on a scale of logarithms: outliers don't rule, and no two values become one."""
    return np.arcsinh((dense - mean) / scale) * 0.3


def fit(ids: np.ndarray, values: np.ndarray, offsets: np.ndarray, dense: np.ndarray, labels: np.ndarray, config: QualityConfig) -> FactorizationMachine:
    """AdaGrad on the logistic loss; classes weigh alike. Same input, same model."""
    rng = np.random.default_rng(config.seed)
    base = structure_base(config)
    mean, scale = dense.mean(0), dense.std(0) + 1e-6
    ids, values, offsets = with_structure(ids, values, offsets, scaled(dense, mean, scale), base)
    n = base + dense.shape[1]
    model = FactorizationMachine(0.0, np.zeros(n), rng.normal(0, 0.02, (n, config.rank)), mean, scale)
    gw, gv, gb = np.full(n, 1e-6), np.full((n, config.rank), 1e-6), 1e-6
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(config.epochs):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), config.batch):
            rows = order[lo : lo + config.batch]
            sizes = offsets[rows + 1] - offsets[rows]
            at = np.repeat(offsets[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            i, x, row = ids[at], values[at], np.repeat(np.arange(len(rows)), sizes)
            seg = np.concatenate([[0], np.cumsum(sizes)])
            s = model.scores(i, x, seg)
            slope = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - labels[rows]) * balance[rows]
            v = model.vector[i]
            sums = segment_sums(v * x[:, None], seg)
            dv = slope[row, None] * x[:, None] * (sums[row] - v * x[:, None])
            touched, where = np.unique(i, return_inverse=True)
            w_grad = np.bincount(where, slope[row] * x) + config.penalty * model.weight[touched]
            v_grad = np.stack([np.bincount(where, dv[:, f]) for f in range(config.rank)], 1) + config.penalty * model.vector[touched]
            gb += slope.sum() ** 2
            model.bias -= config.rate * slope.sum() / np.sqrt(gb)
            gw[touched] += w_grad**2
            model.weight[touched] -= config.rate * w_grad / np.sqrt(gw[touched])
            gv[touched] += v_grad**2
            model.vector[touched] -= config.rate * v_grad / np.sqrt(gv[touched])
    return model


def predict(model: FactorizationMachine, texts: list[str | None], sources: list[str | None], langs: list[str | None], config: QualityConfig) -> np.ndarray:
    """Probability of good quality."""
    ids, values, offsets, dense = features(texts, sources, langs, config.bits, config.meta_bits)
    s = model.scores(*with_structure(ids, values, offsets, scaled(dense, model.mean, model.scale), structure_base(config)))
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def train_quality_model(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> FactorizationMachine | None:
    """From at most ``max_labelled`` rows of docs with a label 0 or 1 in labels (doc_id, quality); None if there is none. A doc_id with
    several labels counts by the least."""
    marks = tidy(labels, ["doc_id", "quality"]).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    luck = F.xxhash64(F.lit(config.seed), "doc_id")
    chosen = marks.orderBy(luck, "doc_id").limit(config.max_labelled)  # a top-n: no task holds more than the bound
    docs = bounded_batches(tidy(docs, ["doc_id", "text", "source", "lang"])).select("doc_id", "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    rows = docs.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    k = len(STRUCTURE)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, quality, text, source, lang in columns_of(batches, "doc_id", "quality", "text", "source", "lang"):
            ids, values, offsets, dense = features(text.to_pylist(), source.to_pylist(), lang.to_pylist(), config.bits, config.meta_bits)
            cut = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [doc_id.cast(pa.string()), quality, pa.ListArray.from_arrays(cut, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(values, pa.float32())), pa.ListArray.from_arrays(pa.array(np.arange(len(dense) + 1) * k, pa.int32()), pa.array(dense.ravel()))],
                names=["doc_id", "quality", "ids", "x", "dense"],
            )

    got = rows.mapInArrow(extract, "doc_id string, quality int, ids array<int>, x array<float>, dense array<double>").toArrow().combine_chunks()
    if not got.num_rows:
        return None
    # the order of rows must not depend on the partitions
    got = got.append_column("size", pa.array([len(x) for x in got["ids"]])).sort_by([("doc_id", "ascending"), ("quality", "ascending"), ("size", "ascending")]).combine_chunks()
    sizes = got["size"].to_numpy()
    ids = np.concatenate([x.values.to_numpy() for x in got["ids"]]).astype(np.int64)
    values = np.concatenate([x.values.to_numpy() for x in got["x"]]).astype(np.float64)
    dense = np.stack([x.values.to_numpy() for x in got["dense"]])
    return fit(ids, values, np.concatenate([[0], np.cumsum(sizes)]), dense, got["quality"].to_numpy().astype(float), config)


def classify_quality(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig(), model: FactorizationMachine | None = None) -> DataFrame:
    """(doc_id, quality_score, keep) of every row: the probability of good quality, and whether it is keep_at at least.

    docs needs doc_id, text, source and lang, labels doc_id and quality; other columns aren't read. A null source or language is a
    value of its own. A null or empty text has score 0 and isn't kept. Null labels and ids, and labels without a document, aren't
    trained on; without any label every score is null and every document with text is kept. A null doc_id is carried; repeated
    rows get equal scores; an empty table has no row. Texts and metadata of any length are read whole; a score of exactly keep_at is kept.
    """
    docs = bounded_batches(tidy(docs, ["doc_id", "text", "source", "lang"]))
    model = model or train_quality_model(docs, labels, config)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("double").alias("quality_score"), (F.length("text") > 0).alias("keep")).fillna({"keep": False})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text, source, lang in columns_of(batches, "doc_id", "text", "source", "lang"):
            texts, sources, langs = text.to_pylist(), source.to_pylist(), lang.to_pylist()
            p = np.concatenate([predict(shared.value, texts[a : a + 512], sources[a : a + 512], langs[a : a + 512], config) for a in range(0, len(texts), 512)])
            p = np.where([bool(t) for t in texts], p, 0.0)
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(p), pa.array(p >= config.keep_at)], names=["doc_id", "quality_score", "keep"])

    return docs.mapInArrow(score, "doc_id long, quality_score double, keep boolean")
