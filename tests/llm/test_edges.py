"""Every operator and stage on nulls, empty and very long texts, ties and repeated rows, empty tables, and clashing extra columns."""

import hashlib
import itertools
import math
import re

import pytest
from pyspark.sql import functions as F

from rillwork.llm import exactdedup, hmm, languageid, linededup, matroska, mixing, neardup, packing, quality, sharding

LONG = "lorem ipsum dolor sit amet " * 60_000  # 1.6 M characters
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 57),
    (2, "The quick brown fox jumps over the lazy dog and runs away", "en", "b", 57),
    (2, "The quick brown fox jumps over the lazy dog and runs away", "en", "b", 57),
    (3, "", "en", "a", 0),
    (4, None, None, None, None),
    (None, "Nobody knows my number but the text is here all the same", "en", "a", 56),
    (None, None, None, None, None),
    (5, "Der schnelle braune Fuchs springt ueber den faulen Hund", "de", None, 55),
    (6, LONG, "la", "b", len(LONG)),
    (7, "***", None, "a", 3),
    (8, "\n\n", "en", "a", 2),
    (9, "x" * 300_000, "en", "c", 300_000),
    (10, "a퟿\U0001f600 İstanbul", "tr", "a", 12),
]
CLASH = ["TEXT", "digest", "__digest", "shard", "shard_pos", "n_lines", "predicted_lang", "accepted", "luck", "key", "keep", "media", "part", "Doc_ID"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 0), (7, 0, None), (None, 1, 0), (99, None, 0)], "doc_id long, quality int, toxic int")


def clashing(df):
    """With extra columns that are named like inputs in other case, like outputs and like internal columns."""
    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASH])


def rows(df):
    return sorted(map(repr, df.collect()))


OPERATORS = {
    "packing": lambda d, x: packing.pack_documents(d, packing.PackConfig(capacity=64)),
    "line_dedup": lambda d, x: linededup.drop_frequent_lines(d, linededup.LineConfig(max_documents=1)),
    "language": lambda d, x: languageid.identify_languages(d),
    "hmm": lambda d, x: hmm.score_documents(d, hmm.HmmConfig(vocabulary=50, iterations=1, states=2)),
    "mixing": lambda d, x: mixing.mix_sources(d, mixing.MixConfig(block_tokens=8, budget=0.7)),
    "exact": lambda d, x: exactdedup.drop_exact_copies(d, exactdedup.earlier_half()),
    "quality": lambda d, x: quality.classify_quality(d, x, quality.QualityConfig(epochs=1)),
    "sharding": lambda d, x: sharding.shuffle_to_shards(d, sharding.ShardConfig(shards=3)),
    "near": lambda d, x: neardup.similar_pairs(d),
    "matroska": lambda d, x: matroska.packet_table(matroska.with_text_movies(d), digest=True),
    "stage_language": lambda d, x: languageid.keep_identified(d),
    "stage_near": lambda d, x: neardup.keep_one_of_similar(d),
}


def mixed_by_hand(rows, config):
    """Ranked quotients, then the seeded order of each source; rows of equal luck stand or fall together."""
    groups = {}
    for r in rows:
        key = "n" if r[3] is None else "s" + r[3]
        name = r[0] if r[0] is not None else r[1] if r[1] is not None else ""
        groups.setdefault(key, []).append((hashlib.md5(f"{config.seed}:{name}".encode()).hexdigest(), len(re.findall(r"[^ \t\n\r]+", r[1] or "")), r))
    blocks = {k: max(1, math.ceil(sum(n for _, n, _ in g) / config.block_tokens)) for k, g in groups.items()}
    quotients = sorted((-math.sqrt(max(1, sum(n for _, n, _ in groups[k]))) / (2 * i + 1), k) for k, b in blocks.items() for i in range(b))
    granted = [k for _, k in quotients[: int(config.budget * sum(blocks.values()))]]
    for k, g in groups.items():
        for luck, _, r in g:
            if k in granted and sum(n for other, n, _ in g if other <= luck) <= granted.count(k) * config.block_tokens:
                yield r


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(docs, labels, name):
    """All of the result, and where each row is one of the input, which ones."""
    got = OPERATORS[name](docs, labels).collect()
    some = [r for r in ROWS if r[1] is not None]
    if name in ("line_dedup", "sharding"):
        texts = sorted(repr((r["doc_id"], r["text"])) for r in got)
        copies = {1, 2}  # their only line is in two documents
        assert texts == sorted(repr((r[0], "" if name == "line_dedup" and r[0] in copies else r[1])) for r in ROWS)
        if name == "sharding":
            assert sorted((r["shard"], r["shard_pos"]) for r in got) == [(s, i) for s, n in enumerate((5, 4, 4)) for i in range(n)]
    elif name in ("language", "hmm", "quality"):
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
        same = {"language": "cross_entropy", "hmm": "log_likelihood", "quality": "quality_score"}[name]
        assert len({r[same] for r in got if r["doc_id"] in ((1, 2) if name != "quality" else (2,))}) == 1  # repeated rows, equal results
        if name == "language":
            assert {r["doc_id"]: r["n_scored"] for r in got if r["doc_id"] in (6, 9)}[6] > 1_000_000
    elif name == "mixing":
        want = sorted(repr(tuple(r)) for r in mixed_by_hand(ROWS, mixing.MixConfig(block_tokens=8, budget=0.7)))
        assert sorted(repr(tuple(r)) for r in got) == want and 0 < len(want) < len(ROWS)
    elif name == "exact":
        assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, [*ROWS[1:2], *ROWS[3:]]))
    elif name == "near":
        assert [tuple(r) for r in got] == [(1, 2, 1.0)]
    elif name == "stage_near":
        assert sorted(repr(tuple(r)) for r in got) == sorted(repr(r) for r in ROWS if r[0] != 2)
    elif name == "stage_language":
        assert {r["doc_id"] for r in got} >= {1, 2, 5} and not {r["doc_id"] for r in got} & {3, 4, 7, 8} and {r["text"] for r in got} <= {r[1] for r in some}
    elif name == "matroska":
        sizes = sorted((str(r["doc_id"]), r["size"]) for r in got if r["track"] == 1)
        assert sizes == sorted((str(r[0]), len(x.encode())) for r in some for x in r[1].split("\n")) and not any(r["error"] for r in got)
        assert len(got) == 2 * len(sizes)
    else:
        tokens = {r["doc_id"]: r["tokens"] for r in packing.count_tokens(docs).collect()}
        for i in {r[0] for r in ROWS if r[0] not in (2, None)}:
            mine = sorted((r["start_token"], r["end_token"]) for r in got if r["doc_id"] == i)
            assert mine[0][0] == 0 and mine[-1][1] == tokens[i] and all(a[1] == b[0] for a, b in itertools.pairwise(mine))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, labels, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(docs, labels, name):
    plain, extra = OPERATORS[name](docs, labels), OPERATORS[name](clashing(docs), labels)
    shared = [c for c in plain.columns if c not in CLASH or name in ("packing", "hmm", "quality", "near", "matroska")]
    if name == "sharding":  # where a row goes depends on nothing in it, but all of them stay
        assert rows(extra.select("doc_id", "text")) == rows(plain.select("doc_id", "text"))
    else:
        assert rows(extra.select(shared)) == rows(plain.select(shared))


def by_id(df, column):
    return {r["doc_id"]: r[column] for r in df.collect() if r["doc_id"] is not None}


def test_results_on_awkward_rows(docs, labels):
    packed = OPERATORS["packing"](docs, labels).collect()
    assert [r["bin"] for r in packed if r["doc_id"] in (3, 4)] == [None, None]
    long = [r for r in packed if r["doc_id"] == 6]
    assert len(long) > 100 and max(r["end_token"] for r in long) == packing.count_tokens(docs.where("doc_id = 6"), packing.PackConfig()).first()["tokens"]
    lines = {r["doc_id"]: r for r in OPERATORS["line_dedup"](docs, labels).collect()}
    assert lines[1]["text"] == "" and lines[1]["n_dropped"] == 1
    assert lines[3]["text"] == "" and lines[3]["n_dropped"] == 0 and lines[4]["text"] is None and lines[8]["text"] == "\n\n" and lines[6]["text"] == LONG
    language = OPERATORS["language"](docs, labels)
    accepted = by_id(language, "accepted")
    assert not accepted[3] and not accepted[4] and not accepted[7] and by_id(language, "predicted_lang")[3] is None and by_id(language, "predicted_lang")[1] == "en"
    scores = by_id(OPERATORS["hmm"](docs, labels), "n_words")
    assert scores[3] == scores[4] == scores[7] == 0 and scores[6] == 300_000 and scores[9] == 1
    exact = OPERATORS["exact"](docs, labels).collect()
    assert sorted(r["doc_id"] for r in exact if r["doc_id"] in (1, 2)) == [2]
    assert sum(r["text"] is None for r in exact) == 2 and len(exact) == len(ROWS) - 2
    judged = by_id(OPERATORS["quality"](docs, labels), "keep")
    assert not judged[3] and not judged[4]
    pairs = [(r["doc_a"], r["doc_b"], r["jaccard"]) for r in OPERATORS["near"](docs, labels).collect()]
    assert pairs == [(1, 2, 1.0)]
    left = OPERATORS["stage_near"](docs, labels).collect()
    assert len(left) == len(ROWS) - 2 and 2 not in {r["doc_id"] for r in left}  # both rows of the dropped id go
    packets = OPERATORS["matroska"](docs, labels).collect()
    assert sum(r["doc_id"] == 8 and r["track"] == 1 for r in packets) == 3 and not [r for r in packets if r["doc_id"] == 4]


def test_no_labels(docs, labels):
    got = quality.classify_quality(docs, labels.limit(0)).collect()
    assert all(r["quality_score"] is None for r in got) and sum(r["keep"] for r in got) == len(ROWS) - 3
    assert languageid.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).where("accepted").count() == 0


def test_missing_columns(docs, labels):
    for name in ("packing", "line_dedup", "language", "hmm", "mixing", "exact", "quality", "near"):
        with pytest.raises(ValueError):
            OPERATORS[name](docs.drop("text"), labels)


def test_languages_that_fit_alike(spark):
    """Equal cross-entropy: the language first in the alphabet."""
    texts = [f"some words that say {w} and no more than that" for w in ("one", "two", "three", "four", "five", "six")]
    d = spark.createDataFrame([(2 * i + k, t, lang) for i, t in enumerate(texts * 5) for k, lang in enumerate(("zz", "aa"))], "doc_id long, text string, lang string")
    config = languageid.LanguageConfig(held_out=0.0)
    got = {r["predicted_lang"]: r["margin"] for r in languageid.identify_languages(d, config).select("predicted_lang", "margin").distinct().collect()}
    assert got == {"aa": 0.0}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from rillwork.llm.frames import shared_folder

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    def session(master, **conf):
        conf = Conf({"spark.sql.warehouse.dir": "/w", **conf})
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf), conf=conf)

    assert shared_folder(session("local[4]")) == "/w/_checkpoints" and shared_folder(session("yarn", **{"spark.checkpoint.dir": "hdfs:/c"})) == "hdfs:/c"
    for master in ("yarn", "spark://m:7077", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError):
            shared_folder(session(master))
