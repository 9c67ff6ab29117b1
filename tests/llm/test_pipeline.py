"""The pipeline's stages against brute force, each on what its predecessor kept."""

import itertools

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from rillwork.llm.frames import DOCUMENT_COLUMNS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").distinct().collect())


def test_order_and_columns(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "pack"]
    for before, after in itertools.pairwise(kept):
        assert set(ids(after)) <= set(ids(before))
    assert all(df.columns == DOCUMENT_COLUMNS for df in kept[:-1])


def test_language_keeps_clean_documents(kept):
    assert kept[1].count() >= 0.98 * kept[0].count()
    both = kept[1].join(kept[0].select("doc_id", F.col("lang").alias("given")), "doc_id")
    assert both.where("lang <> given").count() <= 3


def test_exact(kept):
    best = {}
    for r in kept[1].collect():
        best.setdefault(r["text"], []).append((r["doc_id"] % 2, r["doc_id"]))
    assert ids(kept[2]) == sorted(min(x)[1] for x in best.values())


def test_near(kept):
    from tests.llm.test_operators import brute_pairs

    texts = {r["doc_id"]: r["text"] for r in kept[2].collect()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute_pairs(texts, 3, 0.55):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert ids(kept[3]) == sorted(i for i in texts if root[i] == i)


def test_mix(kept):
    """By the definition: ranked quotients, seeded order within shards."""
    import hashlib
    import math
    import re

    groups = {}
    for r in kept[3].collect():
        luck = hashlib.md5(f"11:{r['doc_id']}".encode()).hexdigest()
        groups.setdefault(r["source"], []).append((luck, r["doc_id"], len(re.findall(r"[^ \t\n\r]+", r["text"]))))
    assert sum(n for g in groups.values() for _, _, n in g) < 1 << 24  # one shard a source
    blocks = {s: max(1, math.ceil(sum(n for _, _, n in g) / 8192)) for s, g in groups.items()}
    quotients = sorted((-math.sqrt(sum(n for _, _, n in groups[s])) / (2 * k + 1), s) for s, b in blocks.items() for k in range(b))
    granted = quotients[: int(0.9 * sum(blocks.values()))]
    want = []
    for s, g in groups.items():
        total, quota = 0, sum(x == s for _, x in granted)
        for _, i, n in sorted(g):
            total += n
            if quota and total <= quota * 8192:
                want.append(i)
    assert ids(kept[4]) == sorted(want)


def test_pack_covers_what_is_left(kept):
    assert ids(kept[5]) == ids(kept[4])
    load = kept[5].groupBy("shard", "bin").agg(F.sum(F.col("end_token") - F.col("start_token")).alias("n"))
    assert load.agg(F.max("n")).first()[0] <= 2048


def test_run(spark, kept):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "3000")
    got = corpus_pipeline.run(spark, SF)
    assert spark.conf.get(name) == "3000"  # as it was
    assert sorted(map(repr, got.collect())) == sorted(map(repr, kept[-1].collect()))


@pytest.mark.parametrize("k", range(5))
def test_stages_on_awkward_rows(spark, k):
    from tests.llm.test_edges import ROWS, SCHEMA, clashing

    docs = spark.createDataFrame(ROWS, SCHEMA)
    stage = corpus_pipeline.STAGES[k][1]
    plain = sorted(map(repr, stage(spark, docs, SF).collect()))
    assert sorted(map(repr, stage(spark, clashing(docs), SF).collect())) == plain
    assert stage(spark, docs.limit(0), SF).count() == 0
