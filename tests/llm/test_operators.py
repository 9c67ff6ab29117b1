"""The operators against brute force, round trips and held-out accuracy."""

import itertools
import math
import random
import struct
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillwork.llm import exactdedup, hmm, languageid, linededup, matroska, mixing, neardup, packing, quality, registry, sharding, text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# 1


def test_packing_is_valid_and_no_worse_than_best_fit():
    rng = np.random.default_rng(1)
    for n, capacity in ((1, 10), (300, 100), (500, 64), (400, 1000)):
        sizes = rng.integers(1, capacity + 1, n)
        before, after = packing.best_fit(sizes, capacity), packing.pack_sizes(sizes, capacity)
        assert sorted(itertools.chain(*after)) == list(range(n))
        fills = np.array([sizes[b].sum() for b in after])
        assert fills.max() <= capacity and len(after) <= len(before)
        assert (fills**2).sum() >= sum(int(sizes[b].sum()) ** 2 for b in before)


def test_search_empties_a_bin_that_best_fit_leaves():
    sizes = np.array([6, 4, 4, 3, 3, 5, 5])  # 30 in bins of 10
    start = [[0, 3], [1, 2], [4, 5], [6]]
    search = packing.LocalSearch(sizes, start, 10)
    done = search.run()
    assert len(done) == 3 and sorted(itertools.chain(*done)) == list(range(7)) and all(sizes[b].sum() == 10 for b in done)


def test_packing_holds_every_token(spark, docs):
    config = packing.PackConfig(capacity=256, shard_rows=64)
    got = packing.pack_documents(docs, config).toPandas()
    want = {r["doc_id"]: r["tokens"] for r in packing.count_tokens(docs.withColumn("x", F.lit(0)), config).collect()}
    sizes = got.assign(n=got.end_token - got.start_token)
    assert sizes.groupby("doc_id").n.sum().to_dict() == want
    bins = sizes.groupby(["shard", "bin"]).n.sum()
    assert bins.max() <= 256
    for _, part in sizes.groupby(["shard", "bin"]):
        part = part.sort_values("bin_offset")
        assert (part.bin_offset == part.n.cumsum() - part.n).all()


def test_long_texts_are_counted_like_short_ones():
    config = packing.PackConfig()
    words = random.Random(3).choices(["alpha", "beta,", "Gamma", "12", "\n", "x-y"], k=40_000)
    whole = packing._encoding(config.vocabulary, config.pattern).encode_ordinary(" ".join(words))
    assert packing.token_count(" ".join(words), config.vocabulary, config.pattern) == len(whole)


@pytest.mark.parametrize("text", ["abcdefgh1" * 20_000, "x" * 70_000, "a-b_c.d'e" * 10_000, "they'll've" * 9_000, "\u6f22\u5b57" * 40_000, "  \n x" * 20_000, "12" * 50_000 + "y"])
def test_texts_without_blanks_are_counted_like_short_ones(text):
    config = packing.PackConfig()
    assert packing.token_count(text, config.vocabulary, config.pattern) == len(packing._encoding(config.vocabulary, config.pattern).encode_ordinary(text))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1 '\n.,\u00e9s", max_size=60))
def test_stretches_don_t_change_counts(text):
    config = packing.PackConfig()
    whole = len(packing._encoding(config.vocabulary, config.pattern).encode_ordinary(text))
    before, packing.STRETCH = packing.STRETCH, 5
    try:
        assert packing.token_count(text, config.vocabulary, config.pattern) == whole
    finally:
        packing.STRETCH = before


def fewest_bins(sizes, capacity):
    """Brute force: each item into each bin that has room, or a new one."""
    best = len(sizes)

    def put(i, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if i == len(sizes):
            best = len(fills)
            return
        for k in range(len(fills)):
            if fills[k] + sizes[i] <= capacity:
                put(i + 1, fills[:k] + [fills[k] + sizes[i]] + fills[k + 1 :])
        put(i + 1, [*fills, sizes[i]])

    put(0, [])
    return best


def test_packing_against_brute_force():
    """Few items: hardly ever a bin more than the fewest, and at the end no exchange is left or no bin is over the bound."""
    rng, more, exchanged = np.random.default_rng(3), 0, 0
    for _ in range(150):
        capacity = int(rng.integers(8, 30))
        sizes = rng.integers(1, capacity + 1, int(rng.integers(1, 10)))
        search = packing.LocalSearch(sizes, [[i] for i in range(len(sizes))], capacity)  # the worst start
        for got in (packing.pack_sizes(sizes, capacity), search.run()):
            best = fewest_bins(sizes.tolist(), capacity)
            assert sorted(itertools.chain(*got)) == list(range(len(sizes))) and best <= len(got) <= best + 1
            more += len(got) - best
            fills = [int(sizes[b].sum()) for b in got]
            if len(got) > -(-int(sizes.sum()) // capacity):
                for a, b in itertools.permutations(range(len(got)), 2):
                    if fills[a] <= fills[b] < capacity:
                        for k, j in ((1, 0), (1, 1), (2, 1), (1, 2)):
                            for given, taken in itertools.product(itertools.combinations(got[a], k), itertools.combinations(got[b], j)):
                                assert not 0 < sizes[list(given)].sum() - sizes[list(taken)].sum() <= capacity - fills[b]
        exchanged += search.exchanges
    assert more <= 15 and exchanged > 100


def test_packing_of_equal_lengths(spark):
    """Ties go by a seeded hash of doc_id and text: the same rows in other partitions give the same bins."""
    d = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("five words of one length").alias("text"))
    config = packing.PackConfig(capacity=20, shard_rows=50)
    a, b = (sorted(map(tuple, packing.pack_documents(x, config).collect())) for x in (d, d.repartition(7)))
    assert a == b and len({r[5:] for r in a if r[4] == 0}) == sum(r[4] == 0 for r in a)


# 2, 5, 6, 9 and 10 also run against SQL


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    columns = sorted(want.columns)
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    tidy = lambda x: round(x, 9) if isinstance(x, float) else x
    a = sorted(repr([tidy(r[c]) for c in columns]) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert a == sorted(repr([tidy(r[i]) for i in at]) for r in want.fetchall())


def test_lines_need_more_than_the_limit(spark):
    d = spark.createDataFrame([(i, f"own {i}\nShared  Line") for i in range(3)] + [(3, "shared line\nshared line"), (4, "twice\nother"), (5, "TWICE\nthis")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.drop_frequent_lines(d, linededup.LineConfig(max_documents=2)).collect()}
    assert got == {0: "own 0", 1: "own 1", 2: "own 2", 3: "", 4: "twice\nother", 5: "TWICE\nthis"}
    got = {r["doc_id"]: r["text"] for r in linededup.drop_frequent_lines(d, linededup.LineConfig(max_documents=4)).collect()}
    assert got[3] == "shared line\nshared line"  # a tie stays


def test_repeated_ids_count_once_as_in_the_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(4)
    rows = [(rng.randrange(12), "\n".join(rng.choices([f"line {i}" for i in range(15)] + [""], k=rng.randint(0, 6)))) for _ in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    config = linededup.LineConfig(max_documents=5)
    d.write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    sql = linededup.line_sql(config)
    frequent = {r[0] for r in con.sql(sql[: sql.index("marked AS")].rstrip().rstrip(",") + " SELECT norm FROM frequent").fetchall()}
    assert 0 < len(frequent) < 15 and linededup.frequent_lines(d, config).count() == len(frequent)
    want = sorted((i, "\n".join(x for x in t.split("\n") if x not in frequent)) for i, t in rows)
    assert sorted((r["doc_id"], r["text"]) for r in linededup.drop_frequent_lines(d, config).collect()) == want
    nameless = spark.createDataFrame([(None, "same\nown")] * 3, "doc_id long, text string")
    assert [r["text"] for r in linededup.drop_frequent_lines(nameless, linededup.LineConfig(max_documents=2)).collect()] == [""] * 3


def test_passages_of_two_documents_go(spark, tmp_path):
    """Over 50 words: planted in 2 documents, also in other case and spacing. 50 words or fewer stay up to 20 documents."""
    long, short = " ".join(f"w{i}" for i in range(51)), " ".join(f"v{i}" for i in range(50))
    rows = [(1, f"own 1\n{long}"), (2, f"{long.upper().replace(' ', '  ')} \nown 2"), (3, f"own 3\n{short}"), (4, f"{short}\nown 4"), (5, f"x {long}")]
    spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in registry.queries()["op2_passage_dedup"](spark, str(tmp_path)).collect()}
    assert got == {**dict(rows), 1: "own 1", 2: "own 2"}


# 3


def brute_kneser_ney(texts, order, alphabet):
    """Plain dictionaries: probability(context, character)."""
    from collections import Counter

    grams = Counter()
    for t in texts:
        codes = " " * (order - 1) + t
        grams.update(codes[i : i + order] for i in range(len(codes) - order + 1))
    levels = [None] * (order + 1)
    levels[order] = grams
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def p(context, c):
        k = len(context) + 1
        counts = levels[k]
        n1, n2 = sum(v == 1 for v in counts.values()), sum(v == 2 for v in counts.values())
        d = min(0.95, max(0.1, n1 / max(n1 + 2 * n2, 1)))
        own = {g[-1]: v for g, v in counts.items() if g[:-1] == context}
        lower = 1 / alphabet if k == 1 else p(context[1:], c)
        if not own:
            return lower
        total = sum(own.values())
        return max(own.get(c, 0) - d, 0) / total + d * len(own) / total * lower

    return p


def test_language_model_is_interpolated_kneser_ney():
    order, data = 3, {"x": ["abab cab ", "bca "], "y": ["ccab ", "aabbcc "]}
    grams = {}
    for name, texts in data.items():
        codes, at = languageid.stream(texts, order - 1)
        parts = [codes[a:b] for a, b in zip(at, at[1:])]
        rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(p, order) for p in parts])
        grams[name] = np.unique(rows, axis=0, return_counts=True)
    model = languageid.kneser_ney(grams, order)
    h, _, n = languageid.cross_entropies(model, ["abc cab", "zz a"])
    for j, name in enumerate(model.languages):
        p = brute_kneser_ney(data[name], order, 5)
        for i, t in enumerate(["abc cab ", "zz a "]):
            padded = "  " + t
            want = -sum(math.log(p(padded[k : k + order - 1], padded[k + order - 1])) for k in range(len(t))) / len(t)
            assert n[i] == len(t) and h[i, j] == pytest.approx(want, rel=1e-5)


def test_windows_don_t_change_scores(monkeypatch, docs):
    model = languageid.train_language_model(docs)
    texts = [r["text"] for r in docs.limit(50).collect()]
    whole = languageid.cross_entropies(model, texts)[0]
    monkeypatch.setattr(languageid, "WINDOW", 777)
    assert np.allclose(languageid.cross_entropies(model, texts)[0], whole, atol=1e-5)


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = languageid.train_language_model(docs.where("doc_id % 2 = 0"))
    got = languageid.identify_languages(docs.where("doc_id % 2 = 1 AND n_chars > 20"), model=model)
    right, kept, n = got.agg(F.avg((F.col("predicted_lang") == F.col("lang")).cast("int")), F.avg(F.col("accepted").cast("int")), F.count("*")).first()
    assert n > 400 and right > 0.99 and kept > 0.98
    strange = spark.createDataFrame([(1, "xqzj wvkp zzqx jjkq vvxw qpzj xkcd qqq www zxcv"), (2, "дом на холме стоит давно и тихо"), (3, "9f8a7sd98f7a9s8d7f a9s8d7f9a8s7df")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    assert languageid.identify_languages(strange, model=model).where("accepted").count() == 0


# 4


def _random_hmm(seed=0, k=3, v=5):
    rng = np.random.default_rng(seed)
    return hmm.Hmm(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(v), k).T.astype(np.float32))


def test_forward_and_counts_sum_over_all_paths(monkeypatch):
    m = _random_hmm()
    seqs = [[0, 1, 2, 4], [3], [], [1, 1, 0], [4, 4, 4, 4, 2]]
    symbols, offsets = np.array(sum(seqs, [])), np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    emit, move, start, logs = np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3), []
    for s in seqs:
        paths = {}
        for p in itertools.product(range(3), repeat=len(s)):
            q = 1.0
            for i, (a, o) in enumerate(zip(p, s)):
                q *= (m.start[a] if i == 0 else m.move[p[i - 1], a]) * m.emit[o, a]
            paths[p] = q
        z = sum(paths.values())
        logs.append(math.log(z) if s else 0.0)
        for p, q in paths.items():
            for i, (a, o) in enumerate(zip(p, s)):
                emit[o, a] += q / z
                if i:
                    move[p[i - 1], a] += q / z
            if s:
                start[p[0]] += q / z
    for step, long in ((1 << 20, 4096), (4, 4096), (1 << 20, 0), (3, 0), (2, 2)):
        monkeypatch.setattr(hmm, "STEP_WORDS", step)
        monkeypatch.setattr(hmm, "LONG_WORDS", long)
        assert np.allclose(hmm.log_likelihoods(m, symbols, offsets), logs, atol=1e-5)
        got = hmm.expected_counts(m, symbols, offsets)
        assert np.allclose(got[0], emit, atol=1e-5) and np.allclose(got[1], move, atol=1e-5) and np.allclose(got[2], start, atol=1e-5)
        assert got[3] == pytest.approx(sum(logs), abs=1e-4)


def test_training_raises_the_likelihood_and_scores_are_normalised(spark, docs):
    config = hmm.HmmConfig(vocabulary=300, iterations=4, states=3, emission_prior=1e-6, transition_prior=1e-6)
    lexicon = hmm.build_lexicon(docs, config)
    encoded = docs.mapInArrow(hmm._encode(spark.sparkContext.broadcast(lexicon)), "doc_id long, symbols binary, spelling double").cache()
    model, history = hmm.train(encoded.where("doc_id IS NOT NULL"), lexicon, config)
    assert all(b >= a - abs(a) * 1e-6 for a, b in zip(history, history[1:]))
    assert np.allclose(model.emit.sum(0), 1, atol=1e-4) and np.allclose(model.move.sum(1), 1) and model.start.sum() == pytest.approx(1)
    # spellings of one length sum to 1 (over the symbols in use, each standing for as many code points as share it)
    shared = np.exp(lexicon.spell[:, 1:])
    shared[:, text.PLAIN_SYMBOLS - 1 :] *= -(-(0x110000 - text.PLAIN_SYMBOLS) // (text.SYMBOLS - text.PLAIN_SYMBOLS))
    assert np.allclose(shared.sum(1), 1, atol=1e-6)


def test_long_texts_in_chunks_count_like_short_ones(monkeypatch):
    m, rng = _random_hmm(3, 4, 30), np.random.default_rng(5)
    symbols, offsets = rng.integers(0, 30, 6000), np.array([0, 17, 17, 2900, 2901, 6000])
    whole = hmm.log_likelihoods(m, symbols, offsets), hmm.expected_counts(m, symbols, offsets)
    for step, long in ((1 << 20, 16), (700, 100), (50, 0)):
        monkeypatch.setattr(hmm, "STEP_WORDS", step)
        monkeypatch.setattr(hmm, "LONG_WORDS", long)
        assert np.allclose(hmm.log_likelihoods(m, symbols, offsets), whole[0], rtol=1e-12)
        got = hmm.expected_counts(m, symbols, offsets)
        assert all(np.allclose(a, b, rtol=1e-9) for a, b in zip(got[:3], whole[1][:3])) and got[3] == pytest.approx(whole[1][3], rel=1e-12)


def test_query_of_scores_by_hand(spark):
    """The whole query on few texts: lexicon, spelling and Baum-Welch in plain Python, forward sums by paths of states."""
    texts = {1: "a b a", 2: "b a ccc", 3: "", 4: None, 5: "a b ccc dd", 6: "b"}
    config = hmm.HmmConfig(states=2, iterations=2)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in hmm.score_documents(docs, config).collect()}
    known = sorted((int(text.word_hashes([w])[0][0]), w) for w in ("a", "b", "ccc"))  # seen twice or more
    symbol = {w: i for i, (_, w) in enumerate(known)} | {"dd": 3 + 1}
    lexicon = hmm.build_lexicon(docs, config)
    assert lexicon.hashes.tolist() == [h for h, _ in known]
    model = hmm.first_model(lexicon, config)
    seqs = {i: [symbol[w] for w in (t or "").split()] for i, t in texts.items()}

    def paths(m, s):
        for p in itertools.product(range(2), repeat=len(s)):
            yield p, math.prod((m.start[a] if i == 0 else m.move[p[i - 1], a]) * float(m.emit[o, a]) for i, (a, o) in enumerate(zip(p, s)))

    for _ in range(2):
        emit, move, start = np.zeros(model.emit.shape), np.zeros((2, 2)), np.zeros(2)
        for s in seqs.values():
            z = sum(q for _, q in paths(model, s))
            for p, q in paths(model, s):
                for i, (a, o) in enumerate(zip(p, s)):
                    emit[o, a] += q / z
                    if i:
                        move[p[i - 1], a] += q / z
                if s:
                    start[p[0]] += q / z
        emit += config.emission_prior * (emit.sum(1, keepdims=True) + 1) / (emit.sum() + len(emit))
        model = hmm.Hmm((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(1, keepdims=True), emit / emit.sum(0))
    pairs = {}
    for w in "a b a b a ccc a b ccc dd b".split():
        for x, y in zip("\0" + w, w):
            pairs[ord(x), ord(y)] = pairs.get((ord(x), ord(y)), 0) + 1
    after = lambda x: sum(n for (a, _), n in pairs.items() if a == x)
    into = lambda y: sum(n for (_, b), n in pairs.items() if b == y)
    share = (into(ord("d")) + 0.1) / (sum(pairs.values()) + 0.1 * (text.SYMBOLS - 1))
    spelled = sum(math.log((pairs[x, ord("d")] + 5 * share) / (after(x) + 5)) for x in (0, ord("d")))
    for i, s in seqs.items():
        want = math.log(sum(q for _, q in paths(model, s))) + (spelled if i == 5 else 0)
        assert got[i]["n_words"] == len(s) and got[i]["log_likelihood"] == pytest.approx(want, abs=1e-5)
        assert got[i]["cross_entropy"] == (pytest.approx(-want / len(s), abs=1e-5) if s else None)


def test_training_ends_when_the_likelihood_hardly_gains(spark, docs):
    """The states part: far below the cross-entropy of a single state."""
    lexicon = hmm.build_lexicon(docs)
    encoded = docs.mapInArrow(hmm._encode(spark.sparkContext.broadcast(lexicon)), "doc_id long, symbols binary, spelling double").cache()
    _, history = hmm.train(encoded, lexicon)
    gains = [(b - a) / abs(b) for a, b in zip(history, history[1:])]
    assert gains[-1] < 1e-3 <= min(gains[:-1])
    _, one = hmm.train(encoded, lexicon, hmm.HmmConfig(states=1))
    assert history[-1] > 0.95 * one[-1]


def test_training_keeps_the_shuffle_files_of_one_iteration_only(spark, docs, monkeypatch):
    """Those of the iterations before are gone from the disk when the next model is made, without help of the garbage collector."""
    disk, made, left = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), [], []
    shuffled = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if f.getName().startswith("shuffle_")}
    before = shuffled()

    def watched(*args, next_model=hmm.next_model):
        for _ in range(50):  # they are removed in the background
            if not (mine := shuffled() - before):
                break
            time.sleep(0.1)
        left.append(len(mine))
        made.append(next_model(*args))
        return made[-1]

    monkeypatch.setattr(hmm, "next_model", watched)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(name)
    scores = hmm.score_documents(docs, hmm.HmmConfig(iterations=3, states=2))
    assert left == [0, 0, 0]
    assert spark.conf.get(name) == kept
    first, second = ({tuple(r) for r in scores.collect()} for _ in range(2))
    assert first == second and len(first) == docs.distinct().count()


def test_every_word_seen_twice_is_a_symbol_however_many_there_are(spark):
    """More words than 16 bits can name: the symbols grow with the corpus."""
    n = 70_000
    d = spark.range(2 * n // 100).select(F.col("id").alias("doc_id"), F.expr(f"concat_ws(' ', transform(sequence(0, 99), j -> concat('w', (id * 100 + j) % {n})), concat('once', id))").alias("text"))
    config = hmm.HmmConfig(states=2, iterations=1)
    lexicon = hmm.build_lexicon(d, config)
    assert len(lexicon.hashes) == n
    symbols, spelling, _ = lexicon.encode([" ".join(f"w{i}" for i in range(n)) + " once1"])
    assert len(set(symbols[:n].tolist())) == n and symbols[n] == n + 4 and not spelling[:n].any() and spelling[n] < 0
    got = hmm.score_documents(d, config).agg(F.count("*"), F.sum("n_words"), F.min("cross_entropy")).first()
    assert got[0] == 2 * n // 100 and got[1] == 2 * n + 2 * n // 100 and got[2] > math.log(n) - 1


# 5


def test_sainte_lague_is_the_ranking_of_quotients():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 6)
        weights = {i: rng.choice([0, 1, 1, 2, 3.5, rng.random()]) for i in range(n)}
        available = {i: rng.randint(0, 9) for i in range(n)}
        total = rng.randint(0, 40)
        quotients = sorted(((-w / (2 * k + 1), i) for i, w in weights.items() if w > 0 for k in range(available[i])))[:total]
        assert mixing.sainte_lague(weights, available, total) == {i: sum(j == i for _, j in quotients) for i in weights}


def test_large_houses_are_quick_and_proportional():
    seats = mixing.sainte_lague({"a": 1.0, "b": 2.0, "c": 7.0}, dict.fromkeys("abc", 10**12), 10**10)
    assert seats == {"a": 10**9, "b": 2 * 10**9, "c": 7 * 10**9}


def test_target_weights_are_met(spark):
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a b c d e f g h").alias("text"), F.when(F.col("id") < 4000, "x").when(F.col("id") < 5500, "y").otherwise("z").alias("source"))
    config = mixing.MixConfig(weights=(("x", 1.0), ("y", 1.0), ("w", 5.0)), budget=0.4, block_tokens=80, shard_tokens=4000)
    got = {r["source"]: r["count"] for r in mixing.mix_sources(d, config).groupBy("source").count().collect()}
    assert set(got) == {"x", "y"} and abs(got["x"] - 1200) <= 20 and abs(got["y"] - 1200) <= 20


def test_largest_fair_total_is_where_the_ranking_passes_a_supply():
    rng = random.Random(6)
    for _ in range(80):
        n = rng.randint(1, 6)
        weights = {i: rng.choice([0, 1, 1, 2, 3.5, rng.random()]) for i in range(n)}
        available = {i: rng.randint(0, 9) for i in range(n)}
        live = [i for i in range(n) if weights[i] and available[i]]
        quotients = sorted((-weights[i] / (2 * k + 1), i, k) for i in live for k in range(20))
        assert mixing.largest_fair(weights, available) == next((at for at, (_, i, k) in enumerate(quotients) if k >= available[i]), 0)


def test_weights_of_the_query_are_met_with_a_hot_source(spark, tmp_path):
    """op5_mix_to_weights, in its own configuration, on 19 equal sources beside one that has half of all tokens."""
    words = " ".join(["w"] * 1024)
    d = spark.range(38 * 80).select(F.col("id").alias("doc_id"), F.lit(words).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.floor(F.col("id") / 2) % 19).cast("string"))).alias("source"), F.lit(2047).cast("long").alias("n_chars"))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["source"]: r["count"] for r in registry.queries()["op5_mix_to_weights"](spark, str(tmp_path)).groupBy("source").count().collect()}
    target = math.sqrt(19) / (math.sqrt(19) + 19)
    assert len(got) == 20 and got["hot"] / sum(got.values()) == pytest.approx(target, abs=0.02)
    assert all(n / sum(got.values()) == pytest.approx((1 - target) / 19, abs=0.01) for s, n in got.items() if s != "hot")
    plain = {r["source"]: r["count"] for r in registry.queries()["op5_mix_sources"](spark, str(tmp_path)).groupBy("source").count().collect()}
    assert plain["hot"] / sum(plain.values()) > 2 * target  # why it is a query of its own


# 6


def test_perfect_hash_is_minimal_and_checks_bytes():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 5000):
        keys = rng.integers(0, 1 << 63, (n, 4)).astype(np.uint64)
        table = exactdedup.PerfectHash(keys)
        assert sorted(table.order.tolist()) == list(range(n))
        assert (table.lookup(keys) == table.order).all()
        near = keys.copy()
        near[:, 3] ^= np.uint64(1)
        assert (table.lookup(near) == -1).all()


def test_history_wins(spark):
    d = spark.createDataFrame([(1, "a"), (4, "a"), (6, "a"), (3, "b"), (5, "b"), (7, "c"), (8, "d"), (8, "d")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in exactdedup.drop_exact_copies(d, exactdedup.earlier_half()).collect()) == [3, 4, 7, 8]


def test_a_text_of_a_million_rows(spark):
    """However often a text occurs, each side has one row of it when they meet."""
    d = spark.range(1_000_000).select((F.col("id") + 2).alias("doc_id"), F.when(F.col("id") % 1000 == 7, F.concat(F.lit("own "), "id")).otherwise(F.lit("hot")).alias("text"))
    kept = exactdedup.drop_exact_copies(d, exactdedup.earlier_half())
    assert kept.where("text = 'hot'").collect() == [(2, "hot")] and kept.count() == 1001
    sides = exactdedup._winners(d.select(F.unhex(F.sha2("text", 256)).alias("digest"), "doc_id", F.lit(1).cast("long").alias("same")))
    assert sides.count() == 1001 and sides.agg(F.sum("n")).first()[0] == 1_000_000


# 7


def test_query_of_quality_by_hand(spark):
    """Features by plain counting, scores by all pairs; sources that differ after 64 characters are two."""
    config = quality.QualityConfig(epochs=1, bits=12, rank=3)
    long = "https://example.org/" + "a" * 80
    rows = [(1, "One two two THREE. 4!\nfive", long + "1", "en"), (2, "Null source here", None, None), (3, "", "s", "en"), (4, "same same", long + "2", "de"), (5, "x" * 100, long + "1", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (5, 1)], "doc_id long, quality int")
    model = quality.train_quality_model(docs, labels, config)
    assert quality._meta_id(long + "1", 14) != quality._meta_id(long + "2", 14)
    got = {r["doc_id"]: r["quality_score"] for r in quality.classify_quality(docs, labels, config, model).collect()}
    import unicodedata

    for i, t, source, lang in rows:
        if not t:
            assert got[i] == 0
            continue
        x = {}
        words = ["".join(g) for k, g in itertools.groupby(t.lower(), lambda c: unicodedata.category(c)[0] in "LN") if k]
        of = {w: int(text.word_hashes([w])[0][0] >> np.uint64(64 - 12)) for w in words}
        for w in words:
            x[of[w]] = x.get(of[w], 0) + 1
        most, distinct, norm = max(x.values()), len(x), math.sqrt(sum(v * v for v in x.values()))
        x = {k: v / norm for k, v in x.items()}
        x[4096 + quality._meta_id(source, 14)] = x[4096 + (1 << 14) + quality._meta_id(lang, 14)] = 0.5
        kinds = [unicodedata.category(c) for c in t]
        share = lambda f: sum(map(f, t, kinds)) / len(t)
        lines = t.count("\n") + t.count("\r")
        dense = [math.log1p(len(t)), share(lambda c, k: k == "Lu"), share(lambda c, k: k[0] == "L" and k != "Lu"), share(lambda c, k: k[0] == "N"), share(lambda c, k: k[0] == "Z" or c == "\t"), share(lambda c, k: k[0] == "P"), share(lambda c, k: k[0] == "S"), lines / len(t), share(lambda c, k: k[0] in "CM" and c not in "\t\n\r"), math.log1p(sum(map(len, words)) / len(words)), distinct / len(words), most / len(words), math.log1p(len(words) / (lines + 1))]
        base = 4096 + (2 << 14)
        for k, v in enumerate(dense):
            x[base + k] = math.asinh((v - model.mean[k]) / model.scale[k]) * 0.3
        s = model.bias + sum(model.weight[k] * v for k, v in x.items()) + sum(model.vector[a] @ model.vector[b] * x[a] * x[b] for a, b in itertools.combinations(x, 2))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-s)), rel=1e-6)
    tie = quality.QualityConfig(epochs=1, bits=12, rank=3, keep_at=got[4])
    assert {r["doc_id"] for r in quality.classify_quality(docs, labels, tie, model).where("keep").collect()} == {i for i, p in got.items() if p >= got[4]}


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = quality.FactorizationMachine(0.3, rng.normal(size=20), rng.normal(size=(20, 4)), np.zeros(1), np.ones(1))
    ids, x, offsets = np.array([1, 5, 7, 2, 19, 3]), rng.normal(size=6), np.array([0, 3, 3, 6])
    for r, got in enumerate(m.scores(ids, x, offsets)):
        i, v = ids[offsets[r] : offsets[r + 1]], x[offsets[r] : offsets[r + 1]]
        want = 0.3 + (m.weight[i] * v).sum() + sum(m.vector[i[a]] @ m.vector[i[b]] * v[a] * v[b] for a, b in itertools.combinations(range(len(i)), 2))
        assert got == pytest.approx(want)


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train_quality_model(docs, labels.where("doc_id % 4 <> 0"))
    test = labels.where("doc_id % 4 = 0")
    got = quality.classify_quality(docs.join(test.select("doc_id"), "doc_id", "left_semi"), labels, model=model).join(test, "doc_id")
    good, bad = got.where("quality = 1").agg(F.avg(F.col("keep").cast("int"))).first()[0], got.where("quality = 0").agg(F.avg(F.col("keep").cast("int"))).first()[0]
    assert good > 0.97 and bad < 0.1


# 8


def test_matrix_has_its_margins_and_tasks_agree():
    sizes, shards = np.array([5, 0, 17, 30, 8]), sharding.even_sizes(60, 7)
    m = np.stack([sharding.matrix_row(sizes, shards, i, 9) for i in range(5)])
    assert (m.sum(1) == sizes).all() and (m.sum(0) == shards).all() and (m >= 0).all()


def test_matrix_is_hypergeometric():
    sizes, shards = np.array([3, 2]), np.array([2, 3])
    got = np.bincount([sharding.matrix_row(sizes, shards, 0, s)[0] for s in range(4000)], minlength=3) / 4000
    want = [math.comb(2, k) * math.comb(3, 3 - k) / math.comb(5, 3) for k in range(3)]
    assert np.abs(got - want).max() < 0.03


def test_large_draws(monkeypatch):
    rng = np.random.default_rng(4)
    big = [sharding.hypergeometric(rng, 3 * 10**9, 7 * 10**9, 10**6) for _ in range(300)]
    assert abs(np.mean(big) - 3e5) < 5 * math.sqrt(2.1e5 / 300) and 0.7 < np.std(big) / math.sqrt(2.1e5) < 1.3
    monkeypatch.setattr(sharding, "_NUMPY_MOST", 0)  # the same code on a small case, against the exact distribution
    got = np.bincount([sharding.hypergeometric(rng, 30, 40, 25) for _ in range(6000)], minlength=26)[:26] / 6000
    want = np.array([math.comb(30, k) * math.comb(40, 25 - k) / math.comb(70, 25) for k in range(26)])
    assert np.abs(got - want).max() < 0.025
    assert [sharding.hypergeometric(rng, 3, 0, 2), sharding.hypergeometric(rng, 0, 3, 2), sharding.hypergeometric(rng, 5, 3, 8)] == [2, 0, 5]


def test_shuffle_is_a_permutation_with_exact_sizes(spark, docs):
    config = sharding.ShardConfig(shards=7)
    got = sharding.shuffle_to_shards(docs.repartition(5, "doc_id"), config).toPandas()
    n = docs.count()
    assert sorted(got.doc_id) == list(range(n))
    assert got.groupby("shard").size().tolist() == sharding.even_sizes(n, 7).tolist()
    for _, part in got.groupby("shard"):
        assert sorted(part.shard_pos) == list(range(len(part)))
    again = sharding.shuffle_to_shards(docs, config).toPandas()
    assert again.equals(sharding.shuffle_to_shards(docs, config).toPandas())
    assert list(again.doc_id) != list(range(n))


def test_many_shards_in_few_partitions(spark, docs):
    """Shards of one partition are cut from its permutation: sizes and places are exact, and each row is in each shard equally often."""
    n = docs.count()
    got = sharding.shuffle_to_shards(docs.repartition(3, "doc_id"), sharding.ShardConfig(shards=90))
    assert got.rdd.getNumPartitions() == -(-90 // 16)
    got = got.toPandas()
    assert sorted(got.doc_id) == list(range(n)) and got.groupby("shard").size().reindex(range(90), fill_value=0).tolist() == sharding.even_sizes(n, 90).tolist()
    assert all(sorted(part.shard_pos) == list(range(len(part))) for _, part in got.groupby("shard"))
    few = spark.range(40, numPartitions=3)
    at = np.zeros((40, 20))
    for seed in range(30):
        for r in sharding.shuffle_to_shards(few, sharding.ShardConfig(shards=20, together=5, seed=seed)).collect():
            at[r["id"], r["shard"]] += 1
    assert (at.sum(0) == 60).all() and at.max() <= 9 and ((at - 1.5) ** 2 / 1.5).sum() < 900  # chi-squared, 741 degrees of freedom
    assert sharding.shuffle_to_shards(few, sharding.ShardConfig(shards=100)).select("shard").distinct().count() == 40


def test_split_beyond_the_range_of_numpy(monkeypatch):
    """Halved groups have the distribution of the direct draw, here of 4 groups."""
    sizes, rng = np.array([3, 1, 2, 2]), np.random.default_rng(1)
    monkeypatch.setattr(sharding, "_NUMPY_MOST", 5)
    got = {}
    for _ in range(8000):
        x = tuple(sharding.split(rng, sizes, 4).tolist())
        got[x] = got.get(x, 0) + 1
    for x in itertools.product(range(4), range(2), range(3), range(3)):
        if sum(x) == 4:
            want = math.prod(math.comb(int(a), b) for a, b in zip(sizes, x)) / math.comb(8, 4)
            assert abs(got.get(x, 0) / 8000 - want) < 0.02


# 9


def brute_pairs(texts, n, theta):
    import regex

    sets = {}
    for i, t in texts.items():
        w = regex.findall(r"[\p{L}\p{N}]+", t.lower())
        if w:
            sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= theta * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("config", [neardup.JaccardConfig(n=1, theta=0.4, frequent=(3,)), neardup.JaccardConfig(n=2, theta=0.55, frequent=(1, 30)), neardup.JaccardConfig(n=1, theta=0.8, frequent=(0,)), neardup.JaccardConfig(n=1, theta=0.2, frequent=(0, 20)), neardup.JaccardConfig(n=3, theta=1.0)])
@pytest.mark.parametrize("joined", [False, True])
def test_join_finds_all_pairs(spark, monkeypatch, config, joined):
    if joined:  # the way taken where the sets are too many to broadcast their cells
        monkeypatch.setattr(neardup, "BROADCAST_SETS", -1)
        monkeypatch.setattr(neardup, "TOGETHER", 2)  # and groups parted between blocks
    rng = random.Random(config.n * 100 + int(config.theta * 10))
    words = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(150):
        if i and rng.random() < 0.6:
            w = texts[rng.randrange(i)].split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = rng.choices(words[:20] if rng.random() < 0.5 else words, k=rng.choice([1, 2, 3, 5, 8, 20, 40]))
        texts[i] = " ".join(w)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in neardup.similar_pairs(d, config).collect()}
    want = brute_pairs(texts, config.n, config.theta)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("frequent", [(0,), (3,), (0, 40)])
def test_combinations_of_sets_of_every_size(spark, frequent):
    """Sets of 2 to 3,000 n-grams of few and many documents, with partners on both sides of theta."""
    rng = random.Random(7)
    texts, i = {}, 0
    for size in (2, 5, 9, 17, 40, 90, 100, 180, 250, 300, 900, 1030, 3000):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size + 2)]
        for share in (0, 0, 0.05, 0.1, 0.12, 0.15, 0.3):
            w = list(base)
            for _ in range(round(share * size)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
            for text in (w, w[: rng.randrange(max(1, len(w) // 2), len(w) + 1)]):
                texts[i] = " ".join(text)
                i += 1
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    config = neardup.JaccardConfig(frequent=frequent)
    kinds = neardup.signature_kinds(d, config)
    assert kinds["combined"] > (0.1 if frequent == (3,) else 0.5) * sum(kinds.values())  # they are used
    assert sum(kinds.values()) < 3 * 182 * 3000  # and in proportion to the n-grams
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in neardup.similar_pairs(d, config).collect()}
    want = brute_pairs(texts, 3, 0.55)
    assert len(want) > 200 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def crowd_texts(rng, n, words=60, swaps=6):
    """Near copies of one text, most of them different."""
    base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, swaps)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        yield " ".join(w)


def classes_by_hand(ids, pairs):
    root, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {(i, find(i), links[i]) for i in ids}


@pytest.mark.parametrize("parted", [False, True])
@pytest.mark.parametrize("theta", [0.55, 0.75])
def test_classes_and_links_of_crowds(spark, monkeypatch, parted, theta):
    if parted:
        for name, value in (("TOGETHER", 20), ("LINK_SETS", 25), ("LINK_GRAMS", 900), ("COLUMNS", 32), ("LEADERS", 2), ("BROADCAST_SETS", -1), ("CROWD", 3)):
            monkeypatch.setattr(neardup, name, value)
    rng = random.Random(21)
    texts = [*crowd_texts(rng, 150), *crowd_texts(rng, 60, swaps=14), *crowd_texts(rng, 3), *(f"alone {i} and nothing else like {i * i} here {i + 7}" for i in range(20))]
    for _ in range(40):  # chains, copies, parts of others
        w = texts[rng.randrange(len(texts))].split()
        texts.append(" ".join(w[: rng.randrange(len(w) // 2, len(w) + 1)]))
    rng.shuffle(texts)
    texts = dict(enumerate(texts))
    texts[997], texts[998], texts[999] = None, "", " - "
    config = neardup.JaccardConfig(theta=theta)
    d = spark.createDataFrame([*texts.items(), (5, texts[5]), (None, texts[5])], "doc_id long, text string")
    got = [tuple(r) for r in neardup.similarity_classes(d, config).collect()]
    want = classes_by_hand(texts, brute_pairs({i: t for i, t in texts.items() if t}, 3, theta))
    assert len(got) == len(texts) and set(got) == want and len({c for _, c, _ in want}) > 20


def test_classes_of_ids_with_several_texts(spark):
    """Each pair of ids counts once, and an id with two texts connects what is like either."""
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(4, a), (4, b), (7, a + " more"), (9, b + " more"), (9, a), (3, "nothing like them at all")]
    got = neardup.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == {(4, 4, 2), (7, 4, 2), (9, 4, 2), (3, 3, 0)}


def test_crowds_are_connected_by_few_links(spark):
    """n near copies have about n * n / 2 links; what connects them, and decides which stay, doesn't need so many."""
    rng = random.Random(22)
    texts = list(dict.fromkeys(crowd_texts(rng, 400)))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert neardup.similar_pairs(d).count() > 50 * len(texts)
    _, linked = neardup._similar(d, neardup.JaccardConfig(), False, True)
    assert linked.count() < 8 * len(texts)
    want = {c for _, c, _ in classes_by_hand(range(len(texts)), brute_pairs(dict(enumerate(texts)), 3, 0.55))}
    assert {r["doc_id"] for r in neardup.keep_one_of_similar(d).collect()} == want


def test_common_grams():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 900, rng.integers(1, 120))).astype(np.uint64) for _ in range(70)]
    want = [[len(np.intersect1d(x, y)) for y in sets[30:]] for x in sets[:30]]
    assert neardup.common_grams(sets[:30], sets[30:]).tolist() == want


def test_similarity_of_exactly_theta_is_in(spark):
    """11 of 20 words in common: 0.55."""
    a, b, c = [f"a{i}" for i in range(4)], [f"b{i}" for i in range(5)], [f"c{i}" for i in range(11)]
    rows = [(1, " ".join(c + a)), (2, " ".join(c + b)), (3, " ".join(c + b + ["more"]))]
    got = neardup.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"), neardup.JaccardConfig(n=1)).collect()
    assert {(r["doc_a"], r["doc_b"]) for r in got} == {(1, 2), (2, 3)} and min(r["jaccard"] for r in got) == 0.55


def test_groups_cost_little_and_combinations_need_k_of_them():
    for theta in (0.3, 0.55, 0.9):
        for level in range(6):
            least = neardup.least_overlap(math.ceil(theta * 4**level - 1e-9), theta)
            assert neardup.group_count(level, 2, theta, 2) < max(2, least)
    group = np.array([0, 0, 0, 2, 5, 5])
    assert neardup.within_groups(group, 2).tolist() == [[0, 1], [1, 2], [4, 5], [0, 2]]
    assert neardup.within_groups(group, 3).tolist() == [[0, 1, 2]] and neardup.within_groups(group[:0], 3).shape == (0, 3)


def test_many_copies_are_paired_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 4)
    d = spark.range(11).select(F.col("id").alias("doc_id"), F.lit("one text that is here many times").alias("text"))
    got = [(r["doc_a"], r["doc_b"], r["jaccard"]) for r in neardup.similar_pairs(d).collect()]
    assert sorted(got) == [(a, b, 1.0) for a, b in itertools.combinations(range(11), 2)]


def test_one_of_each_group_stays(spark):
    base = [f"word{i}" for i in range(60)]
    near = lambda k: " ".join(base[:k] + ["other"] + base[k + 1 :])
    d = spark.createDataFrame([(9, " ".join(base)), (4, near(3)), (7, near(30)), (5, "all by itself and nothing like it"), (6, " ".join(reversed(base)))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in neardup.keep_one_of_similar(d).collect()) == [4, 5, 6]


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


# 10


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=9), st.sampled_from([matroska.XIPH, matroska.EBML_LACING, matroska.FIXED]))
def test_lacing_round_trip(frames, lacing):
    if lacing == matroska.FIXED:
        frames = [f.ljust(len(frames[0]), b".")[: len(frames[0])] for f in frames]
    content = matroska.block_content(1, -5, frames, lacing)
    number, at = matroska.read_size(content, 0, len(content))
    assert number == 1 and struct.unpack_from(">h", content, at)[0] == -5
    got = matroska.frame_ranges(content, at + 3, len(content), content[at + 2] >> 1 & 3)
    assert [content[a : a + n] for a, n in got] == frames


@settings(max_examples=60, deadline=None)
@given(st.integers(0, (1 << 56) - 2))
def test_lengths_round_trip(n):
    b = matroska.size_bytes(n)
    assert matroska.read_size(b, 0, len(b)) == (n, len(b))


def test_movie_round_trip_and_faults():
    lines = [f"line {i} " + "ü" * (i * 7 % 300) for i in range(101)]
    data = matroska.text_movie("\n".join(lines))
    media = matroska.parse(data)
    one = [p for p in media.packets if p.track == 1]
    assert media.error is None and [data[p.offset : p.offset + p.size].decode() for p in one] == lines
    assert [p.timestamp_ns for p in one] == [i * 10**9 for i in range(101)] and [i for i, p in enumerate(one) if p.cued] == [0, 32, 64, 96]
    for n in range(0, len(data), 97):  # cut off anywhere: no crash, what is whole is read
        part = matroska.parse(data[:n])
        got = [data[p.offset : p.offset + p.size].decode() for p in part.packets if p.track == 1]
        assert got == lines[: len(got)] and (part.error or n == 0)
    rng = np.random.default_rng(1)
    for _ in range(200):  # or damaged anywhere
        bad = bytearray(data[:600])
        for at in rng.integers(0, 600, 3):
            bad[at] = rng.integers(256)
        matroska.parse(bytes(bad))
    assert matroska.parse(b"RIFF....").error == "no EBML header"


def brute_packets(data, text):
    """Clusters are found by their bytes; the frames, known from the text, fill the ends of their blocks."""
    import re

    def vint(i):
        n = 9 - data[i].bit_length()
        return int.from_bytes(data[i : i + n], "big") - (1 << 7 * n), i + n

    lines = [x.encode() for x in text.split("\n")]
    payloads, seen, out = {1: lines, 2: [b"%08d" % len(x) for x in lines]}, {1: 0, 2: 0}, []
    for cluster in (m.start() for m in re.finditer(re.escape(b"\x1f\x43\xb6\x75"), data)):
        n, i = vint(cluster + 4)
        stop = i + n
        while i < stop:
            kind, (n, i) = data[i], vint(i + 1)
            end = i + n
            if kind in (0xA0, 0xA3):
                n, body = vint(i + 1) if kind == 0xA0 else (n, i)
                track, flags = data[body] & 0x7F, data[body + 3]
                frames = payloads[track][seen[track] :][: data[body + 4] + 1 if flags & 6 else 1]
                at = body + n - sum(map(len, frames))
                for k, x in enumerate(frames):
                    assert data[at : at + len(x)] == x
                    out.append((track, seen[track], k, "S_TEXT/UTF8" if track == 1 else "S_TEXT/ASCII", seen[track] * 10**9, 10**9, kind == 0xA0 or flags & 0x80 > 0, cluster, at, len(x), None))
                    seen[track], at = seen[track] + 1, at + len(x)
            i = end
    assert seen == {1: len(lines), 2: len(lines)}
    return sorted(out)


def test_query_returns_the_whole_packet_table(spark, docs):
    columns = ["track", "packet", "lace", "codec", "timestamp_ns", "duration_ns", "keyframe", "cluster_offset", "offset", "size", "error"]
    got, of = registry.queries()["op10_packet_ranges"](spark, SF), {}
    assert got.columns == ["doc_id", *(x.split()[0] for x in matroska._PACKETS.split(", "))]
    for r in got.collect():
        of.setdefault(r["doc_id"], []).append(tuple(r[c] for c in columns))
    for d in docs.where("text IS NOT NULL").collect():
        assert sorted(of.pop(d["doc_id"])) == brute_packets(matroska.text_movie(d["text"]), d["text"])
    assert not of
    plain = registry.queries()["op10_matroska_packets"](spark, SF)
    assert sorted(map(repr, got.select(plain.columns).collect())) == sorted(map(repr, plain.collect()))


def test_unknown_sizes_and_groups():
    cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7
    group = matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, matroska.block_content(3, 10, [b"x"], 0)) + matroska.number(matroska.DURATION, 40) + matroska.element(matroska.REFERENCE, b"\xff"))
    body = cluster + matroska.number(matroska.TIME, 100) + group + cluster + matroska.number(matroska.TIME, 200) + matroska.element(matroska.SIMPLE, matroska.block_content(3, -1, [b"yz"], 0))
    data = matroska.element(matroska.EBML, b"") + matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + body
    media = matroska.parse(data)
    got = [(p.timestamp_ns, p.duration_ns, p.keyframe, data[p.offset : p.offset + p.size]) for p in media.packets]
    assert media.error is None and got == [(110_000_000, 40_000_000, False, b"x"), (199_000_000, None, True, b"yz")]


# text kernels


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_words_are_runs_of_letters_and_numbers(texts):
    import unicodedata

    words = [["".join(g) for k, g in itertools.groupby(t.lower(), lambda c: unicodedata.category(c)[0] in "LN") if k] for t in texts]
    hashes, at = text.word_hashes(texts)
    assert np.diff(at).tolist() == [len(w) for w in words]
    seen = {}
    for h, w in zip(hashes.tolist(), itertools.chain(*words)):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_pieces_don_t_change_words(monkeypatch):
    t = [" ".join(f"word{i * 7919 % 1000}" for i in range(4000)), "y" * 5000, None, "a b"]
    whole = text.word_hashes(t), text.spelled_words(t, np.arange(text.SYMBOLS**2, dtype=float).reshape(text.SYMBOLS, -1))
    monkeypatch.setattr(text, "PIECE", 1000)
    cut = text.word_hashes(t), text.spelled_words(t, np.arange(text.SYMBOLS**2, dtype=float).reshape(text.SYMBOLS, -1))
    assert all(np.array_equal(a, b) for a, b in zip(whole[0], cut[0])) and all(np.allclose(a, b) for a, b in zip(whole[1], cut[1]))


@pytest.mark.parametrize("name", ["op2_line_dedup", "op5_mix_sources", "op6_exact_dedup"])
def test_joins_without_broadcasts(spark, monkeypatch, name):
    """The other way, beyond the sizes that are broadcast, gives the same rows."""
    before = sorted(map(repr, registry.queries()[name](spark, SF).collect()))
    for module, limits in ((linededup, ("FREQUENT_ROWS", "AFFECTED_ROWS")), (mixing, ("BROADCAST_ROWS",)), (exactdedup, ("BROADCAST_ROWS",))):
        for limit in limits:
            monkeypatch.setattr(module, limit, -1)
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(repr, registry.queries()[name](spark, SF).collect())) == before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)


def test_near_duplicates_pass_candidates_on_in_lots():
    from types import SimpleNamespace

    import pyarrow as pa
    import zstandard

    from rillwork.llm import neardup
    from rillwork.llm.text import gram_sets

    config = neardup.JaccardConfig()
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[k] if rng.random() > 0.06 else f"x{rng.integers(1 << 30)}" for k in range(60)) for _ in range(60)]
    sketch = neardup.Signer(config, np.zeros(1 << 16, np.uint8), (255,))
    packed = list(neardup._pack(SimpleNamespace(value=sketch), SimpleNamespace(value=neardup.NO_LABELS), 1)(iter([pa.RecordBatch.from_pydict({"text": texts})])))

    def met(*limits):
        sums, most, expand = {}, 0, zstandard.ZstdDecompressor()
        for b in neardup._meet(config, 1, *limits)(iter(packed)):
            for blob in b["pairs"].to_pylist():
                x = expand.decompress(blob)
                n, m = (int(v) for v in np.frombuffer(x, np.uint32, 2))
                lo, at = np.frombuffer(x, np.uint64, n, 8 + 8 * n), 8 + 20 * n
                i, j, shared = (neardup._joined(x, np.uint32, m, at + 4 * m * k) for k in range(3))
                most = max(most, m)
                for p, q, k in zip(lo[i].tolist(), lo[j].tolist(), shared.tolist()):
                    key = min(p, q), max(p, q)
                    sums[key] = sums.get(key, 0) + k
        return sums, most

    whole, all_at_once = met()
    lots, most = met(50, 20)
    enough = lambda s: {p: min(k, neardup.ENOUGH) for p, k in s.items()}
    assert len(whole) == all_at_once > 500 and len(list(gram_sets(texts, 3))) == 60
    assert most < 400 and enough(lots) == enough(whole)
