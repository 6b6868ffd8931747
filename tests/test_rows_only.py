"""Operators without a SQL oracle, checked by brute force on small inputs."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from citesight.operators import model as M
from citesight.operators import sampling as B
from citesight.operators import tokens as K


def test_uniform_replace_draws_valid_rows_reproducibly(spark):
    df = spark.range(0, 50).withColumn("v", F.col("id") * 2)
    a = B.sample_uniform_replace(df, 400, seed=3)
    rows = a.collect()
    assert len(rows) == 400
    assert all(r.v == r.id * 2 for r in rows)
    assert len({r.id for r in rows}) > 30                       # with replacement, most rows hit
    b = B.sample_uniform_replace(df.repartition(5), 400, seed=3)
    assert sorted((r.draw, r.id) for r in rows) == sorted((r.draw, r.id) for r in b.collect())


def test_weighted_replace_follows_inverse_frequency(spark):
    # 90 rows at 0.0 and 10 rows at 1.0: two bins with equal total mass after weighting
    df = spark.createDataFrame([(i, 0.0 if i < 90 else 1.0) for i in range(100)], "id long, v double")
    binned = B.inverse_freq_weights(df, "v", n_bins=2)
    draws = B.sample_weighted_replace(binned, 4000, seed=5).collect()
    assert len(draws) == 4000
    c = Counter(r.bin for r in draws)
    assert abs(c[0] - c[1]) < 400                              # about half each
    assert {r.id for r in draws if r.bin == 1} <= set(range(90, 100))


def test_weighted_replace_default_n_is_rows(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(70)], "id long, v double")
    assert B.sample_weighted_replace(B.inverse_freq_weights(df, "v"), seed=1).count() == 70


def test_null_targets_have_no_bin(spark):
    df = spark.createDataFrame([(1, 0.0), (2, None), (3, float("nan")), (4, 10.0)], "id long, v double")
    assert {r.id for r in B.inverse_freq_weights(df, "v").collect()} == {1, 4}


def test_every_draw_finds_a_bin_and_a_lone_row_keeps_its_draws(spark):
    df = spark.createDataFrame([(i, 0.01 * i) for i in range(500)] + [(999, 1000.0)], "id long, v double")
    draws = B.sample_weighted_replace(B.inverse_freq_weights(df, "v"), 3000, seed=3).collect()
    assert len(draws) == 3000 == len({r.draw for r in draws})
    assert 1300 < sum(r.id == 999 for r in draws) < 1700


def test_tokens_of_rows_without_or_with_equal_ids(spark):
    df = spark.createDataFrame([(None, "b a"), (None, "a"), (1, "a b"), (1, "a b"), (1, "b"), (2, None)], "id long, t string")
    v = K.build_vocab(df, "t")
    for bound in (0, K.BROADCAST_VOCAB_BYTES):
        got = sorted((str(r.id), r.t or "", r.t_tokens) for r in K.tokenise(df, "id", "t", v, broadcast_bytes=bound).collect())
        ids = {r.token: r.token_id for r in v.collect()}
        assert got == sorted((str(i), t or "", [1, *[ids[w] for w in t.split()], 2] if t else []) for i, t in
                             [(None, "b a"), (None, "a"), (1, "a b"), (1, "a b"), (1, "b"), (2, None)])


def test_embed_batch_shape_and_norm(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, None)], "id long, t string")
    e = {r.id: r.e for r in K.embed_batch(df, "t", "e", dim=16).collect()}
    assert len(e[1]) == 16 and e[1] == e[2]
    assert math.isclose(math.sqrt(sum(v * v for v in e[1])), 1.0, rel_tol=1e-5)
    assert all(v == 0.0 for v in e[3])


def encode(texts, dim, fitted=None, steps=K.POWER_STEPS, a=K.WORD_SMOOTHING):
    """Plain version of the default encoder: vectors of ``texts`` with the encoder fitted on ``fitted``."""
    def bag(t):
        return Counter(w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w)

    def vector(t):
        v = [0.0] * dim
        for w, n in bag(t).items():
            d = hashlib.md5(w.encode()).hexdigest()
            v[int(d[:8], 16) % dim] += n * (1 if d[8] < "8" else -1) * a / (a + counts[w] / total)
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm for x in v] if norm > 1e-9 else v

    def dot(x, y):
        return sum(i * j for i, j in zip(x, y))
    fitted = texts if fitted is None else fitted
    counts = sum((bag(t) for t in fitted), Counter())
    total = max(sum(counts.values()), 1)
    u = [dim ** -0.5] * dim
    for _ in range(steps):
        vs = [vector(t) for t in fitted]
        m = [sum(dot(v, u) * v[i] for v in vs) for i in range(dim)]
        norm = math.sqrt(dot(m, m))
        u = [x / norm if norm else 0.0 for x in m]
    out = []
    for v in map(vector, texts):
        c = dot(v, u)
        out.append([(x - c * y) / math.sqrt(1 - c * c) if any(v) and 1 - c * c > 1e-9 else 0.0 for x, y in zip(v, u)])
    return out


CORPUS = ["the cat and the dog", "the dog and a bird", "the the the", None, "", "--", "a bird sings and the cat sleeps",
          "the cat and the dog", "rare words only here"]


def test_default_encoder_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(CORPUS)), "id long, t string")
    new = ["unseen words and the cat", None, "dog"]
    other = spark.createDataFrame(list(enumerate(new)), "id long, t string")
    enc = K.fit_encoder(df, "t", dim=8)
    for frame, texts in ((df, CORPUS), (other, new)):
        got = {r.id: r.e for r in K.embed_batch(frame, "t", "e", encoder=enc).collect()}
        assert len(got) == len(texts)
        for i, want in enumerate(encode(texts, 8, CORPUS)):
            assert all(math.isclose(x, y, abs_tol=1e-6) for x, y in zip(got[i], want)), (i, got[i], want)
    again = {r.id: r.e for r in K.embed_batch(other.repartition(3), "t", "e", encoder=K.fit_encoder(df.repartition(5), "t", dim=8)).collect()}
    assert all(math.isclose(x, y, abs_tol=1e-9) for i, e in again.items() for x, y in zip(e, {r.id: r.e for r in K.embed_batch(
        other, "t", "e", encoder=enc).collect()}[i]))


def test_default_encoder_spreads_frequent_words_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(CORPUS)), "id long, t string")
    want = {r.id: r.e for r in K.embed_weighted(df, "t", "e", dim=8).collect()}
    plain = K._word_sums
    monkeypatch.setattr(K, "_word_sums", lambda *a: plain(*a, broadcast_bytes=0))
    got = {r.id: r.e for r in K.embed_weighted(df, "t", "e", dim=8).collect()}
    assert all(math.isclose(x, y, abs_tol=1e-9) for i in want for x, y in zip(got[i], want[i])) and len(got) == len(want)


def test_default_encoder_sends_only_rare_words_to_a_shuffled_join(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(CORPUS)), "id long, t string")
    want = {r.id: r.e for r in K.embed_weighted(df, "t", "e", dim=8).collect()}
    plain, join, sums, sent = K._word_sums, K.split_hot_join, [], []

    def joined(left, right, key, *a, **kw):
        sent.extend(left.select("w").collect() if key == "w" else [])
        return join(left, right, key, *a, **kw)

    def summed(*a):
        sums.append(a)
        # room for the words found four times or more: the, and
        return plain(*a, broadcast_bytes=2 * (K.ENTRY_BYTES + 3))
    monkeypatch.setattr(K, "split_hot_join", joined)
    monkeypatch.setattr(K, "_word_sums", summed)
    got = {r.id: r.e for r in K.embed_weighted(df, "t", "e", dim=8).collect()}
    assert all(math.isclose(x, y, abs_tol=1e-9) for i in want for x, y in zip(got[i], want[i])) and len(got) == len(want)
    assert len(sums) == 1, "the texts' words are summed once, for the fit and the result"
    times = Counter(w for t in CORPUS for w in re.findall("[a-z]+", t or ""))
    rare = [w for t in {t for t in CORPUS if t} for w in set(re.findall("[a-z]+", t)) if times[w] < 4]
    assert sorted(r.w for r in sent) == sorted(rare)


def test_embeddings_of_texts_that_begin_or_end_between_words(spark):
    texts = ["<s>the cat</s>", " a bird, a cat ", "the cat", "-", "the bird"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: r.e for r in K.embed_batch(df, "t", "e", dim=8).collect()}
    for i, want in enumerate(encode(texts, 8)):
        assert all(math.isclose(x, y, abs_tol=1e-6) for x, y in zip(got[i], want)), (i, got[i], want)
    hashed = {r.id: r.e for r in K.embed_hashed(df, "t", "e", dim=8).collect()}
    assert all(math.isclose(sum(x * x for x in hashed[i]), float(i != 3)) for i in hashed)


def test_default_encoder_of_a_corpus_without_words(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "id long, t string")
    assert [r.e for r in K.embed_batch(df, "t", "e", dim=4).collect()] == [[0.0] * 4] * 2
    assert K.embed_batch(df.where("id > 2"), "t", "e", dim=4).collect() == []


def test_default_encoder_finds_thinned_copies_better_than_hashing(spark):
    docs = (spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null")
            .dropDuplicates(["text"]).select("doc_id", "text"))
    # a copy keeps about a tenth of the words, chosen by word and document
    thin = docs.select("doc_id", F.array_join(F.filter(K.words("text"), lambda w: F.pmod(
        F.xxhash64(w, F.col("doc_id")), F.lit(10)) == 0), " ").alias("text"))

    def found(embed):
        own, copies = ({r.doc_id: np.array(r.e) for r in embed(d).collect()} for d in (docs, thin))
        ids = sorted(own)
        near = np.argmax(np.stack([copies[i] for i in ids]) @ np.stack([own[i] for i in ids]).T, axis=1)
        return float(np.mean(near == np.arange(len(ids))))
    enc = K.fit_encoder(docs, "text")
    hashed, weighted = found(lambda d: K.embed_hashed(d, "text", "e")), found(lambda d: K.embed_batch(d, "text", "e", encoder=enc))
    assert weighted > hashed, (weighted, hashed)


def test_mean_pool_matches_brute_force(spark):
    toks = spark.createDataFrame([(1, [1, 5, 5, 0]), (2, [0, 0])], "id long, toks array<long>")
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (5, [3.0, 2.0])], "token_id long, vec array<float>")
    for bound in (0, K.BROADCAST_VECTOR_BYTES):
        r = {x.id: x.mean_vec for x in K.mean_pool(toks, "id", "toks", vec, dim=2, broadcast_bytes=bound).collect()}
        assert all(math.isclose(a, b) for a, b in zip(r[1], [7.0 / 3, 4.0 / 3]))
        assert r[2] == [0.0, 0.0]


def test_model_train_score_save_load(spark, tmp_path):
    rows = [(i, [float(i % 2), 1.0], [[float(i % 2), 0.0]], float(i % 2), 1.0) for i in range(40)]
    t = spark.createDataFrame(rows, "id long, x array<double>, graph_x array<array<double>>, label double, weight double")
    m = M.train_window(t)
    s = {r.id: r.prob for r in M.score_batch(m, t).collect()}
    assert s[1] > 0.5 > s[0]
    path = M.save_model(m, str(tmp_path), "run", 3)
    back = M.load_model(str(tmp_path), "run", 3)
    s2 = {r.id: r.prob for r in M.score_batch(back, t).collect()}
    assert s == s2 and path.endswith("/run/3")


def _newton_rows(n=400):
    """Overlapping classes, weights, and rows that take no part."""
    import random
    rng, rows = random.Random(3), []
    for i in range(n):
        a, b, c = (rng.gauss(0, 1) for _ in range(3))
        rows.append((i, [a, b], [[c, 0.0], [0.0, c]], float(a - b + c + rng.gauss(0, 1) > 0), rng.choice([0.5, 2.0])))
    return rows + [(n, None, [[0.0, 0.0]], 1.0, 1.0), (n + 1, [0.0, 0.0], [[0.0, 0.0]], None, 1.0)]


_NEWTON_SCHEMA = "id long, x array<double>, graph_x array<array<double>>, label double, weight double"


def test_newton_reaches_the_minimum_for_any_partitioning(spark):
    rows = _newton_rows()
    m, again = (M.train_newton(spark.createDataFrame(rows, _NEWTON_SCHEMA).repartition(p)) for p in (1, 7))
    assert m.last_step < 1e-9 and np.allclose(m.weights, again.weights, rtol=0, atol=1e-12)
    # the gradient, worked out row by row, vanishes there
    grad, total = [0.0] * 5, 0.0
    for _, x, g, y, w in rows[:-2]:
        f = [1.0, *x, g[0][0] / 2, g[1][1] / 2]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(f, (m.intercept, *m.weights)))))
        total += w
        grad = [s + w * (p - y) * v for s, v in zip(grad, f)]
    grad = [s / total + (0.01 * b if i else 0) for i, (s, b) in enumerate(zip(grad, (m.intercept, *m.weights)))]
    assert max(map(abs, grad)) < 1e-12


def test_newton_agrees_with_lbfgs_without_penalty(spark):
    t = spark.createDataFrame(_newton_rows()[:-2], _NEWTON_SCHEMA).withColumn("graph_x", F.expr("slice(graph_x, 1, 1)"))
    t = t.withColumn("x", F.expr("slice(x, 1, 1)")).withColumn("graph_x", F.expr("transform(graph_x, g -> slice(g, 1, 1))"))
    a = {r.id: r.prob for r in M.score_batch(M.train_newton(t, reg=0.0), t).collect()}
    b = {r.id: r.prob for r in M.score_batch(M.train_window(t, reg=0.0, max_iter=200), t).collect()}
    assert max(abs(a[i] - b[i]) for i in a) < 1e-3


def test_newton_saved_empty_and_refused(spark, tmp_path):
    t = spark.createDataFrame(_newton_rows(), _NEWTON_SCHEMA)
    m = M.train_newton(t, weight=None, steps=3)
    M.save_model(m, str(tmp_path), "run", 1)
    assert M.load_model(str(tmp_path), "run", 1, M.NewtonModel) == m
    nothing = M.train_newton(t.where("id < 0"))
    assert nothing == M.NewtonModel(0.0, (), 0.0)
    assert {r.prob for r in M.score_batch(nothing, t).collect()} == {0.5, None}
    with pytest.raises(ValueError, match="2 to 4"):
        M.train_newton(t.unionByName(spark.createDataFrame([(-1, [1.0], [[1.0]], 1.0, 1.0)], _NEWTON_SCHEMA)))
    with pytest.raises(ValueError, match="NaN"):
        M.train_newton(t.unionByName(spark.createDataFrame([(-1, [math.nan, 1.0], [[1.0, 1.0]], 1.0, 1.0)], _NEWTON_SCHEMA)))


def test_tokenise_with_caller_tokenizer(spark):
    df = spark.createDataFrame([(1, "ab c"), (2, None)], "id long, t string")

    def factory():
        return lambda s: [len(w) for w in s.split()]
    r = {x.id: x.t_tokens for x in K.tokenise_with(df, "t", factory).collect()}
    assert r == {1: [2, 1], 2: []}


def test_score_with_foreign_model(spark):
    def factory():
        def predict(x):
            return x * 0.5
        return predict
    df = spark.createDataFrame([(1, 2.0), (2, 4.0)], "id long, v double")
    r = {x.id: x.prob for x in M.score_with(df, factory, ["v"]).collect()}
    assert r == {1: 1.0, 2: 2.0}


def test_describe_approx_close_to_exact(spark):
    from citesight.operators import describe as D
    df = spark.range(0, 1001).selectExpr("cast(id as double) as v")
    e = D.describe_column(df, "v").collect()[0]
    a = D.describe_column(df, "v", approx=True).collect()[0]
    assert e.p50 == 500.0 and abs(a.p50 - 500.0) <= 1.0


def test_length_feature_rejects_other_types(spark):
    import pytest

    from citesight.operators import filters as P
    df = spark.createDataFrame([(1, 2.0)], "id long, v double")
    with pytest.raises(TypeError):
        P.length_feature(df, ["v"])


def test_mean_pool_of_shared_vectors(spark):
    # three vectors for seven tokens: the pad is left out by its token, not by its slot
    toks = spark.createDataFrame([(1, [1, 3, 4, 6, 0]), (2, [0, 0]), (3, [5, 5, 2])], "id long, toks array<long>")
    vec = spark.createDataFrame([(0, [3.0, 0.0]), (1, [0.0, 6.0]), (2, [1.0, 1.0])], "token_id long, vec array<float>")
    for bound in (0, K.BROADCAST_VECTOR_BYTES):
        got = {r.id: r.mean_vec for r in K.mean_pool(toks, "id", "toks", vec, 2, broadcast_bytes=bound, slot=lambda t: t % 3).collect()}
        assert got == {1: [1.5, 3.0], 2: [0.0, 0.0], 3: [1.0, 1.0]}


def test_pooled_vectors_are_read_as_many_as_there_are(spark):
    # the table that K5 broadcasts has a row per vector, not per word of the corpus
    import tempfile
    from citesight.plans.catalog.text import token_vectors
    path = tempfile.mkdtemp(prefix="citesight-test-")
    spark.createDataFrame([(i, [float(i)] * 2) for i in range(3)], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    vectors, slot = token_vectors(spark, path)
    assert vectors.count() == 3
    assert [r.s for r in spark.range(7).select("id", slot(F.col("id")).alias("s")).orderBy("id").collect()] == [0, 1, 2, 0, 1, 2, 0]


def test_mean_pool_reads_its_tokens_once(spark):
    # a costly token frame is not worked out again for its lists, weights and means, nor sorted or sent whole
    toks = spark.createDataFrame([(i, [1, 2, 2, i % 3]) for i in range(30)] * 2, "id long, toks array<long>")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<long>")
    def costly(x):
        seen.add(1)
        return x
    vec = spark.createDataFrame([(i, [float(i), 1.0]) for i in (1, 2)] * 2, "token_id long, vec array<float>")  # rows twice
    got = K.mean_pool(toks.select("id", costly.asNondeterministic()("toks").alias("toks")), "id", "toks", vec, 2).collect()
    assert len(got) == 60 and seen.value == 60
    assert all(abs(r.mean_vec[0] - [5 / 3, 6 / 4, 7 / 4][r.id % 3]) < 1e-12 and r.mean_vec[1] == 1.0 for r in got)


def test_mean_pool_of_a_list_that_no_id_has_very_often(spark, monkeypatch):
    monkeypatch.setattr(K, "SAME_ROWS", 4)
    toks = spark.createDataFrame([(None, [1])] * 11 + [(None, None)] * 5 + [(7, [2, 2])] * 4, "id long, toks array<long>")
    vec = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "token_id long, vec array<float>")
    for bound in (0, 60, K.BROADCAST_VECTOR_BYTES):  # shuffled, the most frequent broadcast, broadcast
        got = sorted(((r.id or 0, r.mean_vec[0]) for r in K.mean_pool(toks, "id", "toks", vec, 1, broadcast_bytes=bound).collect()))
        assert got == [(0, 0.0)] * 5 + [(0, 1.0)] * 11 + [(7, 2.0)] * 4


def test_tokens_of_frequent_and_rare_words(spark):
    rows = [(i, "often " * (i % 4) + f"Rare{i} often, unheard") for i in range(20)] + [(98, None), (99, " .")]
    df = spark.createDataFrame(rows, "id long, t string")
    v = K.build_vocab(df, "t").where("token <> 'unheard'")
    ids = {r.token: r.token_id for r in v.collect()}
    whole = {r.id: r.t_tokens for r in K.tokenise(df, "id", "t", v).collect()}
    for bound in (0, 60):
        got = {r.id: r.t_tokens for r in K.tokenise(df, "id", "t", v, broadcast_bytes=bound).collect()}
        assert got == whole
    assert whole[6] == [1, ids["often"], ids["often"], ids["rare6"], ids["often"], 3, 2] and whole[98] == [] and whole[99] == [1, 2]


def test_mean_pool_of_missing_and_odd_vectors(spark):
    toks = spark.createDataFrame([(1, [1, 2]), (2, [2])], "id long, toks array<long>")
    for bound in (0, K.BROADCAST_VECTOR_BYTES):
        vec = spark.createDataFrame([(1, [3.0, 1.0]), (2, None)], "token_id long, vec array<float>")
        got = {r.id: r.mean_vec for r in K.mean_pool(toks, "id", "toks", vec, 2, broadcast_bytes=bound).collect()}
        assert got == {1: [3.0, 1.0], 2: [0.0, 0.0]}
        for bad in ([1.0], [1.0, None]):
            with pytest.raises(Exception, match="has not 2 numbers"):
                odd = spark.createDataFrame([(1, [3.0, 1.0]), (2, bad)], "token_id long, vec array<float>")
                K.mean_pool(toks, "id", "toks", odd, 2, broadcast_bytes=bound).collect()
