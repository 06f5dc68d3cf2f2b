"""Representations and rankers against numpy and plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.functions.text import bm25_tokens
from docketry.operators import represent, score
from docketry.plans.represent import letter_encoder

WORDS = "court appeal judge law case motion order party claim right duty fact evidence witness trial".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    texts = {i: " ".join(rng.choices(WORDS, weights=range(1, 16), k=rng.randrange(3, 40))) for i in range(30)}
    texts[29] = ""
    return texts, spark.createDataFrame(list(texts.items()), "doc_id BIGINT, text STRING")


@pytest.fixture(scope="module")
def pairs(spark):
    """Documents 0 and 1 are queries; candidates are shared between them and lists are ragged."""
    rows = [(0, i, i % 2) for i in range(2, 30)] + [(1, i, 0) for i in range(10, 15)]
    return rows, spark.createDataFrame(rows, "case_id BIGINT, candidate_id BIGINT, rel INT")


def test_tfidf(spark, corpus):
    texts, docs = corpus
    counts = represent.term_counts(docs)
    got = {(r.doc_id, r.term): r.value for r in represent.tfidf(counts, docs, min_df=2, max_df=0.6).collect()}
    bags = {i: Counter(re.findall("[a-z]{2,}", t)) for i, t in texts.items()}
    df = Counter(t for b in bags.values() for t in b)
    kept = {t for t, n in df.items() if 2 <= n <= 0.6 * len(texts)}
    assert kept != set(df)
    want = {}
    for i, bag in bags.items():
        w = {t: f * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, f in bag.items() if t in kept}
        size = math.sqrt(sum(v * v for v in w.values()))
        want.update({(i, t): v / size for t, v in w.items()})
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_max_features_keeps_the_most_frequent(spark, corpus):
    texts, docs = corpus
    totals = Counter(w for t in texts.values() for w in t.split())
    kept = represent.vocabulary(represent.term_counts(docs), docs, 1, 1.0, max_features=4)
    want = sorted(totals, key=lambda t: (-totals[t], t))[:4]
    assert {r.term for r in kept.collect()} == set(want)


def matrix_of(rows, value):
    terms = sorted({r.term for r in rows})
    ids = sorted({r.doc_id for r in rows})
    m = np.zeros((len(ids), len(terms)))
    for r in rows:
        m[ids.index(r.doc_id), terms.index(r.term)] = r[value]
    return ids, m


def test_lsa_equals_a_dense_svd(spark, corpus):
    _, docs = corpus
    values = represent.tfidf(represent.term_counts(docs), docs, 1, 1.0)
    vectors, singular = represent.lsa(values, k=4, iterations=6, oversample=6)
    ids, m = matrix_of(values.collect(), "value")
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    assert singular == pytest.approx(list(s[:4]), rel=1e-4)
    got = {r.doc_id: np.array(r.vector) for r in vectors.collect()}
    ours = np.stack([got[i] for i in ids])
    best = u[:, :4] * s[:4]
    assert np.allclose(ours @ ours.T, best @ best.T, atol=1e-3)
    assert (ours.sum(axis=0) >= 0).all()


def test_dense_cosine_and_zero_vectors(spark):
    vectors = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])], "doc_id BIGINT, vector ARRAY<DOUBLE>"
    )
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "case_id BIGINT, candidate_id BIGINT")
    got = {r.candidate_id: r.score for r in score.cosine_rank(pairs, vectors).collect()}
    assert got == {2: pytest.approx(1 / math.sqrt(2)), 3: 0.0}


def test_sparse_cosine_scores_every_pair(spark, corpus, pairs):
    texts, docs = corpus
    rows, pair_df = pairs
    counts = represent.term_counts(docs)
    got = {(r.case_id, r.candidate_id): r.score for r in score.sparse_cosine_rank(pair_df, counts, "tf").collect()}
    bags = {i: Counter(t.split()) for i, t in texts.items()}
    for case, candidate, _ in rows:
        a, b = bags[case], bags[candidate]
        dot = sum(a[t] * b[t] for t in a)
        size = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        assert got[case, candidate] == pytest.approx(dot / size if size else 0.0)


def test_bm25_uses_the_candidates_of_each_case_as_corpus(spark, corpus, pairs):
    texts, docs = corpus
    rows, pair_df = pairs
    run = score.bm25_rank(pair_df, represent.term_counts(docs, bm25_tokens))
    got = {(r.case_id, r.candidate_id): r.score for r in run.collect()}
    assert len(got) == len(rows)
    for case in (0, 1):
        members = [c for q, c, _ in rows if q == case]
        bags = {c: Counter(texts[c].split()) for c in members}
        n, avg = len(members), sum(sum(b.values()) for b in bags.values()) / len(members)
        df = Counter(t for b in bags.values() for t in b)
        idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
        mean = sum(idf.values()) / len(idf)
        assert any(v < 0 for v in idf.values())
        for c, bag in bags.items():
            total = 0.0
            for t in texts[case].split():
                if t in bag:
                    w = idf[t] if idf[t] >= 0 else 0.25 * mean
                    total += w * bag[t] * 2.5 / (bag[t] + 1.5 * (0.25 + 0.75 * sum(bag.values()) / avg))
            assert got[case, c] == pytest.approx(total)


def test_no_shuffle_by_term_in_sparse_cosine(spark, corpus, pairs):
    _, docs = corpus
    run = score.sparse_cosine_rank(pairs[1], represent.term_counts(docs), "tf")
    joins = [line for line in run._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("term" in line for line in joins)


def test_a_hot_case_is_split_by_the_join(spark):
    """With a third of the pairs in one case the adaptive plan splits that join partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        ids = spark.range(20000, numPartitions=4)
        pairs = ids.select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997).alias("case_id"),
            F.col("id").alias("candidate_id"),
        )
        vectors = ids.select(
            F.col("id").alias("doc_id"), F.array(F.sin("id"), F.cos("id"), F.lit(1.0)).alias("vector")
        )
        run = score.cosine_rank(pairs, vectors)
        assert run.agg(F.count("score")).first()[0] == 20000
        run.write.format("noop").mode("overwrite").save()
        run.collect()
        assert "skew=true" in run._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_pair_encoder_sees_both_texts(spark):
    rows = [(1, "a b", 2, "c c"), (1, "a b", 3, "")]
    df = spark.createDataFrame(rows, "case_id INT, case_text STRING, candidate_id INT, candidate_text STRING")
    got = {r.candidate_id: r.features for r in represent.pair_encode(df, letter_encoder).collect()}
    want = letter_encoder()([r[1] for r in rows], [r[3] for r in rows])
    assert got == {2: want[0].tolist(), 3: want[1].tolist()}


def test_runs_are_joined_by_pair(spark):
    run = "case_id INT, candidate_id INT, score DOUBLE, rel INT"
    a = spark.createDataFrame([(1, 1, 0.5, 1), (1, 2, 0.0, 0)], run)
    b = spark.createDataFrame([(1, 1, 0.7, 0)], run)
    assert [tuple(r) for r in score.fuse_runs(a, b, a).collect()] == [(1, 1, 0.5, 0.7, 1)]
    merged = {r.candidate_id: (r.score_01, r.score_02, r.rel) for r in score.rerank_merge(a, b).collect()}
    assert merged == {1: (0.5, 0.7, 1), 2: (0.0, None, 0)}
    logs = {r.candidate_id: r.new_score for r in score.log_score(a, "score").collect()}
    assert logs == {1: pytest.approx(math.log(0.5)), 2: float("-inf")}


def test_scores_unfold_by_ascending_candidate(spark):
    pairs = spark.createDataFrame([(1, 30), (1, 4), (2, 9), (2, 10), (2, 11)], "case_id BIGINT, candidate_id BIGINT")
    lists = spark.createDataFrame([(1, [0.1, 0.2, 0.0]), (2, [0.3, 0.4])], "case_id BIGINT, scores ARRAY<DOUBLE>")
    got = {(r.case_id, r.candidate_id): r.score for r in score.unfold_scores(lists, pairs).collect()}
    assert got == {(1, 4): 0.1, (1, 30): 0.2, (2, 9): 0.3, (2, 10): 0.4, (2, 11): None}
