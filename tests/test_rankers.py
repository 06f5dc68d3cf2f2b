"""Rankers on sparse pair features and from preferences: against dense forms and all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from docketry.operators import classify, metrics, pairwise, represent
from docketry.plans import views
from docketry.session import materialise, new_path

QUERIES = contract.queries()


def weights(spark):
    rng = np.random.default_rng(3)
    rows = [(d, t, float(rng.random() + (2 if (t == "b") == (d % 2) else 0))) for d in range(40) for t in "abcde" if rng.random() < 0.7]
    return spark.createDataFrame(rows, "doc_id long, term string, value double")


def all_pairs(spark):
    return spark.createDataFrame([(c, d, int(d % 2)) for c in range(0, 40, 8) for d in range(40) if d != c] + [(0, 99, 0)], "case_id long, candidate_id long, rel int")


def test_terms_are_numbered_in_order(spark):
    values = spark.createDataFrame([(1, t, 1.0) for t in ("é", "b", "a", "b", None)], "doc_id int, term string, value double")
    assert {r.term: r.number for r in represent.term_numbers(values).collect()} == {"a": 0, "b": 1, "é": 2}
    assert represent.term_numbers(values.limit(0)).count() == 0


def test_sparse_vectors_hold_both_documents(spark):
    values, pairs = weights(spark), all_pairs(spark)
    by_doc = {}
    for r in values.collect():
        by_doc.setdefault(r.doc_id, {})["abcde".index(r.term)] = r.value
    rows = represent.sparse_pair_vectors(pairs, values).collect()
    assert len(rows) == pairs.count()
    for r in rows:
        wanted = by_doc.get(r.case_id, {}) | {i + 5: v for i, v in by_doc.get(r.candidate_id, {}).items()}
        assert r.features.size == 10 and dict(zip(r.features.indices.tolist(), r.features.values.tolist())) == wanted


def test_terms_of_the_training_set_number_others(spark):
    values, pairs = weights(spark), all_pairs(spark).limit(30)
    numbers = represent.term_numbers(values.filter("term < 'c'"))
    assert {r.features.size for r in represent.sparse_pair_vectors(pairs, values, numbers).collect()} == {4}
    assert represent.sparse_pair_vectors(pairs.limit(0), values).count() == 0


@pytest.mark.parametrize("fit", [classify.logistic_rank, classify.svm_rank])
def test_sparse_rankers_agree_with_dense_ones(spark, fit):
    sparse = represent.sparse_pair_vectors(all_pairs(spark), weights(spark))
    to_array = F.udf(lambda v: v.toArray().tolist(), "array<double>")
    dense = materialise(sparse.withColumn("features", to_array("features")))
    one, two = fit(sparse, cs=(1.0,)), fit(dense, cs=(1.0,))
    got, wanted = ({(r.case_id, r.candidate_id): r for r in classify.predict(m, rows).collect()} for m, rows in ((one, sparse), (two, dense)))
    assert np.mean([got[k].score == wanted[k].score for k in wanted]) > 0.98
    if fit is classify.logistic_rank:
        assert max(abs(got[k].raw_score - wanted[k].raw_score) for k in wanted) < 1e-3
    path = new_path(spark, "sparse")
    classify.save_ranker(one, path)
    again = classify.predict(classify.load_ranker(path), sparse).collect()
    assert {(r.case_id, r.candidate_id): r.score for r in again} == {k: r.score for k, r in got.items()}


def test_sparse_query_scores_every_pair(spark, sf_dir):
    rows = QUERIES["logistic_rank_sparse"](spark, sf_dir).collect()
    pairs = views.text_pairs(spark, sf_dir).select("case_id", "candidate_id", "rel").collect()
    assert sorted(r[:3] for r in rows) == sorted(tuple(p) for p in pairs)
    assert len({r.raw_score for r in rows}) > 10


# ---- preferences --------------------------------------------------------------------------------------------


def preferences(spark, n=120, width=3, cases=4, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    rel = (x @ np.arange(1, width + 1) + rng.normal(size=n) > 1).astype(int)
    case = np.where(rng.random(n) < 0.5, 0, rng.integers(1, cases, n))
    rows = [(None if c == 1 else int(c), i, v.tolist(), int(r)) for i, (c, v, r) in enumerate(zip(case, x, rel))]
    return rows, spark.createDataFrame(rows, "case_id int, candidate_id int, features array<double>, rel int")


def brute(rows, w):
    loss, gradient, pairs = 0.0, np.zeros(len(w)), 0
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[3] > 0 >= b[3]:
                d = np.array(a[2]) - np.array(b[2])
                slack = max(0.0, 1 - w @ d)
                loss, gradient, pairs = loss + slack**2, gradient - 2 * slack * d, pairs + 1
    return loss, gradient, pairs


@pytest.mark.parametrize("scale", [0.0, 0.3, 2.0])
def test_gradient_equals_all_pairs(spark, scale):
    rows, df = preferences(spark)
    table = df.select(F.col("candidate_id").alias("row"), "case_id", (F.col("rel") > 0).alias("positive"), F.col("features").alias("x"))
    w = scale * np.array([1.0, -0.5, 2.0])
    loss, gradient, pairs = pairwise.measured(table, w)
    wanted = brute(rows, w)
    assert (loss, pairs) == (pytest.approx(wanted[0]), wanted[2]) and gradient == pytest.approx(wanted[1])


def test_descent_finds_the_least_value():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(6, 6))
    a, b = a @ a.T + 0.01 * np.eye(6), rng.normal(size=6)
    x, f, g, calls = pairwise.descend(lambda x: (x @ a @ x / 2 - b @ x, a @ x - b), np.zeros(6), 200, 1e-8)
    assert x == pytest.approx(np.linalg.solve(a, b), rel=1e-4) and calls < 200


def test_training_lowers_the_loss_and_orders_pairs(spark):
    rows, df = preferences(spark)
    model = pairwise.pairwise_rank(df, c=10.0)
    w = np.array(model.weights)
    pairs = brute(rows, w)[2]
    value = lambda w: w @ w / 2 + 10.0 / pairs * brute(rows, w)[0]
    assert model.gap <= 1e-3 and value(w) < 0.6 * value(0 * w)
    assert all(value(w + step) >= value(w) - 1e-3 for step in 0.05 * np.vstack([np.eye(3), -np.eye(3)]))
    run = pairwise.rank(model, df)
    before = metrics.ordered_pair_accuracy(df.withColumn("score", F.lit(0.0) + F.col("candidate_id") * 1.0)).first().opa
    assert metrics.ordered_pair_accuracy(run).first().opa > max(before, 0.8)


def test_odd_preferences(spark):
    rows = [(1, 1, [1.0], 1), (1, 2, [0.0], 0), (1, 3, None, 1), (2, 4, [5.0], 1), (3, 5, [9.0], None), (None, 6, [0.0], 0)]
    df = spark.createDataFrame(rows, "case_id int, candidate_id int, features array<double>, rel int")
    assert pairwise.pairwise_rank(df, c=5.0).weights[0] > 0.5
    assert pairwise.pairwise_rank(df.filter("case_id = 2")).weights == [0.0]
    assert pairwise.pairwise_rank(df.limit(0)).weights == []


def test_pairwise_query_ranks_better_than_the_cosine(spark, sf_dir):
    run = materialise(QUERIES["pairwise_rank"](spark, sf_dir))
    pairs = views.emb_pairs(spark, sf_dir)
    assert run.count() == pairs.count() and run.columns == ["case_id", "candidate_id", "rel", "score"]
    plain = QUERIES["cosine_rank"](spark, sf_dir)
    better, cosine = (metrics.ordered_pair_accuracy(r.select("case_id", "candidate_id", "rel", "score")).first().opa for r in (run, plain))
    assert better > cosine
