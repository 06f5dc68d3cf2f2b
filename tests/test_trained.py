"""Queries that SQL can't express: whole results, and what must hold for a trained model or a truncated SVD."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from docketry.operators import classify, metrics, represent
from docketry.plans import views
from docketry.plans.rank import balanced_sides
from docketry.plans.represent import tfidf_values
from docketry.session import materialise

QUERIES = contract.queries()
SCORED = ["case_id", "candidate_id", "rel", "score", "raw_score"]


@pytest.fixture(scope="module")
def sides(spark, sf_dir):
    pairs, train, test = balanced_sides(spark, sf_dir)
    return pairs, materialise(train), materialise(test)


def scores_of(df):
    return {(r.case_id, r.candidate_id, r.rel): (r.score, r.raw_score) for r in df.collect()}


def same_pairs(df, spark, sf_dir):
    assert df.columns == SCORED
    rows, pairs = df.collect(), views.emb_pairs(spark, sf_dir).select("case_id", "candidate_id", "rel").collect()
    assert sorted(r[:3] for r in rows) == sorted(tuple(p) for p in pairs)
    assert {r.score for r in rows} <= {0.0, 1.0}


def training_matrix(train):
    rows = train.select("case_id", "features", "rel").collect()
    x = np.hstack([np.array([r.features for r in rows]), np.ones((len(rows), 1))])
    return x, np.array([2.0 * r.rel - 1 for r in rows])


def dense_hinge(x, y, c, sweeps=3000):
    """Objective and lower bound by plain dual coordinate ascent, one row after the other."""
    dual, w, squares = np.zeros(len(x)), np.zeros(x.shape[1]), (x * x).sum(1)
    for _ in range(sweeps):
        for i in range(len(x)):
            new = min(max(dual[i] + (1 - y[i] * (x[i] @ w)) / squares[i], 0.0), c)
            if new != dual[i]:
                w += (new - dual[i]) * y[i] * x[i]
                dual[i] = new
        objective = w @ w / 2 + c * np.maximum(1 - y * (x @ w), 0).sum()
        bound = dual.sum() - w @ w / 2
        if objective - bound < 1e-5 * objective:
            break
    return objective, bound


def fitted_weights(model):
    return np.array([*model.weights, model.intercept])


def test_logistic_regression_scores_every_pair(spark, sf_dir):
    same_pairs(QUERIES["logistic_rank"](spark, sf_dir), spark, sf_dir)


def test_svm_searches_the_default_grid_and_scores_every_pair(spark, sf_dir, monkeypatch):
    tried, search = [], classify.search
    monkeypatch.setattr(classify, "search", lambda *args, **o: tried.append(search(*args, **o)) or tried[-1])
    same_pairs(QUERIES["svm_rank"](spark, sf_dir), spark, sf_dir)
    (model,) = tried
    assert set(model.accuracy) == set(classify.SVM_C) and len(classify.SVM_C) == 6
    assert model.gap <= 1e-3 and model.accuracy[model.c] == max(model.accuracy.values())


@pytest.mark.parametrize("block_rows", [4096, 150])
def test_hinge_loss_is_within_its_certificate(sides, block_rows):
    x, y = training_matrix(sides[1])
    for c in (1e-4, 1e-1):
        model = classify.svm_rank(sides[1], cs=(c,), block_rows=block_rows)
        w = fitted_weights(model)
        objective = w @ w / 2 + c * np.maximum(1 - y * (x @ w), 0).sum()
        best, bound = dense_hinge(x, y, c)
        assert model.gap <= 1e-3
        assert bound * (1 - 1e-9) <= objective <= best + 1.1e-3 * objective


def test_logistic_loss_is_least_at_the_fit(sides):
    x, y = training_matrix(sides[1])
    for c in (0.01, 0.5):
        model = classify.logistic_rank(sides[1], cs=(c,), block_rows=200)
        w = fitted_weights(model)
        value = lambda w: np.abs(w[:-1]).sum() + c * np.logaddexp(0, -y * (x @ w)).sum()
        assert model.gap <= 1e-3
        for j in range(len(w)):
            for step in (-0.01, 0.01):
                assert value(w + step * (np.arange(len(w)) == j)) >= value(w) - 1e-4


def test_search_is_cross_validation_by_case(spark, sides):
    """Accuracy of every C as from fits on all folds but one, each by itself."""
    train = sides[1]
    model = classify.svm_rank(train, cs=(1e-2, 1e-1), folds=2)
    fold = F.pmod(F.xxhash64(F.lit(0), "case_id"), F.lit(2))
    for c in (1e-2, 1e-1):
        right = []
        for k in range(2):
            inside, outside = train.filter(fold != k), train.filter(fold == k)
            if not outside.count():
                continue
            alone = classify.svm_rank(inside, cs=(c,))
            right.append(classify.predict(alone, outside).agg(F.avg((F.col("score") == F.col("rel")).cast("int"))).first()[0])
        assert model.accuracy[c] == pytest.approx(np.mean(right), abs=0.02)


def test_odd_training_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 0), (2, None, 1), (3, [1.0, 1.0], None), (None, [2.0, 0.0], 1), (1, [0.0, 1.0], 0)]
    train = spark.createDataFrame(rows, "case_id int, features array<double>, rel int")
    for fit in (classify.svm_rank, classify.logistic_rank):
        model = fit(train, cs=(1.0, 10.0))
        scored = classify.predict(model, train.filter("features IS NOT NULL AND rel IS NOT NULL")).collect()
        assert all(r.score == r.rel for r in scored)
    one_class = classify.svm_rank(train.filter("rel = 1"), cs=(1.0,))
    assert [r.score for r in classify.predict(one_class, train.filter("case_id = 1 AND rel = 1")).collect()] == [1.0]
    with pytest.raises(ValueError):
        classify.svm_rank(train.limit(0), cs=(1.0,))
    with pytest.raises(ValueError):
        classify.svm_rank(train.withColumn("rel", F.lit(3)), cs=(1.0,))


def test_grid_search_returns_the_confusion_matrix(spark, sf_dir, sides):
    _, train, test = sides
    df = QUERIES["grid_search"](spark, sf_dir)
    assert df.columns == ["tn", "fp", "fn", "tp", "accuracy"]
    got = df.first()
    model = classify.grid_search(train, "logistic", (0.01, 0.1))
    rows = classify.predict(model, test).select("rel", "score").collect()
    cells = [sum((r.rel == y) and (r.score == p) for r in rows) for y, p in ((0, 0), (0, 1), (1, 0), (1, 1))]
    assert [got.tn, got.fp, got.fn, got.tp] == cells
    sizes = {r.rel: r["count"] for r in test.groupBy("rel").count().collect()}
    assert (got.tn + got.fp, got.fn + got.tp) == (sizes[0], sizes[1])
    # a model that says one class always must not give the same matrix
    assert metrics.confusion_matrix(test.withColumn("score", F.lit(1.0)), 0.5).first() != got


def test_saved_ranker_scores_as_the_one_in_memory(spark, sf_dir, sides):
    pairs, train, _ = sides
    df = QUERIES["save_ranker"](spark, sf_dir)
    same_pairs(df, spark, sf_dir)
    kept = scores_of(classify.predict(classify.logistic_rank(train, cs=(1.0,)), pairs).select(*SCORED))
    read = scores_of(df)
    assert read.keys() == kept.keys()
    assert all(read[k] == pytest.approx(kept[k], abs=1e-6) for k in kept)


def test_lsa_returns_twenty_components_per_document(spark, sf_dir):
    df = QUERIES["lsa"](spark, sf_dir)
    assert df.columns == ["doc_id", "component", "value"]
    found = {}
    for r in df.collect():
        found.setdefault(r.doc_id, {})[r.component] = r.value
    values = materialise(tfidf_values(spark, sf_dir))
    weights = {r.doc_id: r.w for r in values.groupBy("doc_id").agg(F.sum(F.col("value") * F.col("value")).alias("w")).collect()}
    assert found.keys() == weights.keys() and all(set(v) == set(range(20)) for v in found.values())
    x = np.array([[found[d][i] for i in range(20)] for d in sorted(found)])
    _, singular = represent.lsa(values, k=20)
    # no vector is longer than its weights; components are orthogonal, with descending singular values as lengths
    assert ((x * x).sum(1) <= np.array([weights[d] for d in sorted(weights)]) + 1e-6).all()
    gram = x.T @ x
    assert np.abs(gram - np.diag(np.square(singular))).max() < 1e-6 * max(singular) ** 2
    assert (np.diff(singular) <= 1e-9).all() and np.square(singular).sum() <= sum(weights.values()) + 1e-6
