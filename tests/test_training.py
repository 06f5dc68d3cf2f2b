"""Splits, balancing, neighbours, lists and trained rankers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.operators import classify, neighbours, training
from docketry.session import new_path

KEYS = ["case_id", "candidate_id"]
ROWS = "case_id BIGINT, candidate_id BIGINT, features ARRAY<DOUBLE>, rel INT"


def labelled(spark, rows=200, seed=2, share=0.15, size=3):
    rng = random.Random(seed)
    data = [
        (rng.randrange(12), i, [rng.gauss(0, 1) for _ in range(size)], int(rng.random() < share)) for i in range(rows)
    ]
    return data, spark.createDataFrame(data, ROWS)


def test_no_case_on_both_sides(spark):
    _, rows = labelled(spark)
    split = training.grouped_split(rows, 0.75).collect()
    sides = {s: {r.case_id for r in split if r.side == s} for s in ("train", "test")}
    assert not sides["train"] & sides["test"]
    assert (len(sides["train"]), len(sides["test"])) == (9, 3)


def test_holdout_keeps_every_row(spark):
    data, rows = labelled(spark)
    ids = spark.createDataFrame([(1,), (1,), (5,), (99,)], "case_id BIGINT")
    train, test = training.holdout_split(rows, ids)
    assert {r.case_id for r in test.collect()} == {1, 5}
    assert train.count() + test.count() == len(data)


@pytest.mark.parametrize("ratio", [1.0, 0.25, 0.01])
def test_oversampling_reaches_the_ratio(spark, ratio):
    data, rows = labelled(spark)
    many, few = sum(not r[3] for r in data), sum(r[3] for r in data)
    out = training.oversample(rows, KEYS, ratio).collect()
    assert sum(not r.rel for r in out) == many
    assert sum(r.rel for r in out) == max(few, int(ratio * many))
    assert len({(r.case_id, r.candidate_id, r.copy) for r in out}) == len(out)
    copies = [sum(1 for r in out if r.candidate_id == c) for c in {r.candidate_id for r in out if r.rel}]
    assert max(copies) - min(copies) <= 1


def test_neighbours_equal_brute_force(spark):
    data, rows = labelled(spark, 120)
    points = rows.withColumnRenamed("features", "vector")
    near = training.nearest_neighbours(points, KEYS, k=3).collect()
    x = np.array([r[2] for r in data])
    for r in near:
        distance = np.round(np.linalg.norm(x - x[r.candidate_id], axis=1), 6)
        distance[r.candidate_id] = np.inf
        order = sorted(range(len(data)), key=lambda i: (distance[i], data[i][0], i))
        assert r.nn_candidate_id == order[r.nn - 1]
    assert len(near) == 360


def test_smote_balances_on_segments(spark):
    data, rows = labelled(spark)
    out = training.smote(rows, KEYS).collect()
    assert sum(r.rel for r in out) == sum(1 - r.rel for r in out)
    minority = np.array([r[2] for r in data if r[3]])
    for r in out:
        if r.copy:
            start = np.array(data[r.candidate_id][2])
            made = np.array(r.features)
            assert data[r.candidate_id][3] == 1
            # on a segment from its point to some other minority point
            to = minority - start
            step = made - start
            along = [np.linalg.norm(np.cross(step, t)) < 1e-9 and 0 <= step @ t <= t @ t for t in to]
            assert any(along)


def test_high_scores_are_strictly_above(spark):
    run = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.91)], "case_id INT, candidate_id INT, score DOUBLE")
    pairs = spark.createDataFrame([(1, 1, "a", 0), (1, 2, "b", 1)], "case_id INT, candidate_id INT, candidate_text STRING, rel INT")
    assert [tuple(r) for r in training.high_score_subset(run, pairs).collect()] == [(1, 2, "b", 1)]


def test_ragged_lists_are_trimmed_and_padded(spark):
    data = [(1, i, [float(i)], i % 2) for i in range(3)] + [(2, i, [float(i)], 1) for i in range(5)]
    lists = {r.qid: r for r in training.ltr_lists(spark.createDataFrame(data, ROWS), 4, 1).collect()}
    assert lists[1].labels == [0.0, 1.0, 0.0, -1.0]
    assert lists[1].features == [[0.0], [1.0], [2.0], [0.0]]
    assert lists[2].labels == [1.0] * 4 and lists[2].features[3] == [3.0]


def test_preference_sums_equal_all_pairs(spark):
    data, rows = labelled(spark, 80, share=0.4)
    got = {(r.case_id, r.feature): (r.pairs, r.difference) for r in training.preference_differences(rows).collect()}
    for case in {r[0] for r in data}:
        yes = [r[2] for r in data if r[0] == case and r[3]]
        no = [r[2] for r in data if r[0] == case and not r[3]]
        for f in range(3):
            if yes and no:
                total = sum(a[f] - b[f] for a in yes for b in no)
                assert got[case, f] == (len(yes) * len(no), pytest.approx(total))
            else:
                assert (case, f) not in got


def test_pair_stats_reports_ragged_lists(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "case_id INT, candidate_id INT")
    assert tuple(training.pair_stats(pairs).first()) == (2, 3, 1, 2, False)


@pytest.fixture(scope="module")
def separable(spark):
    rng = random.Random(4)
    data = []
    for i in range(300):
        rel = int(rng.random() < 0.5)
        data.append((i % 15, i, [rng.gauss(3 if rel else -3, 1), rng.gauss(0, 1)], rel))
    return spark.createDataFrame(data, ROWS)


@pytest.mark.parametrize("train", [
    lambda rows: classify.logistic_rank(rows, cs=(1.0,)),
    lambda rows: classify.svm_rank(rows, cs=(1e-2, 1e-1), folds=3),
])
def test_trained_rankers_learn_and_survive_saving(spark, separable, train):
    model = train(separable)
    path = new_path(spark, "model")
    classify.save_ranker(model, path)
    for m in (model, classify.load_ranker(path)):
        scored = classify.predict(m, separable).collect()
        assert {r.score for r in scored} == {0.0, 1.0}
        assert np.mean([r.score == r.rel for r in scored]) > 0.97


def test_penalty_matches_the_summed_loss_form():
    assert classify.regularisation(0.01, 200) == pytest.approx(0.5)


@pytest.mark.parametrize(("few", "equal"), [(1024, False), (1025, True), (1027, True), (2049, False)])
def test_smote_balances_around_the_block_size(spark, few, equal):
    rng = random.Random(few)
    point = lambda: [1.0, 2.0] if equal else [rng.random(), rng.random()]
    data = [(0, i, point(), int(i < few)) for i in range(few + 2054)]
    counts = {r.rel: r["n"] for r in training.class_counts(training.smote(spark.createDataFrame(data, ROWS), KEYS)).collect()}
    assert counts == {0: 2054, 1: 2054}


def brute_neighbours(x, k):
    out = {}
    for i in range(len(x)):
        distance = np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 6)
        distance[i] = np.inf
        order = np.lexsort((np.arange(len(x)), distance))[: min(k, len(x) - 1)]
        out[i] = {n + 1: (int(j), distance[j]) for n, j in enumerate(order)}
    return out


def found_neighbours(spark, x, k=5, **options):
    points = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "case_id INT, candidate_id INT, vector ARRAY<DOUBLE>")
    got = {i: {} for i in range(len(x))}
    for r in neighbours.nearest_neighbours(points, KEYS, k, **options).collect():
        assert r.neighbour == x[r.nn_candidate_id].tolist()
        got[r.candidate_id][r.nn] = (r.nn_candidate_id, r.distance)
    return got


@pytest.mark.parametrize(("n", "dims", "block_rows", "zones"), [(1, 2, 10, 9), (4, 2, 10, 9), (300, 2, 10, 4096), (900, 3, 40, 5), (400, 40, 50, 9)])
def test_neighbours_are_exact(spark, n, dims, block_rows, zones):
    x = np.random.default_rng(n).normal(size=(n, dims))
    x[: n // 3] = np.round(x[: n // 3])  # ties and equal points
    assert found_neighbours(spark, x, block_rows=block_rows, most_zones=zones, most_pivots=30) == brute_neighbours(x, 5)


def test_neighbours_of_many_equal_points(spark):
    x = np.random.default_rng(4).normal(size=(600, 2))
    x[100:400] = x[0]
    assert found_neighbours(spark, x, block_rows=30) == brute_neighbours(x, 5)


def test_neighbours_of_twenty_thousand_points_in_bounded_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20_000, 6)) + 5 * rng.normal(size=(40, 6))[rng.integers(40, size=20_000)]
    got = found_neighbours(spark, x, block_rows=512)
    for i in range(0, 20_000, 50):
        distance = np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 6)
        distance[i] = np.inf
        order = np.lexsort((np.arange(len(x)), distance))[:5]
        assert got[i] == {n + 1: (int(j), distance[j]) for n, j in enumerate(order)}
    assert all(len(g) == 5 for g in got.values())


def test_neighbours_of_odd_points(spark):
    kind = "case_id INT, candidate_id INT, vector ARRAY<DOUBLE>"
    assert neighbours.nearest_neighbours(spark.createDataFrame([], kind), KEYS).count() == 0
    rows = [(0, 0, None), (0, 1, [0.0]), (0, 2, [-0.0]), (0, 3, [3.0]), (None, 4, [1.0])]
    found = neighbours.nearest_neighbours(spark.createDataFrame(rows, kind), KEYS, k=2).collect()
    assert sorted((r.candidate_id, r.nn, r.nn_candidate_id) for r in found) == [(1, 1, 2), (1, 2, 4), (2, 1, 1), (2, 2, 4), (3, 1, 4), (3, 2, 1), (4, 1, 1), (4, 2, 2)]


def test_a_third_label_is_an_error(spark):
    rows = spark.createDataFrame([(0, i, [1.0], v) for i, v in enumerate((0, 1, 2))], ROWS)
    with pytest.raises(ValueError):
        training.oversample(rows, KEYS)


def test_pairwise_loss_does_not_overflow(spark):
    lists = spark.createDataFrame([(1, [1.0, 0.0], [-800.0, 800.0])], "qid INT, labels ARRAY<DOUBLE>, scores ARRAY<DOUBLE>")
    assert training.pairwise_logistic_loss(lists).first().loss == pytest.approx(1600.0)
