"""Metrics, sweeps, cascades and curves against plain Python on hand cases."""

import math
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docketry.operators import cascade, curves, metrics, sweeps

RUN = "case_id BIGINT, candidate_id BIGINT, score DOUBLE, rel INT"
# two cases of four candidates, tied scores; case 2 has no relevant candidate
HAND = [
    (1, 1, 0.9, 1), (1, 2, 0.5, 0), (1, 3, 0.5, 1), (1, 4, 0.1, 0),
    (2, 1, 0.8, 0), (2, 2, 0.8, 0), (2, 3, 0.2, 0), (2, 4, 0.0, 0),
]


@pytest.fixture(scope="module")
def hand(spark):
    return spark.createDataFrame(HAND, RUN)


def random_run(spark, seed=5, rows=400):
    rng = random.Random(seed)
    data = [(rng.randrange(8), i, round(rng.random(), 2), int(rng.random() < 0.25)) for i in range(rows)]
    return data, spark.createDataFrame(data, RUN)


def pooled(rows, rels):
    found = sum(r[3] for r in rows)
    r = found / rels if rels else 0.0
    p = found / len(rows) if rows else 0.0
    return r, p, 2 * p * r / (p + r) if p + r else 0.0


def test_score_sweep_equals_a_scan_per_cut(spark):
    data, run = random_run(spark)
    rels = sum(r[3] for r in data)
    swept = {r.cut: (r.r, r.p, r.f1) for r in sweeps.score_cut_sweep(run, steps=100).collect()}
    assert len(swept) == 100
    for i in range(100):
        assert swept[i / 100] == pytest.approx(pooled([r for r in data if r[2] > i / 100], rels))


def test_a_score_on_a_cut_is_not_above_it(hand):
    swept = {r.cut: r for r in sweeps.score_cut_sweep(hand, steps=10).collect()}
    assert swept[0.9].r == 0 and swept[0.9].p == 0 and swept[0.9].f1 == 0
    assert swept[0.8].r == 0.5 and swept[0.8].p == 1.0
    assert swept[0.0].p == pytest.approx(2 / 7)


def test_sweep_does_not_depend_on_partitions(spark):
    _, run = random_run(spark)
    one = sorted(map(tuple, sweeps.score_cut_sweep(run.repartition(1), steps=100).collect()))
    assert one == sorted(map(tuple, sweeps.score_cut_sweep(run.repartition(7), steps=100).collect()))


def test_recall_falls_with_the_cut(spark):
    _, run = random_run(spark)
    values = [r.r for r in sorted(sweeps.score_cut_sweep(run, steps=100).collect())]
    assert values == sorted(values, reverse=True)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=20), st.sampled_from([100, 200, 1000, 10000]))
def test_accepting_cuts_count_exactly(spark, scores, steps):
    scores = scores + [math.nextafter(7 / steps, 0), 7 / steps, math.nextafter(7 / steps, 1)]
    df = spark.createDataFrame([(float(s),) for s in scores], "s DOUBLE")
    got = df.select("s", sweeps.accepting_cuts(F.col("s"), steps, 0, steps).alias("n")).collect()
    assert all(row.n == sum(i / steps < row.s for i in range(steps)) for row in got)


def test_macro_sweep_equals_means_over_cases(spark):
    data, run = random_run(spark)
    cases = {c for c, _, _, rel in data if rel}
    swept = {r.cut: r for r in sweeps.macro_cut_sweep(run, steps=20).collect()}
    for i in range(20):
        per_case = []
        for c in cases:
            mine = [r for r in data if r[0] == c]
            per_case.append(pooled([r for r in mine if r[2] > i / 20], sum(r[3] for r in mine)))
        means = [sum(x[j] for x in per_case) / len(cases) for j in range(3)]
        row = swept[i / 20]
        assert (row.r, row.p, row.f1) == pytest.approx(means)


def test_grid_sweep_takes_any_cuts(spark):
    data, run = random_run(spark)
    wide = run.withColumn("score", F.col("score") * 50 - 10)
    rels = sum(r[3] for r in data)
    for row in sweeps.grid_cut_sweep(wide, [-20.0, 0.0, 12.5, 99.0]).collect():
        kept = [r for r in data if r[2] * 50 - 10 > row.cut]
        assert (row.r, row.p, row.f1) == pytest.approx(pooled(kept, rels))


def test_rank_sweep_and_best_cut(hand):
    swept = {r.cut: r for r in sweeps.rank_cut_sweep(hand, 5).collect()}
    assert (swept[1].r, swept[1].p) == (0.5, 0.5)
    assert (swept[3].r, swept[3].p) == (1.0, pytest.approx(1 / 3))
    assert (swept[5].r, swept[5].p) == (1.0, 0.25)
    best = {r.metric: r for r in sweeps.best_cut(sweeps.rank_cut_sweep(hand, 5)).collect()}
    assert best["r"].cut == 3 and best["p"].cut == 1  # smallest cut on ties


def test_case_report_zero_fills(hand):
    rows = sweeps.case_report(hand, 0.95).collect()
    assert [tuple(r) for r in rows] == [(1, 0.0, 0.0, 0.0, 0, 0, 2)]


def test_perfect_ranker_bound(hand):
    bound = {r.cut: r for r in sweeps.max_metrics_at_k(hand, 4).collect()}
    assert (bound[1].r, bound[1].p) == (0.5, 0.5)
    assert (bound[4].r, bound[4].p) == (1.0, 0.25)


def test_metrics_at_k_leave_out_cases_without_relevant(hand):
    rows = metrics.precision_recall_at_k(hand, (1, 2, 3, 4)).collect()
    assert {(r.case_id, r.k, round(r.p, 4), r.recall) for r in rows} == {
        (1, 1, 1.0, 0.5), (1, 2, 0.5, 0.5), (1, 3, 0.6667, 1.0)
    }


def test_ndcg_of_the_ideal_order_is_one(spark):
    run = spark.createDataFrame([(1, 1, 0.9, 2), (1, 2, 0.8, 1), (1, 3, 0.1, 0), (2, 1, 0.5, 0)], RUN)
    assert all(r.ndcg == pytest.approx(1.0) for r in metrics.ndcg_at_k(run).collect())


def test_mrr_counts_the_first_relevant(spark):
    run = spark.createDataFrame([(1, i, 1.0 - i / 10, int(i == 6)) for i in range(1, 9)], RUN)
    assert {r.k: r.mrr for r in metrics.mrr_at_k(run).collect()} == {5: 0.0, 10: pytest.approx(1 / 6), 20: pytest.approx(1 / 6)}


def test_ordered_pairs_count_ties_as_wrong(hand):
    row = metrics.ordered_pair_accuracy(hand).first()
    assert (row.correct, row.pairs) == (3, 4)
    spread = metrics.ordered_pair_accuracy(hand).first()
    assert tuple(spread) == tuple(row)


def test_classification_without_positives_predicted(hand):
    row = metrics.classification_metrics(hand, 2.0).first()
    assert (row.precision, row.recall, row.f1_score, row.auc) == (0.0, 0.0, 0.0, 0.5)


TWO_STEP = "case_id BIGINT, candidate_id BIGINT, score_01 DOUBLE, score_02 DOUBLE, rel INT"


def two_step_run(spark):
    rng = random.Random(11)
    data = [(1, 0, 0.9, None, 1)]  # exactly the threshold, never scored again
    for i in range(1, 120):
        first = round(rng.random() * 0.3 + 0.7, 2)
        data.append((rng.randrange(4), i, first, round(rng.random(), 2) if first > 0.9 else None, int(rng.random() < 0.3)))
    return data, spark.createDataFrame(data, TWO_STEP)


def test_cascade_by_scores_equals_a_scan_per_cut_pair(spark):
    data, run = two_step_run(spark)
    rels = sum(r[4] for r in data)
    swept = {(r.cut_01, r.cut_02): r for r in cascade.two_step_score_score(run, steps=20).collect()}
    assert len(swept) == 400
    for i in range(20):
        for j in range(20):
            a, b = i / 20, j / 20
            kept = [
                (r[0], r[1], r[2], r[4]) for r in data
                if r[2] > a and (r[2] < 0.9 or (r[3] is not None and r[3] > b))
            ]
            row = swept[a, b]
            assert (row.r, row.p, row.f1) == pytest.approx(pooled(kept, rels))


def test_cascades_by_rank_equal_a_scan_per_cut_pair(spark):
    data, run = two_step_run(spark)
    frame = run.toPandas()
    frame["rank_01"] = frame.groupby("case_id")["score_01"].rank(ascending=False)
    frame["rank_02"] = frame.groupby("case_id")["score_02"].rank(ascending=False)
    rels = int(frame["rel"].sum())
    by_rank = {(r.cut_01, r.cut_02): r for r in cascade.two_step_rank_rank(run, 12).collect()}
    mixed = {(r.cut_01, r.cut_02): r for r in cascade.two_step_rank_score(run, 12, 10).collect()}
    assert len(by_rank) == 144 and len(mixed) == 120
    low = frame["score_01"] < 0.9

    def check(row, kept):
        rows = [(0, 0, 0, rel) for rel in kept["rel"]]
        assert (row.r, row.p, row.f1) == pytest.approx(pooled(rows, rels))

    for a in range(1, 13):
        first = frame["rank_01"] <= a
        for b in range(1, 13):
            check(by_rank[a, b], frame[first & (low | (frame["rank_02"] <= b))])
        for j in range(10):
            check(mixed[a, j / 10], frame[first & (low | (frame["score_02"] > j / 10))])


def test_auc_equals_the_area_under_the_curve(spark):
    _, run = random_run(spark)
    points = sorted((r.fpr, r.tpr) for r in curves.roc_curve(run).collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert curves.roc_auc(run).first().auc == pytest.approx(area)


def test_auc_without_negatives_is_null(spark):
    run = spark.createDataFrame([(1, 1, 0.5, 1)], RUN)
    assert curves.roc_auc(run).first().auc is None


def test_histogram_edges_follow_the_edge_values(spark):
    values = [0.0, 0.05, 0.15, 0.3, 0.7, 1.0, 1.2, -0.1]
    run = spark.createDataFrame([(1, i, v, 0) for i, v in enumerate(values)], RUN)
    got = {r.bin: r.n for r in curves.score_histogram(run).collect()}
    want = {}
    for v in values:
        for i in range(20):
            if i * 0.05 <= v and (v < (i + 1) * 0.05 or (i == 19 and v <= 20 * 0.05)):
                want[i] = want.get(i, 0) + 1
    assert got == want


def test_density_integrates_to_one(spark):
    _, run = random_run(spark)
    rows = curves.density_curve(run, -1.0, 2.0, 300, value="score").collect()
    assert sum(r.density for r in rows) * 0.01 == pytest.approx(1.0, abs=1e-3)


def test_methods_are_evaluated_side_by_side(hand):
    turned = hand.withColumn("score", -F.col("score"))
    rows = metrics.evaluate_methods({"up": hand, "down": turned}, (1, 2)).collect()
    got = {(r.method, r.measure): r.value for r in rows}
    assert got["up", "P_1"] == 1.0 and got["down", "P_1"] == 0.0
    with pytest.raises(ValueError):
        metrics.evaluate_methods({})


def test_roc_corners_equal_brute_force_over_many_ranges(spark):
    rng = random.Random(8)
    data = [(1, i, float(i // 7), rng.choice([0, 0, 1]) if i < 300 else int(i % 7 < 3)) for i in range(900)]
    run = spark.createDataFrame(data, "case_id int, candidate_id int, score double, rel int")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r.fpr, r.tpr) for r in curves.roc_curve(run, collinear=False).collect())
        every = sorted((r.fpr, r.tpr) for r in curves.roc_curve(run).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    positives, negatives = sum(r[3] for r in data), sum(1 - r[3] for r in data)
    whole = [(round(x * negatives), round(y * positives)) for x, y in every]
    corners = [
        p for i, p in enumerate(whole)
        if i in (0, len(whole) - 1)
        or (p[0] - whole[i - 1][0]) * (whole[i + 1][1] - p[1]) != (p[1] - whole[i - 1][1]) * (whole[i + 1][0] - p[0])
    ]
    assert [(round(x * negatives), round(y * positives)) for x, y in got] == corners and len(corners) < len(whole) - 50


def test_values_outside_the_bins_are_counted(spark):
    values = [-1.0, 0.0, 0.5, 1.0, 1.0000001, float("nan"), float("inf"), None, None]
    run = spark.createDataFrame([(1, i, v, 0) for i, v in enumerate(values)], "case_id int, candidate_id int, score double, rel int")
    assert tuple(curves.outside_bins(run, F.col("score"), 0.0, 0.25, 4).first()) == (1, 3, 2)
    inside = curves.score_histogram(run, bins=4, low=0.0, width=0.25).agg(F.sum("n")).first()[0]
    assert inside == len(values) - 6
