"""Ranks and running sums: spread over tasks they equal one window, and limits reach below the shuffle."""

import random

import pytest
from pyspark.sql import Window, functions as F

from docketry.operators import ranking


def skewed_run(spark, rows=600, seed=3):
    """A third of all rows belong to case 0, with many ties."""
    rng = random.Random(seed)
    data = [
        (0 if i % 3 == 0 else rng.randrange(1, 40), i, round(rng.random(), 1), int(rng.random() < 0.2))
        for i in range(rows)
    ]
    return spark.createDataFrame(data, "case_id BIGINT, candidate_id BIGINT, score DOUBLE, rel INT")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_spread_positions_equal_one_window(spark):
    run = skewed_run(spark)
    window = Window.partitionBy("case_id").orderBy(*ranking.run_order())
    assert rows(ranking.rank_positions(run)) == rows(run.withColumn("rank", F.row_number().over(window)))


def test_rows_with_a_null_case_are_a_case(spark):
    run = spark.createDataFrame([(None, 1, 0.5), (None, 2, 0.7), (1, 3, 0.1)], "case_id INT, candidate_id INT, score DOUBLE")
    assert sorted((r.candidate_id, r["rank"]) for r in ranking.rank_positions(run).collect()) == [(1, 2), (2, 1), (3, 1)]


def test_spread_positions_are_a_numbering(spark):
    counted = {}
    for r in ranking.rank_positions(skewed_run(spark)).collect():
        counted.setdefault(r.case_id, []).append(r)
    for group in counted.values():
        group.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in group] == list(range(1, len(group) + 1))
        keys = [(-r.score, r.candidate_id) for r in group]
        assert keys == sorted(keys)


def test_spread_sums_without_keys(spark):
    values = spark.range(500).select("id", (F.col("id") % 7).alias("v"))
    got = ranking.running_sums(values, [], [F.col("id").desc()], {"s": F.col("v")})
    total = 0
    for row in sorted(got.collect(), key=lambda r: -r.id):
        total += row.v
        assert row.s == total


def test_the_hot_case_is_split_over_ranges(spark):
    run = skewed_run(spark, 3000)
    ranges = run.repartitionByRange(8, "case_id", "score", "candidate_id")
    tasks = ranges.filter("case_id = 0").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_average_rank_matches_pandas(spark):
    run = skewed_run(spark)
    frame = run.toPandas()
    frame["want"] = frame.groupby("case_id")["score"].rank(ascending=False)
    want = {(r.case_id, r.candidate_id): r.want for r in frame.itertuples()}
    for options in ({}, {"limit": 30}):
        got = {(r.case_id, r.candidate_id): r.avg_rank for r in ranking.average_rank(run, **options).collect()}
        limit = options.get("limit", float("inf"))
        assert got == {k: v for k, v in want.items() if v <= limit}


def test_rows_without_a_score_have_no_average_rank(spark):
    run = spark.createDataFrame([(1, 1, 0.5), (1, 2, None)], "case_id INT, candidate_id INT, score DOUBLE")
    assert [tuple(r) for r in ranking.average_rank(run).collect()] == [(1, 0.5, 1, 1.0)]


def test_rank_limit_applies_before_the_shuffle(spark):
    plan = ranking.top_ranked(skewed_run(spark), 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_tie_rules(spark):
    run = spark.createDataFrame([(1, 9, 0.5), (1, 10, 0.5)], "case_id INT, candidate_id INT, score DOUBLE")
    first = lambda tie: ranking.rank_positions(run, tie=tie).filter("rank = 1").first().candidate_id
    assert first("candidate") == 9
    assert first("trec") == 9  # "9" > "10" as strings
    with pytest.raises(ValueError):
        ranking.rank_positions(run, tie="coin")


def test_limits_beyond_the_threshold_are_numbered_in_full(spark):
    run = skewed_run(spark)
    short = rows(ranking.top_ranked(run, 30))
    old = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    try:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
        assert rows(ranking.top_ranked(run, 30)) == short
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", old)
