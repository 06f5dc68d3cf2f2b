"""Two-step cascades: a first cut on every pair, a second cut on the pairs with a high first score.

A pair is returned when the first step accepts it and either its first score is below ``high`` or the
second step accepts it; a first score of exactly ``high`` needs the second step. For both axes a pair is
accepted by a run of cuts that ends at some position, so a two-dimensional histogram of those positions
(bounded by the grid) and two running sums give all cut pairs from one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docketry.functions.measures import f1, ratio
from docketry.operators.ranking import average_rank
from docketry.operators.sweeps import accepting_cuts

HIGH = 0.9


def _accepting_ranks(rank: Column, limit: int) -> Column:
    """How many of the cuts 1..limit are at least ``rank``; 0 for NULL."""
    count = F.lit(limit + 1) - F.ceil(rank)
    return F.greatest(F.lit(0), F.coalesce(count, F.lit(0))).cast("int")


def _sweep(
    run: DataFrame, rels: Column, first: Column, second: Column, size_1: int, size_2: int, high: float
) -> DataFrame:
    """(i1, i2, r, p, f1): cut numbers from 0; a pair is returned when i1 < first and i2 < second."""
    b2 = F.when(F.col("score_01") < F.lit(float(high)), F.lit(size_2)).otherwise(second)
    counts = run.groupBy(first.alias("b1"), b2.alias("b2")).agg(
        F.count("*").alias("returned"), F.count(F.when(F.col("rel") > 0, 1)).alias("found")
    )
    # every cell of the grid once; its size is set by the two cut lists
    cells = run.sparkSession.range((size_1 + 1) * (size_2 + 1)).select(
        F.floor(F.col("id") / F.lit(size_2 + 1)).cast("int").alias("b1"),
        F.pmod(F.col("id"), F.lit(size_2 + 1)).cast("int").alias("b2"),
    )
    filled = cells.join(counts, ["b1", "b2"], "left").na.fill(0, ["returned", "found"])
    along_2 = Window.partitionBy("b1").orderBy(F.col("b2").desc()).rowsBetween(Window.unboundedPreceding, 0)
    along_1 = Window.partitionBy("b2").orderBy(F.col("b1").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = filled.withColumns({c: F.sum(c).over(along_2) for c in ("returned", "found")})
    sums = sums.withColumns({c: F.sum(c).over(along_1) for c in ("returned", "found")})
    r, p = ratio(F.col("found"), rels), ratio(F.col("found"), F.col("returned"))
    return sums.filter("b1 > 0 AND b2 > 0").select(
        (F.col("b1") - 1).alias("i1"), (F.col("b2") - 1).alias("i2"), r.alias("r"), p.alias("p"), f1(p, r).alias("f1")
    )


def _all_rels(run: DataFrame) -> Column:
    """Relevant pairs of the whole run, also those that no cut returns."""
    return run.agg(F.count(F.when(F.col("rel") > 0, 1))).scalar()


def _score_cut(column: str, steps: int) -> Column:
    return F.col(column).cast("double") / F.lit(float(steps))


def two_step_score_score(run: DataFrame, steps: int = 200, high: float = HIGH) -> DataFrame:
    """(cut_01, cut_02, r, p, f1) over score cuts i / steps of both steps.

    ``run`` holds (case_id, candidate_id, score_01, score_02 or NULL, rel), see ``rerank_merge``.
    """
    first = accepting_cuts(F.col("score_01"), steps, 0, steps)
    second = accepting_cuts(F.col("score_02"), steps, 0, steps)
    swept = _sweep(run, _all_rels(run), first, second, steps, steps, high)
    return swept.select(
        _score_cut("i1", steps).alias("cut_01"), _score_cut("i2", steps).alias("cut_02"), "r", "p", "f1"
    )


def _with_first_rank(run: DataFrame, limit: int) -> DataFrame:
    """Pairs with a mean rank of at most ``limit`` in the first step; no rank cut returns the others."""
    return average_rank(run, "score_01", "rank_01", limit)


def two_step_rank_rank(run: DataFrame, limit: int = 200, high: float = HIGH) -> DataFrame:
    """(cut_01, cut_02, r, p, f1) over rank cuts 1..limit of both steps; tied scores share a mean rank."""
    second = average_rank(run.select("case_id", "candidate_id", "score_02"), "score_02", "rank_02", limit)
    ranked = _with_first_rank(run, limit).join(
        second.select("case_id", "candidate_id", "rank_02"), ["case_id", "candidate_id"], "left"
    )
    first, again = (_accepting_ranks(F.col(c), limit) for c in ("rank_01", "rank_02"))
    swept = _sweep(ranked, _all_rels(run), first, again, limit, limit, high)
    return swept.select(
        (F.lit(limit) - F.col("i1")).alias("cut_01"), (F.lit(limit) - F.col("i2")).alias("cut_02"), "r", "p", "f1"
    )


def two_step_rank_score(run: DataFrame, limit: int = 200, steps: int = 200, high: float = HIGH) -> DataFrame:
    """(cut_01, cut_02, r, p, f1) over rank cuts of the first and score cuts of the second step."""
    ranked = _with_first_rank(run, limit)
    first = _accepting_ranks(F.col("rank_01"), limit)
    second = accepting_cuts(F.col("score_02"), steps, 0, steps)
    swept = _sweep(ranked, _all_rels(run), first, second, limit, steps, high)
    return swept.select(
        (F.lit(limit) - F.col("i1")).alias("cut_01"), _score_cut("i2", steps).alias("cut_02"), "r", "p", "f1"
    )


def cut_grid_pivot(sweep: DataFrame, metric: str, cuts_02: list) -> DataFrame:
    """The metric as a matrix: one row per ``cut_01``, one column per named ``cut_02``."""
    return sweep.groupBy("cut_01").pivot("cut_02", list(cuts_02)).agg(F.first(metric))
