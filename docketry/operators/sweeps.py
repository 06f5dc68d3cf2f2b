"""Score and rank cuts: every cut of a grid from one pass over the run.

A row is counted once, under the number of cuts that accept it; a running sum over the grid (whose size is
a parameter, not the data's) then gives every cut. Grids are ``i / steps``: ``accepting_cuts`` compares the
score with the very doubles of the grid, so a score that lies on a cut is treated exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docketry.functions.measures import f1, ratio
from docketry.operators.ranking import run_order, running_sums, top_ranked

STEPS = 10_000


def accepting_cuts(score: Column, steps: int, first: int, last: int) -> Column:
    """How many cuts ``i / steps`` with first <= i < last lie strictly below ``score``; 0 for NULL."""
    size = F.lit(float(steps))
    near = F.ceil(score * size)
    exact = (
        F.when(~(score > (near - 1).cast("double") / size), near - 1)
        .when(score > near.cast("double") / size, near + 1)
        .otherwise(near)
    )
    return F.greatest(F.lit(0), F.least(F.coalesce(exact, F.lit(first)), F.lit(last)) - F.lit(first)).cast("int")


def _relevant() -> Column:
    return F.col("rel") > 0


def _counts(*keys):
    return [F.count("*").alias("returned"), F.count(F.when(_relevant(), 1)).alias("found")]


def _over_grid(spark, counts: DataFrame, size: int) -> DataFrame:
    """(cut number ``i``, returned, found, rels) from counts by the number of accepting cuts ``b``."""
    grid = spark.range(size + 1).select(F.col("id").cast("int").alias("b"))
    filled = grid.join(counts, "b", "left").na.fill(0, ["returned", "found"])
    # the grid has size + 1 rows whatever the run holds, so one task may sum it
    more = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = filled.select(
        "b",
        F.sum("returned").over(more).alias("returned"),
        F.sum("found").over(more).alias("found"),
        F.sum("found").over(Window.partitionBy()).alias("rels"),
    )
    return summed.filter("b > 0").withColumn("i", F.col("b") - 1)


def _pooled(df: DataFrame, *keys) -> DataFrame:
    r, p = ratio(F.col("found"), F.col("rels")), ratio(F.col("found"), F.col("returned"))
    return df.select(*keys, r.alias("r"), p.alias("p"), f1(p, r).alias("f1"))


def score_cut_sweep(
    run: DataFrame, low: float = 0.0, high: float = 1.0, steps: int = STEPS, score: str = "score"
) -> DataFrame:
    """(cut, r, p, f1) for the cuts low <= i / steps < high: pairs with ``score > cut`` are returned and
    pooled over cases. Scores above ``high`` are above every cut."""
    first, last = round(low * steps), round(high * steps)
    accepted = accepting_cuts(F.col(score), steps, first, last)
    counts = run.groupBy(accepted.alias("b")).agg(*_counts())
    cut = (F.col("i") + first).cast("double") / F.lit(float(steps))
    return _pooled(_over_grid(run.sparkSession, counts, last - first), cut.alias("cut"))


def step2_only_sweep(run: DataFrame, steps: int = 1000, score: str = "score_02") -> DataFrame:
    """The sweep on the second step's score; recall still counts every relevant pair of the run."""
    return score_cut_sweep(run, 0.0, 1.0, steps, score)


def macro_cut_sweep(
    run: DataFrame, low: float = 0.0, high: float = 1.0, steps: int = STEPS, score: str = "score"
) -> DataFrame:
    """(cut, r, p, f1) as plain means over the cases with a relevant candidate.

    Along the grid the metrics of a case change only where it has a score, so each case contributes its
    changes, and the changes are added up over the grid.
    """
    first, last = round(low * steps), round(high * steps)
    accepted = accepting_cuts(F.col(score), steps, first, last)
    counts = run.groupBy("case_id", accepted.alias("b")).agg(*_counts())
    # a case has at most one row per cut of the grid here
    whole = Window.partitionBy("case_id")
    more = whole.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.select(
        "case_id",
        "b",
        F.sum("returned").over(more).alias("returned"),
        F.sum("found").over(more).alias("found"),
        F.sum("found").over(whole).alias("rels"),
    ).filter("rels > 0")
    measured = _pooled(summed, "case_id", "b")
    step = Window.partitionBy("case_id").orderBy(F.col("b").desc())
    changes = measured.filter("b > 0").select(
        "b", *[(F.col(m) - F.lag(m, 1, 0.0).over(step)).alias(m) for m in ("r", "p", "f1")]
    )
    by_cut = changes.groupBy("b").agg(*[F.sum(m).alias(m) for m in ("r", "p", "f1")])
    cases = summed.agg(F.countDistinct("case_id")).scalar()
    grid = run.sparkSession.range(1, last - first + 1).select(F.col("id").cast("int").alias("b"))
    from_above = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cut = (F.col("b") - 1 + first).cast("double") / F.lit(float(steps))
    return grid.join(by_cut, "b", "left").na.fill(0.0, ["r", "p", "f1"]).select(
        cut.alias("cut"), *[(F.sum(m).over(from_above) / cases).alias(m) for m in ("r", "p", "f1")]
    )


def grid_cut_sweep(
    run: DataFrame, cuts: list[float], score: str = "score"
) -> DataFrame:
    """(cut, r, p, f1) for an arbitrary list of cuts, as needed for scores without a fixed range.

    The list is a parameter of bounded size; each distinct score finds its place in it once.
    """
    ordered = sorted(set(float(c) for c in cuts))
    below = F.size(F.filter(F.lit(ordered), lambda c: c < F.col("s")))
    by_score = run.groupBy(F.col(score).alias("s")).agg(*_counts())
    counts = by_score.groupBy(F.when(F.col("s").isNull(), 0).otherwise(below).alias("b")).agg(
        F.sum("returned").alias("returned"), F.sum("found").alias("found")
    )
    swept = _over_grid(run.sparkSession, counts, len(ordered))
    return _pooled(swept, F.get(F.lit(ordered), F.col("i")).alias("cut"))


def rank_cut_sweep(run: DataFrame, limit: int = 200, score: str = "score") -> DataFrame:
    """(cut, r, p, f1) when the best ``cut`` candidates of every case are returned, cut = 1..limit."""
    rels = run.agg(F.count(F.when(_relevant(), 1))).scalar()
    counts = top_ranked(run, limit, score).groupBy(F.col("rank").cast("int").alias("rank")).agg(*_counts())
    grid = run.sparkSession.range(1, limit + 1).select(F.col("id").cast("int").alias("rank"))
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = grid.join(counts, "rank", "left").na.fill(0, ["returned", "found"]).select(
        F.col("rank").alias("cut"),
        F.sum("returned").over(upto).alias("returned"),
        F.sum("found").over(upto).alias("found"),
        rels.alias("rels"),
    )
    return _pooled(summed, "cut")


def best_cut(sweep: DataFrame, cut: str = "cut") -> DataFrame:
    """(metric, cut, value, r, p, f1): the cut with the largest value of each metric, the smallest such
    cut on ties, with all three metrics at that cut."""
    metrics = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("r", "p", "f1")])
    )
    rows = sweep.select(cut, "r", "p", "f1", metrics.alias("m")).select(cut, "r", "p", "f1", "m.*")
    best = F.max_by(F.struct(cut, "value", "r", "p", "f1"), F.struct(F.col("value"), -F.col(cut)))
    return rows.groupBy("metric").agg(best.alias("b")).select("metric", "b.*")


def case_report(run: DataFrame, cut: float, score: str = "score") -> DataFrame:
    """(case_id, r, p, f1, returned, found, rels) at one score cut, for cases with a relevant candidate."""
    above = F.col(score) > F.lit(float(cut))
    counts = run.groupBy("case_id").agg(
        F.count(F.when(above, 1)).alias("returned"),
        F.count(F.when(above & _relevant(), 1)).alias("found"),
        F.count(F.when(_relevant(), 1)).alias("rels"),
    )
    return _pooled(counts.filter("rels > 0"), "case_id", "returned", "found", "rels").select(
        "case_id", "r", "p", "f1", "returned", "found", "rels"
    )


def max_metrics_at_k(run: DataFrame, limit: int = 200) -> DataFrame:
    """(cut, r, p, f1) of a perfect ranker at each rank cut.

    sum(min(rels, k)) over cases is the running sum over j <= k of the cases with at least j relevant
    candidates, so a histogram of the counts (at most ``limit`` + 1 rows) is enough.
    """
    cases = run.groupBy("case_id").agg(F.count(F.when(_relevant(), 1)).alias("rels"))
    capped = cases.groupBy(F.least("rels", F.lit(limit)).cast("int").alias("cut")).agg(
        F.count("*").alias("cases"), F.sum("rels").alias("rels")
    )
    grid = run.sparkSession.range(limit + 1).select(F.col("id").cast("int").alias("cut"))
    filled = grid.join(capped, "cut", "left").na.fill(0, ["cases", "rels"])
    everything = Window.partitionBy()
    at_least = Window.orderBy(F.col("cut").desc()).rowsBetween(Window.unboundedPreceding, 0)
    upto = Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, 0)
    counted = filled.select(
        "cut",
        F.sum("cases").over(at_least).alias("reach"),
        F.sum("cases").over(everything).alias("cases"),
        F.sum("rels").over(everything).alias("rels"),
    ).filter("cut > 0")
    found = counted.withColumn("found", F.sum("reach").over(upto))
    return _pooled(found.withColumn("returned", F.col("cases") * F.col("cut")), "cut")


def relative_metrics_at_k(run: DataFrame, limit: int = 200) -> DataFrame:
    """Rank-cut metrics with ``r_rel``, ``p_rel``, ``f1_rel``: their share of the perfect ranker's."""
    bound = max_metrics_at_k(run, limit).select("cut", *[F.col(m).alias(f"max_{m}") for m in ("r", "p", "f1")])
    joined = rank_cut_sweep(run, limit).join(bound, "cut")
    relative = [ratio(F.col(m), F.col(f"max_{m}")).alias(f"{m}_rel") for m in ("r", "p", "f1")]
    return joined.select("cut", "r", "p", "f1", *relative)


def metric_lookup(sweep: DataFrame, cuts: list, cut: str = "cut") -> DataFrame:
    """The rows of a sweep at the named cuts."""
    return sweep.filter(F.col(cut).isin(cuts))


def good_cases(report: DataFrame, above: float = 0.9) -> DataFrame:
    """The cases of a report whose F1 is above a value."""
    return report.filter(F.col("f1") > F.lit(float(above)))


def inspect_case(run: DataFrame, case_id: int, score: str = "score") -> DataFrame:
    """All candidates of one case, best score first."""
    return run.filter(F.col("case_id") == F.lit(case_id)).orderBy(*run_order(score))
