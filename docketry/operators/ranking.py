"""Ranks and running sums that hold up when one case owns a large share of all rows.

``first_rows`` is a window with a rank limit, which Spark applies before the shuffle, so a task never receives
more than the limit per case and map task. Full ranks go through ``running_sums``: rows are range-partitioned by
group *and* order and written, so that a group spreads over as many tasks as it needs, summed per range, and the
sums of the group's earlier ranges are added back. It is the same at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docketry.session import materialise


def running_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums ``name -> value`` per group in the given (total) order.

    Nulls in a key are a group like any other. The rows are written once under the shared folder when this is
    called, because a range number has a meaning for one shuffle only.
    """
    by_keys = [F.col(k) for k in keys]
    values = {f"_add_{name}": value for name, value in sums.items()}
    ranged = df.withColumns(values).repartitionByRange(*by_keys, *order)
    ranges = materialise(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranges.withColumns({name: F.sum(f"_add_{name}").over(inside) for name in sums})
    totals = ranges.groupBy("_range", *keys).agg(*[F.sum(f"_add_{n}").alias(f"_{n}") for n in sums])
    # one row per group and range it touches: at most (groups + ranges) rows, (ranges) within a group
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_range").alias("_of_range"),
        *[F.col(k).alias(f"_of_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums],
    )
    same = F.col("_range") == F.col("_of_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    added = local.join(offsets, same).withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums})
    return added.select(*df.columns, *sums)


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Number the rows of each group from 1 in the given (total) order."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("bigint")})


def run_order(score: str = "score", tie: str = "candidate") -> list[Column]:
    """Best score first. Ties go to the smaller candidate id, or with ``tie='trec'`` to the candidate
    id that is larger as a string."""
    if tie == "candidate":
        second = F.col("candidate_id").asc()
    elif tie == "trec":
        second = F.col("candidate_id").cast("string").desc()
    else:
        raise ValueError(f"unknown tie rule: {tie}")
    return [F.col(score).desc_nulls_last(), second]


def rank_positions(
    run: DataFrame, score: str = "score", tie: str = "candidate", keys: tuple[str, ...] = ("case_id",)
) -> DataFrame:
    """Position of every candidate within its case, best score first."""
    return row_numbers(run, list(keys), run_order(score, tie), "rank")


def first_rows(df: DataFrame, keys: list[str], order: list[Column], limit: int, name: str = "rank") -> DataFrame:
    """The first ``limit`` rows of each group, numbered.

    Spark applies a limit of up to ``spark.sql.optimizer.windowGroupLimitThreshold`` before the shuffle; raise
    that setting for longer lists of cases that own a large share of all rows.
    """
    numbered = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter(F.col(name) <= limit)


def top_ranked(
    run: DataFrame, limit: int, score: str = "score", tie: str = "candidate", keys: tuple[str, ...] = ("case_id",)
) -> DataFrame:
    """The best ``limit`` candidates of each case with their ``rank``."""
    return first_rows(run, list(keys), run_order(score, tie), limit)


def average_rank(
    run: DataFrame,
    score: str = "score",
    name: str = "avg_rank",
    limit: int | None = None,
) -> DataFrame:
    """Mean rank of tied candidates, best score first (rows without a score are left out).

    Ties are counted once per distinct score. With ``limit`` only rows whose mean rank is at most
    ``limit`` are returned; such rows lie within the best ``limit`` distinct scores of their case.
    """
    scored = run.filter(F.col(score).isNotNull())
    ties = scored.groupBy("case_id", score).agg(F.count("*").alias("_n"))
    best_first = [F.col(score).desc()]
    if limit is not None:
        ties = first_rows(ties, ["case_id"], best_first, limit, "_place")
        frame = Window.partitionBy("case_id").orderBy(*best_first).rowsBetween(Window.unboundedPreceding, 0)
        ties = ties.withColumn("_upto", F.sum("_n").over(frame))
    else:
        ties = running_sums(ties, ["case_id"], best_first, {"_upto": F.col("_n")})
    mean_rank = (F.col("_upto") - F.col("_n")).cast("double") + (F.col("_n") + 1) / F.lit(2.0)
    ranks = ties.select("case_id", score, mean_rank.alias(name))
    if limit is not None:
        ranks = ranks.filter(F.col(name) <= limit)
    return scored.join(ranks, ["case_id", score])
