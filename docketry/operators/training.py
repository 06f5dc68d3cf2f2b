"""Training sets: splits by case, balancing, high-score subsets, learning-to-rank lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from docketry.operators.neighbours import nearest_neighbours
from docketry.operators.ranking import first_rows, row_numbers
from docketry.session import materialise

PADDING_LABEL = -1.0


def hash_unit(seed: int, *keys: str) -> Column:
    """A repeatable number in [0, 1) per key: the first eight hex digits of an md5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _hash_order(seed: int, keys: list[str]) -> list[Column]:
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return [F.md5(text).asc(), *[F.col(k).asc() for k in keys]]


def grouped_split(
    rows: DataFrame, train_fraction: float = 0.75, seed: int = 0
) -> DataFrame:
    """Rows with ``side`` ('train' or 'test'); all rows of a case are on one side.

    The first ``floor(train_fraction * cases)`` cases in the order of a seeded hash are for training.
    """
    cases = rows.select("case_id").distinct()
    numbered = row_numbers(cases, [], _hash_order(seed, ["case_id"]), "_place")
    size = cases.select(F.count("*").alias("n")).scalar()
    limit = F.floor(size * F.lit(float(train_fraction)))
    side = F.when(F.col("_place") <= limit, F.lit("train")).otherwise(F.lit("test"))
    return rows.join(numbered.select("case_id", side.alias("side")), "case_id")


def holdout_split(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test): the test side are the cases listed in ``ids``."""
    listed = ids.select("case_id").distinct()
    return rows.join(listed, "case_id", "left_anti"), rows.join(listed, "case_id", "left_semi")


def class_counts(rows: DataFrame, *by: str, label: str = "rel") -> DataFrame:
    return rows.groupBy(*by, label).agg(F.count("*").alias("n"))


def two_classes(rows: DataFrame, label: str) -> tuple[object, int, int]:
    """(label of the smaller class, its rows, rows of the larger); one aggregated row reaches the driver.

    Of equal classes the smaller label counts as the smaller class; one class alone is (None, 0, its rows).
    """
    low, high = rows.agg(F.min(label), F.max(label)).first()
    if low is None or low == high:
        return None, 0, rows.count()
    value = F.col(label)
    lows, highs, total = rows.agg(
        F.count_if(value == F.lit(low)), F.count_if(value == F.lit(high)), F.count(F.lit(1))
    ).first()
    if lows + highs != total:
        raise ValueError(f"{label} must hold two values and no nulls")
    return (low, lows, highs) if lows <= highs else (high, highs, lows)


def oversample(rows: DataFrame, keys: list[str], ratio: float = 1.0, label: str = "rel", seed: int = 0) -> DataFrame:
    """Repeat rows of the smaller class until it has ``floor(ratio * larger)`` rows; ``copy`` numbers the
    repeats from 0. Nothing is removed, and nothing added when the ratio is already reached.

    Repeats are dealt round-robin in the order of a seeded hash, so counts come out exactly.
    """
    smaller, have, larger = two_classes(rows, label)
    if not have:
        return rows.withColumn("copy", F.lit(0))
    wanted = max(have, int(np.floor(ratio * larger)))
    minority = row_numbers(rows.filter(F.col(label) == F.lit(smaller)), [], _hash_order(seed, keys), "_place")
    repeats = F.lit(wanted // have) + F.when(F.col("_place") <= wanted % have, 1).otherwise(0)
    copies = F.explode(F.sequence(F.lit(0), (repeats - 1).cast("int"))).alias("copy")
    others = rows.filter(F.col(label) != F.lit(smaller)).withColumn("copy", F.lit(0))
    return others.unionByName(minority.select(*rows.columns, copies))


def smote(
    rows: DataFrame,
    keys: list[str],
    k: int = 5,
    label: str = "rel",
    vector: str = "features",
    seed: int = 0,
    block_rows: int = 1024,
) -> DataFrame:
    """(keys, label, vector, copy): all rows, plus points of the smaller class until both are equal.

    A new point lies on the line from a minority point to one of its ``k`` nearest minority points; which
    neighbour and how far along come from a hash of the point's keys and the number of the copy (``copy``
    is 0 for given rows). Points take turns in the order of a seeded hash.
    """
    base = rows.select(*keys, label, F.col(vector).cast("array<double>").alias("vector"))
    given = base.withColumn("copy", F.lit(0))
    smaller, have, larger = two_classes(base, label)
    missing = larger - have
    if not have or not missing:
        return given.withColumnRenamed("vector", vector)
    if have < 2:
        raise ValueError("smote needs at least two rows of the smaller class")
    minority = base.filter(F.col(label) == F.lit(smaller))
    turns = row_numbers(minority, [], _hash_order(seed, keys), "_place")
    repeats = F.lit(missing // have) + F.when(F.col("_place") <= missing % have, 1).otherwise(0)
    # a point without a new copy drops out of the explode
    copies = turns.select(
        *keys, "vector", F.explode(F.slice(F.sequence(F.lit(0), repeats.cast("int")), 2, repeats.cast("int"))).alias("copy")
    )
    near = nearest_neighbours(minority, keys, k, block_rows)
    choices = min(k, have - 1)
    picked = copies.withColumns(
        {
            "nn": (F.floor(hash_unit(seed, *keys, "copy") * choices) + 1).cast("int"),
            "step": hash_unit(seed + 1, *keys, "copy"),
        }
    )
    made = picked.join(near.select(*keys, "nn", "neighbour"), [*keys, "nn"]).select(
        *keys,
        F.lit(smaller).alias(label),
        F.zip_with("vector", "neighbour", lambda x, y: x + F.col("step") * (y - x)).alias("vector"),
        "copy",
    )
    return given.unionByName(made).withColumnRenamed("vector", vector)


def high_score_subset(run: DataFrame, pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Pairs with texts and label whose score is above ``threshold`` (strictly); the score is dropped."""
    high = run.filter(F.col("score") > F.lit(float(threshold))).select("case_id", "candidate_id")
    return pairs.join(high, ["case_id", "candidate_id"])


def ltr_lists(rows: DataFrame, list_size: int, num_features: int, vector: str = "features", label: str = "rel") -> DataFrame:
    """One row per query: ``labels`` and ``features`` of its first ``list_size`` candidates by id, short
    lists filled with label -1 and zero features.

    The limit applies before candidates are collected, so an array has at most ``list_size`` parts.
    """
    kept = first_rows(rows, ["case_id"], [F.col("candidate_id")], list_size, "_place")
    part = F.struct("_place", F.col(label).cast("double").alias("label"), F.col(vector).alias("features"))
    lists = kept.groupBy("case_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    missing = F.lit(list_size) - F.size("parts")
    zeros = F.array_repeat(F.lit(0.0), num_features)
    return lists.select(
        F.col("case_id").alias("qid"),
        F.concat("parts.label", F.array_repeat(F.lit(PADDING_LABEL), missing)).alias("labels"),
        F.concat("parts.features", F.array_repeat(zeros, missing)).alias("features"),
    )


def preference_differences(rows: DataFrame, vector: str = "features", label: str = "rel") -> DataFrame:
    """(case_id, feature, pairs, difference): per query the sum of ``x_relevant - x_irrelevant`` over all
    (relevant, irrelevant) pairs, the direction in which a pairwise ranking loss pulls a linear scorer.

    The sum over pairs equals n_irrelevant * sum(relevant) - n_relevant * sum(irrelevant), so no pair is
    built and both sums are combined before the shuffle. Queries without pairs are left out.
    """
    values = rows.select("case_id", F.col(label).alias("_rel"), F.posexplode(vector).alias("feature", "_x"))
    relevant = F.col("_rel") > 0
    sums = values.groupBy("case_id", "feature").agg(
        F.count(F.when(relevant, 1)).alias("n1"),
        F.count(F.when(~relevant, 1)).alias("n0"),
        F.sum(F.when(relevant, F.col("_x")).otherwise(0.0)).alias("s1"),
        F.sum(F.when(relevant, 0.0).otherwise(F.col("_x"))).alias("s0"),
    )
    return sums.filter((F.col("n1") > 0) & (F.col("n0") > 0)).select(
        "case_id",
        "feature",
        (F.col("n1") * F.col("n0")).alias("pairs"),
        (F.col("n0") * F.col("s1") - F.col("n1") * F.col("s0")).alias("difference"),
    )


def softplus(x: Column) -> Column:
    """ln(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def pairwise_logistic_loss(lists: DataFrame) -> DataFrame:
    """(qid, pairs, loss): sum of ln(1 + exp(-(s_i - s_j))) over the label-ordered pairs of each list.

    ``lists`` holds arrays (qid, labels, scores) of a bounded list size; labels of -1 are padding. The
    pairs are summed inside the row.
    """
    items = F.filter(F.arrays_zip("labels", "scores"), lambda x: x["labels"] >= 0)
    sums = F.aggregate(
        "items",
        F.struct(F.lit(0).cast("bigint").alias("pairs"), F.lit(0.0).alias("loss")),
        lambda acc, a: F.aggregate(
            "items",
            acc,
            lambda inner, b: F.when(
                a["labels"] > b["labels"],
                F.struct(
                    (inner["pairs"] + 1).alias("pairs"),
                    (inner["loss"] + softplus(b["scores"] - a["scores"])).alias("loss"),
                ),
            ).otherwise(inner),
        ),
    )
    return lists.select("qid", items.alias("items")).select("qid", sums.alias("s")).select("qid", "s.pairs", "s.loss")


def pair_stats(pairs: DataFrame) -> DataFrame:
    """One row: cases, pairs, smallest and largest candidate list, and whether all lists are equal."""
    sizes = pairs.groupBy("case_id").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("cases"),
        F.sum("n").alias("pairs"),
        F.min("n").alias("min_candidates"),
        F.max("n").alias("max_candidates"),
        (F.min("n") == F.max("n")).alias("uniform"),
    )
