"""Rank and classification metrics of judged runs (case_id, candidate_id, score, rel).

Metrics at k look only at the best ``max(k)`` candidates of a case, which the rank limit keeps small before
the shuffle; totals per case come from pre-combined aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from docketry.functions.measures import f1, ratio
from docketry.operators.ranking import first_rows, running_sums, top_ranked
from docketry.session import materialise

# The cuts of the usual retrieval evaluation.
CUTS = (5, 10, 15, 20, 30, 100, 200, 500, 1000)


def _relevant():
    return F.col("rel") > 0


def rels_per_case(run: DataFrame) -> DataFrame:
    """(case_id, rels) of the cases that have a relevant candidate."""
    return run.filter(_relevant()).groupBy("case_id").agg(F.count("*").alias("rels"))


def avg_rels(run: DataFrame) -> DataFrame:
    return rels_per_case(run).agg(F.avg("rels").alias("avg_rels"))


def precision_recall_at_k(
    run: DataFrame, cuts: Sequence[int] = CUTS, tie: str = "candidate", by: tuple[str, ...] = ()
) -> DataFrame:
    """(by, case_id, k, p, recall): found / k and found / relevant, for cases with a relevant candidate.

    Cuts that reach the length of the longest candidate list are left out. ``by`` names further columns
    that tell runs apart.
    """
    keys = [*by, "case_id"]
    sizes = run.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count(F.when(_relevant(), 1)).alias("rels")
    )
    longest = sizes.agg(F.max("n")).scalar()
    top = top_ranked(run, max(cuts), tie=tie, keys=tuple(keys)).filter(_relevant())
    found = top.groupBy(*keys).agg(
        *[F.count(F.when(F.col("rank") <= k, 1)).alias(f"found_{k}") for k in cuts]
    )
    wide = sizes.filter("rels > 0").join(found, keys, "left")
    per_cut = F.explode(
        F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(f"found_{k}", F.lit(0)).alias("found")) for k in cuts])
    )
    rows = wide.select(*keys, "rels", per_cut.alias("cut")).filter(F.col("cut.k") < longest)
    return rows.select(
        *keys,
        F.col("cut.k").alias("k"),
        ratio(F.col("cut.found"), F.col("cut.k")).alias("p"),
        ratio(F.col("cut.found"), F.col("rels")).alias("recall"),
    )


def f1_at_k(
    run: DataFrame, cuts: Sequence[int] = CUTS, tie: str = "candidate", by: tuple[str, ...] = ()
) -> DataFrame:
    """(by, k, p, recall, f1): plain means over cases of the metrics of each case."""
    per_case = precision_recall_at_k(run, cuts, tie, by).withColumn("f1", f1(F.col("p"), F.col("recall")))
    return per_case.groupBy(*by, "k").agg(
        F.avg("p").alias("p"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1")
    )


def evaluate_methods(runs: dict[str, DataFrame], cuts: Sequence[int] = CUTS) -> DataFrame:
    """(method, measure, value) for the runs of several representations or rankers.

    The runs are scored once and written (ids and scores only), as the metrics read them several times.
    """
    if not runs:
        raise ValueError("no runs given")
    tagged = None
    for method, run in runs.items():
        part = run.select(F.lit(method).alias("method"), "case_id", "candidate_id", "score", "rel")
        tagged = part if tagged is None else tagged.unionByName(part)
    means = f1_at_k(materialise(tagged), cuts, by=("method",))
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.concat_ws("_", F.lit(name), "k").alias("measure"), F.col(column).alias("value"))
                for name, column in (("P", "p"), ("recall", "recall"), ("f1", "f1"))
            ]
        )
    )
    return means.select("method", pairs.alias("m")).select("method", "m.measure", "m.value")


def ndcg_at_k(run: DataFrame, cuts: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """(k, ndcg): gain 2^rel - 1, discount 1 / log2(1 + rank), mean over the cases whose ideal is not 0."""
    limit = max(cuts)
    gain = (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("rank") + 1)
    best_first = [F.col("rel").desc(), F.col("candidate_id")]
    ideal_rows = first_rows(run, ["case_id"], best_first, limit)

    def sums(rows, name):
        return rows.groupBy("case_id").agg(
            *[F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias(f"{name}_{k}") for k in cuts]
        )

    both = sums(top_ranked(run, limit), "dcg").join(sums(ideal_rows, "ideal"), "case_id")
    per_cut = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("k"), F.col(f"dcg_{k}").alias("dcg"), F.col(f"ideal_{k}").alias("ideal"))
                for k in cuts
            ]
        )
    )
    rows = both.select(per_cut.alias("c")).select("c.*").filter("ideal > 0")
    return rows.groupBy("k").agg(F.avg(F.col("dcg") / F.col("ideal")).alias("ndcg"))


def mrr_at_k(run: DataFrame, cuts: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """(k, mrr): mean over cases with a relevant candidate of 1 / rank of the first one within k."""
    first = (
        top_ranked(run, max(cuts)).filter(_relevant()).groupBy("case_id").agg(F.min("rank").alias("first"))
    )
    cases = rels_per_case(run).select("case_id").join(first, "case_id", "left")
    per_cut = [
        F.struct(
            F.lit(k).alias("k"),
            F.when(F.col("first") <= k, F.lit(1.0) / F.col("first")).otherwise(0.0).alias("value"),
        )
        for k in cuts
    ]
    rows = cases.select(F.explode(F.array(*per_cut)).alias("c")).select("c.*")
    return rows.groupBy("k").agg(F.avg("value").alias("mrr"))


def _ordered_pairs(scores: DataFrame, by: list[str], sums: DataFrame) -> DataFrame:
    """Share of correctly ordered pairs from (by, case_id, score, pos, neg, below)."""
    cases = sums.groupBy(*by, "case_id").agg(
        F.sum(F.col("pos") * F.col("below")).alias("correct"),
        (F.sum("pos") * F.sum("neg")).alias("pairs"),
    )
    totals = cases.groupBy(*by) if by else cases.groupBy()
    return totals.agg(F.sum("correct").alias("correct"), F.sum("pairs").alias("pairs"))


def ordered_pair_accuracy_at_k(run: DataFrame, cuts: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """(k, correct, pairs, opa): share of the (relevant, irrelevant) pairs within the best k of a case in
    which the relevant one scores higher; ties count as wrong, ``opa`` is NULL without pairs.

    Pairs are counted from running sums over scores, never built.
    """
    top = top_ranked(run, max(cuts))
    rows = top.select("case_id", "score", "rel", "rank", F.explode(F.lit(list(cuts))).alias("k"))
    counts = rows.filter(F.col("rank") <= F.col("k")).groupBy("k", "case_id", "score").agg(
        F.count(F.when(_relevant(), 1)).alias("pos"), F.count(F.when(~_relevant(), 1)).alias("neg")
    )
    lower = Window.partitionBy("k", "case_id").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.withColumn("below", F.coalesce(F.sum("neg").over(lower), F.lit(0)))
    return _ordered_pairs(counts, ["k"], sums).select("k", "correct", "pairs", _share())


def ordered_pair_accuracy(run: DataFrame) -> DataFrame:
    """(correct, pairs, opa) over whole candidate lists."""
    counts = run.groupBy("case_id", "score").agg(
        F.count(F.when(_relevant(), 1)).alias("pos"), F.count(F.when(~_relevant(), 1)).alias("neg")
    )
    upto = running_sums(counts, ["case_id"], [F.col("score")], {"upto": F.col("neg")})
    sums = upto.withColumn("below", F.col("upto") - F.col("neg"))
    return _ordered_pairs(counts, [], sums).select("correct", "pairs", _share())


def _share():
    return F.when(F.col("pairs") > 0, F.col("correct").cast("double") / F.col("pairs")).alias("opa")


def confusion_matrix(run: DataFrame, cut: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """(tn, fp, fn, tp, accuracy) when scores above ``cut`` are predicted relevant."""
    said = F.col("score") > F.lit(float(cut))
    true = _relevant()
    cells = {"tn": ~said & ~true, "fp": said & ~true, "fn": ~said & true, "tp": said & true}
    counts = run.groupBy(*by).agg(*[F.count(F.when(c, 1)).alias(n) for n, c in cells.items()])
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return counts.withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), total))


def classification_metrics(run: DataFrame, cut: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, F1, AUC of the hard predictions, precision, recall and the four counts."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return confusion_matrix(run, cut, by).select(
        *by,
        F.col("accuracy").alias("eval_accuracy"),
        f1(precision, recall).alias("f1_score"),
        ((recall + ratio(tn, tn + fp)) / 2).alias("auc"),
        precision.alias("precision"),
        recall.alias("recall"),
        tp.alias("true_positives"),
        tn.alias("true_negatives"),
        fp.alias("false_positives"),
        fn.alias("false_negatives"),
    )
