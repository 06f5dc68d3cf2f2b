"""Distributions and ROC: histograms, density curves and the area under the curve."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from docketry.functions.measures import ratio
from docketry.operators.metrics import rels_per_case
from docketry.operators.ranking import running_sums


def _by_score(run: DataFrame, score: str) -> DataFrame:
    return run.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(
        F.count(F.when(F.col("rel") > 0, 1)).alias("pos"), F.count(F.when(~(F.col("rel") > 0), 1)).alias("neg")
    )


def roc_curve(run: DataFrame, score: str = "score", collinear: bool = True) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, after a start point at largest score + 1.

    Distinct scores are counted first; their running sums are spread over tasks when there are many. Without
    ``collinear``, points in the middle of a straight piece are left out: a point's steps are compared with those of
    the point after it, which it meets under its place in the whole curve, so pieces may cross ranges.
    """
    counts = _by_score(run, score)
    sums = {"tp": F.col("pos"), "fp": F.col("neg"), "place": F.lit(1).cast("long")}
    points = running_sums(counts, [], [F.col("threshold").desc()], sums)
    if not collinear:
        following = points.select((F.col("place") - 1).alias("place"), F.col("pos").alias("_pos"), F.col("neg").alias("_neg"))
        straight = F.col("pos") * F.col("_neg") == F.col("neg") * F.col("_pos")
        points = points.join(following, "place", "left").filter(~F.coalesce(straight, F.lit(False)))
    totals = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.max("threshold").alias("top"))
    p, n = totals.select("p").scalar(), totals.select("n").scalar()
    curve = points.select("threshold", ratio(F.col("fp"), n).alias("fpr"), ratio(F.col("tp"), p).alias("tpr"))
    start = totals.select((F.col("top") + 1).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(curve)


def roc_auc(run: DataFrame, score: str = "score") -> DataFrame:
    """(positives, negatives, auc): share of (positive, negative) pairs in the right order, ties half."""
    counts = _by_score(run, score)
    upto = running_sums(counts, [], [F.col("threshold")], {"upto": F.col("neg")})
    lower = F.col("upto") - F.col("neg")
    sums = upto.agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(F.col("pos").cast("double") * (lower + F.col("neg") / F.lit(2.0))).alias("area"),
    )
    size = F.col("positives").cast("double") * F.col("negatives")
    return sums.select("positives", "negatives", F.when(size > 0, F.col("area") / size).alias("auc"))


def _edge(i: Column, low: float, width: float) -> Column:
    return F.lit(low) + i * F.lit(width)


def _bin(value: Column, low: float, width: float, bins: int) -> Column:
    """Bin number by comparison with the edges ``low + i * width``; the last bin includes its right edge,
    values outside get NULL."""
    value = F.when((value >= F.lit(low)) & (value <= _edge(F.lit(bins), low, width)), value)
    near = F.floor((value - F.lit(low)) / F.lit(width))
    exact = (
        F.when(value < _edge(near, low, width), near - 1)
        .when(value >= _edge(near + 1, low, width), near + 1)
        .otherwise(near)
    )
    last = _edge(F.lit(bins), low, width)
    return (
        F.when((exact >= 0) & (exact < bins), exact)
        .when((value <= last) & (exact == bins), F.lit(bins - 1))
        .cast("int")
    )


def score_histogram(
    run: DataFrame, bins: int = 20, low: float = 0.0, width: float = 0.05, score: str = "score"
) -> DataFrame:
    """(rel, bin, low, n, density) of scores by label; scores outside the bins are left out (``outside_bins`` counts them)."""
    rows = run.select("rel", _bin(F.col(score), low, width, bins).alias("bin")).filter("bin IS NOT NULL")
    counts = rows.groupBy("rel", "bin").agg(F.count("*").alias("n"))
    totals = counts.groupBy("rel").agg(F.sum("n").alias("total"))
    return counts.join(totals, "rel").select(
        "rel",
        "bin",
        _edge(F.col("bin"), low, width).alias("low"),
        "n",
        (F.col("n") / (F.col("total") * F.lit(width))).alias("density"),
    )


def outside_bins(rows: DataFrame, value: Column, low: float, width: float, bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, below, above, missing): values that a histogram of fixed bins leaves out; one row without ``by``.

    The last bin includes its right edge, as in the histograms; NaN counts as above, a null as missing.
    """
    last = _edge(F.lit(bins), low, width)
    return rows.groupBy(*by).agg(
        F.count_if(value < F.lit(low)).alias("below"), F.count_if(value > last).alias("above"), F.count_if(value.isNull()).alias("missing")
    )


def score_histogram_auto(run: DataFrame, bins: int = 20, score: str = "score") -> DataFrame:
    """(rel, bin, n, density) with ``bins`` equal bins between the smallest and largest score of each label."""
    value = F.col(score)
    spans = run.groupBy("rel").agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("total")
    )
    # one row per label
    rows = run.select("rel", value.alias("v")).join(F.broadcast(spans), "rel").filter("v IS NOT NULL")
    return _equal_bins(rows, ["rel"], bins)


def _equal_bins(rows: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Histogram of ``v`` between ``low`` and ``high``; a single value spans half a unit to each side."""
    flat = F.col("high") == F.col("low")
    low = F.when(flat, F.col("low") - 0.5).otherwise(F.col("low"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("high") - F.col("low")) / F.lit(float(bins))
    place = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("int")
    return (
        rows.groupBy(*keys, place.alias("bin"), width.alias("width"), F.col("total"))
        .agg(F.count("*").alias("n"))
        .select(*keys, "bin", "n", (F.col("n") / (F.col("total") * F.col("width"))).alias("density"))
    )


def rels_histogram(run: DataFrame, width: int = 5, bins: int = 10) -> DataFrame:
    """(bin, low, n, cumulative) of relevant candidates per case; cumulative is the share up to the bin."""
    from pyspark.sql import Window

    place = _bin(F.col("rels").cast("double"), 0.0, float(width), bins)
    counts = rels_per_case(run).select(place.alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(
        F.count("*").alias("n")
    )
    grid = run.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    filled = grid.join(counts, "bin", "left").na.fill(0, ["n"])
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    share = ratio(F.sum("n").over(upto), F.sum("n").over(Window.partitionBy()))
    return filled.select("bin", (F.col("bin") * width).alias("low"), "n", share.alias("cumulative"))


def returned_histogram(run: DataFrame, cut: float, bins: int = 15, score: str = "score") -> DataFrame:
    """(bin, n, density) of the number of candidates a case returns at one cut; cases that return none
    are not counted, the last of the unit bins includes its right edge."""
    counts = run.filter(F.col(score) > F.lit(float(cut))).groupBy("case_id").agg(F.count("*").alias("returned"))
    place = _bin(F.col("returned").cast("double"), 0.0, 1.0, bins)
    rows = counts.select(place.alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n")).scalar()
    return rows.select("bin", "n", ratio(F.col("n"), total).alias("density"))


# Metrics that share one set of bin edges.
METRIC_GROUPS = (("r", "p", "f1"), ("returned", "found"))


def metric_histograms(report: DataFrame, bins: int = 10, groups=METRIC_GROUPS) -> DataFrame:
    """(metric, bin, n, density) over the cases of a report; metrics of a group share their bin edges."""
    values = F.explode(
        F.array(
            *[
                F.struct(F.lit(g).alias("g"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("v"))
                for g, names in enumerate(groups)
                for m in names
            ]
        )
    )
    rows = report.select(values.alias("x")).select("x.*")
    spans = rows.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    totals = rows.groupBy("g", "metric").agg(F.count("*").alias("total"))
    # one row per metric
    frame = F.broadcast(totals.join(spans, "g"))
    return _equal_bins(rows.join(frame, ["g", "metric"]), ["metric"], bins)


def density_curve(values: DataFrame, low: float, high: float, points: int, by: str | None = None, value: str = "value") -> DataFrame:
    """(by, x, density): Gaussian kernel density with Scott's bandwidth at ``points`` + 1 places.

    Equal values are counted first; one aggregate then has a sum for each of the fixed places.
    """
    keys = [by] if by else []
    rows = values.filter(F.col(value).isNotNull())
    distinct = rows.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    stats = rows.groupBy(*keys).agg(
        F.count("*").alias("size"),
        (F.stddev_samp(F.col(value).cast("double")) * F.pow(F.count("*"), F.lit(-0.2))).alias("h"),
    )
    if by:
        weighed = distinct.join(stats, by)
    else:
        weighed = distinct.withColumns({c: stats.select(c).scalar() for c in ("size", "h")})
    places = [low + (high - low) * i / points for i in range(points + 1)]
    scale = F.col("size") * F.col("h") * F.lit(math.sqrt(2 * math.pi))

    def density(x: float) -> Column:
        z = (F.lit(x) - F.col("v")) / F.col("h")
        return F.sum(F.col("n") * F.exp(F.lit(-0.5) * z * z) / scale)

    sums = F.array(*[F.struct(F.lit(x).alias("x"), density(x).alias("density")) for x in places])
    return weighed.groupBy(*keys).agg(sums.alias("places")).select(*keys, F.inline("places"))
