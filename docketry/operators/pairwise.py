"""A linear ranker trained on preferences within a query: every relevant candidate above every other one.

Minimises |w|^2 / 2 + C * sum max(0, 1 - w (x_i - x_j))^2 over all pairs of a relevant candidate i and another candidate j
of the same case. No pair is built: in order of the score, less 1 for relevant candidates, the pairs that a candidate
violates are those with the other kind's candidates on one side of it, so their number and the sums of their scores
are running sums. These are taken by ranges of case and score (``ranking.running_sums``), so a hot case is no hot task.
A step needs the sum of gradients only, of the size of one vector, and one number for the loss.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docketry.operators.linear import LinearRanker, summed
from docketry.operators.ranking import running_sums
from docketry.session import materialise


def pull(scored: DataFrame) -> DataFrame:
    """(row, g, loss, pairs) from (row, case_id, positive, s): the loss's derivative by each row's score.

    ``loss`` and ``pairs`` stand with the relevant rows: the sum over the pairs they violate, and all their pairs.
    """
    s, positive = F.col("s"), F.col("positive")
    key = F.when(positive, s - 1).otherwise(s)
    up = lambda value: F.when(positive, value).otherwise(0.0)
    down = lambda value: F.when(positive, 0.0).otherwise(value)
    one = F.lit(1.0)
    placed = running_sums(
        scored.withColumn("_key", key),
        ["case_id"],
        [F.col("_key"), F.col("row")],
        {"n1": up(one), "s1": up(s), "n0": down(one), "s0": down(s), "q0": down(s * s)},
    )
    totals = scored.groupBy(F.col("case_id").alias("_case")).agg(
        F.sum(down(one)).alias("all_n0"), F.sum(down(s)).alias("all_s0"), F.sum(down(s * s)).alias("all_q0")
    )
    rows = placed.join(totals, F.col("case_id").eqNullSafe(F.col("_case")))
    n, t, q = (F.col(f"all_{c}") - F.col(c) for c in ("n0", "s0", "q0"))  # the others above a relevant row's key
    g = F.when(positive, -2 * (n * (1 - s) + t)).otherwise(2 * (F.col("n1") * (1 + s) - F.col("s1")))
    loss = F.when(positive, n * (1 - s) * (1 - s) + 2 * (1 - s) * t + q).otherwise(0.0)
    return rows.select("row", g.alias("g"), loss.alias("loss"), up(F.col("all_n0")).alias("pairs"))


def measured(rows: DataFrame, weights: np.ndarray) -> tuple[float, np.ndarray, float]:
    """(loss, its gradient, pairs) over all pairs at the given weights; ``rows`` has row, case_id, positive, x."""
    width = len(weights)
    products = F.zip_with("x", F.lit(weights.tolist()), lambda a, b: a * b)
    scored = rows.select("row", "case_id", "positive", F.aggregate(products, F.lit(0.0), lambda t, p: t + p).alias("s"))
    pulled = pull(scored).filter("g <> 0 OR pairs > 0").join(rows.select("row", "x"), "row")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                g, loss, pairs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "loss", "pairs"))
                sums = np.concatenate([g @ x, [loss.sum(), pairs.sum()]])
                yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    sums = summed(pulled.select("x", "g", "loss", "pairs").mapInArrow(add, "sums binary"), "sums", width + 2)
    return float(sums[-2]), sums[:-2], float(sums[-1])


def descend(value: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, tolerance: float):
    """(point, value, gradient, evaluations) by limited-memory BFGS with halved steps; ``value`` gives both."""
    x, history = start, []
    f, g = value(x)
    calls, first = 1, np.linalg.norm(g)
    while calls < steps and np.linalg.norm(g) > tolerance * max(first, 1e-300):
        d, scales = g.copy(), []
        for s, y in reversed(history):
            scales.append(s @ d / (s @ y))
            d -= scales[-1] * y
        d *= (history[-1][0] @ history[-1][1]) / (history[-1][1] @ history[-1][1]) if history else 1 / max(first, 1.0)
        for (s, y), a in zip(history, reversed(scales), strict=True):
            d += s * (a - y @ d / (s @ y))
        size = 1.0
        while calls < steps:
            new = x - size * d
            f_new, g_new = value(new)
            calls += 1
            if f_new <= f - 1e-4 * size * (g @ d):
                break
            size /= 2
        else:
            break
        if (new - x) @ (g_new - g) > 0:
            history = [*history[-9:], (new - x, g_new - g)]
        x, f, g = new, f_new, g_new
    return x, f, g, calls


def pairwise_rank(
    train: DataFrame, c: float = 1.0, steps: int = 60, tolerance: float = 1e-3, features: str = "features", label: str = "rel"
) -> LinearRanker:
    """The linear ranker of ``train``, rows (case_id, features, label) with a label above 0 for relevant candidates.

    ``gap`` is the gradient's length relative to that at zero; the search ends below ``tolerance`` or after ``steps``
    measurements. Rows without features or label take no part; a null case is a case. Cases of one kind of candidates
    have no pairs and no say. The loss is divided by the number of pairs, so C means the same for all sizes.
    """
    x = F.col(features).cast("array<double>").alias("x")
    rows = train.select("case_id", (F.col(label) > 0).alias("positive"), x).filter("positive IS NOT NULL AND x IS NOT NULL")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "preferences")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient, pairs = measured(rows, w)
        scale = c / max(pairs, 1.0)
        return w @ w / 2 + scale * loss, w + scale * gradient

    first = value(np.zeros(width))[1] if width else np.zeros(0)
    if not first.any():
        return LinearRanker("pairwise", c, [0.0] * width, 0.0, 0.0, {}, 1)
    w, _, g, calls = descend(value, np.zeros(width), steps, tolerance)
    return LinearRanker("pairwise", c, w.tolist(), 0.0, float(np.linalg.norm(g) / np.linalg.norm(first)), {}, calls)


def rank(model: LinearRanker, pairs: DataFrame, features: str = "features") -> DataFrame:
    """``pairs`` with ``score``, by which the candidates of a case are ranked."""
    return pairs.withColumn("score", model.margin(features))
