"""Queries over judged runs: ranks, metrics, sweeps, cascades and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import cascade, curves, metrics, ranking, sweeps
from docketry.operators.score import cosine_rank
from docketry.plans import views
from docketry.plans.registry import query
from docketry.plans.views import EMB_PAIRS, ORDER_RUN
from docketry.session import materialise

RPF = ("r", "p", "f1")
# r, p and f1 from the columns found, returned and rels of a subquery
POOLED = """
    CASE WHEN rels > 0 THEN found / rels ELSE 0 END AS r,
    CASE WHEN returned > 0 THEN found / returned ELSE 0 END AS p,
    CASE WHEN found > 0 THEN 2 * (found / returned) * (found / rels) / (found / returned + found / rels)
         ELSE 0 END AS f1"""


def emb_run(spark, sf_dir):
    """The cosine run over vector pairs, scores rounded before ranking."""
    scored = cosine_rank(views.emb_pairs(spark, sf_dir), views.vectors(spark, sf_dir))
    return scored.withColumn("score", F.round("score", 6) + F.lit(0.0))


@query(
    "rank_positions",
    f"WITH {ORDER_RUN} SELECT case_id, candidate_id, score, rel, rank FROM ranked",
)
def rank_positions(spark, sf_dir):
    return ranking.rank_positions(views.run(spark, sf_dir))


@query(
    "rank_positions_trec",
    f"""WITH {ORDER_RUN} SELECT case_id, candidate_id, score, rel,
    row_number() OVER (PARTITION BY case_id ORDER BY score DESC, CAST(candidate_id AS VARCHAR) DESC) AS rank
    FROM run""",
)
def rank_positions_trec(spark, sf_dir):
    return ranking.rank_positions(views.run(spark, sf_dir), tie="trec")


AVERAGE_RANK = """
    rank() OVER (PARTITION BY case_id ORDER BY {score} DESC)
    + (count(*) OVER (PARTITION BY case_id, {score}) - 1) / 2"""


@query(
    "average_rank",
    f"""WITH {ORDER_RUN} SELECT case_id, candidate_id, score, rel, {AVERAGE_RANK.format(score='score')} AS avg_rank
    FROM run""",
    ("avg_rank",),
)
def average_rank(spark, sf_dir):
    return ranking.average_rank(views.run(spark, sf_dir))


def metrics_at_k(run_table: str, cuts: str = "(5), (10), (15), (20), (30), (100), (200), (500), (1000)") -> str:
    """Per-case metrics of a run as common table expressions."""
    return f"""
cuts(k) AS (VALUES {cuts}),
sizes AS (SELECT case_id, count(*) AS n, sum(rel) AS rels FROM {run_table} GROUP BY case_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, candidate_id) AS place
           FROM {run_table}),
hits AS (SELECT s.case_id, k, rels, count(p.case_id) AS found FROM sizes s CROSS JOIN cuts
         LEFT JOIN placed p ON p.case_id = s.case_id AND p.place <= k AND p.rel = 1
         WHERE rels > 0 AND k < (SELECT max(n) FROM sizes) GROUP BY s.case_id, k, rels),
at_k AS (SELECT case_id, k, found / k AS p, found / rels AS recall,
         CASE WHEN found > 0 THEN 2 * (found / k) * (found / rels) / (found / k + found / rels) ELSE 0 END AS f1
         FROM hits)"""


@query(
    "precision_recall_at_k",
    f"WITH {ORDER_RUN}, {metrics_at_k('run')} SELECT case_id, k, p, recall FROM at_k",
    ("p", "recall"),
)
def precision_recall_at_k(spark, sf_dir):
    return metrics.precision_recall_at_k(views.run(spark, sf_dir))


@query(
    "f1_at_k",
    f"""WITH {EMB_PAIRS}, {metrics_at_k('emb_run')}
    SELECT k, avg(p) AS p, avg(recall) AS recall, avg(f1) AS f1 FROM at_k GROUP BY k""",
    ("p", "recall", "f1"),
)
def f1_at_k(spark, sf_dir):
    """Flagship: vector pairs -> cosine -> rank -> mean precision, recall and F1 at k."""
    return metrics.f1_at_k(materialise(emb_run(spark, sf_dir)))


def pooled_sweep(score: str, low: int, high: int, steps: int, rows: str = "order_run") -> str:
    return f"""
    SELECT cut, {POOLED} FROM (
      SELECT c.cut, (SELECT sum(rel) FROM {rows}) AS rels, coalesce(sum(s.n), 0) AS returned,
             coalesce(sum(s.found), 0) AS found
      FROM (SELECT i / {steps}e0 AS cut FROM range({low}, {high}) t(i)) c
      LEFT JOIN (SELECT {score} AS score, count(*) AS n, sum(rel) AS found FROM {rows} GROUP BY 1) s
        ON s.score > c.cut GROUP BY c.cut) x"""


SCORE_SWEEP = pooled_sweep("score_01", 0, 10000, 10000)


@query("score_cut_sweep", f"WITH {ORDER_RUN} {SCORE_SWEEP}", RPF)
def score_cut_sweep(spark, sf_dir):
    return sweeps.score_cut_sweep(views.run(spark, sf_dir))


@query("score_cut_sweep_high", f"WITH {ORDER_RUN} {pooled_sweep('score_01', 9000, 10000, 10000)}", RPF)
def score_cut_sweep_high(spark, sf_dir):
    return sweeps.score_cut_sweep(views.run(spark, sf_dir), 0.9, 1.0)


@query(
    "macro_cut_sweep",
    f"""WITH {ORDER_RUN}, counted AS (
      SELECT c.cut, t.case_id, t.rels, count(r.case_id) AS returned, coalesce(sum(r.rel), 0) AS found
      FROM (SELECT i / 10000e0 AS cut FROM range(9000, 10000) t(i)) c CROSS JOIN rels t
      LEFT JOIN run r ON r.case_id = t.case_id AND r.score > c.cut GROUP BY ALL)
    SELECT cut, avg(r) AS r, avg(p) AS p, avg(f1) AS f1 FROM (SELECT cut, {POOLED} FROM counted) GROUP BY cut""",
    RPF,
)
def macro_cut_sweep(spark, sf_dir):
    return sweeps.macro_cut_sweep(views.run(spark, sf_dir), 0.9, 1.0)


@query(
    "macro_cut_sweep_full",
    f"""WITH {ORDER_RUN}, counted AS (
      SELECT c.cut, t.case_id, t.rels, count(r.case_id) AS returned, coalesce(sum(r.rel), 0) AS found
      FROM (SELECT i / 1000e0 AS cut FROM range(0, 1000) t(i)) c CROSS JOIN rels t
      LEFT JOIN run r ON r.case_id = t.case_id AND r.score > c.cut GROUP BY ALL)
    SELECT cut, avg(r) AS r, avg(p) AS p, avg(f1) AS f1 FROM (SELECT cut, {POOLED} FROM counted) GROUP BY cut""",
    RPF,
)
def macro_cut_sweep_full(spark, sf_dir):
    """The default range from 0 to 1, in steps of a thousandth."""
    return sweeps.macro_cut_sweep(views.run(spark, sf_dir), steps=1000)


GRID = [i / 8 for i in range(-8, 9)]


@query(
    "grid_cut_sweep",
    f"""WITH {EMB_PAIRS} SELECT cut, {POOLED} FROM (
      SELECT c.cut, (SELECT sum(rel) FROM emb_run) AS rels, count(r.score) AS returned,
             coalesce(sum(r.rel), 0) AS found
      FROM (SELECT i / 8e0 AS cut FROM range(-8, 9) t(i)) c LEFT JOIN emb_run r ON r.score > c.cut
      GROUP BY c.cut)""",
    RPF,
)
def grid_cut_sweep(spark, sf_dir):
    return sweeps.grid_cut_sweep(emb_run(spark, sf_dir), GRID)


RANK_SWEEP = f"""
    SELECT cut, {POOLED} FROM (
      SELECT c.cut, (SELECT sum(rel) FROM run) AS rels, sum(s.n) AS returned, sum(s.found) AS found
      FROM (SELECT CAST(i AS INTEGER) AS cut FROM range(1, 201) t(i)) c
      JOIN (SELECT rank, count(*) AS n, sum(rel) AS found FROM ranked GROUP BY rank) s ON s.rank <= c.cut
      GROUP BY c.cut) x"""


@query("rank_cut_sweep", f"WITH {ORDER_RUN} {RANK_SWEEP}", RPF)
def rank_cut_sweep(spark, sf_dir):
    return sweeps.rank_cut_sweep(views.run(spark, sf_dir))


def best_of(sweep: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, cut, {m} AS value, r, p, f1, "
        f"row_number() OVER (ORDER BY round({m}, 9) DESC, cut) AS place FROM swept"
        for m in RPF
    )
    return f"swept AS ({sweep}), best AS ({parts}) SELECT metric, cut, value, r, p, f1 FROM best WHERE place = 1"


@query("best_cut", f"WITH {ORDER_RUN}, {best_of(SCORE_SWEEP)}", ("value", *RPF))
def best_cut(spark, sf_dir):
    swept = sweeps.score_cut_sweep(views.run(spark, sf_dir))
    return sweeps.best_cut(swept)


@query("best_rank_cut", f"WITH {ORDER_RUN}, {best_of(RANK_SWEEP)}", ("value", *RPF))
def best_rank_cut(spark, sf_dir):
    return sweeps.best_cut(sweeps.rank_cut_sweep(views.run(spark, sf_dir)))


CASE_REPORT = f"""
report AS (SELECT case_id, {POOLED}, returned, found, rels FROM (
  SELECT t.case_id, t.rels, count(*) FILTER (r.score > 0.946) AS returned,
         count(*) FILTER (r.score > 0.946 AND r.rel = 1) AS found
  FROM rels t JOIN run r USING (case_id) GROUP BY t.case_id, t.rels))"""


def report(spark, sf_dir):
    return sweeps.case_report(views.run(spark, sf_dir), 0.946)


@query("case_report", f"WITH {ORDER_RUN}, {CASE_REPORT} SELECT * FROM report", RPF)
def case_report(spark, sf_dir):
    return report(spark, sf_dir)


@query("good_cases", f"WITH {ORDER_RUN}, {CASE_REPORT} SELECT * FROM report WHERE f1 > 0.2", RPF)
def good_cases(spark, sf_dir):
    return sweeps.good_cases(report(spark, sf_dir), 0.2)


@query("rels_per_case", f"WITH {ORDER_RUN} SELECT case_id, rels FROM rels")
def rels_per_case(spark, sf_dir):
    return metrics.rels_per_case(views.run(spark, sf_dir))


@query("avg_rels", f"WITH {ORDER_RUN} SELECT avg(rels) AS avg_rels FROM rels", ("avg_rels",))
def avg_rels(spark, sf_dir):
    return metrics.avg_rels(views.run(spark, sf_dir))


MAX_METRICS = f"""
    SELECT cut, {POOLED} FROM (
      SELECT c.cut, sum(t.rels) AS rels, sum(least(t.rels, c.cut)) AS found,
             (SELECT count(DISTINCT case_id) FROM run) * c.cut AS returned
      FROM (SELECT CAST(i AS INTEGER) AS cut FROM range(1, 201) t(i)) c CROSS JOIN rels t GROUP BY c.cut) x"""


@query("max_metrics_at_k", f"WITH {ORDER_RUN} {MAX_METRICS}", RPF)
def max_metrics_at_k(spark, sf_dir):
    return sweeps.max_metrics_at_k(views.run(spark, sf_dir))


@query(
    "relative_metrics_at_k",
    f"""WITH {ORDER_RUN}, swept AS ({RANK_SWEEP}), bound AS ({MAX_METRICS})
    SELECT cut, s.r, s.p, s.f1, s.r / b.r AS r_rel, s.p / b.p AS p_rel, s.f1 / b.f1 AS f1_rel
    FROM swept s JOIN bound b USING (cut)""",
    (*RPF, "r_rel", "p_rel", "f1_rel"),
)
def relative_metrics_at_k(spark, sf_dir):
    return sweeps.relative_metrics_at_k(views.run(spark, sf_dir))


def cascade_sql(first_ok: str, second_ok: str, grid_1: str, grid_2: str, rows: str = "order_run") -> str:
    """Pairs below 0.9 depend on the first cut only, the others on both; each part is counted apart."""
    return f"""
    g1 AS ({grid_1}), g2 AS ({grid_2}), src AS (SELECT * FROM {rows}),
    low AS (SELECT g1.cut_01, count(s.case_id) AS n, coalesce(sum(s.rel), 0) AS found
            FROM g1 LEFT JOIN src s ON s.score_01 < 0.9e0 AND {first_ok} GROUP BY 1),
    high AS (SELECT g1.cut_01, g2.cut_02, count(*) AS n, sum(s.rel) AS found
             FROM (SELECT * FROM src WHERE NOT score_01 < 0.9e0) s JOIN g1 ON {first_ok} JOIN g2 ON {second_ok}
             GROUP BY 1, 2)
    SELECT cut_01, cut_02, {POOLED} FROM (
      SELECT g1.cut_01, g2.cut_02, (SELECT sum(rel) FROM order_run) AS rels,
             l.n + coalesce(h.n, 0) AS returned, l.found + coalesce(h.found, 0) AS found
      FROM g1 CROSS JOIN g2 JOIN low l ON l.cut_01 = g1.cut_01
      LEFT JOIN high h ON h.cut_01 = g1.cut_01 AND h.cut_02 = g2.cut_02) x"""


SCORE_GRID_1 = "SELECT i / 200e0 AS cut_01 FROM range(0, 200) t(i)"
SCORE_GRID_2 = "SELECT i / 200e0 AS cut_02 FROM range(0, 200) t(i)"
RANK_GRID_1 = "SELECT CAST(i AS INTEGER) AS cut_01 FROM range(1, 201) t(i)"
RANK_GRID_2 = "SELECT CAST(i AS INTEGER) AS cut_02 FROM range(1, 201) t(i)"
RANKS = f"""
ranks_02 AS (SELECT case_id, candidate_id, {AVERAGE_RANK.format(score='score_02')} AS rank_02
             FROM order_run WHERE score_02 IS NOT NULL),
ranks AS (SELECT o.*, {AVERAGE_RANK.format(score='score_01')} AS rank_01, rank_02
          FROM order_run o LEFT JOIN ranks_02 USING (case_id, candidate_id))"""
SCORE_SCORE = cascade_sql("s.score_01 > g1.cut_01", "s.score_02 > g2.cut_02", SCORE_GRID_1, SCORE_GRID_2)


@query("two_step_score_score", f"WITH {ORDER_RUN}, {SCORE_SCORE}", RPF)
def two_step_score_score(spark, sf_dir):
    return cascade.two_step_score_score(views.order_run(spark, sf_dir))


@query(
    "two_step_rank_rank",
    f"WITH {ORDER_RUN}, {RANKS}, "
    + cascade_sql("s.rank_01 <= g1.cut_01", "s.rank_02 <= g2.cut_02", RANK_GRID_1, RANK_GRID_2, "ranks"),
    RPF,
)
def two_step_rank_rank(spark, sf_dir):
    return cascade.two_step_rank_rank(views.order_run(spark, sf_dir))


@query(
    "two_step_rank_score",
    f"WITH {ORDER_RUN}, {RANKS}, "
    + cascade_sql("s.rank_01 <= g1.cut_01", "s.score_02 > g2.cut_02", RANK_GRID_1, SCORE_GRID_2, "ranks"),
    RPF,
)
def two_step_rank_score(spark, sf_dir):
    return cascade.two_step_rank_score(views.order_run(spark, sf_dir))


@query("step2_only_sweep", f"WITH {ORDER_RUN} {pooled_sweep('score_02', 0, 1000, 1000)}", RPF)
def step2_only_sweep(spark, sf_dir):
    return sweeps.step2_only_sweep(views.order_run(spark, sf_dir))


PIVOT_CUTS = [0.0, 0.25, 0.5, 0.75]


@query(
    "cut_grid_pivot",
    f"""WITH {ORDER_RUN}, swept AS (WITH {SCORE_SCORE[4:].lstrip()})
    SELECT cut_01, """
    + ", ".join(f"max(f1) FILTER (cut_02 = {c}) AS f1_{round(c * 100):02d}" for c in PIVOT_CUTS)
    + " FROM swept GROUP BY cut_01",
    [f"f1_{round(c * 100):02d}" for c in PIVOT_CUTS],
)
def cut_grid_pivot(spark, sf_dir):
    swept = cascade.two_step_score_score(views.order_run(spark, sf_dir))
    names = {str(c): f"f1_{round(c * 100):02d}" for c in PIVOT_CUTS}
    return cascade.cut_grid_pivot(swept, "f1", PIVOT_CUTS).withColumnsRenamed(names)


@query(
    "roc_curve",
    f"""WITH {ORDER_RUN}, by_score AS (SELECT score AS threshold, sum(rel) AS pos, sum(1 - rel) AS neg
                                       FROM run GROUP BY score),
    totals AS (SELECT sum(pos) AS p, sum(neg) AS n, max(threshold) AS top FROM by_score)
    SELECT threshold, sum(neg) OVER w / n AS fpr, sum(pos) OVER w / p AS tpr FROM by_score, totals
    WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)
    UNION ALL SELECT top + 1, 0, 0 FROM totals""",
    ("fpr", "tpr"),
)
def roc_curve(spark, sf_dir):
    return curves.roc_curve(views.run(spark, sf_dir))


@query(
    "roc_curve_corners",
    f"""WITH {ORDER_RUN}, by_score AS (SELECT score AS threshold, sum(rel) AS pos, sum(1 - rel) AS neg
                                       FROM run GROUP BY score),
    steps AS (SELECT *, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg,
                     sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM by_score WINDOW w AS (ORDER BY threshold DESC)),
    totals AS (SELECT sum(pos) AS p, sum(neg) AS n, max(threshold) AS top FROM by_score)
    SELECT threshold, fp / n AS fpr, tp / p AS tpr FROM steps, totals
    WHERE next_pos IS NULL OR pos * next_neg <> neg * next_pos
    UNION ALL SELECT top + 1, 0, 0 FROM totals""",
    ("fpr", "tpr"),
)
def roc_curve_corners(spark, sf_dir):
    """The curve's corners only."""
    return curves.roc_curve(views.run(spark, sf_dir), collinear=False)


@query(
    "roc_auc",
    f"""WITH {ORDER_RUN}, placed AS (
      SELECT rel, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS place FROM run)
    SELECT CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives,
           (places - p * (p + 1) / 2) / (p * n) AS auc
    FROM (SELECT CAST(sum(rel) AS DOUBLE) AS p, CAST(sum(1 - rel) AS DOUBLE) AS n,
                 sum(place) FILTER (rel = 1) AS places FROM placed)""",
    ("auc",),
)
def roc_auc(spark, sf_dir):
    return curves.roc_auc(views.run(spark, sf_dir))


@query(
    "score_histogram",
    f"""WITH {ORDER_RUN}, edges AS (
      SELECT CAST(i AS INTEGER) AS bin, i * 0.05e0 AS low, (i + 1) * 0.05e0 AS high FROM range(20) t(i)),
    counts AS (SELECT rel, bin, low, count(*) AS n FROM run JOIN edges
      ON score >= low AND (score < high OR (bin = 19 AND score <= high)) GROUP BY ALL)
    SELECT rel, bin, low, n, n / (sum(n) OVER (PARTITION BY rel) * 0.05e0) AS density FROM counts""",
    ("low", "density"),
)
def score_histogram(spark, sf_dir):
    return curves.score_histogram(views.run(spark, sf_dir))


@query(
    "outside_bins",
    f"""WITH {ORDER_RUN} SELECT rel, count(*) FILTER (score_02 < 0.1e0) AS below, count(*) FILTER (score_02 > 0.1e0 + 16 * 0.05e0) AS above,
    count(*) FILTER (score_02 IS NULL) AS missing FROM order_run GROUP BY rel""",
)
def outside_bins(spark, sf_dir):
    """Second-step scores that a histogram of 16 bins from 0.1 on leaves out."""
    return curves.outside_bins(views.order_run(spark, sf_dir), F.col("score_02"), 0.1, 0.05, 16, ("rel",))


@query(
    "score_histogram_auto",
    f"""WITH {ORDER_RUN}, spans AS (SELECT rel, min(score) AS low, max(score) AS high, count(*) AS total
                                    FROM run GROUP BY rel),
    placed AS (SELECT rel, CAST(least(floor((score - low) / ((high - low) / 20e0)), 19) AS INTEGER) AS bin,
                      total, (high - low) / 20e0 AS width FROM run JOIN spans USING (rel))
    SELECT rel, bin, count(*) AS n, count(*) / (total * width) AS density FROM placed GROUP BY rel, bin, total, width""",
    ("density",),
)
def score_histogram_auto(spark, sf_dir):
    return curves.score_histogram_auto(views.run(spark, sf_dir))


@query(
    "rels_histogram",
    f"""WITH {ORDER_RUN}, grid AS (SELECT CAST(i AS INTEGER) AS bin FROM range(20) t(i)),
    counts AS (SELECT bin, count(case_id) AS n FROM grid LEFT JOIN rels
      ON rels >= bin * 5 AND (rels < bin * 5 + 5 OR (bin = 19 AND rels = 100)) GROUP BY bin)
    SELECT bin, bin * 5 AS low, n, sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS cumulative FROM counts""",
    ("cumulative",),
)
def rels_histogram(spark, sf_dir):
    return curves.rels_histogram(views.run(spark, sf_dir), 5, 20)


@query(
    "returned_histogram",
    f"""WITH {ORDER_RUN}, counts AS (SELECT case_id, count(*) AS returned FROM run WHERE score > 0.97 GROUP BY 1),
    placed AS (SELECT CAST(least(returned, 14) AS INTEGER) AS bin FROM counts WHERE returned <= 15)
    SELECT bin, count(*) AS n, count(*) / sum(count(*)) OVER () AS density FROM placed GROUP BY bin""",
    ("density",),
)
def returned_histogram(spark, sf_dir):
    return curves.returned_histogram(views.run(spark, sf_dir), 0.97)


@query(
    "metric_histograms",
    f"""WITH {ORDER_RUN}, {CASE_REPORT},
    long AS (SELECT 0 AS g, 'r' AS metric, CAST(r AS DOUBLE) AS v FROM report
             UNION ALL SELECT 0, 'p', p FROM report UNION ALL SELECT 0, 'f1', f1 FROM report
             UNION ALL SELECT 1, 'returned', returned FROM report UNION ALL SELECT 1, 'found', found FROM report),
    spans AS (SELECT g, min(v) AS low, max(v) AS high FROM long GROUP BY g),
    placed AS (SELECT metric, CAST(least(floor((v - low) / ((high - low) / 10e0)), 9) AS INTEGER) AS bin,
                      (high - low) / 10e0 AS width FROM long JOIN spans USING (g))
    SELECT metric, bin, count(*) AS n,
           count(*) / (sum(count(*)) OVER (PARTITION BY metric) * width) AS density
    FROM placed GROUP BY metric, bin, width""",
    ("density",),
)
def metric_histograms(spark, sf_dir):
    return curves.metric_histograms(report(spark, sf_dir))


def density_sql(rows: str, high: float, points: int, key: str) -> str:
    return f"""
    SELECT {key}, x, sum(exp(-0.5 * pow((x - v) / h, 2))) / (any_value(size) * any_value(h) * sqrt(2 * pi())) AS density
    FROM {rows} JOIN (SELECT {key}, count(*) AS size, stddev_samp(v) * pow(count(*), -0.2) AS h FROM {rows} GROUP BY 1)
      USING ({key}) CROSS JOIN (SELECT {high} * i / {points}e0 AS x FROM range({points} + 1) t(i))
    GROUP BY {key}, x"""


@query(
    "density_curve",
    f"WITH {ORDER_RUN}, src AS (SELECT rel, score AS v FROM run) {density_sql('src', 1, 50, 'rel')}",
    ("x", "density"),
)
def density_curve(spark, sf_dir):
    rows = views.run(spark, sf_dir)
    return curves.density_curve(rows, 0.0, 1.0, 50, by="rel", value="score")


@query(
    "rels_density",
    f"""WITH {ORDER_RUN}, src AS (SELECT 1 AS one, CAST(rels AS DOUBLE) AS v FROM rels),
    dens AS ({density_sql('src', 100, 100, 'one')}) SELECT x, density FROM dens""",
    ("x", "density"),
)
def rels_density(spark, sf_dir):
    rels = metrics.rels_per_case(views.run(spark, sf_dir))
    return curves.density_curve(rels, 0.0, 100.0, 100, value="rels")


@query(
    "ndcg_at_k",
    f"""WITH {ORDER_RUN}, placed AS (
      SELECT case_id, rel, rank, row_number() OVER (PARTITION BY case_id ORDER BY rel DESC, candidate_id) AS best
      FROM ranked),
    sums AS (SELECT case_id, k, sum((pow(2, rel) - 1) / log2(1 + rank)) FILTER (rank <= k) AS dcg,
                    sum((pow(2, rel) - 1) / log2(1 + best)) FILTER (best <= k) AS ideal
             FROM placed CROSS JOIN (VALUES (1), (3), (5), (10)) c(k) GROUP BY case_id, k)
    SELECT k, avg(dcg / ideal) AS ndcg FROM sums WHERE ideal > 0 GROUP BY k""",
    ("ndcg",),
)
def ndcg_at_k(spark, sf_dir):
    return metrics.ndcg_at_k(views.run(spark, sf_dir))


@query(
    "mrr_at_k",
    f"""WITH {ORDER_RUN}, firsts AS (SELECT case_id, min(rank) AS first FROM ranked WHERE rel = 1 GROUP BY case_id)
    SELECT k, avg(CASE WHEN first <= k THEN 1e0 / first ELSE 0 END) AS mrr
    FROM firsts CROSS JOIN (VALUES (5), (10), (20)) c(k) GROUP BY k""",
    ("mrr",),
)
def mrr_at_k(spark, sf_dir):
    return metrics.mrr_at_k(views.run(spark, sf_dir))


@query(
    "ordered_pair_accuracy_at_k",
    f"""WITH {ORDER_RUN} SELECT k, count(*) FILTER (a.score > b.score) AS correct, count(*) AS pairs,
      count(*) FILTER (a.score > b.score) / count(*) AS opa
    FROM (VALUES (5), (10), (20)) c(k) JOIN ranked a ON a.rank <= k AND a.rel = 1
    JOIN ranked b ON b.case_id = a.case_id AND b.rank <= k AND b.rel = 0 GROUP BY k""",
    ("opa",),
)
def ordered_pair_accuracy_at_k(spark, sf_dir):
    return metrics.ordered_pair_accuracy_at_k(views.run(spark, sf_dir))


@query(
    "ordered_pair_accuracy",
    f"""WITH {ORDER_RUN} SELECT count(*) FILTER (a.score > b.score) AS correct, count(*) AS pairs,
      count(*) FILTER (a.score > b.score) / count(*) AS opa
    FROM run a JOIN run b ON b.case_id = a.case_id AND a.rel = 1 AND b.rel = 0""",
    ("opa",),
)
def ordered_pair_accuracy(spark, sf_dir):
    return metrics.ordered_pair_accuracy(views.run(spark, sf_dir))


CONFUSION = """
cells AS (SELECT count(*) FILTER (score <= 0.5 AND rel = 0) AS tn, count(*) FILTER (score > 0.5 AND rel = 0) AS fp,
                 count(*) FILTER (score <= 0.5 AND rel = 1) AS fn, count(*) FILTER (score > 0.5 AND rel = 1) AS tp
          FROM run)"""


@query(
    "confusion_matrix",
    f"WITH {ORDER_RUN}, {CONFUSION} SELECT tn, fp, fn, tp, (tp + tn) / (tn + fp + fn + tp) AS accuracy FROM cells",
    ("accuracy",),
)
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(views.run(spark, sf_dir))


@query(
    "classification_metrics",
    f"""WITH {ORDER_RUN}, {CONFUSION}
    SELECT (tp + tn) / (tn + fp + fn + tp) AS eval_accuracy, 2 * tp / (2 * tp + fp + fn) AS f1_score,
      (tp / (tp + fn) + tn / (tn + fp)) / 2 AS auc, tp / (tp + fp) AS "precision", tp / (tp + fn) AS recall,
      tp AS true_positives, tn AS true_negatives, fp AS false_positives, fn AS false_negatives FROM cells""",
    ("eval_accuracy", "f1_score", "auc", "precision", "recall"),
)
def classification_metrics(spark, sf_dir):
    return metrics.classification_metrics(views.run(spark, sf_dir))


@query(
    "metric_lookup",
    f"WITH {ORDER_RUN}, swept AS ({RANK_SWEEP}) SELECT * FROM swept WHERE cut IN (5, 10, 15, 20)",
    RPF,
)
def metric_lookup(spark, sf_dir):
    return sweeps.metric_lookup(sweeps.rank_cut_sweep(views.run(spark, sf_dir)), [5, 10, 15, 20])


@query("inspect_case", f"WITH {ORDER_RUN} SELECT case_id, candidate_id, score, rel FROM run WHERE case_id = 14")
def inspect_case(spark, sf_dir):
    return sweeps.inspect_case(views.run(spark, sf_dir), 14)
