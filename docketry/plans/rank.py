"""Queries that score pairs and combine runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions.text import bm25_tokens
from docketry.operators import classify, metrics, represent, score, training
from docketry.plans import views
from docketry.plans.evaluate import emb_run, metrics_at_k
from docketry.plans.registry import query
from docketry.plans.represent import MAX_DF, MIN_DF, STEM_WEIGHTS, WEIGHTS, counts, stemmed_counts, tfidf_values
from docketry.plans.text import BM25_TOKENS
from docketry.plans.views import EMB_PAIRS, ORDER_RUN, TEXT_PAIRS
from docketry.session import dealt_texts, forget, free_shuffles, materialise, new_path, settled


def sparse_cosine_sql(name: str, values: str, value: str) -> str:
    return f"""
{name}_norms AS (SELECT doc_id, sqrt(sum({value} * {value})) AS size FROM {values} GROUP BY doc_id),
{name}_dots AS (SELECT p.case_id, p.candidate_id, sum(CAST(a.{value} * b.{value} AS DOUBLE)) AS dot
  FROM text_pairs p JOIN {values} a ON a.doc_id = p.case_id
  JOIN {values} b ON b.doc_id = p.candidate_id AND b.term = a.term GROUP BY ALL),
{name}_run AS (SELECT p.case_id, p.candidate_id, p.rel, round(coalesce(dot / (x.size * y.size), 0), 6) + 0e0 AS score
  FROM text_pairs p LEFT JOIN {name}_dots d USING (case_id, candidate_id)
  LEFT JOIN {name}_norms x ON x.doc_id = p.case_id LEFT JOIN {name}_norms y ON y.doc_id = p.candidate_id)"""


BM25 = f"""
bm_counts AS (SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest({BM25_TOKENS}) AS term FROM documents) GROUP BY ALL),
bm_lengths AS (SELECT doc_id, coalesce(sum(tf), 0) AS length FROM documents LEFT JOIN bm_counts USING (doc_id) GROUP BY ALL),
bm_shapes AS (SELECT case_id, count(*) AS n, avg(length) AS avgdl FROM text_pairs
  JOIN bm_lengths ON doc_id = candidate_id GROUP BY case_id),
bm_idf AS (SELECT case_id, term, ln(any_value(n) - count(*) + 0.5e0) - ln(count(*) + 0.5e0) AS idf
  FROM text_pairs JOIN bm_counts ON doc_id = candidate_id JOIN bm_shapes USING (case_id) GROUP BY case_id, term),
bm_mean AS (SELECT case_id, avg(idf) AS mean_idf FROM bm_idf GROUP BY case_id),
bm_sums AS (SELECT p.case_id, p.candidate_id,
    sum(q.tf * CASE WHEN idf >= 0 THEN idf ELSE 0.25e0 * mean_idf END
        * d.tf * 2.5e0 / (d.tf + 1.5e0 * (0.25e0 + 0.75e0 * length / avgdl))) AS total
  FROM text_pairs p JOIN bm_counts q ON q.doc_id = p.case_id
  JOIN bm_counts d ON d.doc_id = p.candidate_id AND d.term = q.term
  JOIN bm_idf i ON i.case_id = p.case_id AND i.term = q.term
  JOIN bm_mean m ON m.case_id = p.case_id JOIN bm_shapes s ON s.case_id = p.case_id
  JOIN bm_lengths l ON l.doc_id = p.candidate_id GROUP BY ALL),
bm25_run AS (SELECT case_id, candidate_id, rel, round(coalesce(total, 0), 6) + 0e0 AS score
  FROM text_pairs LEFT JOIN bm_sums USING (case_id, candidate_id))"""

COSINES = f"{sparse_cosine_sql('tfidf', 'tfidf', 'value')}, {sparse_cosine_sql('bow', 'bow', 'tf')}"


def _rounded(run):
    return run.withColumn("score", F.round("score", 6) + F.lit(0.0))


def tfidf_run(spark, sf_dir, term_counts=None):
    term_counts = counts(spark, sf_dir) if term_counts is None else term_counts
    values = represent.tfidf(term_counts, views.texts(spark, sf_dir), MIN_DF, MAX_DF)
    run = score.sparse_cosine_rank(views.text_pairs(spark, sf_dir), values)
    forget(values, term_counts)  # the scores are written
    return _rounded(run)


def bow_run(spark, sf_dir, term_counts=None):
    term_counts = counts(spark, sf_dir) if term_counts is None else term_counts
    values = represent.bow(term_counts, views.texts(spark, sf_dir), MIN_DF, MAX_DF)
    run = score.sparse_cosine_rank(views.text_pairs(spark, sf_dir), values, "tf")
    forget(values, term_counts)
    return _rounded(run)


def bm25_run(spark, sf_dir):
    term_counts = materialise(represent.term_counts(dealt_texts(views.texts(spark, sf_dir)), bm25_tokens))
    free_shuffles(spark)  # of the texts
    run = score.bm25_rank(views.text_pairs(spark, sf_dir), term_counts)
    forget(term_counts, run)  # its documents are written
    return _rounded(run)


@query("cosine_rank", f"WITH {EMB_PAIRS} SELECT case_id, candidate_id, rel, score FROM emb_run")
def cosine_rank(spark, sf_dir):
    return emb_run(spark, sf_dir)


@query(
    "sparse_cosine_rank",
    f"WITH {TEXT_PAIRS}, {WEIGHTS}, {COSINES} SELECT case_id, candidate_id, rel, score FROM tfidf_run",
)
def sparse_cosine_rank(spark, sf_dir):
    return tfidf_run(spark, sf_dir)


@query(
    "sparse_cosine_rank_stemmed",
    f"WITH {TEXT_PAIRS}, {STEM_WEIGHTS}, {COSINES} SELECT case_id, candidate_id, rel, score FROM tfidf_run",
)
def sparse_cosine_rank_stemmed(spark, sf_dir):
    return tfidf_run(spark, sf_dir, stemmed_counts(spark, sf_dir))


@query(
    "sparse_cosine_rank_bow",
    f"WITH {TEXT_PAIRS}, {WEIGHTS}, {COSINES} SELECT case_id, candidate_id, rel, score FROM bow_run",
)
def sparse_cosine_rank_bow(spark, sf_dir):
    return bow_run(spark, sf_dir)


@query("bm25_rank", f"WITH {TEXT_PAIRS}, {BM25} SELECT case_id, candidate_id, rel, score FROM bm25_run")
def bm25_rank(spark, sf_dir):
    return bm25_run(spark, sf_dir)


def _method_sql(method: str, table: str) -> str:
    return f"""
{method}_means AS (WITH {metrics_at_k(table)}
  SELECT k, avg(p) AS p, avg(recall) AS recall, avg(f1) AS f1 FROM at_k GROUP BY k),
{method}_measures AS (SELECT '{method}' AS method, 'P_' || k AS measure, p AS value FROM {method}_means
  UNION ALL SELECT '{method}', 'recall_' || k, recall FROM {method}_means
  UNION ALL SELECT '{method}', 'f1_' || k, f1 FROM {method}_means)"""


@query(
    "evaluate_methods",
    f"""WITH {TEXT_PAIRS}, {WEIGHTS}, {COSINES}, {BM25},
    {_method_sql('bow', 'bow_run')}, {_method_sql('tfidf', 'tfidf_run')}, {_method_sql('bm25', 'bm25_run')}
    SELECT * FROM bow_measures UNION ALL SELECT * FROM tfidf_measures UNION ALL SELECT * FROM bm25_measures""",
    ("value",),
)
def evaluate_methods(spark, sf_dir):
    bm25 = settled(bm25_run(spark, sf_dir), name="bm25")  # each run's tables are deleted before the next
    term_counts = counts(spark, sf_dir)
    runs = {"bow": bow_run(spark, sf_dir, term_counts), "tfidf": tfidf_run(spark, sf_dir, term_counts), "bm25": bm25}
    forget(term_counts, *runs.values())
    return metrics.evaluate_methods(runs)


@query("rank_run", f"WITH {EMB_PAIRS} SELECT case_id, candidate_id, score FROM emb_run")
def rank_run(spark, sf_dir):
    return score.rank_run(emb_run(spark, sf_dir))


def two_runs(spark, sf_dir):
    """Both steps of the order run as separate runs; the second has fewer pairs."""
    both = views.order_run(spark, sf_dir)
    first = both.select("case_id", "candidate_id", F.col("score_01").alias("score"), "rel")
    second = both.filter("score_02 IS NOT NULL").select(
        "case_id", "candidate_id", F.col("score_02").alias("score"), "rel"
    )
    return first, second


@query(
    "fuse_runs",
    f"""WITH {ORDER_RUN} SELECT case_id, candidate_id, score_01 AS score_1, score_02 AS score_2, rel
    FROM order_run WHERE score_02 IS NOT NULL""",
)
def fuse_runs(spark, sf_dir):
    first, second = two_runs(spark, sf_dir)
    return score.fuse_runs(first, second, views.order_run(spark, sf_dir))


@query(
    "log_score",
    f"""WITH {ORDER_RUN} SELECT case_id, candidate_id, score_01 AS score_1, score_02 AS score_2, rel,
    ln(score_01) AS new_score FROM order_run WHERE score_02 IS NOT NULL""",
    ("new_score",),
)
def log_score(spark, sf_dir):
    return score.log_score(fuse_runs(spark, sf_dir))


@query("unfold_scores", f"WITH {ORDER_RUN} SELECT case_id, candidate_id, score FROM run")
def unfold_scores(spark, sf_dir):
    """A list of scores per query, as long as its candidates, as a list-wise model returns it, laid out over the pairs."""
    run = views.run(spark, sf_dir)
    longest = run.groupBy("case_id").count().agg(F.max("count")).first()[0] or 0
    lists = training.ltr_lists(run.withColumn("features", F.array("score")), longest, 1)
    scores = lists.select(F.col("qid").alias("case_id"), F.transform("features", lambda f: f[0]).alias("scores"))
    return score.unfold_scores(scores, run)


@query(
    "attach_external_scores",
    f"WITH {ORDER_RUN} SELECT case_id, candidate_id, rel, score_02 AS score FROM order_run WHERE score_02 IS NOT NULL",
)
def attach_external_scores(spark, sf_dir):
    """Probabilities of two classes, as a classifier returns them, attached to the pairs it has scored."""
    both = views.order_run(spark, sf_dir)
    classes = both.filter("score_02 IS NOT NULL").select(
        "case_id", "candidate_id", F.array(1 - F.col("score_02"), "score_02").alias("probabilities")
    )
    return score.attach_external_scores(both.select("case_id", "candidate_id", "rel"), classes)


@query("rerank_merge", f"WITH {ORDER_RUN} SELECT case_id, candidate_id, score_01, rel, score_02 FROM order_run")
def rerank_merge(spark, sf_dir):
    return score.rerank_merge(*two_runs(spark, sf_dir))


def balanced_sides(spark, sf_dir):
    """Vector pairs split by case, each side balanced by synthetic points."""
    pairs = represent.pair_features(views.emb_pairs(spark, sf_dir), views.vectors(spark, sf_dir))
    split = materialise(training.grouped_split(pairs))
    sides = {}
    for side in ("train", "test"):
        rows = split.filter(F.col("side") == side)
        sides[side] = training.smote(rows, ["case_id", "candidate_id"])
    return pairs, sides["train"], sides["test"]


@query("logistic_rank")
def logistic_rank(spark, sf_dir):
    """Train on the balanced training side, then score every pair."""
    pairs, train, _ = balanced_sides(spark, sf_dir)
    scored = classify.predict(classify.logistic_rank(train), pairs)
    return scored.select("case_id", "candidate_id", "rel", "score", "raw_score")


@query("logistic_rank_sparse")
def logistic_rank_sparse(spark, sf_dir):
    """A logistic regression on TF-IDF weights of both documents of a pair, without making them dense."""
    values = tfidf_values(spark, sf_dir)
    pairs = represent.sparse_pair_vectors(views.text_pairs(spark, sf_dir), values)
    forget(values)  # the vectors are written
    split = training.grouped_split(pairs)
    train = training.oversample(materialise(split.filter("side = 'train'")), ["case_id", "candidate_id"])
    model = classify.logistic_rank(train, cs=(1.0,))
    forget(train, pairs)  # the training rows have been learnt from
    free_shuffles(spark)
    return classify.predict(model, pairs).select("case_id", "candidate_id", "rel", "score", "raw_score")


@query("svm_rank")
def svm_rank(spark, sf_dir):
    """As for the logistic regression, with C searched over folds of cases."""
    pairs, train, _ = balanced_sides(spark, sf_dir)
    scored = classify.predict(classify.svm_rank(train), pairs)
    return scored.select("case_id", "candidate_id", "rel", "score", "raw_score")


@query("grid_search")
def grid_search(spark, sf_dir):
    """The confusion matrix on the balanced test side after a search over folds of cases."""
    _, train, test = balanced_sides(spark, sf_dir)
    model = classify.grid_search(train, "logistic", (0.01, 0.1))
    return metrics.confusion_matrix(classify.predict(model, test), 0.5)


@query("save_ranker")
def save_ranker(spark, sf_dir):
    """A trained ranker written, read back and applied."""
    pairs, train, _ = balanced_sides(spark, sf_dir)
    path = new_path(spark, "ranker")
    classify.save_ranker(classify.logistic_rank(train, cs=(1.0,)), path)
    scored = classify.predict(classify.load_ranker(path), pairs)
    return scored.select("case_id", "candidate_id", "rel", "score", "raw_score")
