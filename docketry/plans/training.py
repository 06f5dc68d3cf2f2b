"""Queries that prepare training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import pairwise, represent, training
from docketry.plans import views
from docketry.plans.evaluate import emb_run
from docketry.plans.registry import query
from docketry.plans.views import EMB_PAIRS, HOLDOUT, ORDER_RUN, TEXT_PAIRS
from docketry.session import materialise

PAIR = ["case_id", "candidate_id"]
SPLIT = """
cases AS (SELECT case_id, row_number() OVER (ORDER BY md5('0:' || case_id), case_id) AS place,
                 count(*) OVER () AS cases FROM (SELECT DISTINCT case_id FROM run)),
split AS (SELECT r.*, CASE WHEN place <= floor(cases * 0.75e0) THEN 'train' ELSE 'test' END AS side
          FROM run r JOIN cases USING (case_id))"""


@query("grouped_split", f"WITH {ORDER_RUN}, {SPLIT} SELECT case_id, candidate_id, score, rel, side FROM split")
def grouped_split(spark, sf_dir):
    return training.grouped_split(views.run(spark, sf_dir))


def held_out(spark, sf_dir):
    train, test = training.holdout_split(views.run(spark, sf_dir), views.holdout_ids(spark, sf_dir))
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


SIDES = f"""{HOLDOUT},
sides AS (SELECT *, CASE WHEN case_id IN (SELECT case_id FROM holdout) THEN 'test' ELSE 'train' END AS side FROM run)"""


@query("holdout_split", f"WITH {ORDER_RUN}, {SIDES} SELECT case_id, candidate_id, score, rel, side FROM sides")
def holdout_split(spark, sf_dir):
    return held_out(spark, sf_dir)


@query("class_counts", f"WITH {ORDER_RUN}, {SIDES} SELECT side, rel, count(*) AS n FROM sides GROUP BY side, rel")
def class_counts(spark, sf_dir):
    return training.class_counts(held_out(spark, sf_dir), "side")


def oversample_sql(rows: str, ratio: str, extra: str = "") -> str:
    """Relevant pairs are the smaller class here."""
    return f"""
    SELECT case_id, candidate_id, score, rel, {extra} CAST(0 AS INTEGER) AS copy FROM {rows} WHERE rel = 0
    UNION ALL
    SELECT case_id, candidate_id, score, rel, {extra} CAST(unnest(range(0, repeats)) AS INTEGER) AS copy FROM (
      SELECT m.*, CAST(wanted // have + CASE WHEN place <= wanted % have THEN 1 ELSE 0 END AS BIGINT) AS repeats FROM (
        SELECT *, row_number() OVER (ORDER BY md5('0:' || case_id || ':' || candidate_id), case_id, candidate_id)
               AS place FROM {rows} WHERE rel = 1) m,
        (SELECT have, greatest(have, CAST(floor({ratio} * more) AS BIGINT)) AS wanted FROM (
          SELECT count(*) FILTER (rel = 1) AS have, count(*) FILTER (rel = 0) AS more FROM {rows})))"""


@query("oversample", f"WITH {ORDER_RUN} {oversample_sql('run', '1e0')}")
def oversample(spark, sf_dir):
    return training.oversample(views.run(spark, sf_dir), PAIR)


@query(
    "oversample_quarter",
    f"""WITH {ORDER_RUN}, {SPLIT}, train AS (SELECT * FROM split WHERE side = 'train'),
    test AS (SELECT * FROM split WHERE side = 'test'),
    both_sides AS ({oversample_sql('train', '0.25e0', 'side,')} UNION ALL {oversample_sql('test', '0.25e0', 'side,')})
    SELECT * FROM both_sides""",
)
def oversample_quarter(spark, sf_dir):
    """Each side of a split brought to one relevant pair per four others."""
    rows = training.grouped_split(views.run(spark, sf_dir))
    train, test = (rows.filter(F.col("side") == side) for side in ("train", "test"))
    return training.oversample(train, PAIR, 0.25).unionByName(training.oversample(test, PAIR, 0.25))


UNIT = "CAST(('0x' || substr(md5('{seed}:' || case_id || ':' || candidate_id || ':' || copy), 1, 8)) AS BIGINT) / 4294967296e0"


@query(
    "smote",
    f"""WITH {EMB_PAIRS}, points AS (SELECT case_id, candidate_id, rel, case_vec || cand_vec AS v FROM emb_joined),
    minority AS (SELECT *, row_number() OVER (ORDER BY md5('0:' || case_id || ':' || candidate_id), case_id, candidate_id)
                 AS place FROM points WHERE rel = 1),
    sizes AS (SELECT count(*) FILTER (rel = 1) AS have, count(*) FILTER (rel = 0) AS more FROM points),
    near AS (SELECT a.case_id, a.candidate_id, b.v AS neighbour, row_number() OVER (
        PARTITION BY a.case_id, a.candidate_id
        ORDER BY round(list_distance(a.v, b.v), 6), b.case_id, b.candidate_id) AS nn
      FROM minority a JOIN minority b ON (a.case_id, a.candidate_id) <> (b.case_id, b.candidate_id)),
    copies AS (SELECT m.case_id, m.candidate_id, m.v, CAST(unnest(range(1,
        1 + (more - have) // have + CASE WHEN place <= (more - have) % have THEN 1 ELSE 0 END)) AS INTEGER) AS copy
      FROM minority m, sizes),
    picked AS (SELECT *, CAST(floor({UNIT.format(seed=0)} * 5) + 1 AS BIGINT) AS nn, {UNIT.format(seed=1)} AS step FROM copies),
    made AS (SELECT case_id, candidate_id, 1 AS rel, copy,
        list_transform(range(1, len(v) + 1), lambda i: v[i] + step * (neighbour[i] - v[i])) AS v
      FROM picked JOIN near USING (case_id, candidate_id, nn)),
    everything AS (SELECT case_id, candidate_id, rel, CAST(0 AS INTEGER) AS copy, v FROM points
                   UNION ALL SELECT case_id, candidate_id, rel, copy, v FROM made)
    SELECT case_id, candidate_id, rel, copy, CAST(i - 1 AS INTEGER) AS pos, v[i] AS value
    FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM everything)""",
    ("value",),
)
def smote(spark, sf_dir):
    pairs = represent.pair_features(views.emb_pairs(spark, sf_dir), views.vectors(spark, sf_dir))
    rows = training.smote(pairs, PAIR)
    return rows.select(*PAIR, "rel", "copy", F.posexplode("features").alias("pos", "value"))


@query(
    "high_score_subset",
    f"""WITH {ORDER_RUN}, {SIDES} SELECT case_id, candidate_id, o_orderpriority AS candidate_text, rel, side
    FROM sides JOIN orders ON o_orderkey = candidate_id WHERE score > 0.9""",
)
def high_score_subset(spark, sf_dir):
    """Pairs with a score above 0.9 with their texts, by side of the hold-out."""
    texts = views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("candidate_id"), F.col("o_orderpriority").alias("candidate_text")
    )
    pairs = held_out(spark, sf_dir).drop("score").join(texts, "candidate_id")
    subset = training.high_score_subset(views.run(spark, sf_dir), pairs)
    return subset.select("case_id", "candidate_id", "candidate_text", "rel", "side")


@query(
    "ltr_lists",
    f"""WITH {ORDER_RUN}, placed AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY candidate_id) AS place
                                     FROM order_run)
    SELECT c.case_id AS qid, CAST(i - 1 AS INTEGER) AS pos, coalesce(CAST(p.rel AS DOUBLE), -1) AS label,
           coalesce(p.score_01, 0) AS first, coalesce(p.score_02, 0) AS second
    FROM (SELECT DISTINCT case_id FROM order_run) c CROSS JOIN range(1, 201) t(i)
    LEFT JOIN placed p ON p.case_id = c.case_id AND p.place = i""",
    ("label", "first", "second"),
)
def ltr_lists(spark, sf_dir):
    features = F.array("score_01", F.coalesce("score_02", F.lit(0.0)))
    lists = training.ltr_lists(views.order_run(spark, sf_dir).withColumn("features", features), 200, 2)
    rows = lists.select("qid", F.posexplode(F.arrays_zip("labels", "features")).alias("pos", "x"))
    return rows.select(
        "qid", "pos", F.col("x.labels").alias("label"), F.col("x.features")[0].alias("first"),
        F.col("x.features")[1].alias("second"),
    )


@query(
    "preference_pairs",
    f"""WITH {EMB_PAIRS}, features AS (SELECT case_id, candidate_id, rel, case_vec || cand_vec AS f FROM emb_joined),
    pairs AS (SELECT a.case_id, a.f AS x, b.f AS y FROM features a JOIN features b
              ON a.case_id = b.case_id AND a.rel > b.rel)
    SELECT case_id, CAST(i - 1 AS INTEGER) AS feature, count(*) AS pairs, sum(x[i] - y[i]) AS difference
    FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM pairs) GROUP BY case_id, i""",
    ("difference",),
)
def preference_pairs(spark, sf_dir):
    """The SQL builds every pair; the operator adds the same sums up without pairs."""
    pairs = represent.pair_features(views.emb_pairs(spark, sf_dir), views.vectors(spark, sf_dir))
    return training.preference_differences(pairs)


@query("pairwise_rank")
def pairwise_rank(spark, sf_dir):
    """Weights of the products of both vectors' components, from the preferences of the training cases; scores of all pairs."""
    both = represent.pair_features(views.emb_pairs(spark, sf_dir), views.vectors(spark, sf_dir))
    half = (F.size("features") / 2).cast("int")
    products = F.zip_with(F.slice("features", F.lit(1), half), F.slice("features", half + 1, half), lambda a, b: a * b)
    pairs = materialise(both.withColumn("features", products))
    train = training.grouped_split(pairs).filter("side = 'train'")
    model = pairwise.pairwise_rank(train)
    return pairwise.rank(model, pairs).select(*PAIR, "rel", "score")


@query(
    "pairwise_logistic_loss",
    f"""WITH {EMB_PAIRS} SELECT c.case_id AS qid, count(a.rel) AS pairs,
      coalesce(sum(ln(1 + exp(b.score - a.score))), 0) AS loss
    FROM (SELECT DISTINCT case_id FROM emb_run) c
    LEFT JOIN (emb_run a JOIN emb_run b ON a.case_id = b.case_id AND a.rel > b.rel) ON a.case_id = c.case_id
    GROUP BY c.case_id""",
    ("loss",),
)
def pairwise_logistic_loss(spark, sf_dir):
    lists = training.ltr_lists(emb_run(spark, sf_dir).withColumn("features", F.array("score")), 60, 1)
    return training.pairwise_logistic_loss(
        lists.select("qid", "labels", F.transform("features", lambda f: f[0]).alias("scores"))
    )


@query(
    "pair_stats",
    f"""WITH {TEXT_PAIRS} SELECT count(*) AS cases, CAST(sum(n) AS BIGINT) AS pairs, min(n) AS min_candidates,
      max(n) AS max_candidates, min(n) = max(n) AS uniform
    FROM (SELECT count(*) AS n FROM text_pairs GROUP BY case_id)""",
)
def pair_stats(spark, sf_dir):
    return training.pair_stats(views.text_pairs(spark, sf_dir))
