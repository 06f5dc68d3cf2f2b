"""Views over the test tables, each as a DataFrame and as the SQL of a common table expression.

Pair tables are made by equi-joins and grow with their table: the rows of a block of consecutive ids
(within one source, for documents) form a case, the first row being the query and all others its
candidates. Every row of a table takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

VECTOR_BLOCK = 50
DOCUMENT_BLOCK = 1000
CUSTOMER_BLOCK = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark, sf_dir) -> DataFrame:
    """(doc_id, vector)"""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector")
    )


def emb_pairs(spark, sf_dir) -> DataFrame:
    """(case_id, candidate_id, rel): vectors of a block against its first; relevant when labels agree."""
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.floor(F.col("vec_id") / VECTOR_BLOCK).alias("block")
    )
    heads = rows.groupBy("block").agg(
        F.min("vec_id").alias("case_id"), F.min_by("label", "vec_id").alias("case_label")
    )
    return rows.join(heads, "block").filter("vec_id <> case_id").select(
        "case_id",
        F.col("vec_id").alias("candidate_id"),
        F.when(F.col("label") == F.col("case_label"), 1).otherwise(0).alias("rel"),
    )


EMB_PAIRS = f"""
emb_rows AS (SELECT vec_id, label, vec_id // {VECTOR_BLOCK} AS block,
                    CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
emb_heads AS (SELECT block, min(vec_id) AS case_id, min_by(label, vec_id) AS case_label
              FROM emb_rows GROUP BY block),
emb_pairs AS (SELECT case_id, vec_id AS candidate_id, CASE WHEN label = case_label THEN 1 ELSE 0 END AS rel
              FROM emb_rows JOIN emb_heads USING (block) WHERE vec_id <> case_id),
emb_joined AS (SELECT p.case_id, p.candidate_id, p.rel, a.vector AS case_vec, b.vector AS cand_vec
               FROM emb_pairs p JOIN emb_rows a ON a.vec_id = p.case_id
               JOIN emb_rows b ON b.vec_id = p.candidate_id),
emb_run AS (SELECT case_id, candidate_id, rel, round(list_dot_product(case_vec, cand_vec)
            / (sqrt(list_dot_product(case_vec, case_vec)) * sqrt(list_dot_product(cand_vec, cand_vec))), 6)
            + 0e0 AS score FROM emb_joined)"""


def texts(spark, sf_dir) -> DataFrame:
    """(doc_id, text) as they are read, for what deals them out itself."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def documents(spark, sf_dir) -> DataFrame:
    """(doc_id, text)"""
    return texts(spark, sf_dir).repartition("doc_id")


def text_pairs(spark, sf_dir) -> DataFrame:
    """(case_id, candidate_id, rel): documents of one source and block against the first of them."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.floor(F.col("doc_id") / DOCUMENT_BLOCK).alias("block")
    )
    heads = rows.groupBy("source", "block").agg(F.min("doc_id").alias("case_id"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("candidate_id"), "quality")
    pairs = rows.join(heads, ["source", "block"]).filter("doc_id <> case_id")
    return pairs.select("case_id", F.col("doc_id").alias("candidate_id")).join(
        labels, "candidate_id", "left"
    ).select("case_id", "candidate_id", F.coalesce("quality", F.lit(0)).alias("rel"))


TEXT_PAIRS = f"""
doc_rows AS (SELECT doc_id, source, doc_id // {DOCUMENT_BLOCK} AS block FROM documents),
doc_heads AS (SELECT source, block, min(doc_id) AS case_id FROM doc_rows GROUP BY source, block),
text_pairs AS (SELECT h.case_id, r.doc_id AS candidate_id, coalesce(l.quality, 0) AS rel
               FROM doc_rows r JOIN doc_heads h USING (source, block)
               LEFT JOIN labels l ON l.doc_id = r.doc_id WHERE r.doc_id <> h.case_id)"""


def pair_table(spark, sf_dir) -> DataFrame:
    """The pair table with texts: (case_id, case_text, candidate_id, candidate_text, candidate_is_noticed)."""
    texts = documents(spark, sf_dir)
    case_side = texts.select(F.col("doc_id").alias("case_id"), F.col("text").alias("case_text"))
    candidate_side = texts.select(F.col("doc_id").alias("candidate_id"), F.col("text").alias("candidate_text"))
    joined = text_pairs(spark, sf_dir).join(candidate_side, "candidate_id").join(case_side, "case_id")
    return joined.select(
        "case_id", "case_text", "candidate_id", "candidate_text", (F.col("rel") == 1).alias("candidate_is_noticed")
    )


PAIR_TABLE = (
    TEXT_PAIRS
    + """,
pair_table AS (SELECT p.case_id, a.text AS case_text, p.candidate_id, b.text AS candidate_text,
                      p.rel = 1 AS candidate_is_noticed
               FROM text_pairs p JOIN documents a ON a.doc_id = p.case_id
               JOIN documents b ON b.doc_id = p.candidate_id)"""
)


def order_run(spark, sf_dir) -> DataFrame:
    """A judged two-step run over orders: the orders of a block of customers are one case's candidates.

    Four decimals put scores exactly on cuts and make ties; the second step scores pairs above 0.9.
    """
    score = F.floor(F.col("o_totalprice") / F.lit(50.0)) / F.lit(10000.0)
    second = (F.col("o_orderkey") * 7919 % 10007).cast("double") / F.lit(10007).cast("double")
    return table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_custkey") / CUSTOMER_BLOCK).alias("case_id"),
        F.col("o_orderkey").alias("candidate_id"),
        score.alias("score_01"),
        F.when(score > 0.9, second).alias("score_02"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("rel"),
    )


def run(spark, sf_dir) -> DataFrame:
    """(case_id, candidate_id, score, rel): the first step of ``order_run``."""
    return order_run(spark, sf_dir).select("case_id", "candidate_id", F.col("score_01").alias("score"), "rel")


ORDER_RUN = f"""
order_run AS (SELECT o_custkey // {CUSTOMER_BLOCK} AS case_id, o_orderkey AS candidate_id,
    floor(o_totalprice / 50e0) / 10000e0 AS score_01,
    CASE WHEN floor(o_totalprice / 50e0) / 10000e0 > 0.9e0
         THEN CAST(o_orderkey * 7919 % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) END AS score_02,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS rel FROM orders),
run AS (SELECT case_id, candidate_id, score_01 AS score, rel FROM order_run),
rels AS (SELECT case_id, count(*) AS rels FROM run WHERE rel = 1 GROUP BY case_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, candidate_id) AS rank FROM run)"""


def holdout_ids(spark, sf_dir) -> DataFrame:
    """(case_id): cases whose customers have a mean account balance above 4500."""
    balances = table(spark, sf_dir, "customer").groupBy(
        F.floor(F.col("c_custkey") / CUSTOMER_BLOCK).alias("case_id")
    ).agg(F.round(F.avg("c_acctbal"), 2).alias("balance"))
    return balances.filter("balance > 4500").select("case_id")


HOLDOUT = f"""
holdout AS (SELECT c_custkey // {CUSTOMER_BLOCK} AS case_id FROM customer GROUP BY 1
            HAVING round(avg(c_acctbal), 2) > 4500)"""
