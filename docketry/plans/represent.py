"""Queries that build representations of the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions.text import ngrams, term_tokens
from docketry.operators import represent, text
from docketry.plans import views
from docketry.plans.registry import query
from docketry.plans.text import STEMS, TERM_COUNTS
from docketry.plans.views import EMB_PAIRS, PAIR_TABLE
from docketry.session import dealt_texts, free_shuffles, materialise, new_path, settled
from docketry.sources.tables import load_representation, save_representation

MIN_DF, MAX_DF = 5, 0.8
WEIGHTS = f"""{TERM_COUNTS},
vocabulary AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM term_counts GROUP BY term
               HAVING count(*) >= {MIN_DF} AND count(*) <= {MAX_DF}e0 * (SELECT count(*) FROM documents)),
bow AS (SELECT doc_id, term, tf FROM term_counts JOIN vocabulary USING (term)),
weights AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w
            FROM term_counts JOIN vocabulary USING (term)),
tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS value FROM weights)"""

# the same over stems
STEM_WEIGHTS = f"""{TERM_COUNTS}, {STEMS}, stem_counts AS (SELECT doc_id, stem AS term, CAST(sum(tf) AS BIGINT) AS tf
  FROM term_counts JOIN stems USING (term) GROUP BY doc_id, stem){WEIGHTS[len(TERM_COUNTS) :].replace("term_counts", "stem_counts")}"""
STOP_WORDS = ("the", "of", "de", "der", "la")


def stemmed_counts(spark, sf_dir):
    """Term counts of all documents over Porter stems, written once."""
    plain = counts(spark, sf_dir)
    return settled(text.stem_terms(plain, text.stem_vocabulary(plain)), name="stemmed")


def counts(spark, sf_dir):
    """Term counts of all documents, written once and read by several steps."""
    written = materialise(represent.term_counts(dealt_texts(views.texts(spark, sf_dir))))
    free_shuffles(spark)  # of the texts
    return written


def tfidf_values(spark, sf_dir):
    docs = views.texts(spark, sf_dir)
    return represent.tfidf(counts(spark, sf_dir), docs, MIN_DF, MAX_DF)


@query(
    "build_corpus",
    f"""WITH {PAIR_TABLE}
    SELECT candidate_id AS doc_id, 'candidate' AS role, md5(candidate_text) AS digest FROM pair_table
    UNION ALL SELECT DISTINCT case_id, 'case', md5(case_text) FROM pair_table""",
)
def build_corpus(spark, sf_dir):
    corpus = represent.build_corpus(views.pair_table(spark, sf_dir))
    return corpus.select("doc_id", "role", F.md5("text").alias("digest"))


@query("raw", "SELECT doc_id, text FROM documents")
def raw(spark, sf_dir):
    return represent.raw(views.documents(spark, sf_dir))


@query("vocabulary", f"WITH {WEIGHTS} SELECT term, df, total FROM vocabulary ORDER BY total DESC, term LIMIT 1000")
def vocabulary(spark, sf_dir):
    docs = views.texts(spark, sf_dir)
    return represent.vocabulary(counts(spark, sf_dir), docs, MIN_DF, MAX_DF, max_features=1000)


@query("bow", f"WITH {WEIGHTS} SELECT doc_id, term, tf FROM bow")
def bow(spark, sf_dir):
    return represent.bow(counts(spark, sf_dir), views.texts(spark, sf_dir), MIN_DF, MAX_DF)


@query("tfidf", f"WITH {WEIGHTS} SELECT doc_id, term, value FROM tfidf", ("value",))
def tfidf(spark, sf_dir):
    return tfidf_values(spark, sf_dir)


@query("bow_stemmed", f"WITH {STEM_WEIGHTS} SELECT doc_id, term, tf FROM bow")
def bow_stemmed(spark, sf_dir):
    return represent.bow(stemmed_counts(spark, sf_dir), views.texts(spark, sf_dir), MIN_DF, MAX_DF)


@query("tfidf_stemmed", f"WITH {STEM_WEIGHTS} SELECT doc_id, term, value FROM tfidf", ("value",))
def tfidf_stemmed(spark, sf_dir):
    return represent.tfidf(stemmed_counts(spark, sf_dir), views.texts(spark, sf_dir), MIN_DF, MAX_DF)


@query(
    "bow_bigrams",
    f"""WITH kept AS (SELECT doc_id, [x FOR x IN regexp_extract_all(lower(text), '[a-z]{{2,}}')
        IF x NOT IN {STOP_WORDS}] AS w FROM documents),
    grams AS (SELECT doc_id, w[i] || ' ' || w[i + 1] AS term FROM (SELECT *, unnest(range(1, len(w))) AS i FROM kept)),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL)
    SELECT doc_id, term, tf FROM tf WHERE term IN (SELECT term FROM tf GROUP BY term HAVING count(*) >= {MIN_DF}
      AND count(*) <= {MAX_DF}e0 * (SELECT count(*) FROM documents))""",
)
def bow_bigrams(spark, sf_dir):
    """Pairs of neighbouring words, without a few stop words."""
    docs = views.texts(spark, sf_dir)
    pairs = materialise(represent.term_counts(dealt_texts(docs), lambda column: ngrams(term_tokens(column), 2, 2, STOP_WORDS)))
    return represent.bow(pairs, docs, MIN_DF, MAX_DF)


@query("save_representation", f"WITH {WEIGHTS} SELECT doc_id, term, value FROM tfidf", ("value",))
def saved_representation(spark, sf_dir):
    path = new_path(spark, "tfidf")
    save_representation(tfidf_values(spark, sf_dir), path)
    return load_representation(spark, path)


@query("lsa")
def lsa(spark, sf_dir):
    """Signs and near-equal components are free, so there is no SQL; the tests check what any truncated SVD
    keeps to, and the vectors against numpy."""
    vectors, _ = represent.lsa(tfidf_values(spark, sf_dir), k=20)
    return vectors.select("doc_id", F.posexplode("vector").alias("component", "value"))


@query(
    "dense_vectors",
    f"""WITH {EMB_PAIRS}, corpus AS (SELECT candidate_id AS doc_id FROM emb_pairs
                                     UNION SELECT case_id FROM emb_pairs)
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, vector[i] AS value
    FROM (SELECT doc_id, vector, unnest(range(1, len(vector) + 1)) AS i FROM corpus JOIN emb_rows ON vec_id = doc_id)""",
)
def dense_vectors(spark, sf_dir):
    pairs = views.emb_pairs(spark, sf_dir)
    corpus = pairs.select(F.col("candidate_id").alias("doc_id")).union(pairs.select("case_id")).distinct()
    found = represent.dense_vectors(corpus, views.vectors(spark, sf_dir))
    return found.select("doc_id", F.posexplode("vector").alias("pos", "value"))


@query(
    "pair_features",
    f"""WITH {EMB_PAIRS}, features AS (SELECT case_id, candidate_id, rel, case_vec || cand_vec AS f FROM emb_joined)
    SELECT case_id, candidate_id, rel, CAST(i - 1 AS INTEGER) AS pos, f[i] AS value
    FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM features)""",
)
def pair_features(spark, sf_dir):
    pairs = represent.pair_features(views.emb_pairs(spark, sf_dir), views.vectors(spark, sf_dir))
    return pairs.select("case_id", "candidate_id", "rel", F.posexplode("features").alias("pos", "value"))


@query(
    "sparse_pair_features",
    f"""WITH {PAIR_TABLE}, {WEIGHTS}
    SELECT case_id, candidate_id, side, count(*) AS terms, sum(value) AS total FROM (
      SELECT case_id, candidate_id, 'case' AS side, value FROM text_pairs JOIN tfidf ON doc_id = case_id
      UNION ALL
      SELECT case_id, candidate_id, 'candidate', value FROM text_pairs JOIN tfidf ON doc_id = candidate_id)
    GROUP BY ALL""",
    ("total",),
)
def sparse_pair_features(spark, sf_dir):
    rows = represent.sparse_pair_features(views.text_pairs(spark, sf_dir), tfidf_values(spark, sf_dir))
    return rows.groupBy("case_id", "candidate_id", "side").agg(
        F.count("*").alias("terms"), F.sum("value").alias("total")
    )


@query(
    "split_representation",
    f"""WITH {EMB_PAIRS}
    SELECT case_id, CAST(NULL AS BIGINT) AS candidate_id, list_sum(vector) AS total
    FROM (SELECT DISTINCT case_id FROM emb_pairs) JOIN emb_rows ON vec_id = case_id
    UNION ALL SELECT case_id, candidate_id, list_sum(cand_vec) FROM emb_joined""",
    ("total",),
)
def split_representation(spark, sf_dir):
    cases, candidates = represent.split_representation(
        views.emb_pairs(spark, sf_dir), views.vectors(spark, sf_dir)
    )
    total = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x).alias("total")
    left = cases.select("case_id", F.lit(None).cast("bigint").alias("candidate_id"), total)
    return left.unionByName(candidates.select("case_id", "candidate_id", total))


LETTERS = "etaoinsh"


def letter_encoder():
    """A stand-in for a user's model: how often each of eight letters stands in either text."""
    import numpy as np

    def encode(texts_a, texts_b):
        return np.array([[float(t.count(c)) for t in pair for c in LETTERS] for pair in zip(texts_a, texts_b)])

    return encode


@query(
    "pair_encode",
    f"""WITH {PAIR_TABLE} SELECT case_id, candidate_id, CAST(i AS INTEGER) AS pos,
      CAST(length(text) - length(replace(text, substr('{LETTERS}', i % 8 + 1, 1), '')) AS DOUBLE) AS value
    FROM (SELECT case_id, candidate_id, i, CASE WHEN i < 8 THEN case_text ELSE candidate_text END AS text
          FROM pair_table, range(16) t(i))""",
)
def pair_encode(spark, sf_dir):
    """Runs a Python model over both texts."""
    pairs = represent.pair_encode(views.pair_table(spark, sf_dir), letter_encoder)
    return pairs.select("case_id", "candidate_id", F.posexplode("features").alias("pos", "value"))
