"""Queries that write a table in one of the file formats and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import represent
from docketry.plans import views
from docketry.plans.registry import query
from docketry.plans.text import LANGUAGE, SENTENCES, kept_sentences
from docketry.plans.views import EMB_PAIRS, HOLDOUT, ORDER_RUN, PAIR_TABLE, TEXT_PAIRS
from docketry.session import new_path
from docketry.sources import lines, tables, xml

DIGESTS = ("case_text", "candidate_text")


def _digests(pairs):
    return pairs.withColumns({c: F.md5(c) for c in DIGESTS})


@query(
    "read_pairs",
    f"""WITH {PAIR_TABLE} SELECT case_id, md5(case_text) AS case_text, candidate_id,
    md5(candidate_text) AS candidate_text, candidate_is_noticed FROM pair_table""",
)
def read_pairs(spark, sf_dir):
    path = new_path(spark, "pairs")
    tables.write_table(views.pair_table(spark, sf_dir), path)
    return _digests(tables.read_pairs(spark, path))


@query("read_scores", f"WITH {ORDER_RUN} SELECT case_id, candidate_id, score FROM run")
def read_scores(spark, sf_dir):
    path = new_path(spark, "scores")
    tables.write_scores(views.run(spark, sf_dir), path)
    return tables.read_scores(spark, path)


@query("read_case_ids", f"WITH {HOLDOUT} SELECT case_id FROM holdout")
def read_case_ids(spark, sf_dir):
    path = new_path(spark, "ids")
    tables.write_table(views.holdout_ids(spark, sf_dir), path, header=False)
    return tables.read_case_ids(spark, path)


@query("read_corpus", "SELECT md5(text) AS digest FROM documents")
def read_corpus(spark, sf_dir):
    path = new_path(spark, "corpus")
    tables.write_table(views.documents(spark, sf_dir), path, ["text"], header=False)
    return tables.read_corpus(spark, path).select(F.md5("text").alias("digest"))


@query("read_qrels", f"WITH {ORDER_RUN} SELECT case_id, candidate_id, score, rel FROM run")
def read_qrels(spark, sf_dir):
    """Positive judgments written and read back; joining them restores the labels of the run."""
    path = new_path(spark, "qrels")
    run = views.run(spark, sf_dir)
    run.filter("rel = 1").select("case_id", F.lit("T"), "candidate_id", "rel").write.option("sep", "\t").csv(path)
    return tables.judge(run.drop("rel"), tables.read_qrels(spark, path))


def task_xml(spark, sf_dir) -> str:
    """The text pairs as task XML. A case has at most one block of candidates."""
    file_name = lambda column: F.concat(F.format_string("%06d", column), F.lit(".txt"))
    pairs = views.text_pairs(spark, sf_dir)
    candidate = F.struct(
        F.col("candidate_id").cast("string").alias("_id"), file_name(F.col("candidate_id")).alias("_VALUE")
    )
    noticed = F.collect_list(F.when(F.col("rel") == 1, F.col("candidate_id").cast("string")))
    cases = pairs.groupBy("case_id").agg(
        F.collect_list(candidate).alias("candidate_case"), F.array_join(noticed, ",").alias("cases_noticed")
    )
    path = new_path(spark, "task")
    cases.select(
        F.col("case_id").cast("string").alias("_id"),
        F.concat(F.lit("queries/"), file_name(F.col("case_id"))).alias("query"),
        F.when(F.col("cases_noticed") != "", F.col("cases_noticed")).alias("cases_noticed"),
        F.struct("candidate_case").alias("candidate_cases"),
    ).write.format("xml").option("rootTag", "cases").option("rowTag", "instance").save(path)
    return path


@query(
    "read_task_xml",
    f"""WITH {PAIR_TABLE} SELECT CAST(case_id AS VARCHAR) AS case_id, md5(case_text) AS case_text,
    CAST(candidate_id AS VARCHAR) AS candidate_id, md5(candidate_text) AS candidate_text, candidate_is_noticed
    FROM pair_table""",
)
def read_task_xml(spark, sf_dir):
    """Task XML against a table of texts by path, as ``read_text_files`` returns it."""
    docs = views.documents(spark, sf_dir)
    pairs = views.text_pairs(spark, sf_dir)
    name = F.concat(F.format_string("%06d", "doc_id"), F.lit(".txt"))
    case_texts = pairs.select(F.col("case_id").alias("doc_id")).distinct().join(docs, "doc_id").select(
        F.concat(F.lit("queries/"), name).alias("path"), "text"
    )
    candidate_texts = pairs.select("case_id", F.col("candidate_id").alias("doc_id")).join(docs, "doc_id").select(
        F.concat(F.col("case_id").cast("string"), F.lit("/candidates/"), name).alias("path"), "text"
    )
    instances = xml.read_instances(spark, task_xml(spark, sf_dir))
    return _digests(xml.task_pairs(instances, case_texts.unionByName(candidate_texts)))


@query(
    "task_stats",
    f"""WITH {TEXT_PAIRS} SELECT CAST(case_id AS VARCHAR) AS id, CAST(sum(rel) AS INTEGER) AS num_rel,
    CAST(count(*) AS INTEGER) AS num_can FROM text_pairs GROUP BY case_id""",
)
def task_stats(spark, sf_dir):
    return xml.task_stats(xml.read_instances(spark, task_xml(spark, sf_dir)))


@query(
    "read_entailment_xml",
    """SELECT a.conv_id || '-' || a.turn AS query_id, replace(a.text, chr(10), ' ') AS law_text,
      replace(b.text, chr(10), ' ') AS statement, CASE WHEN length(b.text) > length(a.text) THEN 1 ELSE 0 END AS label
    FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND a.role = 'user'""",
)
def read_entailment_xml(spark, sf_dir):
    """Each user turn and its reply as a pair element, written and read back."""
    turns = views.table(spark, sf_dir, "conversations")
    replies = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("t2"))
    pairs = turns.filter("role = 'user'").join(replies, ["conv_id", "turn"])
    path = new_path(spark, "entailment")
    pairs.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("_id"),
        F.when(F.length("t2") > F.length("text"), "Y").otherwise("N").alias("_label"),
        F.col("text").alias("t1"),
        "t2",
    ).write.format("xml").option("rootTag", "pairs").option("rowTag", "pair").save(path)
    return xml.read_entailment_xml(spark, path)


LIBSVM = f"""{EMB_PAIRS},
svm AS (SELECT case_id, candidate_id, rel, list_transform(range(1, 129),
          lambda i: printf('%d:%.6f', i, (case_vec || cand_vec)[i])) AS parts FROM emb_joined)"""


def features(spark, sf_dir):
    return represent.pair_features(views.emb_pairs(spark, sf_dir), views.vectors(spark, sf_dir))


@query(
    "libsvm_lines",
    f"""WITH {LIBSVM} SELECT case_id, candidate_id,
    rel || ' qid:' || case_id || ' ' || array_to_string(parts, ' ') || ' cid:' || candidate_id AS value FROM svm""",
)
def libsvm_lines(spark, sf_dir):
    return lines.libsvm_lines(features(spark, sf_dir), decimals=6)


@query(
    "read_libsvm_ltr",
    f"""WITH {LIBSVM} SELECT case_id AS qid, candidate_id, CAST(rel AS DOUBLE) AS label, CAST(i AS INTEGER) AS feature,
    CAST(split_part(parts[i], ':', 2) AS DOUBLE) + 0e0 AS value
    FROM (SELECT *, unnest(range(1, 129)) AS i FROM svm)""",
    ("value",),
)
def read_libsvm_ltr(spark, sf_dir):
    path = new_path(spark, "libsvm")
    lines.write_libsvm_ltr(features(spark, sf_dir), path, decimals=6)
    parsed = lines.read_libsvm_ltr(spark, path)
    return parsed.select("qid", "candidate_id", "label", F.explode("features").alias("feature", "value"))


@query(
    "submission_lines",
    f"""WITH {ORDER_RUN} SELECT case_id, candidate_id, score, printf('%03d %03d %s', case_id, candidate_id, 'RUN') AS line
    FROM run WHERE score > 0.946""",
)
def submission_lines(spark, sf_dir):
    return lines.submission_lines(views.run(spark, sf_dir), "RUN", score_cut=0.946)


@query(
    "write_submission",
    f"""WITH {ORDER_RUN} SELECT printf('%03d %03d %s', case_id, candidate_id, 'RUN') AS line
    FROM ranked WHERE rank <= 6""",
)
def write_submission(spark, sf_dir):
    path = new_path(spark, "submission")
    lines.write_submission(lines.submission_lines(views.run(spark, sf_dir), "RUN", rank_cut=6), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(
    "write_sentences",
    f"""WITH {SENTENCES}, {LANGUAGE} SELECT sentence AS line, count(*) AS n FROM kept GROUP BY 1
    UNION ALL SELECT '', count(*) FROM documents""",
)
def write_sentences(spark, sf_dir):
    """The sentence corpus as lines: every kept sentence, and one empty line per document."""
    kept = kept_sentences(spark, sf_dir)
    ended = F.transform("sentences", lambda s: F.concat(s, F.lit("\n")))
    path = new_path(spark, "sentences")
    lines.write_sentences(kept.select("doc_id", F.array_join(ended, "").alias("lines")), path)
    written = spark.read.option("lineSep", "\n").text(path)
    return written.groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))
