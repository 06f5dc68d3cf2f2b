"""Line formats: learning-to-rank libsvm, submissions and the sentence corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry.operators.ranking import top_ranked


def libsvm_lines(pairs: DataFrame, vector: str = "features", label: str = "rel", decimals: int | None = None) -> DataFrame:
    """``label qid:case 1:v 2:v ... cid:candidate`` per pair; values in full, or with so many ``decimals``."""
    number = (lambda v: v.cast("string")) if decimals is None else (lambda v: F.format_string(f"%.{decimals}f", v))
    numbered = F.transform(F.col(vector), lambda v, i: F.concat((i + 1).cast("string"), F.lit(":"), number(v)))
    line = F.concat_ws(
        " ",
        F.col(label).cast("string"),
        F.concat(F.lit("qid:"), F.col("case_id").cast("string")),
        F.array_join(numbered, " "),
        F.concat(F.lit("cid:"), F.col("candidate_id").cast("string")),
    )
    return pairs.select("case_id", "candidate_id", line.alias("value"))


def write_libsvm_ltr(
    pairs: DataFrame, path: str, vector: str = "features", label: str = "rel", decimals: int | None = None
) -> None:
    """Write the lines in ascending order of case and candidate."""
    lines = libsvm_lines(pairs, vector, label, decimals).repartitionByRange("case_id", "candidate_id")
    lines.sortWithinPartitions("case_id", "candidate_id").select("value").write.text(path)


def parse_libsvm_ltr(lines: DataFrame, column: str = "value") -> DataFrame:
    """(qid, candidate_id, label, features) from LTR lines; features map an index to a value.

    ``cid`` is a column of its own, not a feature.
    """
    tokens = F.split(F.trim(F.col(column)), r"\s+")
    feature_tokens = F.filter(F.slice(tokens, 3, F.size(tokens)), lambda t: t.rlike(r"^\d+:"))
    entries = F.transform(
        feature_tokens,
        lambda t: F.struct(
            F.substring_index(t, ":", 1).cast("int").alias("key"),
            F.substring_index(t, ":", -1).cast("double").alias("value"),
        ),
    )
    cid = F.regexp_extract(F.col(column), r"\scid:(\d+)", 1)
    return lines.select(
        F.substring_index(tokens[1], ":", -1).cast("bigint").alias("qid"),
        F.when(cid != "", cid.cast("bigint")).alias("candidate_id"),
        tokens[0].cast("double").alias("label"),
        F.map_from_entries(entries).alias("features"),
    )


def read_libsvm_ltr(spark: SparkSession, path: str) -> DataFrame:
    return parse_libsvm_ltr(spark.read.text(path))


def dense_features(features: Column, size: int) -> Column:
    """A feature map as an array of ``size`` values, absent features 0."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(size)), lambda i: F.coalesce(F.element_at(features, i), F.lit(0.0))
    )


def submission_lines(
    run: DataFrame, name: str, score_cut: float | None = None, rank_cut: int | None = None
) -> DataFrame:
    """``case candidate run`` lines, ids padded to three digits, of the pairs above a score cut or
    within a rank cut."""
    if (score_cut is None) == (rank_cut is None):
        raise ValueError("give either score_cut or rank_cut")
    if score_cut is not None:
        kept = run.filter(F.col("score") > F.lit(float(score_cut)))
    else:
        kept = top_ranked(run, rank_cut)
    line = F.format_string("%03d %03d %s", "case_id", "candidate_id", F.lit(name))
    return kept.select("case_id", "candidate_id", "score", line.alias("line"))


def write_submission(lines: DataFrame, path: str) -> None:
    """Write submission lines by case, best score first; large cases span several files."""
    order = [F.col("case_id"), F.col("score").desc(), F.col("candidate_id")]
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("line").write.text(path)


def write_sentences(corpus: DataFrame, path: str) -> None:
    """Write a sentence corpus (column ``lines``): one sentence per line, an empty line per document."""
    corpus.select("lines").write.text(path)
