"""Task XML: retrieval instances with their candidate lists, and entailment pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

INSTANCE = (
    "_id STRING, query STRING, cases_noticed STRING, "
    "candidate_cases STRUCT<candidate_case: ARRAY<STRUCT<_VALUE: STRING, _id: STRING>>>"
)
ENTAILMENT = "_id STRING, _label STRING, t1 STRING, t2 STRING"


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``instance`` element: id, query file, noticed ids and candidate files."""
    raw = spark.read.format("xml").option("rowTag", "instance").schema(INSTANCE).load(path)
    noticed = F.when(F.col("cases_noticed").isNull(), F.array().cast("array<string>")).otherwise(
        F.split("cases_noticed", ",")
    )
    return raw.select(
        F.col("_id").alias("case_id"),
        F.col("query").alias("case_file"),
        noticed.alias("noticed"),
        F.col("candidate_cases.candidate_case").alias("candidates"),
    )


def task_pairs(instances: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per candidate, with both texts looked up by relative path.

    ``texts`` holds (path, text); a query lies at its own path, a candidate under
    ``<case_id>/candidates/``; a missing text is an error. A candidate is noticed when its id is in the
    instance's list.
    """
    pairs = instances.select(
        "case_id", "case_file", "noticed", F.explode("candidates").alias("candidate")
    ).select(
        "case_id",
        "case_file",
        F.col("candidate._id").alias("candidate_id"),
        F.concat_ws("/", "case_id", F.lit("candidates"), F.col("candidate._VALUE")).alias("candidate_file"),
        F.array_contains("noticed", F.col("candidate._id")).alias("candidate_is_noticed"),
    )
    case_texts = texts.select(F.col("path").alias("case_file"), F.col("text").alias("case_text"))
    candidate_texts = texts.select(F.col("path").alias("candidate_file"), F.col("text").alias("candidate_text"))

    def found(text: str, file: str) -> Column:
        message = F.concat(F.lit("no text file "), F.col(file))
        return F.coalesce(F.col(text), F.raise_error(message).cast("string")).alias(text)

    return (
        pairs.join(candidate_texts, "candidate_file", "left")
        .join(case_texts, "case_file", "left")
        .select(
            "case_id",
            found("case_text", "case_file"),
            "candidate_id",
            found("candidate_text", "candidate_file"),
            "candidate_is_noticed",
        )
    )


def read_text_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root`` as (path relative to ``root``, whole text); ``root`` is any Hadoop path or URI."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base)
    folder = base.toUri().getPath().rstrip("/")
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    # the reader's paths are percent-encoded URIs; a plus sign in them is a plus sign
    local = F.regexp_replace("_metadata.file_path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    path = F.url_decode(F.replace(local, F.lit("+"), F.lit("%2B")))
    return files.select(F.substr(path, F.lit(len(folder) + 2)).alias("path"), F.col("value").alias("text"))


def read_task_xml(spark: SparkSession, path: str, root: str) -> DataFrame:
    """The pair table of a task file whose text files lie below ``root``."""
    return task_pairs(read_instances(spark, path), read_text_files(spark, root))


def task_stats(instances: DataFrame) -> DataFrame:
    """Number of noticed and of candidate cases per instance."""
    return instances.select(
        F.col("case_id").alias("id"),
        F.size("noticed").alias("num_rel"),
        F.coalesce(F.size("candidates"), F.lit(0)).alias("num_can"),
    )


def read_entailment_xml(spark: SparkSession, path: str) -> DataFrame:
    """``pair`` elements as (query_id, law_text, statement, label 1/0), newlines turned into blanks."""
    raw = (
        spark.read.format("xml")
        .option("rowTag", "pair")
        .option("ignoreSurroundingSpaces", False)
        .schema(ENTAILMENT)
        .load(path)
    )
    return raw.select(
        F.col("_id").alias("query_id"),
        F.translate("t1", "\n", " ").alias("law_text"),
        F.translate("t2", "\n", " ").alias("statement"),
        F.when(F.col("_label") == "Y", 1).when(F.col("_label") == "N", 0).alias("label"),
    )
