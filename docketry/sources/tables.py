"""CSV and TSV tables: pairs, scores, hold-out ids, judgments, raw text; Parquet representations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PAIRS = (
    "case_id BIGINT, case_text STRING, candidate_id BIGINT, candidate_text STRING, "
    "candidate_is_noticed BOOLEAN"
)
SCORES = "case_id BIGINT, candidate_id BIGINT, score DOUBLE"
CASE_IDS = "case_id BIGINT"
QRELS = "case_id BIGINT, iter STRING, candidate_id BIGINT, rel INT"


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The five named columns of a pair CSV; further columns and column order do not matter."""
    names = [part.split()[0] for part in PAIRS.split(", ")]
    raw = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    types = dict(part.split() for part in PAIRS.split(", "))
    typed = raw.select(*[F.col(n).cast(types[n]).alias(n) for n in names])
    return typed.na.fill("", ["case_text", "candidate_text"])  # the reader turns empty texts into NULL


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Ids and scores of a file with a header; numbers only, so a large file is read in splits."""
    return spark.read.schema(SCORES).option("header", True).option("enforceSchema", False).csv(path)


def read_case_ids(spark: SparkSession, path: str) -> DataFrame:
    """A headerless list of case ids."""
    return spark.read.schema(CASE_IDS).csv(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A headerless CSV with one text column."""
    # texts hold quotes and newlines; quotes are doubled as in RFC 4180
    raw = spark.read.schema("text STRING").option("multiLine", True).option("quote", '"').option("escape", '"')
    return raw.csv(path).na.fill("")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated judgments: case, iteration, candidate, relevance."""
    return spark.read.schema(QRELS).option("sep", "\t").csv(path)


def judge(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Add ``rel`` to a run; a pair without a judgment is not relevant."""
    marks = qrels.select("case_id", "candidate_id", "rel")
    joined = run.join(marks, ["case_id", "candidate_id"], "left")
    return joined.withColumn("rel", F.coalesce("rel", F.lit(0)))


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, header: bool = True) -> None:
    """Write the named columns (all by default) as CSV files."""
    (
        df.select(*(columns or df.columns))
        .write.option("header", header)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def write_scores(run: DataFrame, path: str) -> None:
    write_table(run, path, ["case_id", "candidate_id", "score"])


def save_representation(df: DataFrame, path: str) -> None:
    """One Parquet table per prepared representation."""
    df.write.parquet(path)


def load_representation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
