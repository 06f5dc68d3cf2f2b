"""A corpus pipeline: quality filter, near-duplicate removal, source mixing, tokenization.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes every stage's result as Parquet under the shared folder and reads it again as the
next one's documents, so a lost executor costs at most the tasks of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry.llm import prefix_bpe, quality_neighbours, simhash, source_mixing
from docketry.session import new_path

#: Texts that score less are rejected.
QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled texts vote for; learnt from two thirds of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_neighbours.fit(docs, labels, quality_neighbours.is_held_out())
    scored = quality_neighbours.score(docs, model, "_quality")
    return scored.filter(F.col("_quality") >= QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least doc_id."""
    return simhash.one_of_each_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources at weights 1, 2, 3 takes them; copies are repeated rows."""
    return source_mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): ids as little-endian unsigned 32-bit numbers."""
    encoded = prefix_bpe.encode_decode(docs)
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("tokens", tokens)]

#: None of the stages can be said in SQL; the tests compare ``run`` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
