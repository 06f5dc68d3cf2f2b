"""What several operators of this subpackage share: tables, blocks of rows, global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docketry.session import materialise, new_path

#: White space and words as the contracts define them: ASCII white space separates, all else is a word.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Names of helper columns beside a table's own.
CONTENT, CHECK = "__docketry_content", "__docketry_check"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """``doc_id``, ``text`` (null as the empty text) and the named columns; whatever else there is goes."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *columns)


def content_keys(*columns: Column) -> list[Column]:
    """Two independent hashes, 96 bits in all, that stand for a row's values."""
    return [F.xxhash64(*columns).alias(CONTENT), F.hash(*columns).alias(CHECK)]


def crc_remainder(column: str | Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; a null counts as the empty text."""
    text = F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column, F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus))


def stored(df: DataFrame, name: str) -> DataFrame:
    """As ``materialise``, more closely packed, for tables about as large as the input."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, *order: str, name: str = "ranges") -> DataFrame:
    """``df`` written in range partitions by ``order``, with ``_range``, the number of its range.

    Ranges are in ascending order (nulls first) and equal keys share one. Rows of one range number are
    what one task holds; sums over ranges make positions in the whole table without one task for all.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    return materialise(ranges, name)


def running_start(ranges: DataFrame, amount: Column) -> DataFrame:
    """Per ``_range`` the sum of ``amount`` over all earlier ranges, as ``_start``.

    One row per range, so one small window holds them: their number is the number of shuffle partitions.
    """
    sums = ranges.groupBy("_range").agg(F.sum(amount).alias("_sum"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
