"""Session helpers: the shared folder for written tables, and a local session for tests and the bench."""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of text that a task gets, about; what a task makes of its texts (rows by term, sorts) is several times as large.
PART_BYTES = 8 << 20
#: Rows of a table by term that a task sorts or groups, about.
PART_ROWS = 1 << 20
#: Where a local session without ``spark.checkpoint.dir`` keeps written tables. Never used on a cluster.
LOCAL_FOLDER = "/tmp/checkpoints"


def local_session(cores: int | str = 8, name: str = "docketry") -> SparkSession:
    """A ``local[cores]`` session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", LOCAL_FOLDER)
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``, which every executor can reach.

    Where the setting is missing, a local session uses ``LOCAL_FOLDER``; on a cluster that is an error,
    because a machine-local folder would not survive a lost executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = LOCAL_FOLDER
    return f"{configured.rstrip('/')}/docketry-{context.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, for a table or model written by a job."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and return the read of it.

    The write is a job of its own, run when this is called. Later stages read one fixed result, with
    column pruning, and a lost executor costs no more than the tasks it ran. ``release`` deletes it.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession, amount: int, most: int) -> int:
    """How many partitions to deal ``amount`` over, for about ``most`` in each: it follows the data, not a setting."""
    return max(spark.sparkContext.defaultParallelism, -(-amount // most))


def text_parts(docs: DataFrame, size: Column) -> int:
    """``parts`` for the sum of ``size``, a row's bytes of text."""
    return parts(docs.sparkSession, docs.agg(F.sum(size.cast("bigint"))).first()[0] or 0, PART_BYTES)


def dealt_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` dealt by ``key`` over as many partitions as it takes for each to have about ``PART_BYTES`` of text,
    so that a task's share does not grow with the input."""
    return docs.repartition(text_parts(docs, F.octet_length(text)), key)


def row_parts(rows: DataFrame) -> int:
    """``parts`` for the number of rows; meant for a written table, where the count is in its footers."""
    return parts(rows.sparkSession, rows.count(), PART_ROWS)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path on whatever store holds it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def folders(df: DataFrame) -> set[str]:
    """The tables under the shared folder that ``df`` reads."""
    mine = re.compile(rf".*/docketry-{re.escape(df.sparkSession.sparkContext.applicationId)}/[^/]+")
    return {found[0] for found in map(mine.match, df.inputFiles()) if found}


def forget(df: DataFrame, *needed: DataFrame) -> None:
    """Delete the written tables that ``df`` reads and none of ``needed`` does."""
    for path in folders(df).difference(*map(folders, needed)):
        delete(df.sparkSession, path)


def settled(df: DataFrame, *needed: DataFrame, name: str = "table") -> DataFrame:
    """``materialise``; then the tables that were written for ``df`` alone are deleted, and shuffle files freed.

    ``needed`` are what else reads tables that ``df`` reads.
    """
    written = materialise(df, name)
    forget(df, written, *needed)
    free_shuffles(df.sparkSession)
    return written


def free_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of steps that nothing refers to any more deleted now.

    Spark's cleaner deletes them once the driver has collected the steps' objects as garbage, which in a loop of large
    steps may be long after; this asks for a collection, as ``spark.cleaner.periodicGC.interval`` does by the clock.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete every table this application has written under the shared folder.

    Call it when no result that reads them is needed any more, e.g. before the session stops.
    """
    delete(spark, shared_folder(spark))
