"""Rows (doc_id, term, value) taken together by blocks of documents, or by document, where they are.

What is known of a term (its idf, its stem, its number) has to meet all rows with the term. A join row by row shuffles every
row by term, and what follows shuffles it by document again. Here rows are packed into blocks of whole documents, in which
terms are numbers. A block asks once for each of its terms, and only terms of blocks are shuffled for that; the rows go to
their block's answers as a few compressed bytes each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from docketry.session import delete, forget, free_shuffles, new_path, row_parts

#: Rows of a block, about, and rows that are put together by document at once.
BLOCK_ROWS, HELD_ROWS = 1 << 19, 1 << 16


def numbered(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A number for every row and the distinct values they stand for, null included."""
    coded = column.combine_chunks().dictionary_encode("encode")
    return coded.indices.to_numpy().astype(np.int32), coded.dictionary


def runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches put together to tables of about ``most`` rows that end where a document ends."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < most or not batch.num_rows:
            continue
        codes = batch.column("doc_id").dictionary_encode("encode").indices.to_numpy()
        others = np.flatnonzero(codes != codes[-1])
        if len(others):
            cut = int(others[-1]) + 1
            held[-1] = batch.slice(0, cut)
            yield pa.Table.from_batches(held)
            held, size = [batch.slice(cut)], batch.num_rows - cut
    if size:
        yield pa.Table.from_batches(held)


@dataclass
class Block:
    """Rows of some documents, in the order of documents; documents and terms have numbers of their own."""

    documents: pa.Array
    rows: np.ndarray
    terms: pa.Array
    columns: np.ndarray
    values: np.ndarray

    FIELDS = ("block", "documents", "terms", "sizes", "columns", "numbers")

    @staticmethod
    def of_rows(table: pa.Table) -> Block:
        (rows, documents), (columns, terms) = (numbered(table[c]) for c in ("doc_id", "term"))
        order = np.argsort(rows, kind="stable")
        return Block(documents, rows[order], terms, columns[order], table["_v"].to_numpy()[order])

    def packed(self, block: int) -> pa.RecordBatch:
        sizes = np.bincount(self.rows, minlength=len(self.documents)).astype("<i4")
        press = zstandard.ZstdCompressor(level=1).compress
        lists = [pa.array([x], pa.list_(x.type)) for x in (self.documents, self.terms)]
        cells = [pa.array([press(x.tobytes())], pa.binary()) for x in (sizes, self.columns.astype("<i4"), self.values.astype("<f8"))]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *lists, *cells], list(Block.FIELDS))

    @staticmethod
    def of(packed: pa.Table) -> Block:
        unpack = zstandard.ZstdDecompressor().decompress
        sizes, columns, values = (
            np.frombuffer(unpack(packed[c][0].as_py()), kind) for c, kind in (("sizes", "<i4"), ("columns", "<i4"), ("numbers", "<f8"))
        )
        documents, terms = (packed[c].combine_chunks().flatten() for c in ("documents", "terms"))
        return Block(documents, np.repeat(np.arange(len(sizes)), sizes), terms, columns, values)

    def joined(self, found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(row of the block, row of ``found``) for all that have a term in common, in the order of the block."""
        numbers = found["number"].to_numpy()
        order, per = np.argsort(numbers, kind="stable"), np.bincount(numbers, minlength=len(self.terms))
        times, first = per[self.columns], (np.cumsum(per) - per)[self.columns]
        entry = np.repeat(np.arange(len(times)), times)
        place = np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)
        return entry, order[first[entry] + place]


def doubles(values: np.ndarray) -> pa.Array:
    """NaN stands for null in a block."""
    return pa.array(values, mask=np.isnan(values))


def packed_rows(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` in blocks (``Block.FIELDS``), written; a null term is left out. A document whose rows stand together is whole."""
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "blocks")
    doc_type = rows.schema["doc_id"].dataType.simpleString()
    kept = rows.filter("term IS NOT NULL").select("doc_id", "term", F.col(value).cast("double").alias("_v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, table in enumerate(runs(batches, BLOCK_ROWS)):
            yield Block.of_rows(table).packed(first + i)

    schema = f"block LONG, documents ARRAY<{doc_type}>, terms ARRAY<STRING>, sizes BINARY, columns BINARY, numbers BINARY"
    kept.mapInArrow(work, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def repeated(keys: DataFrame) -> bool:
    """Whether a value comes twice in a column."""
    return not keys.toDF("key").groupBy("key").count().filter("count > 1").isEmpty()


def whole_blocks(rows: DataFrame, value: str) -> DataFrame:
    """``packed_rows`` with every document in one block; rows are shuffled only if a document's were apart."""
    blocks = packed_rows(rows, value)
    if repeated(blocks.select(F.explode("documents"))):
        forget(blocks)
        together = rows.repartition(row_parts(rows), "doc_id").sortWithinPartitions("doc_id")
        blocks = packed_rows(together, value)
    free_shuffles(rows.sparkSession)
    return blocks


def with_terms(blocks: DataFrame, terms: DataFrame, parts: int, work: Callable[[Block, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``work`` makes of every block and the rows of ``terms`` for its terms, which come with the term's ``number`` there."""
    listed = blocks.select(F.col("block").alias("of_block"), F.posexplode("terms").alias("number", "term"))
    found = listed.repartition(parts, "term").join(terms.repartition(parts, "term"), "term")
    found = found.select("of_block", "number", *[c for c in terms.columns if c != "term"]).repartition(parts, "of_block")
    both = blocks.repartition(parts, "block").groupBy("block").cogroup(found.groupBy("of_block"))
    return both.applyInArrow(lambda packed, rows: work(Block.of(packed), rows), schema)


def document_rows(rows: DataFrame, value: str) -> DataFrame:
    """(doc_id, terms, values), written: a row per document with its terms and their values.

    Rows of a document that stand together are put together where they are; if those of one were apart, its parts are shuffled.
    """
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "documents")
    doc_type, value_type = (rows.schema[c].dataType.simpleString() for c in ("doc_id", value))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, HELD_ROWS):
            number, documents = numbered(table["doc_id"])
            order = pa.array(np.argsort(number, kind="stable"))
            at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(documents)))]), pa.int32())
            lists = [pa.ListArray.from_arrays(at, table[c].combine_chunks().take(order)) for c in ("term", "_v")]
            yield pa.RecordBatch.from_arrays([documents, *lists], ["doc_id", "terms", "values"])

    schema = f"doc_id {doc_type}, terms ARRAY<STRING>, values ARRAY<{value_type}>"
    made = rows.select("doc_id", "term", F.col(value).alias("_v")).mapInArrow(work, schema)
    made.write.option("compression", "zstd").parquet(path)
    free_shuffles(spark)
    documents = spark.read.schema(schema).parquet(path)
    if repeated(documents.select("doc_id")):
        parts = F.collect_list(F.struct("terms", "values"))
        merged = documents.groupBy("doc_id").agg(parts.alias("parts"))
        merged = merged.select("doc_id", *[F.flatten(f"parts.{c}").alias(c) for c in ("terms", "values")])
        again = new_path(spark, "documents")
        merged.write.option("compression", "zstd").parquet(again)
        delete(spark, path)
        free_shuffles(spark)
        documents = spark.read.schema(schema).parquet(again)
    return documents
