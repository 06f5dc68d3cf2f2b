"""Token files: ids in fixed-size blocks, shuffled into bit or byte planes, each compressed with zstandard.

A token file is a folder with two Parquet tables written by Spark, so that it works on any store and a lost
task's output is never seen. ``chunks`` has the payload: a chunk holds whole documents, its ids are cut into
blocks of ``BLOCK`` (the last filled up with zeros), every block is transposed, plane p of all blocks is
compressed as one frame, and planes of nothing but zeros have no frame. Shards are ranges of doc_id, chunks
are numbered within their shard. ``index`` has one row per chunk: where its ids start among all ids, how many
there are and the doc_ids from and to; a reader finds the chunk of a position or a document there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry.llm.batches import pieces
from docketry.llm.byte_tokens import byte_tokens
from docketry.llm.common import documents, running_start

BLOCK = 8192
#: A chunk is closed by the document that brings it to this many ids.
CHUNK_IDS = 1 << 17
LEVEL = 3
CHUNKS = "shard int, chunk int, first long, n_ids long, planes array<binary>, doc_ids array<long>, lengths array<long>"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Compressed planes of ids: 32 of bits or 4 of bytes, the least significant first; b"" for all zeros."""
    blocks = np.zeros(-(-len(ids) // BLOCK) * BLOCK, "<u4")
    blocks[: len(ids)] = ids
    raw = blocks.view(np.uint8).reshape(-1, BLOCK, 4)
    if bits:
        split = np.unpackbits(raw, axis=2, bitorder="little").transpose(2, 0, 1)
        planes = np.packbits(split, axis=2, bitorder="little")
    else:
        planes = raw.transpose(2, 0, 1)
    packer = zstandard.ZstdCompressor(level=LEVEL)
    return [packer.compress(np.ascontiguousarray(p).tobytes()) if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ``n`` ids of compressed planes; their number tells bits from bytes."""
    blocks = -(-n // BLOCK)
    bits = len(planes) == 32
    width = BLOCK // 8 if bits else BLOCK
    unpacker, out = zstandard.ZstdDecompressor(), np.zeros((len(planes), blocks, width), np.uint8)
    for i, plane in enumerate(planes):
        if plane:
            out[i] = np.frombuffer(unpacker.decompress(plane), np.uint8).reshape(blocks, width)
    if bits:
        raw = np.packbits(np.unpackbits(out, axis=2, bitorder="little").transpose(1, 2, 0), axis=2, bitorder="little")
    else:
        raw = out.transpose(1, 2, 0)
    return np.ascontiguousarray(raw).reshape(-1).view("<u4")[:n]


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0, bits: bool = False) -> None:
    """Encode every text and write the ids, each document's followed by ``end_id``, in ascending doc_id order.

    Null doc_ids come first; equal doc_ids are ordered by their texts. A null or empty text is one ``end_id``.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, shard, chunk, first = byte_tokens(path), TaskContext.get().partitionId(), 0, 0
        parts, names, lengths, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            columns = [
                pa.array([shard], pa.int32()),
                pa.array([chunk], pa.int32()),
                pa.array([first], pa.int64()),
                pa.array([held], pa.int64()),
                pa.array([to_planes(np.concatenate(parts), bits)], pa.list_(pa.binary())),
                pa.array([names], pa.list_(pa.int64())),
                pa.array([lengths], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, ["shard", "chunk", "first", "n_ids", "planes", "doc_ids", "lengths"])

        end = np.array([end_id], np.uint32)
        for piece in pieces(batches):
            for name, ids in zip(piece.column("doc_id").to_pylist(), tokens.encode(piece.column("text")), strict=True):
                parts += [ids, end]
                names.append(name)
                lengths.append(len(ids) + 1)
                held += len(ids) + 1
                if held >= CHUNK_IDS:
                    yield close()
                    chunk, first = chunk + 1, first + held
                    parts, names, lengths, held = [], [], [], 0
        if names:
            yield close()

    ordered = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    chunks = ordered.mapInArrow(work, CHUNKS)
    chunks.write.option("compression", "none").parquet(f"{folder}/chunks")
    written = docs.sparkSession.read.schema(CHUNKS).parquet(f"{folder}/chunks")
    starts = running_start(written.select(F.col("shard").alias("_range"), "n_ids"), F.col("n_ids"))
    (
        written.join(F.broadcast(starts), F.col("shard") == F.col("_range"))  # one row per shard
        .select(
            "shard",
            "chunk",
            (F.col("_start") + F.col("first")).alias("start"),
            "n_ids",
            F.size("doc_ids").alias("n_docs"),
            F.array_min("doc_ids").alias("first_doc"),
            F.array_max("doc_ids").alias("last_doc"),
        )
        .write.parquet(f"{folder}/index")
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the documents of a token file; ids are little-endian 32-bit numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, row=row: batch.column(name)[row].as_py()
                lengths = get("lengths")
                raw = from_planes(get("planes"), get("n_ids")).tobytes()
                ends = np.cumsum(lengths)
                begins = (ends - lengths).tolist()
                ids = [raw[4 * a : 4 * b] for a, b in zip(begins, ends.tolist(), strict=True)]
                columns = [
                    batch.column("doc_ids")[row].values,
                    pa.array([get("start") + b for b in begins], pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(ids, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    starts = spark.read.parquet(f"{folder}/index").groupBy("shard").agg(F.min("start").alias("_start"))
    chunks = spark.read.schema(CHUNKS).parquet(f"{folder}/chunks")
    placed = chunks.join(F.broadcast(starts), "shard").select(  # one row per shard
        (F.col("_start") + F.col("first")).alias("start"), "n_ids", "planes", "doc_ids", "lengths"
    )
    return placed.mapInArrow(work, "doc_id long, start long, n_tokens long, ids binary")
