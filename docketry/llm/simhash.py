"""Near-duplicate groups: 64-bit SimHash, joined on a grid of per-segment bit counts.

A fingerprint is cut into 32 segments of two bits; the vector of their bit counts is its embedding. Flipping a
bit moves the vector by one step, so the Manhattan distance of two vectors never exceeds the Hamming distance
of the fingerprints. Of the two halves of the vector one is within half the limit; for a limit of 4 that is a
distance of 2, and two points of the grid within 2 have a common point within 1 of both. Each distinct
fingerprint is therefore put into the cells within one step of either half of its vector (about 50), an
equi-join on the cell brings all pairs within the bound together, and exact Hamming distances decide.

Equal fingerprints are one entry from the start. Cells with one entry are dropped before any comparison.
Within a cell a search from entry to entry finds the connected entries and reports a star for each, not pairs;
a cell of more than ``CELL_ROWS`` entries is dealt out in blocks, and every two blocks meet in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from docketry.llm.common import CHECK, CONTENT, content_keys
from docketry.llm.components import components
from docketry.session import materialise

SHINGLE_WORDS = 4
LIMIT = 4
SEED = 42
SEGMENT_BITS, HALVES = 2, 2
CELL_ROWS = 4096
BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str, shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of the space-joined word shingles of a text; 0 for a text without words."""
    words = text.encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_digest
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts, stops = (ends - lengths)[:n].tolist(), ends[-n:].tolist()
    digests = b"".join([hashed(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)])
    table = np.frombuffer(digests, np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(table[:, i], minlength=256) @ BITS_OF_BYTE for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, fp): the fingerprint of every row as a signed 64-bit number; null texts count as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = signed([fingerprint(t.as_py()) for t in batch.column("text")])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(values)], [*keys, "fp"])

    types = "".join(f"{k} {docs.schema[k].dataType.simpleString()}, " for k in keys)
    return docs.select(*keys, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, f"{types}fp long")


def cell_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of all cells within one step of either half of each fingerprint's vector.

    A bit count of a two-bit segment fits its two bits, so a half of the vector is a 32-bit number of counts.
    """
    bits = fps.view(np.uint64)
    low = np.uint64(0x5555555555555555)
    counts = (bits & low) + ((bits >> np.uint64(1)) & low)
    rows, keys = [], []
    everyone = np.arange(len(fps))
    for half in range(HALVES):
        cell = ((counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        tag = np.int64(half) << np.int64(32)
        rows.append(everyone)
        keys.append(cell | tag)
        for segment in range(16):
            value, step = (cell >> (2 * segment)) & 3, np.int64(1) << np.int64(2 * segment)
            for may, move in ((value < SEGMENT_BITS, step), (value > 0, -step)):
                rows.append(everyone[may])
                keys.append((cell[may] + move) | tag)
    return np.concatenate(rows), np.concatenate(keys)


def cells(distinct: DataFrame) -> DataFrame:
    """(cell, fp): about 50 rows for each distinct fingerprint."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for start in range(0, len(fps), 4096):
                some = fps[start : start + 4096]
                rows, keys = cell_keys(some)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(some[rows])], ["cell", "fp"])

    return distinct.select("fp").mapInArrow(work, "cell long, fp long")


def stars(fps: np.ndarray, limit: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each connected group of distinct fingerprints: its members but the first, and the first."""
    left, members, roots = np.unique(fps.view(np.uint64)), [], []
    while len(left) > 1:
        front, root, left = left[:1], left[0], left[1:]
        while len(front) and len(left):
            some, front = front[:512], front[512:]
            near = (np.bitwise_count(left[None, :] ^ some[:, None]) <= limit).any(0)
            found, left = left[near], left[~near]
            front = np.concatenate([front, found])
            members.append(found)
            roots.append(np.full(len(found), root))
    return members, roots


def cell_links(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, pair) -> star edges of every group. A group may reach over several batches."""

    def edges(cell, pair, fps):
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (pair[1:] != pair[:-1])])
        sizes = np.diff(np.r_[starts, len(fps)])
        members, roots = [], []
        two = starts[sizes == 2]  # most groups
        close = np.bitwise_count(fps[two].view(np.uint64) ^ fps[two + 1].view(np.uint64)) <= limit
        members.append(fps[two][close].view(np.uint64))
        roots.append(fps[two + 1][close].view(np.uint64))
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            group = fps[start : start + size]
            if size <= 12:
                x = group.view(np.uint64)
                i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= limit, 1))
                members.append(x[i])
                roots.append(x[j])
            else:
                for kept, more in zip((members, roots), stars(group, limit), strict=True):
                    kept.extend(more)
        u, v = (np.concatenate(x).view(np.int64) for x in (members, roots))
        pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        rows = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("cell", "pair", "fp"), strict=True)]
        if not len(rows[0]):
            continue
        changes = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
        cut = changes[-1] + 1 if len(changes) else 0
        if cut:
            yield edges(*(x[:cut] for x in rows))
        held = [x[cut:] for x in rows]
    if len(held[0]):
        yield edges(*held)


def links(distinct: DataFrame, limit: int = LIMIT, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(u, v): edges that connect exactly what chains of fingerprints within ``limit`` bits connect."""
    if limit > 2 * HALVES:
        raise ValueError("cells within one step of each half cover up to 4 differing bits")
    counted = cells(distinct).withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("cell")))
    link = lambda rows: rows.mapInArrow(lambda batches: cell_links(batches, limit), "u long, v long")
    # the count has brought a cell's rows together already
    usual = counted.filter(F.col("rows").between(2, cell_rows)).select("cell", F.lit(0).cast("long").alias("pair"), "fp")
    blocks = F.ceil(F.col("rows") / cell_rows)
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pair = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda other: F.least(mine, other) * F.col("blocks") + F.greatest(mine, other),
    )
    crowded = (
        counted.filter(F.col("rows") > cell_rows)
        .withColumn("blocks", blocks)
        .select("cell", F.explode(pair).alias("pair"), "fp")
        .repartition("cell", "pair")
    )
    order = ("cell", "pair")
    return link(usual.sortWithinPartitions(*order)).unionByName(link(crowded.sortWithinPartitions(*order))).distinct()


def roots(prints: DataFrame, first: Column, limit: int) -> DataFrame:
    """(fp, first, root): every distinct fingerprint with its least ``first`` and the root of its group."""
    distinct = materialise(prints.groupBy("fp").agg(F.min(first).alias("first")), "distinct")
    found = materialise(components(links(distinct, limit)), "roots")
    return distinct.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )


def groups(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    The component is the smallest doc_id that chains of near fingerprints reach. Null and empty texts have
    fingerprint zero and are linked like any other; null doc_ids count for no component and rows with one
    are returned; repeated rows are returned as often as they occur; an empty table gives an empty result.
    """
    prints = materialise(fingerprints(docs, "doc_id"), "prints")
    rooted = roots(prints, F.col("doc_id"), limit)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(named, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each_group(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group does: the one with the least doc_id.

    Rows with a null doc_id come last; among rows of one doc_id a hash of the text decides, and of rows equal
    in doc_id and text one stays. All columns are returned as they are.
    """
    keys = content_keys(F.col("doc_id"), F.coalesce("text", F.lit("")))
    keyed = docs.select("*", *keys)
    prints = materialise(fingerprints(keyed, "doc_id", CONTENT, CHECK), "prints")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", CONTENT, CHECK)
    kept = roots(prints, order, limit).groupBy("root").agg(F.min("first").alias("kept"))
    kept = kept.select(f"kept.{CONTENT}", f"kept.{CHECK}")
    rows = keyed.join(kept, [CONTENT, CHECK], "left_semi")
    return rows.dropDuplicates([CONTENT, CHECK]).select(*docs.columns)
