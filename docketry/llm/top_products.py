"""Exact top-k inner products by descending length, with rotated partial sums and Cauchy-Schwarz bounds.

Vectors become integers, floor(64 x) per component, so scores are exact. Candidates are put in order of
descending length and cut into blocks. The eigenvectors of the candidates' Gram matrix (the right singular
vectors) rotate both sides, which gathers as much length as possible in the first coordinates. A block is
skipped for a query whose length times the block's greatest length stays below the query's k-th best score so
far; within a block the sum over the first coordinates plus the product of the two residual lengths is an
upper bound, and only candidates whose bound reaches the k-th best score get their exact product.

Queries and candidates are dealt in blocks to the cells of a grid, each a bounded task; a cell returns k rows
per query, and the best k of all cells are kept. Nothing but the Gram matrix (dimension squared) and the head
block (a fixed number of the longest vectors, for the first bounds) is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from docketry.llm.common import in_order, running_start
from docketry.session import materialise

SCALE = 64
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 8192
#: Rows of a candidate block that are multiplied at once, queries multiplied at once, leading coordinates.
STEP, QUERY_STEP, LEADING = 1024, 1024, 16
#: The longest vectors, from which every query takes its first bound.
HEAD = 2048
#: Products of lengths up to this are exact in double arithmetic.
EXACT = 2.0**52


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, length2): usable vectors as integers.

    Null ids, null vectors and vectors with null or non-finite components take no part. Rows that share a
    vec_id, or all of their values, are rows of their own. Vectors of several dimensions are compared as if
    padded with zeros.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    rows = rows.select("vec_id", F.transform(x, lambda c: F.floor(c * SCALE)).alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return rows.withColumn("length2", squares)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as integers, padded with zeros to ``width``."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors of the sum of v v^T, by descending eigenvalue; width**2 sums reach the driver."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = matrix(batch.column("v"), width).astype(np.float64)
            total += m.T @ m
        i, j = np.divmod(np.arange(width * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "s"])

    sums = rows.select("v").mapInArrow(products, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    gram = np.zeros((width, width))
    for i, j, s in sums.collect():
        gram[i, j] = s
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    return vectors[:, np.argsort(-values, kind="stable")]


class Best:
    """The k best (score, id) of each of a block of queries; equal scores go to the smaller id."""

    def __init__(self, ids: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.k, self.floor = ids, k, floor.copy()
        self.rows = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # query, score, id

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, s, i = (np.concatenate(x) for x in zip(self.rows, (query, score, ids), strict=True))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        self.rows = tuple(x[place < self.k] for x in (q, s, i))


def search(best: Best, queries: np.ndarray, candidates: np.ndarray, ids: np.ndarray, turn: np.ndarray) -> None:
    """Update ``best`` with candidates in descending order of length."""
    lead = min(LEADING, queries.shape[1])

    def rotated(m):
        length = np.sqrt((m.astype(np.float64) ** 2).sum(1))
        first = m.astype(np.float64) @ turn[:, :lead]
        rest = np.sqrt(np.maximum(length**2 - (first**2).sum(1), 0.0))
        return length, first, rest + 1e-7 * (length + 1.0)  # what rounding may have taken

    q_length, q_first, q_rest = rotated(queries)
    c_length, c_first, c_rest = rotated(candidates)
    exact = q_length.max(initial=0) * c_length.max(initial=0) < EXACT
    q_full = queries.astype(np.float64) if exact else queries
    for start in range(0, len(candidates), STEP):
        block = slice(start, start + STEP)
        longest = c_length[block].max() * (1 + 1e-9)
        alive = np.flatnonzero(q_length * longest >= best.floor)
        for at in range(0, len(alive), QUERY_STEP):
            some = alive[at : at + QUERY_STEP]
            bound = q_first[some] @ c_first[block].T + np.outer(q_rest[some], c_rest[block])
            passed = bound >= best.floor[some][:, None] - 1e-6 * (1.0 + np.abs(best.floor[some][:, None]))
            rows, columns = np.flatnonzero(passed.any(1)), np.flatnonzero(passed.any(0))
            if not len(rows):
                continue
            full = candidates[block][columns].astype(q_full.dtype)
            products = q_full[some[rows]] @ full.T
            hit = passed[np.ix_(rows, columns)] & (products >= best.floor[some[rows]][:, None])
            hit &= best.ids[some[rows]][:, None] != ids[block][columns][None, :]
            r, c = np.nonzero(hit)
            best.add(some[rows[r]], products[r, c].astype(np.int64), ids[block][columns[c]])


def top_products(vectors: DataFrame, modulus: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest products of each query with every other vector.

    Queries are the rows whose vec_id is divisible by ``modulus``; equal scores go to the smaller vec_id; a
    query with fewer than ``k`` candidates gets all of them. Rows of a repeated query id are searched one by one,
    then ranked together; repeated candidates take as many ranks. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = materialise(integer_vectors(vectors).withColumn("_minus", -F.col("length2")), "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    turn = rotation(rows, width)
    ranges = in_order(rows, "_minus", "vec_id", name="by_length")
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_minus", "vec_id")) - 1 + F.col("_start")
    placed = ranges.join(F.broadcast(running_start(ranges, F.lit(1))), "_range").select("vec_id", "v", place.alias("place"))
    placed = materialise(placed, "placed")
    is_query = F.pmod("vec_id", F.lit(modulus)) == 0
    head = placed.filter(F.col("place") < HEAD).orderBy("place").select("vec_id", "v").toArrow()  # HEAD rows
    shared = spark.sparkContext.broadcast((turn, matrix(head["v"], width), head["vec_id"].to_numpy()))

    def first_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, head, head_ids = shared.value
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            best = Best(ids, np.full(len(ids), -np.inf), k)
            if len(ids):
                search(best, matrix(batch.column("v"), width), head, head_ids, turn)
            columns = [batch.column("vec_id"), batch.column("v"), batch.column("q_block"), pa.array(best.floor)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "q_block", "floor"])

    candidates = placed.withColumn("c_block", F.floor(F.col("place") / CANDIDATE_BLOCK))
    blocks = (placed.agg(F.max("place")).first()[0] or 0) // CANDIDATE_BLOCK + 1
    queries = placed.filter(is_query)
    n_query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    queries = queries.select("vec_id", "v", F.pmod(F.xxhash64("place"), F.lit(n_query_blocks)).alias("q_block"))
    bounded = queries.mapInArrow(first_bounds, "vec_id long, v array<long>, q_block long, floor double")
    left = bounded.withColumn("c_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = candidates.withColumn(
        "q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_query_blocks - 1).cast("long")))
    )

    def cell(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not queries.num_rows or not candidates.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        turn = shared.value[0]
        candidates = candidates.sort_by("place")
        ids = queries["vec_id"].to_numpy()
        best = Best(ids, queries["floor"].to_numpy(), k)
        search(best, matrix(queries["v"], width), matrix(candidates["v"], width), candidates["vec_id"].to_numpy(), turn)
        q, score, vec_id = best.rows
        return pa.table([pa.array(ids[q]), pa.array(vec_id), pa.array(score)], names=names)

    cells = (
        left.groupBy("q_block", "c_block")
        .cogroup(right.groupBy("q_block", "c_block"))
        .applyInArrow(cell, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return cells.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
