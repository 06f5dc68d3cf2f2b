"""Exact nearest neighbours by pivots, shells and the triangle inequality.

Equal vectors are one point with a list of their first keys. Every point is assigned to the nearest of a bounded number
of pivots; in order of (pivot, distance to it) the points are cut into blocks of even size, so a crowded pivot is several
shells. A point's k-th distance within its own block bounds its k-th distance at all. A block elsewhere is looked at only
if it may hold a point that near: its shells' distances from the point, by the triangle inequality, and the distance to
the plane between two pivots say so. Points and blocks that have to meet are paired block by block, so that a task holds
two blocks, whatever the data. Nothing is dropped: where bounds exclude little (many dimensions), more blocks meet, up
to all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from docketry.operators.ranking import row_numbers
from docketry.session import materialise

BLOCK_ROWS = 1024
#: Pivots, and groups of consecutive blocks with bounds of their own, at most: what is broadcast has a fixed size.
MOST_PIVOTS, MOST_ZONES = 512, 4096
#: Numbers of a matrix of points by pivots or shells that a task holds at once.
CELLS = 1 << 20
#: Distances are compared to so many decimals.
DECIMALS = 6
SLACK = 2.0 * 10**-DECIMALS


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def slices(batches: Iterator[pa.RecordBatch], across: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so few rows that a number for each row and each of ``across`` others makes at most ``CELLS``."""
    rows = max(1, CELLS // max(across, 1))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances between two sets of rows; equal rows may come out a little above 0."""
    squares = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(squares, 0.0))


def nearest(x: np.ndarray, y: np.ndarray, x_numbers: np.ndarray, y_numbers: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of each row's ``k`` nearest columns of another number, ties to the smaller number.

    The fast distances choose what may be among the nearest, differences of coordinates decide.
    """
    near = distances(x, y)
    near[x_numbers[:, None] == y_numbers[None, :]] = np.inf
    # the rounding of the fast form, for squares that cancel
    doubt = SLACK + 1e-6 * (np.sqrt((x * x).sum(1)).max(initial=0.0) + np.sqrt((y * y).sum(1)).max(initial=0.0))
    kth = np.partition(near, k - 1, axis=1)[:, k - 1] if near.shape[1] >= k else np.full(len(x), np.inf)
    rows, columns = np.nonzero((near <= kth[:, None] + doubt) & np.isfinite(near))
    exact = np.round(np.sqrt(((x[rows] - y[columns]) ** 2).sum(1)), DECIMALS)
    order = np.lexsort((y_numbers[columns], exact, rows))
    rows, columns, exact = rows[order], columns[order], exact[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], columns[kept], exact[kept]


def distinct_points(points: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(number, copies, vector): every distinct vector with its first k + 1 keys, numbered by the first of them.

    The limit on keys applies before the shuffle, so a vector that many rows share is no hot group.
    """
    first = Window.partitionBy("vector").orderBy(*keys)
    few = points.withColumn("_copy", F.row_number().over(first)).filter(F.col("_copy") <= k + 1)
    copies = few.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct(*keys))).alias("copies"))
    return row_numbers(copies, [], [F.col("copies")[0]], "number")


def exact_groups(distinct: DataFrame, k: int, block_rows: int, most_pivots: int, most_zones: int, seed: int) -> DataFrame:
    """(number, near, distance): for every point its ``k`` nearest others, or all if there are fewer."""
    spark = distinct.sparkSession
    size = distinct.count()
    blocks = max(1, size // block_rows)
    pivots = min(most_pivots, 4 * blocks)
    drawn = distinct.orderBy(F.xxhash64(F.lit(seed), "number"), "number").limit(pivots).select("vector").toArrow()  # most_pivots rows
    centres = matrix(drawn["vector"])

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(centres)):
            x = matrix(batch.column("vector"))
            if len(x):
                far = distances(x, centres)
                cell = far.argmin(1)
                columns = [batch.column("number"), batch.column("vector"), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(x)), cell])]
                yield pa.RecordBatch.from_arrays(columns, ["number", "vector", "cell", "away"])

    vector = distinct.schema["vector"].dataType.simpleString()
    celled = distinct.select("number", "vector").mapInArrow(assigned, f"number long, vector {vector}, cell int, away double")
    placed = row_numbers(celled, [], [F.col("cell"), F.col("away"), F.col("number")], "_place")
    block = F.floor((F.col("_place") - 1) * blocks / F.lit(max(size, 1))).cast("int")
    placed = materialise(placed.withColumn("block", block).drop("_place"), "placed")
    per_zone = -(-blocks // most_zones)
    shells = placed.groupBy(F.floor(F.col("block") / per_zone).cast("int").alias("zone"), "cell").agg(
        F.min("away").alias("low"), F.max("away").alias("high")
    ).orderBy("zone", "cell").toArrow()  # at most a row per zone and one more per pivot
    zone, cell, low, high = (shells[c].to_numpy() for c in ("zone", "cell", "low", "high"))
    between = distances(centres, centres)
    found = "number long, near long, distance double"

    def within(rows: pa.Table) -> pa.Table:
        numbers, x = rows["number"].to_numpy(), matrix(rows["vector"])
        i, j, d = nearest(x, x, numbers, numbers, k)
        counts = np.bincount(i, minlength=len(x))
        reach = np.full(len(x), np.inf)
        last = np.flatnonzero(np.append(i[1:] != i[:-1], True)) if len(i) else np.zeros(0, int)
        full = counts[i[last]] == k if len(i) else np.zeros(0, bool)
        reach[i[last][full]] = d[last][full]
        lists = np.split(np.arange(len(i)), np.cumsum(counts)[:-1])
        near = pa.array([numbers[j[t]].tolist() for t in lists], pa.list_(pa.int64()))
        far = pa.array([d[t].tolist() for t in lists], pa.list_(pa.float64()))
        return pa.table([rows["number"], rows["vector"], rows["cell"], rows["block"], pa.array(reach), near, far], names=["number", "vector", "cell", "block", "reach", "near", "far"])

    own = materialise(
        placed.groupBy("block").applyInArrow(within, f"number long, vector {vector}, cell int, block int, reach double, near array<long>, far array<double>"),
        "own_blocks",
    )

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(cell)):
            x, mine, block, reach = matrix(batch.column("vector")), *(batch.column(c).to_numpy() for c in ("cell", "block", "reach"))
            if not len(x):
                continue
            far = distances(x, centres)
            to = far[:, cell]  # to the pivot of every shell
            bound = np.maximum(np.maximum(to - high, low - to), 0.0)
            apart = between[mine][:, cell]
            plane = (to**2 - far[np.arange(len(x)), mine][:, None] ** 2) / np.maximum(2 * apart, 1e-300)
            bound = np.maximum(bound, np.where(apart > 0, plane, 0.0))
            slack = SLACK + 1e-6 * (1 + to)
            point, shell = np.nonzero(bound <= reach[:, None] + slack)
            pairs = np.unique(np.stack([point, zone[shell]], 1), axis=0)
            targets = pairs[:, 1:] * per_zone + np.arange(per_zone)[None, :]
            point, target = np.repeat(pairs[:, 0], per_zone), targets.ravel()
            keep = (target != block[point]) & (target < blocks)
            point, target = point[keep], target[keep]
            columns = [batch.column("number").take(pa.array(point)), batch.column("vector").take(pa.array(point)), pa.array(block[point]), pa.array(target.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["number", "vector", "block", "target"])

    going = own.select("number", "vector", "cell", "block", "reach").mapInArrow(visits, f"number long, vector {vector}, block int, target int")
    going = materialise(going, "visits")
    hosts = going.select(F.col("block").alias("_from"), F.col("target").alias("_at")).distinct()
    waiting = placed.select("number", "vector", F.col("block").alias("_at")).join(hosts, "_at").select("number", "vector", "_from", "_at")

    def meeting(guests: pa.Table, there: pa.Table) -> pa.Table:
        a, b = guests["number"].to_numpy(), there["number"].to_numpy()
        if not len(a) or not len(b):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=["number", "near", "distance"])
        i, j, d = nearest(matrix(guests["vector"]), matrix(there["vector"]), a, b, k)
        return pa.table([pa.array(a[i]), pa.array(b[j]), pa.array(d)], names=["number", "near", "distance"])

    met = going.groupBy("block", "target").cogroup(waiting.groupBy("_from", "_at")).applyInArrow(meeting, found)
    local = own.select("number", F.explode(F.arrays_zip("near", "far")).alias("x")).select("number", "x.near", F.col("x.far").alias("distance"))
    best = Window.partitionBy("number").orderBy("distance", "near")
    every = local.unionByName(met).withColumn("_best", F.row_number().over(best))
    return every.filter(F.col("_best") <= k).drop("_best")


def nearest_neighbours(
    points: DataFrame,
    keys: list[str],
    k: int = 5,
    block_rows: int = BLOCK_ROWS,
    most_pivots: int = MOST_PIVOTS,
    most_zones: int = MOST_ZONES,
    seed: int = 0,
) -> DataFrame:
    """For every point its ``k`` nearest others: (keys, nn, nn_<key>s, distance, neighbour); ``nn`` counts from 1.

    Exact at every size; blocks have less than twice ``block_rows`` points. Equal distances (to six decimals) go to the
    smaller key. A point gets all others if there are fewer than ``k``. Keys identify a point; null vectors take no part,
    all others are equally long. An empty table gives an empty result.
    """
    vector = F.col("vector").cast("array<double>").alias("vector")
    points = materialise(points.filter("vector IS NOT NULL").select(*keys, vector), "points")
    distinct = materialise(distinct_points(points, keys, k), "distinct_points")
    if distinct.isEmpty():
        near = points.sparkSession.createDataFrame([], "number long, near long, distance double")
    else:
        near = exact_groups(distinct, k, block_rows, most_pivots, most_zones, seed)
    others = near.join(distinct.select(F.col("number").alias("near"), "copies", F.col("vector").alias("neighbour")), "near")
    own = distinct.select("number", F.lit(0.0).alias("distance"), "copies", F.col("vector").alias("neighbour"))
    listed = others.select("number", "distance", "copies", "neighbour").unionByName(own)
    # a row per point and neighbour, at most (k + 1) squared; one more than k, as the point itself may be among them
    listed = listed.select("number", "distance", F.explode("copies").alias("copy"), "neighbour")
    first = Window.partitionBy("number").orderBy("distance", "copy")
    listed = listed.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1)
    lists = listed.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("_n", "distance", "copy", "neighbour"))).alias("near"))
    lists = distinct.select("number", "vector").join(lists, "number").select("vector", "near")
    me = F.struct(*keys)
    rows = points.join(lists, "vector").select(*keys, F.posexplode(F.slice(F.filter("near", lambda x: x["copy"] != me), 1, k)).alias("nn", "x"))
    return rows.select(
        *keys, (F.col("nn") + 1).alias("nn"), *[F.col(f"x.copy.{c}").alias(f"nn_{c}") for c in keys], "x.distance", "x.neighbour"
    )
