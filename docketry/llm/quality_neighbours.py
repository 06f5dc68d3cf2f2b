"""Quality by the votes of the nearest labelled texts in a latent-semantic space.

A text's terms are triples of character classes (letters by case, digits, blanks, line ends, each common kind of
punctuation), words hashed into a fixed number of slots, and words that repeat one of the three before them.
Term weights are square roots of relative frequencies times inverse document frequencies. A truncated singular
value decomposition of a bounded sample of labelled texts gives the space; the sample's vectors and labels are
broadcast, which their fixed number allows. Every text is projected, its cosine with every labelled vector is
worked out in blocks, and the labels of its nearest ones are averaged, weighted by a power of the cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docketry.llm.batches import LOWERED, PIECE_ROWS, span_hashes, text_bytes, word_spans
from docketry.llm.common import crc_remainder, documents

#: Labelled texts that the space is fitted on and that vote: at most so many, chosen by a hash of doc_id.
SAMPLE = 6000
DIMENSIONS, NEIGHBOURS, POWER = 48, 25, 8
WORD_SLOTS = 1024
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 20

CLASS_SIGNS = (".", ",", "!", "?", "|", "-", ":;", "'\"", "#$%&*@^~+=<>\\/_`", "()[]{}")
CLASSES = 6 + len(CLASS_SIGNS)
TRIPLES = CLASSES**3
REPEATS = 4
TERMS = TRIPLES + WORD_SLOTS + REPEATS
#: Share of the three kinds of terms in a vector's length.
SHARES = (1.0, 0.3, 1.0)


def byte_classes() -> np.ndarray:
    classes = np.zeros(256, np.int64)  # control characters
    classes[ord("a") : ord("z") + 1] = 1
    classes[0x80:] = 1
    classes[ord("A") : ord("Z") + 1] = 2
    classes[ord("0") : ord("9") + 1] = 3
    classes[[0x20, 0x09]] = 4
    classes[[0x0A, 0x0D]] = 5
    for i, signs in enumerate(CLASS_SIGNS):
        classes[list(signs.encode())] = 6 + i
    return classes


KINDS = byte_classes()


def term_weights(column: pa.Array) -> np.ndarray:
    """Square roots of relative term frequencies, a row per text; each kind of terms is a unit vector or zero."""
    data, at = text_bytes(column)
    rows = len(at) - 1
    text = np.repeat(np.arange(rows), np.diff(at))
    kinds = KINDS[data]
    same = text[2:] == text[:-2]
    triple = (kinds[:-2] * CLASSES + kinds[1:-1]) * CLASSES + kinds[2:]
    triples = np.bincount((text[2:] * TRIPLES + triple)[same], minlength=rows * TRIPLES).reshape(rows, TRIPLES)
    starts, ends, first = word_spans(data, at)
    hashes = span_hashes(LOWERED[data], starts, ends)
    owner = np.repeat(np.arange(rows), np.diff(first))
    slots = owner * WORD_SLOTS + (hashes % np.uint64(WORD_SLOTS)).astype(np.int64)
    words = np.bincount(slots, minlength=rows * WORD_SLOTS).reshape(rows, WORD_SLOTS)
    repeats = np.zeros((rows, REPEATS))
    for back in range(1, REPEATS):
        again = (hashes[back:] == hashes[:-back]) & (owner[back:] == owner[:-back])
        repeats[:, back - 1] = np.bincount(owner[back:][again], minlength=rows)
    repeats[:, -1] = np.maximum(np.diff(first) - repeats.sum(1), 0)
    parts = []
    for counts, share in zip((triples, words, repeats), SHARES, strict=True):
        total = counts.sum(1, keepdims=True)
        parts.append(np.sqrt(counts / np.maximum(total, 1)).astype(np.float32) * np.float32(share))
    return np.hstack(parts)


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    weights: np.ndarray  # by term: inverse document frequency
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # of the labelled texts, unit length
    labels: np.ndarray
    prior: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """Weighted votes of the nearest labelled texts; the prior for texts that resemble none."""
        if not len(self.labels):
            return np.full(len(column), self.prior)
        near = unit_rows((term_weights(column) * self.weights) @ self.axes) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        if k < near.shape[1]:
            best = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
        else:
            best = np.broadcast_to(np.arange(k), near.shape)
        votes = np.maximum(np.take_along_axis(near, best, axis=1), 0.0).astype(np.float64) ** POWER
        total = votes.sum(1)
        return np.where(total > 0, (votes * self.labels[best]).sum(1) / np.maximum(total, 1e-300), self.prior)


def axes_of(matrix: np.ndarray, dimensions: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    dimensions = min(dimensions, *matrix.shape)
    wide = min(dimensions + 16, *matrix.shape)
    basis = np.random.Generator(np.random.PCG64(5)).standard_normal((matrix.shape[1], wide)).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(matrix.T @ (matrix @ basis))
    _, _, turn = np.linalg.svd(matrix @ basis, full_matrices=False)
    return (basis @ turn.T)[:, :dimensions].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows of ``docs`` that are not ``held_out`` (a condition on doc_id; default: none are).

    ``labels`` has doc_id and quality (0 or 1). Rows with nulls in either are left out, a doc_id with several
    labels has their mean. At most ``sample`` labelled doc_ids are used; with none, every score is 0.5.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    if held_out is not None:
        known = known.filter(~held_out)
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("_quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = documents(docs).join(F.broadcast(chosen), "doc_id")  # ``sample`` rows at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                weights = term_weights(some.column("text"))
                rows, terms = np.nonzero(weights)
                counts = np.bincount(rows, minlength=len(weights))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                columns = [
                    some.column("doc_id"),
                    some.column("_quality"),
                    pa.ListArray.from_arrays(offsets, pa.array(terms.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(weights[rows, terms])),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "quality", "terms", "weights"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality double, terms array<int>, weights array<float>"
    # repeated doc_ids could exceed the sample, so the limit holds for the rows too
    rows = texts.mapInArrow(work, schema).orderBy(F.xxhash64("doc_id"), "doc_id", "terms").limit(sample).toArrow()
    matrix = np.zeros((rows.num_rows, TERMS), np.float32)
    lengths = rows["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    place = np.repeat(np.arange(rows.num_rows), lengths)
    matrix[place, rows["terms"].combine_chunks().flatten().to_numpy()] = rows["weights"].combine_chunks().flatten().to_numpy()
    quality = rows["quality"].to_numpy()
    if not len(quality):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1)), quality, 0.5)
    holders = np.count_nonzero(matrix, axis=0)
    weights = (1.0 + np.log((1 + len(matrix)) / (1 + holders))).astype(np.float32)
    matrix *= weights
    axes = axes_of(matrix, DIMENSIONS)
    return Model(weights, axes, unit_rows(matrix @ axes).astype(np.float32), quality, float(quality.mean()))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, from 0 to 1; higher means label 1 is likelier.

    Null and empty texts, and texts that resemble no labelled one, get the mean label. A score depends on the
    row's text alone, but for the rounding of products in single precision (about 3e-7), which depends on the rows beside
    it; of labelled texts equally near at the limit any may vote. Other columns stay as they are (but for one
    called ``name``, which is replaced). An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def votes(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            column = column.fill_null("")
            sizes = np.concatenate([[0], np.cumsum(np.diff(text_bytes(column)[1]))])
            found, start = [], 0
            while start < len(column):
                stop = int(np.searchsorted(sizes, sizes[start] + BLOCK_BYTES, "right")) - 1
                stop = min(max(stop, start + 1), start + BLOCK_ROWS, start + PIECE_ROWS)
                found.append(shared.value.scores(column.slice(start, stop - start)))
                start = stop
            yield pa.array(np.clip(np.concatenate(found), 0.0, 1.0) if found else np.zeros(0), pa.float64())

    return docs.withColumn(name, votes("text"))


def is_held_out() -> Column:
    return crc_remainder("doc_id", 3) == 1
