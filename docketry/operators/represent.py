"""Representations of a corpus: raw text, bag of words, TF-IDF, latent and dense vectors.

Sparse representations are long tables (doc_id, term, value); dense ones are (doc_id, vector).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from docketry.functions.text import term_tokens
from docketry.functions.vectors import as_doubles
from docketry.operators.blocks import Block, doubles, numbered, packed_rows, repeated, whole_blocks, with_terms
from docketry.operators.ranking import row_numbers
from docketry.operators.score import SLICE_ROWS, SLICES, in_slices
from docketry.session import delete, folders, forget, free_shuffles, materialise, new_path, row_parts

#: Entries of a block of ``lsa``'s matrix, about; of a row of the table that holds it; and those worked on at once.
BLOCK_ENTRIES, PART_ENTRIES, GATHERED = 1 << 22, 1 << 17, 1 << 16


def build_corpus(pairs: DataFrame) -> DataFrame:
    """(doc_id, role, text): all candidates, and each query case once by its id."""
    candidates = pairs.select(
        F.col("candidate_id").alias("doc_id"), F.lit("candidate").alias("role"), F.col("candidate_text").alias("text")
    )
    cases = pairs.groupBy(F.col("case_id").alias("doc_id")).agg(
        F.lit("case").alias("role"), F.min("case_text").alias("text")
    )
    return candidates.unionByName(cases)


def raw(corpus: DataFrame) -> DataFrame:
    return corpus.select("doc_id", "text")


def term_counts(docs: DataFrame, tokens=term_tokens) -> DataFrame:
    """(doc_id, term, tf). Repeats inside a document are combined before the shuffle."""
    rows = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("term"))
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def vocabulary(
    counts: DataFrame, docs: DataFrame, min_df: int = 5, max_df: float = 0.8, max_features: int | None = None
) -> DataFrame:
    """(term, df, total): terms in at least ``min_df`` documents and at most the share ``max_df``; with
    ``max_features`` the most frequent ones, ties by name."""
    size = docs.select(F.count("*").alias("n")).scalar()
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    kept = terms.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_df)) * size))
    if max_features is not None:
        kept = kept.orderBy(F.col("total").desc(), F.col("term")).limit(max_features)
    return kept


def bow(counts: DataFrame, docs: DataFrame, min_df: int = 5, max_df: float = 0.8, max_features: int | None = None) -> DataFrame:
    """(doc_id, term, tf) over the pruned vocabulary. ``counts`` is read several times; give a written table.

    Rows stay where they are but for their blocks (``blocks``); terms alone are shuffled.
    """
    terms = vocabulary(counts, docs, min_df, max_df, max_features).select("term")

    def keep(block: Block, found: pa.Table) -> pa.Table:
        entry, _ = block.joined(found)
        columns = [block.documents.take(pa.array(block.rows[entry])), block.terms.take(pa.array(block.columns[entry]))]
        return pa.table([*columns, doubles(block.values[entry])], names=["doc_id", "term", "tf"])

    kept = with_terms(packed_rows(counts, "tf"), terms, row_parts(counts), keep, f"{doc_term(counts)}, tf DOUBLE")
    return kept.select("doc_id", "term", F.col("tf").cast(counts.schema["tf"].dataType))


def tfidf(counts: DataFrame, docs: DataFrame, min_df: int = 5, max_df: float = 0.8, max_features: int | None = None) -> DataFrame:
    """(doc_id, term, value): tf * (ln((1 + n) / (1 + df)) + 1), each document scaled to length 1.

    ``counts`` is read several times; give a written table. As in ``bow``, no row is shuffled by term.
    """
    size = docs.select(F.count("*").alias("n")).scalar()
    terms = vocabulary(counts, docs, min_df, max_df, max_features).select(
        "term", (F.log((size + 1) / (F.col("df") + 1)) + 1).alias("idf")
    )

    def weigh(block: Block, found: pa.Table) -> pa.Table:
        entry, place = block.joined(found)
        rows, w = block.rows[entry], block.values[entry] * found["idf"].to_numpy()[place]
        length = np.sqrt(np.bincount(rows, np.nan_to_num(w * w), len(block.documents)))
        columns = [block.documents.take(pa.array(rows)), block.terms.take(pa.array(block.columns[entry]))]
        return pa.table([*columns, doubles(w / length[rows])], names=["doc_id", "term", "value"])

    return with_terms(whole_blocks(counts, "tf"), terms, row_parts(counts), weigh, f"{doc_term(counts)}, value DOUBLE")


def doc_term(counts: DataFrame) -> str:
    return f"doc_id {counts.schema['doc_id'].dataType.simpleString()}, term STRING"


def term_maps(values: DataFrame, value: str = "value", name: str = "terms") -> DataFrame:
    """(doc_id, map of term to value); a map is no larger than the text it describes."""
    entries = F.collect_list(F.struct("term", value))
    return values.groupBy("doc_id").agg(F.map_from_entries(entries).alias(name))


def lsa(values: DataFrame, k: int = 20, iterations: int = 5, oversample: int = 10, value: str = "value"):
    """Latent vectors by a truncated SVD: (doc_id, vector of ``k`` components) and the singular values.

    Block power iteration: the matrix is packed once into blocks of whole documents (``packed_blocks``), each of about
    ``BLOCK_ENTRIES`` entries, and stays where it is. A round sends every block the rows of the iteration's block for
    the terms it has, and adds up what the blocks return for them, so that a round shuffles terms by blocks instead
    of entries; its files are deleted when the next one starts. Only the (k + oversample)-square Gram matrix reaches the driver to make the block orthonormal.
    The starting block is drawn from a hash of the term, so runs repeat. The sign of each component is chosen
    such that its vector sums to a positive number.
    """
    spark, width = values.sparkSession, k + oversample
    names = [f"c{i}" for i in range(width)]
    numbers = ", ".join(f"{c} DOUBLE" for c in names)
    doc_type = values.schema["doc_id"].dataType.simpleString()

    def gram(block: DataFrame) -> np.ndarray:
        def partial(batches):
            total = np.zeros((width, width))
            for batch in batches:
                rows = batch.to_numpy()
                total += rows.T @ rows
            yield pd.DataFrame({"cell": range(width * width), "v": total.ravel()})

        cells = block.select(*names).mapInPandas(partial, "cell INT, v DOUBLE").groupBy("cell").agg(F.sum("v"))
        out = np.zeros(width * width)
        for cell, v in cells.collect():  # width * width rows
            out[cell] = v
        return out.reshape(width, width)

    def turned(block: DataFrame, key: str, rotation: np.ndarray) -> DataFrame:
        def rotate(batches):
            for batch in batches:
                rows = pd.DataFrame(batch[names].to_numpy() @ rotation, columns=names)
                rows.insert(0, key, batch[key].to_numpy())
                yield rows

        return block.select(key, *names).mapInPandas(rotate, block.select(key, *names).schema)

    def orthonormal(block: DataFrame, key: str) -> DataFrame:
        sizes, axes = np.linalg.eigh(gram(block))
        scale = np.where(sizes > sizes.max() * 1e-12, 1 / np.sqrt(np.maximum(sizes, 1e-300)), 0.0)
        return turned(block, key, axes * scale)

    start = [
        (F.pmod(F.xxhash64(F.lit(i), "term"), F.lit(20011)) / F.lit(10005.0) - F.lit(1.0)).alias(c)
        for i, c in enumerate(names)
    ]
    table = packed_blocks(values, value)
    try:
        matrix = spark.table(table)
        listed = matrix.filter("terms IS NOT NULL").select("block", F.posexplode("terms").alias("number", "term"))
        listed = materialise(listed, "lsa_terms")

        def met(block: DataFrame, work: Callable, schema: str) -> DataFrame:
            """What ``work`` makes of every packed block and the rows of ``block`` for its terms."""
            rows = listed.join(block, "term").withColumnRenamed("block", "of_block")
            return matrix.groupBy("block").cogroup(rows.groupBy("of_block")).applyInArrow(work, schema)

        def there(packed: pa.Table, rows: pa.Table) -> tuple[PackedBlock, np.ndarray]:
            some = np.zeros((rows.num_rows, width))
            some[rows["number"].to_numpy()] = np.column_stack([rows[c].to_numpy() for c in names])
            one = PackedBlock.of(packed)
            return one, one.by_document(some)

        def back(packed: pa.Table, rows: pa.Table) -> pa.Table:
            one, product = there(packed, rows)
            product[~one.documents.is_valid().to_numpy(zero_copy_only=False)] = 0.0  # a null is no document that meets itself
            product = one.by_term(product)[rows["number"].to_numpy()]
            return pa.table([rows["term"], *[pa.array(c) for c in product.T.copy()]], names=["term", *names])

        def out(packed: pa.Table, rows: pa.Table) -> pa.Table:
            one, product = there(packed, rows)
            return pa.table([one.documents, *[pa.array(c) for c in product.T.copy()]], names=["doc_id", *names])

        terms, before = listed.select("term").distinct().select("term", *start), None
        for _ in range(iterations):
            path = new_path(spark, "lsa_round")
            parts = met(terms, back, f"term STRING, {numbers}")
            parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in names]).write.parquet(path)
            if before:
                delete(spark, before)
            before = path
            free_shuffles(spark)
            terms = orthonormal(spark.read.schema(f"term STRING, {numbers}").parquet(path), "term")
        documents = materialise(met(terms, out, f"doc_id {doc_type}, {numbers}"))
    finally:
        drop_blocks(spark, table)
    sizes, axes = np.linalg.eigh(gram(documents))
    best = np.argsort(sizes)[::-1]
    rotated = turned(documents, "doc_id", axes[:, best])
    sums = rotated.agg(*[F.sum(c) for c in names[:k]]).first()
    signs = [-1.0 if (s or 0.0) < 0 else 1.0 for s in sums]
    vector = F.array(*[F.col(c) * F.lit(sign) for c, sign in zip(names, signs)])
    singular = [float(np.sqrt(max(v, 0.0))) for v in sizes[best][:k]]
    return rotated.select("doc_id", vector.alias("vector")), singular


@dataclass
class PackedBlock:
    """The entries of some documents, in the order of documents; documents and terms have numbers of their own."""

    documents: pa.Array
    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    n_terms: int

    @staticmethod
    def of(packed: pa.Table) -> PackedBlock:
        entries = packed.filter(pc.is_valid(packed["part"])).sort_by("part")
        head = packed.filter(pc.is_valid(packed["terms"]))
        rows, columns, numbers = (
            np.frombuffer(b"".join(entries[c].to_pylist()), kind) for c, kind in (("rows", "<i4"), ("columns", "<i4"), ("numbers", "<f8"))
        )
        documents, terms = (head[c].combine_chunks().flatten() for c in ("documents", "terms"))
        return PackedBlock(documents, rows, columns, numbers, len(terms))

    def by_document(self, block: np.ndarray) -> np.ndarray:
        return gathered(self.rows, self.columns, self.values, block, len(self.documents))

    def by_term(self, block: np.ndarray) -> np.ndarray:
        order = np.argsort(self.columns, kind="stable")
        return gathered(self.columns[order], self.rows[order], self.values[order], block, self.n_terms)


def gathered(to: np.ndarray, of: np.ndarray, values: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """Sums of value * block[of] by ``to``, which ascends; some entries at once, to bound the memory."""
    out = np.zeros((n, block.shape[1]))
    for start in range(0, len(to), GATHERED):
        some = slice(start, start + GATHERED)
        first = np.flatnonzero(np.diff(to[some], prepend=-1))
        out[to[some][first]] += np.add.reduceat(values[some, None] * block[of[some]], first)
    return out


def packed_blocks(values: DataFrame, value: str = "value") -> str:
    """The name of a table bucketed by block that holds a sparse representation in blocks of whole documents.

    A block has a row with its ``documents`` and ``terms`` and, by ``part``, rows of its entries: numbers of documents
    (``rows``) and of terms (``columns``), and values (``numbers``). A null value counts as zero, a null term not at all.
    Rows are shuffled only if those of a document stand in several parts of the table they are written to first.
    """
    spark, name = values.sparkSession, f"lsa_{uuid.uuid4().hex}"
    path, unpacked = new_path(spark, "lsa_blocks"), new_path(spark, "lsa_entries")
    doc_type = values.schema["doc_id"].dataType.simpleString()
    kept = values.filter("term IS NOT NULL").select("doc_id", "term", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v"))
    free_shuffles(spark)  # of what the values were made from
    kept.write.option("compression", "zstd").parquet(unpacked)
    free_shuffles(spark)
    entries = spark.read.schema(kept.schema).parquet(unpacked)
    count = max(1, -(-entries.count() // BLOCK_ENTRIES))

    def pack(batches):
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held)
        held.clear()
        block = TaskContext.get().partitionId()
        (rows, documents), (columns, terms) = (numbered(table[c]) for c in ("doc_id", "term"))
        order = np.argsort(rows, kind="stable")
        rows, columns, numbers = rows[order], columns[order], table["_v"].to_numpy()[order]
        lists = [pa.array([x], pa.list_(x.type)) for x in (documents, terms)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.nulls(1, pa.int32()), *lists, *[pa.nulls(1, pa.binary())] * 3], fields
        )
        nothing = [pa.nulls(1, x.type) for x in lists]
        for part, start in enumerate(range(0, len(rows), PART_ENTRIES)):
            some = slice(start, start + PART_ENTRIES)
            cells = [pa.array([x[some].tobytes()], pa.binary()) for x in (rows, columns, numbers)]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), *nothing, *cells], fields)

    fields = ["block", "part", "documents", "terms", "rows", "columns", "numbers"]
    schema = f"block INT, part INT, documents ARRAY<{doc_type}>, terms ARRAY<STRING>, rows BINARY, columns BINARY, numbers BINARY"
    entries.coalesce(count).mapInArrow(pack, schema).write.option("path", path).bucketBy(count, "block").saveAsTable(name)
    if repeated(spark.table(name).filter("documents IS NOT NULL").select(F.explode("documents"))):  # rows of one stood apart
        drop_blocks(spark, name)
        packed = entries.repartition(count, "doc_id").mapInArrow(pack, schema)
        packed.write.option("path", path).bucketBy(count, "block").saveAsTable(name)
    delete(spark, unpacked)
    free_shuffles(spark)
    return name


def drop_blocks(spark, name: str) -> None:
    """Forget a table of ``packed_blocks`` and delete its files."""
    path = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'").first()["data_type"]
    spark.sql(f"DROP TABLE {name}")
    delete(spark, path)


def dense_vectors(corpus: DataFrame, vectors: DataFrame) -> DataFrame:
    """Look up precomputed vectors (doc_id, vector) for the documents of a corpus."""
    found = vectors.select("doc_id", as_doubles(F.col("vector")).alias("vector"))
    return corpus.select("doc_id").join(found, "doc_id")


def text_encoder(make_predict: Callable, batch_size: int = 64):
    """A column function text -> vector around a user's batch encoder."""
    return predict_batch_udf(make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)


def pair_encode(pairs: DataFrame, make_predict: Callable, batch_size: int = 64) -> DataFrame:
    """(case_id, candidate_id, features): both texts of a pair encoded together by a user's model.

    ``make_predict`` is called once per Python worker and returns ``f(texts_a, texts_b) -> matrix``.
    """
    encode = predict_batch_udf(make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    return pairs.select(
        "case_id", "candidate_id", encode(F.col("case_text"), F.col("candidate_text")).alias("features")
    )


def split_representation(pairs: DataFrame, vectors: DataFrame, value: str = "vector") -> tuple[DataFrame, DataFrame]:
    """Query rows (case_id, value) and candidate rows (case_id, candidate_id, value)."""
    cases = pairs.select("case_id").distinct().join(
        vectors.select(F.col("doc_id").alias("case_id"), value), "case_id"
    )
    candidates = pairs.select("case_id", "candidate_id").join(
        vectors.select(F.col("doc_id").alias("candidate_id"), value), "candidate_id"
    )
    return cases, candidates.select("case_id", "candidate_id", value)


def pair_features(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs with ``features``: the query vector followed by the candidate vector."""
    case_side = vectors.select(F.col("doc_id").alias("case_id"), F.col("vector").alias("_case"))
    candidate_side = vectors.select(F.col("doc_id").alias("candidate_id"), F.col("vector").alias("_cand"))
    joined = pairs.join(candidate_side, "candidate_id").join(case_side, "case_id")
    return joined.select(*pairs.columns, F.concat("_case", "_cand").alias("features"))


def sparse_pair_features(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(case_id, candidate_id, side, term, value): the query's terms next to the candidate's terms."""
    keys = pairs.select("case_id", "candidate_id")
    case_side = keys.join(values.withColumnRenamed("doc_id", "case_id"), "case_id").withColumn("side", F.lit("case"))
    candidate_side = keys.join(
        values.withColumnRenamed("doc_id", "candidate_id"), "candidate_id"
    ).withColumn("side", F.lit("candidate"))
    return case_side.unionByName(candidate_side).select("case_id", "candidate_id", "side", "term", "value")


def term_numbers(values: DataFrame) -> DataFrame:
    """(term, number): the distinct terms of a sparse representation, numbered from 0 in their order.

    Terms are numbered by ranges, so no task holds the whole dictionary.
    """
    terms = values.select("term").filter("term IS NOT NULL").distinct()
    return row_numbers(terms, [], [F.col("term")], "number").withColumn("number", F.col("number") - 1)


def sparse_pair_vectors(pairs: DataFrame, values: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """Pairs with ``features``: a sparse vector of the query's terms and, after them, of the candidate's terms.

    ``values`` is (doc_id, term, value). A term has the index ``number`` in the query's half and ``number`` plus
    the number of all terms in the candidate's; give the ``numbers`` of a training set to prepare others alike, terms
    without a number are left out then. A document's indices and values are put together once, not once per pair, in blocks
    (``blocks``); documents meet their pairs slice by slice; the hot side of either join is the pairs' keys. A pair whose document has no terms gets zeros in its half.
    """
    blocks, given = whole_blocks(values, "value"), numbers is not None
    if not given:
        numbers = materialise(term_numbers(blocks.select(F.explode("terms").alias("term"))), "term_numbers")
    size = (numbers.agg(F.max("number")).first()[0] or 0) + 1

    def listed(block: Block, found: pa.Table) -> pa.Table:
        entry, place = block.joined(found)
        rows, index, value = block.rows[entry], found["index"].to_numpy()[place], block.values[entry]
        order = np.lexsort((value, index, rows))
        sizes = np.bincount(rows, minlength=len(block.documents))
        at = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        lists = [pa.ListArray.from_arrays(at, x) for x in (pa.array(index[order].astype(np.int32)), doubles(value[order]))]
        return pa.table([block.documents, *lists], names=["doc_id", "i", "v"]).filter(pa.array(sizes > 0))

    schema = f"doc_id {values.schema['doc_id'].dataType.simpleString()}, i ARRAY<INT>, v ARRAY<DOUBLE>"
    terms = numbers.select("term", F.col("number").alias("index"))
    documents = materialise(with_terms(blocks, terms, row_parts(numbers) * 2, listed, schema), "sparse_documents")
    forget(blocks)
    free_shuffles(pairs.sparkSession)
    n = max(1, min(SLICES, (documents.agg(F.sum(F.size("i"))).first()[0] or 0) // SLICE_ROWS))
    cases = pairs.select(F.col("case_id").alias("doc_id")).distinct()
    heads = in_slices(lambda slice_of: slice_of(documents, "doc_id").join(cases, "doc_id", "left_semi"), n, "heads")
    case_side, candidate_side = (
        side.select(F.col("doc_id").alias(key), F.col("i").alias(f"_{key}_i"), F.col("v").alias(f"_{key}_v"))
        for side, key in ((heads, "case_id"), (documents, "candidate_id"))
    )
    none = {kind: F.array().cast(f"array<{kind}>") for kind in ("int", "double")}
    shifted = F.transform(F.coalesce("_candidate_id_i", none["int"]), lambda i: (i + size).cast("int"))
    vector = F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(2 * size).cast("int").alias("size"),
        F.concat(F.coalesce("_case_id_i", none["int"]), shifted).alias("indices"),
        F.concat(F.coalesce("_case_id_v", none["double"]), F.coalesce("_candidate_id_v", none["double"])).alias("values"),
    )  # the columns a sparse vector is stored as

    def joined(slice_of) -> DataFrame:
        both = slice_of(pairs, "candidate_id").join(slice_of(candidate_side, "candidate_id"), "candidate_id", "left")
        return both.join(case_side, "case_id", "left").select(*pairs.columns, vector.alias("features"))

    written = in_slices(joined, n, "sparse_pairs")
    for table in (documents, heads, *([] if given else [numbers])):
        forget(table)
    schema = T.StructType([*pairs.schema.fields, T.StructField("features", VectorUDT())])
    return pairs.sparkSession.read.schema(schema).parquet(*sorted(folders(written)))
