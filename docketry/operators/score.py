"""Rankers without training: cosine and BM25, and operations on finished runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docketry.functions.vectors import cosine, dot, map_dot, norm
from docketry.operators.blocks import document_rows
from docketry.operators.ranking import row_numbers
from docketry.session import forget, free_shuffles, materialise, row_parts, settled

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Slices of the candidates that are joined one after the other, at most, and rows of a sparse representation for each.
SLICES, SLICE_ROWS = 4, 1 << 22


def cosine_rank(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs with ``score``: the cosine of their dense vectors. Norms are taken once per document."""
    sized = vectors.select("doc_id", "vector", norm(F.col("vector")).alias("size"))
    case_side = sized.select(
        F.col("doc_id").alias("case_id"), F.col("vector").alias("_a"), F.col("size").alias("_na")
    )
    candidate_side = sized.select(
        F.col("doc_id").alias("candidate_id"), F.col("vector").alias("_b"), F.col("size").alias("_nb")
    )
    joined = pairs.join(candidate_side, "candidate_id").join(case_side, "case_id")
    score = cosine(dot(F.col("_a"), F.col("_b")), F.col("_na"), F.col("_nb"))
    return joined.select(*pairs.columns, score.alias("score"))


def sparse_cosine_rank(pairs: DataFrame, values: DataFrame, value: str = "value") -> DataFrame:
    """Pairs with ``score``: the cosine of their sparse vectors, 0 without a shared term.

    Each document becomes one row with its terms, written once (``blocks.document_rows``). The query's map joins the
    pairs first and the candidates' maps last, so a candidate's map crosses the network once however many
    cases list it. Candidates are joined slice by slice, which bounds the shuffle files; scores are written.
    There is no shuffle by term; the cost does not depend on how frequent a term is.
    """
    documents = document_rows(values, value)
    square = F.aggregate("values", F.lit(0.0), lambda acc, x: acc + F.coalesce(x.cast("double") * x, F.lit(0.0)))
    sized = documents.select("doc_id", F.map_from_arrays("terms", "values").alias("terms"), F.sqrt(square).alias("size"))
    n = slices(documents)
    heads = in_slices(lambda slice_of: slice_of(sized, "doc_id").join(
        pairs.select(F.col("case_id").alias("doc_id")).distinct(), "doc_id", "left_semi"
    ), n, "heads")  # the queries alone
    case_side, candidate_side = (
        side.select(F.col("doc_id").alias(key), F.col("terms").alias(f"_{n}"), F.col("size").alias(f"_size_{n}"))
        for side, key, n in ((heads, "case_id", "a"), (sized, "candidate_id", "b"))
    )
    shared = map_dot(F.col("_a"), F.col("_b")) / (F.col("_size_a") * F.col("_size_b"))

    def scored(slice_of) -> DataFrame:
        asked = slice_of(pairs, "candidate_id").join(case_side, "case_id", "left")
        joined = asked.join(slice_of(candidate_side, "candidate_id"), "candidate_id", "left")
        return joined.select(*pairs.columns, F.coalesce(shared, F.lit(0.0)).alias("score"))

    scores = in_slices(scored, n, "scores")
    forget(sized)
    forget(heads)
    return scores


def slices(documents: DataFrame) -> int:
    """How many slices for ``documents`` (of ``document_rows``)."""
    return max(1, min(SLICES, (documents.agg(F.sum(F.size("terms"))).first()[0] or 0) // SLICE_ROWS))


def in_slices(make, n: int, name: str) -> DataFrame:
    """What ``make(slice_of)`` returns for each of ``n`` slices, written one after the other; shuffle files go in between.

    ``slice_of(df, key)`` are the rows of a slice; equal keys are in one slice, and null keys too.
    """
    made = None
    for i in range(n):
        def slice_of(df: DataFrame, key: str, i: int = i) -> DataFrame:
            return df.filter(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)) == i) if n > 1 else df

        written = materialise(make(slice_of), name)
        if n > 1:
            free_shuffles(written.sparkSession)
        made = written if made is None else made.unionByName(written)
    return made


def bm25_rank(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Pairs with ``score``: BM25 of the candidate for the query's tokens (with repeats), where the
    candidates of the case are the corpus. A negative idf is replaced by a quarter of the mean idf.

    ``counts`` is ``term_counts(docs, bm25_tokens)``, a written table: every document is tokenised once, however many
    cases share it, and becomes one row. Per case only document frequencies are shuffled, combined beforehand, for a slice of the
    documents and then for a slice of the cases at once; one aggregate makes of them the mean idf and the query's term weights,
    a map no larger than its text, which are written. That joins the pairs first and the candidates' maps last.
    """
    dealt = row_parts(counts)
    documents = document_rows(counts, "tf")
    length = F.aggregate("values", F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(x.cast("bigint"), F.lit(0))).alias("length")
    texts = documents.select(F.col("doc_id").alias("candidate_id"), length, F.map_from_arrays("terms", "values").alias("terms"))
    lengths = documents.select(F.col("doc_id").alias("candidate_id"), length)
    keys = pairs.select("case_id", "candidate_id")
    shapes = keys.join(lengths, "candidate_id", "left").groupBy("case_id").agg(
        F.count("*").alias("n"), F.avg(F.coalesce("length", F.lit(0))).alias("average_length")
    )
    cases = keys.select(F.col("case_id").alias("doc_id")).distinct()
    heads = settled(documents.repartition(dealt, "doc_id").join(cases, "doc_id", "left_semi"), documents, keys, name="heads")
    n, shapes = slices(documents), settled(shapes, documents, keys, name="shapes")
    terms = documents.select(F.col("doc_id").alias("candidate_id"), "terms")

    def counted(slice_of) -> DataFrame:
        some = slice_of(terms, "candidate_id").repartition(dealt, "candidate_id")
        seen = slice_of(keys, "candidate_id").join(some, "candidate_id").select("case_id", F.explode("terms").alias("term"))
        return seen.groupBy("case_id", "term").agg(F.count("*").alias("df"))

    appearances = in_slices(counted, n, "appearances")
    asked = heads.select(F.col("doc_id").alias("case_id"), F.explode(F.arrays_zip("terms", "values")).alias("e"))
    asked = asked.select("case_id", F.col("e.terms").alias("term"), F.col("e.values").alias("tf"))
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    used = lambda e: F.when(e["idf"] >= 0, e["idf"]).otherwise(F.lit(EPSILON) * F.col("mean_idf"))
    weights = F.transform("asked", lambda e: F.struct(e["term"], (e["tf"] * used(e)).alias("weight")))

    def profiled(slice_of) -> DataFrame:
        found = slice_of(appearances, "case_id").groupBy("case_id", "term").agg(F.sum("df").alias("df"))
        rated = (
            found.join(slice_of(asked, "case_id"), ["case_id", "term"], "left")
            .join(slice_of(shapes, "case_id"), "case_id")
            .select("case_id", "average_length", "term", "tf", idf.alias("idf"))
        )
        profiles = rated.groupBy("case_id").agg(
            F.first("average_length").alias("average_length"),
            F.avg("idf").alias("mean_idf"),
            F.collect_list(F.when(F.col("tf").isNotNull(), F.struct("term", "tf", "idf"))).alias("asked"),
        )
        return profiles.select("case_id", "average_length", F.map_from_entries(weights).alias("profile"))

    queries = in_slices(profiled, n, "queries")
    for table in (appearances, heads, shapes):
        forget(table)
    free_shuffles(pairs.sparkSession)
    damp = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.try_divide(F.coalesce("length", F.lit(0)), "average_length"))
    saturated = lambda weight, tf: weight * (tf * F.lit(K1 + 1)) / (tf + damp)
    score = F.coalesce(map_dot(F.col("profile"), F.col("terms"), saturated), F.lit(0.0))
    joined = pairs.join(queries, "case_id", "left").join(texts.repartition(dealt, "candidate_id"), "candidate_id", "left")
    return joined.select(*pairs.columns, score.alias("score"))


def rank_run(scored: DataFrame) -> DataFrame:
    """The run of unlabelled data: ids and scores only."""
    return scored.select("case_id", "candidate_id", "score")


def fuse_runs(first: DataFrame, second: DataFrame, labels: DataFrame) -> DataFrame:
    """Two runs side by side as ``score_1`` and ``score_2`` with the label, pairs present in all three."""
    keys = ["case_id", "candidate_id"]
    a = first.select(*keys, F.col("score").alias("score_1"))
    b = second.select(*keys, F.col("score").alias("score_2"))
    return a.join(b, keys).join(labels.select(*keys, "rel"), keys)


def log_score(run: DataFrame, score: str = "score_1", name: str = "new_score") -> DataFrame:
    """Add the natural logarithm of a score: minus infinity for 0, NULL for negative scores."""
    return run.withColumn(name, F.when(F.col(score) > 0, F.log(score)).when(F.col(score) == 0, F.lit(float("-inf"))))


def unfold_scores(lists: DataFrame, pairs: DataFrame) -> DataFrame:
    """Score arrays per query (case_id, scores), aligned with the ascending candidate ids of ``pairs``.

    Every pair is returned; one beyond the end of its array has a null score.
    """
    places = row_numbers(pairs.select("case_id", "candidate_id"), ["case_id"], [F.col("candidate_id")], "place")
    values = lists.select("case_id", F.posexplode("scores").alias("_pos", "score"))
    scores = values.select("case_id", (F.col("_pos") + 1).cast("bigint").alias("place"), "score")
    return places.join(scores, ["case_id", "place"], "left").select("case_id", "candidate_id", "score")


def attach_external_scores(pairs: DataFrame, probabilities: DataFrame, column: str = "probabilities") -> DataFrame:
    """Take the probability of class 1 of an external model as the score of each pair."""
    scores = probabilities.select("case_id", "candidate_id", F.col(column)[1].alias("score"))
    return pairs.join(scores, ["case_id", "candidate_id"])


def rerank_merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Step-1 pairs with ``score_01`` and, where the second step scored them, ``score_02``; the label is
    that of step 1."""
    keys = ["case_id", "candidate_id"]
    a = first.select(*keys, F.col("score").alias("score_01"), "rel")
    b = second.select(*keys, F.col("score").alias("score_02"))
    return a.join(b, keys, "left")
