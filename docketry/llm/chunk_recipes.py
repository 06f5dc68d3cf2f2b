"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A normalised text is cut where its own characters say so: a chunk has at least ``LEAST`` characters and ends after
the next one of a few rare letters, or at ``MOST``. Equal texts have equal chunks, and texts that share long
passages share most of theirs. Distinct chunks are combined on the map side and cross the network once; there
each chunk value is checked against all others of its hash, so a chunk's identifier, (hash, ordinal among the
texts of that hash), stands for exactly one text. A document is then its recipe, the ordered list of its
chunks' identifiers: two documents are equal if and only if their recipes are, and long documents are grouped
by short lists of numbers. The texts themselves are never sorted, joined or grouped.

Recipes take 8 bytes a chunk; where no two different chunks share a hash, which the check proves for the table
at hand, all ordinals are 0 and are not looked up.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from docketry.session import materialise

#: Characters of a chunk before a cut is looked for, and at most.
LEAST, MOST = 256, 8192
#: A chunk ends after one of these: about one character in 40 to 200 of text in Latin letters; other scripts are cut at MOST.
CUT = "jqxz"
ROW = "__docketry_row"
NO_ORDINALS = "array<struct<place:int,ordinal:int>>"


def normalised(text: Column) -> Column:
    """A-Z as a-z; every other character stays. Null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text, which put end to end are the text; none for the empty text."""
    pattern = f"(?s).{{{least}}}[^{CUT}]{{0,{most - least}}}+[{CUT}]?|.{{1,{least}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def shared_hashes(cut: DataFrame, hashed: Callable[[Column], Column] = chunk_hash) -> DataFrame | None:
    """(hash, chunk, ordinal) of the chunks whose hash another chunk has too, ordinals from 0; None if there are none.

    Chunks are combined before the shuffle, so a frequent chunk is one row per task; the check for several
    chunks of one hash counts distinct chunks only.
    """
    each = cut.select(F.explode("chunks").alias("chunk")).select(hashed(F.col("chunk")).alias("hash"), "chunk")
    distinct = each.groupBy("hash", "chunk").agg(F.lit(1).alias("_one"))
    several = materialise(distinct.groupBy("hash").agg(F.count("_one").alias("_n")).filter("_n > 1"), "shared_hashes")
    if several.isEmpty():
        return None
    texts = distinct.join(several, "hash", "left_semi").groupBy("hash").agg(F.sort_array(F.collect_list("chunk")).alias("texts"))
    return materialise(texts.select("hash", F.posexplode("texts").alias("ordinal", "chunk")), "shared_chunks")


def recipes(
    docs: DataFrame, least: int = LEAST, most: int = MOST, hashed: Callable[[Column], Column] = chunk_hash
) -> DataFrame:
    """(row, doc_id, text_sha256, recipe): every row of ``docs`` under a number of its own, with its recipe.

    ``recipe`` holds the chunks' hashes in order, and the place and ordinal of every chunk whose ordinal is not
    0: equal recipes mean equal texts. ``row`` is ``docs``'s own ``ROW`` if it has one; otherwise it is given
    when the table is written, the same in every later read.
    """
    row = F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()
    texts = docs.select(row.alias("row"), "doc_id", normalised(F.col("text")).alias("text"))
    cut = texts.withColumn("chunks", chunks(F.col("text"), least, most))
    shared = shared_hashes(cut, hashed)
    digest, hashes = F.sha2("text", 256).alias("text_sha256"), F.transform("chunks", hashed).alias("hashes")
    if shared is None:
        nothing = F.array().cast(NO_ORDINALS).alias("ordinals")
        return materialise(cut.select("row", "doc_id", digest, F.struct(hashes, nothing).alias("recipe")), "recipes")
    numbered = materialise(cut.select("row", "doc_id", digest, hashes, "chunks"), "chunked")
    held = numbered.select("row", F.posexplode("chunks").alias("place", "chunk"))
    held = held.withColumn("hash", hashed(F.col("chunk"))).join(shared.filter("ordinal > 0"), ["hash", "chunk"])
    places = held.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "ordinal"))).alias("ordinals"))
    ordinals = F.coalesce("ordinals", F.array().cast(NO_ORDINALS)).alias("ordinals")
    with_places = numbered.drop("chunks").join(places, "row", "left")
    return materialise(with_places.select("row", "doc_id", "text_sha256", F.struct("hashes", ordinals).alias("recipe")), "recipes")


def copies(docs: DataFrame, **options) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, text_sha256): one row per row of ``docs``, dropped ones too.

    Texts are equal when they are after A-Z are lower-cased; null counts as empty. Of equal texts the row with
    the largest doc_id stays (a null id is below all others; of several rows with that id and text one stays, so
    every group has exactly one row with ``kept``). Other columns take no part. An empty table gives an empty
    result.

    Groups are counted and joined under (recipe, salt), with as many salts as there are shuffle partitions, so
    the rows of a very large group are dealt over all tasks; the salts of one group are joined as one row each.
    """
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = recipes(docs, **options).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    partial = rows.groupBy("recipe", "salt").agg(
        F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("n")
    )
    groups = partial.groupBy("recipe").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
    dealt = partial.select("recipe", "salt").join(groups.filter("group_size > 1"), "recipe")
    joined = rows.join(dealt, ["recipe", "salt"], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "row",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    numbered = materialise(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    kept = copies(numbered, **options).filter("kept").select(F.col("row").alias(ROW))
    return numbered.join(kept, ROW, "left_semi").drop(ROW)
