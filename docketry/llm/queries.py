"""The registry of this subpackage: one query per operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry.llm import bit_planes, chunk_recipes, context_mixing, count_transducer, license_rules, merkle_manifest, one_permutation, prefix_bpe, quality_neighbours, simhash, source_mixing, spelling_variants, top_products
from docketry.llm.common import crc_remainder, documents, table
from docketry.session import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op10_pivotal_mix(spark, sf_dir):
    """Words each document gives to the mix of all sources at weights 1, 2, 3."""
    return source_mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


@query
def op9_exact_top_k(spark, sf_dir):
    """The 20 highest integer inner products of every 20th vector with all others."""
    return top_products.top_products(table(spark, sf_dir, "embeddings"))


ORACLES["op9_exact_top_k"] = """
WITH vectors AS (
    SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scores AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op3_simhash_groups(spark, sf_dir):
    """Groups of documents whose SimHash fingerprints differ in four bits at most, chained."""
    return simhash.groups(table(spark, sf_dir, "documents"))


@query
def op8_prefix_bpe(spark, sf_dir):
    """Digests of every text's word-level BPE ids and of their decoding."""
    return prefix_bpe.encode_decode(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query
def op2_bit_planes(spark, sf_dir):
    """Documents as read back from a token file of all texts."""
    folder = new_path(spark, "tokens")
    bit_planes.write(table(spark, sf_dir, "documents"), folder)
    ids = bit_planes.read(spark, folder)
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op6_token_counts(spark, sf_dir):
    """Bytes and sentencepiece tokens of every text, and whether it has more than 4096 of them."""
    return count_transducer.token_counts(table(spark, sf_dir, "documents"))


@query
def op7_license_rules(spark, sf_dir):
    """License phrases and rule detections of every text."""
    return license_rules.summary(license_rules.scan(table(spark, sf_dir, "documents")))


@query
def op5_one_permutation_minhash(spark, sf_dir):
    """Fingerprints of every text and of its edited text, with their likeness."""
    return one_permutation.compare_edits(table(spark, sf_dir, "documents"))


@query
def op4_quality_knn(spark, sf_dir):
    """Quality of every text by votes of labelled texts; a third of the labels is held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = quality_neighbours.is_held_out()
    model = quality_neighbours.fit(docs, labels, held_out)
    scored = quality_neighbours.score(documents(docs), model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op1_context_mixing(spark, sf_dir):
    """Log probabilities of every text under a model of nine tenths of them."""
    return context_mixing.score(table(spark, sf_dir, "documents"))


@query
def op11_chunk_recipes(spark, sf_dir):
    """Groups of documents whose texts are equal but for the case of A-Z, and which row of each stays."""
    return chunk_recipes.copies(table(spark, sf_dir, "documents")).drop("row")


ORACLES["op11_chunk_recipes"] = """
WITH normal AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM normal
"""


@query
def op12_merkle_manifest(spark, sf_dir):
    """Leaf, roots and proof of every document, and whether the document without its line ends still verifies."""
    without_line_ends = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    return merkle_manifest.verified(table(spark, sf_dir, "documents"), crc_remainder("doc_id", 2) == 0, without_line_ends)


#: crc32 of a text: a table of 256 remainders from the polynomial, then one look-up per byte.
CRC_SQL = """
crc_table AS (
    SELECT list(list_reduce(list_prepend(i, [0, 1, 2, 3, 4, 5, 6, 7]),
                            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS remainders
    FROM range(256) AS t(i)
)"""


def crc_sql(blob: str) -> str:
    """SQL for the unsigned crc32 of a blob, next to ``CRC_SQL``."""
    numbers = f"[CAST(('0x' || hex({blob})[2 * k - 1 : 2 * k]) AS BIGINT) FOR k IN range(1, octet_length({blob}) + 1)]"
    return (
        f"xor(list_reduce(list_prepend(4294967295, {numbers}), "
        "lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1])), 4294967295)"
    )


def field_sql(column: str) -> str:
    """SQL for a leaf's field: its length in bytes, ":" and its value, or "-"."""
    value = f"CAST({column} AS VARCHAR)"
    return f"coalesce(octet_length(encode({value})) || ':' || {value}, '-')"


ORACLES["op12_merkle_manifest"] = f"""
WITH RECURSIVE {CRC_SQL}, fields AS (
    SELECT doc_id, source, lang, n_chars, text, CASE
        WHEN {crc_sql("encode(coalesce(CAST(doc_id AS VARCHAR), ''))")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered
    FROM documents, crc_table
), leaves AS (
    SELECT doc_id, source, sha256(front || {field_sql("text")}) AS leaf, sha256(front || {field_sql("tampered")}) AS tampered_leaf
    FROM (SELECT *, {" || ".join(map(field_sql, ("doc_id", "source", "lang", "n_chars")))} AS front FROM fields)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
           count(*) OVER (PARTITION BY source) AS n
    FROM leaves
), low AS (
    SELECT source, 0 AS level, pos, n, leaf AS digest FROM placed
    UNION ALL
    SELECT source, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
    FROM low WHERE n > 1 GROUP BY source, level, pos // 3, n
), subroots AS (
    SELECT source, level, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n
    FROM low WHERE n = 1
), high AS (
    SELECT 0 AS level, place AS pos, n, subroot AS digest FROM subroots
    UNION ALL
    SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
    FROM high WHERE n > 1 GROUP BY level, pos // 3, n
), low_ways AS (
    SELECT p.source, p.pos, l.level,
           coalesce(string_agg(l.digest, '' ORDER BY l.pos) FILTER (l.pos < p.pos // CAST(3 ** l.level AS BIGINT)), '') AS before,
           coalesce(string_agg(l.digest, '' ORDER BY l.pos) FILTER (l.pos > p.pos // CAST(3 ** l.level AS BIGINT)), '') AS after
    FROM placed p JOIN low l ON l.source IS NOT DISTINCT FROM p.source AND l.n > 1
         AND l.pos // 3 = p.pos // CAST(3 ** (l.level + 1) AS BIGINT)
    GROUP BY ALL
), high_ways AS (
    SELECT s.source, h.level + s.level AS level,
           coalesce(string_agg(h.digest, '' ORDER BY h.pos) FILTER (h.pos < s.place // CAST(3 ** h.level AS BIGINT)), '') AS before,
           coalesce(string_agg(h.digest, '' ORDER BY h.pos) FILTER (h.pos > s.place // CAST(3 ** h.level AS BIGINT)), '') AS after
    FROM subroots s JOIN high h ON h.n > 1 AND h.pos // 3 = s.place // CAST(3 ** (h.level + 1) AS BIGINT)
    GROUP BY s.source, s.level, h.level
), ways AS (
    SELECT p.source, p.pos, list({{'before': w.before, 'after': w.after}} ORDER BY w.level) FILTER (w.level IS NOT NULL) AS way
    FROM placed p LEFT JOIN (
        SELECT * FROM low_ways
        UNION ALL
        SELECT p.source, p.pos, h.level, h.before, h.after FROM placed p JOIN high_ways h ON h.source IS NOT DISTINCT FROM p.source
    ) w ON w.source IS NOT DISTINCT FROM p.source AND w.pos = p.pos
    GROUP BY p.source, p.pos
), folded AS (
    SELECT p.doc_id, p.leaf, s.subroot, (SELECT digest FROM high WHERE n = 1) AS root,
           sha256(coalesce(array_to_string([x.before || x.after FOR x IN way], ''), '')) AS proof_sha256,
           coalesce(list_reduce(list_prepend({{'before': '', 'after': p.tampered_leaf}}, way),
               lambda a, x: {{'before': '', 'after': sha256(x.before || a.after || x.after)}}).after, p.tampered_leaf) AS folded_root
    FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source
    JOIN ways w ON w.source IS NOT DISTINCT FROM p.source AND w.pos = p.pos
)
SELECT *, folded_root = root AS verified FROM folded
"""


@query
def op13_spelling_variants(spark, sf_dir):
    """Near words, form and root of every frequent word of all texts, with planted misspellings."""
    return spelling_variants.variants(spelling_variants.count_words(table(spark, sf_dir, "documents"), modulus=199))


ORACLES["op13_spelling_variants"] = f"""
WITH RECURSIVE {CRC_SQL}, runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run
    FROM documents
), counted AS (
    SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
    SELECT run, n, length(run) AS size, {crc_sql("encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)")} AS h
    FROM counted, crc_table
), edited AS (
    SELECT n, CASE WHEN h % 199 = 0 THEN left(run, h % size) || substr(run, h % size + 2) ELSE run END AS word FROM hashed
), words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cuts AS (
    SELECT word, n, i, left(word, i) AS prefix, substr(word, i + 2) AS suffix
    FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
    SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b USING (i, prefix, suffix) WHERE a.word <> b.word
    UNION
    SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.prefix || c.suffix
    UNION
    SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.prefix || c.suffix
), best AS (
    SELECT word, count(*) AS n_near, max(n) AS top_n, arg_min(other, (-n, other)) AS top FROM near GROUP BY word
), forms AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN top_n >= 5 * w.n THEN top END AS form,
           CASE WHEN top_n >= 5 * w.n THEN top_n END AS form_n
    FROM words w LEFT JOIN best b USING (word)
), ends AS (
    SELECT word, word AS at FROM words
    UNION ALL
    SELECT e.word, f.form FROM ends e JOIN forms f ON f.word = e.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, e.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN ends e ON e.word = f.word JOIN forms last ON last.word = e.at AND last.form IS NULL
"""
