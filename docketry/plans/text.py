"""Queries over document texts: preparation and vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import stemming
from docketry.functions.text import (
    ACCENTED,
    NON_LETTERS,
    UNACCENTED,
    bm25_tokens,
    clean_whitespace,
    long_sentences,
    term_tokens,
)
from docketry.operators import text
from docketry.operators.represent import term_counts
from docketry.plans import views
from docketry.plans.registry import query
from docketry.plans.views import TEXT_PAIRS
from docketry.session import dealt_texts, materialise

LANGUAGES = ("de", "en", "es", "fr")

CLEAN = "regexp_replace(replace(text, chr(10), ' '), ' {2,}', ' ', 'g')"
SENTENCES = f"""
cleaned AS (SELECT doc_id, {CLEAN} AS clean FROM documents),
parts AS (SELECT doc_id, string_split(regexp_replace(clean, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts
          FROM cleaned),
sentences AS (SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS pos, unnest(parts) AS sentence
              FROM parts),
long_sentences AS (SELECT * FROM sentences WHERE len(regexp_extract_all(sentence, '\\S+')) > 5),
numbered AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos, sentence
             FROM long_sentences)"""


def _gram_rows(source: str, column: str, keys: str) -> str:
    chars = f"string_split(' ' || trim(regexp_replace(lower({column}), '{NON_LETTERS}', ' ', 'g')) || ' ', '')"
    return f"""(SELECT {keys}, c[i] || c[i + 1] || c[i + 2] AS gram
      FROM (SELECT {keys}, c, unnest(range(1, len(c) - 1)) AS i FROM (SELECT {keys}, {chars} AS c FROM {source}))
      WHERE c[i + 1] <> ' ')"""


LANGUAGE = f"""
gram_counts AS (SELECT gram, {', '.join(f"count(*) FILTER (lang = '{x}') AS n_{x}" for x in LANGUAGES)}
                FROM {_gram_rows('documents', 'text', 'lang')} GROUP BY gram),
gram_sizes AS (SELECT count(*) AS grams, {', '.join(f'sum(n_{x}) AS t_{x}' for x in LANGUAGES)} FROM gram_counts),
likely AS (SELECT doc_id, pos, {', '.join(f'round(sum(ln(coalesce(n_{x}, 0) + 1) - ln(t_{x} + grams)), 6) AS s_{x}' for x in LANGUAGES)}
           FROM {_gram_rows('numbered', 'sentence', 'doc_id, pos')} LEFT JOIN gram_counts USING (gram)
           CROSS JOIN gram_sizes GROUP BY doc_id, pos),
languages AS (SELECT doc_id, pos, sentence, CASE WHEN s_en IS NULL THEN 'non-en'
    {' '.join(f"WHEN s_{x} >= greatest({', '.join('s_' + y for y in LANGUAGES)}) THEN '{x}'" for x in LANGUAGES)}
    END AS language FROM numbered LEFT JOIN likely USING (doc_id, pos)),
kept AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos, sentence
         FROM languages WHERE language = 'en')"""


def profiles(spark, sf_dir):
    """The language profiles of the labelled documents, trained once and kept."""
    labelled = views.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return materialise(text.train_language_profiles(dealt_texts(labelled), LANGUAGES))


def texts(spark, sf_dir):
    return dealt_texts(views.documents(spark, sf_dir))


def kept_sentences(spark, sf_dir):
    return text.document_sentences(texts(spark, sf_dir), profiles(spark, sf_dir), LANGUAGES)


@query("clean_whitespace", f"SELECT doc_id, {CLEAN} AS clean FROM documents")
def _clean_whitespace(spark, sf_dir):
    return views.documents(spark, sf_dir).select("doc_id", clean_whitespace(F.col("text")).alias("clean"))


@query("split_sentences", f"WITH {SENTENCES} SELECT doc_id, pos, sentence FROM sentences")
def split_sentences(spark, sf_dir):
    return text.sentences(views.documents(spark, sf_dir))


ABBREVIATIONS = f"""
tokens AS (SELECT unnest(regexp_extract_all(lower(clean), '{text.TOKEN.replace("'", "''")}')) AS token FROM cleaned),
words AS (SELECT rtrim(token, '.') AS word, token LIKE '%.' AS is_dotted FROM tokens),
word_counts AS (SELECT word, count(*) FILTER (is_dotted) AS dotted, count(*) FILTER (NOT is_dotted) AS plain
                FROM words WHERE regexp_matches(word, '^\\p{{L}}') GROUP BY word),
shares AS (SELECT sum(dotted) / CAST(sum(dotted + plain) AS DOUBLE) AS share FROM word_counts),
ratios AS (SELECT word, dotted, plain, length(replace(word, '.', '')) AS letters,
      -2 * (dotted * ln(share) + plain * ln(1 - share) - dotted * ln(0.99e0) - plain * ln(0.01e0)) AS ratio
    FROM word_counts, shares WHERE dotted > 0),
abbreviation_statistics AS (SELECT word, dotted, plain,
      ratio * exp(-letters) * (length(word) - letters + 1) * pow(letters, -plain) AS score FROM ratios)"""


@query("abbreviation_statistics", f"WITH {SENTENCES}, {ABBREVIATIONS} SELECT * FROM abbreviation_statistics", ("score",))
def abbreviation_statistics(spark, sf_dir):
    """How far every word with a period after it looks like an abbreviation."""
    return text.abbreviation_statistics(views.documents(spark, sf_dir))


@query(
    "split_sentences_abbreviations",
    f"""WITH {SENTENCES}, {ABBREVIATIONS}, cut AS (
      SELECT doc_id, pos, sentence, CASE WHEN sentence LIKE '%.'
        THEN rtrim(regexp_extract_all(lower(sentence), '{text.TOKEN.replace("'", "''")}')[-1], '.') END AS last FROM sentences),
    flagged AS (SELECT c.*, lag(a.word IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY pos) AS goes_on FROM cut c
      LEFT JOIN (SELECT word FROM abbreviation_statistics WHERE round(score, 6) >= 0.3) a ON a.word = c.last),
    grouped AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS place FROM flagged)
    SELECT doc_id, CAST(place AS INTEGER) AS pos, string_agg(sentence, ' ' ORDER BY grouped.pos) AS sentence
    FROM grouped GROUP BY doc_id, place""",
)
def split_sentences_abbreviations(spark, sf_dir):
    """Sentences that don't end after abbreviations, which are found in the texts themselves."""
    docs = views.documents(spark, sf_dir)
    return text.sentences(docs, text.abbreviations(text.abbreviation_statistics(docs)))


@query("filter_short_sentences", f"WITH {SENTENCES} SELECT doc_id, pos, sentence FROM long_sentences")
def filter_short_sentences(spark, sf_dir):
    return text.filter_short_sentences(text.sentences(views.documents(spark, sf_dir)))


@query("detect_language", f"WITH {SENTENCES}, {LANGUAGE} SELECT doc_id, pos, language FROM languages")
def detect_language(spark, sf_dir):
    rows = texts(spark, sf_dir).select(
        "doc_id", F.posexplode(long_sentences(F.col("text"))).alias("pos", "sentence")
    )
    return text.detect_language(rows, profiles(spark, sf_dir), LANGUAGES)


CLEAN_TEXT = """
clean_texts AS (SELECT doc_id, coalesce(string_agg(sentence, ' ' ORDER BY pos), '') AS clean_text
                FROM documents LEFT JOIN kept USING (doc_id) GROUP BY doc_id)"""


@query("clean_text", f"WITH {SENTENCES}, {LANGUAGE}, {CLEAN_TEXT} SELECT * FROM clean_texts")
def clean_text(spark, sf_dir):
    return text.clean_text(texts(spark, sf_dir), profiles(spark, sf_dir), LANGUAGES)


@query("sentence_table", f"WITH {SENTENCES}, {LANGUAGE} SELECT doc_id, pos, sentence FROM kept")
def sentence_table(spark, sf_dir):
    return text.sentence_table(texts(spark, sf_dir), profiles(spark, sf_dir), LANGUAGES)


@query(
    "sentence_corpus",
    f"""WITH {SENTENCES}, {LANGUAGE}
    SELECT doc_id, coalesce(string_agg(sentence || chr(10), '' ORDER BY pos), '') AS lines
    FROM documents LEFT JOIN kept USING (doc_id) GROUP BY doc_id""",
)
def sentence_corpus(spark, sf_dir):
    return text.sentence_corpus(texts(spark, sf_dir), profiles(spark, sf_dir), LANGUAGES)


def _rank_rounds(iterations: int) -> str:
    rounds = ["round_0 AS (SELECT *, 1e0 AS score FROM shares)"]
    for i in range(iterations):
        rounds.append(
            f"""sent_{i} AS (SELECT doc_id, term, sum(asks * score) AS sent FROM round_{i} GROUP BY doc_id, term),
got_{i} AS (SELECT r.doc_id, r.pos, 0.15e0 + 0.85e0 * sum(r.gives * (s.sent - r.asks * r.score)) AS score
            FROM round_{i} r JOIN sent_{i} s ON s.doc_id = r.doc_id AND s.term = r.term GROUP BY r.doc_id, r.pos),
round_{i + 1} AS (SELECT r.doc_id, r.pos, r.term, r.asks, r.gives, g.score FROM round_{i} r
                  JOIN got_{i} g ON g.doc_id = r.doc_id AND g.pos = r.pos)"""
        )
    return ",\n".join(rounds)


SUMMARY = f"""
entries AS MATERIALIZED (SELECT doc_id, pos, term, count(*) AS tf FROM (
  SELECT doc_id, pos, unnest(regexp_extract_all(lower(sentence), '[a-z]{{2,}}')) AS term FROM kept) GROUP BY ALL),
lens AS (SELECT doc_id, pos, sum(tf) AS length FROM entries GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n, sum(coalesce(length, 0)) AS tokens
          FROM kept LEFT JOIN lens USING (doc_id, pos) GROUP BY doc_id),
dfs AS (SELECT doc_id, term, count(*) AS df FROM entries GROUP BY ALL),
idfs AS (SELECT doc_id, term, ln(n - df + 0.5e0) - ln(df + 0.5e0) AS idf FROM dfs JOIN sizes USING (doc_id)),
means AS (SELECT doc_id, avg(idf) AS mean FROM idfs GROUP BY doc_id),
weighed AS (SELECT e.doc_id, e.pos, e.term,
    tf * greatest(CASE WHEN idf < 0 THEN 0.25e0 * mean ELSE idf END, 0e0) AS asks,
    tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * length / (tokens / n))) AS gives
  FROM entries e JOIN idfs USING (doc_id, term) JOIN means USING (doc_id) JOIN sizes USING (doc_id)
  JOIN lens ON lens.doc_id = e.doc_id AND lens.pos = e.pos),
offers AS (SELECT doc_id, term, sum(gives) AS gives FROM weighed GROUP BY ALL),
outgoing AS (SELECT w.doc_id, w.pos, sum(w.asks * (o.gives - w.gives)) AS total
             FROM weighed w JOIN offers o ON o.doc_id = w.doc_id AND o.term = w.term GROUP BY ALL),
shares AS MATERIALIZED (SELECT w.doc_id, w.pos, w.term, CASE WHEN total > 0 THEN w.asks / total ELSE 0 END AS asks, w.gives
           FROM weighed w JOIN outgoing o ON o.doc_id = w.doc_id AND o.pos = w.pos),
{_rank_rounds(10)},
final AS (SELECT DISTINCT doc_id, pos, score FROM round_10),
placed AS (SELECT k.doc_id, k.pos, k.sentence, len(regexp_extract_all(sentence, '\\S+')) AS words,
    row_number() OVER (PARTITION BY k.doc_id ORDER BY round(coalesce(score, 0.15e0), 6) DESC, k.pos) AS place
  FROM kept k LEFT JOIN final f ON f.doc_id = k.doc_id AND f.pos = k.pos),
summed AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY place) AS upto FROM placed),
fitting AS (SELECT *, min(CASE WHEN abs(180 - upto) <= abs(180 - (upto - words)) THEN 1 ELSE 0 END)
            OVER (PARTITION BY doc_id ORDER BY place) AS fits FROM summed),
summaries AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM fitting WHERE fits = 1 GROUP BY doc_id)"""


@query(
    "summarize",
    f"""WITH {SENTENCES}, {LANGUAGE}, {CLEAN_TEXT}, {SUMMARY}
    SELECT doc_id, coalesce(summary, clean_text) AS summary FROM clean_texts LEFT JOIN summaries USING (doc_id)""",
)
def summarize(spark, sf_dir):
    return text.summarize(kept_sentences(spark, sf_dir))


def _token_report(spark, sf_dir, tokens):
    joined = F.array_join("tokens", " ")
    return views.documents(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("tokens")).select(
        "doc_id", F.size("tokens").cast("bigint").alias("n"), F.md5(joined).alias("digest")
    )


def _token_sql(expression: str) -> str:
    return f"""SELECT doc_id, len(tokens) AS n, md5(array_to_string(tokens, ' ')) AS digest
    FROM (SELECT doc_id, {expression} AS tokens FROM documents)"""


@query("tokenize_terms", _token_sql("regexp_extract_all(lower(text), '[a-z]{2,}')"))
def tokenize_terms(spark, sf_dir):
    return _token_report(spark, sf_dir, term_tokens)


BM25_TOKENS = (
    "regexp_extract_all(lower(regexp_replace(translate(text, "
    f"'{ACCENTED}', '{UNACCENTED}'), '\\p{{Mn}}+', '', 'g')), '[\\p{{L}}_]{{3,}}')"
)


@query("tokenize_bm25", _token_sql(BM25_TOKENS))
def tokenize_bm25(spark, sf_dir):
    return _token_report(spark, sf_dir, bm25_tokens)


@query(
    "apply_preprocessing",
    f"""WITH {TEXT_PAIRS}, cleaned AS (SELECT doc_id, md5({CLEAN}) AS digest FROM documents)
    SELECT case_id, candidate_id, rel, a.digest AS case_digest, b.digest AS candidate_digest
    FROM text_pairs JOIN cleaned a ON a.doc_id = case_id JOIN cleaned b ON b.doc_id = candidate_id""",
)
def apply_preprocessing(spark, sf_dir):
    pairs = text.apply_preprocessing(
        views.text_pairs(spark, sf_dir), views.documents(spark, sf_dir), clean_whitespace
    )
    return pairs.select(
        "case_id",
        "candidate_id",
        "rel",
        F.md5("case_text").alias("case_digest"),
        F.md5("candidate_text").alias("candidate_digest"),
    )


def _stem_sql(source: str) -> str:
    """The stemming steps as common table expressions, from the same fixed values."""
    has = lambda x, shape: f"regexp_matches({x}, '{shape}')"
    ends = lambda suffix, w="w": f"ends_with({w}, '{suffix}')"
    cut = lambda n, w="w": f"left({w}, greatest(length({w}) - {n}, 0))"
    m0, m1, m2 = stemming.MEASURE_ABOVE_0, stemming.MEASURE_IS_1, stemming.MEASURE_ABOVE_1
    cvc, vowel, double = stemming.ENDS_CVC, stemming.HAS_VOWEL, stemming.DOUBLE_CONSONANT

    def table(rules, shape, word="w", also=""):
        lines = []
        for suffix, ending in rules:
            stem = cut(len(suffix), word)
            extra = also if suffix == "ion" else ""
            test = f"{has(stem + (" || 'l'" if suffix == 'logi' else ''), shape)}{extra.format(stem=stem)}"
            lines.append(f"WHEN {ends(suffix, word)} THEN CASE WHEN {test} THEN {stem} || '{ending}' ELSE {word} END")
        return "CASE " + " ".join(lines) + f" ELSE {word} END"

    def tidy(stem):
        return f"""CASE WHEN {has(stem, '(at|bl|iz)$')} THEN {stem} || 'e'
          WHEN {has(stem, double)} THEN {cut(1, stem)}
          WHEN {has(stem, m1)} AND {has(stem, cvc)} THEN {stem} || 'e' ELSE {stem} END"""

    step_2 = [*stemming.STEP_2, ("logi", "log")]
    step_4 = [(s, "") for s in stemming.STEP_4]
    step_4.insert(stemming.STEP_4.index("ou"), ("ion", ""))
    short = f"({cut(4)} || 'al')"
    steps = [
        f"""CASE WHEN {ends('ies')} AND length(w) = 4 THEN {cut(1)} WHEN {ends('sses')} THEN {cut(2)}
            WHEN {ends('ies')} THEN {cut(2)} WHEN {ends('ss')} THEN w WHEN {ends('s')} THEN {cut(1)} ELSE w END""",
        f"""CASE WHEN {ends('ied')} THEN CASE WHEN length(w) = 4 THEN {cut(1)} ELSE {cut(2)} END
            WHEN {ends('eed')} THEN CASE WHEN {has(cut(3), m0)} THEN {cut(1)} ELSE w END
            WHEN {ends('ed')} AND {has(cut(2), vowel)} THEN {tidy(cut(2))}
            WHEN {ends('ing')} AND {has(cut(3), vowel)} THEN {tidy(cut(3))} ELSE w END""",
        f"""CASE WHEN {ends('y')} AND length(w) > 2 AND {has(cut(1), stemming.ENDS_CONSONANT)}
            THEN {cut(1)} || 'i' ELSE w END""",
        f"CASE WHEN {ends('alli')} AND {has(cut(4), m0)} THEN {table(step_2, m0, short)} ELSE {table(step_2, m0)} END",
        table(stemming.STEP_3, m0),
        table(step_4, m2, also=" AND regexp_matches({stem}, '[st]$')"),
        f"""CASE WHEN {ends('e')} AND ({has(cut(1), m2)} OR ({has(cut(1), m1)} AND NOT {has(cut(1), cvc)}))
            THEN {cut(1)} ELSE w END""",
        f"CASE WHEN {ends('ll')} AND {has(cut(1), m2)} THEN {cut(1)} ELSE w END",
    ]
    ctes = [f"step_0 AS (SELECT DISTINCT term, term AS w FROM {source})"]
    ctes += [f"step_{i + 1} AS (SELECT term, {s} AS w FROM step_{i})" for i, s in enumerate(steps)]
    irregular = " ".join(f"WHEN term = '{a}' THEN '{b}'" for a, b in stemming.IRREGULAR.items())
    ctes.append(
        f"stems AS (SELECT term, CASE {irregular} WHEN length(term) <= 2 THEN term ELSE w END AS stem FROM step_8)"
    )
    return ",\n".join(ctes)


TERM_COUNTS = """
term_counts AS (SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS term FROM documents) GROUP BY ALL)"""


STEMS = _stem_sql("term_counts")


@query("stem_vocabulary", f"WITH {TERM_COUNTS}, {STEMS} SELECT term, stem FROM stems")
def stem_vocabulary(spark, sf_dir):
    return text.stem_vocabulary(text.tokenize_terms(views.documents(spark, sf_dir)))


@query(
    "stem_terms",
    f"""WITH {TERM_COUNTS}, {STEMS}
    SELECT doc_id, stem AS term, CAST(sum(tf) AS BIGINT) AS tf FROM term_counts JOIN stems USING (term)
    GROUP BY doc_id, stem""",
)
def stem_terms(spark, sf_dir):
    counts = materialise(term_counts(texts(spark, sf_dir)))
    return text.stem_terms(counts, text.stem_vocabulary(counts))
