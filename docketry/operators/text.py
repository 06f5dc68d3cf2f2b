"""Text preparation over ``docs(doc_id, text)``: sentences, language, cleaning, summaries, vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from docketry.functions.stemming import porter_vocabulary
from docketry.functions.text import (
    MIN_SENTENCE_WORDS,
    clean_whitespace,
    letter_trigrams,
    letter_words,
    long_sentences,
    split_sentences,
    term_tokens,
    word_count,
)
from docketry.operators.blocks import Block, doubles, numbered, whole_blocks, with_terms
from docketry.session import materialise, row_parts, text_parts

SUMMARY_WORDS = 180
#: A word for abbreviation statistics, with the periods in and after it.
TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}.'-]*"
LEAST_ABBREVIATION = 0.3
#: Trigrams that every task holds, with their log probabilities.
MOST_GRAMS = 1 << 18
UNKNOWN_LANGUAGE = "non-en"


def apply_preprocessing(pairs: DataFrame, docs: DataFrame, function: Callable[[Column], Column]) -> DataFrame:
    """The pair table with both texts passed through ``function``.

    The function runs once per document, not once per pair; the pairs pick the result up by key.
    """
    prepared = docs.select("doc_id", function(F.col("text")).alias("_text"))
    case_texts = prepared.select(F.col("doc_id").alias("case_id"), F.col("_text").alias("case_text"))
    candidate_texts = prepared.select(
        F.col("doc_id").alias("candidate_id"), F.col("_text").alias("candidate_text")
    )
    return pairs.join(candidate_texts, "candidate_id").join(case_texts, "case_id")


def sentences(docs: DataFrame, abbreviations: DataFrame | None = None) -> DataFrame:
    """Every sentence of the cleaned text with its position.

    With ``abbreviations`` (a column ``word``), no sentence ends after one of them. Sentences as cut by punctuation are
    joined with the list by their last word, so neither a text nor the list is held by all tasks; a document's sentences
    are put in order together. A null text has no sentences, and doc_ids are told apart by their value.
    """
    parts = split_sentences(clean_whitespace(F.col("text")))
    cut = docs.select("doc_id", F.posexplode(parts).alias("pos", "sentence"))
    if abbreviations is None:
        return cut
    last = F.element_at(F.regexp_extract_all(F.lower("sentence"), F.lit(TOKEN), F.lit(0)), -1)
    dotted = F.col("sentence").endswith(".")
    known = abbreviations.select(F.col("word").alias("_last"), F.lit(True).alias("_open")).distinct()
    cut = cut.withColumn("_last", F.when(dotted, F.rtrim(last, F.lit("."))))
    order = Window.partitionBy("doc_id").orderBy("pos")
    starts = F.when(F.lag("_open").over(order), 0).otherwise(1)
    joined = cut.join(known, "_last", "left").withColumn("_starts", starts)
    numbered = joined.withColumn("_sentence", F.sum("_starts").over(order) - 1)
    parts = F.sort_array(F.collect_list(F.struct("pos", "sentence")))
    return numbered.groupBy("doc_id", F.col("_sentence").cast("int").alias("pos")).agg(
        F.array_join(F.transform(parts, lambda p: p["sentence"]), " ").alias("sentence")
    )


def abbreviation_statistics(docs: DataFrame) -> DataFrame:
    """(word, dotted, plain, score): how far each word that ever has a period after it looks like an abbreviation.

    The log-likelihood ratio compares "a period follows in 99 of 100 cases" with "as often as after any word" (Kiss and
    Strunk 2006); the score is that ratio, less for long words and for every time the word stands without a period, more
    for periods inside. Words start with a letter; case makes no difference. Counts are combined before the shuffle.
    """
    token = F.explode(F.regexp_extract_all(F.lower(clean_whitespace(F.col("text"))), F.lit(TOKEN), F.lit(0))).alias("token")
    words = docs.select(token).select(F.rtrim("token", F.lit(".")).alias("word"), F.col("token").endswith(".").alias("_dotted"))
    counts = materialise(
        words.filter(F.col("word").rlike(r"^\p{L}")).groupBy("word").agg(F.count_if("_dotted").alias("dotted"), F.count_if(~F.col("_dotted")).alias("plain"))
    )
    dotted, total = counts.agg(F.sum("dotted"), F.sum(F.col("dotted") + F.col("plain"))).first()
    share = (dotted or 0) / (total or 1)
    c, n = F.col("dotted"), F.col("plain")
    log = lambda p: F.lit(float(np.log(p)) if p > 0 else 0.0)  # a share of 0 or 1 meets counts of 0 only
    ratio = -2 * (c * log(share) + n * log(1 - share) - c * log(0.99) - n * log(0.01))
    letters = F.char_length(F.replace(F.col("word"), F.lit("."), F.lit("")))
    periods = F.char_length("word") - letters
    score = ratio * F.exp(-letters) * (periods + 1) * F.pow(letters.cast("double"), -n.cast("double"))
    return counts.filter(c > 0).select("word", "dotted", "plain", score.alias("score"))


def abbreviations(statistics: DataFrame, least: float = LEAST_ABBREVIATION) -> DataFrame:
    """(word): those with a score of at least ``least``, compared to six decimals."""
    return statistics.filter(F.round("score", 6) >= least).select("word")


def filter_short_sentences(sentence_rows: DataFrame, min_words: int = MIN_SENTENCE_WORDS) -> DataFrame:
    """Keep sentences with more than ``min_words`` words."""
    return sentence_rows.filter(word_count(F.col("sentence")) > min_words)


def train_language_profiles(labelled: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Smoothed log probability of every letter trigram, one column ``lp_<language>`` each, and the
    value ``unseen_<language>`` for trigrams that occur in no training text.

    ``labelled`` holds (text, lang). Letters are those of any script.
    """
    # words are counted first, so trigrams are taken once per different word
    words = labelled.select("lang", F.explode(F.split(letter_words(F.col("text")), " ")).alias("word"))
    by_word = words.groupBy("word").agg(
        *[F.count(F.when(F.col("lang") == name, 1)).alias(f"n_{name}") for name in languages]
    )
    grams = by_word.withColumn("gram", F.explode(letter_trigrams(F.col("word"))))
    counts = grams.groupBy("gram").agg(*[F.sum(f"n_{name}").alias(f"n_{name}") for name in languages])
    counts = materialise(counts)  # read once per total below
    sizes = counts.agg(
        F.count("*").alias("grams"), *[F.sum(f"n_{name}").alias(f"total_{name}") for name in languages]
    )
    columns = []
    for name in languages:
        total = sizes.select(F.col(f"total_{name}") + F.col("grams")).scalar()
        columns += [
            (F.log(F.col(f"n_{name}") + 1) - F.log(total.cast("double"))).alias(f"lp_{name}"),
            (-F.log(total.cast("double"))).alias(f"unseen_{name}"),
        ]
    return counts.select("gram", *columns)


def trigram_sums(sentence_rows: DataFrame, profiles: DataFrame, languages: Sequence[str]) -> DataFrame:
    """(doc_id, pos, grams, seen, sum_<language>): how many trigrams a sentence has, how many of them the profiles
    know, and the sums of these ones' log probabilities.

    The ``MOST_GRAMS`` likeliest trigrams, or all if there are fewer, go to the tasks as a sorted array of numbers, so that
    their trigrams need no row each. What a sentence has besides is joined with the rest of the profiles.
    """
    names = [f"lp_{name}" for name in languages]
    likeliest = [sum((F.col(c) for c in names[1:]), F.col(names[0])).desc(), F.col("gram")]
    first = profiles.select("gram", *names).orderBy(*likeliest).limit(MOST_GRAMS).toArrow()  # MOST_GRAMS rows
    more = first.num_rows == MOST_GRAMS
    known, at = gram_numbers(first["gram"].to_pylist())
    order = np.argsort(known, kind="stable")
    values = np.stack([first[c].to_numpy()[at] for c in names], 1)[order] if len(at) else np.zeros((0, len(names)))
    shared = profiles.sparkSession.sparkContext.broadcast((known[order], values))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = shared.value
        known, values = np.append(known, -1), np.vstack([values, np.zeros(len(names))])  # the last is never found
        for batch in batches:
            words = ["" if w is None else f" {w} " for w in batch.column("words").to_pylist()]
            code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
            owner = np.repeat(np.arange(len(words)), list(map(len, words)))
            middle = np.flatnonzero(code[1:-1] != 32) + 1  # blanks part the sentences, too
            number, owner = code[middle - 1] << 42 | code[middle] << 21 | code[middle + 1], owner[middle]
            place = np.searchsorted(known[:-1], number)
            found = known[place] == number
            place[~found] = len(known) - 1
            counts = [np.bincount(owner, minlength=len(words)), np.bincount(owner[found], minlength=len(words))]
            sums = [np.bincount(owner, values[place, i], len(words)).astype(np.float64) for i in range(len(names))]
            rest = [[] for _ in words]
            for i in np.flatnonzero(~found) if more else ():
                rest[owner[i]].append("".join(map(chr, code[middle[i] - 1 : middle[i] + 2])))
            columns = [batch.column("doc_id"), batch.column("pos"), *map(pa.array, counts + sums), pa.array(rest, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "pos", "grams", "seen", *sum_names, "rest"])

    sum_names = [f"sum_{name}" for name in languages]
    kinds = [f"{c} {sentence_rows.schema[c].dataType.simpleString()}" for c in ("doc_id", "pos")]
    schema = ", ".join([*kinds, "grams long, seen long", *[f"{c} double" for c in sum_names], "rest array<string>"])
    rows = sentence_rows.select("doc_id", "pos", letter_words(F.col("sentence")).alias("words")).mapInArrow(rate, schema)
    if not more:
        return rows.drop("rest")
    rows = materialise(rows)
    table = profiles.orderBy(*likeliest).offset(MOST_GRAMS).select("gram", *names)
    others = rows.select("doc_id", "pos", F.explode("rest").alias("gram")).join(table, "gram")
    others = others.select("doc_id", "pos", F.lit(0).alias("grams"), F.lit(1).alias("seen"), *[F.col(a).alias(b) for a, b in zip(names, sum_names)])
    return rows.drop("rest").unionByName(others)


def gram_numbers(grams: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of three code points, place in ``grams``) of every string of that length."""
    whole = [i for i, gram in enumerate(grams) if len(gram) == 3]
    code = np.frombuffer("".join(grams[i] for i in whole).encode("utf-32-le"), "<u4").astype(np.int64).reshape(-1, 3)
    return code[:, 0] << 42 | code[:, 1] << 21 | code[:, 2], np.array(whole, np.int64)


def detect_language(sentence_rows: DataFrame, profiles: DataFrame, languages: Sequence[str]) -> DataFrame:
    """(doc_id, pos, language): the language under which the sentence's trigrams are most likely.

    Sentences without letters get ``non-en``. Scores are compared after rounding to six decimals; equal
    scores go to the first language by name.
    """
    unseen = profiles.select(*[F.max(f"unseen_{name}").alias(f"unseen_{name}") for name in languages])
    sums = trigram_sums(sentence_rows, profiles, languages)
    scores = sums.groupBy("doc_id", "pos").agg(*[F.sum(c).alias(c) for c in sums.columns if c not in ("doc_id", "pos")])
    missing = F.col("grams") - F.col("seen")
    totals = scores.select(
        "doc_id",
        "pos",
        "grams",
        *[
            F.round(
                F.col(f"sum_{name}")
                + missing * unseen.select(f"unseen_{name}").scalar(),
                6,
            ).alias(f"score_{name}")
            for name in languages
        ],
    )
    best = F.greatest(*[F.col(f"score_{name}") for name in languages])
    choice = F.coalesce(
        *[F.when(F.col(f"score_{name}") == best, F.lit(name)) for name in sorted(languages)]
    )
    language = F.when(F.col("grams") > 0, choice).otherwise(F.lit(UNKNOWN_LANGUAGE))
    return totals.select("doc_id", "pos", language.alias("language"))


def document_sentences(
    docs: DataFrame, profiles: DataFrame, languages: Sequence[str], keep: str = "en"
) -> DataFrame:
    """(doc_id, sentences): the long sentences of each document in language ``keep``, in order.

    Languages are collected per document, so the array is no longer than the text it came from.
    """
    # cut once, and read by the languages and the result; partitions follow the texts
    size = F.octet_length("text").alias("_size")
    split = materialise(docs.select("doc_id", size, long_sentences(F.col("text")).alias("_all")))
    n = text_parts(split, F.col("_size"))
    rows = split.select("doc_id", F.posexplode("_all").alias("pos", "sentence"))
    kept = detect_language(rows, profiles, languages).filter(F.col("language") == keep)
    positions = kept.groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("_kept"))
    chosen = F.transform(F.col("_kept"), lambda p: F.element_at("_all", p + 1))
    empty = F.array().cast("array<string>")
    return split.repartition(n, "doc_id").join(positions.repartition(n, "doc_id"), "doc_id", "left").select(
        "doc_id", F.coalesce(chosen, empty).alias("sentences")
    )


def clean_text(docs: DataFrame, profiles: DataFrame, languages: Sequence[str], keep: str = "en") -> DataFrame:
    """(doc_id, clean_text): kept sentences joined by blanks; empty when none is kept."""
    kept = document_sentences(docs, profiles, languages, keep)
    return kept.select("doc_id", F.array_join("sentences", " ").alias("clean_text"))


def sentence_table(docs: DataFrame, profiles: DataFrame, languages: Sequence[str], keep: str = "en") -> DataFrame:
    """(doc_id, pos, sentence): kept sentences numbered from 0 within their document."""
    kept = document_sentences(docs, profiles, languages, keep)
    return kept.select("doc_id", F.posexplode("sentences").alias("pos", "sentence"))


def sentence_corpus(docs: DataFrame, profiles: DataFrame, languages: Sequence[str], keep: str = "en") -> DataFrame:
    """(doc_id, lines): kept sentences each ended by a newline; the line writer adds the empty line that
    parts documents."""
    kept = document_sentences(docs, profiles, languages, keep)
    ended = F.transform("sentences", lambda s: F.concat(s, F.lit("\n")))
    return kept.select("doc_id", F.array_join(ended, "").alias("lines"))


def sentence_scores(kept: DataFrame, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """(doc_id, pos, score): weighted PageRank over the sentences of each document.

    The weight of the edge i -> j is the BM25 score of sentence j for the words of sentence i, within the
    document (idf below zero replaced by a quarter of the average idf, and never negative). The sum over
    edges factors through the shared words, so each round adds up once per word and once per sentence
    and no sentence pairs are built. A document is one row, so there is no shuffle and no sort: words are
    numbered once per batch and every round is a few sums over numbers.
    """

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sentences = batch.column("tokens").flatten()
            sizes = batch.column("tokens").value_lengths().to_numpy(zero_copy_only=False)
            doc_of = np.repeat(np.arange(batch.num_rows), sizes)  # of a sentence
            length = sentences.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)
            words = sentences.flatten().dictionary_encode()
            n_words, total = max(1, len(words.dictionary)), len(doc_of)
            entry, tf = np.unique(
                np.repeat(np.arange(total), length.astype(np.int64)) * n_words + words.indices.to_numpy(), return_counts=True
            )
            sentence, doc = entry // n_words, doc_of[entry // n_words]
            pair, word = np.unique(doc * n_words + entry % n_words, return_inverse=True)  # words of documents
            owner, df = pair // n_words, np.bincount(word, minlength=len(pair))
            raw = np.log(sizes[owner] - df + 0.5) - np.log(df + 0.5)
            mean = np.bincount(owner, raw, batch.num_rows) / np.maximum(np.bincount(owner, minlength=batch.num_rows), 1)
            idf = np.maximum(np.where(raw < 0, 0.25 * mean[owner], raw), 0.0)
            average = np.bincount(doc_of, length, batch.num_rows) / np.maximum(sizes, 1)
            asks = tf * idf[word]
            gives = tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length[sentence] / average[doc]))
            offered = np.bincount(word, gives, len(pair))[word] - gives
            outgoing = np.bincount(sentence, asks * offered, total)[sentence]
            share = np.where(outgoing > 0, asks / np.where(outgoing > 0, outgoing, 1.0), 0.0)
            score = np.ones(total)
            for _ in range(iterations):
                sent = share * score[sentence]
                received = gives * (np.bincount(word, sent, len(pair))[word] - sent)
                score = 1 - damping + damping * np.bincount(sentence, received, total)
            pos = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            columns = [batch.column("doc_id").take(pa.array(doc_of)), pa.array(pos, pa.int32()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "pos", "score"])

    tokens = kept.select("doc_id", F.transform("sentences", term_tokens).alias("tokens"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    return tokens.mapInArrow(rate, f"doc_id {kind}, pos INT, score DOUBLE")


def summarize(kept: DataFrame, words: int = SUMMARY_WORDS, iterations: int = 10) -> DataFrame:
    """(doc_id, summary): the best sentences, in text order, as long as each brings the length closer to
    ``words``; the whole cleaned text when no sentence fits.

    ``kept`` is the result of ``document_sentences``.
    """
    kept = materialise(kept)  # read by the scores, the lengths and the result; cleaned once
    scores = sentence_scores(kept, iterations)
    lengths = kept.select(
        "doc_id", F.posexplode(F.transform("sentences", word_count)).alias("pos", "words")
    )
    best_first = Window.partitionBy("doc_id").orderBy(F.round("score", 6).desc(), F.col("pos"))
    frame = best_first.rowsBetween(Window.unboundedPreceding, 0)
    ranked = scores.join(lengths, ["doc_id", "pos"]).withColumn("upto", F.sum("words").over(frame))
    closer = F.abs(F.lit(words) - F.col("upto")) <= F.abs(F.lit(words) - (F.col("upto") - F.col("words")))
    taken = ranked.withColumn("fits", F.min(closer).over(frame)).filter("fits")
    positions = taken.groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("_taken"))
    summary = F.array_join(F.transform("_taken", lambda p: F.element_at("sentences", p + 1)), " ")
    whole = F.array_join("sentences", " ")
    return kept.join(positions, "doc_id", "left").select(
        "doc_id", F.coalesce(F.when(F.length(summary) > 0, summary), whole).alias("summary")
    )


def tokenize_terms(docs: DataFrame) -> DataFrame:
    """(doc_id, term): one row per token."""
    return docs.select("doc_id", F.explode(term_tokens(F.col("text"))).alias("term"))


def stem_vocabulary(
    terms: DataFrame, stemmer: Callable[[DataFrame], DataFrame] = porter_vocabulary
) -> DataFrame:
    """(term, stem) for every distinct term; each word is stemmed once for the whole corpus."""
    return stemmer(terms.select("term").distinct()).select("term", "stem")


def stem_terms(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, term, tf) with terms replaced by their stems and counts of equal stems added up.

    ``counts`` holds one row per document and term; give a written table. Its rows are not shuffled: blocks of whole documents
    get the stems of their terms (``blocks``), and equal stems meet within a block.
    """
    kinds = {c: counts.schema[c].dataType.simpleString() for c in ("doc_id", "tf")}

    def add(block: Block, found: pa.Table) -> pa.Table:
        entry, place = block.joined(found)
        number, stems = numbered(found["stem"])
        keys, of_key = np.unique(block.rows[entry] * max(len(stems), 1) + number[place], return_inverse=True)
        tf, known = block.values[entry], ~np.isnan(block.values[entry])
        total, n = (np.bincount(of_key, x, len(keys)) for x in (np.where(known, tf, 0.0), known))
        row, stem = np.divmod(keys, max(len(stems), 1))
        columns = [block.documents.take(pa.array(row)), stems.take(pa.array(stem))]
        return pa.table([*columns, doubles(np.where(n > 0, total, np.nan))], names=["doc_id", "term", "tf"])

    terms = vocabulary.select("term", "stem")
    stemmed = with_terms(whole_blocks(counts, "tf"), terms, row_parts(counts), add, f"doc_id {kinds['doc_id']}, term STRING, tf DOUBLE")
    return stemmed.select("doc_id", "term", F.col("tf").cast("double" if kinds["tf"] in ("float", "double") else "bigint"))
