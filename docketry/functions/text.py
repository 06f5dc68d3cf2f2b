"""Text expressions. All of them are built-in functions and stay inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

SENTENCE_MARK = "\u0001"
MIN_SENTENCE_WORDS = 5
# Everything but letters, of any script, counts as a blank for language profiles.
NON_LETTERS = r"[^\p{L}]+"


def clean_whitespace(text: Column) -> Column:
    """Newlines become blanks, runs of blanks become one blank; tabs stay."""
    return F.regexp_replace(F.translate(text, "\n", " "), " {2,}", " ")


def split_sentences(text: Column) -> Column:
    """Sentences end at ``.``, ``!`` or ``?`` followed by white space."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1" + SENTENCE_MARK)
    return F.split(marked, SENTENCE_MARK)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def long_sentences(text: Column, min_words: int = MIN_SENTENCE_WORDS) -> Column:
    """Sentences of the cleaned text with more than ``min_words`` words, in order."""
    return F.filter(split_sentences(clean_whitespace(text)), lambda s: word_count(s) > min_words)


def term_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more ASCII letters."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), F.lit(0))


def ngrams(tokens: Column, low: int = 1, high: int = 1, stop: tuple[str, ...] = ()) -> Column:
    """Runs of ``low`` to ``high`` tokens joined by blanks, after the words of ``stop`` are taken out."""
    kept = F.filter(tokens, lambda t: ~t.isin(*stop)) if stop else tokens

    def run_of(words: Column, n: int):
        return lambda place: F.array_join(F.slice(words, place, n), " ")

    def runs(words: Column) -> Column:
        parts = []
        for n in range(low, high + 1):
            places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1))
            places = F.coalesce(places, F.array().cast("array<int>"))
            parts.append(F.transform(places, run_of(words, n)))
        return F.concat(*parts)

    # as the only element of an array, so that the tokens are worked out once
    return F.element_at(F.transform(F.array(kept), runs), 1)


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by canonical decomposition."""
    pairs = []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii():
            pairs.append((chr(code), base[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


ACCENTED, UNACCENTED = _accent_table()


def strip_accents(text: Column) -> Column:
    """Replace accented Latin letters by their base letter and drop combining marks."""
    return F.regexp_replace(F.translate(text, ACCENTED, UNACCENTED), r"\p{Mn}+", "")


def bm25_tokens(text: Column) -> Column:
    """Lower-cased, accent-free runs of letters (underscore included) longer than two characters."""
    return F.regexp_extract_all(F.lower(strip_accents(text)), F.lit(r"[\p{L}_]{3,}"), F.lit(0))


def letter_words(text: Column) -> Column:
    """The lower-cased letters of a text, words separated by one blank."""
    return F.trim(F.regexp_replace(F.lower(text), NON_LETTERS, " "))


def letter_trigrams(text: Column) -> Column:
    """All overlapping trigrams of the words of a text, each word with a blank before and after it."""
    padded = F.concat(F.lit(" "), letter_words(text), F.lit(" "))
    return F.regexp_extract_all(padded, F.lit("(?=(.[^ ].))"), F.lit(1))
