"""Porter stemming as column expressions, with the common extensions of the published algorithm
(short words and irregular forms kept, ``-ied``/``-ies`` of four letters, ``-fulli`` and ``-logi``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the algorithm: letter classes and stem shapes. A "y" is a vowel after a consonant only.
CONSONANT_RUN = "[^aeiou][^aeiouy]*"
VOWEL_RUN = "[aeiouy][aeiou]*"
FIRST_VOWELS = "^([^aeiou][^aeiouy]*[aeiouy]|[aeiou])[aeiou]*"
MEASURE_ABOVE_0 = FIRST_VOWELS + CONSONANT_RUN
MEASURE_IS_1 = f"{FIRST_VOWELS}{CONSONANT_RUN}({VOWEL_RUN})?$"
MEASURE_ABOVE_1 = FIRST_VOWELS + CONSONANT_RUN + VOWEL_RUN + CONSONANT_RUN
HAS_VOWEL = "[aeiou]|[^aeiou]y"
ENDS_CVC = "([^aeiouy]|^y|[aeiou]y)[aeiouy][^aeiouwxy]$|^[aeiou][^aeiou]$"
ENDS_CONSONANT = "[^aeiouy]$|[aeiou]y$|^y$"
DOUBLE_CONSONANT = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"

# Irregular forms.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}

# Suffix and replacement, in the order in which they are tried.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"),
]
STEP_3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
    ("ness", ""),
]
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism",
    "ate", "iti", "ous", "ive", "ize",
]


def _cut(word: Column, suffix: str) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - F.lit(len(suffix)))


def _first_suffix(word: Column, rules) -> Column:
    """Apply the first rule whose suffix matches; its condition decides whether the word changes.

    ``rules`` holds (suffix, condition on the stem, new ending).
    """
    result = word
    for suffix, condition, ending in reversed(rules):
        stem = _cut(word, suffix)
        changed = F.when(condition(stem), F.concat(stem, F.lit(ending))).otherwise(word)
        result = F.when(word.endswith(suffix), changed).otherwise(result)
    return result


def _step_1a(word: Column) -> Column:
    always = lambda _: F.lit(True)
    plain = _first_suffix(
        word, [("sses", always, "ss"), ("ies", always, "i"), ("ss", always, "ss"), ("s", always, "")]
    )
    return F.when(word.endswith("ies") & (F.length(word) == 4), _cut(word, "s")).otherwise(plain)


def _restore(stem: Column) -> Column:
    """Tidy a stem that lost ``-ed`` or ``-ing``."""
    e_added = F.concat(stem, F.lit("e"))
    return (
        F.when(stem.endswith("at") | stem.endswith("bl") | stem.endswith("iz"), e_added)
        .when(stem.rlike(DOUBLE_CONSONANT), F.substring(stem, F.lit(1), F.length(stem) - 1))
        .when(stem.rlike(MEASURE_IS_1) & stem.rlike(ENDS_CVC), e_added)
        .otherwise(stem)
    )


def _step_1b(word: Column) -> Column:
    ed, ing = _cut(word, "ed"), _cut(word, "ing")
    eed = _cut(word, "eed")
    return (
        F.when(
            word.endswith("ied"),
            F.concat(_cut(word, "ied"), F.when(F.length(word) == 4, F.lit("ie")).otherwise(F.lit("i"))),
        )
        .when(word.endswith("eed"), F.when(eed.rlike(MEASURE_ABOVE_0), _cut(word, "d")).otherwise(word))
        .when(word.endswith("ed") & ed.rlike(HAS_VOWEL), _restore(ed))
        .when(word.endswith("ing") & ing.rlike(HAS_VOWEL), _restore(ing))
        .otherwise(word)
    )


def _step_1c(word: Column) -> Column:
    stem = _cut(word, "y")
    turns = word.endswith("y") & (F.length(stem) > 1) & stem.rlike(ENDS_CONSONANT)
    return F.when(turns, F.concat(stem, F.lit("i"))).otherwise(word)


def _step_2(word: Column) -> Column:
    positive = lambda stem: stem.rlike(MEASURE_ABOVE_0)
    rules = [(suffix, positive, ending) for suffix, ending in STEP_2]
    # "-logi" looks at the stem with its "l" still on
    rules.append(("logi", lambda stem: F.concat(stem, F.lit("l")).rlike(MEASURE_ABOVE_0), "log"))
    once = _first_suffix(word, rules)
    # "-alli" becomes "-al" and is then looked at again
    shorter = F.concat(_cut(word, "alli"), F.lit("al"))
    again = word.endswith("alli") & _cut(word, "alli").rlike(MEASURE_ABOVE_0)
    return F.when(again, _first_suffix(shorter, rules)).otherwise(once)


def _step_3(word: Column) -> Column:
    positive = lambda stem: stem.rlike(MEASURE_ABOVE_0)
    return _first_suffix(word, [(suffix, positive, ending) for suffix, ending in STEP_3])


def _step_4(word: Column) -> Column:
    long_stem = lambda stem: stem.rlike(MEASURE_ABOVE_1)
    rules = [(suffix, long_stem, "") for suffix in STEP_4]
    ion = ("ion", lambda stem: stem.rlike(MEASURE_ABOVE_1) & stem.rlike("[st]$"), "")
    rules.insert(STEP_4.index("ou"), ion)
    return _first_suffix(word, rules)


def _step_5a(word: Column) -> Column:
    stem = _cut(word, "e")
    drops = stem.rlike(MEASURE_ABOVE_1) | (stem.rlike(MEASURE_IS_1) & ~stem.rlike(ENDS_CVC))
    return F.when(word.endswith("e") & drops, stem).otherwise(word)


def _step_5b(word: Column) -> Column:
    stem = _cut(word, "l")
    return F.when(word.endswith("ll") & stem.rlike(MEASURE_ABOVE_1), stem).otherwise(word)


STEPS = [_step_1a, _step_1b, _step_1c, _step_2, _step_3, _step_4, _step_5a, _step_5b]


def porter_vocabulary(words: DataFrame, word: str = "term", stem: str = "stem") -> DataFrame:
    """Add the stem of every (lower-case) word; meant for a table of distinct words."""
    out = words.withColumn(stem, F.col(word))
    for step in STEPS:
        out = out.withColumn(stem, step(F.col(stem)))
    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    kept = F.when(F.length(word) <= 2, F.col(word))
    return out.withColumn(stem, F.coalesce(F.element_at(irregular, F.col(word)), kept, F.col(stem)))
