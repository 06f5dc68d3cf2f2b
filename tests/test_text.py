"""Text expressions and document operators on hand texts."""

import pytest
from pyspark.sql import functions as F

from docketry.functions import text as fn
from docketry.operators import text


def one(spark, function, value):
    return spark.createDataFrame([(value,)], "t STRING").select(function(F.col("t"))).first()[0]


def test_whitespace(spark):
    assert one(spark, fn.clean_whitespace, "a\n\nb   c\td  ") == "a b c\td "


def test_sentences_and_lengths(spark):
    five, six = "One two three four five.", "One two three four five six!"
    assert one(spark, fn.split_sentences, f"{five}  {six} Rest") == [five, six, "Rest"]
    assert one(spark, fn.long_sentences, f"{five} {six}\nRest") == [six]
    assert one(spark, fn.long_sentences, "") == []


def test_tokens(spark):
    assert one(spark, fn.term_tokens, "Ab c D1ef gh-IJ") == ["ab", "ef", "gh", "ij"]
    assert one(spark, fn.bm25_tokens, "Élan état a1bcd É́a no_t") == ["elan", "etat", "bcd", "no_t"]


def test_trigrams(spark):
    assert one(spark, fn.letter_trigrams, "Ab, c!") == [" ab", "ab ", " c "]
    assert one(spark, fn.letter_trigrams, "123") == []


STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss",
    "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
    "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit",
    "radically": "radic", "differentli": "differ", "vileli": "vile", "analogousli": "analog",
    "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal",
    "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal",
    "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form",
    "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope",
    "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
    "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac",
    "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun",
    "activate": "activ", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
    "dying": "die", "died": "die", "news": "news", "by": "by", "geology": "geolog", "enjoy": "enjoy",
    "flies": "fli", "spied": "spi", "generically": "gener", "yes": "ye",
}


def test_stems(spark):
    words = spark.createDataFrame([(w,) for w in STEMS], "term STRING")
    got = {r.term: r.stem for r in text.stem_vocabulary(words).collect()}
    assert got == STEMS


def test_equal_stems_are_added_up(spark):
    counts = spark.createDataFrame([(1, "cat", 2), (1, "cats", 3), (2, "dog", 1)], "doc_id INT, term STRING, tf BIGINT")
    stemmed = text.stem_terms(counts, text.stem_vocabulary(counts))
    assert sorted(map(tuple, stemmed.collect())) == [(1, "cat", 5), (2, "dog", 1)]


ENGLISH = "The cat sat on the mat with the hat. The dog ran to the other house at night. "
FRENCH = "Le chat est sur le tapis avec un chapeau. La souris mange du fromage dans la cuisine. "


@pytest.fixture(scope="module")
def profiles(spark):
    labelled = spark.createDataFrame([(ENGLISH * 3, "en"), (FRENCH * 3, "fr")], "text STRING, lang STRING")
    return text.train_language_profiles(labelled, ["en", "fr"])


def test_only_english_sentences_stay_in_order(spark, profiles):
    docs = spark.createDataFrame(
        [(1, "The dog sat on the other mat. Le chat mange dans la cuisine. The cat ran to the house at night. 1 2 3 4 5 6 7."),
         (2, ""), (3, "1 2 3 4 5 6 7.")],
        "doc_id INT, text STRING",
    )
    got = {r.doc_id: r.clean_text for r in text.clean_text(docs, profiles, ["en", "fr"]).collect()}
    assert got == {1: "The dog sat on the other mat. The cat ran to the house at night.", 2: "", 3: ""}
    rows = docs.select("doc_id", F.posexplode(fn.long_sentences(F.col("text"))).alias("pos", "sentence"))
    found = {(r.doc_id, r.pos): r.language for r in text.detect_language(rows, profiles, ["en", "fr"]).collect()}
    assert found == {(1, 0): "en", (1, 1): "fr", (1, 2): "en", (1, 3): "non-en", (3, 0): "non-en"}


def kept(spark, sentences):
    return spark.createDataFrame([(1, sentences), (2, [])], "doc_id INT, sentences ARRAY<STRING>")


def test_summary_is_an_ordered_part_of_the_text(spark):
    sentences = [f"Sentence {w} about cats and dogs and {w} things with words" for w in "abcdefghijklmnop"]
    got = {r.doc_id: r.summary for r in text.summarize(kept(spark, sentences), words=30).collect()}
    assert got[2] == ""
    chosen = [s for s in sentences if s in got[1]]
    assert " ".join(chosen) == got[1] and 20 <= len(got[1].split()) <= 40


def test_summary_falls_back_to_the_whole_text(spark):
    long = ["word " * 80 + "end"]
    got = {r.doc_id: r.summary for r in text.summarize(kept(spark, long), words=10).collect()}
    assert got[1] == long[0]


def test_sentence_scores_equal_the_pairwise_graph(spark):
    import math
    import re
    from collections import Counter

    sentences = ["cats chase mice in the barn", "mice fear cats", "dogs bark at night loudly", "the barn has mice and cats", "night falls"]
    docs = [Counter(re.findall("[a-z]{2,}", s)) for s in sentences]
    n, avg = len(docs), sum(sum(d.values()) for d in docs) / len(docs)
    df = Counter(t for d in docs for t in d)
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: max(0.25 * mean if v < 0 else v, 0.0) for t, v in idf.items()}
    weight = [
        [0.0 if i == j else sum(
            a * idf[t] * b[t] * 2.5 / (b[t] + 1.5 * (0.25 + 0.75 * sum(b.values()) / avg)) for t, a in q.items() if t in b
        ) for j, b in enumerate(docs)] for i, q in enumerate(docs)
    ]
    score = [1.0] * n
    for _ in range(10):
        score = [
            0.15 + 0.85 * sum(score[i] * weight[i][j] / sum(weight[i]) for i in range(n) if sum(weight[i]) > 0)
            for j in range(n)
        ]
    got = {r.pos: r.score for r in text.sentence_scores(kept(spark, sentences)).collect() if r.doc_id == 1}
    assert [got[i] for i in range(n)] == pytest.approx(score)


def test_preprocessing_runs_per_document(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (2, "c  d")], "doc_id INT, text STRING")
    pairs = spark.createDataFrame([(1, 2), (2, 1)], "case_id INT, candidate_id INT")
    got = text.apply_preprocessing(pairs, docs, fn.clean_whitespace)
    assert {(r.case_id, r.case_text, r.candidate_text) for r in got.collect()} == {(1, "a b", "c d"), (2, "c d", "a b")}
    same = text.apply_preprocessing(pairs, docs, lambda c: c)
    assert {r.case_text for r in same.collect()} == {"a\nb", "c  d"}


def test_ngrams_by_hand(spark):
    rows = spark.createDataFrame([(1, ["a", "the", "b", "c"]), (2, ["a"]), (3, [])], "id INT, w ARRAY<STRING>")
    got = {r.id: r.g for r in rows.select("id", fn.ngrams(F.col("w"), 1, 3, ("the",)).alias("g")).collect()}
    assert got == {1: ["a", "b", "c", "a b", "b c", "a b c"], 2: ["a"], 3: []}


def test_published_stems(spark):
    """Word and stem pairs from the description of the algorithm, step by step."""
    pairs = {
        "caresses": "caress", "ponies": "poni", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre",
        "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
        "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss",
        "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "relational": "relat",
        "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "operator": "oper",
        "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formaliti": "formal",
        "triplicate": "triplic", "formative": "form", "formalize": "formal", "electrical": "electr", "hopeful": "hope",
        "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
        "adjustable": "adjust", "defensible": "defens", "replacement": "replac", "adjustment": "adjust",
        "dependent": "depend", "adoption": "adopt", "communism": "commun", "activate": "activ", "effective": "effect",
        "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
    }
    terms = spark.createDataFrame([(w,) for w in pairs], "term STRING")
    assert {r.term: r.stem for r in text.stem_vocabulary(terms).collect()} == pairs


def test_sentences_go_on_after_abbreviations(spark):
    lines = [f"Mr. Smith saw No. {i} of the cases. He left early with Mrs. Jones." for i in range(30)]
    lines += ["They agree, e.g. in this case. An end comes at the end. Nothing else was said by them here."] * 20
    lines += ["The cases of Jones and them end early in this case here in the end"] * 5
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)] + [(99, None), (98, ""), (97, "Ends with Mr.")], "doc_id int, text string")
    statistics = text.abbreviation_statistics(docs)
    found = {r.word for r in text.abbreviations(statistics).collect()}
    assert {"mr", "no", "mrs", "e.g"} <= found and not found & {"cases", "end", "case", "jones", "here"}
    got = {}
    for r in text.sentences(docs, text.abbreviations(statistics)).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.sentence))
    assert got[3] == [(0, "Mr. Smith saw No. 3 of the cases."), (1, "He left early with Mrs. Jones.")]
    assert [s for _, s in got[40]] == ["They agree, e.g. in this case.", "An end comes at the end.", "Nothing else was said by them here."]
    assert got[97] == [(0, "Ends with Mr.")] and got[98] == [(0, "")] and 99 not in got
    # the rule without a list stays as it was
    assert [r.sentence for r in text.sentences(docs.filter("doc_id = 3")).orderBy("pos").collect()][:2] == ["Mr.", "Smith saw No."]


def test_abbreviation_statistics_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "no period")], "doc_id int, text string")
    assert text.abbreviation_statistics(docs).count() == text.abbreviation_statistics(docs.limit(0)).count() == 0
    only = text.abbreviation_statistics(spark.createDataFrame([(1, "a. b.")], "doc_id int, text string")).collect()
    assert {(r.word, r.dotted, r.plain) for r in only} == {("a", 1, 0), ("b", 1, 0)} and all(r.score == r.score for r in only)
