"""Groups of spelling variants by a dictionary of trie-node pairs.

The vocabulary's prefixes are the nodes of a trie, its suffixes the nodes of a trie of reversed words. Both are
numbered. A word cut at a place is then a pair of integers, (prefix node, suffix node): cut between two characters
it says what an inserted character would split, with a character skipped it says what a deleted or replaced one
would leave. Two words differ by one replaced character exactly if they have a pair with one skipped character in
common, and by one inserted character exactly if a skip pair of the longer is a split pair of the shorter. So all
neighbours come from one grouping by pairs of integers, whatever the words' lengths.

A pair with a skipped character stands for at most as many words as there are letters (90 in the words of
``count_words``), and a split pair for one word, so no group can grow with the vocabulary.

Nodes are numbered without a string longer than a word ever being shuffled: words are sorted in ranges, a task
numbers the nodes of its range from the letters two neighbouring words share, and one row per range (its first and
last word) tells the next range which of its nodes it has in common with the last one. That row is all that reaches
the driver.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docketry.llm.common import documents, in_order
from docketry.session import materialise

#: Words have at least so many characters and occurrences; a form has so many times its variant's occurrences.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
LETTERS = r"a-zÀ-ÿ"


def without(word: Column, place: Column) -> Column:
    """The word without its code point at ``place`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.char_length(word)))


def count_words(
    docs: DataFrame, modulus: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT
) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z as a-z, that are long and frequent enough.

    With ``modulus``, a run loses one code point wherever the crc32 of ``<doc_id>:<run>`` is divisible by it, which
    plants misspellings at places that are the same in every run; a null doc_id counts as the empty text. Null and
    empty texts have no words. Counting is combined before the shuffle, so a frequent word is no hot key.
    """
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    # a shorter run can't become a word, and a run that is long enough is matched from its first letter to its last
    runs = F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    words = documents(docs).select("doc_id", F.explode(runs).alias("word"))
    if modulus:
        key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "word")
        words = words.withColumn("_h", F.crc32(key.cast("binary")))
        cut = without(F.col("word"), (F.col("_h") % F.char_length("word")).cast("int"))
        words = words.select(F.when(F.col("_h") % modulus == 0, cut).otherwise(F.col("word")).alias("word"))
    long_enough = words.filter(F.char_length("word") >= least_length)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def shared(a: str, b: str) -> int:
    """Characters that two words have in common at their starts."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def number_range(rows: pa.Table) -> pa.Table:
    """The words of a range in order, each with its path: the numbers of its prefixes' nodes from 1 on."""
    words = sorted(rows["word"].to_pylist())
    paths, path, before, nodes = [], [], "", 0
    for word in words:
        kept = shared(before, word)
        path = path[:kept] + list(range(nodes + 1, nodes + 1 + len(word) - kept))
        nodes += len(word) - kept
        paths.append(np.array(path, np.int64))
        before = word
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(paths) if paths else [], pa.int64()))
    return pa.table([pa.array(words, pa.string()), rows["_range"].slice(0, len(words)), lists], names=["word", "_range", "path"])


def joined_ranges(ends: list[tuple[int, str, str, list[int]]]) -> list[tuple[int, int, list[int]]]:
    """(range, shift, carried) of each range from (range, first word, last word, path of the last word).

    A range's nodes up to number len(carried) are nodes of earlier ranges, the others are new: number + shift.
    """
    out, total, before, path = [], 0, "", []
    for number, first, last, own in ends:
        carried = path[: shared(before, first)]
        shift = total - len(carried)
        out.append((number, shift, carried))
        path = [carried[x - 1] if x <= len(carried) else x + shift for x in own]
        total, before = shift + own[-1], last
    return out


def trie_paths(words: DataFrame) -> DataFrame:
    """(word, path): per distinct word the numbers of the trie nodes of its prefixes, shortest first.

    Equal prefixes have equal numbers in the whole table, different ones have different numbers. A word's last
    number is its own, and these ascend in code-point order. The empty prefix has no number (0 is free for it). No
    word is empty or null.
    """
    spark = words.sparkSession
    ranges = in_order(words.select("word"), "word", name="sorted_words")
    kind = "word string, _range int, path array<long>"
    local = materialise(ranges.groupBy("_range").applyInArrow(number_range, kind), "trie")
    ends = local.groupBy("_range").agg(F.min("word"), F.max("word"), F.max_by("path", "word")).orderBy("_range").collect()
    numbers = joined_ranges([tuple(r) for r in ends])  # one row per range
    known = spark.createDataFrame(numbers, "_range int, shift long, carried array<long>")
    earlier = F.size("carried")
    path = F.transform("path", lambda x: F.when(x <= earlier, F.get("carried", (x - 1).cast("int"))).otherwise(x + F.col("shift")))
    return local.join(F.broadcast(known), "_range").select("word", path.alias("path"))


def node_pairs(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, word, n, ...) of every word, and (prefix, suffix, key, n, skips, first) of every cut of every word.

    ``prefix`` and ``suffix`` are node numbers. ``key`` is the word's own number. ``skips`` tells cuts that leave a character out from cuts between characters.
    Leaving out any of several equal characters in a row leaves the same word; only the first of them is ``first``.
    """
    forward = trie_paths(words)
    backward = trie_paths(words.select(F.reverse("word").alias("word"))).select(F.reverse("word").alias("word"), F.col("path").alias("back"))
    numbered = words.join(forward, "word").join(backward, "word").select(
        F.element_at("path", -1).alias("key"),
        "word",
        "n",
        F.concat(F.array(F.lit(0).cast("long")), "path").alias("p"),
        F.concat(F.array(F.lit(0).cast("long")), "back").alias("s"),
        F.split("word", "").alias("letters"),
    )
    numbered = materialise(numbered, "numbered_words")
    last = F.size("p") - 1

    def skip(i: Column) -> Column:
        first = (i == 0) | (F.get("letters", i) != F.get("letters", i - 1))
        return F.struct(F.get("p", i).alias("prefix"), F.get("s", last - 1 - i).alias("suffix"), F.lit(True).alias("skips"), first.alias("first"))

    def split(i: Column) -> Column:
        return F.struct(F.get("p", i).alias("prefix"), F.get("s", last - i).alias("suffix"), F.lit(False).alias("skips"), F.lit(True).alias("first"))

    cuts = F.concat(F.transform(F.sequence(F.lit(0), last - 1), skip), F.transform(F.sequence(F.lit(0), last), split))
    return numbered, numbered.select("key", "n", F.explode(cuts).alias("cut")).select("cut.prefix", "cut.suffix", "key", "n", "cut.skips", "cut.first")


def neighbours(pairs: DataFrame) -> DataFrame:
    """(key, n_near, best): per word with a near word their number and the most frequent, as (-n, key).

    Each two near words meet under exactly one pair, so counts are sums. A group emits a row per word, not per two.
    """
    member = F.struct((-F.col("n")).alias("minus_n"), "key", "skips", "first")
    groups = pairs.groupBy("prefix", "suffix").agg(F.sort_array(F.collect_list(member)).alias("words")).filter(F.size("words") > 1)

    def near(x: Column, y: Column) -> Column:
        return (x["key"] != y["key"]) & ((x["skips"] & y["skips"]) | ((x["skips"] != y["skips"]) & x["first"] & y["first"]))

    def found(x: Column) -> Column:
        others = F.filter("words", lambda y: near(x, y))
        return F.struct(x["key"].alias("key"), F.size(others).cast("long").alias("n_near"), F.get(F.transform(others, lambda y: F.struct(y["minus_n"], y["key"])), F.lit(0)).alias("best"))

    each = groups.select(F.explode(F.filter(F.transform("words", found), lambda x: x["n_near"] > 0)).alias("x")).select("x.*")
    return each.groupBy("key").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(key, root): where a chain of forms ends, by doubling the steps until none is left.

    A form is several times more frequent than its variant, so chains are as short as the logarithm of the counts.
    """
    state = materialise(forms.select("key", F.col("form").alias("root")), "forms")
    while True:
        further = state.select(F.col("key").alias("root"), F.col("root").alias("_next"))
        joined = materialise(state.join(further, "root", "left").select("key", F.coalesce("_next", "root").alias("root"), "_next"), "forms")
        state = joined.select("key", "root")
        if joined.filter(F.col("_next").isNotNull()).isEmpty():
            return state


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n) of distinct words.

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its most frequent
    near word (ties: the smallest in code-point order) if that is at least ``ratio`` times as frequent; ``root`` is the
    end of the chain of forms. Null and empty words take no part. An empty vocabulary gives an empty result.
    """
    words = materialise(words.select("word", "n").filter("word <> ''"), "words")
    numbered, pairs = node_pairs(words)
    near = materialise(neighbours(pairs), "near_words")
    names = numbered.select("key", "word")
    own = numbered.select("key", "word", "n").join(near, "key", "left")
    is_form = -F.col("best.minus_n") >= ratio * F.col("n")
    own = materialise(own.select("key", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.key")).alias("form"), F.when(is_form, -F.col("best.minus_n")).alias("form_n")), "word_forms")
    ends = roots(own.filter(F.col("form").isNotNull()))
    named = own.filter(F.col("form").isNotNull()).join(ends, "key")
    named = named.join(names.select(F.col("key").alias("form"), F.col("word").alias("form_word")), "form")
    named = named.join(names.select(F.col("key").alias("root"), F.col("word").alias("root_word")), "root")
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    with_form = named.select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n")
    alone = own.filter(F.col("form").isNull()).select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return with_form.unionByName(alone).select(columns)
