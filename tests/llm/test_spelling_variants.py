"""Spelling variants against brute force: node numbers over many ranges, repeated letters, ties, chains, odd texts."""

import random
import re
import string
import zlib
from collections import Counter

import odd  # beside this file
import pytest

from docketry.llm import queries, spelling_variants
from docketry.llm.spelling_variants import joined_ranges, number_range

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def counted(rows, modulus):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(words, ratio=5):
    near = {w: [x for x in words if x != w and abs(len(x) - len(w)) < 2 and one_apart(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    rows = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(map(str, rows))


def found(df):
    return sorted(str((r.word, r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect())


def vocabulary(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


@pytest.mark.parametrize("seed,letters,least,most", [(1, "ab", 1, 6), (2, "abé×", 1, 4), (3, "aä\U0001f600", 2, 5), (4, "ab", 30, 31)])
def test_variants_against_brute_force(spark, seed, letters, least, most):
    rng = random.Random(seed)
    words = {}
    for _ in range(150):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))
        words[w] = rng.choice([1, 2, 5, 10, 26, 131, 700])
        words[w[1:] + "a"] = words[w]  # ties
    words.pop("", None)
    assert found(spelling_variants.variants(vocabulary(spark, words))) == expected(words)


def test_variants_over_many_ranges(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))): rng.randint(1, 500) for _ in range(400)}
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        paths = {r.word: r.path for r in spelling_variants.trie_paths(vocabulary(spark, words)).collect()}
        assert found(spelling_variants.variants(vocabulary(spark, words))) == expected(words)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    check_paths(paths, words)


def check_paths(paths, words):
    numbers = {}
    for w, path in paths.items():
        assert len(path) == len(w)
        for i, number in enumerate(path):
            assert numbers.setdefault(w[: i + 1], number) == number
    assert set(paths) == set(words) and len(set(numbers.values())) == len(numbers) and 0 not in numbers.values()
    assert sorted(paths, key=lambda w: paths[w][-1]) == sorted(words)


@pytest.mark.parametrize("seed", range(20))
def test_ranges_join_to_one_numbering(seed):
    import pyarrow as pa

    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    cuts = sorted(rng.sample(range(1, len(words)), rng.randint(1, 12)))
    parts = [words[a:b] for a, b in zip([0, *cuts], [*cuts, len(words)])]
    local = [number_range(pa.table({"word": p, "_range": pa.array([k] * len(p), pa.int32())})).to_pylist() for k, p in enumerate(parts)]
    joined = joined_ranges([(k, rows[0]["word"], rows[-1]["word"], rows[-1]["path"]) for k, rows in enumerate(local)])
    paths = {}
    for rows, (_, shift, carried) in zip(local, joined):
        for r in rows:
            paths[r["word"]] = [carried[x - 1] if x <= len(carried) else x + shift for x in r["path"]]
    check_paths(paths, words)


def test_counts_of_odd_texts(spark):
    rows = [(i, t) for i, t, _ in odd.ROWS for _ in range(3)]
    rows += [(k % 7, "Straße ÉCOLEŒ naïveté×÷ Größen, " + "ÀÉÎÕÜÿ" * 3 + " x" + "y" * 3000) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for modulus in (1, 3, 199):
        got = {r.word: r.n for r in spelling_variants.count_words(docs, modulus=modulus).collect()}
        assert got == counted(rows, modulus) and got
    assert found(spelling_variants.variants(spelling_variants.count_words(docs, modulus=2))) == expected(counted(rows, 2))
    assert spelling_variants.variants(spelling_variants.count_words(docs.limit(0))).count() == 0


def test_empty_and_null_words_take_no_part(spark):
    words = spark.createDataFrame([("", 3), (None, 4), ("a", 1), ("b", 9)], "word string, n long")
    assert found(spelling_variants.variants(words)) == expected({"a": 1, "b": 9})


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    words = counted(rows, 199)
    assert found(queries.op13_spelling_variants(spark, sf_dir)) == expected(words)
