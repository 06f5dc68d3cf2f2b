"""Every operator on odd rows and on an empty table: nothing crashes, every row has its result."""

import math

import odd  # beside this file
import pytest

from docketry.llm import (
    bit_planes,
    context_mixing,
    count_transducer,
    license_rules,
    one_permutation,
    prefix_bpe,
    quality_neighbours,
    simhash,
    source_mixing,
    top_products,
)
from docketry.session import new_path

IDS = sorted((str(r[0]) for r in odd.ROWS))


def token_file(docs):
    folder = new_path(docs.sparkSession, "odd")
    bit_planes.write(docs, folder)
    return bit_planes.read(docs.sparkSession, folder)


def quality(docs):
    labels = docs.sparkSession.createDataFrame(
        [(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (8, 0), (99, 1)], "doc_id long, quality int"
    )
    return quality_neighbours.score(docs, quality_neighbours.fit(docs, labels))


OPERATORS = {
    "context_mixing": context_mixing.score,
    "bit_planes": token_file,
    "simhash": simhash.groups,
    "quality": quality,
    "one_permutation": one_permutation.compare_edits,
    "count_transducer": count_transducer.token_counts,
    "license_rules": lambda docs: license_rules.summary(license_rules.scan(docs)),
    "prefix_bpe": prefix_bpe.encode_decode,
    "source_mixing": source_mixing.mix,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, name):
    rows = OPERATORS[name](odd.documents(spark)).collect()
    assert sorted(str(r.doc_id) for r in rows) == IDS
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    if name == "context_mixing":
        assert by_id[2][0].n_tokens == by_id[3][0].n_tokens == by_id[4][0].n_tokens == 1
        assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
        assert by_id[1][0].score == by_id[5][0].score
    if name == "bit_planes":
        assert [r.n_tokens for r in by_id[2]] == [1] and by_id[None][0].start == 0
    if name == "simhash":
        assert by_id[1][0].component_id == by_id[5][0].component_id == by_id[5][1].component_id == 1
        assert by_id[2][0].fingerprint == by_id[4][0].fingerprint == "0" * 16
        assert by_id[2][0].component_id == by_id[3][0].component_id == by_id[4][0].component_id == 2
    if name == "quality":
        assert all(0 <= r.score <= 1 for r in rows)
    if name == "one_permutation":
        assert by_id[2][0].fingerprint == "" and by_id[1][0].fingerprint == by_id[5][0].fingerprint
    if name == "count_transducer":
        assert (by_id[2][0].n_bytes, by_id[2][0].n_tokens) == (0, 0) and by_id[6][0].over_limit
    if name == "source_mixing":
        assert all(r.copies == 0 for r in rows if r.size == 0) and all(0 <= r.copies <= 3 for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_an_empty_result(spark, name):
    assert OPERATORS[name](odd.documents(spark, [])).count() == 0


def test_groups_keep_one_document_and_all_columns(spark):
    docs = odd.documents(spark)
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "None", "6", "7", "8"])
    assert simhash.one_of_each_group(docs.limit(0)).count() == 0


def test_mixed_documents_are_those_taken(spark):
    docs = odd.documents(spark)
    mixed = source_mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = sum(len((r.text or "").split()) for r in docs.collect())
    taken = sum(len(r.text.split()) for r in mixed.collect())
    assert taken > 0 and taken <= 3 * words
    assert source_mixing.mixed_documents(docs.limit(0)).count() == 0


def test_a_null_id_and_the_text_null_are_two_units(spark):
    rows = [(None, "a b c"), ("null", "a b c"), ("3", "d e f g")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id string, text string, source string")
    assert sorted(str(r.doc_id) for r in source_mixing.mix(docs).collect()) == ["3", "None", "null"]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (None, [1.0, 1.0]), (6, [2.0]), (7, []), (20, [0.1, -0.1]), (1, [1.0, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_products.top_products(vectors).collect())
    usable = [(0, (64, 32)), (1, (64, 32)), (1, (64, 32)), (6, (128, 0)), (7, (0, 0)), (20, (6, -7))]
    wanted = []
    for q, x in usable:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in usable if i != q)
            wanted += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert found == wanted
    assert top_products.top_products(vectors.limit(0)).count() == 0
