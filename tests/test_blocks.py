"""Rows by document and term are worked on in blocks of whole documents: same rows, and none is shuffled by term."""

import math
import os

import pytest

from docketry import session
from docketry.operators import blocks, represent, score, text


def _counts(spark, tmp_path, apart):
    """(doc_id, term, tf), written; with ``apart`` the rows of a document stand in several files."""
    words = ["cat", "cats", "run", "running", "the", "dog", "dogs"]
    rows = [(None if d == 5 else d, words[(d * 3 + i) % 7], i + 1) for d in range(40) for i in range(5)]
    rows += [(d, None, 9) for d in (1, 2)]
    frame = spark.createDataFrame(rows, "doc_id long, term string, tf long")
    frame = frame.repartition(6, "term") if apart else frame.repartition(6, "doc_id")
    frame.write.parquet(f"{tmp_path}/counts")
    return rows, spark.read.parquet(f"{tmp_path}/counts")


def _weights(rows, n):
    df = {}
    for _, t, _ in rows:
        df[t] = df.get(t, 0) + 1
    w = {(d, t): tf * (math.log((1 + n) / (1 + df[t])) + 1) for d, t, tf in rows if t}
    size = {}
    for (d, _), x in w.items():
        size[d] = size.get(d, 0) + x * x
    return {(d, t): x / math.sqrt(size[d]) for (d, t), x in w.items()}


@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("most", [7, 1 << 19])
def test_weights_and_stems_come_to_the_rows(spark, tmp_path, monkeypatch, apart, most):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", most)
    rows, counts = _counts(spark, tmp_path, apart)
    docs = spark.range(40).withColumnRenamed("id", "doc_id")
    found = represent.tfidf(counts, docs, 1, 1.0)
    assert {(r.doc_id, r.term): r.value for r in found.collect()} == pytest.approx(_weights(rows, 40))
    assert sorted(map(str, represent.bow(counts, docs, 1, 1.0).collect())) == sorted(
        f"Row(doc_id={d}, term='{t}', tf={tf})" for d, t, tf in rows if t
    )
    stems = {"cat": "cat", "cats": "cat", "run": "run", "running": "run", "dog": None, "dogs": None}
    wanted = {}
    for d, t, tf in rows:
        if t in stems:
            wanted[d, stems[t]] = wanted.get((d, stems[t]), 0) + tf
    made = text.stem_terms(counts, spark.createDataFrame(list(stems.items()), "term string, stem string"))
    assert {(r.doc_id, r.term): r.tf for r in made.collect()} == wanted and made.count() == len(wanted)
    assert "Window" not in found._jdf.queryExecution().toString()


def test_rows_are_read_once_by_the_weights_and_not_sorted_by_term(spark, tmp_path):
    _, counts = _counts(spark, tmp_path, False)
    plan = represent.tfidf(counts, spark.range(40), 1, 1.0)._jdf.queryExecution().executedPlan().toString()
    reads = [line for line in plan.splitlines() if "FileScan" in line and f"{tmp_path}/counts"[:20] in line and "tf#" in line.split("Batched")[0]]
    assert len(reads) <= 1  # the vocabulary's; rows come from their blocks
    assert "tf#" not in "".join(line for line in plan.splitlines() if "hashpartitioning(term" in line)


def test_documents_become_rows(spark, tmp_path, monkeypatch):
    for apart in (False, True):
        rows, counts = _counts(spark, f"{tmp_path}/{apart}", apart)
        monkeypatch.setattr(blocks, "HELD_ROWS", 3)
        made = {r.doc_id: sorted(zip(r.terms, r.values), key=str) for r in blocks.document_rows(counts, "tf").collect()}
        wanted = {}
        for d, t, tf in rows:
            wanted.setdefault(d, []).append((t, tf))
        assert made == {d: sorted(v, key=str) for d, v in wanted.items()}


def test_settled_tables_delete_what_only_they_read(spark):
    first, second = (session.materialise(spark.range(n), "settled") for n in (5, 7))
    path = {n: session.folders(t).copy().pop().removeprefix("file:") for n, t in ((1, first), (2, second))}
    both = session.settled(first.union(second), second)
    assert both.count() == 12 and second.count() == 7
    assert not os.path.exists(path[1]) and os.path.exists(path[2])


def test_cosines_and_bm25_keep_few_tables_and_move_no_row_by_term(spark, tmp_path, monkeypatch):
    """In slices as in one; rows of documents apart or together; afterwards only the scores are left."""
    monkeypatch.setattr(score, "SLICE_ROWS", 20)
    for apart in (False, True):
        rows, counts = _counts(spark, f"{tmp_path}/{apart}", apart)
        counts = counts.filter("term IS NOT NULL")
        pairs = spark.createDataFrame([(d // 10 * 10, d, d % 2) for d in range(42)] + [(None, 3, 0), (0, None, 1)], "case_id long, candidate_id long, rel int")
        vectors = {}
        for d, t, tf in rows:
            if t:
                vectors.setdefault(d, {})[t] = tf
        before = set(os.listdir(session.shared_folder(spark)))
        found = score.sparse_cosine_rank(pairs, counts, "tf")
        left = set(os.listdir(session.shared_folder(spark))) - before
        assert found.count() == 44 and all(name.startswith("scores") for name in left)
        for r in found.collect():
            a, b = vectors.get(r.case_id, {}), vectors.get(r.candidate_id, {})
            if r.case_id is None or r.candidate_id is None:
                a = {}
            dot = sum(x * b.get(t, 0) for t, x in a.items())
            size = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
            assert r.score == pytest.approx(dot / size if size else 0.0)
        plan = score.bm25_rank(pairs, counts)._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "hashpartitioning" in x and "term#" in x]
