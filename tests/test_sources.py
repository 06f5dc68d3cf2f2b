"""Readers and writers on small files."""

import os

import pytest
from pyspark.sql import functions as F

from docketry.sources import lines, tables, xml

TASK = """<?xml version="1.0"?>
<cases task="1">
<instance id="001">
  <query>001/base.txt</query>
  <cases_noticed>003,010</cases_noticed>
  <candidate_cases>
    <candidate_case id="003">003.txt</candidate_case>
    <candidate_case id="004">004.txt</candidate_case>
  </candidate_cases>
</instance>
<instance id="002">
  <query>002/base.txt</query>
  <candidate_cases>
    <candidate_case id="010">010.txt</candidate_case>
  </candidate_cases>
</instance>
</cases>
"""


@pytest.fixture
def task(tmp_path):
    root = tmp_path / "root dir"
    files = {
        "001/base.txt": "first\nquery", "002/base.txt": "second query",
        "001/candidates/003.txt": "text 003", "001/candidates/004.txt": "text, \"004\"\n",
        "002/candidates/010.txt": "text 010",
    }
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    (tmp_path / "task.xml").write_text(TASK)
    return str(tmp_path / "task.xml"), str(root)


def test_task_xml_with_text_files(spark, task):
    rows = sorted(map(tuple, xml.read_task_xml(spark, *task).collect()))
    assert rows == [
        ("001", "first\nquery", "003", "text 003", True),
        ("001", "first\nquery", "004", "text, \"004\"\n", False),
        ("002", "second query", "010", "text 010", False),
    ]


def test_task_stats(spark, task):
    stats = xml.task_stats(xml.read_instances(spark, task[0]))
    assert sorted(map(tuple, stats.collect())) == [("001", 2, 2), ("002", 0, 1)]


def test_entailment_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<dataset><pair id='H1' label='Y'><t1>A law\nin lines</t1><t2>A claim</t2></pair>"
        "<pair id='H2' label='N'><t1>B &amp; C</t1><t2>D\nE</t2></pair></dataset>"
    )
    rows = sorted(map(tuple, xml.read_entailment_xml(spark, str(tmp_path / "*.xml")).collect()))
    assert rows == [("H1", "A law in lines", "A claim", 1), ("H2", "B & C", "D E", 0)]


def test_pairs_keep_newlines_quotes_and_column_order(spark, tmp_path):
    data = [(1, "a\n\"b\", c", 2, "", True), (1, "a\n\"b\", c", 3, "x", False)]
    df = spark.createDataFrame(data, tables.PAIRS).select(
        "candidate_id", "case_id", F.lit("more").alias("extra"), "case_text", "candidate_text", "candidate_is_noticed"
    )
    tables.write_table(df, str(tmp_path / "pairs"))
    assert sorted(map(tuple, tables.read_pairs(spark, str(tmp_path / "pairs")).collect())) == data


def test_scores_ids_and_judgments(spark, tmp_path):
    (tmp_path / "scores.csv").write_text("case_id,candidate_id,score\n1,2,0.25\n1,3,1e-05\n")
    (tmp_path / "ids.csv").write_text("1\n7\n")
    (tmp_path / "qrels").write_text("1\tT\t3\t1\n")
    run = tables.read_scores(spark, str(tmp_path / "scores.csv"))
    assert sorted(map(tuple, run.collect())) == [(1, 2, 0.25), (1, 3, 1e-05)]
    assert [r.case_id for r in tables.read_case_ids(spark, str(tmp_path / "ids.csv")).collect()] == [1, 7]
    judged = tables.judge(run, tables.read_qrels(spark, str(tmp_path / "qrels")))
    assert sorted((r.candidate_id, r.rel) for r in judged.collect()) == [(2, 0), (3, 1)]


def test_ltr_lines_keep_every_line_and_the_candidate_apart(spark, tmp_path):
    (tmp_path / "x.libsvm").write_text(
        "1 qid:10 1:0.5 2:-1.25 cid:7\n0 qid:10 2:3.0 cid:8\n0 qid:11 1:1.0\n"
    )
    rows = lines.read_libsvm_ltr(spark, str(tmp_path / "x.libsvm")).orderBy("qid", "candidate_id").collect()
    assert [(r.qid, r.candidate_id, r.label, r.features) for r in rows] == [
        (10, 7, 1.0, {1: 0.5, 2: -1.25}), (10, 8, 0.0, {2: 3.0}), (11, None, 0.0, {1: 1.0}),
    ]
    dense = spark.createDataFrame([({2: 3.0},)], "f MAP<INT, DOUBLE>").select(lines.dense_features(F.col("f"), 3))
    assert dense.first()[0] == [0.0, 3.0, 0.0]


def test_ltr_round_trip(spark, tmp_path):
    pairs = spark.createDataFrame(
        [(2, 5, 1, [0.5, -2.0]), (1, 9, 0, [1.0, 0.0])], "case_id BIGINT, candidate_id BIGINT, rel INT, features ARRAY<DOUBLE>"
    )
    path = str(tmp_path / "ltr")
    lines.write_libsvm_ltr(pairs, path)
    text = "".join(open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.startswith("part-"))
    assert text == "0 qid:1 1:1.0 2:0.0 cid:9\n1 qid:2 1:0.5 2:-2.0 cid:5\n"


def test_submission_order_and_cuts(spark, tmp_path):
    run = spark.createDataFrame(
        [(7, 1, 0.2), (7, 2, 0.9), (3, 5, 0.5), (3, 6, 0.5)], "case_id BIGINT, candidate_id BIGINT, score DOUBLE"
    )
    path = str(tmp_path / "sub")
    lines.write_submission(lines.submission_lines(run, "BEST", score_cut=0.2), path)
    text = "".join(open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.startswith("part-"))
    assert text == "003 005 BEST\n003 006 BEST\n007 002 BEST\n"
    ranked = lines.submission_lines(run, "BEST", rank_cut=1).collect()
    assert {r.line for r in ranked} == {"003 005 BEST", "007 002 BEST"}
    with pytest.raises(ValueError):
        lines.submission_lines(run, "BEST")


def test_sentence_corpus_ends_documents_with_an_empty_line(spark, tmp_path):
    corpus = spark.createDataFrame([("one\ntwo\n",), ("",)], "lines STRING").coalesce(1)
    path = str(tmp_path / "corpus")
    lines.write_sentences(corpus, path)
    text = "".join(open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.startswith("part-"))
    assert sorted(text.split("\n\n")) == sorted(["one\ntwo", "\n"]) or text in ("one\ntwo\n\n\n", "\none\ntwo\n\n")


@pytest.mark.parametrize("style", ["plain", "uri", "relative"])
def test_text_files_of_a_task(spark, tmp_path, monkeypatch, style):
    names = {"q+1.txt": "query\ntext", "7/candidates/a b.txt": "one", "7/candidates/ü%.txt": "two"}
    for name, value in names.items():
        (tmp_path / "root" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / name).write_text(value)
    root = {"plain": f"{tmp_path}/root/", "uri": f"file://{tmp_path}/root", "relative": os.path.relpath(f"{tmp_path}/root")}[style]
    assert {r.path: r.text for r in xml.read_text_files(spark, root).collect()} == names
    instance = (
        "<cases><instance id='7'><query>q+1.txt</query><cases_noticed>2</cases_noticed><candidate_cases>"
        "<candidate_case id='1'>a b.txt</candidate_case><candidate_case id='2'>ü%.txt</candidate_case>"
        "</candidate_cases></instance></cases>"
    )
    (tmp_path / "task.xml").write_text(instance)
    found = xml.read_task_xml(spark, str(tmp_path / "task.xml"), root).collect()
    assert {(r.candidate_id, r.case_text, r.candidate_text, r.candidate_is_noticed) for r in found} == {
        ("1", "query\ntext", "one", False),
        ("2", "query\ntext", "two", True),
    }


def test_a_missing_text_is_an_error(spark, tmp_path):
    (tmp_path / "root").mkdir()
    (tmp_path / "root" / "q.txt").write_text("x")
    instance = "<cases><instance id='7'><query>q.txt</query><candidate_cases><candidate_case id='1'>a.txt</candidate_case></candidate_cases></instance></cases>"
    (tmp_path / "task.xml").write_text(instance)
    with pytest.raises(Exception, match="no text file 7/candidates/a.txt"):
        xml.read_task_xml(spark, str(tmp_path / "task.xml"), str(tmp_path / "root")).collect()
