"""A task's share must not grow with the input: partitions follow the rows, and results stay the same."""

import numpy as np
import pyarrow as pa

from docketry import session
from docketry.operators import neighbours, represent, text
from docketry.plans import represent as plans


def _texts(spark, tmp_path, copies=40):
    rows = [(i, f"alpha beta beta gamma{'xyzuvw'[i % 6]} delta") for i in range(copies)]
    rows += [(None, "alpha alpha"), (None, "beta"), (3, "alpha"), (copies, None), (copies + 1, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return rows


def test_texts_are_dealt_by_their_size(spark, tmp_path, monkeypatch):
    rows = _texts(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(session, "PART_BYTES", 50)
    size = sum(len(text or "") for _, text in rows)
    dealt = session.dealt_texts(docs)
    assert dealt.rdd.getNumPartitions() == -(-size // 50)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, docs.collect()))
    assert session.dealt_texts(docs.limit(0)).count() == 0


def test_term_counts_take_more_tasks_for_more_text(spark, tmp_path, monkeypatch):
    _texts(spark, tmp_path)
    monkeypatch.setattr(session, "PART_BYTES", 50)
    seen = []
    monkeypatch.setattr(plans, "materialise", lambda df: seen.append(df) or df)
    counts = {(r.doc_id, r.term): r.tf for r in plans.counts(spark, str(tmp_path)).collect()}
    assert seen[0].rdd.getNumPartitions() > 20
    assert counts[(None, "alpha")] == 2 and counts[(None, "beta")] == 1 and counts[(3, "alpha")] == 2 and counts[(5, "beta")] == 2
    plain = represent.term_counts(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert counts == {(r.doc_id, r.term): r.tf for r in plain.collect()}


def test_rows_by_term_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(session, "PART_ROWS", 10)
    rows = [(i % 13, f"w{i % 7}", i % 3 + 1) for i in range(91)]
    counts = spark.createDataFrame(rows, "doc_id long, term string, tf long")
    docs = spark.range(13).withColumnRenamed("id", "doc_id")
    settings = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    before = {k: spark.conf.get(k) for k in settings}
    spark.conf.set(settings[0], "false")
    try:
        for made in (represent.bow(counts, docs, 1, 1.0), represent.tfidf(counts, docs, 1, 1.0)):
            assert made.rdd.getNumPartitions() == 10 and made.count() == 91
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_stemmed_rows_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(session, "PART_ROWS", 10)
    words = ["cat", "cats", "running", "runs", "run", None, "dogs"]
    rows = [(None if i % 13 == 5 else i % 13, words[i % 7], i % 3 + 1) for i in range(91)]
    counts = spark.createDataFrame(rows, "doc_id long, term string, tf long")
    stems = {"cat": "cat", "cats": "cat", "running": "run", "runs": "run", "run": "run", "dogs": "dog"}
    vocabulary = spark.createDataFrame(list(stems.items()), "term string, stem string")
    wanted = {}
    for doc, word, n in rows:
        if word:
            wanted[doc, stems[word]] = wanted.get((doc, stems[word]), 0) + n
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = text.stem_terms(counts, vocabulary)
        assert made.rdd.getNumPartitions() == 10
        assert {(r.doc_id, r.term): r.tf for r in made.collect()} == wanted
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_languages_make_no_row_per_trigram(spark, monkeypatch):
    """Alike with all trigrams in the tasks, with few of them there, and by hand."""
    labelled = spark.createDataFrame(
        [("the cat and the dog went on", "en"), ("der Hund und die Katze", "de"), ("el perro y el gato", "es"), ("le chien et le chat \U0001d400\U0001d401", "fr")],
        "text string, lang string",
    )
    languages = ("de", "en", "es", "fr")
    profiles = text.train_language_profiles(labelled, languages)
    rows = [(1, 0, "the dog"), (1, 1, "die Katze"), (None, 0, "el gato"), (None, 1, "123 ..."), (2, 0, None), (2, 1, "le chien Über 漢字"), (2, 2, ""), (3, 0, "the dog"), (3, 0, "the dog")]
    sentences = spark.createDataFrame(rows, "doc_id long, pos int, sentence string")
    found = text.detect_language(sentences, profiles, languages)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    wanted = {(1, 0): "en", (1, 1): "de", (None, 0): "es", (None, 1): "non-en", (2, 0): "non-en", (2, 1): "fr", (2, 2): "non-en", (3, 0): "en"}
    assert {(r.doc_id, r.pos): r.language for r in found.collect()} == wanted and found.count() == len(wanted)

    def sums():
        by = text.trigram_sums(sentences, profiles, languages).groupBy("doc_id", "pos").sum("grams", "seen", *[f"sum_{x}" for x in languages])
        return {r[:2]: [round(v, 9) for v in r[2:]] for r in map(tuple, by.collect())}

    whole = sums()
    assert whole[(1, 0)][:2] == [6, 6] and whole[(2, 1)][:2] == [13, 8]
    monkeypatch.setattr(text, "MOST_GRAMS", 5)
    assert sums() == whole


def test_points_meet_shells_in_bounded_slices(spark, monkeypatch):
    """What a task holds of points by pivots or shells is bounded, however many rows a batch has."""
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(i, rng.integers(0, 50, 3).astype(float).tolist()) for i in range(400)], "k long, vector array<double>")

    def found():
        near = neighbours.nearest_neighbours(points, ["k"], k=3, block_rows=16, most_pivots=32, most_zones=64)
        return sorted((r.k, r.nn, r.nn_k, r.distance) for r in near.collect())

    whole = found()
    monkeypatch.setattr(neighbours, "CELLS", 100)
    batch = pa.RecordBatch.from_arrays([pa.array(range(45))], ["number"])
    assert [b.num_rows for b in neighbours.slices(iter([batch]), 10)] == [10, 10, 10, 10, 5]
    assert found() == whole and len(whole) == 1200


def test_lsa_sends_terms_to_blocks_not_entries(spark, monkeypatch):
    """The matrix stays where its blocks are; many small blocks give the vectors of a dense SVD."""
    monkeypatch.setattr(represent, "BLOCK_ENTRIES", 40)
    monkeypatch.setattr(represent, "PART_ENTRIES", 7)
    monkeypatch.setattr(represent, "GATHERED", 5)
    rng = np.random.default_rng(11)
    x = np.where(rng.random((30, 12)) < 0.6, rng.random((30, 12)), 0.0)
    x[0, 0] = x[29, 11] = 1.0
    rows = [(int(d), f"t{t}", float(x[d, t])) for d, t in zip(*x.nonzero())]
    odd = [(3, None, 5.0), (4, "t1", None), (5, "t2", 0.25)]  # a null term, a null value, a repeated entry
    x[5, 2] += 0.25
    values = spark.createDataFrame(rows + odd, "doc_id int, term string, value double")

    name = represent.packed_blocks(values)
    try:
        matrix = spark.table(name)
        blocks = {r.block: r.documents for r in matrix.filter("documents IS NOT NULL").collect()}
        assert len(blocks) > 3 and sorted(d for docs in blocks.values() for d in docs) == list(range(30))
        met = matrix.groupBy("block").cogroup(spark.range(4).groupBy("id")).applyInArrow(lambda a, b: a.select(["block"]), "block int")
        plan = met._jdf.queryExecution().executedPlan().toString()
        scan = next(i for i, line in enumerate(plan.splitlines()) if "Scan parquet" in line)
        assert "Exchange" not in "".join(plan.splitlines()[:scan])
    finally:
        represent.drop_blocks(spark, name)
    assert not spark.catalog.tableExists(name)

    vectors, singular = represent.lsa(values, k=3, iterations=6, oversample=9)
    left, sizes, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(singular, sizes[:3], rtol=1e-6)
    found = np.array([r.vector for r in vectors.orderBy("doc_id").collect()])
    assert np.allclose(np.abs(found), np.abs(left[:, :3] * sizes[:3]), atol=1e-5)
