"""The corpus pipeline against a brute-force version of its decisions."""

import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
from docketry.llm import quality_neighbours, source_mixing  # noqa: E402
from test_exact import reached, slow_fingerprint  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Rows after every stage, each stage on what was written of the one before."""
    from docketry.session import materialise

    docs, found = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    columns = docs.columns
    found.append(docs.collect())
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialise(stage(spark, docs, sf_dir))
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        found.append(docs.collect())
    return found


def test_quality_rejects_what_scores_low(spark, sf_dir, stages):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_neighbours.fit(docs, labels, quality_neighbours.is_held_out())
    import pyarrow as pa

    wanted = {r.doc_id for r in stages[0] if model.scores(pa.array([r.text or ""]))[0] >= 0.5}
    assert {r.doc_id for r in stages[1]} == wanted and len(stages[1]) == len(wanted)


def test_one_document_of_each_group_stays(stages):
    rows = sorted(stages[1], key=lambda r: r.doc_id)
    label = reached([slow_fingerprint(r.text or "") for r in rows])
    assert sorted(r.doc_id for r in stages[2]) == sorted({rows[i].doc_id for i in label})


def test_the_mix_comes_near_its_targets(spark, stages):
    words = lambda r: len((r.text or "").encode().split())
    docs = spark.createDataFrame(stages[2])
    sized = source_mixing.sizes(docs)
    targets = {r.source: r.target for r in source_mixing.targets(sized).collect()}
    taken, largest = Counter(), Counter()
    for r in stages[3]:
        taken[r.source] += words(r)
    for r in stages[2]:
        largest[r.source] = max(largest[r.source], words(r))
    assert all(abs(taken[s] - t) <= largest[s] / 2 + 1e-6 for s, t in targets.items())
    assert max(Counter(r.doc_id for r in stages[3]).values()) <= 3
    assert {r.doc_id for r in stages[3]} <= {r.doc_id for r in stages[2]}


def test_tokens_of_every_copy(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = lambda t: np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
    wanted = sorted((r.doc_id, ids(r.text)) for r in stages[3])
    assert sorted((r.doc_id, bytes(r.ids)) for r in stages[4]) == wanted


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    found = sorted((r.doc_id, bytes(r.ids)) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert found == sorted((r.doc_id, bytes(r.ids)) for r in stages[4])
