"""The hash of spans: against big integers, over stretches, and on words that collide in sums modulo a power of two."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from docketry.llm import batches, byte_tokens, context_mixing, count_transducer, one_permutation


def thue_morse(n):
    ones = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in ones), "".join("ba"[x] for x in ones)


def test_products_and_hashes_against_big_integers(monkeypatch):
    monkeypatch.setattr(batches, "SUM_BYTES", 700)
    rng, prime = np.random.default_rng(1), batches.PRIME
    a, b = (np.append(rng.integers(0, prime, 500, np.uint64), np.uint64(prime - 1)) for _ in range(2))
    assert [int(x) for x in batches.product(a, b)] == [int(x) * int(y) % prime for x, y in zip(a, b)]
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    starts = rng.integers(0, 3000, 60)
    ends = np.minimum(starts + rng.integers(0, 1500, 60), 3000)
    got = batches.span_hashes(data, starts, ends)
    for s, e, h in zip(starts.tolist(), ends.tolist(), got):
        value = sum((int(x) + 1) * pow(batches.BASE, i, prime) for i, x in enumerate(data[s:e])) % prime
        assert batches.mixed(np.array([(value + (e - s << 32)) % 2**64], np.uint64))[0] == h


def test_equal_spans_agree_wherever_they_stand(monkeypatch):
    monkeypatch.setattr(batches, "SUM_BYTES", 900)
    part = np.random.default_rng(2).integers(0, 256, 1200).astype(np.uint8)
    data = np.concatenate([part, part[:77], part, part[:5], part])
    starts = np.array([0, 1277, 2482])
    assert len(set(batches.span_hashes(data, starts, starts + 1200).tolist())) == 1


@pytest.mark.parametrize("n", [1024, 2048])
def test_thue_morse_words_are_told_apart(n):
    texts = list(thue_morse(n))
    tokens = byte_tokens.ByteTokens(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [x.tolist() for x in tokens.encode(pa.array(texts))] == [library.encode(t).ids for t in texts]
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    assert count_transducer.Counter(path).totals(pa.array(texts)).tolist() == [len(x) for x in pieces.encode(texts)]
    bits, _ = one_permutation.signatures(pa.array(texts, pa.large_string()))
    assert (bits[0] != bits[1]).any()


def test_a_word_like_a_learnt_one_is_not_known(spark):
    one, two = thue_morse(1024)
    ids = [i for i in range(200)]
    learnt = {r.doc_id: r.held_out for r in context_mixing.score(spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")).collect()}
    train, held = next(i for i in ids if not learnt[i]), next(i for i in ids if learnt[i])
    docs = spark.createDataFrame([(train, one), (held, two)], "doc_id long, text string")
    rows = {r.doc_id: r for r in context_mixing.score(docs).collect()}
    assert (rows[train].n_known, rows[held].n_known) == (2, 1)


@pytest.mark.parametrize("kind", ["int", "string", "bigint"])
def test_fingerprints_with_ids_of_any_type(spark, kind):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "x"), (None, None)], "doc_id long, text string")
    docs = docs.selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text")
    assert one_permutation.compare_edits(docs).count() == one_permutation.fingerprints(docs).count() == 3
