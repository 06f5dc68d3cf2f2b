"""Operators against brute force, other libraries and exact round trips."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docketry.llm import (
    bit_planes,
    byte_tokens,
    components,
    context_mixing,
    count_transducer,
    license_rules,
    one_permutation,
    prefix_bpe,
    quality_neighbours,
    queries,
    simhash,
    source_mixing,
    top_products,
)

STOCK = (
    "a the ing er th on 's ' 'll é É ß × Σ İ 中 한 😀 1 23 ½ ! ?! ... <|endoftext|> <|startoftext|> <s> _ ▁ \n \t "
    "\x0b \x85   aaaaaa llll ThE é"
).split(" ") + [" ", "  ", "     "]
TEXTS = st.lists(st.sampled_from(STOCK), max_size=25).map("".join)


def documents(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


# ---- tokenizers ---------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_word_ids_are_the_librarys(text):
    words = prefix_bpe.words(public_tokenizers.path("word_bpe_49k.json"))
    ids = words.library.encode(text, add_special_tokens=False).ids
    found = words.split(text)
    assert b"".join(x[0] for x in found) == np.array(ids, "<u4").tobytes()
    assert b" ".join(x[1] for x in found).decode() == words.library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=6))
def test_byte_ids_are_the_librarys(texts):
    tokens = byte_tokens.byte_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = [tokens.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in tokens.encode(pa.array(texts))] == wanted


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=6))
def test_token_counts_are_the_librarys(texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert count_transducer.counter(path).totals(pa.array(texts)).tolist() == [len(x) for x in library.encode(texts)]


def test_counts_of_long_runs_compose(spark):
    path, rng = public_tokenizers.path("piece_bpe_32k.model"), random.Random(5)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["".join(rng.choice("aeinthsolrdé1") for _ in range(n)) for n in (63, 64, 65, 127, 500, 3000)] + [" " * 400, "-" * 333]
    assert count_transducer.counter(path).totals(pa.array(texts)).tolist() == [len(x) for x in library.encode(texts)]


def test_tables_of_words_start_anew_without_a_trace(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(60)) for _ in range(30)]
    monkeypatch.setattr(prefix_bpe, "CACHED_WORDS", 20)
    monkeypatch.setattr(byte_tokens, "KNOWN_WORDS", 20)
    monkeypatch.setattr(count_transducer, "KNOWN_CHUNKS", 20)
    monkeypatch.setattr(count_transducer, "MOST_STATES", 50)
    monkeypatch.setattr(count_transducer, "KNOWN_PAIRS", 50)
    words = prefix_bpe.Words(public_tokenizers.path("word_bpe_49k.json"))
    tokens = byte_tokens.ByteTokens(public_tokenizers.path("byte_bpe_50k.json"))
    path = public_tokenizers.path("piece_bpe_32k.model")
    counter, library = count_transducer.Counter(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for t in texts:
        assert len(b"".join(x[0] for x in words.split(t))) == 4 * len(words.library.encode(t, add_special_tokens=False).ids)
        assert tokens.encode(pa.array([t]))[0].tolist() == tokens.library.encode(t, add_special_tokens=False).ids
        assert counter.totals(pa.array([t])).tolist() == [len(library.encode(t))]


def test_token_query_against_libraries(spark, sf_dir):
    texts = documents(spark, sf_dir)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in queries.op8_prefix_bpe(spark, sf_dir).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in queries.op6_token_counts(spark, sf_dir).collect():
        n = len(pieces.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


# ---- token files --------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=200), st.booleans(), st.integers(0, 3))
def test_planes_round_trip(ids, bits, shift):
    ids = np.tile(np.array(ids, np.uint32) >> np.uint32(8 * shift), 90)
    planes = bit_planes.to_planes(ids, bits)
    assert len(planes) == (32 if bits else 4)
    assert (bit_planes.from_planes(planes, len(ids)) == ids).all()


@pytest.mark.parametrize("bits", [False, True])
def test_token_file_holds_all_ids_in_order(spark, sf_dir, tmp_path, bits):
    texts = documents(spark, sf_dir)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    folder = str(tmp_path / "tokens")
    bit_planes.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, bits=bits)
    got = {r.doc_id: r for r in bit_planes.read(spark, folder).collect()}
    at = 0
    for i in sorted(texts):
        ids = [*lib.encode(texts[i], add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens) == (at, len(ids))
        assert bytes(got[i].ids) == np.array(ids, "<u4").tobytes()
        at += len(ids)
    index = spark.read.parquet(f"{folder}/index").orderBy("start").collect()
    assert sum(r.n_ids for r in index) == at and index[0].start == 0
    assert all(a.start + a.n_ids == b.start and a.last_doc < b.first_doc for a, b in zip(index, index[1:]))


# ---- SimHash ------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reached(fps, limit=4):
    """Least index that every fingerprint reaches over links, by repeated comparison of all with all."""
    fps = np.array(fps, np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= limit
    label = np.arange(len(fps))
    while True:
        least = np.where(near, label[None], len(fps)).min(1)
        if (least == label).all():
            return label
        label = least


def test_simhash_query_against_brute_force(spark, sf_dir):
    texts = documents(spark, sf_dir)
    rows = sorted(queries.op3_simhash_groups(spark, sf_dir).collect(), key=lambda r: r.doc_id)
    fps = [slow_fingerprint(texts[r.doc_id]) for r in rows]
    assert [r.fingerprint for r in rows] == [f"{f:016x}" for f in fps]
    assert [r.component_id for r in rows] == [rows[i].doc_id for i in reached(fps)]


@pytest.mark.parametrize("cell_rows", [4096, 7])
def test_links_of_dense_groups(spark, cell_rows):
    rng = random.Random(1)
    fps = set()
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(120):
            y = x
            for _ in range(rng.randint(0, 6)):
                y ^= 1 << rng.randrange(64)
            fps.add(y)
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(200)})
    table = spark.createDataFrame([(int(v),) for v in simhash.signed(fps)], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.links(table, cell_rows=cell_rows)).collect()}
    label, keys = reached(fps), simhash.signed(fps).tolist()
    groups = {}
    for i, key in enumerate(keys):
        groups.setdefault(roots.get(key, key), set()).add(i)
    wanted = {}
    for i, l in enumerate(label.tolist()):
        wanted.setdefault(l, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 500)]
    edges = spark.createDataFrame(path + star + path[:5] + [(7, 7)], "u long, v long")
    found = {r.node: r.root for r in components.components(edges).collect()}
    assert found == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1500)}


# ---- fingerprints -------------------------------------------------------------------------------------------


def shingles(text, n=5):
    words = text.encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_minhash_query(spark, sf_dir):
    texts = documents(spark, sf_dir)
    order = sorted(texts)
    rows = {r.doc_id: r for r in queries.op5_one_permutation_minhash(spark, sf_dir).collect()}
    errors = []
    for i, j in zip(order, order[1:] + order[:1]):
        text, half = texts[i], len(texts[i]) // 2
        edited = text[: len(text) - half] + texts[j][:half]
        assert rows[i].n_chars == len(text) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, value in ((edited, rows[i].near_edited), (texts[j], rows[i].near_next)):
            a, b = shingles(text), shingles(other)
            errors.append(value - (len(a & b) / len(a | b) if a | b else 1.0))
    assert np.abs(errors).max() < 0.15 and np.sqrt(np.mean(np.square(errors))) < 0.03
    by_text = {}
    for i in order:
        by_text.setdefault(texts[i], set()).add(rows[i].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


def test_densified_bins_by_hand():
    texts = ["one two three four five six seven", "x", "", "a b c d e f"]
    bits, has = one_permutation.signatures(pa.array(texts))
    assert has.tolist() == [True, True, False, True]
    hashes, owner = one_permutation.shingle_hashes(pa.array(texts))
    shift = np.uint64(64 - one_permutation.BIN_BITS)
    for t in (0, 1, 3):
        bins = {}
        for h in hashes[owner == t]:
            key = int(h >> shift)
            bins[key] = min(bins.get(key, 1 << 64), int(h) & ((1 << int(shift)) - 1))
        for b in range(one_permutation.BINS):
            value = bins.get(b)
            for lender in () if value is not None else one_permutation.LENDERS[:, b]:
                if int(lender) in bins:
                    value = bins[int(lender)]
                    break
            assert bits[t, b] == value & 15
    packed = [p.hex() for p in one_permutation.packed(bits, has)]
    again, has_again = one_permutation.unpacked(packed)
    assert (again[has] == bits[has]).all() and (has_again == has).all()


# ---- quality, language model --------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op4_quality_knn(spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    held = [(rows[r.doc_id].predicted, r.quality) for r in labels if rows[r.doc_id].held_out]
    assert all(rows[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in labels)
    assert np.mean([p == q for p, q in held]) > 0.97


def test_neighbour_votes_by_hand():
    texts = pa.array(["aa bb cc dd", "AA!! BB!! CC!!", "ee ff gg hh"])
    weights = quality_neighbours.term_weights(texts)
    axes = quality_neighbours.axes_of(weights, 3)
    vectors = quality_neighbours.unit_rows(weights @ axes)
    model = quality_neighbours.Model(np.ones(weights.shape[1], np.float32), axes, vectors, np.array([1.0, 0.0, 1.0]), 0.5)
    near = np.maximum(vectors @ vectors.T, 0.0) ** quality_neighbours.POWER
    wanted = (near * np.array([1.0, 0.0, 1.0])).sum(1) / near.sum(1)
    assert model.scores(texts) == pytest.approx(wanted, rel=1e-4)
    assert model.scores(pa.array([""])).tolist() == [0.5]


def test_held_out_labels_are_not_learnt(spark):
    docs = spark.createDataFrame([(i, f"text {i} " + ("!! " * 5 if i % 2 else "word ") * 9) for i in range(60)], "doc_id long, text string")
    first = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    flipped = spark.createDataFrame(
        [(i, 1 - i % 2 if zlib.crc32(str(i).encode()) % 3 == 1 else i % 2) for i in range(60)], "doc_id long, quality int"
    )
    held = quality_neighbours.is_held_out()
    scores = [
        sorted((r.doc_id, r.score) for r in quality_neighbours.score(docs, quality_neighbours.fit(docs, l, held)).collect())
        for l in (first, flipped)
    ]
    assert scores[0] == scores[1]


def test_language_model_query(spark, sf_dir):
    texts = documents(spark, sf_dir)
    tokens = {i: [*t.encode().lower().split(), b"\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    for r in queries.op1_context_mixing(spark, sf_dir).collect():
        words = tokens[r.doc_id]
        base = sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(words), total)
        assert r.n_known == sum(counts[w] > 0 for w in words) and r.base_score == pytest.approx(base, rel=1e-9)
        assert r.bits_per_byte == pytest.approx(-r.score * np.log2(10) / sum(len(w) + (w != b"\n") for w in words), rel=1e-9)


def test_the_model_is_a_distribution():
    """Over all bytes that may follow a beginning, probabilities sum to one."""
    tables, mixer = np.zeros((context_mixing.PREDICTORS, context_mixing.SLOTS, 2), np.float32), context_mixing.Mixer.new()
    words = pa.array(["the", "then", "there", "other", "\n"])
    counts, kinds = np.array([50, 20, 10, 5, 30]), np.zeros(5, int)
    beginnings = context_mixing.nodes(words, kinds, counts, 2.0)
    context_mixing.count_slots(beginnings, tables)
    for _ in range(5):
        context_mixing.learn(beginnings, tables, mixer)
    # all strings of one printable byte more, ended by a blank: P(word) <= sum over them, and 'the' is likely
    p = 10 ** context_mixing.log10_probabilities(words, kinds, tables, mixer)
    assert p.sum() < 1 and p.argmax() == 0
    alone = [bytes([b]).decode("latin-1") for b in range(128)]
    first = 0.0
    for hashes_of in (alone,):
        for b in hashes_of:
            nodes = context_mixing.nodes(pa.array([b + "x"]), np.zeros(1, int), np.ones(1), np.inf)
            first += 10 ** byte_log10(nodes, tables, mixer, int(nodes.of_byte[0]))
    upper = sum(10 ** high_bit(tables, mixer, b) for b in (0, 1))
    assert upper == pytest.approx(1.0, abs=1e-6) and first <= 1.0 + 1e-6


def byte_log10(nodes, tables, mixer, node):
    total = 0.0
    for bit in range(8):
        slots, known, value = context_mixing.bit_slots([h[node : node + 1] for h in nodes.hashes], nodes.data[node : node + 1], bit)
        odds, _, gate = context_mixing.predict(tables, mixer, slots, known)
        one = context_mixing.refine(mixer, odds, gate)[0][0]
        total += np.log10(one if value[0] else 1 - one)
    return total


def high_bit(tables, mixer, bit):
    nodes = context_mixing.nodes(pa.array(["a"]), np.zeros(1, int), np.ones(1), np.inf)
    start = int(nodes.of_byte[0])
    slots, known, _ = context_mixing.bit_slots([h[start : start + 1] for h in nodes.hashes], nodes.data[start : start + 1], 0)
    odds, _, gate = context_mixing.predict(tables, mixer, slots, known)
    one = context_mixing.refine(mixer, odds, gate)[0][0]
    return np.log10(one if bit else 1 - one)


# ---- products, mixing ---------------------------------------------------------------------------------------


def test_products_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(top_products, "CANDIDATE_BLOCK", 300)
    monkeypatch.setattr(top_products, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1000, 12)) * np.exp(rng.normal(size=(1000, 1)))
    x[500:620] = x[500]  # ties
    x = x.astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_products.top_products(vectors).collect()}
    v = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    for q in range(0, 1000, 20):
        best = sorted((-int(v[q] @ v[i]), i) for i in range(1000) if i != q)[:20]
        assert [got[q, n + 1] for n in range(20)] == [(i, -s) for s, i in best]


def test_targets_by_hand(spark):
    sizes = [("a", 10), ("b", 100), ("c", 1000), (None, 400), ("d", 0)]
    sized = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes)], "doc_id long, source string, size long")
    weights, limit = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}, {s: 3.0 * n for s, n in sizes}
    total, fixed = 1510.0, {}
    while True:
        rest = total - sum(fixed.values())
        open_ = [s for s in weights if s not in fixed]
        share = {s: rest * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > limit[s]]
        if not over:
            break
        fixed |= {s: limit[s] for s in over}
    wanted = fixed | share
    found = {r.source: r.target for r in source_mixing.targets(sized).collect()}
    assert found == pytest.approx(wanted)


def test_mix_comes_near_its_targets_and_repeats(spark, sf_dir):
    rows = queries.op10_pivotal_mix(spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        source = docs[r.doc_id].source
        assert r["size"] == len((docs[r.doc_id].text or "").encode().split()) and r.taken <= 3 * r["size"]
        assert r.taken % max(r["size"], 1) == 0
        taken[source] += r.taken
        target[source] = r.target
        largest[source] = max(largest[source], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in target)
    again = queries.op10_pivotal_mix(spark, sf_dir).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_rounding_keeps_sums_and_probabilities(spark):
    """Over several levels of buckets: sums stay, and units are taken about as often as their probability."""
    units = [("s" if i % 3 else "hot", str(i), 1 + i % 7, 0.3) for i in range(900)]
    table = spark.createDataFrame(units, "source string, key string, size long, p double")
    rows = {r.key: r.taken for r in source_mixing.round_fractions(table, bucket=4).collect()}
    assert len(rows) == 900 and set(rows.values()) == {0, 1}
    for source in ("s", "hot"):
        wanted = sum(n * p for s, _, n, p in units if s == source)
        assert abs(sum(n * rows[k] for s, k, n, _ in units if s == source) - wanted) <= 3.5 + 1e-6
    small = np.mean([rows[k] for _, k, n, _ in units if n == 1])
    assert 0.15 < small < 0.45


def test_native_plans_have_no_python(spark, sf_dir, capsys):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source_mixing.mix(docs).explain()
    license_rules.scan(docs).explain()
    assert "Python" not in capsys.readouterr().out


def test_products_against_sql_are_covered():
    assert set(queries.ORACLES) <= set(queries.QUERIES) and len(queries.QUERIES) == 10
