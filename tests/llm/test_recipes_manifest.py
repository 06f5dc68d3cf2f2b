"""Exact dedup by chunk recipes and the Merkle manifest: against brute force, with hash clashes, over several tiers."""

import hashlib
import random
import string
import zlib
from collections import defaultdict

import odd  # beside this file
import pytest
from pyspark.sql import functions as F

from docketry.llm import chunk_recipes, merkle_manifest
from docketry.llm.common import crc_remainder

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def texts_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def expected_copies(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    return groups


def check_copies(found, rows):
    groups = expected_copies(rows)
    assert len(found) == len(rows)
    kept = defaultdict(int)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    for r in found:
        ids = by_digest[r.text_sha256]
        assert r.doc_id in ids and r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert all(kept[d] == 1 for d in by_digest)


def long_texts(rng):
    """Texts that share most of their chunks, in another order, in another case, or but for one of them."""
    parts = ["".join(rng.choice("abjq zxé. \n") for _ in range(400)) for _ in range(6)]
    texts = ["".join(rng.sample(parts, len(parts))) for _ in range(30)]
    return texts + [t.upper() for t in texts] + [t.swapcase() for t in texts[:10]] + [t + "é" for t in texts[:5]]


def test_chunks_put_together_are_the_text(spark):
    rng = random.Random(1)
    texts = [*long_texts(rng), "", "x", "é" * 20_000, "中" * 9_000, "j" * 3_000, "😀a" * 700, "\n" * 600]
    rows = texts_frame(spark, list(enumerate(texts))).select("text", chunk_recipes.chunks(F.col("text")).alias("c")).collect()
    for r in rows:
        assert "".join(r.c) == r.text and all(0 < len(c) <= chunk_recipes.MOST + 1 for c in r.c)


def test_edits_change_few_chunks(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(60_000))
    edited = text[:30_000] + "inserted" + text[30_000:]
    a, b = (set(r.c) for r in texts_frame(spark, [(1, text), (2, edited)]).select(chunk_recipes.chunks(F.col("text")).alias("c")).collect())
    assert len(a) > 100 and len(a - b) < 25


@pytest.mark.parametrize("hashed", [chunk_recipes.chunk_hash, lambda c: F.pmod(F.xxhash64(c), F.lit(3)), lambda c: F.lit(7).cast("long")])
def test_copies_against_brute_force_whatever_the_hash(spark, hashed):
    texts = long_texts(random.Random(3))
    rows = [(i % 90, t) for i, t in enumerate(texts)] + [(r[0], r[1]) for r in odd.ROWS]
    found = chunk_recipes.copies(texts_frame(spark, rows), least=20, most=60, hashed=hashed).collect()
    check_copies(found, rows)


def test_copies_of_a_hot_group(spark):
    rows = [(i, "Same text" if i % 3 else f"text {i // 9}") for i in range(3000)]
    check_copies(chunk_recipes.copies(texts_frame(spark, rows)).collect(), rows)


def test_documents_that_stay_keep_their_columns(spark):
    docs = odd.documents(spark)
    kept = chunk_recipes.without_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(["3", "4", "None", "5", "6", "7", "8"])
    assert chunk_recipes.without_copies(docs.limit(0)).count() == chunk_recipes.copies(docs.limit(0)).count() == 0


def test_plan_has_no_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = chunk_recipes.copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


# ---- Merkle manifest ----------------------------------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row):
    return h("".join(field(row[c]) for c in merkle_manifest.FIELDS))


def climb(nodes):
    """All levels above the given digests, and each node's (left, right) on its way up."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 3 * 3 : k // 3 * 3 + 3]
            ways[i].append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
            at[i] = k // 3
        nodes = [h("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
    return nodes[0], ways


def manifest(rows):
    by_source = defaultdict(list)
    for row in rows:
        by_source[row["source"]].append(row)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    tops = {}
    for s in sources:
        by_source[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        tops[s] = climb([leaf(r) for r in by_source[s]])
    root, high = climb([tops[s][0] for s in sources])
    for k, s in enumerate(sources):
        for row, low in zip(by_source[s], tops[s][1]):
            way = low + high[k]
            changed = dict(row)
            if row["text"] is not None and zlib.crc32(str("" if row["doc_id"] is None else row["doc_id"]).encode()) % 2 == 0:
                changed["text"] = row["text"].replace("\n", "")
            x = leaf(changed)
            for left, right in way:
                x = h(left + x + right)
            yield (row["doc_id"], leaf(row), tops[s][0], root, h("".join(a + b for a, b in way)), x, x == root)


def verified(docs):
    no_lines = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    return merkle_manifest.verified(docs, crc_remainder("doc_id", 2) == 0, no_lines)


def plain(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_manifest_over_several_tiers(spark, monkeypatch, depth):
    monkeypatch.setattr(merkle_manifest, "DEPTH", depth)
    rng = random.Random(depth)
    sizes = {None: 5, "": 1, "a": 28, "b": 27, "é": 82 if depth > 1 else 10, "z": 3, "日": 2, "lone": 1}
    rows = [
        {"doc_id": rng.randrange(10**6), "source": s, "lang": rng.choice(["en", None]), "n_chars": rng.choice([3, None]), "text": rng.choice(["a\nb", "c", "", None, "é\n"])}
        for s, n in sizes.items()
        for _ in range(n)
    ]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert plain(verified(docs).collect()) == plain(manifest(rows))


def test_manifest_of_odd_rows(spark):
    docs = odd.documents(spark).withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), "tree": F.lit(1), "levels": F.lit(2), "root": F.lit("r"), "leaf": F.lit("l")})
    rows = [r.asDict() for r in docs.collect()]
    assert plain(verified(docs).collect()) == plain(manifest(rows))
    assert verified(docs.limit(0)).count() == 0


def test_one_document_is_its_own_root(spark):
    docs = spark.createDataFrame([(7, "s", "en", 1, "x")], "doc_id long, source string, lang string, n_chars long, text string")
    r = verified(docs).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == h("") and r.verified
