"""Rows of one vec_id are all searched and ranked, whether their vectors differ or not, as in the query's SQL."""

import duckdb
import numpy as np
import pytest

from docketry.llm import queries, top_products


@pytest.mark.parametrize("block", [8192, 40])
def test_repeated_ids_as_in_sql(spark, monkeypatch, block):
    monkeypatch.setattr(top_products, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(top_products, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 4)).astype(np.float32)
    rows = [(i % 50, v.tolist()) for i, v in enumerate(x)]  # every id three times
    rows += [*rows[:30], *rows[:7], rows[20], rows[20]]  # and equal rows, queries among them
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_products.top_products(vectors).collect())
    duck = duckdb.connect()
    duck.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    duck.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert found == sorted(duck.execute(queries.ORACLES["op9_exact_top_k"]).fetchall())
