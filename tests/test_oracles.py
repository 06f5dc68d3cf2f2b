"""Every query with SQL gives the same rows as DuckDB on the same tables."""

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(rows):
    return sorted(tuple(repr(v) if isinstance(v, float) else str(v) for v in row) for row in rows)


def test_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = plain(tuple(row[i] for i in places) for row in result.fetchall())
    assert plain(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == expected


#: Run, with more said about their results, by test_trained.py and test_rankers.py.
ELSEWHERE = {"logistic_rank", "logistic_rank_sparse", "svm_rank", "grid_search", "save_ranker", "lsa", "pairwise_rank"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - ELSEWHERE))
def test_queries_without_sql_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_has_rows(spark):
    rows = contract.entry(spark).collect()
    assert rows and {"k", "p", "recall", "f1"} == set(rows[0].asDict())
