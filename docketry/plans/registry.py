"""The registry: name -> query, and name -> SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry.functions.measures import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, doubles: Sequence[str] = ()):
    """Register a query. The columns ``doubles`` are rounded to six decimals on both sides, because sums
    of doubles depend on their order in the last digits."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = function(spark, sf_dir)
            return df.withColumns({c: rounded(F.col(c)) for c in doubles}) if doubles else df

        run.__name__, run.__doc__ = name, function.__doc__
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = run
        if sql is not None:
            if doubles:
                parts = ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0e0 AS {c}" for c in doubles)
                ORACLES[name] = f"SELECT * REPLACE ({parts}) FROM (\n{sql.strip()}\n) AS result"
            else:
                ORACLES[name] = sql.strip()
        return function

    return register
