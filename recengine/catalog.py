"""The registry of queries: a builder of a DataFrame for each name, and SQL that another engine can run.

Values are compared by a hash, so both sides round doubles to six places (from a hair above, so that ties fall alike) and hold whole numbers as 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def comparable(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    one = lambda c: F.round(F.col(f"`{c}`").cast("double") + F.lit(1e-11), 6) + F.lit(0.0) if kinds[c] in ("double", "float") or kinds[c].startswith("decimal") else F.col(f"`{c}`").cast("long") if kinds[c] in ("int", "smallint", "tinyint") else F.col(f"`{c}`")
    return df.select(*(one(c).alias(c) for c in df.columns))


def query(sql: str | None = None, *, doubles: str = "", longs: str = "") -> Callable[[Query], Query]:
    """Registers a query under its function's name; ``doubles`` and ``longs`` name the columns of ``sql`` to round and to cast."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = lambda spark, sf_dir: comparable(f(spark, sf_dir))
        if sql:
            parts = [f"round({c}::DOUBLE + 1e-11::DOUBLE, 6) + 0.0::DOUBLE AS {c}" for c in doubles.split()] + [f"{c}::BIGINT AS {c}" for c in longs.split()]
            _SQL[f.__name__] = f"SELECT * {'REPLACE (' + ', '.join(parts) + ')' if parts else ''} FROM ({sql})"
        return f

    return register


def queries() -> dict[str, Query]:
    from recengine.plans import core, models  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
