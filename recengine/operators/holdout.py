"""Hold-outs of whole tracks or whole users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(ids: DataFrame, column: str, fraction: float, seed: str) -> DataFrame:
    """round(fraction * n) distinct ids (half to even), the first by a digest of id and seed: the same on any engine."""
    distinct = ids.select(column).distinct()
    n = int(distinct.agg(F.bround(F.lit(float(fraction)) * F.count(F.lit(1)))).first()[0] or 0)
    return distinct.orderBy(F.md5(F.concat(F.col(column).cast("string"), F.lit(seed)))).limit(n)


def without(listens: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return listens.join(ids, column, "left_anti")
