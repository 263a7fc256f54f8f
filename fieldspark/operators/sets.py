"""Bounds, top k, unions and id sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_bounds(df: DataFrame, key: Sequence[str], start: Column, end: Column, *, time: str = "time") -> DataFrame:
    """First and last time per product, and a requested window clamped to them."""
    b = df.groupBy(*key).agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"))
    return b.withColumns({"clamped_start": F.greatest("first_time", start), "clamped_end": F.least("last_time", end)})


def top_k(df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each key. The rank filter lets Spark keep only k rows per key and task before the
    shuffle, so a crowded key never reaches one task whole. End `order` with something unique."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn(out, rank).where(F.col(out) <= k)


def union_parts(parts: dict[str, DataFrame], origin: str = "origin") -> DataFrame:
    """Parts appended by column name, each row naming the part it came from."""
    out = None
    for name, part in parts.items():
        one = part.withColumn(origin, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def id_sets(ids: DataFrame, include: DataFrame, exclude: DataFrame) -> DataFrame:
    """The ids and the included ones, without the excluded ones."""
    return ids.union(include).distinct().join(exclude.distinct(), ids.columns, "left_anti")
