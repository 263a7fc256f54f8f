"""Exact selection by running weight: many percentiles and medians at once, no group of values ordered beyond a stated size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.session import materialise

#: So many values of one goal are ordered by one task at most, and so many cuts narrow a larger range.
SIZE, CUTS = 4_096, 64


def crossings(
    held: DataFrame, by: Sequence[str], goals: DataFrame, *, size: int = SIZE, cuts: int = CUTS, levels: int | None = None, few_goals: bool = False
) -> DataFrame:
    """(by..., q, value): for each of `goals(by..., q, _goal)` the first value, going up, at which the weight of its group's
    `held(by..., _x, _w)`, one row per distinct value, has reached `_goal`; the last where rounding keeps it a hair below.

    A range that holds more than `size` values is cut at quantiles of its values, from a mergeable sketch, so that every part holds
    about as few of them however they are spread. Weights are summed by part, and the part where the running weight crosses the goal
    is the next range: rounds grow with the logarithm of the number of values. How good the sketch is decides how fast parts
    shrink, never what is found. At most `levels` rounds, if given. `held` is read once a round; store it beforehand. Set
    `few_goals` where goals are known to be few: then they are broadcast."""
    by, group = list(by), [*by, "q"]
    span = held.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    ranges = materialise(goals.select(*group, "_goal").join(span, by).withColumn("_off", F.lit(0).cast("double")), "ranges")
    small: list[DataFrame] = []
    columns = [*group, "_goal", "_off", "_lo", "_hi", "_n"]
    rounds = 0

    def inside(part: DataFrame) -> DataFrame:
        return held.join(F.broadcast(part) if few_goals else part, by).where(F.col("_x").between(F.col("_lo"), F.col("_hi")))

    while levels is None or rounds < levels:
        rounds += 1
        wide = ranges.where(F.col("_n") > size)
        if wide.isEmpty():
            break
        small.append(ranges.where(F.col("_n") <= size).select(*columns))
        shares = F.array(*[F.lit((i + 1) / cuts) for i in range(cuts - 1)])
        marks = inside(wide).groupBy(*group).agg(F.percentile_approx("_x", shares, F.lit(100 * cuts)).alias("_cuts"))
        parts = inside(wide.join(marks, group)).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_x"))))
        hist = parts.groupBy(*group, "_goal", "_off", "_b").agg(
            F.sum("_w").alias("_s"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_n")
        )
        # A row per part: at most `cuts` for each goal.
        hist = hist.withColumn("_cum", F.col("_off") + F.sum("_s").over(Window.partitionBy(*group).orderBy("_b")))
        row = F.struct("_b", "_lo", "_hi", (F.col("_cum") - F.col("_s")).alias("_off"), "_n", "_goal")
        best = hist.groupBy(*group).agg(F.coalesce(F.min(F.when(F.col("_cum") >= F.col("_goal"), row)), F.max(row)).alias("_r"))
        ranges = materialise(best.select(*group, *[F.col(f"_r.{c}").alias(c) for c in columns if c not in group]), "ranges")
    last = reduce(DataFrame.unionByName, [*small, ranges.select(*columns)])
    run = F.col("_off") + F.sum("_w").over(Window.partitionBy(*group).orderBy("_x"))
    ordered = inside(last).withColumn("_cum", run)
    return ordered.groupBy(*group).agg(F.coalesce(F.min(F.when(F.col("_cum") >= F.col("_goal"), F.col("_x"))), F.max("_x")).alias("value"))


def medians(df: DataFrame, by: Sequence[str], x: str, *, size: int = SIZE) -> DataFrame:
    """(by..., median) of the values of `x` that are not null, for all groups at once; the mean of the two middle ones where
    their number is even. Equal values are counted before they are selected, so no task holds a group's values."""
    by = list(by)
    held = df.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("_x")).agg(F.count(F.lit(1)).alias("_w"))
    held = materialise(held, "counts")
    total = held.groupBy(*by).agg(F.sum("_w").alias("_n"))
    middle = F.array(F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1)
    goals = total.select(*by, F.posexplode(middle).alias("q", "_goal"))
    return crossings(held, by, goals, size=size).groupBy(*by).agg(F.avg("value").alias("median"))
