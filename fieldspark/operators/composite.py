"""Satellite pixels: latest-value composites, coast masks and shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import times
from fieldspark.functions.scales import finite
from fieldspark.operators import sizes


# More than there are ranks of 64 bits, so that time and rank order as one number.
RANKS = 2 * 10**19
LEAST_RANK = -(2**63)


def valid_pixels(pixels: DataFrame) -> DataFrame:
    return pixels.where(finite(F.col("value")))


def newest(time: Column, rank: Column) -> Column:
    """An order by time, then by rank (any whole number of 64 bits), in one decimal: Spark can then pick the newest value by
    hash, which it cannot with a struct. A sensor gives a pixel one value per time, so the order is unique."""
    order = times.micros(time).cast("decimal(18,0)") * _decimal(RANKS) + (rank.cast("decimal(20,0)") - _decimal(LEAST_RANK))
    return F.when(rank.isNotNull(), order.cast("decimal(38,0)")).otherwise(F.raise_error(F.lit("a pixel without a sensor")).cast("decimal(38,0)"))


def newest_time(order: Column) -> Column:
    at = F.call_function("div", order - _place(order), _decimal(RANKS))
    return F.timestamp_add("MICROSECOND", at, times.ts(times.EPOCH))


def newest_rank(order: Column) -> Column:
    return (_place(order) + _decimal(LEAST_RANK)).cast("long")


def _place(order: Column) -> Column:
    return F.pmod(order, _decimal(RANKS))


def _decimal(number: int) -> Column:
    return F.lit(str(number)).cast("decimal(20,0)")


def composite(pixels: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Per pixel the newest valid value in [as_of - days, as_of], its age and which sensor gave it. At equal
    times the sensor listed first wins, whatever its number. `product_index` counts only the sensors with data in the window. One
    shuffle, after partial aggregation; the few sensors are one broadcast row."""
    window = pixels.where((F.col("time") <= as_of) & (F.col("time") >= F.timestamp_add("DAY", F.lit(-days), as_of)))
    used = window.agg(F.array_sort(F.collect_set("sensor")).alias("_used"))
    order = newest(F.col("time"), F.bitwise_not(F.col("sensor").cast("long")))
    best = valid_pixels(window).withColumn("_o", order).groupBy("iy", "ix").agg(F.max_by("value", "_o").alias("value"), F.max("_o").alias("_o"))
    return best.join(sizes.one_row(used)).select(
        "iy", "ix", "value", times.age_days(newest_time(F.col("_o")), as_of).alias("age_days"),
        (F.array_position("_used", F.bitwise_not(newest_rank(F.col("_o"))).cast(pixels.schema["sensor"].dataType)) - 1).cast("int").alias("product_index"),
    )


def composite_series(pixels: DataFrame, first: str, step_days: int, frames: int, days: int) -> DataFrame:
    """The composite at each of `frames` ends first, first + step, ...: the newest valid value not older than
    `days`. At equal times the sensor listed last wins.

    Observations are first reduced to the newest per pixel and frame step, since a newer one serves every frame
    an older one of the same step does; only the survivors are repeated over the frames they can serve."""
    step_us = step_days * times.DAY_US
    since = F.timestamp_diff("MICROSECOND", times.ts(first), F.col("time"))
    opened = F.greatest(F.lit(0), F.ceil(since / F.lit(float(step_us))).cast("int"))
    # Both ends as plain comparisons of the stored column, which prune files and row groups.
    begin, end = F.timestamp_add("DAY", F.lit(-days), times.ts(first)), F.timestamp_add("DAY", F.lit((frames - 1) * step_days), times.ts(first))
    rows = valid_pixels(pixels.where(F.col("time").between(begin, end))).withColumn("_o", newest(F.col("time"), F.col("sensor")))
    kept = rows.groupBy("iy", "ix", opened.alias("_k0")).agg(F.max_by("value", "_o").alias("value"), F.max("_o").alias("_o"))
    until = F.timestamp_diff("MICROSECOND", times.ts(first), newest_time(F.col("_o"))) + F.lit(days * times.DAY_US)
    last = F.least(F.lit(frames - 1), F.floor(until / F.lit(float(step_us))).cast("int"))
    served = kept.withColumn("_k1", last).where(F.col("_k0") <= F.col("_k1")).withColumn("frame", F.explode(F.sequence("_k0", "_k1")))
    out = served.groupBy("frame", "iy", "ix").agg(F.max_by("value", "_o").alias("value"), F.max("_o").alias("_o"))
    at = F.timestamp_add("DAY", F.col("frame") * step_days, times.ts(first))
    return out.select(
        "frame", at.alias("time"), "iy", "ix", "value", times.age_days(newest_time(F.col("_o")), at).alias("age_days"), newest_rank(F.col("_o")).cast(pixels.schema["sensor"].dataType).alias("sensor")
    )


def mask_coast(pixels: DataFrame, steps: int, frame: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Drop valid pixels within `steps` (in rows plus columns) of an invalid one in the same frame. Every pixel
    of a frame has a row, invalid ones a null; outside the grid counts as water. Erosion by a cross, `steps`
    times over, is this distance."""
    ok = F.col(value).isNotNull()
    if steps <= 0:
        return pixels.where(ok)
    ball = [(dy, dx) for dy in range(-steps, steps + 1) for dx in range(-steps, steps + 1) if abs(dy) + abs(dx) <= steps]
    land = pixels.where(~ok).select(*frame, "iy", "ix")
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ball])
    near = land.withColumn("_o", F.explode(offsets)).select(
        *frame, (F.col("iy") + F.col("_o.dy")).alias("iy"), (F.col("ix") + F.col("_o.dx")).alias("ix")
    ).distinct()
    return pixels.where(ok).join(near, [*frame, "iy", "ix"], "left_anti")


def wet_mask(grid: DataFrame, key: Sequence[str] = ("iy", "ix"), value: str = "value") -> DataFrame:
    """Per cell: wet if any step has a value, and the share of steps that do."""
    ok = F.col(value).isNotNull()
    return grid.groupBy(*key).agg(F.bool_or(ok).alias("wet"), F.avg(ok.cast("int")).alias("share"), F.count(F.lit(1)).alias("steps"))


def valid_share(composites: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of pixels with a value and their median age. Ages are whole seconds within the composite's window,
    so the median's table of distinct values is bounded by the window."""
    ok = F.col("value").isNotNull()
    return composites.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pixels"), F.avg(ok.cast("int")).alias("valid_share"), F.median(F.when(ok, F.col("age_days"))).alias("median_age_days")
    )
