"""Time arithmetic on `timestamp_ntz` columns, all in UTC. The session time zone must be UTC (`session.use_utc`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.session import spread

EPOCH = "1970-01-01 00:00:00"
HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def micros(t: Column) -> Column:
    """Microseconds since the epoch."""
    return F.timestamp_diff("MICROSECOND", ts(EPOCH), t)


def step_index(t: Column, step_us: int) -> Column:
    """Whole steps since the epoch, rounded down (also before the epoch). Exact: times are below 2^53 us."""
    return F.floor(micros(t) / F.lit(float(step_us))).cast("long")


def hour_index(t: Column) -> Column:
    return step_index(t, HOUR_US)


def day_index(t: Column) -> Column:
    return step_index(t, DAY_US)


def from_hour(index: Column) -> Column:
    return F.timestamp_add("HOUR", index, ts(EPOCH))


def from_day(index: Column) -> Column:
    return F.timestamp_add("DAY", index, ts(EPOCH))


def add_hours(t: Column, hours: Column | int) -> Column:
    return F.timestamp_add("HOUR", hours if isinstance(hours, Column) else F.lit(hours), t)


def hours_between(start: Column, end: Column) -> Column:
    """Elapsed hours as a double."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(float(HOUR_US))


def floor_hour(t: Column) -> Column:
    return from_hour(hour_index(t))


def floor_day(t: Column) -> Column:
    return from_day(day_index(t))


def centred_hour(t: Column) -> Column:
    """The hour t' whose half-open window [t' - 30 min, t' + 30 min) holds t."""
    return floor_hour(F.timestamp_add("MINUTE", F.lit(30), t))


def round_time(t: Column, unit: str = "hour") -> Column:
    """Record times may jitter by seconds: round half up to the hour or to the second."""
    if unit == "hour":
        return centred_hour(t)
    if unit == "second":
        index = step_index(F.timestamp_add("MILLISECOND", F.lit(500), t), 1_000_000)
        return F.timestamp_add("SECOND", index, ts(EPOCH))
    raise ValueError(f"unit must be 'hour' or 'second', got {unit!r}")


def from_epoch_hours(hours: Column, epoch: str) -> Column:
    """Fractional hours since `epoch`, to the nearest second."""
    return F.timestamp_add("SECOND", F.rint(hours * 3600.0).cast("long"), ts(epoch))


# Forecast cycles and files ---------------------------------------------------------------------


def cycle_floor(t: Column, every: int = 12) -> Column:
    index = hour_index(t)
    return from_hour(index - F.pmod(index, F.lit(every)))


def cycle_for_valid(t: Column) -> Column:
    """An hour is served by the cycle that began one hour earlier."""
    return add_hours(t, -1)


def max_lead(cycle: Column) -> Column:
    """How many hours a cycle reaches: every sixth one is a long run, whose length grew in December 2020; all others are short."""
    return (
        F.when(F.hour(cycle) % 6 != 0, 18).when(cycle >= ts("2020-12-02 00:00:00"), 48).otherwise(36).cast("int")
    )


def file_date(t: Column) -> Column:
    """Midnight stamp of the day file that holds the record at t: file D holds (D-1 00:00, D 00:00]."""
    return from_day(day_index(add_hours(t, -1)) + 1)


def nowcast_cycle(t: Column, every: int = 6, first: int = 5) -> Column:
    """The nowcast cycle whose file holds t: cycles at first, first + every, ... and each file holds the
    `every` hours up to its cycle."""
    index = hour_index(t)
    return from_hour(index + F.pmod(F.lit(first) - index, F.lit(every)))


# Request axes ----------------------------------------------------------------------------------


def on_the_hour(t: Column) -> Column:
    return F.pmod(micros(t), F.lit(HOUR_US)) == 0


def frame_times(
    requests: DataFrame, start: str, hours: str, *, before: int = 1, after: int = 1, stride: int = 1, out: str = "time"
) -> DataFrame:
    """One row per record time of each request: start - before to start + hours + after, inclusive, every
    `stride` hours. A start off the hour is an error."""
    begin = F.when(on_the_hour(F.col(start)), hour_index(F.col(start))).otherwise(
        F.raise_error(F.concat(F.lit("start is not on the hour: "), F.col(start).cast("string"))).cast("long")
    )
    return spread(requests).withColumn(
        "_h", F.explode(F.sequence(begin - before, begin + F.col(hours) + after, F.lit(stride).cast("long")))
    ).select("*", from_hour(F.col("_h")).alias(out)).drop("_h")


# Age and retention -----------------------------------------------------------------------------


def age_days(t: Column, as_of: Column) -> Column:
    """Age in days, whole seconds first, as the composites report it."""
    return F.timestamp_diff("SECOND", t, as_of) / F.lit(86400.0)


def is_stale(built: Column, provisional: Column, as_of: Column, max_hours: int = 24) -> Column:
    """A product of provisional readings is rebuilt once it is older than `max_hours`."""
    return provisional & (F.timestamp_diff("SECOND", built, as_of) > F.lit(max_hours * 3600))


def expired(modified: Column, as_of: Column, max_age_days: float) -> Column:
    return F.timestamp_diff("SECOND", modified, as_of) > F.lit(max_age_days * 86400.0)
