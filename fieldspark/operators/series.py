"""Station and cell series: hourly means, gap filling, resampling, runs and contiguity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions import ordered, times
from fieldspark.operators import sizes
from fieldspark.session import materialise

# Fill flags, worst last.
FILL_NONE, FILL_INTERPOLATED, FILL_DAILY_MEAN, FILL_CLIMATOLOGY = 0, 1, 2, 3


# Types whose values do not fit a fixed-width aggregation buffer.
_WIDE = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)


def dedupe(df: DataFrame, key: Sequence[str], order: Sequence[str], keep: str = "last") -> DataFrame:
    """One row per key: the last or the first in `order` (end it with something unique). Aggregates before the
    shuffle; the key's rows are never sorted in one task. With one order column and fixed-width values each value
    is picked by itself, which Spark can do by hash; otherwise the row is picked as a whole."""
    rest = [c for c in df.columns if c not in key]
    pick = {"last": F.max_by, "first": F.min_by}[keep]
    if len(order) == 1 and not any(isinstance(df.schema[c].dataType, _WIDE) for c in rest):
        return df.groupBy(*key).agg(*[pick(c, order[0]).alias(c) for c in rest]).select(*df.columns)
    best = df.groupBy(*key).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def clean(obs: DataFrame, key: Sequence[str], order: Sequence[str], *, value: str = "value", non_negative: bool = True) -> DataFrame:
    """Duplicate times keep the last reading, then missing and (for discharge) negative values are dropped."""
    out = dedupe(obs, key, order, "last").where(F.col(value).isNotNull() & ~F.isnan(value))
    return out.where(F.col(value) >= 0) if non_negative else out


def hourly_centred(obs: DataFrame, key: Sequence[str], *, time: str = "time", value: str = "value") -> DataFrame:
    """Mean over [t - 30 min, t + 30 min) for each hour t with a reading; other hours are absent."""
    return obs.groupBy(*key, times.centred_hour(F.col(time)).alias(time)).agg(F.avg(value).alias(value))


def clean_hourly(
    obs: DataFrame, key: Sequence[str], order: str, *, time: str = "time", value: str = "value", non_negative: bool = True
) -> DataFrame:
    """`clean` and `hourly_centred` in one shuffle: rows move once, by key and hour, and both the duplicates of a
    time and the readings of an hour meet there."""
    rows = obs.select(*key, time, value, order, times.centred_hour(F.col(time)).alias("_hour")).repartition(*key, "_hour")
    once = rows.groupBy(*key, "_hour", time).agg(F.max_by(value, order).alias(value)).where(F.col(value).isNotNull() & ~F.isnan(value))
    if non_negative:
        once = once.where(F.col(value) >= 0)
    return once.groupBy(*key, "_hour").agg(F.avg(value).alias(value)).withColumnRenamed("_hour", time)


def first_valid(df: DataFrame, key: Sequence[str], fields: Sequence[str], order: str) -> DataFrame:
    """Duplicates merged: the first value present, field by field (not the first row)."""
    return df.groupBy(*key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields])


def quality_rollup(obs: DataFrame, key: Sequence[str], *, quality: str = "quality", verified: str = "v") -> DataFrame:
    """Verified only if every reading is; provisional if any is not."""
    ok = F.col(quality) == verified
    return obs.groupBy(*key).agg(
        F.when(F.bool_and(F.coalesce(ok, F.lit(False))), "verified").otherwise("preliminary").alias("quality"),
        F.bool_or(F.coalesce(~ok, F.lit(True))).alias("provisional"),
        F.count(F.lit(1)).alias("readings"),
    )


# Gaps ------------------------------------------------------------------------------------------


def _gaps(hourly: DataFrame, windows: DataFrame, key: Sequence[str], time: str, value: str, pad_hours: int) -> DataFrame:
    """Every hour of each window (`windows(key..., start, end)`), with the measured value where there is one and,
    where not, the measured neighbours and the position and length of the run of missing hours.

    Only measured hours are held as rows, at most one per hour of the window, so a series is short however many
    readings made it. Each measured hour answers for itself and for the missing hours up to the next one, which
    it lists; one opening row per window answers for the hours before the first. There is no full axis to join.

    Hours up to `pad_hours` outside the window bound runs inside it, but only the window's own hours count
    toward a run's length."""
    keys = [*key, "start", "end"]
    first, last = times.hour_index(F.col("start")), times.hour_index(F.col("end"))
    held = hourly.where(F.col(value).isNotNull()).join(windows.select(*keys), list(key)).where(
        F.col(time).between(times.add_hours(F.col("start"), -pad_hours), times.add_hours(F.col("end"), pad_hours))
    ).select(*keys, times.hour_index(F.col(time)).alias("_at"), F.col(value).alias("_v"))
    opening = windows.select(*keys, (first - pad_hours - 1).alias("_at"), F.lit(None).cast("double").alias("_v"))
    series = Window.partitionBy(*keys).orderBy("_at")
    rows = held.unionByName(opening).withColumn("_next", F.lead(F.struct("_at", "_v")).over(series))
    rows = rows.withColumns({
        "_h0": F.when(F.col("_v").isNotNull(), F.col("_at")),
        "_h1": F.col("_next._at"),
        "_v1": F.col("_next._v"),
        "_a": F.greatest(F.col("_at"), first),
        "_b": F.least(F.coalesce(F.col("_next._at") - 1, last), last),
        "_gap": F.greatest(F.col("_at") + 1, first),
    }).where(F.col("_a") <= F.col("_b"))
    listed = rows.withColumn("_h", F.explode(F.sequence("_a", "_b")))
    return listed.select(
        *keys, "_h", F.when(F.col("_h") == F.col("_h0"), F.col("_v")).alias("_v"), "_h0", "_h1", F.col("_v").alias("_v0"), "_v1",
        (F.col("_h") - F.col("_gap") + 1).alias("_pos"), (F.col("_b") - F.col("_gap") + 1).alias("_len"),
    )


def _between() -> Column:
    """The time-linear value between the measured neighbours; null where a side is open."""
    share = (F.col("_h") - F.col("_h0")).cast("double") / (F.col("_h1") - F.col("_h0")).cast("double")
    return F.col("_v0") + (F.col("_v1") - F.col("_v0")) * share


def fill_lookup(hours: DataFrame, daily: DataFrame, normals: DataFrame | None, key: Sequence[str], *, time: str = "time", value: str = "value", flag: str = "flag") -> DataFrame:
    """Hours still empty take the day mean (flag 2), then the day-of-year median (flag 3). `daily(key..., date,
    value)` and `normals(key..., mm_dd, value)` have one row per key and day."""
    d = daily.select(*key, F.col("date").alias("_date"), F.col(value).alias("_daily"))
    out = hours.withColumn("_date", F.to_date(time)).join(d, [*key, "_date"], "left")
    climate = F.lit(None).cast("double")
    if normals is not None:
        n = normals.select(*key, F.col("mm_dd").alias("_md"), F.col(value).alias("_normal"))
        out = out.withColumn("_md", F.date_format("_date", "MM-dd")).join(n, [*key, "_md"], "left")
        climate = F.col("_normal")
    filled = F.coalesce(F.col(value), F.col("_daily"), climate)
    new_flag = (
        F.when(F.col(value).isNotNull(), F.col(flag))
        .when(F.col("_daily").isNotNull(), FILL_DAILY_MEAN)
        .when(climate.isNotNull(), FILL_CLIMATOLOGY)
        .otherwise(F.col(flag))
    )
    return out.select(*[filled.alias(value) if c == value else new_flag.cast("int").alias(flag) if c == flag else F.col(c) for c in hours.columns])


def gap_ladder(
    hourly: DataFrame, windows: DataFrame, key: Sequence[str], max_gap: int, daily: DataFrame, normals: DataFrame | None,
    *, time: str = "time", value: str = "value", strict: bool = False, lookup: Sequence[str] | None = None,
) -> DataFrame:
    """Every hour of each window with a value and a fill flag: measured (0), a bounded run of at most `max_gap`
    hours interpolated (1), the day mean (2), the day-of-year median (3). Hours no rung fills stay null, or are
    an error when `strict`. Day means and medians go by `lookup`, the key where it is not given."""
    rows = _gaps(hourly, windows, key, time, value, max_gap + 1)
    bounded = (F.col("_len") <= max_gap) & F.col("_h0").isNotNull() & F.col("_h1").isNotNull()
    hours = rows.select(
        *key,
        times.from_hour(F.col("_h")).alias(time),
        F.when(F.col("_v").isNotNull(), F.col("_v")).when(bounded, _between()).alias(value),
        F.when(F.col("_v").isNull() & bounded, FILL_INTERPOLATED).otherwise(FILL_NONE).alias("flag"),
    )
    out = fill_lookup(hours, daily, normals, lookup or key, time=time, value=value)
    if strict:
        stop = F.raise_error(F.concat(F.lit("no value for "), F.col(time).cast("string"))).cast("double")
        out = out.withColumn(value, F.coalesce(F.col(value), stop))
    return out


def interpolate_limit(hourly: DataFrame, windows: DataFrame, key: Sequence[str], limit: int, *, time: str = "time", value: str = "value") -> DataFrame:
    """Every hour of each window; only the first `limit` hours of a run bounded on both sides are interpolated,
    whatever the run's length."""
    rows = _gaps(hourly, windows, key, time, value, limit + 1)
    inside = (F.col("_pos") <= limit) & F.col("_h0").isNotNull() & F.col("_h1").isNotNull()
    return rows.select(
        *key, times.from_hour(F.col("_h")).alias(time), F.when(F.col("_v").isNotNull(), F.col("_v")).when(inside, _between()).alias(value)
    )


def resample_hourly(long: DataFrame, cell: Sequence[str], *, step_hours: int = 1, field: str = "field", time: str = "time", value: str = "value") -> DataFrame:
    """Each field on the axis first..last of all fields in steps of `step_hours`, linear between the field's own
    times: those at which any of its cells has data. Every cell of a field has a row for each time of the axis: null before the
    field's first and after its last time, and where the cell has no value at one of the two bracketing times. A field with
    a single time keeps it where it lies on the axis. The axis also counts times at which no cell has a value.

    The input is read once. Both brackets of every target come from one pass, in pieces, over the short list of a field's
    times; a value then goes to the targets between its time's neighbours, so no cell's series is ever ordered."""
    step_us = step_hours * times.HOUR_US
    long = materialise(long.select(field, *cell, time, value), "fields")
    present = long.where(F.col(value).isNotNull())
    seen = materialise(long.groupBy(field, time).agg((F.count(value) > 0).alias("_any")), "steps")
    steps = seen.where("_any").select(field, time)
    year = times.step_index(F.col(time), 8766 * times.HOUR_US)
    pairs = ordered.with_neighbours(steps, [field], [time], year, next={"_t1": time})
    axis = seen.agg(
        times.step_index(F.min(time), step_us).alias("_lo"), times.step_index(F.max(time), step_us).alias("_hi")
    )
    m = times.micros(F.col(time))
    # A target in [t0, t1) belongs to t0; the last time answers only for itself.
    t_from = F.ceil(m / F.lit(float(step_us))).cast("long")
    t_to = F.when(F.col("_t1").isNull(), times.step_index(F.col(time), step_us)).otherwise(
        F.ceil(times.micros(F.col("_t1")) / F.lit(float(step_us))).cast("long") - 1
    )
    spans = pairs.join(sizes.one_row(axis)).withColumns(
        {"_a": F.greatest(t_from, F.col("_lo")), "_b": F.least(t_to, F.col("_hi"))}
    ).where(F.col("_a") <= F.col("_b"))
    target = F.timestamp_add("HOUR", F.col("_k") * step_hours, times.ts(times.EPOCH))
    points = spans.withColumn("_k", F.explode(F.sequence("_a", "_b"))).withColumn("_t", target)
    share = F.timestamp_diff("MICROSECOND", F.col(time), F.col("_t")) / F.timestamp_diff("MICROSECOND", F.col(time), F.col("_t1"))
    points = points.withColumn("_w", F.when(F.col("_t") == F.col(time), 0.0).otherwise(share))
    # Each target takes weight 1 - w of the time before and w of the time after.
    need = F.when(F.col("_w") > 0, 2).otherwise(1)
    legs = points.select(field, F.col("_t"), need.alias("_need"), F.explode(F.array(
        F.struct(F.col(time).alias("at"), (F.lit(1.0) - F.col("_w")).alias("w")),
        F.struct(F.col("_t1").alias("at"), F.col("_w").alias("w")),
    )).alias("_leg")).select(field, "_t", "_need", F.col("_leg.at").alias(time), F.col("_leg.w").alias("_w")).where(F.col("_w") > 0)
    # One row for each cell and target, to which nothing need add up.
    targets = long.select(field, *cell).distinct().join(sizes.one_row(axis)).withColumn("_k", F.explode(F.sequence("_lo", "_hi")))
    blank = targets.select(field, *cell, target.alias("_t"), F.lit(None).cast("double").alias("_p"), F.lit(None).cast("int").alias("_need"))
    # Legs are a few numbers for each field and target.
    met = present.join(sizes.small(legs, sizes.MOST_NARROW_ROWS), [field, time]).select(field, *cell, "_t", (F.col("_w") * F.col(value)).alias("_p"), "_need")
    whole = blank.unionByName(met).groupBy(field, *cell, "_t").agg(F.sum("_p").alias("_v"), F.count("_p").alias("_n"), F.max("_need").alias("_need"))
    return whole.select(field, *cell, F.col("_t").alias(time), F.when(F.col("_n") == F.col("_need"), F.col("_v")).alias(value))


# Runs and contiguity ---------------------------------------------------------------------------


def runs(df: DataFrame, key: Sequence[str], index: str, *, max_gap: int = 1, max_len: int | None = None, block: int = 4096) -> DataFrame:
    """Runs of an integer index (distinct within the key): a new one starts where the step exceeds `max_gap`;
    with `max_len`, runs are cut after that many members. Returns (key..., start, stop, members)."""
    piece = F.floor(F.col(index) / F.lit(block)).cast("long")
    if max_len is not None and max_gap != 1:
        raise ValueError("max_len needs runs of consecutive members")
    marked = ordered.with_run_start(df.select(*key, index), key, index, piece, max_gap, "_run")
    group = [*key, "_run"]
    if max_len is not None:
        marked = marked.withColumn("_cut", F.floor((F.col(index) - F.col("_run")) / F.lit(max_len)).cast("long"))
        group.append("_cut")
    return marked.groupBy(*group).agg(
        F.min(index).alias("start"), F.max(index).alias("stop"), F.count(F.lit(1)).alias("members")
    ).select(*key, "start", "stop", "members")


def contiguity(df: DataFrame, store: Sequence[str], order: str, *, time: str = "time") -> DataFrame:
    """Rows whose time is not exactly one hour after the row before (by `order`, unique in the store)."""
    piece = F.floor(F.col(order) / F.lit(100_000)).cast("long")
    stepped = ordered.with_neighbours(df.select(*store, order, time), store, [order], piece, prev={"before": time})
    step = F.timestamp_diff("SECOND", F.col("before"), F.col(time))
    fault = F.when(step <= 0, "not increasing").when(step != 3600, "not one hour")
    return stepped.withColumn("fault", fault).where(F.col("fault").isNotNull()).select(*store, order, "before", time, "fault")


# Shape -----------------------------------------------------------------------------------------


def to_long(df: DataFrame, ids: Sequence[str], fields: Sequence[str]) -> DataFrame:
    return df.unpivot([F.col(c) for c in ids], [F.col(c) for c in fields], "field", "value")


def to_wide(df: DataFrame, ids: Sequence[str], fields: Sequence[str], *, field: str = "field", value: str = "value") -> DataFrame:
    """One column per field; the list is given, so no pass over the data finds it."""
    return df.groupBy(*ids).agg(*[F.max(F.when(F.col(field) == f, F.col(value))).alias(f) for f in fields])


def missing_counts(df: DataFrame, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Missing and total samples per field."""
    counts = df.groupBy(*by).agg(
        *[F.count_if(F.col(c).isNull()).alias(c) for c in fields], F.count(F.lit(1)).alias("n")
    )
    return counts.unpivot([*[F.col(c) for c in by], F.col("n")], [F.col(c) for c in fields], "field", "n_missing")
