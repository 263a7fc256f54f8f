"""Structured Streaming forms of the hourly and daily rules.

Streams write through the file sink, whose log makes a replayed batch harmless. Those that list stores or change rows already
written (`append_records`, `upsert_days`) do so batch by batch under the batch's number, which a replay finds done."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldspark.functions import times
from fieldspark.operators import composite
from fieldspark.sources import publish


def read_folder(spark: SparkSession, folder: str, schema: StructType | str, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder as they arrive."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> None:
    """Process everything that has arrived and stop, appending to a parquet folder. Run again with the same
    checkpoint to go on."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.trigger(availableNow=True).start().awaitTermination()


def _timed(stream: DataFrame, time: str, lag: str) -> DataFrame:
    """The stream with a watermark; event time must be an instant, which in a UTC session is the same clock."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lag)


def _clock(t: Column) -> Column:
    return t.cast("timestamp_ntz")


def ready_days(stream: DataFrame, group: Sequence[str], *, time: str = "time", lag: str = "6 hours") -> DataFrame:
    """(group..., day, readings) of a UTC day once data `lag` past its end has arrived."""
    days = _timed(stream, time, lag).groupBy(*group, F.window(time, "1 day")).agg(F.count(F.lit(1)).alias("readings"))
    return days.select(*group, _clock(F.col("window.start")).alias("day"), "readings")


def first_write(stream: DataFrame, key: Sequence[str], *, time: str = "time", lag: str = "6 hours") -> DataFrame:
    """Each (key..., time) once, with its day; arrivals later than the watermark are dropped, so a day that was
    written and closed is never touched again."""
    once = _timed(stream, time, lag).dropDuplicatesWithinWatermark([*key, time])
    return once.withColumns({time: _clock(F.col(time)), "day": F.to_date(time)})


def hourly_mean(stream: DataFrame, key: Sequence[str], *, time: str = "time", value: str = "value", lag: str = "1 hour") -> DataFrame:
    """Mean over [t - 30 min, t + 30 min) of each hour t, emitted when the hour is closed."""
    hours = _timed(stream, time, lag).groupBy(*key, F.window(time, "1 hour", startTime="30 minutes")).agg(F.avg(value).alias(value))
    return hours.select(*key, F.timestamp_add("MINUTE", F.lit(30), _clock(F.col("window.start"))).alias(time), value)


def rolling_composite(stream: DataFrame, days: int, step_days: int, *, lag: str = "1 day") -> DataFrame:
    """The newest valid value per pixel in [end - days, end) for each frame end, emitted when the frame is closed.
    At equal times the sensor listed last wins."""
    valid = _timed(composite.valid_pixels(stream), "time", lag).withColumn("_o", composite.newest(_clock(F.col("time")), F.col("sensor")))
    frames = valid.groupBy(F.window("time", f"{days} days", f"{step_days} days"), "iy", "ix").agg(
        F.max_by("value", "_o").alias("value"), F.max("_o").alias("_o")
    )
    end, order = _clock(F.col("window.end")), F.col("_o")
    return frames.select(
        end.alias("time"), "iy", "ix", "value", times.age_days(composite.newest_time(order), end).alias("age_days"), composite.newest_rank(order).cast(stream.schema["sensor"].dataType).alias("sensor")
    )


def usable_cycles(stream: DataFrame, *, cycle: str = "cycle", lag: str = "7 hours") -> DataFrame:
    """(cycle, rows) of cycles that are at least the posting lag older than the newest one seen."""
    counted = _timed(stream, cycle, lag).groupBy(cycle).agg(F.count(F.lit(1)).alias("rows"))
    return counted.withColumn(cycle, _clock(F.col(cycle)))


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], object], checkpoint: str) -> None:
    """Hand everything that has arrived to `each` in batches with their numbers, and stop."""
    writer = stream.writeStream.foreachBatch(lambda df, number: each(df, number) and None).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def append_records(
    stream: DataFrame, store: Sequence[str], fields: Sequence[str], expected: Column | int, staging: str, checkpoint: str, manifest: str | None = None, *, cells: Sequence[str] = ()
) -> DataFrame:
    """Append hourly records to staging as they come and list each store when its last record is there. Every batch is
    an attempt at publication (`publish.publish`), so a replayed batch, late rows and repeated records change nothing that readers
    get. Returns the verdict on all stores seen, from the log of records. Keep one checkpoint for one staging folder."""
    spark, store = stream.sparkSession, list(store)
    manifest = manifest or staging.rstrip("/") + "-manifest"
    run_batches(stream, lambda df, number: publish.publish(df, store, fields, expected, staging, manifest, number, cells=cells), checkpoint)
    return publish.all_stores(spark, stream.schema, store, expected, staging)


def upsert_batch(df: DataFrame, number: int, table: str, key: Sequence[str], order: Sequence[Column], *, day: str = "day") -> None:
    """Merge a batch into the days that it touches: of each (day, key...) the row with the greatest `order` stays.

    The merged days are written under the batch's number, then listed; readers take the newest listed copy of a day, so
    no row is ever gone, as it would be for a while if a day's files were replaced. A batch that is listed changes nothing when it
    comes again, one that broke off is written anew. Only the touched days are read."""
    spark, listing = df.sparkSession, f"{table}/days/version={number}"
    if publish.finished(spark, listing):
        return
    # Days of a calendar: a few thousand rows at most.
    touched = [r[0] for r in df.select(day).distinct().collect()]
    held = {d: v for d, v in _newest(spark, table, number).items() if d in set(touched)}
    rows = df
    if held:
        paths = [f"{table}/rows/version={v}/{day}={d}" for d, v in held.items()]
        before = spark.read.schema(df.schema).option("basePath", f"{table}/rows").parquet(*paths)
        rows = before.select(*df.columns).unionByName(df)
    rest = [c for c in df.columns if c not in key and c != day]
    best = rows.groupBy(*key, day).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    best = best.select(*key, day, *[F.col(f"_row.{c}").alias(c) for c in rest])
    best.write.mode("overwrite").partitionBy(day).parquet(f"{table}/rows/version={number}")
    spark.createDataFrame([(d,) for d in touched], "day date").write.mode("overwrite").parquet(listing)


def _newest(spark: SparkSession, table: str, before: int | None = None) -> dict[dt.date, int]:
    """The newest listed version of each day, below `before` if given."""
    try:
        listed = spark.read.schema("day date, version long").parquet(f"{table}/days")
    except AnalysisException:  # nothing was listed yet
        return {}
    if before is not None:
        listed = listed.where(F.col("version") < before)
    return {r.day: r.version for r in listed.groupBy("day").agg(F.max("version").alias("version")).collect()}


def upsert_days(stream: DataFrame, table: str, checkpoint: str, key: Sequence[str], order: Sequence[Column], *, day: str = "day") -> None:
    """Everything that has arrived, upserted batch by batch. Work grows with a batch and the days it touches."""
    run_batches(stream, lambda df, number: upsert_batch(df, number, table, key, order, day=day), checkpoint)


def read_days(spark: SparkSession, table: str, schema: StructType, *, day: str = "day") -> DataFrame:
    """The current rows of a table that `upsert_days` keeps."""
    paths = [f"{table}/rows/version={v}/{day}={d}" for d, v in _newest(spark, table).items()]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{table}/rows").parquet(*paths).select(*schema.names)


def quality_order(quality: str = "quality", arrival: str = "arrival", verified: str = "v") -> list[Column]:
    """A verified reading replaces preliminary ones and never goes back; among equals the last arrival stands."""
    return [(F.col(quality) == verified).alias("v"), F.col(arrival).alias("a")]


def upsert_quality(log: DataFrame, key: Sequence[str], *, quality: str = "quality", arrival: str = "arrival", verified: str = "v") -> DataFrame:
    """The current reading of each key from a whole log of arrivals, by `quality_order`. A stream keeps the same by `upsert_days`."""
    rest = [c for c in log.columns if c not in key]
    order = F.struct(*quality_order(quality, arrival, verified))
    best = log.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])
