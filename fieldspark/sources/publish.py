"""Publication: a store becomes visible only when it is complete.

Rows are staged under the number of the attempt that brought them, with a log of the records they make up. Once a store's records
are complete the attempt lists it in the manifest, with the attempt that each record is taken from. Readers join on
that, so rows which come later, a second time, or from an attempt that failed half-way are never seen."""

from __future__ import annotations

import time as clock
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DateType, LongType, StringType, StructType, TimestampNTZType

from fieldspark.functions import geo, keys, times


def records_of(df: DataFrame, store: Sequence[str], fields: Sequence[str], *, time: str = "time", cells: Sequence[str] = ()) -> DataFrame:
    """One row per record (store..., time): whether every field is there, and whether a cell is there twice. `cells` are the
    columns that tell rows of one record apart; without them rows of one time belong together however many they are."""
    if cells:
        df = df.groupBy(*store, time, *cells).agg(*[F.count(c).alias(f"_n_{c}") for c in fields], F.count(F.lit(1)).alias("_rows"))
        have, twice = [F.sum(f"_n_{c}") for c in fields], F.max("_rows") > 1
    else:
        have, twice = [F.count(c) for c in fields], F.lit(False)
    whole = F.lit(True)
    for n in have:
        whole = whole & (n > 0)
    return df.groupBy(*store, time).agg(whole.alias("whole"), twice.alias("repeated"))


def gate_records(records: DataFrame, store: Sequence[str], expected: Column | int, *, time: str = "time", more: Sequence[Column] = ()) -> DataFrame:
    """The verdict on each store from its records, one row per time.

    With n distinct times that share one offset within the hour, last - first == (n - 1) hours holds exactly
    when every step is one hour, so no window over the records is needed."""
    offset = F.pmod(times.micros(F.col(time)), F.lit(times.HOUR_US))
    gate = records.groupBy(*store).agg(
        F.count(F.lit(1)).alias("records"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        (F.min(offset) == F.max(offset)).alias("_same_offset"),
        F.min("whole").alias("_whole"),
        F.max("repeated").alias("_repeated"),
        *more,
    )
    span = times.hours_between(F.col("first_time"), F.col("last_time"))
    hourly = F.col("_same_offset") & (span == (F.col("records") - 1).cast("double"))
    expected = expected if isinstance(expected, Column) else F.lit(expected)
    fault = keys.reason([
        (F.col("records") != expected, "record count"),
        (~hourly, "not hourly"),
        (~F.col("_whole"), "field missing"),
        (F.col("_repeated"), "repeated record"),
    ])
    kept = [c for c in gate.columns if not c.startswith("_")]
    return gate.select(*kept, fault.alias("fault"), fault.isNull().alias("complete"))


def publish_gate(df: DataFrame, store: Sequence[str], fields: Sequence[str], expected: Column | int, *, time: str = "time", cells: Sequence[str] = ()) -> DataFrame:
    """One row per store: records, first and last time, the faults found, and whether it may be published. A
    store passes when it has the expected count of distinct record times, they are exactly an hour apart, no
    record lacks a field, and no cell of a record is there twice. `expected` may use the store's key columns."""
    return gate_records(records_of(df, store, fields, time=time, cells=cells), store, expected, time=time)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a job has written the folder to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def _folder_column(columns: Sequence[str]) -> str:
    """A name for the staged days that no column has."""
    name = "day"
    while name in columns:
        name = "staged_" + name
    return name


def _log(staging: str) -> str:
    return staging.rstrip("/") + "-records"


def _log_schema(like: StructType, store: Sequence[str]) -> StructType:
    out = StructType().add("time", TimestampNTZType()).add("whole", BooleanType()).add("repeated", BooleanType()).add("attempt", LongType())
    for c in store:
        out = out.add(like[c])
    return out


def manifest_schema(like: StructType, store: Sequence[str]) -> StructType:
    """A row for each listed store. `taken` has the attempt of each of its records, `listing` the attempt that listed it."""
    out = StructType()
    for c in store:
        out = out.add(like[c])
    for name, kind in (("records", LongType()), ("first_time", TimestampNTZType()), ("last_time", TimestampNTZType())):
        out = out.add(name, kind)
    taken = ArrayType(StructType().add("time", TimestampNTZType()).add("attempt", LongType()))
    return out.add("taken", taken).add("fault", StringType()).add("complete", BooleanType()).add("listing", LongType())


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows so far; none before anything was written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # the path does not exist yet
        return spark.createDataFrame([], schema)


def publish(
    df: DataFrame, store: str | Sequence[str], fields: Sequence[str], expected: Column | int, staging: str, manifest: str, attempt: int | None = None, *, cells: Sequence[str] = ()
) -> DataFrame:
    """Stage the rows under `attempt`, a number that grows from one attempt to the next (the clock without one), check every
    store that they touch, and list the complete ones. Returns the verdict on the touched stores, readers use `published`.

    Of records that come twice the first whole one counts; a listed store is never listed again. An attempt that has ended changes
    nothing when it is run again; one that broke off starts anew. Of other attempts the log is read, a short row per record, their
    staged rows never. A store with a null key can't be listed."""
    spark = df.sparkSession
    store = [store] if isinstance(store, str) else list(store)
    attempt = clock.time_ns() // 1000 if attempt is None else attempt
    log, done = _log(staging), f"{manifest}/listing={attempt}"
    if not finished(spark, done):
        staged = f"{staging}/attempt={attempt}"
        day = _folder_column(df.columns)
        df.withColumn(day, F.to_date("time")).write.mode("overwrite").partitionBy(day).parquet(staged)
        rows = _read(spark, staged, StructType(list(df.schema)).add(day, DateType()))
        records_of(rows, store, fields, cells=cells).write.mode("overwrite").parquet(f"{log}/attempt={attempt}")
        listed = _read(spark, manifest, manifest_schema(df.schema, store)).where(F.col("listing") < attempt).select(*store)
        gate = _touched_gate(spark, df.schema, store, expected, log, attempt).join(listed, store, "left_anti")
        gate.where("complete").write.mode("overwrite").parquet(done)
    return _touched_gate(spark, df.schema, store, expected, log, attempt).drop("taken")


def _touched_gate(spark: SparkSession, like: StructType, store: list[str], expected: Column | int, log: str, attempt: int) -> DataFrame:
    """The verdict on the stores of an attempt as things stood when it ended."""
    schema = _log_schema(like, store)
    touched = _read(spark, log, schema).where(F.col("attempt") == attempt).select(*store).distinct()
    records = _read(spark, log, schema).where(F.col("attempt") <= attempt).join(touched, store, "left_semi")
    # A whole record goes before one that isn't, then the first to come.
    best = F.min(F.struct((~F.col("whole") | F.col("repeated")).alias("bad"), "attempt", "whole", "repeated")).alias("_r")
    once = records.groupBy(*store, "time").agg(best).select(*store, "time", "_r.attempt", "_r.whole", "_r.repeated")
    return gate_records(once, store, expected, more=[F.collect_list(F.struct("time", "attempt")).alias("taken")])


def all_stores(spark: SparkSession, like: StructType, store: list[str], expected: Column | int, staging: str) -> DataFrame:
    """The verdict on every store in the log: a report, not read while publishing."""
    records = _read(spark, _log(staging), _log_schema(like, store))
    best = F.min(F.struct((~F.col("whole") | F.col("repeated")).alias("bad"), "attempt", "whole", "repeated")).alias("_r")
    once = records.groupBy(*store, "time").agg(best).select(*store, "time", "_r.whole", "_r.repeated")
    return gate_records(once, store, expected)


def published(staged: DataFrame, manifest: DataFrame, store: str | Sequence[str]) -> DataFrame:
    """The rows of listed stores from the attempts that the manifest names, and no others. Should two attempts have listed one store at
    once, the lower number stands."""
    store = [store] if isinstance(store, str) else list(store)
    taken = manifest.groupBy(*store).agg(F.min_by("taken", "listing").alias("taken")).select(*store, F.inline("taken"))
    return staged.join(taken, [*store, "time", "attempt"], "left_semi").drop("attempt")


def read_published(spark: SparkSession, schema: StructType, store: str | Sequence[str], staging: str, manifest: str) -> DataFrame:
    """`published` from the folders, for rows of `schema`; empty before anything was listed."""
    keys_ = [store] if isinstance(store, str) else list(store)
    rows = _read(spark, staging, StructType(list(schema)).add(_folder_column(schema.names), DateType()).add("attempt", LongType()))
    return published(rows, _read(spark, manifest, manifest_schema(schema, keys_)), keys_).select(*schema.names)


def write_archive(days: DataFrame, archive: str, group: Sequence[str]) -> None:
    """Append days not kept yet, one folder per group and day, hours in order within each file."""
    days.sortWithinPartitions(*group, "day", "time").write.mode("append").partitionBy(*group, "day").parquet(archive)


# The version of the item layout and the extension that names how an asset is opened.
STAC_VERSION = "1.0.0"
XARRAY_ASSETS = "https://stac-extensions.github.io/xarray-assets/v1.0.0/schema.json"
ZARR_MEDIA_TYPE = "application/vnd+zarr"


def stac_items(catalog: DataFrame, base_url: str = "", prefix: str = "") -> DataFrame:
    """One JSON feature (STAC item) per finished store of `catalog(store_id, kind, family, west, south, east, north, time_start, time_end)`, and
    where it has them `schema` (else legacy) and `version`. `prefix` stands before the names of the properties that are not STAC's
    own. Longitudes past 180 are wrapped; a store without a box has neither bbox nor geometry."""
    def iso(c: str) -> Column:
        return F.date_format(F.col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def held(c: str) -> Column:
        return F.col(c).cast("string") if c in catalog.columns else F.lit(None).cast("string")

    def wrapped(c: str) -> Column:
        return F.when(F.col(c) > 180, geo.wrap_lon(F.col(c))).otherwise(F.col(c))

    base = base_url.rstrip("/")
    s, n = F.col("south"), F.col("north")
    w, e = wrapped("west"), wrapped("east")
    ring = F.array(F.array(w, s), F.array(e, s), F.array(e, n), F.array(w, n), F.array(w, s))
    bounded = w.isNotNull() & s.isNotNull() & e.isNotNull() & n.isNotNull()
    ident = F.col("store_id").cast("string")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.lit(STAC_VERSION).alias("stac_version"),
        F.array(F.lit(XARRAY_ASSETS)).alias("stac_extensions"),
        ident.alias("id"),
        F.when(bounded, F.array(w, s, e, n)).alias("bbox"),
        F.when(bounded, F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))).alias("geometry"),
        F.struct(
            F.lit(None).cast("string").alias("datetime"),
            iso("time_start").alias("start_datetime"),
            iso("time_end").alias("end_datetime"),
            F.col("kind").alias(prefix + "kind"),
            F.coalesce(held("schema"), F.lit("legacy")).alias(prefix + "schema"),
            F.col("family").alias(prefix + "donor"),
            held("version").alias(prefix + "store_version"),
        ).alias("properties"),
        F.array(
            F.struct(F.lit("self").alias("rel"), F.concat(F.lit(base + "/items/"), ident).alias("href"), F.lit("application/json").alias("type"))
        ).alias("links"),
        F.struct(
            F.struct(
                F.concat(F.lit(base + "/stores/"), ident).alias("href"),
                F.lit(ZARR_MEDIA_TYPE).alias("type"),
                F.array(F.lit("data")).alias("roles"),
                F.struct(F.lit(True).alias("consolidated"), F.lit(2).alias("zarr_format")).alias("xarray:open_kwargs"),
            ).alias("data")
        ).alias("assets"),
    )
    return catalog.select("store_id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def write_json_lines(items: DataFrame, path: str) -> None:
    items.select(F.col("feature").alias("value")).write.mode("errorifexists").text(path)
