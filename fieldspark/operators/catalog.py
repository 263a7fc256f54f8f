"""Catalogue of stores: footprints, coverage, spacing, sameness and thinning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import geo, keys, ordered, times
from fieldspark.functions.scales import finite
from fieldspark.operators import selection, sizes
from fieldspark.session import materialise, spread

# The order keywords are looked for in a store's path and attributes, and in its file stem.
FAMILY_RULES = (
    ("doppio", "Doppio"), ("necofs", "NECOFS"), ("fvcom", "NECOFS"), ("nyofs", "NYOFS"), ("dbofs", "DBOFS"), ("hycom", "HYCOM"),
    ("hrdps", "HRDPS"), ("hrrr", "HRRR"), ("era5", "ERA5"), ("nwps", "NWPS"), ("hfradar", "HF radar"), ("usgs", "USGS rivers"),
    ("regridded_ic", "Regridded IC"),
)
KIND_RULES = (
    ("volume", "ocean volume"), ("obc", "ocean boundary"), ("ic_regrid", "initial condition"), ("ic", "initial condition"),
    ("lev", "atmosphere levels"), ("atm", "atmosphere"), ("bc", "atmosphere"), ("wav", "waves"), ("nwps", "waves"), ("riv", "rivers"),
    ("hfradar", "surface currents (radar)"),
)


def footprints(rows: DataFrame, store: str = "store_id") -> DataFrame:
    """Box, first and last time and record count of each store from its coordinates (lon, lat, time). Longitudes
    past 180 are wrapped and coordinates that are not finite skipped; a store whose coordinates are not positions gets a null box."""
    rows = rows.withColumns({c: F.when(finite(F.col(c)), F.col(c)) for c in ("lon", "lat")})
    lon = F.when(F.col("lon") > 180, F.col("lon") - 360.0).otherwise(F.col("lon"))
    ends = rows.groupBy(store).agg(
        F.min(lon).alias("_w"), F.min("lat").alias("_s"), F.max(lon).alias("_e"), F.max("lat").alias("_n"),
        (F.min("lon") < -180).alias("_under"), (F.max("lon") > 360).alias("_over"),
        F.min("time").alias("time_start"), F.max("time").alias("time_end"), F.count(F.lit(1)).alias("records"),
    )
    ok = ~F.col("_under") & ~F.col("_over") & (F.col("_s") >= -90) & (F.col("_n") <= 90)
    box = [F.when(ok, F.round(c, 4)).alias(n) for c, n in (("_w", "west"), ("_s", "south"), ("_e", "east"), ("_n", "north"))]
    return ends.select(store, *box, "time_start", "time_end", "records")


ATTRIBUTES = ("type", "source", "donor_id", "donor", "schema")


def entries(stores: DataFrame, axes: DataFrame, moments: DataFrame, files: DataFrame) -> DataFrame:
    """Whole catalogue entries, one per row of `stores(store_id, path, attributes map<string,string>)`: box, first and last time,
    records, cadence in hours, family, kind, bytes and number of files; each null where it can't be told.

    `axes(store_id, axis, position, value)` holds each store's lon and lat in order: axes that only count their positions, and
    latitudes past 90 or longitudes outside -180..360, are no places, and then the attribute `bbox` (west,south,east,north) may
    say. `moments(store_id, time)` may be empty for a store: then `target_date`, else `start_time`, is its first and last time.
    `files(store_id, bytes)` are its parts. Axes, times and files are each combined before they are moved; no list of a store is held."""
    good = axes.where(finite(F.col("value")))
    per_axis = good.groupBy("store_id", "axis").agg(
        F.min("value").alias("_least"), F.max("value").alias("_most"),
        ((F.count(F.lit(1)) > 2) & F.bool_and(F.col("value") == F.col("position"))).alias("_index"),
        F.min(F.when(F.col("value") > 180, F.col("value") - 360.0).otherwise(F.col("value"))).alias("_west"),
        F.max(F.when(F.col("value") > 180, F.col("value") - 360.0).otherwise(F.col("value"))).alias("_east"),
    )
    at = {f"{a}{c}": F.max(F.when(F.col("axis") == a, F.col(c))) for a in ("lon", "lat") for c in ("_least", "_most", "_index", "_west", "_east")}
    wide = per_axis.groupBy("store_id").agg(*[c.alias(n) for n, c in at.items()])
    places = ~F.col("lon_index") & F.col("lat_least").between(-90, 90) & F.col("lat_most").between(-90, 90) & (F.col("lon_least") >= -180) & (F.col("lon_most") <= 360)
    named = F.transform(F.split(F.try_element_at("attributes", F.lit("bbox")), ","), lambda v: F.trim(v).try_cast("double"))
    told = F.when((F.size(named) == 4) & ~F.exists(named, lambda v: v.isNull()), named)
    spans = moments.groupBy("store_id").agg(F.min("time").alias("_t0"), F.max("time").alias("_t1"), F.count_distinct("time").alias("records"))
    sizes_ = files.groupBy("store_id").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))
    out = stores.join(wide, "store_id", "left").join(spans, "store_id", "left").join(cadence(moments, ["store_id"]), "store_id", "left").join(sizes_, "store_id", "left")
    said = F.coalesce(*[F.try_element_at("attributes", F.lit(c)).try_cast("timestamp_ntz") for c in ("target_date", "start_time")])
    text = F.concat_ws(" ", "path", *[F.try_element_at("attributes", F.lit(c)) for c in ATTRIBUTES])
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.coalesce(keys.classify_stem(name, KIND_RULES), F.when(F.lower(name).rlike("\\.(grib2?|nc)$"), "raw donor file"))
    box = {"west": ("lon_west", 0), "south": ("lat_least", 1), "east": ("lon_east", 2), "north": ("lat_most", 3)}
    return out.select(
        "store_id", *[F.coalesce(F.when(places, F.round(c, 4)), F.get(told, F.lit(i))).alias(n) for n, (c, i) in box.items()],
        F.coalesce("_t0", said).alias("time_start"), F.coalesce("_t1", said).alias("time_end"), F.coalesce("records", F.lit(0)).alias("records"), F.col("step_h").alias("cadence_h"),
        keys.classify(text, FAMILY_RULES).alias("family"), kind.alias("kind"), "bytes", F.coalesce("files", F.lit(0)).alias("files"),
    )


def coverage(catalog: DataFrame, box: Sequence[float] | None = None) -> DataFrame:
    """Per family and UTC day: hours covered (of 24) and stores. A store's span is listed by day with the hours
    as bits, so hours are never listed one by one and nothing needs a distinct."""
    if box is not None:
        catalog = catalog.where(geo.overlaps(*[F.col(c) for c in ("west", "south", "east", "north")], *box))
    spans = catalog.select("family", times.hour_index(F.col("time_start")).alias("_a"), times.hour_index(F.col("time_end")).alias("_b"))
    first, last = F.floor(F.col("_a") / F.lit(24)).cast("long"), F.floor(F.col("_b") / F.lit(24)).cast("long")
    days = spans.withColumn("_day", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("_a") - F.col("_day") * 24, F.lit(0)).cast("int")
    hi = F.least(F.col("_b") - F.col("_day") * 24, F.lit(23)).cast("int")
    days = days.withColumns({"_lo": lo, "_hi": hi}).withColumn("_bits", F.expr("shiftleft(1L, _hi + 1) - shiftleft(1L, _lo)"))
    return days.groupBy("family", times.from_day(F.col("_day")).alias("day")).agg(
        F.bit_count(F.bit_or("_bits")).cast("int").alias("hours"), F.count(F.lit(1)).alias("stores")
    )


def axis_spacing(axes: DataFrame, axis: str = "axis", value: str = "value", block: float = 1.0) -> DataFrame:
    """Median step between the distinct values of each axis, with their number and mean; steps are selected for all axes at once."""
    distinct = axes.select(axis, value).distinct()
    stepped = ordered.with_neighbours(distinct, [axis], [value], F.floor(F.col(value) / F.lit(block)).cast("long"), next={"_next": value})
    stepped = materialise(stepped.withColumn("_step", F.col("_next") - F.col(value)), "steps")
    step = selection.medians(stepped, [axis], "_step").withColumnRenamed("median", "step")
    whole = stepped.groupBy(axis).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("middle"))
    return whole.join(step, axis, "left").select(axis, "step", "n", "middle")


def resolution(spacing: DataFrame) -> DataFrame:
    """One row (dlon, dlat, metres, label) from the spacing of the axes `lon` and `lat`."""
    pick = {name: F.max(F.when(F.col("axis") == axis, F.col(c))) for name, axis, c in (("dlon", "lon", "step"), ("dlat", "lat", "step"), ("_mid", "lat", "middle"))}
    row = spacing.agg(*[c.alias(n) for n, c in pick.items()])
    metres = (F.col("dlon") * 111320.0 * F.cos(F.radians("_mid")) + F.col("dlat") * 111320.0) / 2.0
    label = F.when(metres >= 1000, F.format_string("~%.0fkm", metres / 1000.0)).otherwise(F.format_string("~%.0fm", metres))
    return row.select("dlon", "dlat", metres.alias("metres"), label.alias("label"))


def cadence(rows: DataFrame, store: Sequence[str], *, time: str = "time") -> DataFrame:
    """Median time step of each store in hours, null for a store of one time; selected for all stores at once."""
    distinct = rows.select(*store, time).distinct()
    stepped = ordered.with_neighbours(distinct, store, [time], times.hour_index(F.col(time)), next={"_next": time})
    stepped = materialise(stepped.withColumn("_step", times.hours_between(F.col(time), F.col("_next"))).select(*store, "_step"), "steps")
    step = selection.medians(stepped, store, "_step").withColumnRenamed("median", "step_h")
    return stepped.select(*store).distinct().join(step, list(store), "left")


def same_cells(rows: DataFrame, window: Sequence[str], file: Sequence[str], cell: Sequence[str]) -> DataFrame:
    """Whether all files of a window hold the same set of cells: per file a count and two order-free hashes of
    its distinct cells, then one comparison per window."""
    distinct = rows.select(*window, *file, *cell).distinct()
    sets = distinct.groupBy(*window, *file).agg(
        F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64(*cell)).alias("_x"), F.sum(F.hash(*cell).cast("long")).alias("_h")
    )
    return sets.groupBy(*window).agg(
        F.count(F.lit(1)).alias("files"),
        F.min("_n").alias("fewest"),
        F.max("_n").alias("most"),
        ((F.min("_n") == F.max("_n")) & (F.min("_x") == F.max("_x")) & (F.min("_h") == F.max("_h"))).alias("same"),
    )


def stride_cells(grid: DataFrame, budget: int) -> DataFrame:
    """Every n-th row and column so that the grid fits the cell budget; never an average."""
    shape = grid.agg((F.max("iy") + 1).alias("_ny"), (F.max("ix") + 1).alias("_nx"))
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("_ny") * F.col("_nx") / F.lit(float(budget)))).cast("int"))
    shape = shape.select(step.alias("stride"))
    return grid.join(sizes.one_row(shape)).where((F.col("iy") % F.col("stride") == 0) & (F.col("ix") % F.col("stride") == 0))


def target_axis(low: float, high: float, step: float, pad: float) -> list[float]:
    """Centres from low - pad through high + pad: index times step, the far end included."""
    n = math.ceil((high - low + 2 * pad + step / 2) / step)
    return [low - pad + k * step for k in range(n)]


def target_grid(requests: DataFrame, step: float, pad: float) -> DataFrame:
    """The padded target grid of every request's box: (request, iy, ix, lon, lat)."""
    def count(low: str, high: str):
        return F.ceil((F.col(high) - F.col(low) + 2 * pad + step / 2) / step).cast("int")

    rows = spread(requests.select("request", "west", "south", "east", "north")).select("request", "west", "south", count("west", "east").alias("_nx"), count("south", "north").alias("_ny"))
    rows = rows.withColumn("iy", F.explode(F.sequence(F.lit(0), F.col("_ny") - 1))).withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("_nx") - 1)))
    return rows.select(
        "request", "iy", "ix", (F.col("west") - pad + F.col("ix") * step).alias("lon"), (F.col("south") - pad + F.col("iy") * step).alias("lat")
    )
