"""Gauge selection on a river network and discharge at the mouth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import keys, times

# Cubic feet to cubic metres, the tolerated excess of gauged over mouth area, the statistics of
# a discharge record (15-minute and daily mean), and the site type of a stream.
CFS_TO_M3S = 0.028316846592
AREA_SLACK = 1.02
DISCHARGE_STATISTICS = ("00011", "00003")
STREAM = "ST"


def candidate_sites(sites: DataFrame, mouths: DataFrame, included: DataFrame | None = None, *, min_share: float = 0.01) -> DataFrame:
    """Every upstream or included site of each mouth with the rule that drops it, null for a candidate. `mouths`
    holds (mouth, area_mouth, include, exclude); included sites skip the type and share rules only, and one that
    is not listed upstream is added when `included(mouth, station, ...)` gives its record."""
    if included is not None:
        sites = sites.unionByName(included.join(sites.select("mouth", "station"), ["mouth", "station"], "left_anti"), allowMissingColumns=True)
    rows = sites.join(mouths.select("mouth", "area_mouth", "include", "exclude"), "mouth")
    pinned = F.array_contains("include", F.col("station"))
    why = keys.reason([
        (F.array_contains("exclude", F.col("station")), "excluded by the mouth entry"),
        (F.col("site_type").isNull(), "no site record"),
        ((F.col("site_type") != STREAM) & ~pinned, F.concat(F.lit("site type "), F.col("site_type"))),
        (F.col("area_sqmi").isNull() | (F.col("area_sqmi") == 0), "no drainage area"),
        ((F.col("area_sqmi") < F.col("area_mouth") * min_share) & ~pinned, "drains under the least share of the mouth's area"),
    ])
    return rows.select("mouth", "station", "area_sqmi", "area_mouth", pinned.alias("pinned"), why.alias("reason"))


def select_gauges(
    sites: DataFrame, mouths: DataFrame, records: DataFrame, below: DataFrame, start: Column, end: Column, *, min_share: float = 0.01, slack_days: int = 1,
    lagged: bool = False,
) -> DataFrame:
    """The lowest gauge on each branch: (mouth, station, area_sqmi, kept, reason). A candidate needs a discharge
    record over the window, and is dropped when another active gauge with a larger area lies downstream; equal
    areas go by station. With `lagged` the window of each mouth is earlier by its `lag_hours`. Included gauges stay, and one without a record carries a reason of its own. `below
    (mouth, station, below)` lists what lies downstream of each site."""
    rows = candidate_sites(sites, mouths, min_share=min_share)
    held = records.where(F.col("statistic").isin(*DISCHARGE_STATISTICS))
    first, last, by = start, F.timestamp_add("DAY", F.lit(-slack_days), end), ["station"]
    if lagged:
        held = held.join(rows.select("mouth", "station"), "station").join(mouths.select("mouth", "lag_hours"), "mouth")
        first, last, by = times.add_hours(first, -F.col("lag_hours")), times.add_hours(last, -F.col("lag_hours")), ["mouth", "station"]
    covering = held.where((F.col("begin_time") <= first) & (F.col("end_time") >= last)).select(*by).distinct().withColumn("_covers", F.lit(True))
    rows = rows.join(covering, by, "left").withColumn(
        "reason",
        F.coalesce("reason", F.when(F.col("_covers").isNull(), F.when(F.col("pinned"), "included gauge without a record").otherwise("no discharge record over the window"))),
    ).drop("_covers")
    active = rows.where(F.col("reason").isNull()).select("mouth", "station", "area_sqmi")
    lower = active.select("mouth", F.col("station").alias("below"), F.col("area_sqmi").alias("_area"))
    larger = (F.col("_area") > F.col("area_sqmi")) | ((F.col("_area") == F.col("area_sqmi")) & (F.col("below") > F.col("station")))
    upstream = (
        active.join(below.select("mouth", "station", "below").distinct(), ["mouth", "station"])
        .join(lower, ["mouth", "below"])
        .where(larger)
        .groupBy("mouth", "station").agg(F.min("below").alias("_below"))
    )
    out = rows.join(upstream, ["mouth", "station"], "left")
    why = F.coalesce("reason", F.when(F.col("_below").isNotNull() & ~F.col("pinned"), F.format_string("upstream of another gauge (%d)", F.col("_below"))))
    return out.select("mouth", "station", "area_sqmi", "area_mouth", why.isNull().alias("kept"), why.alias("reason"))


def mouth_summary(selection: DataFrame) -> DataFrame:
    """Per mouth: gauges kept, gauged area, scale to the mouth, and a fault: no gauge, or gauged area over the
    mouth's by more than the slack."""
    kept = F.col("kept")
    gauged = F.sum(F.when(kept, F.col("area_sqmi")))
    s = selection.groupBy("mouth").agg(
        F.count(F.lit(1)).alias("upstream_sites"), F.count_if(kept).alias("gauges"), gauged.alias("gauged_area"), F.max("area_mouth").alias("area_mouth")
    )
    return s.withColumns({
        "scale_factor": F.try_divide("area_mouth", "gauged_area"),
        "fault": keys.reason([
            (F.col("gauges") == 0, "no gauge"),
            (F.col("gauged_area") > F.col("area_mouth") * AREA_SLACK, "gauged area exceeds the mouth's"),
        ]),
    })


def reason_counts(rows: DataFrame, by: Sequence[str] = (), *, reason: str = "reason") -> DataFrame:
    """Dropped rows per reason, details in brackets left out."""
    short = F.get(F.split(F.col(reason), r" \("), F.lit(0))
    return rows.where(F.col(reason).isNotNull()).groupBy(*by, short.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def fills_counted(hours: DataFrame, by: Sequence[str], *, flag: str = "flag") -> DataFrame:
    """Hours filled per kind."""
    f = F.col(flag)
    return hours.groupBy(*by).agg(
        F.count_if(f == 1).alias("interpolated"), F.count_if(f == 2).alias("daily_mean"), F.count_if(f == 3).alias("climatology_median")
    )


def mouth_report(summary: DataFrame, selection: DataFrame, hours: DataFrame, used: DataFrame, *, quality: str = "quality", verified: str = "v") -> DataFrame:
    """(mouth, gauges, fault, provisional, interpolated, daily_mean, climatology_median, dropped): one row for every mouth of
    `summary`. Of its gauges' `hours(mouth, time, flag)` the worst fill of each hour counts; `used` are the readings they rest on,
    provisional unless verified (never where they carry no quality); `dropped` maps each reason to its number of sites. A row per reason is all
    that is gathered."""
    worst = fills_counted(hours.groupBy("mouth", "time").agg(F.max("flag").alias("flag")), ["mouth"])
    loose = (F.coalesce(F.col(quality) != verified, F.lit(True))) if quality in used.columns else F.lit(False)
    doubt = used.groupBy("mouth").agg(F.bool_or(loose).alias("provisional"))
    why = reason_counts(selection, ["mouth"]).groupBy("mouth").agg(F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("dropped"))
    out = summary.select("mouth", "gauges", "fault").join(worst, "mouth", "left").join(doubt, "mouth", "left").join(why, "mouth", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("interpolated", "daily_mean", "climatology_median")]
    return out.select("mouth", "gauges", "fault", F.coalesce("provisional", F.lit(False)).alias("provisional"), *counts, F.coalesce("dropped", F.create_map().cast("map<string,bigint>")).alias("dropped"))


def _gauge(hourly: DataFrame) -> list[str]:
    return [c for c in ("mouth", "station") if c in hourly.columns]


def apply_lag(hourly: DataFrame, gauges: DataFrame, *, time: str = "time") -> DataFrame:
    """Gauge hours at the time their water reaches the mouth: shifted by the river's lag. Hours without a mouth are those of
    every mouth that their gauge serves."""
    lag = gauges.select("mouth", "station", "lag_hours")
    return hourly.join(lag, _gauge(hourly)).withColumn(time, times.add_hours(F.col(time), F.col("lag_hours"))).drop("lag_hours")


def river_discharge(hourly: DataFrame, gauges: DataFrame, summary: DataFrame, temperature: DataFrame | None = None, *, time: str = "time") -> DataFrame:
    """(mouth, time, discharge in m3/s, fill, temperature): the sum over the kept gauges scaled to the mouth's
    area, the worst fill flag, and the temperature of the largest gauge that has a record. `hourly(station,
    time, value, flag)` covers every hour; an hour that any gauge lacks is null."""
    kept = gauges.where("kept").select("mouth", "station", "area_sqmi")
    total = hourly.join(kept, _gauge(hourly)).groupBy("mouth", time).agg(
        F.sum("value").alias("_q"), F.count("value").alias("_n"), F.max("flag").alias("fill")
    )
    scale = summary.where("gauges > 0").select("mouth", F.col("gauges").alias("_g"), "scale_factor")
    q = F.when(F.col("_n") == F.col("_g"), F.col("_q") * F.col("scale_factor") * CFS_TO_M3S)
    out = total.join(scale, "mouth").select("mouth", time, q.alias("discharge"), F.col("fill").cast("int").alias("fill"))
    if temperature is None:
        return out
    by = _gauge(temperature)
    with_record = temperature.where(F.col("value").isNotNull()).select(*by).distinct()
    chosen = kept.join(with_record, by).groupBy("mouth").agg(
        F.min(F.struct((-F.col("area_sqmi")).alias("a"), F.col("station").alias("station"))).alias("_s")
    ).select("mouth", F.col("_s.station").alias("station"))
    temp = temperature.join(chosen, by).select("mouth", time, F.col("value").alias("temperature"))
    return out.join(temp, ["mouth", time], "left")
