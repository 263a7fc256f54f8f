"""The request verbs, each one declarative plan from tables to a publishable result."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import times
from fieldspark.operators import composite, forecast, joins, rivers as river_ops, series, vertical, weights
from fieldspark.session import materialise
from fieldspark.sources import scan


@dataclass(frozen=True)
class RiverResult:
    """Discharge per mouth and hour, the gauge selection with reasons, a summary per mouth, and a report per mouth: its fault, whether any
    reading it rests on is provisional, hours filled of each kind, and how many sites each reason dropped."""

    discharge: DataFrame
    selection: DataFrame
    summary: DataFrame
    report: DataFrame


def rivers(
    mouths: DataFrame, sites: DataFrame, records: DataFrame, below: DataFrame, readings: DataFrame, daily: DataFrame, normals: DataFrame | None,
    temperature: DataFrame | None, start: str, hours: int, *, gauge_window: tuple[str, str] | None = None, max_gap: int = 6, min_share: float = 0.01, strict: bool = False,
) -> RiverResult:
    """Gauges of each mouth, their hourly series with gaps filled, and the scaled sum at the mouth for start ..
    start + hours. A gauge is read earlier by its river's lag, and one that serves several mouths is read for each; its record
    has to cover what is read, or `gauge_window` where that is given."""
    begin, end = times.ts(start), times.add_hours(times.ts(start), hours)
    if gauge_window:
        selected = river_ops.select_gauges(sites, mouths, records, below, times.ts(gauge_window[0]), times.ts(gauge_window[1]), min_share=min_share)
    else:
        selected = river_ops.select_gauges(sites, mouths, records, below, begin, end, min_share=min_share, lagged=True)
    # A short list that the summary, the windows and the sum all need: written once, not derived in each.
    selection = materialise(selected.join(mouths.select("mouth", "lag_hours"), "mouth"), "gauges")
    summary = river_ops.mouth_summary(selection)
    gauges = selection.where("kept")
    key = ["mouth", "station"]
    since = times.add_hours(begin, -F.col("lag_hours"))
    windows = gauges.select(*key, since.alias("start"), times.add_hours(since, hours).alias("end"))
    lags = selection.agg(F.min("lag_hours"), F.max("lag_hours")).first()
    # Readings that can bear on any window: the ladder looks max_gap + 1 hours around it, an hourly mean half an hour more.
    around = max_gap + 2
    low, high = times.add_hours(begin, -around - int(lags[1] or 0)), times.add_hours(end, around - int(lags[0] or 0))
    stations = gauges.select("station").distinct()

    def in_reach(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("time").between(low, high)).join(stations, "station", "left_semi")

    def of_mouths(hourly: DataFrame) -> DataFrame:
        return hourly.join(gauges.select(*key), "station")

    hourly = of_mouths(series.clean_hourly(in_reach(readings), ["station"], "arrival"))
    filled = series.gap_ladder(hourly, windows, key, max_gap, daily, normals, strict=strict, lookup=["station"])
    at_mouth = river_ops.apply_lag(filled, gauges)
    temp = None
    if temperature is not None:
        t = of_mouths(series.hourly_centred(in_reach(temperature), ["station"]))
        # Needed twice: for which gauges have a record, and for the values.
        temp = materialise(river_ops.apply_lag(series.interpolate_limit(t, windows, key, max_gap), gauges), "temperature")
    discharge = river_ops.river_discharge(at_mouth, gauges, summary, temp)
    used = in_reach(readings).join(windows, "station").where(F.col("time").between(F.col("start"), F.col("end")))
    return RiverResult(discharge, selection, summary, river_ops.mouth_report(summary, selection, at_mouth, used))


def satellite(pixels: DataFrame, as_of: Column, days: int, coast_steps: int) -> DataFrame:
    """Newest valid value of each pixel of the window, without the water along the shore. A pixel no sensor saw
    in the window counts as land."""
    every = pixels.select("iy", "ix").distinct()
    best = every.join(composite.composite(pixels, as_of, days), ["iy", "ix"], "left")
    return composite.mask_coast(best, coast_steps)


def parent_ocean(
    requests: DataFrame, donors: DataFrame, delivered: DataFrame, field: DataFrame, cell_weights: DataFrame, start: str, end: str, levels: Sequence[float], *, layer_z: Column, bed: Column
) -> tuple[DataFrame, DataFrame]:
    """(donor choice, field on target cells and fixed heights): the donor of each request, then the window's
    layers regridded by sparse weights and interpolated to `levels`. `field` carries (time, layer, iy, ix, value);
    `layer_z` and `bed` are columns over (layer, target)."""
    choice = joins.rank_donors(requests, donors, delivered).where("chosen").select("request", "domain")
    window = scan.scan_window(field, start, end)
    on_target = weights.apply_weights(window, cell_weights, ["time", "layer"], ["value"])
    columns = vertical.build_columns(on_target.withColumn("z", layer_z), ["time", "target"])
    return choice, vertical.sigma_to_z(columns, ["time", "target"], levels, bed)


def donor_fields(
    requests: DataFrame, donors: DataFrame, field: DataFrame, cell_weights: DataFrame, targets: DataFrame, start: str, end: str, records: int, levels: Sequence[float],
    *, layer_z: Column, bed: Column,
) -> tuple[DataFrame, DataFrame]:
    """(donor of each request, its field): every request is served by the best ranked donor whose domain contains it and that delivers the
    whole window, and by that one only.

    `field` carries (domain, time, layer, iy, ix, value), `cell_weights` (domain, target, iy, ix, w), `targets` (request, target). A donor
    delivers when it has all `records` times of [start, end); one that has fewer is passed over for the next, as a whole: no
    request gets some hours from one donor and some from another. `fallback` says that the first choice did not deliver; a request
    without any donor has no row. Fields of donors that nobody chose are not regridded, and of a chosen one each target once, however many requests share it."""
    window = scan.scan_window(field, start, end)
    whole = window.groupBy("domain").agg(F.count_distinct("time").alias("_n")).where(F.col("_n") == records).select("domain")
    ranked = materialise(joins.rank_donors(requests, donors), "ranked")
    delivers = ranked.join(whole, "domain", "left_semi")
    choice = delivers.groupBy("request").agg(F.min_by("domain", "rank").alias("domain"), (F.min("rank") > 1).alias("fallback"))
    choice = materialise(choice, "chosen")
    used = choice.join(targets, "request").select("domain", "target").distinct()
    asked = cell_weights.join(used, ["domain", "target"], "left_semi").withColumn("pair", F.struct("domain", "target"))
    cells = window.join(used.select("domain").distinct(), "domain", "left_semi")
    on_target = weights.apply_weights(cells, asked.select("domain", "iy", "ix", "pair", "w"), ["time", "layer"], ["value"], cell=("domain", "iy", "ix"), target="pair")
    on_target = on_target.select("time", "layer", "pair.domain", "pair.target", "value")
    key = ["time", "domain", "target"]
    columns = vertical.build_columns(on_target.withColumn("z", layer_z), key)
    fields = vertical.sigma_to_z(columns, key, levels, bed)
    served = choice.select("request", "domain").join(targets, "request")
    return choice, served.join(fields, ["domain", "target"])


def waves(requests: DataFrame, cycles: DataFrame, as_of: Column, *, fields: Sequence[str], leads: int = 144, every: int = 12) -> DataFrame:
    """The cycle and lead that serve each record of each request: complete and posted cycles only. `cycles` has
    (cycle, lead, field)."""
    usable = forecast.usable_cycles(cycles, as_of)
    complete = forecast.audit_cycles(usable, fields, leads, cycle="cycle", lead="lead").where("complete").select("cycle")
    held = usable.select("cycle", "lead").distinct().join(complete, "cycle", "left_semi")
    hours = times.frame_times(requests, "start", "hours")
    latest = forecast.newest_cycle(times.add_hours(F.col("start"), F.col("hours")), as_of, every=every)
    return forecast.plan_records(hours.withColumn("latest", latest), held, every=every, reach=leads)


def trajectory(track: DataFrame, grid: DataFrame, lon: weights.Axis, lat: weights.Axis, start: str, step_hours: int, steps: int, levels: Sequence[float], values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(values along the track, missing counts per variable)."""
    out = weights.interpolate_track(track, grid, lon, lat, start, step_hours, steps, levels, values)
    return out, series.missing_counts(out, values)
