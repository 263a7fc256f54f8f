"""Forecast cycles: planning, point extraction, audit and scoring. Issue and valid time are both kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import ordered, times, winds
from fieldspark.operators import sizes


def newest_cycle(end_valid: Column, as_of: Column, *, lag_hours: int = 7, every: int = 12) -> Column:
    """The last cycle that is both begun by `end_valid` and, at `as_of`, old enough to have been posted."""
    return times.cycle_floor(F.least(end_valid, times.add_hours(as_of, -lag_hours)), every)


def plan_records(hours: DataFrame, held: DataFrame, *, latest: str = "latest", every: int = 12, reach: int = 144) -> DataFrame:
    """Add (cycle, lead) to each row of `hours(time, latest, ...)`: the newest cycle at or before the hour and
    not past `latest` that holds the lead, walking back one cycle at a time to `reach` hours. `held(cycle, lead)`
    lists what complete cycles hold.

    What cycles hold is turned round first: for each valid hour the cycles that reach it, reach / every + 1 at most. An hour then meets
    one row and picks from its list, however many cycles it would have to walk back; hours are never multiplied nor aggregated."""
    cycle, lead = times.hour_index(F.col("cycle")), F.col("lead").cast("long")
    reached = held.where(lead.between(0, reach)).select((cycle + lead).alias("_h"), cycle.alias("_c"))
    # A row for each hour that any cycle reaches; unmarked, the hours would be dealt by a few hundred keys.
    reached = sizes.small(reached.groupBy("_h").agg(F.collect_set("_c").alias("_cycles")), sizes.MOST_NARROW_ROWS)
    newest = F.least(times.hour_index(times.cycle_floor(F.col("time"), every)), times.hour_index(F.col(latest)))
    met = hours.withColumns({"_h": times.hour_index(F.col("time")), "_newest": newest}).join(reached, "_h", "left")
    fits = F.filter("_cycles", lambda c: (c <= F.col("_newest")) & (F.pmod(F.col("_newest") - c, F.lit(every)) == 0))
    return met.withColumn("_cycle", F.array_max(fits)).select(
        *hours.columns, times.from_hour(F.col("_cycle")).alias("cycle"), (F.col("_h") - F.col("_cycle")).cast("int").alias("lead")
    )


def usable_cycles(cycles: DataFrame, as_of: Column, *, cycle: str = "cycle", lag_hours: int = 7) -> DataFrame:
    """Cycles at least the posting lag old."""
    return cycles.where(F.col(cycle) <= times.add_hours(as_of, -lag_hours))


def audit_cycles(df: DataFrame, fields: Sequence[str], leads: int, *, cycle="issue_time", lead="lead_h", field="field") -> DataFrame:
    """Per cycle: leads with every field, and whether leads 1..`leads` are all there. Lead 0 may be missing."""
    per_lead = df.where(F.col(field).isin(list(fields))).groupBy(cycle, lead).agg(F.count_distinct(field).alias("_f"))
    whole = F.col("_f") == len(fields)
    return per_lead.groupBy(cycle).agg(
        F.count(F.lit(1)).alias("leads"),
        F.count_if(whole).alias("whole_leads"),
        F.count_if(whole & F.col(lead).between(1, leads)).alias("forecast_leads"),
        F.sum("_f").alias("field_leads"),
    ).withColumn("complete", F.col("forecast_leads") == leads)


def audit_stores(df: DataFrame, store: Sequence[str], *, time: str = "time") -> DataFrame:
    """Per store: records, first and last time and the largest gap in hours. Each store's series is walked in
    hour-long pieces."""
    records = df.select(*store, time).distinct()
    stepped = ordered.with_neighbours(records, store, [time], times.hour_index(F.col(time)), prev={"_before": time})
    gap = times.hours_between(F.col("_before"), F.col(time))
    return stepped.groupBy(*store).agg(
        F.count(F.lit(1)).alias("records"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.max(gap).alias("largest_gap_h")
    )


def extract_points(grid: DataFrame, weights: DataFrame, leads: Sequence[int]) -> DataFrame:
    """Bitemporal rows (issue_time, valid_time, lead_h, point, field, value) of each point from its weighted
    cells. Leads past a cycle's longest are skipped; a point with a missing cell is null."""
    wanted = grid.where(F.col("lead_h").isin(list(leads)) & (F.col("lead_h") <= times.max_lead(F.col("issue_time"))))
    out = sizes.weighted_cells(wanted, weights, ["iy", "ix"], "point").groupBy("issue_time", "lead_h", "field", "point").agg(
        F.sum(F.col("w") * F.col("value")).alias("_v"), F.count("value").alias("_c"), F.max("_n").alias("_n")
    )
    return out.select(
        "issue_time", times.add_hours(F.col("issue_time"), F.col("lead_h")).alias("valid_time"), "lead_h", "point", "field",
        F.when(F.col("_c") == F.col("_n"), F.col("_v")).alias("value"),
    )


def rotate_points(rows: DataFrame, points: DataFrame, angle: Column, *, u: str = "u10", v: str = "v10") -> DataFrame:
    """Point forecasts with the grid-relative wind pair turned to east and north; `angle` (radians, of the grid's x
    axis from east) is a column over `points(point, ...)`. Other fields pass unchanged."""
    ids = ["issue_time", "valid_time", "lead_h", "point"]
    pair = rows.where(F.col("field").isin(u, v)).groupBy(*ids).agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_{n}") for n, f in (("u", u), ("v", v))]
    )
    east, north = winds.rotate_by(F.col("_u"), F.col("_v"), F.col("_a"))
    turned = pair.join(sizes.small(points.select("point", angle.alias("_a")), sizes.MOST_NARROW_ROWS), "point").select(
        *ids, east.alias(u), north.alias(v)
    ).unpivot(ids, [u, v], "field", "value")
    return rows.where(~F.col("field").isin(u, v)).unionByName(turned)


def score_by_lead(forecast: DataFrame, observed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Error of each lead against observations: count, mean error and root mean square error. Both sides carry
    `value`; `on` ends with the valid time."""
    both = forecast.join(observed.select(*on, F.col("value").alias("_o")), list(on))
    e = F.col("value") - F.col("_o")
    return both.where(F.col("value").isNotNull() & F.col("_o").isNotNull()).groupBy("lead_h").agg(
        F.count(F.lit(1)).alias("n"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse")
    )


def centred_rate(acc: DataFrame, key: Sequence[str], *, time: str = "time", value: str = "value", out: str = "rate") -> DataFrame:
    """Rate centred on each hour from hourly accumulations ending at t and at t + 1 h. Hours whose next hour is
    missing are left out. A self join on the hour, so no window over a cell's series."""
    after = acc.select(*key, times.add_hours(F.col(time), -1).alias(time), F.col(value).alias("_next"))
    return acc.join(after, [*key, time]).select(*key, time, winds.centred_rate(F.col(value), F.col("_next")).alias(out))
