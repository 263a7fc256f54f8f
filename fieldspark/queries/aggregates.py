"""Aggregations: hourly means, discharge, composites, scales, masks, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions import geo, times
from fieldspark.operators import catalog, composite, forecast, mesh, rivers, scales, series
from fieldspark.plans import requests as plans
from fieldspark.queries.joins import SELECT_SQL, LOCATE_SQL, mouths, selection
from fieldspark.registry import query


@query("D1", sql="""
WITH d AS (SELECT station, parameter, time, max_by(value, arrival) AS value FROM obs GROUP BY 1, 2, 3)
SELECT station, parameter, date_trunc('hour', time + INTERVAL '30' MINUTE)::TIMESTAMP AS time, round(avg(value), 6) AS value FROM d WHERE value >= 0 GROUP BY 1, 2, 3""")
def hourly_centred(x):
    return series.clean_hourly(x.obs, ["station", "parameter"], "arrival").withColumn("value", F.round("value", 6))


RIVER_START, RIVER_HOURS = "2024-01-03 00:00:00", 600


def river_inputs(x):
    """Discharge from every reading of a station, day means of its large readings, medians from its very large
    ones (both null where there are none), and temperatures from one parameter."""
    discharge = x.obs.select("station", "time", "value", "quality", "arrival")
    day = F.to_date("time")
    large, huge = (F.avg(F.when(F.col("value") > v, F.col("value"))).alias("value") for v in (40, 120))
    daily = discharge.groupBy("station", day.alias("date")).agg(large)
    days = F.transform(F.sequence(F.lit(1), F.lit(31)), lambda d: F.concat(F.lit("01-"), F.lpad(d.cast("string"), 2, "0")))
    normals = discharge.groupBy("station").agg(huge).withColumn("mm_dd", F.explode(days))
    temperature = x.obs.where(F.col("parameter") == "view").select("station", "time", "value")
    return discharge, daily, normals, temperature


RIVER_SQL = f"""
{SELECT_SQL},
kept AS (SELECT mouth, station, area_sqmi, area_mouth FROM selected WHERE reason IS NULL),
axis AS (SELECT k.mouth, k.station, TIMESTAMP '2024-01-03 00:00:00' + INTERVAL '1' HOUR * CAST(t.id - k.mouth AS INT) AS time FROM kept k CROSS JOIN range(601) AS t(id)),
clean AS (SELECT station, time, max_by(value, arrival) AS value FROM obs GROUP BY 1, 2),
hr AS (SELECT station, date_trunc('hour', time + INTERVAL '30' MINUTE)::TIMESTAMP AS time, avg(value) AS v FROM clean WHERE value >= 0 GROUP BY 1, 2),
pad AS (SELECT k.mouth, h.* FROM hr h JOIN kept k ON h.station = k.station WHERE h.time BETWEEN TIMESTAMP '2024-01-03 00:00:00' - INTERVAL '1' HOUR * CAST(7 + k.mouth AS INT) AND TIMESTAMP '2024-01-28 00:00:00' + INTERVAL '1' HOUR * CAST(7 - k.mouth AS INT)),
uni AS (SELECT mouth, station, time FROM axis UNION SELECT mouth, station, time FROM pad),
f AS (SELECT u.*, p.v, count(p.v) OVER (PARTITION BY u.station ORDER BY u.time) AS g FROM uni u LEFT JOIN pad p ON u.station = p.station AND u.time = p.time),
b AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN time END IGNORE NULLS) OVER p AS t0, last_value(v IGNORE NULLS) OVER p AS v0,
             first_value(CASE WHEN v IS NOT NULL THEN time END IGNORE NULLS) OVER n AS t1, first_value(v IGNORE NULLS) OVER n AS v1,
             count(*) FILTER (WHERE v IS NULL) OVER (PARTITION BY station, g) AS run
      FROM f WINDOW p AS (PARTITION BY station ORDER BY time ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY station ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
r1 AS (SELECT mouth, station, time, CASE WHEN v IS NOT NULL THEN v WHEN run <= 6 AND t0 IS NOT NULL AND t1 IS NOT NULL THEN v0 + (v1 - v0) * datediff('hour', t0, time) / datediff('hour', t0, t1) END AS v,
              CASE WHEN v IS NULL AND run <= 6 AND t0 IS NOT NULL AND t1 IS NOT NULL THEN 1 ELSE 0 END AS flag FROM b),
dm AS (SELECT station, CAST(time AS DATE) AS d, avg(CASE WHEN value > 40 THEN value END) AS v FROM obs GROUP BY 1, 2),
nm AS (SELECT station, avg(CASE WHEN value > 120 THEN value END) AS v FROM obs GROUP BY 1),
filled AS (SELECT r1.mouth, r1.station, r1.time, coalesce(r1.v, dm.v, nm.v) AS value, CASE WHEN r1.v IS NOT NULL THEN flag WHEN dm.v IS NOT NULL THEN 2 WHEN nm.v IS NOT NULL THEN 3 ELSE 0 END AS flag
           FROM r1 JOIN axis a ON r1.station = a.station AND r1.time = a.time LEFT JOIN dm ON r1.station = dm.station AND CAST(r1.time AS DATE) = dm.d LEFT JOIN nm ON r1.station = nm.station),
lagged AS (SELECT mouth, station, time + INTERVAL '1' HOUR * CAST(mouth AS INT) AS time, value, flag FROM filled),
tot AS (SELECT mouth, time, sum(value) AS q, count(value) AS n, max(flag) AS fill FROM lagged GROUP BY 1, 2),
sc AS (SELECT mouth, count(*) AS g, max(area_mouth) / sum(area_sqmi) AS k FROM kept GROUP BY 1),
discharge AS (SELECT t.mouth, t.time, CASE WHEN t.n = s.g THEN t.q * s.k * 0.028316846592e0 END AS discharge, t.fill FROM tot t JOIN sc s ON t.mouth = s.mouth)"""


@query("D2", sql=f"""
WITH {RIVER_SQL},
th AS (SELECT station, date_trunc('hour', time + INTERVAL '30' MINUTE)::TIMESTAMP AS time, avg(value) AS v FROM obs WHERE parameter = 'view' GROUP BY 1, 2),
tpad AS (SELECT k.mouth, h.* FROM th h JOIN kept k ON h.station = k.station WHERE h.time BETWEEN TIMESTAMP '2024-01-03 00:00:00' - INTERVAL '1' HOUR * CAST(7 + k.mouth AS INT) AND TIMESTAMP '2024-01-28 00:00:00' + INTERVAL '1' HOUR * CAST(7 - k.mouth AS INT)),
tuni AS (SELECT mouth, station, time FROM axis UNION SELECT mouth, station, time FROM tpad),
tf AS (SELECT u.*, p.v, count(p.v) OVER (PARTITION BY u.station ORDER BY u.time) AS g FROM tuni u LEFT JOIN tpad p ON u.station = p.station AND u.time = p.time),
tb AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN time END IGNORE NULLS) OVER p AS t0, last_value(v IGNORE NULLS) OVER p AS v0,
              first_value(CASE WHEN v IS NOT NULL THEN time END IGNORE NULLS) OVER n AS t1, first_value(v IGNORE NULLS) OVER n AS v1,
              count(*) FILTER (WHERE v IS NULL) OVER (PARTITION BY station, g ORDER BY time) AS pos
       FROM tf WINDOW p AS (PARTITION BY station ORDER BY time ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY station ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
temp AS (SELECT b.station, b.time, CASE WHEN v IS NOT NULL THEN v WHEN pos <= 6 AND t0 IS NOT NULL AND t1 IS NOT NULL THEN v0 + (v1 - v0) * datediff('hour', t0, b.time) / datediff('hour', t0, t1) END AS v
         FROM tb b JOIN axis a ON a.station = b.station AND a.time = b.time),
ts AS (SELECT mouth, arg_max(station, struct_pack(a := area_sqmi, s := -station)) AS station FROM kept WHERE station IN (SELECT station FROM temp WHERE v IS NOT NULL) GROUP BY 1)
SELECT d.mouth, d.time, round(d.discharge, 5) AS discharge, d.fill, round(t.v, 9) AS temperature FROM discharge d LEFT JOIN ts ON d.mouth = ts.mouth
LEFT JOIN temp t ON t.station = ts.station AND t.time + INTERVAL '1' HOUR * CAST(d.mouth AS INT) = d.time""")
def river_discharge(x):
    """The flagship: gauges -> lag -> hourly means -> gap ladder -> scaled sum at each mouth."""
    discharge, daily, normals, temperature = river_inputs(x)
    out = plans.rivers(
        mouths(x), x.river_site, x.river_record, x.river_below, discharge, daily, normals, temperature,
        RIVER_START, RIVER_HOURS, gauge_window=("1996-06-01 00:00:00", "1999-06-01 00:00:00"),
    )
    return out.discharge.withColumns({"discharge": F.round("discharge", 5), "temperature": F.round("temperature", 9)})


# Records moved to the years of the readings; each mouth's gauges must cover its own, lagged window.
LAGGED_SQL = RIVER_SQL.replace(
    SELECT_SQL[SELECT_SQL.index("covering AS"):SELECT_SQL.index("rule AS")],
    """covering AS (SELECT DISTINCT s.mouth, s.station FROM river_site s JOIN river_record r ON r.station = s.station WHERE statistic IN ('00011', '00003')
             AND r.begin_time + INTERVAL '10227' DAY <= TIMESTAMP '2024-01-03 00:00:00' - INTERVAL '1' HOUR * CAST(s.mouth AS INT)
             AND r.end_time + INTERVAL '10227' DAY >= TIMESTAMP '2024-01-27 00:00:00' - INTERVAL '1' HOUR * CAST(s.mouth AS INT)),
""",
).replace("WHEN s.station NOT IN (SELECT station FROM covering) THEN", "WHEN NOT EXISTS (SELECT 1 FROM covering c WHERE c.mouth = s.mouth AND c.station = s.station) THEN")


@query("D2", "C10", "E16", sql=f"WITH {LAGGED_SQL} SELECT mouth, time, round(discharge, 5) AS discharge, fill FROM discharge")
def river_lagged(x):
    """Each gauge's record must cover the request's window as much earlier as the river takes to its mouth."""
    discharge, daily, normals, _ = river_inputs(x)
    move = lambda c: F.timestamp_add("DAY", F.lit(10227), F.col(c))
    records = x.river_record.withColumns({"begin_time": move("begin_time"), "end_time": move("end_time")})
    out = plans.rivers(mouths(x), x.river_site, records, x.river_below, discharge, daily, normals, None, RIVER_START, RIVER_HOURS)
    return out.discharge.withColumn("discharge", F.round("discharge", 5)).select("mouth", "time", "discharge", "fill")


@query("D3", sql=f"""
WITH {RIVER_SQL} SELECT mouth, count(*) FILTER (WHERE fill = 1) AS interpolated, count(*) FILTER (WHERE fill = 2) AS daily_mean, count(*) FILTER (WHERE fill = 3) AS climatology_median FROM discharge GROUP BY 1""")
def fills_counted(x):
    discharge, daily, normals, _ = river_inputs(x)
    out = plans.rivers(
        mouths(x), x.river_site, x.river_record, x.river_below, discharge, daily, normals, None,
        RIVER_START, RIVER_HOURS, gauge_window=("1996-06-01 00:00:00", "1999-06-01 00:00:00"),
    )
    return rivers.fills_counted(out.discharge, ["mouth"], flag="fill")


@query("D3", "D10", sql=f"""
WITH {RIVER_SQL},
fills AS (SELECT mouth, count(*) FILTER (WHERE fill = 1) AS interpolated, count(*) FILTER (WHERE fill = 2) AS daily_mean, count(*) FILTER (WHERE fill = 3) AS climatology_median FROM discharge GROUP BY 1),
doubt AS (SELECT k.mouth, bool_or(o.quality <> 'v') AS provisional FROM kept k JOIN obs o ON o.station = k.station
          WHERE o.time BETWEEN TIMESTAMP '2024-01-03 00:00:00' - INTERVAL '1' HOUR * CAST(k.mouth AS INT) AND TIMESTAMP '2024-01-28 00:00:00' - INTERVAL '1' HOUR * CAST(k.mouth AS INT) GROUP BY 1),
why AS (SELECT mouth, regexp_replace(reason, ' \\(.*', '') AS reason, count(*) AS n FROM selected WHERE reason IS NOT NULL GROUP BY 1, 2),
drops AS (SELECT mouth, string_agg(reason || ': ' || n, '; ' ORDER BY reason) AS dropped FROM why GROUP BY 1)
SELECT m.mouth, coalesce(provisional, FALSE) AS provisional, coalesce(interpolated, 0) AS interpolated, coalesce(daily_mean, 0) AS daily_mean, coalesce(climatology_median, 0) AS climatology_median, coalesce(dropped, '') AS dropped
FROM (SELECT DISTINCT mouth FROM selected) m LEFT JOIN fills USING (mouth) LEFT JOIN doubt USING (mouth) LEFT JOIN drops USING (mouth)""")
def river_report(x):
    """One row a mouth: what a user has to know of the river's record."""
    discharge, daily, normals, _ = river_inputs(x)
    out = plans.rivers(
        mouths(x), x.river_site, x.river_record, x.river_below, discharge, daily, normals, None,
        RIVER_START, RIVER_HOURS, gauge_window=("1996-06-01 00:00:00", "1999-06-01 00:00:00"),
    )
    lines = F.transform(F.map_entries("dropped"), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string")))
    return out.report.drop("gauges", "fault").withColumn("dropped", F.array_join(F.array_sort(lines), "; "))


@query("D3", sql=f"WITH {SELECT_SQL} SELECT mouth, regexp_replace(reason, ' \\(.*', '') AS reason, count(*) AS n FROM selected WHERE reason IS NOT NULL GROUP BY 1, 2")
def reason_counts(x):
    return rivers.reason_counts(selection(x), ["mouth"])


@query("D4", sql="""
WITH p AS (SELECT * FROM pixel WHERE time <= TIMESTAMP '1999-06-15 12:00:00' AND time >= TIMESTAMP '1999-06-08 12:00:00'),
u AS (SELECT sensor, row_number() OVER (ORDER BY sensor) - 1 AS product_index FROM (SELECT DISTINCT sensor FROM p) a),
r AS (SELECT *, row_number() OVER (PARTITION BY iy, ix ORDER BY time DESC, sensor, value DESC) AS k FROM p WHERE value IS NOT NULL)
SELECT r.iy, r.ix, r.value, round(datediff('second', r.time, TIMESTAMP '1999-06-15 12:00:00') / 86400e0, 9) AS age_days, u.product_index FROM r JOIN u ON r.sensor = u.sensor WHERE k = 1""")
def composite_latest(x):
    return composite.composite(x.pixel, times.ts("1999-06-15 12:00:00"), 7).withColumn("age_days", F.round("age_days", 9))


@query("D5", sql="""
WITH f AS (SELECT CAST(id AS INT) AS frame, TIMESTAMP '1998-01-01 06:00:00' + INTERVAL '5' DAY * CAST(id AS INT) AS e FROM range(60) AS t(id)),
r AS (SELECT f.frame, f.e AS time, p.iy, p.ix, p.value, p.sensor, p.time AS t, row_number() OVER (PARTITION BY f.frame, p.iy, p.ix ORDER BY p.time DESC, p.sensor DESC, p.value DESC) AS k
      FROM pixel p JOIN f ON p.time <= f.e AND p.time >= f.e - INTERVAL '12' DAY WHERE p.value IS NOT NULL)
SELECT frame, time, iy, ix, value, round(datediff('second', t, time) / 86400e0, 9) AS age_days, sensor FROM r WHERE k = 1""")
def composite_series(x):
    return composite.composite_series(x.pixel, "1998-01-01 06:00:00", 5, 60, 12).withColumn("age_days", F.round("age_days", 9))


@query("D6", sql="""
WITH l AS (SELECT 'u' AS field, u AS value, iy + 1e0 AS w FROM grid UNION ALL SELECT 'temp', temp, iy + 1e0 FROM grid UNION ALL SELECT 'v', abs(v), iy + 1e0 FROM grid),
c AS (SELECT field, value, sum(w) OVER (PARTITION BY field ORDER BY value) AS cw, sum(w) OVER (PARTITION BY field) AS total FROM l)
SELECT field, round(CASE WHEN field = 'v' THEN -min(value) FILTER (WHERE cw >= 0.995 * total) ELSE min(value) FILTER (WHERE cw >= 0.01 * total) END, 6) AS lo,
       round(CASE WHEN field = 'v' THEN min(value) FILTER (WHERE cw >= 0.995 * total) ELSE min(value) FILTER (WHERE cw >= 0.99 * total) END, 6) AS hi FROM c GROUP BY 1""")
def shared_scale(x):
    meta = x.spark.createDataFrame([("u", False), ("v", True), ("temp", False)], "field string, symmetric boolean")
    long = x.grid.withColumn("area", F.col("iy") + 1.0).unpivot(["area"], ["u", "v", "temp"], "field", "value")
    out = scales.shared_scale(long, meta)
    return out.withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


@query("D7", sql=f"""
WITH {LOCATE_SQL},
m AS (SELECT *, 6371000 * cos(radians((lat0 + lat1 + lat2) / 3)) AS kx, 6371000e0 AS ky FROM corners)
SELECT elem, round(abs((radians(lon1) - radians(lon0)) * kx * (radians(lat2) - radians(lat0)) * ky - (radians(lon2) - radians(lon0)) * kx * (radians(lat1) - radians(lat0)) * ky) / 2, 0) AS area_m2 FROM m""")
def element_area(x):
    out = mesh.element_area(mesh.element_corners(x.mesh_element, x.mesh_node))
    return out.withColumn("area_m2", F.round("area_m2", 0))


@query("D7", sql="""
WITH e AS (SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM ring WINDOW w AS (PARTITION BY ring ORDER BY seq)),
a AS (SELECT basin, ring, hole, abs(sum(radians(lon2 - lon) * (2 + sin(radians(lat)) + sin(radians(lat2))))) * power(6371.0088e0, 2) / 2 AS km2 FROM e WHERE lon2 IS NOT NULL GROUP BY 1, 2, 3)
SELECT basin, round(sum(CASE WHEN hole THEN -km2 ELSE km2 END) / 2.589988110336e0, 4) AS area_sqmi, count(*) AS rings FROM a GROUP BY 1""")
def ring_area(x):
    return mesh.polygon_area(x.ring, ["basin"]).withColumn("area_sqmi", F.round("area_sqmi", 4))


@query("D8", sql="""
SELECT iy, ix, bool_or(value IS NOT NULL AND l_orderkey % 40 = iy + ix) AS wet, round(avg(CASE WHEN value IS NOT NULL AND l_orderkey % 40 = iy + ix THEN 1e0 ELSE 0e0 END), 6) AS share, count(*) AS steps FROM pixel GROUP BY 1, 2""")
def wet_mask(x):
    value = F.when(F.col("l_orderkey") % 40 == F.col("iy") + F.col("ix"), F.col("value"))
    return composite.wet_mask(x.pixel.withColumn("value", value)).withColumn("share", F.round("share", 6))


@query("D8", sql="""
WITH p AS (SELECT DISTINCT iy, ix FROM pixel), v AS (SELECT iy, ix, max(time) AS t FROM pixel WHERE value IS NOT NULL AND time <= TIMESTAMP '1999-06-15 12:00:00' AND time >= TIMESTAMP '1999-06-08 12:00:00' GROUP BY 1, 2)
SELECT p.iy, count(*) AS pixels, round(avg(CASE WHEN t IS NULL THEN 0e0 ELSE 1e0 END), 6) AS valid_share, round(median(datediff('second', t, TIMESTAMP '1999-06-15 12:00:00') / 86400e0), 9) AS median_age_days FROM p LEFT JOIN v USING (iy, ix) GROUP BY 1""")
def valid_share(x):
    every = x.pixel.select("iy", "ix").distinct()
    best = composite.composite(x.pixel, times.ts("1999-06-15 12:00:00"), 7)
    out = composite.valid_share(every.join(best, ["iy", "ix"], "left"), ["iy"])
    return out.withColumns({"valid_share": F.round("valid_share", 6), "median_age_days": F.round("median_age_days", 9)})


@query("D9", sql="""
WITH h AS (SELECT station, date_trunc('hour', time)::TIMESTAMP AS time, arrival, CASE WHEN parameter = 'click' THEN value END AS u, CASE WHEN quality = 'v' AND parameter <> 'view' THEN value END AS v FROM obs)
SELECT station, time, arg_min(u, arrival) FILTER (WHERE u IS NOT NULL) AS u, arg_min(v, arrival) FILTER (WHERE v IS NOT NULL) AS v FROM h GROUP BY 1, 2""")
def first_valid(x):
    rows = x.obs.select(
        "station", times.floor_hour(F.col("time")).alias("time"), "arrival",
        F.when(F.col("parameter") == "click", F.col("value")).alias("u"), F.when((F.col("quality") == "v") & (F.col("parameter") != "view"), F.col("value")).alias("v"),
    )
    return series.first_valid(rows, ["station", "time"], ["u", "v"], "arrival")


@query("D10", sql="""
SELECT station, parameter, CASE WHEN bool_and(quality = 'v') THEN 'verified' ELSE 'preliminary' END AS quality, bool_or(quality <> 'v') AS provisional, count(*) AS readings FROM obs GROUP BY 1, 2""")
def quality_rollup(x):
    return series.quality_rollup(x.obs, ["station", "parameter"])


@query("D11", sql="""
WITH l AS (SELECT issue_time, lead_h, count(DISTINCT field) AS f FROM forecast GROUP BY 1, 2)
SELECT issue_time, count(*) AS leads, count(*) FILTER (WHERE f = 5) AS whole_leads, count(*) FILTER (WHERE f = 5 AND lead_h BETWEEN 1 AND 12) AS forecast_leads, CAST(sum(f) AS BIGINT) AS field_leads,
       count(*) FILTER (WHERE f = 5 AND lead_h BETWEEN 1 AND 12) = 12 AS complete FROM l GROUP BY 1""")
def audit_cycles(x):
    return forecast.audit_cycles(x.forecast, ["click", "view", "error", "signup", "purchase"], 12)


@query("D11", sql="""
WITH r AS (SELECT DISTINCT station, parameter, time FROM obs), s AS (SELECT *, lag(time) OVER (PARTITION BY station, parameter ORDER BY time) AS p FROM r)
SELECT station, parameter, count(*) AS records, min(time) AS first_time, max(time) AS last_time, round(max(datediff('microsecond', p, time)) / 3600e6, 6) AS largest_gap_h FROM s GROUP BY 1, 2""")
def audit_stores(x):
    return forecast.audit_stores(x.obs, ["station", "parameter"]).withColumn("largest_gap_h", F.round("largest_gap_h", 6))


@query("D12", sql="""
WITH c AS (SELECT store_id, family, time_start + INTERVAL '1' HOUR * CAST(store_id % 24 AS INT) AS a, time_end + INTERVAL '1' HOUR * CAST(store_id % 24 + store_id % 40 AS INT) AS b FROM catalog),
h AS (SELECT store_id, family, unnest(generate_series(date_trunc('hour', a)::TIMESTAMP, date_trunc('hour', b)::TIMESTAMP, INTERVAL '1' HOUR)) AS hr FROM c)
SELECT family, date_trunc('day', hr)::TIMESTAMP AS day, CAST(count(DISTINCT hr) AS INT) AS hours, count(DISTINCT store_id) AS stores FROM h GROUP BY 1, 2""")
def coverage_strip(x):
    spans = x.catalog.withColumns({
        "time_start": times.add_hours(F.col("time_start"), (F.col("store_id") % 24).cast("int")),
        "time_end": times.add_hours(F.col("time_end"), (F.col("store_id") % 24 + F.col("store_id") % 40).cast("int")),
    })
    return catalog.coverage(spans)


@query("D13", sql="""
WITH a AS (SELECT DISTINCT 'lon' AS axis, lon AS v FROM point UNION ALL SELECT DISTINCT 'lat', lat FROM point),
s AS (SELECT axis, v, lead(v) OVER (PARTITION BY axis ORDER BY v) - v AS d FROM a),
m AS (SELECT median(d) FILTER (WHERE axis = 'lon') AS dlon, median(d) FILTER (WHERE axis = 'lat') AS dlat, avg(v) FILTER (WHERE axis = 'lat') AS mid FROM s)
SELECT round(dlon, 6) AS dlon, round(dlat, 6) AS dlat, round((dlon * 111320 * cos(radians(mid)) + dlat * 111320) / 2, 2) AS metres,
       CASE WHEN (dlon * 111320 * cos(radians(mid)) + dlat * 111320) / 2 >= 1000 THEN printf('~%.0fkm', (dlon * 111320 * cos(radians(mid)) + dlat * 111320) / 2000) ELSE printf('~%.0fm', (dlon * 111320 * cos(radians(mid)) + dlat * 111320) / 2) END AS label FROM m""")
def grid_spacing(x):
    axes = x.point.unpivot(["point"], ["lon", "lat"], "axis", "value")
    out = catalog.resolution(catalog.axis_spacing(axes))
    return out.withColumns({"dlon": F.round("dlon", 6), "dlat": F.round("dlat", 6), "metres": F.round("metres", 2)})


@query("D13", sql="""
WITH d AS (SELECT DISTINCT station, time FROM obs), s AS (SELECT *, lead(time) OVER (PARTITION BY station ORDER BY time) AS n FROM d)
SELECT station, round(median(datediff('microsecond', time, n) / 3600e6), 6) AS step_h FROM s GROUP BY 1""")
def cadence(x):
    return catalog.cadence(x.obs, ["station"]).withColumn("step_h", F.round("step_h", 6))


@query("D14", sql="""
WITH g AS (SELECT layer, CASE WHEN iy = 3 THEN NULL ELSE u END AS u, CASE WHEN ix > 12 THEN NULL ELSE v END AS v FROM grid)
SELECT layer, count(*) AS n, 'u' AS field, count(*) FILTER (WHERE u IS NULL) AS n_missing FROM g GROUP BY 1 UNION ALL SELECT layer, count(*), 'v', count(*) FILTER (WHERE v IS NULL) FROM g GROUP BY 1""")
def n_missing(x):
    rows = x.grid.select("layer", F.when(F.col("iy") != 3, F.col("u")).alias("u"), F.when(F.col("ix") <= 12, F.col("v")).alias("v"))
    return series.missing_counts(rows, ["u", "v"], ["layer"])


@query("D15", sql="""
WITH p AS (SELECT *, 6371000 * cos(radians(39.7e0)) * radians(lon + 74.3e0) AS x, 6371000 * radians(lat - 39.7e0) AS y FROM track),
b AS (SELECT min(x) FILTER (WHERE alive) AS lx, max(x) FILTER (WHERE alive) AS hx, min(y) FILTER (WHERE alive) AS ly, max(y) FILTER (WHERE alive) AS hy, min(z) FILTER (WHERE alive) AS lz, max(z) FILTER (WHERE alive) AS hz FROM p),
s AS (SELECT (lx + hx) / 2 AS ox, (ly + hy) / 2 AS oy, (lz + hz) / 2 AS oz, greatest((hx - lx) / 2 / 32767, 1e-6) AS sx, greatest((hy - ly) / 2 / 32767, 1e-6) AS sy, greatest((hz - lz) / 2 / 32767, 1e-6) AS sz FROM b)
SELECT obs, CASE WHEN alive THEN CAST(round_even((x - ox) / sx, 0) AS INT) ELSE 0 END AS code_x, CASE WHEN alive THEN CAST(round_even((y - oy) / sy, 0) AS INT) ELSE 0 END AS code_y,
       CASE WHEN alive THEN CAST(round_even((z - oz) / sz, 0) AS INT) ELSE 0 END AS code_z, round(ox, 4) AS offset_x, round(sx, 6) AS scale_x FROM p, s""")
def quantize_track(x):
    out = scales.quantize_track(x.track, -74.3, 39.7)
    return out.select("obs", "code_x", "code_y", "code_z", F.round("offset_x", 4).alias("offset_x"), F.round("scale_x", 6).alias("scale_x"))


@query("D16", sql="""
WITH c AS (SELECT DISTINCT layer, time, iy % 4 AS iy, ix % 2 AS ix FROM grid), f AS (SELECT layer, time, count(*) AS n, string_agg(concat(iy, '/', ix), ',' ORDER BY iy, ix) AS cells FROM c GROUP BY 1, 2)
SELECT layer, count(*) AS files, min(n) AS fewest, max(n) AS most, min(cells) = max(cells) AS same FROM f GROUP BY 1""")
def same_cells(x):
    rows = x.grid.select("layer", "time", (F.col("iy") % 4).alias("iy"), (F.col("ix") % 2).alias("ix"))
    return catalog.same_cells(rows, ["layer"], ["time"], ["iy", "ix"])


@query("D17", sql="""
WITH m AS (SELECT iy, layer, round(CAST(sum(-layer * 2 + iy * 4) AS DOUBLE) / count(*) / 4 - 4, 2) AS z_mean FROM grid GROUP BY 1, 2)
SELECT iy, layer, z_mean, row_number() OVER (PARTITION BY iy ORDER BY z_mean DESC, layer) - 1 AS index, printf('%.1f m deep', greatest(0, -z_mean)) AS label FROM m""")
def layer_summary(x):
    rows = x.grid.select("iy", "layer", ((-F.col("layer") * 2 + F.col("iy") * 4) / F.lit(4.0) - 4.0).alias("z"))
    return scales.layer_summary(rows, ["iy"])


@query("D18", sql="""
SELECT station, date_trunc('hour', time)::TIMESTAMP AS time, max(value) FILTER (WHERE parameter = 'click') AS click, max(value) FILTER (WHERE parameter = 'view') AS view, max(value) FILTER (WHERE parameter = 'error') AS error,
       max(value) FILTER (WHERE parameter = 'signup') AS signup, max(value) FILTER (WHERE parameter = 'purchase') AS purchase FROM obs GROUP BY 1, 2""")
def pivot_fields(x):
    rows = x.obs.select("station", times.floor_hour(F.col("time")).alias("time"), "parameter", "value")
    return series.to_wide(rows, ["station", "time"], ["click", "view", "error", "signup", "purchase"], field="parameter")
