"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions import geo, keys, scales, times, vertical, winds
from fieldspark.operators import catalog, joins, scales as scale_ops
from fieldspark.registry import query
from fieldspark.sources import scan


@query("B1", sql="""
SELECT s.point, d.domain, NOT (s.lon < d.west + 0.2e0 AND s.lat > d.north - 0.3e0) AS but_corner,
       d.west <= s.lon - 0.1e0 AND d.south <= s.lat - 0.1e0 AND d.east >= s.lon + 0.1e0 AND d.north >= s.lat + 0.1e0 AS holds_cell
FROM point s JOIN domain d ON s.lon BETWEEN d.west AND d.east AND s.lat BETWEEN d.south AND d.north""")
def box_predicates(x):
    hit = joins.points_in_boxes(x.point, x.domain)
    lon, lat = F.col("lon"), F.col("lat")
    box = [F.col(c) for c in joins.BOX]
    corner = geo.in_box_but_corner(lon, lat, *box, F.col("west") + 0.2, F.col("north") - 0.3)
    cell = geo.contains(*box, lon - 0.1, lat - 0.1, lon + 0.1, lat + 0.1)
    return hit.select("point", "domain", corner.alias("but_corner"), cell.alias("holds_cell"))


@query("B2", sql="""
WITH s AS (SELECT point, lon - 106e0 AS raw, lat FROM point), w AS (SELECT *, raw - 360 * floor((raw + 180) / 360e0) AS wrapped FROM s)
SELECT point, round(wrapped, 6) AS wrapped, round(raw - 360 * floor(raw / 360e0), 6) AS wrapped_360 FROM w WHERE wrapped >= 178.5e0 OR wrapped <= -178.5e0""")
def seam_filter(x):
    raw = F.col("lon") - 106.0
    hit = x.point.where(geo.seam_filter(raw, 178.5, 181.5))
    return hit.select("point", F.round(geo.wrap_lon(raw), 6).alias("wrapped"), F.round(geo.wrap_360(raw), 6).alias("wrapped_360"))


@query("B3", sql="""
WITH n AS (SELECT p.point, p.lon, p.lat, r.west, r.south, greatest(r.west, least(p.lon, r.east)) AS nlon, greatest(r.south, least(p.lat, r.north)) AS nlat
           FROM point p JOIN request r ON p.point = r.request)
SELECT point, round(2 * 6371 * asin(sqrt(least(1, power(sin(radians(nlat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(nlat)) * power(sin(radians(nlon - lon) / 2), 2)))), 6) AS km,
       round(6371000 * cos(radians(south)) * radians(lon - west), 3) AS x, round(6371000 * radians(lat - south), 3) AS y, round(lon, 6) AS back_lon, round(lat, 6) AS back_lat FROM n""")
def distance_to_box(x):
    rows = x.point.join(x.request.withColumnRenamed("request", "point"), "point")
    km = geo.distance_to_box_km(F.col("lon"), F.col("lat"), *[F.col(c) for c in joins.BOX])
    mx, my = geo.to_local(F.col("lon"), F.col("lat"), F.col("west"), F.col("south"))
    lon, lat = geo.from_local(mx, my, F.col("west"), F.col("south"))
    return rows.select(
        "point", F.round(km, 6).alias("km"), F.round(mx, 3).alias("x"), F.round(my, 3).alias("y"), F.round(lon, 6).alias("back_lon"), F.round(lat, 6).alias("back_lat")
    )


@query("B4", sql="SELECT o_orderkey AS store_id, o_orderdate AS time, o_totalprice AS bytes FROM orders")
def canonical_fields(x):
    return scan.canonical(
        x.orders, {"store_id": ["id", "o_orderkey"], "time": ["ocean_time", "o_orderdate", "o_date"], "bytes": ["o_totalprice", "size"], "salt": ["salinity"]}
    )


@query("B5", sql="""
SELECT time, -layer AS z, round(39 + iy / 10e0, 6) AS lat, round(CASE WHEN ix * 22.5e0 + 5 >= 180 THEN ix * 22.5e0 + 5 - 360 ELSE ix * 22.5e0 + 5 END, 6) AS lon, round(u, 6) AS u FROM grid""")
def normalise_legacy(x):
    legacy = x.grid.select(
        "time", F.col("layer").alias("depth"), (F.lit(39.0) + F.col("iy") / F.lit(10.0)).alias("latitude"), (F.col("ix") * 22.5 + 5.0).alias("longitude"), "u"
    )
    out = scan.normalise(legacy, "legacy")
    return out.select("time", "z", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("u", 6).alias("u"))


@query("B6", sql="SELECT time, layer, iy, ix, round(u, 6) AS u FROM grid WHERE layer IN (1, 5, 7)")
def select_layers(x):
    return scan.select_layers(x.grid, [1, -1, -3, 1], 8).select("time", "layer", "iy", "ix", F.round("u", 6).alias("u"))


@query("B7", sql="""
SELECT time, layer, iy, ix, round(sqrt(u * u + v * v), 6) AS speed, round((temp * 360) + 180 - 360 * floor((temp * 360 + 180) / 360), 6) AS toward,
       round((u + 25) / 100 * sin(radians(v * 30)), 6) AS ue, round((u + 25) / 100 * cos(radians(v * 30)), 6) AS vn FROM grid""")
def speed_dir(x):
    ue, vn = winds.components(F.col("u") + 25.0, F.col("v") * 30.0)
    return x.grid.select(
        "time", "layer", "iy", "ix", F.round(winds.speed(F.col("u"), F.col("v")), 6).alias("speed"),
        F.round(winds.flip_dir(F.col("temp") * 360.0), 6).alias("toward"), F.round(ue, 6).alias("ue"), F.round(vn, 6).alias("vn"),
    )


@query("B8", sql="""
WITH w AS (SELECT event_id, value AS u, lead_h - 10e0 AS v, -75 + point / 2e0 AS lon, 40 + point / 4e0 AS lat FROM forecast),
l AS (SELECT *, radians(sin(radians(38.5e0)) * (lon + 97.5e0)) AS a, radians(lon + 92.597) AS x, radians(lat) AS y, radians(90 - 36.08852) AS th FROM w),
r AS (SELECT *, atan2(cos(y) * sin(x), cos(th) * cos(y) * cos(x) + sin(th) * sin(y)) AS rx, asin(-sin(th) * cos(y) * cos(x) + cos(th) * sin(y)) AS ry FROM l),
q AS (SELECT *, rx + radians(1e-3) AS rx2 FROM r),
g AS (SELECT *, degrees(atan2(cos(ry) * sin(rx), cos(th) * cos(ry) * cos(rx) - sin(th) * sin(ry))) AS lon1, degrees(asin(sin(th) * cos(ry) * cos(rx) + cos(th) * sin(ry))) AS lat1,
      degrees(atan2(cos(ry) * sin(rx2), cos(th) * cos(ry) * cos(rx2) - sin(th) * sin(ry))) AS lon2, degrees(asin(sin(th) * cos(ry) * cos(rx2) + cos(th) * sin(ry))) AS lat2 FROM q),
b AS (SELECT *, atan2(lat2 - lat1, (lon2 - lon1) * cos(radians(lat1))) AS b FROM g)
SELECT event_id, round(cos(a) * u + sin(a) * v, 4) AS u_lambert, round(cos(a) * v - sin(a) * u, 4) AS v_lambert,
       round(cos(b) * u - sin(b) * v, 4) AS u_pole, round(sin(b) * u + cos(b) * v, 4) AS v_pole,
       round(cos(radians(lat)) * u - sin(radians(lat)) * v, 4) AS u_grid, round(sin(radians(lat)) * u + cos(radians(lat)) * v, 4) AS v_grid FROM b""")
def rotate_wind(x):
    import math

    lon, lat = F.lit(-75.0) + F.col("point") / F.lit(2.0), F.lit(40.0) + F.col("point") / F.lit(4.0)
    u, v = F.col("value"), F.col("lead_h") - F.lit(10.0)
    lambert = winds.rotate_by(u, v, winds.lambert_angle(lon, math.sin(math.radians(38.5)), -97.5))
    pole = winds.rotate_by(u, v, winds.rotated_pole_angle(lon, lat, -36.08852, -92.597))
    grid = winds.rotate_by(u, v, F.radians(lat))
    names = ("u_lambert", "v_lambert", "u_pole", "v_pole", "u_grid", "v_grid")
    return x.forecast.select("event_id", *[F.round(c, 4).alias(n) for n, c in zip(names, (*lambert, *pole, *grid))])


@query("B9", sql="""
WITH s AS (SELECT layer, iy, ix, arg_min(temp, time) AS p FROM grid GROUP BY 1, 2, 3)
SELECT g.time, g.layer, g.iy, g.ix, round(-g.u / ((100000 - g.layer * 10000 + s.p * 1000) / (287.05e0 * (280 + g.v)) * 9.80665e0), 6) AS w
FROM grid g JOIN s ON g.layer = s.layer AND g.iy = s.iy AND g.ix = s.ix""")
def omega_to_w(x):
    cell = ["layer", "iy", "ix"]
    static = x.grid.groupBy(*cell).agg(F.min_by("temp", "time").alias("p"))
    pressure = F.lit(100000.0) - F.col("layer") * 10000 + F.col("p") * 1000
    w = winds.omega_to_w(F.col("u"), F.col("v") + 280.0, pressure)
    return x.grid.join(static, cell).select("time", *cell, F.round(w, 6).alias("w"))


@query("B10", sql="""
SELECT time, layer, iy, ix, round(-(layer - 0.5e0) / 7 * (10 + iy + v / 10) + v / 10, 6) AS z,
       round((5 * (-(layer - 0.5e0) / 7) + (10 + iy) * (-power((layer - 0.5e0) / 7, 2))) / (5 + 10 + iy), 6) AS stretched FROM grid""")
def layer_height(x):
    sigma = -(F.col("layer") - 0.5) / 7.0
    h, zeta = F.col("iy") + 10.0, F.col("v") / 10.0
    return x.grid.select(
        "time", "layer", "iy", "ix", F.round(vertical.layer_height(sigma, h, zeta), 6).alias("z"),
        F.round(vertical.stretching(sigma, -sigma * sigma, h, 5.0), 6).alias("stretched"),
    )


@query("B11", sql="""
WITH n AS (SELECT request, west, south, CAST(ceil((east - west + 2 * 0.05e0 + 0.05e0 / 2) / 0.05e0) AS INT) AS nx, CAST(ceil((north - south + 2 * 0.05e0 + 0.05e0 / 2) / 0.05e0) AS INT) AS ny FROM request)
SELECT request, CAST(y.id AS INT) AS iy, CAST(x.id AS INT) AS ix, round(west - 0.05e0 + x.id * 0.05e0, 6) AS lon, round(south - 0.05e0 + y.id * 0.05e0, 6) AS lat
FROM n JOIN range(100) AS y(id) ON y.id < ny JOIN range(100) AS x(id) ON x.id < nx""")
def target_grid(x):
    out = catalog.target_grid(x.request, 0.05, 0.05)
    return out.withColumns({"lon": F.round("lon", 6), "lat": F.round("lat", 6)})


@query("B11", sql="""
SELECT node, CAST(k.id AS INT) AS level, round(-(greatest(1, ceil(h / 2.5e0)) - k.id - 0.5e0) * 2.5e0, 6) AS z FROM mesh_node JOIN range(20) AS k(id) ON k.id < greatest(1, ceil(h / 2.5e0))""")
def z_levels(x):
    rows = x.mesh_node.select("node", F.posexplode(vertical.levels_for_depth(F.col("h"), 2.5)).alias("level", "z"))
    return rows.withColumn("z", F.round("z", 6))


@query("B12", sql="""
SELECT event_id, date_trunc('day', valid_time)::TIMESTAMP + CASE WHEN hour(valid_time) >= 12 THEN INTERVAL '12' HOUR ELSE INTERVAL '0' HOUR END AS cycle,
       valid_time - INTERVAL '1' HOUR AS hour_cycle,
       CASE WHEN hour(issue_time + INTERVAL '1' HOUR * CAST(point AS INT)) % 6 <> 0 THEN 18 ELSE 48 END AS lead_now,
       CASE WHEN hour(issue_time + INTERVAL '1' HOUR * CAST(point AS INT)) % 6 <> 0 THEN 18 ELSE 36 END AS lead_then,
       date_trunc('day', valid_time - INTERVAL '1' HOUR)::TIMESTAMP + INTERVAL '1' DAY AS file_date,
       valid_time + INTERVAL '1' HOUR * CAST((((5 - hour(valid_time)) % 6) + 6) % 6 AS INT) AS nowcast FROM forecast""")
def cycle_calendar(x):
    t = F.col("valid_time")
    c = times.add_hours(F.col("issue_time"), F.col("point"))
    return x.forecast.select(
        "event_id", times.cycle_floor(t).alias("cycle"), times.cycle_for_valid(t).alias("hour_cycle"), times.max_lead(c).alias("lead_now"),
        times.max_lead(F.timestamp_add("YEAR", F.lit(-8), c)).alias("lead_then"), times.file_date(t).alias("file_date"), times.nowcast_cycle(t).alias("nowcast"),
    )


@query("B13", sql="""
SELECT request, start + INTERVAL '1' HOUR * CAST(h.id * 3 - 1 AS INT) AS time FROM request JOIN range(100) AS h(id) ON h.id * 3 - 1 <= hours + 1""")
def frame_times(x):
    return times.frame_times(x.request.select("request", "start", "hours"), "start", "hours", stride=3).select("request", "time")


@query("B14", sql="""
SELECT event_id, date_trunc('hour', ts + INTERVAL '30' MINUTE)::TIMESTAMP AS hour, date_trunc('second', ts + INTERVAL '500' MILLISECOND)::TIMESTAMP AS second,
       TIMESTAMP '2000-01-01 00:00:00' + INTERVAL '1' SECOND * CAST(event_id AS INT) * 20 AS decoded FROM events""")
def round_time(x):
    return x.events.select(
        "event_id", times.round_time(F.col("ts"), "hour").alias("hour"), times.round_time(F.col("ts"), "second").alias("second"),
        times.from_epoch_hours(F.col("event_id") / F.lit(180.0), "2000-01-01 00:00:00").alias("decoded"),
    )


@query("B15", sql="""
WITH m AS (SELECT * FROM (VALUES ('u', -20e0, 20e0, FALSE), ('v', -4e0, 4e0, FALSE), ('temp', 0.1e0, 1e0, TRUE)) AS t(field, lo, hi, log)),
l AS (SELECT time, layer, iy, ix, 'u' AS field, u AS value FROM grid UNION ALL SELECT time, layer, iy, ix, 'v', CASE WHEN iy = 3 THEN NULL ELSE v END FROM grid UNION ALL SELECT time, layer, iy, ix, 'temp', temp FROM grid),
c AS (SELECT l.*, m.lo, m.hi, m.log, CASE WHEN value IS NULL THEN 0 ELSE 1 + CAST(round_even(254 * CASE WHEN log THEN (ln(greatest(lo, least(hi, value))) - ln(lo)) / (ln(hi) - ln(lo)) ELSE (greatest(lo, least(hi, value)) - lo) / (hi - lo) END, 0) AS INT) END AS code
      FROM l JOIN (SELECT field, lo, hi, log FROM m) m USING (field))
SELECT time, layer, iy, ix, field, code, CASE WHEN code > 0 THEN round(CASE WHEN log THEN exp(ln(lo) + (code - 1) / 254e0 * (ln(hi) - ln(lo))) ELSE lo + (code - 1) / 254e0 * (hi - lo) END, 6) END AS decoded FROM c""")
def encode_scale(x):
    meta = x.spark.createDataFrame([("u", -20.0, 20.0, False), ("v", -4.0, 4.0, False), ("temp", 0.1, 1.0, True)], "field string, lo double, hi double, log boolean")
    long = x.grid.withColumn("v", F.when(F.col("iy") != 3, F.col("v"))).unpivot(["time", "layer", "iy", "ix"], ["u", "v", "temp"], "field", "value")
    return scale_ops.encode_fields(long, meta).drop("value").withColumn("decoded", F.round("decoded", 6))


@query("B16", sql="""
SELECT point, round((lon + 75) * (640 / 4e0), 6) AS x, round((44 - lat) * (480 / 5e0), 6) AS y, CAST(floor((lon + 75) * (640 / 4e0)) AS INT) AS px, CAST(floor((44 - lat) * (480 / 5e0)) AS INT) AS py FROM point""")
def to_pixel(x):
    px, py, i, j = geo.to_pixel(F.col("lon"), F.col("lat"), (-75.0, 39.0, -71.0, 44.0), 640, 480)
    return x.point.select("point", F.round(px, 6).alias("x"), F.round(py, 6).alias("y"), i.alias("px"), j.alias("py"))


@query("B17", sql="""
SELECT request, concat('atm_', substr(sha256(concat_ws('_', 'atm', 'v2', printf('%.4f', west), printf('%.4f', south), printf('%.4f', east), printf('%.4f', north),
       strftime(date_trunc('hour', start + INTERVAL '50' MINUTE), '%Y-%m-%d %H:%M:%S'), CAST(hours AS VARCHAR))), 1, 12)) AS id FROM request""")
def request_id(x):
    box = [keys.fixed(F.col(c), 4) for c in joins.BOX]
    hour = F.date_format(times.floor_hour(F.timestamp_add("MINUTE", F.lit(50), F.col("start"))), "yyyy-MM-dd HH:mm:ss")
    return x.request.select("request", keys.request_id("atm", "v2", [*box, hour, F.col("hours")]).alias("id"))


@query("B18", sql="""
SELECT station, arrival, CASE WHEN value IS NULL THEN 'missing value' WHEN parameter NOT IN ('click', 'view', 'purchase') THEN concat('unknown parameter ', parameter)
       WHEN value - 20 < 0 THEN 'negative' WHEN value > 200 THEN 'too large' END AS reason FROM obs""")
def validate_rows(x):
    v = F.col("value")
    checks = [
        (v.isNull(), "missing value"),
        (~F.col("parameter").isin("click", "view", "purchase"), F.concat(F.lit("unknown parameter "), F.col("parameter"))),
        (v - 20 < 0, "negative"),
        (v > 200, "too large"),
    ]
    return scan.validate(x.obs, checks).select("station", "arrival", "reason")


PAGE_RULES = (("/fr/", "French"), ("/en/", "English"), ("ref=", "referred"), ("https", "secure"), ("http", "plain"))


@query("B19", sql="""
SELECT page_id, CASE WHEN contains(lower(url), '/fr/') THEN 'French' WHEN contains(lower(url), '/en/') THEN 'English' WHEN contains(lower(url), 'ref=') THEN 'referred'
       WHEN contains(lower(url), 'https') THEN 'secure' WHEN contains(lower(url), 'http') THEN 'plain' END AS family FROM pages""")
def classify_family(x):
    return x.pages.select("page_id", keys.classify(F.col("url"), PAGE_RULES).alias("family"))


@query("B19", sql="""
SELECT store_id, CASE CAST(store_id % 4 AS INT) WHEN 0 THEN 'ocean boundary' WHEN 1 THEN 'atmosphere' WHEN 2 THEN 'waves' ELSE 'rivers' END AS kind,
       CASE WHEN path LIKE '%high%' THEN 'HYCOM' END AS family FROM catalog""")
def classify_kind(x):
    stem = F.element_at(F.split("path", "/"), -1)
    text = F.when(F.col("path").contains("high"), F.concat(F.lit("HYCOM "), F.col("path"))).otherwise(F.col("path"))
    return x.catalog.select("store_id", keys.classify_stem(stem, catalog.KIND_RULES).alias("kind"), keys.classify(text, catalog.FAMILY_RULES).alias("family"))


@query("B20", sql="""
SELECT store_id, round(datediff('second', time_start, TIMESTAMP '2001-08-02 06:00:00') / 86400e0, 9) AS age_days,
       provisional AND datediff('second', time_start, TIMESTAMP '2001-08-02 06:00:00') > 86400 AS stale,
       datediff('second', time_start, TIMESTAMP '2001-08-02 06:00:00') > 30 * 86400 AS expired FROM catalog""")
def retention(x):
    now = times.ts("2001-08-02 06:00:00")
    t = F.col("time_start")
    return x.catalog.select(
        "store_id", F.round(times.age_days(t, now), 9).alias("age_days"), times.is_stale(t, F.col("provisional"), now).alias("stale"), times.expired(t, now, 30).alias("expired")
    )


@query("B21", sql="""
WITH s AS (SELECT CAST(ceil(sqrt((max(iy) + 1) * (max(ix) + 1) / 300e0)) AS INT) AS n FROM cell)
SELECT iy, ix, greatest(1, n) AS stride FROM cell, s WHERE iy % greatest(1, n) = 0 AND ix % greatest(1, n) = 0""")
def stride_cells(x):
    return catalog.stride_cells(x.cell, 300).select("iy", "ix", "stride")
