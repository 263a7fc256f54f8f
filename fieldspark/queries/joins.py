"""Joins: points and boxes, donors, cycles, weights, meshes, gauges."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions import times
from fieldspark.operators import forecast, joins, mesh, rivers, weights
from fieldspark.plans import requests as plans
from fieldspark.registry import query

LOCATE_SQL = """
corners AS (SELECT e.elem, a.lon AS lon0, b.lon AS lon1, c.lon AS lon2, a.lat AS lat0, b.lat AS lat1, c.lat AS lat2, a.h AS h0, b.h AS h1, c.h AS h2, e.n0, e.n1, e.n2
            FROM mesh_element e JOIN mesh_node a ON e.n0 = a.node JOIN mesh_node b ON e.n1 = b.node JOIN mesh_node c ON e.n2 = c.node)"""


def bary_sql(points: str) -> str:
    """Candidate elements of `points` with their weights."""
    return f"""
bary AS (SELECT p.*, c.elem, h0, h1, h2, ((lat1 - lat2) * (lon - lon2) + (lon2 - lon1) * (lat - lat2)) / ((lat1 - lat2) * (lon0 - lon2) + (lon2 - lon1) * (lat0 - lat2)) AS b0,
                ((lat2 - lat0) * (lon - lon2) + (lon0 - lon2) * (lat - lat2)) / ((lat1 - lat2) * (lon0 - lon2) + (lon2 - lon1) * (lat0 - lat2)) AS b1
         FROM {points} p JOIN corners c ON lon >= least(lon0, lon1, lon2) - 1e-8 AND lon <= greatest(lon0, lon1, lon2) + 1e-8 AND lat >= least(lat0, lat1, lat2) - 1e-8 AND lat <= greatest(lat0, lat1, lat2) + 1e-8)"""


@query("C1", sql="""
WITH hit AS (SELECT r.request, s.site FROM request r JOIN site s ON s.lon BETWEEN r.west AND r.east AND s.lat BETWEEN r.south AND r.north),
none AS (SELECT * FROM request WHERE request NOT IN (SELECT request FROM hit)),
far AS (SELECT n.*, s.site, s.lon, s.lat, greatest(west, least(lon, east)) AS nlon, greatest(south, least(lat, north)) AS nlat FROM none n CROSS JOIN (SELECT * FROM site WHERE site IN (3, 7)) s)
SELECT request, site, TRUE AS within_box, 0e0 AS distance_km FROM hit
UNION ALL
SELECT request, site, FALSE, round(2 * 6371 * asin(sqrt(least(1, power(sin(radians(nlat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(nlat)) * power(sin(radians(nlon - lon) / 2), 2)))), 1) FROM far""")
def points_in_boxes(x):
    return joins.stations_for_boxes(x.site, x.request, "request", [3, 7])


@query("C2", sql="""
WITH r AS (SELECT q.request, d.domain, (d.east - d.west) * (d.north - d.south) AS area, d.resolution_m FROM request q JOIN domain d ON d.west <= q.west AND d.south <= q.south AND d.east >= q.east AND d.north >= q.north),
k AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY area, resolution_m, domain) AS rank, resolution_m > 100 AS got FROM r)
SELECT request, domain, round(area, 6) AS area, resolution_m, rank, coalesce(got AND rank = min(rank) FILTER (WHERE got) OVER (PARTITION BY request), FALSE) AS chosen FROM k""")
def rank_donors(x):
    delivered = joins.rank_donors(x.request, x.domain).where("resolution_m > 100")
    return joins.rank_donors(x.request, x.domain, delivered).withColumn("area", F.round("area", 6))


@query("C3", sql="""
WITH h AS (SELECT request, unnest(generate_series(start - INTERVAL '1' HOUR, start + INTERVAL '1' HOUR * (hours + 1), INTERVAL '1' HOUR)) AS time,
                  least(start + INTERVAL '1' HOUR * hours, TIMESTAMP '2024-01-19 20:00:00') AS e FROM request),
l AS (SELECT request, time, date_trunc('day', e)::TIMESTAMP + CASE WHEN hour(e) >= 12 THEN INTERVAL '12' HOUR ELSE INTERVAL '0' HOUR END AS latest FROM h),
held AS (SELECT valid_time, list(DISTINCT issue_time) AS cycles FROM forecast WHERE lead_h BETWEEN 0 AND 36 GROUP BY 1),
p AS (SELECT l.*, list_max(list_filter(cycles, lambda c: c <= latest)) AS cycle FROM l LEFT JOIN held ON valid_time = time)
SELECT request, time, latest, cycle, CAST(datediff('hour', cycle, time) AS INT) AS lead FROM p""")
def plan_records(x):
    hours = times.frame_times(x.request.select("request", "start", "hours"), "start", "hours")
    latest = forecast.newest_cycle(times.add_hours(F.col("start"), F.col("hours")), times.ts("2024-01-20 03:00:00"))
    hours = hours.select("request", "time", latest.alias("latest"))
    held = x.forecast.select(F.col("issue_time").alias("cycle"), F.col("lead_h").alias("lead"))
    return forecast.plan_records(hours, held, reach=36).select("request", "time", "latest", "cycle", "lead")


@query("C4", sql="""
WITH n AS (SELECT point, count(*) AS n FROM forecast_weights GROUP BY 1),
s AS (SELECT g.issue_time, g.lead_h, g.field, w.point, sum(w.w * g.value) AS v, count(g.value) AS c FROM forecast_grid g JOIN forecast_weights w ON g.iy = w.iy AND g.ix = w.ix WHERE g.lead_h IN (0, 6, 12, 18, 24) GROUP BY 1, 2, 3, 4)
SELECT s.issue_time, s.issue_time + INTERVAL '1' HOUR * s.lead_h AS valid_time, s.lead_h, s.point, s.field, CASE WHEN s.c = n.n THEN round(v, 6) END AS value FROM s JOIN n ON s.point = n.point""")
def extract_points(x):
    return forecast.extract_points(x.forecast_grid, x.forecast_weights, [0, 6, 12, 18, 24]).withColumn("value", F.round("value", 6))


@query("C5", sql="""
WITH d AS (SELECT p.point, c.iy, c.ix, sqrt(power((c.lon - p.lon) * 111.32e0 * cos(radians(p.lat)), 2) + power((c.lat - p.lat) * 110.57e0, 2)) AS km FROM point p JOIN cell c ON c.wet AND abs(c.lat - p.lat) < 0.2 AND abs(c.lon - p.lon) < 0.4),
r AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY round(km, 9), iy, ix) AS r FROM d WHERE km <= 12),
w AS (SELECT *, CASE WHEN min(km) OVER (PARTITION BY point) < 1e-6 THEN CASE WHEN r = 1 THEN 1e0 ELSE 0e0 END ELSE 1 / (km * km) END AS raw FROM r WHERE r <= 4)
SELECT point, iy, ix, round(km, 6) AS km, round(raw / sum(raw) OVER (PARTITION BY point), 6) AS w FROM w""")
def idw_weights(x):
    out = weights.idw_weights(x.point, x.cell.where("wet"), 4, 12.0)
    return out.withColumns({"km": F.round("km", 6), "w": F.round("w", 6)})


@query("C6", sql="""
WITH n AS (SELECT target, count(*) AS n FROM weights GROUP BY 1),
s AS (SELECT g.time, g.layer, w.target, sum(w.w * g.u) AS u, count(g.u) AS cu, sum(w.w * g.temp) AS temp, count(g.temp) AS ct FROM grid g JOIN weights w ON g.iy = w.iy AND g.ix = w.ix GROUP BY 1, 2, 3)
SELECT s.time, s.layer, s.target, CASE WHEN cu = n THEN round(u, 8) END AS u, CASE WHEN ct = n THEN round(temp, 8) END AS temp FROM s JOIN n ON s.target = n.target""")
def apply_weights(x):
    out = weights.apply_weights(x.grid, x.weights, ["time", "layer"], ["u", "temp"])
    return out.withColumns({"u": F.round("u", 8), "temp": F.round("temp", 8)})


@query("C7", sql=f"""
WITH {LOCATE_SQL}, {bary_sql('point')},
hit AS (SELECT *, 1 - b0 - b1 AS b2 FROM bary WHERE b0 >= -1e-9 AND b1 >= -1e-9 AND 1 - b0 - b1 >= -1e-9),
one AS (SELECT point, min(elem) AS elem, arg_min(b0, elem) AS b0, arg_min(b1, elem) AS b1, arg_min(b2, elem) AS b2 FROM hit GROUP BY 1)
SELECT p.point, o.elem, round(o.b0, 6) + 0 AS b0, round(o.b1, 6) + 0 AS b1, round(o.b2, 6) + 0 AS b2 FROM point p LEFT JOIN one o ON p.point = o.point""")
def locate_points(x):
    corners = mesh.element_corners(x.mesh_element, x.mesh_node)
    out = mesh.locate(x.point, corners)
    return out.select("point", "elem", *[(F.round(b, 6) + 0.0).alias(b) for b in ("b0", "b1", "b2")])


EDGES_SQL = """
edges AS (SELECT elem, 0 AS k, least(n1, n2) AS a, greatest(n1, n2) AS b FROM mesh_element UNION ALL SELECT elem, 1, least(n2, n0), greatest(n2, n0) FROM mesh_element
          UNION ALL SELECT elem, 2, least(n0, n1), greatest(n0, n1) FROM mesh_element),
nb AS (SELECT e.elem, e.k, coalesce(max(f.elem), -1) AS neighbour FROM edges e LEFT JOIN edges f ON e.a = f.a AND e.b = f.b AND e.elem <> f.elem GROUP BY 1, 2)"""


@query("C8", sql=f"WITH {EDGES_SQL} SELECT elem, k, neighbour FROM nb")
def edge_neighbours(x):
    return mesh.neighbours(x.mesh_element).select("elem", "k", "neighbour")


SUBSET = (-74.0, 39.3, -72.5, 42.0)


@query("C9", sql=f"""
WITH {LOCATE_SQL}, {EDGES_SQL},
sub AS (SELECT elem, n0, n1, n2 FROM corners WHERE (lon0 + lon1 + lon2) / 3 BETWEEN -74 AND -72.5 AND (lat0 + lat1 + lat2) / 3 BETWEEN 39.3 AND 42),
code AS (SELECT elem, k, CASE WHEN neighbour = -1 THEN -1 WHEN neighbour IN (SELECT elem FROM sub) THEN neighbour ELSE -2 END AS c FROM nb WHERE elem IN (SELECT elem FROM sub))
SELECT s.*, max(c) FILTER (WHERE k = 0) AS nb0, max(c) FILTER (WHERE k = 1) AS nb1, max(c) FILTER (WHERE k = 2) AS nb2 FROM sub s JOIN code USING (elem) GROUP BY ALL""")
def subset_mesh(x):
    return mesh.subset_mesh(x.mesh_element, x.mesh_node, SUBSET)[0]


@query("C9", sql=f"""
WITH {LOCATE_SQL}, {EDGES_SQL},
sub AS (SELECT elem, n0, n1, n2 FROM corners WHERE (lon0 + lon1 + lon2) / 3 BETWEEN -74 AND -72.5 AND (lat0 + lat1 + lat2) / 3 BETWEEN 39.3 AND 42),
used AS (SELECT n0 AS node FROM sub UNION SELECT n1 FROM sub UNION SELECT n2 FROM sub),
one AS (SELECT a, b FROM edges GROUP BY 1, 2 HAVING count(*) = 1)
SELECT node, lon, lat, h, node IN (SELECT a FROM one) OR node IN (SELECT b FROM one) AS on_boundary, row_number() OVER (ORDER BY node) - 1 AS local FROM mesh_node WHERE node IN (SELECT node FROM used)""")
def subset_nodes(x):
    return mesh.export_ids(mesh.subset_mesh(x.mesh_element, x.mesh_node, SUBSET)[1], "node")


WINDOW = ("1996-06-01 00:00:00", "1999-06-01 00:00:00")


def mouths(x):
    """River mouths: the gauge at each root is excluded, and mouth 2 pins one gauge."""
    pinned = F.when(F.col("mouth") == 2, F.array(F.lit(12).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return x.river_site.groupBy("mouth").agg((F.max("area_sqmi") * 1.2).alias("area_mouth")).select(
        "mouth", "area_mouth", pinned.alias("include"), F.array(F.col("mouth").cast("long")).alias("exclude"), F.col("mouth").alias("lag_hours")
    )


def selection(x):
    return rivers.select_gauges(x.river_site, mouths(x), x.river_record, x.river_below, times.ts(WINDOW[0]), times.ts(WINDOW[1]))


SELECT_SQL = """
area AS (SELECT mouth, max(area_sqmi) * 1.2e0 AS area_mouth FROM river_site GROUP BY 1),
covering AS (SELECT DISTINCT station FROM river_record WHERE statistic IN ('00011', '00003') AND begin_time <= TIMESTAMP '1996-06-01 00:00:00' AND end_time >= TIMESTAMP '1999-05-31 00:00:00'),
rule AS (SELECT s.mouth, s.station, s.area_sqmi, a.area_mouth, s.mouth = 2 AND s.station = 12 AS pinned,
                CASE WHEN s.station = s.mouth THEN 'excluded by the mouth entry'
                     WHEN s.site_type <> 'ST' AND NOT (s.mouth = 2 AND s.station = 12) THEN concat('site type ', s.site_type)
                     WHEN s.area_sqmi IS NULL THEN 'no drainage area'
                     WHEN s.area_sqmi < 0.01 * a.area_mouth AND NOT (s.mouth = 2 AND s.station = 12) THEN 'drains under the least share of the mouth''s area'
                     WHEN s.station NOT IN (SELECT station FROM covering) THEN CASE WHEN s.mouth = 2 AND s.station = 12 THEN 'included gauge without a record' ELSE 'no discharge record over the window' END END AS why
         FROM river_site s JOIN area a ON s.mouth = a.mouth),
act AS (SELECT * FROM rule WHERE why IS NULL),
up AS (SELECT s.mouth, s.station, min(b.below) AS below FROM act s JOIN river_below b ON s.mouth = b.mouth AND s.station = b.station
       JOIN act l ON l.mouth = b.mouth AND l.station = b.below AND (l.area_sqmi > s.area_sqmi OR (l.area_sqmi = s.area_sqmi AND l.station > s.station)) GROUP BY 1, 2),
selected AS (SELECT r.mouth, r.station, r.area_sqmi, r.area_mouth, coalesce(why, CASE WHEN below IS NOT NULL AND NOT pinned THEN concat('upstream of another gauge (', below, ')') END) AS reason
             FROM rule r LEFT JOIN up ON r.mouth = up.mouth AND r.station = up.station)"""


@query("C10", "F6", sql=f"WITH {SELECT_SQL} SELECT mouth, station, area_sqmi, area_mouth, reason IS NULL AS kept, reason FROM selected")
def select_gauges(x):
    return selection(x)


@query("C10", sql=f"""
WITH {SELECT_SQL}
SELECT mouth, count(*) AS upstream_sites, count(*) FILTER (WHERE reason IS NULL) AS gauges, round(sum(area_sqmi) FILTER (WHERE reason IS NULL), 6) AS gauged_area, max(area_mouth) AS area_mouth,
       round(max(area_mouth) / sum(area_sqmi) FILTER (WHERE reason IS NULL), 6) AS scale_factor,
       CASE WHEN count(*) FILTER (WHERE reason IS NULL) = 0 THEN 'no gauge' WHEN sum(area_sqmi) FILTER (WHERE reason IS NULL) > max(area_mouth) * 1.02 THEN 'gauged area exceeds the mouth''s' END AS fault
FROM selected GROUP BY 1""")
def mouth_summary(x):
    out = rivers.mouth_summary(selection(x))
    return out.withColumns({"gauged_area": F.round("gauged_area", 6), "scale_factor": F.round("scale_factor", 6)})


@query("C11", sql="""
WITH l AS (SELECT parameter, date_trunc('day', time)::TIMESTAMP + INTERVAL '1' HOUR * CAST(CASE parameter WHEN 'view' THEN 3 * floor(hour(time) / 3e0) WHEN 'error' THEN 6 * floor(hour(time) / 6e0) WHEN 'signup' THEN 12 * floor(hour(time) / 12e0) ELSE hour(time) END AS INT) AS time, station, max(value) AS v FROM obs GROUP BY 1, 2, 3),
w AS (SELECT time, station, max(v) FILTER (parameter = 'click') AS click, max(v) FILTER (parameter = 'view') AS view, max(v) FILTER (parameter = 'error') AS error,
             max(v) FILTER (parameter = 'signup') AS signup, max(v) FILTER (parameter = 'purchase') AS purchase FROM l GROUP BY 1, 2),
s AS (SELECT max(t0) AS t0, min(t1) AS t1 FROM (SELECT parameter, min(time) AS t0, max(time) AS t1 FROM l GROUP BY 1) a)
SELECT w.* FROM w, s WHERE time BETWEEN t0 AND t1""")
def merge_fields(x):
    hour = times.hour_index(F.col("time"))

    def every(name, step):
        rows = x.obs.where(F.col("parameter") == name)
        return rows.groupBy(times.from_hour(hour - F.pmod(hour, F.lit(step))).alias("time"), "station").agg(F.max("value").alias("value"))

    cadences = {"click": 1, "view": 3, "error": 6, "signup": 12, "purchase": 1}
    return joins.merge_fields({name: every(name, step) for name, step in cadences.items()}, ["time", "station"])


def windows_of(x):
    start = times.add_hours(F.col("start"), -10)
    return x.request.select("request", start.alias("start"), times.add_hours(start, F.col("hours")).alias("end"))


SPLIT_SQL = """
r AS (SELECT request, start - INTERVAL '10' HOUR AS start, start - INTERVAL '10' HOUR + INTERVAL '1' HOUR * hours AS "end" FROM request),
s AS (SELECT *, lead(start) OVER (ORDER BY start) AS nxt, min(start) OVER () AS first FROM segment),
piece AS (SELECT r.request, s.segment, greatest(r.start, s.start) AS piece_start, least(r."end", coalesce(s.nxt, r."end")) AS piece_end, s.tidal
          FROM r JOIN s ON s.start < r."end" AND (s.nxt IS NULL OR s.nxt > r.start) WHERE r.start >= s.first)"""


@query("C12", sql=f"WITH {SPLIT_SQL} SELECT * FROM piece")
def split_window(x):
    return joins.split_window(windows_of(x), x.segment)


@query("C12", sql=f"""
WITH {SPLIT_SQL} SELECT request, CASE WHEN bool_and(tidal) THEN 'included' WHEN bool_or(tidal) THEN 'mixed' ELSE 'none' END AS tides, count(*) AS n_pieces FROM piece GROUP BY 1""")
def tidal_content(x):
    return joins.tidal_content(joins.split_window(windows_of(x), x.segment))


@query("C12", sql="""
WITH s AS (SELECT segment, start, lead(start) OVER (ORDER BY start) AS nxt FROM segment),
h AS (SELECT station, date_trunc('hour', time)::TIMESTAMP AS time, max(value) AS value FROM obs GROUP BY 1, 2),
c AS (SELECT h.*, s.segment FROM h JOIN s ON h.time >= s.start AND (s.nxt IS NULL OR h.time <= s.nxt))
SELECT station, time, max(segment) AS segment, max(value) AS value FROM c GROUP BY 1, 2""")
def stitch_segments(x):
    hourly = x.obs.groupBy("station", times.floor_hour(F.col("time")).alias("time")).agg(F.max("value").alias("value"))
    span = hourly.agg(F.min("time").alias("start"), times.add_hours(F.max("time"), 1).alias("end")).withColumn("request", F.lit(0))
    pieces = joins.split_window(span, x.segment)
    # Each piece is read with both ends, so the time of a switch comes twice.
    copies = joins.overlap_join(hourly.withColumn("until", F.col("time")), pieces, ("time", "until"), ("piece_start", "piece_end"), times.DAY_US)
    return joins.stitch(copies.select("station", "time", "segment", "value"), ["station", "time"], "segment")


VOLUME_AXES = (
    weights.Axis(-75.0, 0.5, 4), weights.Axis(39.0, 0.5, 4), "1995-01-01 00:00:00", 2160, 28, [-7.0, -6.0, -5.0, -4.0, -3.0, -2.0, -1.0], ["u"],
)
TRACK_SQL = """
WITH p AS (SELECT trajectory_id, obs, (lon + 75) / 0.5e0 AS fx, (lat - 39) / 0.5e0 AS fy, datediff('hour', TIMESTAMP '1995-01-01', time) / 2160e0 AS ft, least(z, -1) + 7 AS fz FROM track),
b AS (SELECT *, least(2, floor(fx)) AS x0, least(2, floor(fy)) AS y0, least(26, floor(ft)) AS t0, least(5, floor(fz)) AS z0 FROM p WHERE fx BETWEEN 0 AND 3 AND fy BETWEEN 0 AND 3 AND ft BETWEEN 0 AND 27 AND fz >= 0),
c AS (SELECT trajectory_id, obs, t0 + a.id AS it, z0 + d.id AS iz, y0 + e.id AS iy, x0 + f.id AS ix,
             abs(1 - a.id - (ft - t0)) * abs(1 - d.id - (fz - z0)) * abs(1 - e.id - (fy - y0)) * abs(1 - f.id - (fx - x0)) AS w
      FROM b CROSS JOIN range(2) AS a(id) CROSS JOIN range(2) AS d(id) CROSS JOIN range(2) AS e(id) CROSS JOIN range(2) AS f(id)),
s AS (SELECT c.trajectory_id, c.obs, sum(c.w * v.u) AS u, count(*) AS n FROM c JOIN volume v ON c.it = v.it AND 7 - c.iz = v.iz AND c.iy = v.iy AND c.ix = v.ix GROUP BY 1, 2)"""


@query("C14", sql=f"{TRACK_SQL} SELECT t.trajectory_id, t.obs, CASE WHEN s.n = 16 THEN round(s.u, 6) END AS u FROM track t LEFT JOIN s ON t.trajectory_id = s.trajectory_id AND t.obs = s.obs")
def interpolate_track(x):
    out, _ = plans.trajectory(x.track, x.volume.withColumn("iz", 7 - F.col("iz")), *VOLUME_AXES)
    return out.select("trajectory_id", "obs", F.round("u", 6).alias("u"))


@query("C14", "D14", sql=f"{TRACK_SQL} SELECT 'u' AS field, count(*) AS n, count(*) FILTER (WHERE s.n IS NULL OR s.n < 16) AS n_missing FROM track t LEFT JOIN s ON t.trajectory_id = s.trajectory_id AND t.obs = s.obs")
def trajectory_missing(x):
    return plans.trajectory(x.track, x.volume.withColumn("iz", 7 - F.col("iz")), *VOLUME_AXES)[1]


@query("C14", sql="""
SELECT trajectory_id, round(min(lon) - 0.1e0, 6) AS west, round(min(lat) - 0.1e0, 6) AS south, round(max(lon) + 0.1e0, 6) AS east, round(max(lat) + 0.1e0, 6) AS north,
       min(time) - INTERVAL '1' HOUR AS start, CAST(datediff('hour', min(time), max(time)) + 2 AS INT) AS hours FROM track GROUP BY 1""")
def track_windows(x):
    out = weights.track_windows(x.track)
    return out.withColumns({c: F.round(c, 6) for c in joins.BOX})


@query("C15", sql="""
WITH d AS (SELECT p.point, s.site, round(power((s.lon - p.lon) * cos(radians(p.lat)), 2) + power(s.lat - p.lat, 2), 12) AS d2 FROM point p CROSS JOIN site s),
r AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY d2, site) AS r FROM d)
SELECT point, site, round(d2, 9) AS d2 FROM r WHERE r = 1""")
def nearest_site(x):
    return joins.nearest_site(x.point, x.site).withColumn("d2", F.round("d2", 9))


@query("C16", sql="""
WITH p AS (SELECT DISTINCT -75 + (l_partkey % 40) / 10e0 + (l_suppkey % 7 - 3) * 0.02e0 AS lon, 39 + (l_orderkey % 50) / 10e0 + (l_linenumber - 4) * 0.02e0 AS lat FROM lineitem),
d AS (SELECT p.lon, p.lat, c.iy, c.ix, row_number() OVER (PARTITION BY p.lon, p.lat ORDER BY abs(c.lon - p.lon) + abs(c.lat - p.lat), c.iy, c.ix) AS r
      FROM p JOIN cell c ON abs(c.lon - p.lon) <= 0.05e0 AND abs(c.lat - p.lat) <= 0.05e0)
SELECT round(p.lon, 6) AS lon, round(p.lat, 6) AS lat, d.iy, d.ix FROM p LEFT JOIN d ON p.lon = d.lon AND p.lat = d.lat AND d.r = 1""")
def snap_pixels(x):
    lon = F.lit(-75.0) + (F.col("l_partkey") % 40) / F.lit(10.0) + (F.col("l_suppkey") % 7 - 3) * 0.02
    lat = F.lit(39.0) + (F.col("l_orderkey") % 50) / F.lit(10.0) + (F.col("l_linenumber") - 4) * 0.02
    pixels = x.lineitem.select(lon.alias("lon"), lat.alias("lat")).distinct()
    out = joins.snap_pixels(pixels, x.cell, 0.1)
    return out.withColumns({"lon": F.round("lon", 6), "lat": F.round("lat", 6)})


SAMPLE_SQL = """
c AS (SELECT line, avg(lon) AS lon0, avg(lat) AS lat0 FROM line GROUP BY 1),
v AS (SELECT l.line, seq, lon0, lat0, 6371000 * cos(radians(lat0)) * radians(lon - lon0) AS x, 6371000 * radians(lat - lat0) AS y FROM line l JOIN c ON l.line = c.line),
g AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM v WINDOW w AS (PARTITION BY line ORDER BY seq)),
u AS (SELECT *, sqrt(power(x1 - x, 2) + power(y1 - y, 2)) AS d FROM g WHERE x1 IS NOT NULL),
cum AS (SELECT *, sum(d) OVER (PARTITION BY line ORDER BY seq) - d AS c0, sum(d) OVER (PARTITION BY line) AS total FROM u),
k AS (SELECT cum.*, CAST(t.id AS INT) AS k, total * t.id / 19e0 AS dist, row_number() OVER (PARTITION BY line, t.id ORDER BY seq DESC) AS r FROM cum JOIN range(20) AS t(id) ON c0 <= total * t.id / 19e0 + 1e-6),
sample AS (SELECT line, k, dist AS distance, lon0 + degrees((x + (x1 - x) * least(1, (dist - c0) / d)) / (6371000 * cos(radians(lat0)))) AS lon, lat0 + degrees((y + (y1 - y) * least(1, (dist - c0) / d)) / 6371000) AS lat FROM k WHERE r = 1)"""


@query("E8", sql=f"WITH {SAMPLE_SQL} SELECT line, k, round(distance, 3) AS distance, round(lon, 6) AS lon, round(lat, 6) AS lat FROM sample")
def sample_line(x):
    out = mesh.sample_line(x.line, 20)
    return out.withColumns({"distance": F.round("distance", 3), "lon": F.round("lon", 6), "lat": F.round("lat", 6)})


@query("C17", sql=f"""
WITH {SAMPLE_SQL}, {LOCATE_SQL}, {bary_sql('sample')},
hit AS (SELECT *, 1 - b0 - b1 AS b2 FROM bary WHERE b0 >= -1e-9 AND b1 >= -1e-9 AND 1 - b0 - b1 >= -1e-9),
one AS (SELECT line, k, min(elem) AS elem, arg_min(-(b0 * h0 + b1 * h1 + b2 * h2), elem) AS bed FROM hit GROUP BY 1, 2)
SELECT s.line, s.k, round(s.distance, 3) AS distance, round(s.lon, 6) AS lon, round(s.lat, 6) AS lat, o.elem, round(o.bed, 4) AS bed, f.layer, round(f.value, 6) AS value
FROM sample s LEFT JOIN one o ON s.line = o.line AND s.k = o.k LEFT JOIN mesh_field f ON o.elem = f.elem""")
def section_sample(x):
    corners = mesh.element_corners(x.mesh_element, x.mesh_node, ("lon", "lat", "h"))
    out = mesh.section(x.line, corners, x.mesh_field, 20)
    return out.select(
        "line", "k", F.round("distance", 3).alias("distance"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "elem", F.round("bed", 4).alias("bed"), "layer", F.round("value", 6).alias("value")
    )


@query("C18", sql="""
WITH r AS (SELECT *, TIMESTAMP '1995-01-01 00:00:00' + INTERVAL '1' DAY * CAST(request % 2000 AS INT) AS t0, TIMESTAMP '1995-01-21 00:00:00' + INTERVAL '1' DAY * CAST(request % 2000 AS INT) AS t1 FROM request)
SELECT r.request, c.store_id FROM r JOIN catalog c ON c.west <= r.east AND c.east >= r.west AND c.south <= r.north AND c.north >= r.south AND c.time_start <= r.t1 AND c.time_end >= r.t0
WHERE c.family IN ('F', 'O') AND c.kind = 'waves'""")
def search_catalog(x):
    start = F.timestamp_add("DAY", (F.col("request") % 2000).cast("int"), times.ts("1995-01-01 00:00:00"))
    requests = x.request.select("request", *joins.BOX, start.alias("time_start"), F.timestamp_add("DAY", F.lit(20), start).alias("time_end"))
    return joins.search_catalog(x.catalog, requests, families=["F", "O"], kind="waves")


@query("C19", sql="""
WITH f AS (SELECT l_partkey AS node, CAST(l_suppkey % 3 AS INT) AS layer, CASE WHEN min(l_quantity) < 20 THEN CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) END AS value FROM lineitem GROUP BY 1, 2),
r AS (SELECT elem, unnest([n0, n1, n2]) AS node FROM mesh_element)
SELECT layer, elem, CASE WHEN count(value) = 3 THEN round(avg(value), 6) END AS value FROM r JOIN f ON r.node = f.node GROUP BY 1, 2""")
def node_to_element(x):
    mean = F.sum(F.col("l_quantity").cast("long")).cast("double") / F.count(F.lit(1))
    field = x.lineitem.groupBy(F.col("l_partkey").alias("node"), (F.col("l_suppkey") % 3).cast("int").alias("layer")).agg(
        F.when(F.min("l_quantity") < 20, mean).alias("value")
    )
    return mesh.to_elements(field, x.mesh_element, ["layer"]).withColumn("value", F.round("value", 6))


@query("C20", sql="""
WITH o AS (SELECT station % 8 AS point, parameter AS field, date_trunc('hour', time)::TIMESTAMP AS valid_time, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS o FROM obs GROUP BY 1, 2, 3)
SELECT f.lead_h, count(*) AS n, round(avg(f.value - o.o), 6) AS bias, round(sqrt(avg(power(f.value - o.o, 2))), 6) AS rmse FROM forecast f JOIN o ON f.point = o.point AND f.field = o.field AND f.valid_time = o.valid_time GROUP BY 1""")
def score_by_lead(x):
    observed = x.obs.groupBy((F.col("station") % 8).cast("int").alias("point"), F.col("parameter").alias("field"), times.floor_hour(F.col("time")).alias("valid_time")).agg(
        (F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") / F.count(F.lit(1)) / 100.0).alias("value")
    )
    out = forecast.score_by_lead(x.forecast.select("point", "field", "valid_time", "lead_h", "value"), observed, ["point", "field", "valid_time"])
    return out.withColumns({"bias": F.round("bias", 6), "rmse": F.round("rmse", 6)})
