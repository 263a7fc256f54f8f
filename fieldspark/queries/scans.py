"""Scans, source resolution and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions import geo, times
from fieldspark.operators import joins
from fieldspark.registry import query
from fieldspark.session import work_dir
from fieldspark.sources import publish, scan, text

SERIES_ORDER = ("purchase", "error", "click", "view", "signup")


@query("A1", sql="""
SELECT o.station, o.parameter, o.time, o.value, s.lon, s.lat FROM obs o JOIN site s ON o.station = s.site
WHERE o.time >= TIMESTAMP '2024-01-05 00:00:00' AND o.time < TIMESTAMP '2024-01-12 00:00:00'
  AND s.lon BETWEEN -74.5 AND -72 AND s.lat BETWEEN 39.5 AND 41.5""")
def scan_window(x):
    obs = scan.scan_window(x.obs, "2024-01-05 00:00:00", "2024-01-12 00:00:00").select("station", "parameter", "time", "value")
    site = x.site.where(geo.in_box(F.col("lon"), F.col("lat"), -74.5, 39.5, -72.0, 41.5)).select(F.col("site").alias("station"), "lon", "lat")
    return obs.join(site, "station").select("station", "parameter", "time", "value", "lon", "lat")


@query("A2", sql="""
SELECT w.request, w.time, min(f.preference) AS preference, min_by(f.file, f.preference) AS file
FROM wanted_hour w LEFT JOIN files f
  ON w.time > f.day - INTERVAL '1' DAY AND w.time <= f.day - CASE WHEN f.preference = 1 THEN INTERVAL '1' HOUR ELSE INTERVAL '0' HOUR END
GROUP BY 1, 2""")
def resolve_source(x):
    short = F.when(F.col("preference") == 1, -1).otherwise(0)
    files = x.files.select("preference", "file", times.add_hours(F.col("day"), -24).alias("begin"), times.add_hours(F.col("day"), short).alias("end"))
    return scan.resolve_source(x.wanted_hour, files)


@query("A3", "F5", sql="""
WITH expected AS (SELECT request, unnest(generate_series(start, start + INTERVAL '1' HOUR * (hours - 1), INTERVAL '1' HOUR)) AS time FROM request),
got AS (SELECT DISTINCT station AS request, date_trunc('hour', time) AS time FROM obs)
SELECT e.request, count(*) AS n_expected, count(*) FILTER (WHERE g.time IS NULL) AS n_missing,
       min(e.time) FILTER (WHERE g.time IS NULL) AS first_missing, count(*) FILTER (WHERE g.time IS NULL) = 0 AS may_serve
FROM expected e LEFT JOIN got g ON e.request = g.request AND e.time = g.time GROUP BY 1""")
def missing_hours(x):
    asked = times.frame_times(x.request.select("request", "start", (F.col("hours") - 1).alias("hours")), "start", "hours", before=0, after=0)
    got = x.obs.select(F.col("station").alias("request"), times.floor_hour(F.col("time")).alias("time"))
    return scan.serve_decision(asked.select("request", "time"), got, "request", ["request", "time"])


@query("A4", sql="""
WITH p AS (SELECT line, string_split_regex(trim(text), '\\s+') AS a FROM obs_text)
SELECT line, make_timestamp(CASE WHEN CAST(a[1] AS INT) < 100 THEN 2000 + CAST(a[1] AS INT) ELSE CAST(a[1] AS INT) END, CAST(a[2] AS INT),
       CAST(a[3] AS INT), CAST(a[4] AS INT), CAST(a[5] AS INT), 0) AS time,
       nullif(TRY_CAST(a[6] AS DOUBLE), 99) AS "WVHT", nullif(TRY_CAST(a[7] AS DOUBLE), 999) AS "WDIR", nullif(TRY_CAST(a[8] AS DOUBLE), 9999) AS "PRES"
FROM p""")
def ingest_stdmet(x):
    return text.ingest_stdmet(x.obs_text, ["WVHT", "WDIR", "PRES"], text="text")


@query("A5", sql="""
WITH e AS (SELECT file, line, text, CAST(split_part(text, ':', 2) AS BIGINT) AS start FROM idx_text),
w AS (SELECT *, lead(start) OVER (PARTITION BY file ORDER BY line) AS "end" FROM e)
SELECT file, line, start, "end" FROM w WHERE text LIKE '%:UGRD:10 m%'""")
def byte_ranges(x):
    return text.byte_ranges(x.idx_text, [":UGRD:10 m"], block=4)


@query("A6", sql="""
SELECT l_orderkey, l_linenumber, CASE WHEN u_raw <> -32767 THEN round(u_raw * 0.01e0, 6) END AS u,
       CASE WHEN n_sites_unsigned > 127 THEN n_sites_unsigned - 256 ELSE n_sites_unsigned END AS n_sites FROM packed""")
def decode_packed(x):
    df = scan.decode_packed(x.packed, {"u": ("u_raw", 0.01, -32767)}, {"n_sites": "n_sites_unsigned"})
    return df.select("l_orderkey", "l_linenumber", F.round("u", 6).alias("u"), "n_sites")


@query("A7", sql="""
WITH raw AS (SELECT time, layer, iy, ix, CASE WHEN layer = 7 THEN 1e37 WHEN ix = 3 THEN 'NaN'::DOUBLE ELSE u END AS u, CASE WHEN iy = 2 THEN -1e37 ELSE v END AS v FROM grid)
SELECT time, layer, iy, ix, CASE WHEN NOT isnan(u) AND abs(u) < 1e30 THEN round(u, 6) END AS u,
       CASE WHEN NOT isnan(v) AND abs(v) < 1e30 THEN round(v, 6) END AS v FROM raw""")
def mask_fill(x):
    raw = x.grid.select(
        "time", "layer", "iy", "ix",
        F.when(F.col("layer") == 7, 1e37).when(F.col("ix") == 3, float("nan")).otherwise(F.col("u")).alias("u"),
        F.when(F.col("iy") == 2, -1e37).otherwise(F.col("v")).alias("v"),
    )
    return scan.mask_fill(raw, ["u", "v"]).withColumns({"u": F.round("u", 6), "v": F.round("v", 6)})


@query("A8", sql="""
WITH h AS (SELECT parameter, CAST(time AS DATE) AS day, date_trunc('hour', time) AS time, CASE WHEN quality = 'v' THEN value END AS value FROM obs),
t AS (SELECT parameter, day, time, count(value) AS n FROM h GROUP BY 1, 2, 3),
s AS (SELECT *, lag(time) OVER (PARTITION BY parameter, day ORDER BY time) AS p FROM t),
g AS (SELECT parameter, day, count(*) AS records, min(time) AS first_time, max(time) AS last_time, bool_and(p IS NULL OR time - p = INTERVAL '1' HOUR) AS hourly, bool_and(n > 0) AS present FROM s GROUP BY 1, 2)
SELECT parameter, day, records, first_time, last_time,
       CASE WHEN records <> 24 THEN 'record count' WHEN NOT hourly THEN 'not hourly' WHEN NOT present THEN 'field missing' END AS fault,
       records = 24 AND hourly AND present AS complete FROM g""")
def publish_gate(x):
    hourly = x.obs.select("parameter", F.to_date("time").alias("day"), times.floor_hour(F.col("time")).alias("time"), F.when(F.col("quality") == "v", F.col("value")).alias("value"))
    return publish.publish_gate(hourly, ["parameter", "day"], ["value"], 24)


@query("A8", sql="""
WITH h AS (SELECT parameter, CAST(time AS DATE) AS day, date_trunc('hour', time)::TIMESTAMP AS time, avg(value) FILTER (quality = 'v') AS value FROM obs GROUP BY 1, 2, 3),
g AS (SELECT parameter, day FROM h GROUP BY 1, 2 HAVING count(*) = 24 AND count(value) = 24)
SELECT parameter, day, time, round(value, 6) AS value FROM h SEMI JOIN g USING (parameter, day)""")
def publish_and_read(x):
    # The second attempt brings every third hour, other values for hours that came before, and is made twice.
    base = work_dir(x.spark, "attempts")
    hours = x.obs.groupBy("parameter", F.to_date("time").alias("day"), times.floor_hour(F.col("time")).alias("time")).agg(F.avg(F.when(F.col("quality") == "v", F.col("value"))).alias("value"))
    held = F.hour("time") % 3 == 2
    first = hours.where(~held)
    again = hours.where(held).unionByName(hours.where(F.hour("time") == 0).withColumn("value", F.col("value") + 1000))
    store, staging, manifest = ["parameter", "day"], base + "/staging", base + "/manifest"
    for attempt, rows in ((1, first), (2, again), (2, again), (3, hours.withColumn("value", -F.col("value")))):
        publish.publish(rows, store, ["value"], 24, staging, manifest, attempt, cells=["time"])
    return publish.read_published(x.spark, hours.schema, store, staging, manifest).withColumn("value", F.round("value", 6))


@query("A9", sql="""
WITH d AS (SELECT parameter, date_trunc('day', time)::TIMESTAMP AS day, count(*) AS n, max(time) AS last FROM obs GROUP BY 1, 2),
ready AS (SELECT parameter, day, n FROM (SELECT *, max(last) OVER (PARTITION BY parameter) AS newest FROM d) a
          WHERE newest >= day + INTERVAL '1' DAY AND TIMESTAMP '2024-01-29 03:00:00' >= day + INTERVAL '1' DAY + INTERVAL '6' HOUR)
SELECT parameter, day, n FROM ready WHERE NOT (day < TIMESTAMP '2024-01-12' AND parameter <> 'view')""")
def archive_days(x):
    obs = x.obs.select("parameter", "time", "value")
    kept = obs.select("parameter", times.floor_day(F.col("time")).alias("day")).distinct().where((F.col("day") < times.ts("2024-01-12 00:00:00")) & (F.col("parameter") != "view"))
    new = scan.archive_days(obs, kept, ["parameter"], times.ts("2024-01-29 03:00:00"))
    return new.groupBy("parameter", "day").agg(F.count(F.lit(1)).alias("n"))


CHOICE_SQL = """rq AS (SELECT request, west, south, east, north, TIMESTAMP '1996-01-01 00:00:00' + INTERVAL '1' DAY * CAST(request % 1800 AS INT) AS d0 FROM request),
rd AS (SELECT request, west, south, east, north, d0 + INTERVAL '1' DAY * CAST(k.id AS INT) AS day FROM rq CROSS JOIN range(5) AS k(id)),
hit AS (SELECT r.request, r.day, a.box, row_number() OVER (PARTITION BY r.request, r.day ORDER BY (a.east - a.west) * (a.north - a.south), a.box) AS k
        FROM rd r JOIN radar_day a ON a.day = r.day AND a.west <= r.west AND a.south <= r.south AND a.east >= r.east AND a.north >= r.north),
choice AS (SELECT r.request, r.day, h.box, CASE WHEN h.box IS NULL THEN 'live' ELSE 'archive' END AS source
           FROM rd r LEFT JOIN hit h ON h.request = r.request AND h.day = r.day AND h.k = 1)"""


def chosen_days(x):
    first = F.timestamp_add("DAY", F.col("request") % 1800, times.ts("1996-01-01 00:00:00"))
    requests = x.request.select("request", *joins.BOX, first.alias("d0"))
    days = requests.select("request", *joins.BOX, F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"), "d0").select(
        "request", *joins.BOX, F.timestamp_add("DAY", F.col("k"), F.col("d0")).alias("day")
    )
    return requests, scan.choose_archive(days, x.radar_day)


@query("A10", sql=f"WITH {CHOICE_SQL} SELECT * FROM choice")
def choose_archive(x):
    return chosen_days(x)[1]


@query("A10", sql=f"""
WITH {CHOICE_SQL},
cut AS (SELECT c.*, q.west, q.south, q.east, q.north, q.d0 + INTERVAL '6' HOUR AS t0, q.d0 + INTERVAL '114' HOUR AS t1 FROM choice c JOIN rq q USING (request)),
rows AS (SELECT 'archive' AS source, box, day, obs_id, time, lon, lat, u FROM radar_row UNION ALL SELECT 'live', NULL, day, obs_id, time, lon, lat, u FROM radar_live)
SELECT c.request, c.source, r.obs_id, r.day, r.time, r.lon, r.lat, r.u FROM cut c JOIN rows r ON r.source = c.source AND r.day = c.day AND r.box IS NOT DISTINCT FROM c.box
WHERE r.lon >= c.west AND r.lon <= c.east AND r.lat >= c.south AND r.lat <= c.north AND r.time >= c.t0 AND r.time < c.t1""")
def load_window(x):
    requests, choice = chosen_days(x)
    window = requests.withColumns({"start": F.timestamp_add("HOUR", F.lit(6), F.col("d0")), "end": F.timestamp_add("HOUR", F.lit(114), F.col("d0"))})
    return scan.load_window(x.radar_row, x.radar_live, choice, window)


@query("A11", sql="""
SELECT valid_time, point, field, issue_time, lead_h, value, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY valid_time, point, field ORDER BY issue_time DESC, event_id DESC) AS k FROM forecast) a WHERE k = 1""")
def latest_issue(x):
    return scan.latest_issue(x.forecast, ["valid_time", "point", "field"], ["issue_time", "event_id"])


@query("A12", sql="""
SELECT trajectory_id AS store_id, round(min(lon), 4) AS west, round(min(lat), 4) AS south, round(max(lon), 4) AS east, round(max(lat), 4) AS north,
       min(time) AS time_start, max(time) AS time_end, count(*) AS records FROM track GROUP BY 1""")
def catalog_footprint(x):
    from fieldspark.operators import catalog

    rows = x.track.select(F.col("trajectory_id").alias("store_id"), geo.wrap_360(F.col("lon")).alias("lon"), "lat", "time")
    return catalog.footprints(rows)


@query("A12", "B19", "D13", sql="""
WITH c AS (SELECT *, store_id % 7 = 0 AS counted, store_id % 5 = 1 AS timeless,
                  CASE store_id % 4 WHEN 0 THEN 'hycom' WHEN 1 THEN 'era5' WHEN 2 THEN 'nwps' ELSE 'other' END || CASE WHEN store_id % 6 = 0 THEN '/raw.grib2' ELSE '/obc_x.zarr' END AS p FROM catalog),
t AS (SELECT store_id, unnest([time_start, time_start + INTERVAL '2' HOUR, time_end]) AS time FROM c WHERE NOT timeless),
s AS (SELECT store_id, time, lead(time) OVER (PARTITION BY store_id ORDER BY time) AS n FROM t),
d AS (SELECT store_id, min(time) AS t0, max(time) AS t1, count(*) AS records, median(datediff('second', time, n) / 3600e0) AS step FROM s GROUP BY 1)
SELECT c.store_id, CASE WHEN counted THEN -70e0 ELSE round(west, 4) END AS west, CASE WHEN counted THEN 40e0 ELSE round(south, 4) END AS south, CASE WHEN counted THEN -69.5e0 ELSE round(east, 4) END AS east,
       CASE WHEN counted THEN 41e0 ELSE round(north, 4) END AS north, coalesce(d.t0, TIMESTAMP '2001-02-03') AS time_start, coalesce(d.t1, TIMESTAMP '2001-02-03') AS time_end, coalesce(d.records, 0) AS records, d.step AS cadence_h,
       CASE store_id % 4 WHEN 0 THEN 'HYCOM' WHEN 1 THEN 'ERA5' WHEN 2 THEN 'NWPS' END AS family, CASE WHEN store_id % 6 = 0 THEN 'raw donor file' ELSE 'ocean boundary' END AS kind,
       CAST(round(bytes) AS BIGINT) AS bytes, 2 AS files FROM c LEFT JOIN d USING (store_id)""")
def catalog_entries(x):
    from fieldspark.operators import catalog

    every = F.col("store_id")
    donor = F.when(every % 4 == 0, "hycom").when(every % 4 == 1, "era5").when(every % 4 == 2, "nwps").otherwise("other")
    c = x.catalog.withColumns({"counted": every % 7 == 0, "timeless": every % 5 == 1})
    attributes = F.when(F.col("timeless") | F.col("counted"), F.create_map(F.lit("target_date"), F.lit("2001-02-03"), F.lit("bbox"), F.lit("-70, 40, -69.5, 41")))
    stores = c.select("store_id", F.concat(donor, F.when(every % 6 == 0, "/raw.grib2").otherwise("/obc_x.zarr")).alias("path"), attributes.alias("attributes"))

    def axis(name, low, high):
        # Some stores count 0, 1, 2 instead of giving longitudes, others give them as 0..360.
        values = F.array(F.col(low) + F.lit(360.0 if name == "lon" else 0.0), (F.col(low) + F.col(high)) / 2, F.col(high), F.lit(float("nan")))
        if name == "lon":
            values = F.when(F.col("counted"), F.array(*[F.lit(float(k)) for k in range(4)])).otherwise(values)
        return c.select("store_id", F.lit(name).alias("axis"), F.posexplode(values).alias("position", "value"))

    axes = axis("lon", "west", "east").unionByName(axis("lat", "south", "north"))
    moments = c.where("NOT timeless").select("store_id", F.explode(F.array("time_start", times.add_hours(F.col("time_start"), 2), "time_end")).alias("time"))
    whole = F.round("bytes").cast("long")
    files = c.select("store_id", F.explode(F.array(F.floor(whole / 3).cast("long"), whole - F.floor(whole / 3).cast("long"))).alias("bytes"))
    out = catalog.entries(stores, axes, moments, files)
    return out.withColumn("files", F.col("files").cast("int"))


@query("A13", sql="""
SELECT store_id, 'Feature' AS type, west AS bbox_west, north AS bbox_north, strftime(time_start, '%Y-%m-%dT%H:%M:%SZ') AS start_datetime,
       strftime(time_end, '%Y-%m-%dT%H:%M:%SZ') AS end_datetime, kind, family AS donor, east AS corner_east, '1.0.0' AS stac_version, 1 AS extensions,
       CASE WHEN provisional THEN 'obc-2' ELSE 'legacy' END AS schema, CAST(store_id % 3 AS VARCHAR) AS store_version, 'https://example.org/stores/' || store_id AS href, 2 AS zarr_format FROM catalog""")
def stac_items(x):
    layout = (
        "type string, stac_version string, stac_extensions array<string>, bbox array<double>, geometry struct<coordinates: array<array<array<double>>>>, "
        "properties struct<start_datetime: string, end_datetime: string, kind: string, donor: string, schema: string, store_version: string>, "
        "assets struct<data: struct<href: string, `xarray:open_kwargs`: struct<zarr_format: int>>>"
    )
    stores = x.catalog.withColumns({"schema": F.when(F.col("provisional"), "obc-2"), "version": F.col("store_id") % 3})
    items = publish.stac_items(stores, "https://example.org").withColumn("f", F.from_json("feature", layout))
    return items.select(
        "store_id", "f.type", F.col("f.bbox")[0].alias("bbox_west"), F.col("f.bbox")[3].alias("bbox_north"), "f.properties.*",
        F.col("f.geometry.coordinates")[0][1][0].alias("corner_east"), "f.stac_version", F.size("f.stac_extensions").alias("extensions"),
        F.col("f.assets.data.href").alias("href"), F.col("f.assets.data")["xarray:open_kwargs"]["zarr_format"].alias("zarr_format"),
    )


@query("A14", sql=r"""
WITH p AS (SELECT id, string_split(path, '/') AS a FROM names)
SELECT id, substr(a[1], 6) AS grid, a[2] AS box_name, CASE WHEN a[2] <> 'other' THEN -CAST(substr(a[2], 17, 7) AS DOUBLE) END AS west,
       CASE WHEN a[2] <> 'other' THEN CAST(substr(a[2], 1, 6) AS DOUBLE) END AS south, CASE WHEN a[2] <> 'other' THEN -CAST(substr(a[2], 26, 7) AS DOUBLE) END AS east,
       CASE WHEN a[2] <> 'other' THEN CAST(substr(a[2], 9, 6) AS DOUBLE) END AS north, CAST(strptime(substr(a[5], 11, 8), '%Y%m%d') AS DATE) AS day FROM p""")
def parse_name(x):
    return text.parse_radar_name(x.names).drop("path")


@query("A15", sql="""
WITH o AS (SELECT station, parameter, time, CASE WHEN NOT (parameter = 'purchase' AND station % 4 = 0) THEN value END AS value, list_position(['purchase', 'error', 'click', 'view', 'signup'], parameter) AS rank FROM obs),
b AS (SELECT station, min(rank) AS rank FROM o WHERE value IS NOT NULL AND rank > 0 GROUP BY 1)
SELECT o.station, o.parameter, o.time, o.value FROM o JOIN b ON o.station = b.station AND o.rank = b.rank""")
def preferred_series(x):
    held = ~((F.col("parameter") == "purchase") & (F.col("station") % 4 == 0))
    obs = x.obs.select("station", "parameter", "time", F.when(held, F.col("value")).alias("value"))
    return scan.preferred_series(obs, SERIES_ORDER)


@query("A16", sql="""
WITH hit AS (SELECT r.request, c.iy, c.ix FROM request r JOIN cell c ON c.wet AND c.lon BETWEEN r.west AND r.east AND c.lat BETWEEN r.south AND r.north),
shape AS (SELECT max(iy) + 1 AS ny, max(ix) + 1 AS nx FROM cell)
SELECT request, greatest(0, min(iy) - 2) AS y0, least(max(ny) - 1, max(iy) + 2) AS y1, greatest(0, min(ix) - 2) AS x0, least(max(nx) - 1, max(ix) + 2) AS x1,
       count(*) AS n_wet FROM hit, shape GROUP BY 1""")
def crop_rectangle(x):
    hits = joins.points_in_boxes(x.cell.where("wet"), x.request)
    shape = x.cell.agg((F.max("iy") + 1).alias("ny"), (F.max("ix") + 1).alias("nx"))
    return scan.crop_rectangles(hits, "request", shape, 2)
