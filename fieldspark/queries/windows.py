"""Gap filling, resampling, runs, neighbourhoods and water columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions import times
from fieldspark.operators import composite, forecast, mesh, rivers, series, sizes, vertical
from fieldspark.registry import query

GAP_SQL = """
w AS (SELECT DISTINCT station, TIMESTAMP '2024-01-02 00:00:00' + INTERVAL '1' HOUR * CAST(station % 48 AS INT) AS s FROM obs),
axis AS (SELECT station, s + INTERVAL '1' HOUR * CAST(t.id AS INT) AS time FROM w CROSS JOIN range(481) AS t(id)),
hr AS (SELECT station, date_trunc('hour', time + INTERVAL '30' MINUTE)::TIMESTAMP AS time, avg(value) AS v FROM obs GROUP BY 1, 2),
pad AS (SELECT h.* FROM hr h JOIN w ON h.station = w.station WHERE h.time BETWEEN w.s - INTERVAL '7' HOUR AND w.s + INTERVAL '487' HOUR),
uni AS (SELECT station, time FROM axis UNION SELECT station, time FROM pad),
f AS (SELECT u.*, p.v, count(p.v) OVER (PARTITION BY u.station ORDER BY u.time) AS g FROM uni u LEFT JOIN pad p ON u.station = p.station AND u.time = p.time),
b AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN time END IGNORE NULLS) OVER p AS t0, last_value(v IGNORE NULLS) OVER p AS v0,
             first_value(CASE WHEN v IS NOT NULL THEN time END IGNORE NULLS) OVER n AS t1, first_value(v IGNORE NULLS) OVER n AS v1,
             count(*) FILTER (WHERE v IS NULL) OVER (PARTITION BY station, g) AS run, count(*) FILTER (WHERE v IS NULL) OVER (PARTITION BY station, g ORDER BY time) AS pos
      FROM f WINDOW p AS (PARTITION BY station ORDER BY time ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY station ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i AS (SELECT b.*, t0 IS NOT NULL AND t1 IS NOT NULL AS bounded, v0 + (v1 - v0) * datediff('hour', t0, b.time) / nullif(datediff('hour', t0, t1), 0) AS line FROM b JOIN axis a ON a.station = b.station AND a.time = b.time)"""


def gap_inputs(x):
    start = times.add_hours(times.ts("2024-01-02 00:00:00"), (F.col("station") % 48).cast("int"))
    windows = x.obs.select("station").distinct().select("station", start.alias("start"), times.add_hours(start, 480).alias("end"))
    hourly = series.hourly_centred(x.obs.select("station", "time", "value"), ["station"])
    return hourly, windows


@query("E1", "C13", sql=f"""
WITH {GAP_SQL},
r1 AS (SELECT station, time, CASE WHEN v IS NOT NULL THEN v WHEN run <= 6 AND bounded THEN line END AS v, CASE WHEN v IS NULL AND run <= 6 AND bounded THEN 1 ELSE 0 END AS flag FROM i),
dm AS (SELECT station, CAST(time AS DATE) AS d, CAST(sum(CASE WHEN quality = 'v' THEN CAST(round(value * 100) AS BIGINT) END) AS DOUBLE) / count(CASE WHEN quality = 'v' THEN 1 END) / 100 AS v FROM obs GROUP BY 1, 2),
nm AS (SELECT station, max(CASE WHEN value > 60 THEN value END) AS v FROM obs GROUP BY 1)
SELECT r1.station, r1.time, round(coalesce(r1.v, dm.v, nm.v), 9) AS value, CASE WHEN r1.v IS NOT NULL THEN flag WHEN dm.v IS NOT NULL THEN 2 WHEN nm.v IS NOT NULL THEN 3 ELSE 0 END AS flag
FROM r1 LEFT JOIN dm ON r1.station = dm.station AND CAST(r1.time AS DATE) = dm.d LEFT JOIN nm ON r1.station = nm.station AND day(r1.time) <= 15""")
def gap_ladder(x):
    hourly, windows = gap_inputs(x)
    # Day means of verified readings (null where a day has none), medians stood in for by large values.
    cents = F.when(F.col("quality") == "v", F.round(F.col("value") * 100).cast("long"))
    mean = F.try_divide(F.sum(cents).cast("double"), F.count(cents)) / 100.0
    daily = x.obs.groupBy("station", F.to_date("time").alias("date")).agg(mean.alias("value"))
    days = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda d: F.concat(F.lit("01-"), F.lpad(d.cast("string"), 2, "0")))
    normals = x.obs.groupBy("station").agg(F.max(F.when(F.col("value") > 60, F.col("value"))).alias("value")).select("station", "value", F.explode(days).alias("mm_dd"))
    return series.gap_ladder(hourly, windows, ["station"], 6, daily, normals).withColumn("value", F.round("value", 9))


@query("E2", sql=f"WITH {GAP_SQL} SELECT station, time, round(CASE WHEN v IS NOT NULL THEN v WHEN pos <= 6 AND bounded THEN line END, 9) AS value FROM i")
def interpolate_limit(x):
    hourly, windows = gap_inputs(x)
    return series.interpolate_limit(hourly, windows, ["station"], 6).withColumn("value", F.round("value", 9))


@query("E3", sql="""
WITH l AS (SELECT 'click' AS field, date_trunc('hour', time)::TIMESTAMP AS time, station % 2 AS cell, max(value) AS value FROM obs WHERE parameter = 'click' GROUP BY 1, 2, 3
           UNION ALL SELECT 'view', date_trunc('day', time)::TIMESTAMP + INTERVAL '3' HOUR * CAST(floor(hour(time) / 3e0) AS INT), station % 2, max(value) FROM obs WHERE parameter = 'view' GROUP BY 1, 2, 3
           UNION ALL SELECT 'error', date_trunc('day', time)::TIMESTAMP + INTERVAL '6' HOUR * CAST(floor(hour(time) / 6e0) AS INT), station % 2, max(value) FROM obs WHERE parameter = 'error' GROUP BY 1, 2, 3
           UNION ALL SELECT 'signup', date_trunc('day', time)::TIMESTAMP, station % 2, max(value) FROM obs WHERE parameter = 'signup' GROUP BY 1, 2, 3
           UNION ALL SELECT 'purchase', TIMESTAMP '2024-01-09 00:00:00', station % 2, max(value) FROM obs WHERE parameter = 'purchase' GROUP BY 1, 2, 3),
axis AS (SELECT unnest(generate_series((SELECT min(time) FROM l), (SELECT max(time) FROM l), INTERVAL '1' HOUR)) AS t),
st AS (SELECT DISTINCT field, time FROM l),
cells AS (SELECT DISTINCT field, cell FROM l),
br AS (SELECT field, t, max(time) FILTER (WHERE time <= t) AS t0, min(time) FILTER (WHERE time > t) AS t1 FROM axis CROSS JOIN st GROUP BY 1, 2)
SELECT b.field, b.t AS time, CAST(g.cell AS INT) AS cell, round(CASE WHEN b.t0 = b.t THEN a.value ELSE a.value + (c.value - a.value) * datediff('hour', b.t0, b.t) / datediff('hour', b.t0, b.t1) END, 5) AS value
FROM cells g JOIN br b ON b.field = g.field LEFT JOIN l a ON a.field = b.field AND a.time = b.t0 AND a.cell = g.cell LEFT JOIN l c ON c.field = b.field AND c.time = b.t1 AND c.cell = g.cell""")
def resample_hourly(x):
    hour = times.hour_index(F.col("time"))
    every = {"click": 1, "view": 3, "error": 6, "signup": 24}
    when = F.lit(None).cast("timestamp_ntz")
    for name, step in every.items():
        when = F.when(F.col("parameter") == name, times.from_hour(hour - F.pmod(hour, F.lit(step)))).otherwise(when)
    when = F.when(F.col("parameter") == "purchase", times.ts("2024-01-09 00:00:00")).otherwise(when)
    cell = (F.col("station") % 2).cast("int").alias("cell")
    long = x.obs.groupBy(F.col("parameter").alias("field"), when.alias("time"), cell).agg(F.max("value").alias("value"))
    return series.resample_hourly(long, ["cell"]).withColumn("value", F.round("value", 5))


@query("E4", sql="""
WITH d AS (SELECT DISTINCT station, datediff('day', DATE '1970-01-01', CAST(time AS DATE)) AS day FROM obs),
g AS (SELECT *, day - row_number() OVER (PARTITION BY station ORDER BY day) AS isl FROM d),
p AS (SELECT *, floor((day - min(day) OVER (PARTITION BY station, isl)) / 5e0) AS cut FROM g)
SELECT station, min(day) AS start, max(day) AS stop, count(*) AS members FROM p GROUP BY station, isl, cut""")
def runs(x):
    days = x.obs.select("station", times.day_index(F.col("time")).alias("day")).distinct()
    return series.runs(days, ["station"], "day", max_len=5, block=8)


@query("E4", sql="""
WITH i AS (SELECT DISTINCT l_suppkey AS supplier, l_partkey AS idx FROM lineitem), g AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY supplier ORDER BY idx) <= 4 THEN 0 ELSE 1 END AS b FROM i),
r AS (SELECT *, sum(b) OVER (PARTITION BY supplier ORDER BY idx) AS r FROM g)
SELECT supplier, min(idx) AS start, max(idx) AS stop, count(*) AS members FROM r GROUP BY supplier, r""")
def index_runs(x):
    index = x.lineitem.select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("idx")).distinct()
    return series.runs(index, ["supplier"], "idx", max_gap=4, block=256)


@query("E5", sql="""
WITH h AS (SELECT parameter, station % 5 AS cell, date_trunc('hour', time)::TIMESTAMP AS time, max(value) AS value FROM obs GROUP BY 1, 2, 3)
SELECT a.parameter, a.cell, a.time, round((a.value + b.value) / 7200, 8) AS rate FROM h a JOIN h b ON a.parameter = b.parameter AND a.cell = b.cell AND b.time = a.time + INTERVAL '1' HOUR""")
def centred_rate(x):
    hourly = x.obs.groupBy("parameter", (F.col("station") % 5).alias("cell"), times.floor_hour(F.col("time")).alias("time")).agg(F.max("value").alias("value"))
    return forecast.centred_rate(hourly, ["parameter", "cell"]).withColumn("rate", F.round("rate", 8))


@query("E6", sql="""
WITH h AS (SELECT *, date_trunc('day', time)::TIMESTAMP AS day FROM obs)
SELECT a.station, a.day, a.value AS last_value, a.arrival AS last_arrival, b.value AS first_value, b.arrival AS first_arrival
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station, day ORDER BY time DESC, arrival DESC) AS k FROM h) q WHERE k = 1) a
JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station, day ORDER BY value, arrival) AS k FROM h) q WHERE k = 1) b ON a.station = b.station AND a.day = b.day""")
def dedupe(x):
    rows = x.obs.select("station", times.floor_day(F.col("time")).alias("day"), "time", "value", "arrival")
    last = series.dedupe(rows, ["station", "day"], ["time", "arrival"], "last").select("station", "day", F.col("value").alias("last_value"), F.col("arrival").alias("last_arrival"))
    first = series.dedupe(rows, ["station", "day"], ["value", "arrival"], "first").select("station", "day", F.col("value").alias("first_value"), F.col("arrival").alias("first_arrival"))
    return last.join(first, ["station", "day"])


LEVELS = [-57.5 + 5.0 * k for k in range(12)]


@query("E7", sql="""
WITH c AS (SELECT vec_id, 10e0 + vec_id % 50 AS h, vec_id % 23 = 0 AS land, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS k FROM embeddings),
l AS (SELECT *, -(k + 0.5e0) / 64 * h AS z FROM c),
t AS (SELECT CAST(id AS INT) AS level, -57.5e0 + 5 * id AS zt FROM range(12) AS t(id)),
p AS (SELECT l.vec_id, t.level, t.zt, any_value(h) AS h, bool_or(land) AS land, min(z) FILTER (WHERE z >= zt) AS zu, arg_min(v, z) FILTER (WHERE z >= zt) AS vu, max(z) FILTER (WHERE z < zt) AS zl, arg_max(v, z) FILTER (WHERE z < zt) AS vl
      FROM l CROSS JOIN t GROUP BY 1, 2, 3)
SELECT vec_id, level, zt AS z, CASE WHEN NOT land AND zt >= -h THEN round(CASE WHEN zu IS NULL THEN vl WHEN zl IS NULL THEN vu ELSE vu + (vl - vu) * (zu - zt) / (zu - zl) END, 6) END AS value FROM p""")
def sigma_to_z(x):
    h = F.col("vec_id") % 50 + 10.0
    z = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: -(k.cast("double") + 0.5) / 64.0 * h)
    columns = x.embeddings.select("vec_id", z.alias("z"), F.col("embedding").cast("array<double>").alias("value"))
    bed = F.when(F.col("vec_id") % 23 != 0, -(F.col("vec_id") % 50 + 10.0))
    return vertical.sigma_to_z(columns, ["vec_id"], LEVELS, bed).withColumn("value", F.round("value", 6))


@query("E9", sql="""
WITH f AS (SELECT time, layer, iy, ix, CASE WHEN iy = 5 AND ix % 3 = 0 THEN NULL ELSE u END AS u FROM grid),
c AS (SELECT time, layer, iy, ix, u FROM f UNION ALL SELECT time, layer, iy, ix - 1, u FROM f WHERE ix > 0)
SELECT time, layer, iy, ix, CASE WHEN count(u) = count(*) THEN round(avg(u), 6) END AS u FROM c GROUP BY 1, 2, 3, 4""")
def faces_to_centres(x):
    faces = x.grid.select("time", "layer", "iy", "ix", F.when(~((F.col("iy") == 5) & (F.col("ix") % 3 == 0)), F.col("u")).alias("u"))
    return vertical.faces_to_centres(faces, "ix", ["time", "layer", "iy"], "u").withColumn("u", F.round("u", 6))


@query("E9", sql="""
WITH f AS (SELECT time, layer, iy, ix, CASE WHEN iy = 5 AND ix % 3 = 0 THEN 0 ELSE v END AS v FROM grid),
c AS (SELECT time, layer, iy, ix, v FROM f UNION ALL SELECT time, layer, iy + 1, ix, v FROM f WHERE iy + 1 < 16)
SELECT time, layer, iy, ix, round(avg(v), 6) AS v FROM c GROUP BY 1, 2, 3, 4""")
def faces_to_centres_zero(x):
    faces = x.grid.select("time", "layer", "iy", "ix", F.when(~((F.col("iy") == 5) & (F.col("ix") % 3 == 0)), F.col("v")).alias("v"))
    out = vertical.faces_to_centres(faces, "iy", ["time", "layer", "ix"], "v", before=True, land_as_zero=True, centres=16)
    return out.withColumn("v", F.round("v", 6))


@query("E10", sql="""
WITH a AS (SELECT DISTINCT 'lon' AS axis, ix AS i, lon AS c FROM cell UNION ALL SELECT DISTINCT 'lat', iy, lat FROM cell),
n AS (SELECT *, lag(c) OVER (PARTITION BY axis ORDER BY i) AS p, lead(c) OVER (PARTITION BY axis ORDER BY i) AS n FROM a)
SELECT axis, i AS edge, round(CASE WHEN p IS NULL THEN c - (n - c) / 2 ELSE (p + c) / 2 END, 6) AS value FROM n UNION ALL SELECT axis, i + 1, round(c + (c - p) / 2, 6) FROM n WHERE n IS NULL""")
def cell_edges(x):
    axes = x.cell.select(F.lit("lon").alias("axis"), F.col("ix").alias("i"), F.col("lon").alias("centre")).unionByName(
        x.cell.select(F.lit("lat").alias("axis"), F.col("iy").alias("i"), F.col("lat").alias("centre"))
    ).distinct()
    return mesh.cell_edges(axes).withColumn("value", F.round("value", 6))


@query("E10", sql="""
WITH g AS (SELECT iy, ix, lon * lat / 10 AS v FROM cell), m AS (SELECT max(iy) AS ny, max(ix) AS nx FROM g),
y AS (SELECT iy, ix, v FROM g UNION ALL SELECT -1, a.ix, 2 * a.v - b.v FROM g a JOIN g b ON a.ix = b.ix AND a.iy = 0 AND b.iy = 1
      UNION ALL SELECT m.ny + 1, a.ix, 2 * a.v - b.v FROM m, g a JOIN g b ON a.ix = b.ix WHERE a.iy = m.ny AND b.iy = m.ny - 1),
e AS (SELECT iy, ix, v FROM y UNION ALL SELECT a.iy, -1, 2 * a.v - b.v FROM y a JOIN y b ON a.iy = b.iy AND a.ix = 0 AND b.ix = 1
      UNION ALL SELECT a.iy, m.nx + 1, 2 * a.v - b.v FROM m, y a JOIN y b ON a.iy = b.iy WHERE a.ix = m.nx AND b.ix = m.nx - 1)
SELECT a.iy + 1 AS jy, a.ix + 1 AS jx, round((a.v + b.v + c.v + d.v) / 4, 6) AS value FROM e a JOIN e b ON b.iy = a.iy AND b.ix = a.ix + 1 JOIN e c ON c.iy = a.iy + 1 AND c.ix = a.ix JOIN e d ON d.iy = a.iy + 1 AND d.ix = a.ix + 1""")
def cell_corners(x):
    shape = x.cell.agg((F.max("iy") + 1).alias("ny"), (F.max("ix") + 1).alias("nx"))
    grid = x.cell.select("iy", "ix", (F.col("lon") * F.col("lat") / 10.0).alias("value")).join(sizes.one_row(shape))
    return mesh.cell_corners(grid, F.col("ny"), F.col("nx"), "value").withColumn("value", F.round("value", 6))


@query("E11", sql="""
SELECT 2 * (iy * 40 + ix) + t.id AS elem, iy * 41 + ix AS n0, CASE WHEN t.id = 0 THEN iy * 41 + ix + 1 ELSE iy * 41 + ix + 42 END AS n1,
       CASE WHEN t.id = 0 THEN iy * 41 + ix + 42 ELSE iy * 41 + ix + 41 END AS n2, iy * 40 + ix AS source_index, row_number() OVER (ORDER BY iy, ix, t.id) - 1 AS local FROM cell CROSS JOIN range(2) AS t(id) WHERE wet""")
def structured_mesh(x):
    return mesh.export_ids(mesh.structured_mesh(x.cell, 40), "elem", block=512)


@query("E12", sql="""
WITH f AS (SELECT date_trunc('month', time)::DATE AS frame, iy, ix, max(CASE WHEN (l_orderkey + iy) % 5 <> 0 THEN value END) AS value FROM pixel GROUP BY 1, 2, 3),
land AS (SELECT * FROM f WHERE value IS NULL)
SELECT frame, iy, ix, value FROM f WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM land l WHERE l.frame = f.frame AND abs(l.iy - f.iy) + abs(l.ix - f.ix) <= 2)""")
def mask_coast(x):
    value = F.when((F.col("l_orderkey") + F.col("iy")) % 5 != 0, F.col("value"))
    frames = x.pixel.groupBy(F.trunc("time", "month").alias("frame"), "iy", "ix").agg(F.max(value).alias("value"))
    return composite.mask_coast(frames, 2, ["frame"])


@query("E13", sql="""
WITH c AS (SELECT iy * 40 + ix AS elem, lon, lat, 1e8 * cos(radians(lat)) AS a FROM cell WHERE wet),
w AS (SELECT count(*) AS n, avg(lon) AS lon0, avg(lat) AS lat0, greatest(sqrt(sum(a) / 200), 1) AS side FROM c),
k AS (SELECT c.*, n, floor(6371000 * cos(radians(lat0)) * radians(lon - lon0) / side) AS kx, floor(6371000 * radians(lat - lat0) / side) AS ky FROM c, w)
SELECT min(elem) AS elem FROM k GROUP BY CASE WHEN n > 200 THEN kx ELSE elem END, CASE WHEN n > 200 THEN ky ELSE -1 END""")
def thin_columns(x):
    columns = x.cell.where("wet").select((F.col("iy") * 40 + F.col("ix")).alias("elem"), "lon", "lat", (F.cos(F.radians("lat")) * 1e8).alias("area_m2"))
    return mesh.thin_columns(columns, 200)


@query("E14", sql="""
WITH g AS (SELECT time, iy, ix, layer - 1 AS layer, CASE WHEN (iy + ix + layer) % 6 <> 0 THEN u END AS u, v FROM grid),
d AS (SELECT time, iy, ix, coalesce(max(layer) FILTER (WHERE u IS NOT NULL AND v IS NOT NULL), 0) AS deep FROM g GROUP BY 1, 2, 3),
s AS (SELECT d.*, CAST(t.id AS INT) AS slot, CAST(round_even(t.id / 3e0 * deep, 0) AS INT) AS pick, CAST(round_even((t.id - 1) / 3e0 * deep, 0) AS INT) AS prior FROM d CROSS JOIN range(4) AS t(id))
SELECT s.time, s.iy, s.ix, s.slot, s.pick AS layer, CASE WHEN NOT (slot > 0 AND pick = prior) THEN round(g.u, 6) END AS u, round(g.v, 6) AS v
FROM s LEFT JOIN g ON g.time = s.time AND g.iy = s.iy AND g.ix = s.ix AND g.layer = s.pick""")
def spread_levels(x):
    u = F.when((F.col("iy") + F.col("ix") + F.col("layer")) % 6 != 0, F.col("u"))
    layers = x.grid.select("time", "iy", "ix", (F.col("layer") - 1).alias("layer"), u.alias("u"), "v")
    out = vertical.spread_levels(layers, ["time", "iy", "ix"], 4)
    return out.withColumns({"u": F.round("u", 6), "v": F.round("v", 6)})


@query("E15", sql="""
WITH h AS (SELECT parameter, arrival, date_trunc('hour', time)::TIMESTAMP AS time FROM obs), s AS (SELECT *, lag(time) OVER (PARTITION BY parameter ORDER BY arrival) AS before FROM h)
SELECT parameter, arrival, before, time, CASE WHEN time <= before THEN 'not increasing' ELSE 'not one hour' END AS fault FROM s WHERE before IS NOT NULL AND time - before <> INTERVAL '1' HOUR""")
def contiguity(x):
    rows = x.obs.select("parameter", "arrival", times.floor_hour(F.col("time")).alias("time"))
    return series.contiguity(rows, ["parameter"], "arrival")


@query("E16", sql="""
WITH h AS (SELECT station, date_trunc('hour', time + INTERVAL '30' MINUTE)::TIMESTAMP AS time, avg(value) AS value FROM obs GROUP BY 1, 2)
SELECT h.station, r.mouth, h.time + INTERVAL '1' HOUR * CAST(r.mouth * 3 AS INT) AS time, round(h.value, 5) AS value FROM h JOIN river_site r ON h.station = r.station""")
def apply_lag(x):
    hourly = series.hourly_centred(x.obs.select("station", "time", "value"), ["station"])
    gauges = x.river_site.select("mouth", "station", (F.col("mouth") * 3).alias("lag_hours"))
    return rivers.apply_lag(hourly, gauges).select("station", "mouth", "time", F.round("value", 5).alias("value"))
