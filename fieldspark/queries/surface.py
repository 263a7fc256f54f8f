"""Adapters, contracts and whole requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions import times
from fieldspark.operators import mesh, sets
from fieldspark.plans import requests as plans
from fieldspark.registry import query
from fieldspark.sources import adapters, scan


@query("U1", sql="""
SELECT time, CAST(station AS VARCHAR) AS place, parameter AS field, value, 'gauge' AS origin FROM obs
UNION ALL SELECT time::TIMESTAMP, concat(layer, '/', iy, '/', ix), 'temp', temp, 'model' FROM grid""")
def adapter_union(x):
    def gauge(spark, box, window):
        rows = scan.scan_window(x.obs, *window)
        return rows.select("time", F.col("station").cast("string").alias("place"), F.col("parameter").alias("field"), "value")

    def model(spark, box, window):
        rows = scan.scan_window(x.grid.withColumn("time", F.col("time").cast("timestamp_ntz")), *window)
        return rows.select("time", F.concat_ws("/", "layer", "iy", "ix").alias("place"), F.lit("temp").alias("field"), F.col("temp").alias("value"))

    whole = ("1900-01-01 00:00:00", "2100-01-01 00:00:00")
    parts = {}
    for name, fn in (("gauge", gauge), ("model", model)):
        adapters.drop_adapter(name)
        adapters.register_adapter(name)(fn)
        parts[name] = adapters.read_adapter(x.spark, name, None, whole)
    return sets.union_parts(parts)


@query("U2", sql="""
WITH n AS (SELECT CASE WHEN node % 91 = 1 THEN node + 1 WHEN node % 97 = 5 THEN node + 1000000000 ELSE node END AS node, CASE WHEN node % 333 = 7 THEN 361e0 ELSE lon END AS lon, lat FROM mesh_node),
e AS (SELECT elem, n0, n1, CASE WHEN elem % 401 = 3 THEN n1 ELSE n2 END AS n2 FROM mesh_element UNION ALL SELECT elem, n0, n1, n2 FROM mesh_element WHERE elem % 203 = 8),
f AS (SELECT elem, CASE WHEN elem % 211 = 4 THEN 0 ELSE layer END AS layer, value FROM mesh_field)
SELECT 'corner without a node' AS rule, CAST(elem AS BIGINT) AS id, count(*) AS n FROM (SELECT elem, unnest([n0, n1, n2]) AS node FROM e) a WHERE node NOT IN (SELECT node FROM n) GROUP BY elem
UNION ALL SELECT 'repeated corner', elem, count(*) FROM e WHERE n0 = n1 OR n1 = n2 OR n0 = n2 GROUP BY elem
UNION ALL SELECT 'element listed twice', elem, count(*) FROM e GROUP BY elem HAVING count(*) > 1
UNION ALL SELECT 'node listed twice', node, count(*) FROM n GROUP BY node HAVING count(*) > 1
UNION ALL SELECT 'coordinate out of range', node, count(*) FROM n WHERE abs(lat) > 90 OR lon > 360 GROUP BY node
UNION ALL SELECT 'layer count', elem, count(DISTINCT layer) FROM f GROUP BY elem HAVING count(DISTINCT layer) < (SELECT max(c) FROM (SELECT count(DISTINCT layer) AS c FROM f GROUP BY elem) m)
UNION ALL SELECT 'field without an element', elem, count(*) FROM f WHERE elem NOT IN (SELECT elem FROM e) GROUP BY elem""")
def mesh_contract(x):
    node = F.col("node")
    nodes = x.mesh_node.select(
        F.when(node % 91 == 1, node + 1).when(node % 97 == 5, node + 1_000_000_000).otherwise(node).alias("node"), F.when(node % 333 == 7, 361.0).otherwise(F.col("lon")).alias("lon"), "lat"
    )
    elem = F.col("elem")
    copies = F.explode(F.sequence(F.lit(1), F.when(elem % 203 == 8, 2).otherwise(1)))
    elements = x.mesh_element.withColumn("copy", copies).withColumn("n2", F.when((elem % 401 == 3) & (F.col("copy") == 1), F.col("n1")).otherwise(F.col("n2"))).drop("copy")
    fields = x.mesh_field.withColumn("layer", F.when(elem % 211 == 4, 0).otherwise(F.col("layer")))
    return mesh.contract_violations(nodes, elements, fields)


@query("A1", "C16", "D4", "E12", name="satellite_request", sql="""
WITH p AS (SELECT DISTINCT iy, ix FROM pixel),
r AS (SELECT iy, ix, value, time, sensor, row_number() OVER (PARTITION BY iy, ix ORDER BY time DESC, sensor, value DESC) AS k FROM pixel WHERE value IS NOT NULL AND time <= TIMESTAMP '1999-06-15 12:00:00' AND time >= TIMESTAMP '1999-04-16 12:00:00'),
u AS (SELECT sensor, row_number() OVER (ORDER BY sensor) - 1 AS product_index FROM (SELECT DISTINCT sensor FROM pixel WHERE time <= TIMESTAMP '1999-06-15 12:00:00' AND time >= TIMESTAMP '1999-04-16 12:00:00') a),
b AS (SELECT p.iy, p.ix, r.value, r.time, u.product_index FROM p LEFT JOIN r ON p.iy = r.iy AND p.ix = r.ix AND r.k = 1 LEFT JOIN u ON r.sensor = u.sensor)
SELECT iy, ix, value, round(datediff('second', time, TIMESTAMP '1999-06-15 12:00:00') / 86400e0, 9) AS age_days, product_index FROM b
WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b l WHERE l.value IS NULL AND abs(l.iy - b.iy) + abs(l.ix - b.ix) <= 1)""")
def satellite_request(x):
    out = plans.satellite(x.pixel, times.ts("1999-06-15 12:00:00"), 60, 1)
    return out.withColumn("age_days", F.round("age_days", 9))


@query("C6", "E7", "B10", name="parent_ocean_field", sql="""
WITH g AS (SELECT time, layer, iy % 4 AS iy, ix % 4 AS ix, CAST(sum(CAST(round(temp * 100000) AS BIGINT)) AS DOUBLE) / count(*) / 100000 AS value FROM grid WHERE time >= DATE '1996-01-01' AND time < DATE '1998-01-01' GROUP BY 1, 2, 3, 4),
w AS (SELECT s_suppkey AS target, CAST(s_suppkey % 3 + k.id AS INT) AS iy, CAST(s_suppkey % 4 AS INT) AS ix, CASE WHEN k.id = 0 THEN 0.35355339e0 ELSE 0.64644661e0 END AS w FROM supplier CROSS JOIN range(2) AS k(id)),
t AS (SELECT g.time, g.layer, w.target, sum(w.w * g.value) AS v, count(*) AS n FROM g JOIN w ON g.iy = w.iy AND g.ix = w.ix GROUP BY 1, 2, 3),
c AS (SELECT time, target, layer * -1.9e0 + 0.7e0 AS z, CASE WHEN n = 2 THEN v END AS v FROM t),
l AS (SELECT CAST(id AS INT) AS level, -1.5e0 - 3 * id AS zt FROM range(5) AS t(id)),
p AS (SELECT time, target, level, zt, min(z) FILTER (WHERE z >= zt) AS zu, struct_extract(arg_min(struct_pack(v := v), z) FILTER (WHERE z >= zt), 'v') AS vu, max(z) FILTER (WHERE z < zt) AS zl, struct_extract(arg_max(struct_pack(v := v), z) FILTER (WHERE z < zt), 'v') AS vl FROM c CROSS JOIN l GROUP BY 1, 2, 3, 4)
SELECT time, target, level, zt AS z, CASE WHEN zt >= -(6e0 + target % 9) THEN round(CASE WHEN zu IS NULL THEN vl WHEN zl IS NULL THEN vu ELSE vu + (vl - vu) * (zu - zt) / (zu - zl) END, 6) END AS value FROM p""")
def parent_ocean_field(x):
    coarse = x.grid.withColumn("time", F.col("time").cast("timestamp_ntz")).groupBy("time", "layer", (F.col("iy") % 4).alias("iy"), (F.col("ix") % 4).alias("ix")).agg(
        (F.sum(F.round(F.col("temp") * 100000).cast("long")).cast("double") / F.count(F.lit(1)) / 100000.0).alias("value")
    )
    step = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    cell_weights = x.supplier.select(F.col("s_suppkey").alias("target"), step).select(
        "target", (F.col("target") % 3 + F.col("k")).cast("int").alias("iy"), (F.col("target") % 4).cast("int").alias("ix"), F.when(F.col("k") == 0, 0.35355339).otherwise(0.64644661).alias("w")
    )
    delivered = x.domain.select(F.lit(0).cast("long").alias("request"), "domain")
    _, out = plans.parent_ocean(
        x.request, x.domain, delivered, coarse, cell_weights, "1996-01-01 00:00:00", "1998-01-01 00:00:00", [-1.5 - 3 * k for k in range(5)],
        layer_z=F.col("layer") * -1.9 + 0.7, bed=-(F.col("target") % 9 + 6.0),
    )
    return out.select(F.to_date("time").alias("time"), "target", "level", "z", F.round("value", 6).alias("value"))


@query("C2", "C6", "E7", name="donor_request", sql="""
WITH g AS (SELECT time::TIMESTAMP AS time, layer, iy % 4 AS iy, ix % 4 AS ix, CAST(sum(CAST(round(temp * 100000) AS BIGINT)) AS DOUBLE) / count(*) / 100000 AS value FROM grid WHERE time >= DATE '1996-01-01' AND time < DATE '1996-03-01' GROUP BY 1, 2, 3, 4),
f AS (SELECT d.domain, g.time, g.layer, g.iy, g.ix, g.value + d.domain AS value FROM g CROSS JOIN domain d WHERE NOT (d.domain % 3 = 0 AND day(time) % 5 = 0)),
whole AS (SELECT domain FROM f GROUP BY 1 HAVING count(DISTINCT time) = (SELECT count(DISTINCT time) FROM grid WHERE time >= DATE '1996-01-01' AND time < DATE '1996-03-01')),
r AS (SELECT q.request, d.domain, row_number() OVER (PARTITION BY q.request ORDER BY (d.east - d.west) * (d.north - d.south), d.resolution_m, d.domain) AS rank
      FROM request q JOIN domain d ON d.west <= q.west AND d.south <= q.south AND d.east >= q.east AND d.north >= q.north),
choice AS (SELECT request, arg_min(domain, rank) AS domain, min(rank) > 1 AS fallback FROM r SEMI JOIN whole USING (domain) GROUP BY 1),
w AS (SELECT s_suppkey AS target, CAST(s_suppkey % 3 + k.id AS INT) AS iy, CAST(s_suppkey % 4 AS INT) AS ix, CASE WHEN k.id = 0 THEN 0.35355339e0 ELSE 0.64644661e0 END AS w FROM supplier CROSS JOIN range(2) AS k(id) WHERE s_suppkey <= 10),
t AS (SELECT f.domain, f.time, f.layer, w.target, sum(w.w * f.value) AS v, count(*) AS n FROM f JOIN w ON f.iy = w.iy AND f.ix = w.ix GROUP BY 1, 2, 3, 4),
c AS (SELECT domain, time, target, layer * -1.9e0 + 0.7e0 AS z, CASE WHEN n = 2 THEN v END AS v FROM t),
l AS (SELECT CAST(id AS INT) AS level, -1.5e0 - 3 * id AS zt FROM range(3) AS t(id)),
p AS (SELECT domain, time, target, level, zt, min(z) FILTER (WHERE z >= zt) AS zu, struct_extract(arg_min(struct_pack(v := v), z) FILTER (WHERE z >= zt), 'v') AS vu, max(z) FILTER (WHERE z < zt) AS zl, struct_extract(arg_max(struct_pack(v := v), z) FILTER (WHERE z < zt), 'v') AS vl FROM c CROSS JOIN l GROUP BY 1, 2, 3, 4, 5)
SELECT h.request, h.domain, h.fallback, p.time, p.target, p.level, CASE WHEN zt >= -(6e0 + p.target % 9) THEN round(CASE WHEN zu IS NULL THEN vl WHEN zl IS NULL THEN vu ELSE vu + (vl - vu) * (zu - zt) / (zu - zl) END, 5) END AS value
FROM choice h JOIN p ON p.domain = h.domain AND p.target = 1 + h.request % 10""")
def donor_request(x):
    window = ("1996-01-01 00:00:00", "1996-03-01 00:00:00")
    times_ = x.grid.withColumn("time", F.col("time").cast("timestamp_ntz"))
    records = scan.scan_window(times_, *window).select("time").distinct().count()
    coarse = times_.groupBy("time", "layer", (F.col("iy") % 4).alias("iy"), (F.col("ix") % 4).alias("ix")).agg(
        (F.sum(F.round(F.col("temp") * 100000).cast("long")).cast("double") / F.count(F.lit(1)) / 100000.0).alias("value")
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(24))).alias("domain")  # a domain for each nation
    field = coarse.select(every, "time", "layer", "iy", "ix", "value").withColumn("value", F.col("value") + F.col("domain"))
    field = field.where(~((F.col("domain") % 3 == 0) & (F.dayofmonth("time") % 5 == 0)))
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    cells = x.supplier.where("s_suppkey <= 10").select(F.col("s_suppkey").alias("target"), k, F.sequence(F.lit(0), F.lit(24)).alias("d")).select(
        F.explode("d").alias("domain"), "target", (F.col("target") % 3 + F.col("k")).cast("int").alias("iy"), (F.col("target") % 4).cast("int").alias("ix"),
        F.when(F.col("k") == 0, 0.35355339).otherwise(0.64644661).alias("w"),
    )
    targets = x.request.select("request", (F.col("request") % 10 + 1).alias("target"))
    choice, fields = plans.donor_fields(
        x.request, x.domain, field, cells, targets, *window, records, [-1.5, -4.5, -7.5], layer_z=F.col("layer") * -1.9 + 0.7, bed=-(F.col("target") % 9 + 6.0)
    )
    out = fields.join(choice.select("request", "fallback"), "request")
    return out.select("request", "domain", "fallback", "time", "target", "level", F.round("value", 5).alias("value"))


@query("C3", "D11", "S6", sql="""
WITH held AS (SELECT issue_time AS cycle, lead_h AS lead, valid_time, count(DISTINCT event_id % 2) AS f FROM forecast WHERE issue_time <= TIMESTAMP '2024-01-25 03:00:00' - INTERVAL '7' HOUR GROUP BY 1, 2, 3),
complete AS (SELECT cycle FROM held WHERE lead BETWEEN 1 AND 6 AND f = 2 GROUP BY 1 HAVING count(*) = 6),
hour AS (SELECT valid_time, list(DISTINCT cycle) AS cycles FROM held SEMI JOIN complete USING (cycle) WHERE lead BETWEEN 0 AND 6 GROUP BY 1),
r AS (SELECT request, start, unnest(generate_series(start - INTERVAL '1' HOUR, start + INTERVAL '1' HOUR * (hours + 1), INTERVAL '1' HOUR)) AS time, least(start + INTERVAL '1' HOUR * hours, TIMESTAMP '2024-01-24 20:00:00') AS e FROM request),
l AS (SELECT *, date_trunc('day', e)::TIMESTAMP + CASE WHEN hour(e) >= 12 THEN INTERVAL '12' HOUR ELSE INTERVAL '0' HOUR END AS latest FROM r),
p AS (SELECT l.*, list_max(list_filter(cycles, lambda c: c <= latest)) AS cycle FROM l LEFT JOIN hour ON valid_time = time)
SELECT request, time, cycle, CAST(datediff('hour', cycle, time) AS INT) AS lead FROM p""")
def waves_request(x):
    field = F.when(F.col("event_id") % 2 == 0, "hs").otherwise("tp")
    cycles = x.forecast.select(F.col("issue_time").alias("cycle"), F.col("lead_h").alias("lead"), field.alias("field"))
    out = plans.waves(x.request.select("request", "start", "hours"), cycles, times.ts("2024-01-25 03:00:00"), fields=["hs", "tp"], leads=6)
    return out.select("request", "time", "cycle", "lead")
