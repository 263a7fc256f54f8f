"""Ordered output, bounds, top k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions import times
from fieldspark.operators import sets
from fieldspark.registry import query
from fieldspark.sources import scan


@query("F1", sql="SELECT point, lon, lat FROM point ORDER BY lon, point")
def ordered_sites(x):
    return x.point.orderBy("lon", "point")


@query("F2", sql="""
WITH b AS (SELECT sensor, min(time) AS first_time, max(time) AS last_time FROM pixel WHERE value IS NOT NULL GROUP BY 1)
SELECT sensor, first_time, last_time, greatest(first_time, TIMESTAMP '1994-01-01 00:00:00') AS clamped_start, least(last_time, TIMESTAMP '1999-01-01 00:00:00') AS clamped_end FROM b""")
def time_bounds(x):
    return sets.time_bounds(x.pixel.where(F.col("value").isNotNull()), ["sensor"], times.ts("1994-01-01 00:00:00"), times.ts("1999-01-01 00:00:00"))


@query("F3", sql="""
SELECT station, time, value, arrival, rank FROM (SELECT station, time, value, arrival, row_number() OVER (PARTITION BY station ORDER BY value DESC, arrival) AS rank FROM obs) a WHERE rank <= 3""")
def top_k(x):
    return sets.top_k(x.obs.select("station", "time", "value", "arrival"), ["station"], [F.col("value").desc(), F.col("arrival")], 3)


@query("F4", sql="""
SELECT station AS place, time, value, CAST(NULL AS DOUBLE) AS z, 'gauge' AS origin FROM obs UNION ALL SELECT trajectory_id, time, NULL, z, 'track' FROM track""")
def union_parts(x):
    gauge = x.obs.select(F.col("station").alias("place"), "time", "value")
    track = x.track.select(F.col("trajectory_id").alias("place"), "time", "z")
    return sets.union_parts({"gauge": gauge, "track": track}).select("place", "time", "value", "z", "origin")


@query("F5", sql="""
WITH a AS (SELECT DISTINCT request AS station, CAST(unnest(generate_series(date_trunc('day', start)::TIMESTAMP, start + INTERVAL '1' HOUR * (hours - 1), INTERVAL '1' DAY)) AS DATE) AS day FROM request)
SELECT station, day FROM a EXCEPT SELECT station, CAST(time AS DATE) FROM obs""")
def missing_days(x):
    days = F.explode(F.sequence(F.to_date("start"), F.to_date(times.add_hours(F.col("start"), F.col("hours") - 1))))
    wanted = x.request.select(F.col("request").alias("station"), days.alias("day"))
    return scan.missing_hours(wanted, x.obs.select("station", F.to_date("time").alias("day")), ["station", "day"]).distinct()


@query("F6", sql="""
SELECT site FROM (SELECT site FROM site UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') a WHERE site NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def id_sets(x):
    added = x.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("site"))
    removed = x.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("site"))
    return sets.id_sets(x.site.select("site"), added, removed)
