"""Projections of the given tables onto the input schemas of the operators (see FIXTURES.md).

Each is one SQL text for Spark and DuckDB; `spark` differs from `duck` only where the two spell a function
differently. Braces name the tables and projections a Spark text reads. All of them grow with the tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@dataclass(frozen=True)
class Projection:
    duck: str
    spark: str


PROJECTIONS: dict[str, Projection] = {}


def _add(name: str, sql: str, spark: str | None = None) -> None:
    """`sql` names its inputs in braces; `spark` replaces it where Spark needs other words."""
    PROJECTIONS[name] = Projection(re.sub(r"\{(\w+)\}", r"\1", sql).strip(), (spark or sql).strip())


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    text = PROJECTIONS[name].spark
    inputs = {n: load(spark, folder, n) for n in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **inputs)


# Series and sites ------------------------------------------------------------------------------

_add("obs", """
SELECT user_id AS station, event_type AS parameter, ts AS time, value,
       CASE WHEN event_id % 7 = 0 THEN 'p' ELSE 'v' END AS quality, event_id AS arrival
FROM {events}""")

_add("site", """
SELECT s_suppkey AS site, -75e0 + (s_suppkey * 37 % 400) / 100e0 AS lon, 39e0 + (s_suppkey * 53 % 300) / 100e0 AS lat,
       CASE WHEN s_suppkey % 9 = 0 THEN 'ES' ELSE 'ST' END AS site_type
FROM {supplier}""")

# Customers as named points: more of them than sites.
_add("point", """
SELECT c_custkey AS point, -75e0 + (c_custkey * 29 % 397) / 100e0 AS lon, 39e0 + (c_custkey * 71 % 499) / 100e0 AS lat
FROM {customer}""")

_add("domain", """
SELECT n_nationkey AS domain, -75e0 + (n_nationkey * 17 % 30) / 10e0 AS west, 39e0 + (n_nationkey * 11 % 20) / 10e0 AS south,
       -75e0 + (n_nationkey * 17 % 30) / 10e0 + (1 + n_regionkey) / 2e0 AS east,
       39e0 + (n_nationkey * 11 % 20) / 10e0 + (1 + n_regionkey) / 2e0 AS north, 100 * (1 + n_nationkey % 4) AS resolution_m
FROM {nation}""")

_add("request", """
SELECT c_custkey AS request, -74.8e0 + (c_custkey * 13 % 30) / 10e0 AS west, 39.1e0 + (c_custkey * 7 % 20) / 10e0 AS south,
       -74.8e0 + (c_custkey * 13 % 30) / 10e0 + 0.2e0 * (1 + c_nationkey % 3) AS east,
       39.1e0 + (c_custkey * 7 % 20) / 10e0 + 0.2e0 * (1 + c_nationkey % 3) AS north,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(c_custkey % 600 AS INT) AS start,
       CAST(24 * (1 + c_nationkey % 5) AS INT) AS hours
FROM {customer}""", spark="""
SELECT c_custkey AS request, -74.8e0 + (c_custkey * 13 % 30) / 10e0 AS west, 39.1e0 + (c_custkey * 7 % 20) / 10e0 AS south,
       -74.8e0 + (c_custkey * 13 % 30) / 10e0 + 0.2e0 * (1 + c_nationkey % 3) AS east,
       39.1e0 + (c_custkey * 7 % 20) / 10e0 + 0.2e0 * (1 + c_nationkey % 3) AS north,
       TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(c_custkey % 600 AS INT) AS start,
       CAST(24 * (1 + c_nationkey % 5) AS INT) AS hours
FROM {customer}""")

# Grids -----------------------------------------------------------------------------------------

_add("cell", """
SELECT CAST(floor(p_partkey / 40e0) AS INT) AS iy, CAST(p_partkey % 40 AS INT) AS ix, -75e0 + (p_partkey % 40) / 10e0 AS lon,
       39e0 + floor(p_partkey / 40e0) / 10e0 AS lat, p_size >= 8 AS wet
FROM {part}""")

_add("grid", """
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS time, l_linenumber AS layer, CAST(l_suppkey % 16 AS INT) AS iy,
       CAST(l_partkey % 16 AS INT) AS ix,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) - 25 AS u,
       CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) - 5 AS v,
       floor(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*)) / 100000e0 AS temp
FROM {lineitem} GROUP BY 1, 2, 3, 4""")

# A volume with a complete axis of 90-day steps, 0.5 degree cells and one land cell.
_add("volume", """
SELECT CAST(floor(datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 90e0) AS INT) AS it, l_linenumber AS iz,
       CAST(l_suppkey % 4 AS INT) AS iy, CAST(l_partkey % 4 AS INT) AS ix,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS u
FROM {lineitem} WHERE NOT (l_suppkey % 4 = 3 AND l_partkey % 4 = 3) GROUP BY 1, 2, 3, 4""", spark="""
SELECT CAST(floor(datediff(CAST(l_shipdate AS DATE), DATE '1995-01-01') / 90e0) AS INT) AS it, l_linenumber AS iz,
       CAST(l_suppkey % 4 AS INT) AS iy, CAST(l_partkey % 4 AS INT) AS ix,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS u
FROM {lineitem} WHERE NOT (l_suppkey % 4 = 3 AND l_partkey % 4 = 3) GROUP BY 1, 2, 3, 4""")

_add("pixel", """
SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS sensor,
       l_shipdate + INTERVAL '1' SECOND * CAST((l_orderkey * 7 + l_linenumber) % 86400 AS INT) AS time,
       CAST(l_suppkey % 20 AS INT) AS iy, CAST(l_partkey % 20 AS INT) AS ix,
       CASE WHEN l_tax < 0.02e0 THEN NULL ELSE l_quantity END AS value, l_orderkey, l_linenumber,
       l_orderkey * 8 + l_linenumber AS arrival
FROM {lineitem}""")

_add("packed", """
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber = 7 THEN -32767 ELSE l_quantity * 100 END AS SMALLINT) AS u_raw,
       CAST(l_suppkey * 3 % 256 AS INT) AS n_sites_unsigned
FROM {lineitem}""")

_add("weights", """
SELECT CAST(s_suppkey AS INT) AS target, CAST(floor(s_suppkey / 15e0) AS INT) % 15 + CAST(floor(k.id / 2e0) AS INT) AS iy,
       CAST(s_suppkey % 15 + k.id % 2 AS INT) AS ix, 0.25e0 AS w
FROM {supplier} CROSS JOIN range(4) AS k(id)""", spark="""
SELECT CAST(s_suppkey AS INT) AS target, CAST(floor(s_suppkey / 15e0) AS INT) % 15 + CAST(floor(k.id / 2e0) AS INT) AS iy,
       CAST(s_suppkey % 15 + k.id % 2 AS INT) AS ix, 0.25e0 AS w
FROM {supplier} LATERAL VIEW explode(sequence(0, 3)) k AS id""")

# Meshes: a lattice of nodes 40 wide, two triangles per square -----------------------------------

_add("mesh_node", """
SELECT CAST(p_partkey AS INT) AS node, -75e0 + (p_partkey % 40) / 10e0 AS lon, 39e0 + floor(p_partkey / 40e0) / 10e0 AS lat,
       10e0 + p_size % 13 AS h
FROM {part}""")

_add("mesh_element", """
SELECT CAST(2 * p_partkey + k.id AS INT) AS elem, CAST(p_partkey AS INT) AS n0,
       CAST(CASE WHEN k.id = 0 THEN p_partkey + 1 ELSE p_partkey + 41 END AS INT) AS n1,
       CAST(CASE WHEN k.id = 0 THEN p_partkey + 41 ELSE p_partkey + 40 END AS INT) AS n2
FROM {part} CROSS JOIN range(2) AS k(id)
WHERE p_partkey % 40 < 39 AND p_size > 2 AND p_partkey + 41 <= (SELECT max(p_partkey) FROM {part})""", spark="""
SELECT CAST(2 * p_partkey + k.id AS INT) AS elem, CAST(p_partkey AS INT) AS n0,
       CAST(CASE WHEN k.id = 0 THEN p_partkey + 1 ELSE p_partkey + 41 END AS INT) AS n1,
       CAST(CASE WHEN k.id = 0 THEN p_partkey + 41 ELSE p_partkey + 40 END AS INT) AS n2
FROM {part} LATERAL VIEW explode(sequence(0, 1)) k AS id
WHERE p_partkey % 40 < 39 AND p_size > 2 AND p_partkey + 41 <= (SELECT max(p_partkey) FROM {part})""")

# Layered values on the mesh's elements: two per line item's part, three layers.
_add("mesh_field", """
SELECT CAST(2 * l_partkey + l_linenumber % 2 AS INT) AS elem, CAST(l_suppkey % 3 AS INT) AS layer,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS value
FROM {lineitem} GROUP BY 1, 2""")

_add("line", """
SELECT CAST(floor(s_suppkey / 5e0) AS INT) AS line, CAST(s_suppkey AS INT) AS seq, -74.9e0 + (s_suppkey * 17 % 37) / 10e0 AS lon,
       39.1e0 + (s_suppkey * 11 % 41) / 10e0 AS lat
FROM {supplier}""")

_add("ring", """
SELECT c_custkey AS ring, CAST(k.id AS INT) AS seq,
       -75e0 + (c_custkey % 40) / 10e0 + CASE WHEN k.id IN (1, 2) THEN 0.5e0 ELSE 0e0 END AS lon,
       39e0 + (c_custkey % 60) / 20e0 + CASE WHEN k.id IN (2, 3) THEN 0.4e0 ELSE 0e0 END AS lat, c_nationkey AS basin,
       c_custkey % 5 = 0 AS hole
FROM {customer} CROSS JOIN range(5) AS k(id)""", spark="""
SELECT c_custkey AS ring, CAST(k.id AS INT) AS seq,
       -75e0 + (c_custkey % 40) / 10e0 + CASE WHEN k.id IN (1, 2) THEN 0.5e0 ELSE 0e0 END AS lon,
       39e0 + (c_custkey % 60) / 20e0 + CASE WHEN k.id IN (2, 3) THEN 0.4e0 ELSE 0e0 END AS lat, c_nationkey AS basin,
       c_custkey % 5 = 0 AS hole
FROM {customer} LATERAL VIEW explode(sequence(0, 4)) k AS id""")

# Forecasts -------------------------------------------------------------------------------------

_add("forecast", """
SELECT cycle AS issue_time, valid_time,
       CAST(24 * datediff('day', CAST(cycle AS DATE), CAST(valid_time AS DATE)) + hour(valid_time) - hour(cycle) AS INT) AS lead_h,
       CAST(user_id % 8 AS INT) AS point, event_type AS field, value, event_id
FROM (SELECT *, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS valid_time,
             CASE event_id % 4 WHEN 0 THEN half WHEN 1 THEN half - INTERVAL '12' HOUR WHEN 2 THEN half - INTERVAL '24' HOUR
                  ELSE half - INTERVAL '36' HOUR END AS cycle
      FROM (SELECT *, CASE WHEN hour(ts) < 12 THEN CAST(date_trunc('day', ts) AS TIMESTAMP)
                           ELSE CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL '12' HOUR END AS half FROM {events}) a) b""",
spark="""
SELECT cycle AS issue_time, valid_time,
       CAST(24 * datediff(CAST(valid_time AS DATE), CAST(cycle AS DATE)) + hour(valid_time) - hour(cycle) AS INT) AS lead_h,
       CAST(user_id % 8 AS INT) AS point, event_type AS field, value, event_id
FROM (SELECT *, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS valid_time,
             CASE event_id % 4 WHEN 0 THEN half WHEN 1 THEN half - INTERVAL '12' HOUR WHEN 2 THEN half - INTERVAL '24' HOUR
                  ELSE half - INTERVAL '36' HOUR END AS cycle
      FROM (SELECT *, CASE WHEN hour(ts) < 12 THEN CAST(date_trunc('day', ts) AS TIMESTAMP_NTZ)
                           ELSE CAST(date_trunc('day', ts) AS TIMESTAMP_NTZ) + INTERVAL '12' HOUR END AS half FROM {events}) a) b""")

# The same forecasts on grid cells, for point extraction.
_add("forecast_grid", """
SELECT issue_time, CAST(6 * floor(lead_h / 6e0) AS INT) AS lead_h, field, 0 AS iy, CAST(event_id % 2 AS INT) AS ix, max(value) AS value
FROM {forecast} GROUP BY 1, 2, 3, 4, 5""")

_add("forecast_weights", """
SELECT s_suppkey AS point, 0 AS iy, CAST(k.id AS INT) AS ix,
       CASE WHEN k.id = 0 THEN (1 + s_suppkey % 10) / 16e0 ELSE 1 - (1 + s_suppkey % 10) / 16e0 END AS w
FROM {supplier} CROSS JOIN range(2) AS k(id)""", spark="""
SELECT s_suppkey AS point, 0 AS iy, k.id AS ix,
       CASE WHEN k.id = 0 THEN (1 + s_suppkey % 10) / 16e0 ELSE 1 - (1 + s_suppkey % 10) / 16e0 END AS w
FROM {supplier} LATERAL VIEW explode(sequence(0, 1)) k AS id""")

# Rivers ----------------------------------------------------------------------------------------

_add("river_site", """
SELECT CAST(s_suppkey % 5 AS INT) AS mouth, CAST(floor(s_suppkey / 5e0) AS INT) + 1 AS r, s_suppkey AS station,
       CASE WHEN s_suppkey % 31 = 3 THEN NULL ELSE 10000e0 / (CAST(floor(s_suppkey / 5e0) AS INT) + 1) END AS area_sqmi,
       CASE WHEN s_suppkey % 9 = 0 THEN 'ES' ELSE 'ST' END AS site_type
FROM {supplier}""")

_add("river_below", """
SELECT DISTINCT CAST(s.s_suppkey % 5 AS INT) AS mouth, s.s_suppkey AS station,
       CAST((floor((floor(s.s_suppkey / 5e0) + 1) / power(2e0, k.id)) - 1) * 5 + s.s_suppkey % 5 AS BIGINT) AS below
FROM {supplier} s CROSS JOIN range(1, 40) AS k(id)
WHERE floor((floor(s.s_suppkey / 5e0) + 1) / power(2e0, k.id)) >= 1""", spark="""
SELECT DISTINCT CAST(s_suppkey % 5 AS INT) AS mouth, s_suppkey AS station,
       CAST((floor((floor(s_suppkey / 5e0) + 1) / power(2e0, k.id)) - 1) * 5 + s_suppkey % 5 AS BIGINT) AS below
FROM {supplier} LATERAL VIEW explode(sequence(1, 39)) k AS id
WHERE floor((floor(s_suppkey / 5e0) + 1) / power(2e0, k.id)) >= 1""")

_add("river_record", """
SELECT o_custkey AS station, CASE WHEN o_orderkey % 3 = 0 THEN '00011' WHEN o_orderkey % 3 = 1 THEN '00003' ELSE '00010' END AS statistic,
       min(o_orderdate) AS begin_time, max(o_orderdate) AS end_time
FROM {orders} GROUP BY 1, 2""")

# Files, stores and texts -----------------------------------------------------------------------

_add("files", """
SELECT DISTINCT CAST(o_orderkey % 3 AS INT) AS preference, o_orderdate AS day,
       concat('src', CAST(o_orderkey % 3 AS VARCHAR), '/', strftime(o_orderdate, '%Y_%m_%d')) AS file
FROM {orders} WHERE o_orderkey % 3 = 2 OR (day(o_orderdate) + o_orderkey % 3) % 3 <> 0""", spark="""
SELECT DISTINCT CAST(o_orderkey % 3 AS INT) AS preference, o_orderdate AS day,
       concat('src', CAST(o_orderkey % 3 AS STRING), '/', date_format(o_orderdate, 'yyyy_MM_dd')) AS file
FROM {orders} WHERE o_orderkey % 3 = 2 OR (day(o_orderdate) + o_orderkey % 3) % 3 <> 0""")

_add("wanted_hour", """
SELECT DISTINCT l_orderkey AS request, l_shipdate + INTERVAL '1' HOUR * CAST(l_partkey % 24 AS INT) AS time FROM {lineitem}""")

_add("segment", """
SELECT c_custkey AS segment, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '30' MINUTE * CAST(c_custkey AS INT) AS start,
       c_custkey % 5 >= 3 AS tidal
FROM {customer}""", spark="""
SELECT c_custkey AS segment, TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '30' MINUTE * CAST(c_custkey AS INT) AS start,
       c_custkey % 5 >= 3 AS tidal
FROM {customer}""")

_add("track", """
SELECT o_custkey AS trajectory_id, o_orderkey AS obs, o_orderdate AS time, -75e0 + (o_orderkey * 7 % 1400) / 1000e0 AS lon,
       39e0 + (o_orderkey * 11 % 1400) / 1000e0 AS lat, -((o_orderkey % 60) / 10e0) AS z, o_orderkey % 17 <> 0 AS alive
FROM {orders}""")

_add("catalog", """
SELECT o_orderkey AS store_id, concat(lower(o_orderpriority), '/', CASE o_orderkey % 4 WHEN 0 THEN 'obc_' WHEN 1 THEN 'atm_' WHEN 2 THEN 'wav_' ELSE 'riv_' END,
              CAST(o_orderkey AS VARCHAR), '.zarr') AS path,
       o_orderstatus AS family, CASE o_orderkey % 4 WHEN 0 THEN 'ocean' WHEN 1 THEN 'atmosphere' WHEN 2 THEN 'waves' ELSE 'rivers' END AS kind,
       o_orderdate AS time_start, o_orderdate + INTERVAL '5' HOUR AS time_end,
       -75e0 + (o_custkey % 40) / 10e0 AS west, 39e0 + (o_custkey % 30) / 10e0 AS south,
       -74.6e0 + (o_custkey % 40) / 10e0 AS east, 39.3e0 + (o_custkey % 30) / 10e0 AS north, o_totalprice AS bytes, o_orderkey % 5 = 0 AS provisional
FROM {orders}""", spark="""
SELECT o_orderkey AS store_id, concat(lower(o_orderpriority), '/', CASE o_orderkey % 4 WHEN 0 THEN 'obc_' WHEN 1 THEN 'atm_' WHEN 2 THEN 'wav_' ELSE 'riv_' END,
              CAST(o_orderkey AS STRING), '.zarr') AS path,
       o_orderstatus AS family, CASE o_orderkey % 4 WHEN 0 THEN 'ocean' WHEN 1 THEN 'atmosphere' WHEN 2 THEN 'waves' ELSE 'rivers' END AS kind,
       o_orderdate AS time_start, o_orderdate + INTERVAL '5' HOUR AS time_end,
       -75e0 + (o_custkey % 40) / 10e0 AS west, 39e0 + (o_custkey % 30) / 10e0 AS south,
       -74.6e0 + (o_custkey % 40) / 10e0 AS east, 39.3e0 + (o_custkey % 30) / 10e0 AS north, o_totalprice AS bytes, o_orderkey % 5 = 0 AS provisional
FROM {orders}""")

_add("obs_text", """
SELECT event_id AS line, concat(CASE WHEN event_id % 5 = 0 THEN CAST(year(ts) - 2000 AS VARCHAR) ELSE CAST(year(ts) AS VARCHAR) END, ' ',
       CAST(month(ts) AS VARCHAR), ' ', CAST(day(ts) AS VARCHAR), ' ', CAST(hour(ts) AS VARCHAR), '  ', CAST(minute(ts) AS VARCHAR), ' ',
       CASE WHEN event_id % 11 = 0 THEN '99.0' ELSE CAST(value AS VARCHAR) END, ' ',
       CASE WHEN event_id % 13 = 0 THEN 'MM' WHEN event_id % 17 = 0 THEN '999' ELSE CAST(user_id AS VARCHAR) END, ' ',
       CASE WHEN event_id % 19 = 0 THEN '9999.0' ELSE '1013.5' END) AS text
FROM {events}""", spark="""
SELECT event_id AS line, concat(CASE WHEN event_id % 5 = 0 THEN CAST(year(ts) - 2000 AS STRING) ELSE CAST(year(ts) AS STRING) END, ' ',
       CAST(month(ts) AS STRING), ' ', CAST(day(ts) AS STRING), ' ', CAST(hour(ts) AS STRING), '  ', CAST(minute(ts) AS STRING), ' ',
       CASE WHEN event_id % 11 = 0 THEN '99.0' ELSE CAST(value AS STRING) END, ' ',
       CASE WHEN event_id % 13 = 0 THEN 'MM' WHEN event_id % 17 = 0 THEN '999' ELSE CAST(user_id AS STRING) END, ' ',
       CASE WHEN event_id % 19 = 0 THEN '9999.0' ELSE '1013.5' END) AS text
FROM {events}""")

_add("idx_text", """
SELECT file, line, concat(CAST(line AS VARCHAR), ':', CAST(line * 1000 + pk % 900 AS VARCHAR), ':d=20240101:',
       CASE WHEN sk % 2 = 0 THEN 'UGRD' ELSE 'VGRD' END, ':10 m above ground:1 hour fcst:') AS text
FROM (SELECT l_orderkey AS file, CAST(l_linenumber AS BIGINT) AS line, min(l_partkey) AS pk, max(l_suppkey) AS sk FROM {lineitem} GROUP BY 1, 2) a""",
spark="""
SELECT file, line, concat(CAST(line AS STRING), ':', CAST(line * 1000 + pk % 900 AS STRING), ':d=20240101:',
       CASE WHEN sk % 2 = 0 THEN 'UGRD' ELSE 'VGRD' END, ':10 m above ground:1 hour fcst:') AS text
FROM (SELECT l_orderkey AS file, CAST(l_linenumber AS BIGINT) AS line, min(l_partkey) AS pk, max(l_suppkey) AS sk FROM {lineitem} GROUP BY 1, 2) a""")

_add("names", """
SELECT s_suppkey AS id, concat('grid_', CAST(1 + s_suppkey % 2 AS VARCHAR), 'km/', CASE WHEN s_suppkey % 7 = 0 THEN 'other' ELSE
       concat('40.', CAST(100 + s_suppkey % 900 AS VARCHAR), 'N_41.300N_073.800W_071.', CAST(100 + s_suppkey % 900 AS VARCHAR), 'W') END,
       '/2024/01/radar_', CAST(1 + s_suppkey % 2 AS VARCHAR), 'km_202401', CASE WHEN s_suppkey % 28 < 9 THEN '0' ELSE '' END,
       CAST(1 + s_suppkey % 28 AS VARCHAR), '.nc') AS path
FROM {supplier}""", spark="""
SELECT s_suppkey AS id, concat('grid_', CAST(1 + s_suppkey % 2 AS STRING), 'km/', CASE WHEN s_suppkey % 7 = 0 THEN 'other' ELSE
       concat('40.', CAST(100 + s_suppkey % 900 AS STRING), 'N_41.300N_073.800W_071.', CAST(100 + s_suppkey % 900 AS STRING), 'W') END,
       '/2024/01/radar_', CAST(1 + s_suppkey % 2 AS STRING), 'km_202401', CASE WHEN s_suppkey % 28 < 9 THEN '0' ELSE '' END,
       CAST(1 + s_suppkey % 28 AS STRING), '.nc') AS path
FROM {supplier}""")

# Archived radar days: which boxes hold which days.
_add("radar_day", """
SELECT DISTINCT CAST(o_custkey % 35 AS INT) AS box, o_orderdate AS day, -75e0 + (o_custkey % 5) / 10e0 AS west, 39e0 AS south,
       -73e0 + (o_custkey % 7) / 10e0 AS east, 41e0 AS north
FROM {orders}""")

# What the archive holds of its boxes, and what the live source still has.
_add("radar_row", """
SELECT o_orderkey AS obs_id, CAST(o_custkey % 35 AS INT) AS box, o_orderdate AS day, o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 AS INT) AS time,
       -75e0 + (o_orderkey * 7 % 200) / 100e0 AS lon, 39e0 + (o_orderkey * 11 % 200) / 100e0 AS lat, o_orderkey % 97 / 10e0 AS u
FROM {orders}""")

_add("radar_live", """
SELECT l_orderkey * 10 + l_linenumber AS obs_id, l_shipdate AS day, l_shipdate + INTERVAL '1' HOUR * CAST((l_orderkey + l_linenumber) % 24 AS INT) AS time,
       -75e0 + (l_partkey * 7 % 200) / 100e0 AS lon, 39e0 + (l_suppkey * 11 % 200) / 100e0 AS lat, l_partkey % 97 / 10e0 AS u
FROM {lineitem}""")
