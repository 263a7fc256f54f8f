"""Short tables whose rows give many each, or meet few keys, are worked on by many tasks."""

from __future__ import annotations

from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fieldspark.functions import times
from fieldspark.operators import catalog, forecast, joins, weights

T0 = datetime(2024, 1, 1)


def tasks(df) -> int:
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


@pytest.fixture
def requests(spark):
    rows = [(i, -75.0 + i % 40 / 20, 39.0, -74.0 + i % 40 / 20, 40.0, T0, 48) for i in range(400)]
    return spark.createDataFrame(rows, "request long, west double, south double, east double, north double, start timestamp_ntz, hours int").coalesce(1)


def test_rows_are_dealt_before_they_are_multiplied(spark, requests):
    assert tasks(requests) == 1
    assert tasks(catalog.target_grid(requests, 0.05, 0.05)) > 4
    hours = times.frame_times(requests, "start", "hours")
    assert tasks(hours) > 4 and hours.count() == 400 * 51
    held = spark.createDataFrame([(T0, lead) for lead in range(40)], "cycle timestamp_ntz, lead int")
    planned = forecast.plan_records(hours.withColumn("latest", F.lit(T0).cast("timestamp_ntz")), held, reach=36)
    assert tasks(planned) > 4
    assert planned.where("cycle is not null").count() == 400 * 37  # leads 0 to 36


def test_targets_of_few_cells_are_dealt(spark):
    cells = spark.createDataFrame([(t, k, 0.5) for t in range(200) for k in (0, 1)], "target int, ix int, w double").withColumn("iy", F.lit(0)).coalesce(1)
    field = spark.createDataFrame([(T0, 0, 0, 2.0), (T0, 0, 1, 4.0)], "time timestamp_ntz, iy int, ix int, value double").coalesce(1)
    out = weights.apply_weights(field, cells, ["time"], ["value"])
    assert tasks(out) > 4
    assert {(r.target, r.value) for r in out.collect()} == {(t, 3.0) for t in range(200)}
    grid = field.select(F.col("time").alias("issue_time"), F.lit(0).alias("lead_h"), F.lit("u").alias("field"), "iy", "ix", "value")
    out = forecast.extract_points(grid, cells.withColumnRenamed("target", "point"), [0])
    assert tasks(out) > 4
    assert {(r.point, r.value) for r in out.collect()} == {(t, 3.0) for t in range(200)}


@pytest.mark.parametrize("most", [None, 0])
def test_pairs_of_one_crowded_tile_come_box_by_box_from_many_tasks(spark, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(joins, "MOST_SITES", most)
    sites = [(k, -74.5 + k % 20 / 100, 40.5 + k % 30 / 100) for k in range(120)] + [(900, -70.0, 30.0)]
    boxes = [(b, -74.5 + b % 7 / 100, 40.5, -74.4 + b % 7 / 100, 40.6) for b in range(300)]
    boxes += [(0, 10.0, 10.0, 10.1, 10.1), (300, 10.0, 10.0, 10.1, 10.1), (301, 179.9, 30.0, -69.9, 30.1), (None, -74.5, 40.5, -74.4, 40.6)]
    s = spark.createDataFrame(sites, "site int, lon double, lat double")
    r = spark.createDataFrame(boxes, "request int, west double, south double, east double, north double")
    # Without a broadcast by the optimiser, as for tables beyond its threshold.
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = joins.stations_for_boxes(s, r, "request", [3, 900]).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    hit = lambda x, y, w, s, e, n: (w <= x <= e if w <= e else x >= w or x <= e) and s <= y <= n
    want = Counter((b[0], k, True) for b in boxes for k, x, y in sites if hit(x, y, *b[1:]))
    met = {b for b, _, _ in want if b is not None}
    want.update((b[0], k, False) for b in boxes if b[0] not in met for k in (3, 900))
    assert Counter((x.request, x.site, x.within_box) for x in rows) == want
    if most is None:
        pairs = [(x.task, x.request) for x in rows if x.within_box]
        assert len({task for task, _ in pairs}) >= 4
        turns = sum(a != b for a, b in zip(pairs, pairs[1:], strict=False)) + 1
        assert turns <= 4 * len(boxes)  # a box lies in four tiles at most
