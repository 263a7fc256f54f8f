"""Gauges, cycles, sources, publication, adapters and streams."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from fieldspark import schemas, streaming
from fieldspark.functions import times
from fieldspark.operators import forecast, joins, rivers
from fieldspark.plans import requests as plans
from fieldspark.session import materialise, work_dir
from fieldspark.sources import adapters, publish, scan, text
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 3, 1)
H = dt.timedelta(hours=1)


def river(spark, include=(), exclude=(), short=()):
    sites = spark.createDataFrame(
        [("m", 1, 900.0, "ST"), ("m", 2, 500.0, "ST"), ("m", 3, 300.0, "ST"), ("m", 4, 200.0, "ES"), ("m", 5, None, "ST"), ("m", 6, 5.0, "ST"), ("m", 7, 100.0, "ST")],
        "mouth string, station int, area_sqmi double, site_type string",
    )
    mouths = spark.createDataFrame([("m", 1000.0, list(include), list(exclude), 3)], "mouth string, area_mouth double, include array<int>, exclude array<int>, lag_hours int")
    records = spark.createDataFrame(
        [(s, "00011", T0 - 1000 * H, T0 + (0 if s in short else 1000) * H) for s in (1, 2, 3, 4, 6)] + [(7, "00010", T0 - 1000 * H, T0 + 1000 * H)],
        "station int, statistic string, begin_time timestamp_ntz, end_time timestamp_ntz",
    )
    below = spark.createDataFrame([("m", 2, 1), ("m", 3, 1), ("m", 3, 2), ("m", 7, 1)], "mouth string, station int, below int")
    return sites, mouths, records, below


def pick(spark, **kw):
    sites, mouths, records, below = river(spark, **kw)
    out = rivers.select_gauges(sites, mouths, records, below, times.ts(str(T0)), times.ts(str(T0 + 100 * H)))
    return {r.station: r.reason for r in out.collect()}


def test_gauge_rules(spark):
    got = pick(spark)
    assert got[1] is None and got[2] == "upstream of another gauge (1)" and got[3] == "upstream of another gauge (1)"
    assert got[4] == "site type ES" and got[5] == "no drainage area" and got[6].startswith("drains under") and got[7] == "no discharge record over the window"


def test_lowest_gauge_moves_up_when_the_lower_one_is_out(spark):
    got = pick(spark, exclude=(1,))
    assert got[1] == "excluded by the mouth entry" and got[2] is None and got[3] == "upstream of another gauge (2)"
    assert pick(spark, short=(1,))[2] is None


def test_included_gauges_stay(spark):
    got = pick(spark, include=(3, 4, 6, 7))
    assert got[3] is None and got[4] is None and got[6] is None and got[7] == "included gauge without a record"


def test_too_much_gauged_area_is_a_fault(spark):
    sites, mouths, records, below = river(spark, include=(2,))
    out = rivers.mouth_summary(rivers.select_gauges(sites, mouths, records, below, times.ts(str(T0)), times.ts(str(T0 + 100 * H)))).first()
    assert out.gauges == 2 and out.fault == "gauged area exceeds the mouth's"


def test_river_end_to_end_scales_and_lags(spark):
    sites, mouths, records, below = river(spark, exclude=(1,))
    # Gauge 2 (500 of 1000 sq mi) reads its own hour; the mouth sees it three hours later, doubled.
    rows = [(2, T0 + k * H / 4, float(k // 4), "v", k) for k in range(-400, 400)]
    readings = spark.createDataFrame(rows, "station int, time timestamp_ntz, value double, quality string, arrival int").withColumn("value", F.abs("value"))
    empty = spark.createDataFrame([], "station int, date date, value double")
    out = plans.rivers(mouths, sites, records, below, readings, empty, None, None, str(T0 + 10 * H), 24)
    got = {r.time: r for r in out.discharge.collect()}
    assert sorted(got) == [T0 + (10 + k) * H for k in range(25)]
    # The mean over [h - 30 min, h + 30 min) of a quarter-hourly step function is h - 0.5.
    for k in range(25):
        assert got[T0 + (10 + k) * H].discharge == pytest.approx((10 + k - 3 - 0.5) * 2 * 0.028316846592)
        assert got[T0 + (10 + k) * H].fill == 0


def test_a_gauge_may_serve_two_mouths(spark):
    sites, mouths, records, below = river(spark, exclude=(1,))
    # A second mouth with the same gauges, two hours nearer.
    again = lambda df: df.unionByName(df.withColumn("mouth", F.lit("n")))
    lag = mouths.first().lag_hours
    both = mouths.unionByName(mouths.withColumn("mouth", F.lit("n")).withColumn("lag_hours", (F.col("lag_hours") - 2).cast(mouths.schema["lag_hours"].dataType)))
    rows = [(2, T0 + k * H / 4, float(k // 4), "v", k) for k in range(-400, 400)]
    readings = spark.createDataFrame(rows, "station int, time timestamp_ntz, value double, quality string, arrival int").withColumn("value", F.abs("value"))
    empty = spark.createDataFrame([], "station int, date date, value double")
    warm = readings.select("station", "time", "value")
    out = plans.rivers(both, again(sites), records, again(below), readings, empty, None, warm, str(T0 + 10 * H), 24)
    got = {(r.mouth, r.time): r for r in out.discharge.collect()}
    first = mouths.first().mouth
    assert sorted(got) == sorted((m, T0 + (10 + k) * H) for m in (first, "n") for k in range(25))
    for k in range(25):
        for mouth, late in ((first, lag), ("n", lag - 2)):
            row = got[mouth, T0 + (10 + k) * H]
            assert row.discharge == pytest.approx((10 + k - late - 0.5) * 2 * 0.028316846592)
            assert row.temperature == pytest.approx(10 + k - late - 0.5)


def test_gauge_records_cover_the_lagged_window(spark):
    sites, mouths, records, below = river(spark, exclude=(1,))
    far = mouths.withColumn("lag_hours", F.lit(24 * 365 * 40).cast(mouths.schema["lag_hours"].dataType))
    kept = lambda m: {r.station for r in rivers.select_gauges(sites, m, records, below, times.ts(str(T0)), times.ts(str(T0 + 100 * H)), lagged=True).where("kept").collect()}
    assert kept(mouths) == {2} and kept(far) == set()


def test_plan_walks_back_to_a_complete_cycle(spark):
    held = [(T0, k) for k in range(0, 30)] + [(T0 + 12 * H, k) for k in range(1, 30)] + [(T0 + 24 * H, k) for k in range(0, 30)]
    held = spark.createDataFrame(held, "cycle timestamp_ntz, lead int")
    hours = spark.createDataFrame([(T0 + h * H, T0 + 12 * H) for h in (0, 12, 13, 30, 47)], "time timestamp_ntz, latest timestamp_ntz")
    got = {int((r.time - T0) / H): (r.cycle, r.lead) for r in forecast.plan_records(hours, held, reach=36).collect()}
    assert got[0] == (T0, 0) and got[12] == (T0, 12)  # the newer cycle lacks its analysis
    assert got[13] == (T0 + 12 * H, 1) and got[30] == (T0 + 12 * H, 18) and got[47] == (None, None)


def test_point_winds_turn_and_other_fields_pass(spark):
    rows = [(T0, T0 + H, 1, p, f, v) for p in (1, 2) for f, v in (("u10", 3.0), ("v10", 4.0), ("t2m", 280.0))]
    df = spark.createDataFrame(rows, "issue_time timestamp_ntz, valid_time timestamp_ntz, lead_h int, point int, field string, value double")
    points = spark.createDataFrame([(1, 0.0), (2, 90.0)], "point int, deg double")
    got = {(r.point, r.field): r.value for r in forecast.rotate_points(df, points, F.radians("deg")).collect()}
    assert got == {(1, "u10"): 3.0, (1, "v10"): 4.0, (1, "t2m"): 280.0, (2, "u10"): pytest.approx(-4.0), (2, "v10"): pytest.approx(3.0), (2, "t2m"): 280.0}


def test_waves_use_complete_and_posted_cycles(spark):
    rows = [(T0, k, f) for k in range(0, 13) for f in ("hs", "tp")] + [(T0 + 12 * H, k, f) for k in range(0, 13) for f in ("hs", "tp") if not (k == 5 and f == "tp")]
    rows += [(T0 + 24 * H, k, f) for k in range(0, 13) for f in ("hs", "tp")]
    cycles = spark.createDataFrame(rows, "cycle timestamp_ntz, lead int, field string")
    req = spark.createDataFrame([(1, T0 + 11 * H, 1)], "request int, start timestamp_ntz, hours int")
    got = plans.waves(req, cycles, times.ts(str(T0 + 30 * H)), fields=["hs", "tp"], leads=12).orderBy("time").collect()
    assert [(r.cycle, r.lead) for r in got] == [(T0, 10), (T0, 11), (T0, 12), (None, None)]


def test_split_at_switches(spark):
    seg = spark.createDataFrame([(0, T0, False), (1, T0 + 100 * H, False), (2, T0 + 200 * H, True)], "segment int, start timestamp_ntz, tidal boolean")
    req = [(1, 10, 20), (2, 90, 210), (3, 100, 150), (4, -5, 50), (5, 150, 200), (6, 500, 900)]
    df = spark.createDataFrame([(r, T0 + a * H, T0 + b * H) for r, a, b in req], "request int, start timestamp_ntz, end timestamp_ntz")
    pieces = joins.split_window(df, seg)
    got = sorted((r.request, r.segment, int((r.piece_start - T0) / H), int((r.piece_end - T0) / H)) for r in pieces.collect())
    assert got == [(1, 0, 10, 20), (2, 0, 90, 100), (2, 1, 100, 200), (2, 2, 200, 210), (3, 1, 100, 150), (5, 1, 150, 200), (6, 2, 500, 900)]
    assert {r.request: r.tides for r in joins.tidal_content(pieces).collect()} == {1: "none", 2: "mixed", 3: "none", 5: "none", 6: "included"}


def test_source_preference_and_the_missing_midnight(spark):
    files = spark.createDataFrame([(0, "month1", T0 - 1 * H, T0 + 47 * H), (0, "month2", T0 + 48 * H, T0 + 90 * H), (1, "daily", T0 + 24 * H, T0 + 48 * H)], "preference int, file string, begin timestamp_ntz, end timestamp_ntz")
    wanted = spark.createDataFrame([(T0 + h * H,) for h in (0, 47, 48, 49, 91)], "time timestamp_ntz")
    got = {int((r.time - T0) / H): r.file for r in scan.resolve_source(wanted, files).collect()}
    assert got == {0: "month1", 47: "month1", 48: "daily", 49: "month2", 91: None}


def test_ingest_text_with_headers_short_years_and_no_minutes(spark):
    lines = ["#YY MM DD hh WVHT WDIR", "98 04 02 00 99.0 99", "", "2026 04  02 23   MM  999", "2026 13 02 23 1.0 5"]
    got = text.ingest_stdmet(spark.createDataFrame([(x,) for x in lines], "value string"), ["WVHT", "WDIR"], minutes=False).collect()
    assert [(r.time, r.WVHT, r.WDIR) for r in got] == [(dt.datetime(1998, 4, 2), None, 99.0), (dt.datetime(2026, 4, 2, 23), None, None), (None, 1.0, 5.0)]


def test_byte_ranges_end_at_the_next_message_across_blocks(spark):
    rows = [("f", k, f"{k}:{k * 100}:d=1:{'UGRD' if k % 3 == 0 else 'TMP'}:10 m:") for k in range(1, 20)] + [("f", 20, "bad line"), ("g", 1, "1:5:d=1:UGRD:10 m:"), ("g", 2, "2:x:d=1:UGRD:10 m:")]
    got = {(r.file, r.line): (r.start, r.end) for r in text.byte_ranges(spark.createDataFrame(rows, "file string, line int, text string"), [":UGRD:"], block=3).collect()}
    assert got == {**{("f", k): (k * 100, (k + 1) * 100) for k in (3, 6, 9, 12, 15, 18)}, ("g", 1): (5, None)}


def test_file_names_round_trip(spark):
    t = times.ts("2024-03-05 12:00:00")
    name = text.cycle_file_name(F.lit("box"), F.lit("CG1"), t)
    r = spark.range(1).select(name.alias("n"), text.parse_cycle_name(name).alias("c"), text.parse_cycle_name(F.lit("x.nc")).alias("x"), text.lead_file_name(t, F.lit("TMP"), F.lit("AGL-2m"), F.lit(7)).alias("l")).first()
    assert r.n == "box_CG1_20240305_1200.grib2" and r.c == dt.datetime(2024, 3, 5, 12) and r.x is None and r.l == "20240305T12Z_TMP_AGL-2m_PT007H.grib2"


def test_gate_and_publication(spark, tmp_path):
    def store(name, hours, value=1.0):
        return [(name, T0 + h * H, value) for h in hours]

    rows = store("good", range(5)) + store("gap", (0, 1, 2, 4, 5)) + store("short", range(4)) + store("empty", range(5), None) + [("jitter", T0 + k * H + dt.timedelta(seconds=k), 1.0) for k in range(5)]
    df = spark.createDataFrame(rows, "store_id string, time timestamp_ntz, temp double")
    staging, manifest = str(tmp_path / "staging"), str(tmp_path / "manifest")
    gate = {r.store_id: r.fault for r in publish.publish(df, "store_id", ["temp"], 5, staging, manifest).collect()}
    assert gate == {"good": None, "gap": "not hourly", "short": "record count", "empty": "field missing", "jitter": "not hourly"}
    publish.publish(spark.createDataFrame(store("short", (4,)), df.schema), "store_id", ["temp"], 5, staging, manifest)
    listed = spark.read.parquet(manifest)
    assert sorted(r.store_id for r in listed.collect()) == ["good", "short"]
    assert publish.published(spark.read.parquet(staging), listed, "store_id").count() == 10


def hours_of(spark, rows):
    return spark.createDataFrame([(k, T0 + h * H, cell, v) for k, h, cell, v in rows], "k string, time timestamp_ntz, cell int, v double")


def test_replays_late_rows_and_repeats_leave_what_readers_get(spark, tmp_path):
    staging, manifest = str(tmp_path / "staging"), str(tmp_path / "manifest")

    def attempt(number, rows):
        gate = publish.publish(hours_of(spark, rows), ["k"], ["v"], 4, staging, manifest, number, cells=["cell"])
        return {r.k: r.fault for r in gate.collect()}

    def seen():
        return sorted((r.k, int((r.time - T0) / H), r.cell, r.v) for r in publish.read_published(spark, hours_of(spark, []).schema, ["k"], staging, manifest).collect())

    two = lambda k, hours, v: [(k, h, c, v) for h in hours for c in (0, 1)]
    assert seen() == []
    assert attempt(1, two("a", (0, 1), 1.0) + two("b", range(4), 2.0) + two("c", range(4), 3.0) + [("c", 2, 0, 9.0)]) == {"a": "record count", "b": None, "c": "repeated record"}
    b = two("b", range(4), 2.0)
    assert seen() == sorted(b)
    # An attempt that has ended is not made again, whatever it brings.
    assert attempt(1, two("a", range(4), 7.0)) == {"a": "record count", "b": None, "c": "repeated record"}
    # Late rows of a listed store stay out; of hours that come twice the first counts; a whole hour replaces a repeated one.
    assert attempt(2, two("b", (3, 4), 8.0) + two("a", (1, 2), 5.0) + two("c", (2,), 6.0)) == {"a": "record count", "b": "record count", "c": None}
    c = two("c", (0, 1, 3), 3.0) + two("c", (2,), 6.0)
    assert seen() == sorted(b + c)
    assert attempt(3, two("a", (3,), 4.0)) == {"a": None}
    a = two("a", (0, 1), 1.0) + two("a", (2,), 5.0) + two("a", (3,), 4.0)
    assert seen() == sorted(a + b + c)
    # One that broke off before it was listed starts anew.
    rows = hours_of(spark, two("d", range(4), 1.0))
    rows.withColumn("day", F.to_date("time")).write.partitionBy("day").parquet(f"{staging}/attempt=4")
    assert attempt(4, two("d", range(4), 2.0)) == {"d": None}
    assert seen() == sorted(a + b + c + two("d", range(4), 2.0))
    assert attempt(5, []) == {}


def test_upsert_reads_and_writes_touched_days_only(spark, tmp_path):
    table = str(tmp_path / "table")
    schema = "station int, hour timestamp_ntz, day date, value double, quality string, arrival int"

    def batch(number, rows):
        df = spark.createDataFrame([(s, T0 + h * H, (T0 + h * H).date(), v, q, n) for s, h, v, q, n in rows], schema)
        streaming.upsert_batch(df, number, table, ["station", "hour"], streaming.quality_order())
        return df.schema

    def now(shape):
        return {(r.station, int((r.hour - T0) / H)): (r.value, r.quality) for r in streaming.read_days(spark, table, shape).collect()}

    shape = batch(0, [(1, h, float(h), "p", 1) for h in range(72)])
    assert len(now(shape)) == 72
    batch(1, [(1, 30, 100.0, "v", 2), (1, 31, 101.0, "p", 2), (2, 31, 5.0, "p", 2)])
    batch(2, [(1, 30, 200.0, "p", 3), (1, 31, 201.0, "p", 3)])
    want = {(1, h): (float(h), "p") for h in range(72)} | {(1, 30): (100.0, "v"), (1, 31): (201.0, "p"), (2, 31): (5.0, "p")}
    assert now(shape) == want
    assert [p.name for p in (tmp_path / "table/rows/version=2").iterdir() if p.is_dir()] == ["day=2024-03-02"]
    batch(1, [(1, 0, -1.0, "v", 9)])  # a number that was listed before
    assert now(shape) == want
    batch(3, [])
    assert now(shape) == want


def test_archive_is_create_only(spark, tmp_path):
    rows = [("g", T0 + k * H, float(k)) for k in range(80)]
    df = spark.createDataFrame(rows, "grid string, time timestamp_ntz, v double")
    none = spark.createDataFrame([], "grid string, day timestamp_ntz")
    path = str(tmp_path / "archive")
    new = scan.archive_days(df, none, ["grid"], times.ts(str(T0 + 53 * H)))
    publish.write_archive(new, path, ["grid"])
    kept = spark.read.parquet(path).select("grid", F.col("day").cast("timestamp_ntz").alias("day")).distinct()
    assert [r.day for r in kept.collect()] == [T0]  # the second day's lag is not over
    later = scan.archive_days(df, kept, ["grid"], times.ts(str(T0 + 200 * H)))
    assert sorted({r.day for r in later.select("day").distinct().collect()}) == [T0 + 24 * H, T0 + 48 * H]  # nothing was published past the fourth day


def test_catalogue_search_with_boxes_of_the_whole_earth(spark):
    r = random.Random(2)

    def boxes(n, big):
        out = [(k, w := r.uniform(-170, 170), s := r.uniform(-80, 80), w + r.choice([0, 0.1, 0.5, 8]) * r.random(), s + r.choice([0, 0.1, 0.5, 8]) * r.random(), t := T0 + r.randint(0, 9000) * H, t + r.choice([0, 1, 30, 3000]) * H) for k in range(n)]
        out += [(n + k, -180.0, -90.0, 180.0, 90.0, T0, T0 + 9000 * H) for k in range(big)]
        return out + [(-1, None, 0.0, 1.0, 1.0, T0, T0), (-2, 0.0, 0.0, 1.0, 1.0, T0 + H, T0), (-3, 0.0, 0.0, 1.0, 1.0, None, T0)]

    shape = "west double, south double, east double, north double, time_start timestamp_ntz, time_end timestamp_ntz"
    stores, asks = boxes(700, 1), boxes(500, 2)
    a, b = spark.createDataFrame(stores, "store_id int, " + shape), spark.createDataFrame(asks, "request int, " + shape)
    want = sorted(
        (q[0], s[0]) for q in asks if q[0] >= 0 for s in stores if s[0] >= 0 and s[1] <= q[3] and s[3] >= q[1] and s[2] <= q[4] and s[4] >= q[2] and s[5] <= q[6] and s[6] >= q[5]
    )
    got = joins.search_catalog(a, b)
    assert sorted((x.request, x.store_id) for x in got.collect()) == want and len(want) > 1000
    assert joins.catalog_candidates(a, b).count() < 3 * len(want)


def test_window_rows_are_cut_to_each_request(spark):
    r = random.Random(8)
    day = [T0 + 24 * k * H for k in range(3)]
    boxes = [(b, d, w := r.uniform(-20, 5), s := r.uniform(-20, 5), w + r.uniform(1, 30), s + r.uniform(1, 30)) for b in range(6) for d in day if r.random() < 0.8]
    boxes += [(99, day[0], -180.0, -90.0, 180.0, 90.0)]
    asks = [(q, w := r.uniform(-10, 10), s := r.uniform(-10, 10), w + r.uniform(0, 4), s + r.uniform(0, 4), T0 + r.randint(0, 20) * H, T0 + r.randint(30, 70) * H) for q in range(40)]
    held = [(b, d, d + r.randint(0, 23) * H, r.uniform(-15, 15), r.uniform(-15, 15), n) for n, (b, d) in enumerate([(b, d) for b, d, *_ in boxes] * 20)]
    live = [(d, d + r.randint(0, 23) * H, r.uniform(-15, 15), r.uniform(-15, 15), 10_000 + n) for n, d in enumerate(day * 1500)]
    requests = spark.createDataFrame(asks, "request int, west double, south double, east double, north double, start timestamp_ntz, end timestamp_ntz")
    archive = spark.createDataFrame(boxes, "box int, day timestamp_ntz, west double, south double, east double, north double")
    days = requests.crossJoin(spark.createDataFrame([(d,) for d in day], "day timestamp_ntz"))
    choice = scan.choose_archive(days, archive)
    want = {}
    for q, w, s, e, n, *_ in asks:
        for d in day:
            fit = [((be - bw) * (bn - bs), b) for b, bd, bw, bs, be, bn in boxes if bd == d and bw <= w and bs <= s and be >= e and bn >= n]
            want[q, d] = min(fit)[1] if fit else None
    assert {(c.request, c.day): c.box for c in choice.collect()} == want
    shape = "day timestamp_ntz, time timestamp_ntz, lon double, lat double, n int"
    got = scan.load_window(spark.createDataFrame(held, "box int, " + shape), spark.createDataFrame(live, shape), choice, requests)
    assert got.columns == ["request", "source", "day", "time", "lon", "lat", "n"]
    rows = sorted((x.request, x.source, x.n) for x in got.collect())
    expect = []
    for q, w, s, e, n, t0, t1 in asks:
        for b, d, t, lon, lat, k in [*held, *((None, *x) for x in live)]:
            if want[q, d] == b and w <= lon <= e and s <= lat <= n and t0 <= t < t1:
                expect.append((q, "live" if b is None else "archive", k))
    assert rows == sorted(expect) and {x[1] for x in rows} == {"live", "archive"}


def test_archive_or_live(spark):
    days = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, T0), (1, 0.0, 0.0, 1.0, 1.0, T0 + 24 * H)], "request int, west double, south double, east double, north double, day timestamp_ntz")
    archive = spark.createDataFrame([(7, T0, -1.0, -1.0, 2.0, 2.0), (8, T0, 0.0, 0.0, 1.5, 1.5), (9, T0, 0.2, 0.0, 1.0, 1.0)], "box int, day timestamp_ntz, west double, south double, east double, north double")
    choice = scan.choose_archive(days, archive)
    assert {r.day: (r.box, r.source) for r in choice.collect()} == {T0: (8, "archive"), T0 + 24 * H: (None, "live")}
    kept = spark.createDataFrame([(7, T0, 1.0), (8, T0, 2.0)], "box int, day timestamp_ntz, v double")
    live = spark.createDataFrame([(T0, 3.0), (T0 + 24 * H, 4.0)], "day timestamp_ntz, v double")
    assert sorted(r.v for r in scan.load_window(kept, live, choice).collect()) == [2.0, 4.0]


def test_crop_nulls_outside_the_box(spark):
    cells = [(j, i, float(i), float(j), not (j == 2 and i == 2), 1.0) for j in range(6) for i in range(6)]
    df = spark.createDataFrame(cells, "iy int, ix int, lon double, lat double, wet boolean, v double")
    got = {(r.iy, r.ix): r.v for r in scan.crop(df, (1.5, 1.5, 3.2, 3.2), 1, ["v"]).collect()}
    assert set(got) == {(j, i) for j in range(1, 5) for i in range(1, 5)}
    assert {p for p, v in got.items() if v is not None} == {(2, 3), (3, 2), (3, 3)}


def test_stac_lines(spark, tmp_path):
    row = [("s", "ocean", "F", 1.0, 2.0, 3.0, 4.0, T0, T0 + H), ("t", "ocean", "F", None, 2.0, 3.0, 4.0, T0, T0 + H)]
    cat = spark.createDataFrame(row, "store_id string, kind string, family string, west double, south double, east double, north double, time_start timestamp_ntz, time_end timestamp_ntz")
    path = str(tmp_path / "items")
    publish.write_json_lines(publish.stac_items(cat, "https://example.org/"), path)
    items = {i["id"]: i for i in (json.loads(r.value) for r in spark.read.text(path).collect())}
    assert items["s"]["bbox"] == [1.0, 2.0, 3.0, 4.0] and items["s"]["geometry"]["coordinates"][0][2] == [3.0, 4.0]
    assert items["t"]["bbox"] is None and items["s"]["properties"]["start_datetime"] == "2024-03-01T00:00:00Z"


def test_layers_and_schemas_are_checked(spark):
    df = spark.createDataFrame([(k,) for k in range(5)], "layer int")
    assert sorted(r.layer for r in scan.select_layers(df, [-1, 0, 4], 5).collect()) == [0, 4]
    with pytest.raises(ValueError):
        scan.select_layers(df, [5], 5)
    with pytest.raises(ValueError):
        scan.normalise(df, "other")
    assert schemas.differences(df, "site_below") == ["missing site", "missing below", "unknown layer"]


def test_adapters_are_held_to_their_schema(spark):
    adapters.drop_adapter("bad")

    @adapters.register_adapter("bad")
    def bad(session, box, window):
        return session.createDataFrame([(1,)], "place int")

    with pytest.raises(ValueError, match="missing time"):
        adapters.read_adapter(spark, "bad", None, ("", ""))
    with pytest.raises(ValueError, match="twice"):
        adapters.register_adapter("bad")(bad)
    adapters.drop_adapter("bad")
    with pytest.raises(KeyError):
        adapters.read_adapter(spark, "bad", None, ("", ""))


def test_materialised_results_live_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert work_dir(spark, "x").startswith(shared) and work_dir(spark, "x") != work_dir(spark, "x")
    assert shared in materialise(spark.range(3), "three").inputFiles()[0]


SCHEMA = "station int, time timestamp_ntz, value double"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_hours_close_over_two_arrivals_and_late_readings_are_dropped(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    arrive(spark, source, [(1, T0 + k * H / 4, float(k)) for k in range(24)])

    def run():
        stream = streaming.read_folder(spark, source, spark.read.parquet(source).schema)
        streaming.run_available(streaming.hourly_mean(stream, ["station"]), out, check)
        return {int((r.time - T0) / H): r.value for r in spark.read.parquet(out).collect()}

    first = run()
    assert first == {h: pytest.approx(sum(range(max(0, 4 * h - 2), 4 * h + 2)) / len(range(max(0, 4 * h - 2), 4 * h + 2))) for h in range(0, 5)}
    # One reading far too late, one in time, and new ones that close more hours.
    arrive(spark, source, [(1, T0 + dt.timedelta(minutes=5), 999.0), (1, T0 + 5 * H + dt.timedelta(minutes=5), 100.0)] + [(1, T0 + k * H / 4, float(k)) for k in range(24, 40)])
    second = run()
    assert second[0] == first[0] and second[5] == pytest.approx((18 + 19 + 20 + 21 + 100) / 5) and max(second) == 8


def test_first_write_drops_repeats_across_arrivals(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = [(1, T0 + k * H, float(k)) for k in range(30)]
    for batch in (rows[:20], rows[15:]):
        arrive(spark, source, batch)
        stream = streaming.read_folder(spark, source, spark.read.parquet(source).schema)
        streaming.run_available(streaming.first_write(stream, ["station"]), out, check, ["day"])
    got = spark.read.parquet(out)
    assert got.count() == 30 and sorted(r.day.day for r in got.select("day").distinct().collect()) == [1, 2]


def test_store_is_visible_only_when_its_last_hour_came(spark, tmp_path):
    source, staging, check = (str(tmp_path / n) for n in ("in", "staging", "check"))
    for hours, complete in ((range(3), False), (range(3, 5), True)):
        arrive(spark, source, [(1, T0 + h * H, 1.0) for h in hours])
        stream = streaming.read_folder(spark, source, spark.read.parquet(source).schema)
        gate = streaming.append_records(stream, ["station"], ["value"], 5, staging, check).collect()
        assert [r.complete for r in gate] == [complete]


def test_verified_never_goes_back(spark):
    rows = [(1, 1.0, "p", 1), (1, 2.0, "v", 2), (1, 3.0, "p", 3), (2, 4.0, "p", 1), (2, 5.0, "p", 2)]
    got = {r.k: (r.value, r.quality) for r in streaming.upsert_quality(spark.createDataFrame(rows, "k int, value double, quality string, arrival int"), ["k"]).collect()}
    assert got == {1: (2.0, "v"), 2: (5.0, "p")}
