"""Closed-form cases of the column functions."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from fieldspark.functions import geo, keys, scales, times, vertical, winds
from pyspark.sql import functions as F


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def stamp(text):
    return dt.datetime.fromisoformat(text)


@pytest.mark.parametrize("at, hour", [
    ("2024-01-01 00:29:59.999999", "2024-01-01 00:00:00"),
    ("2024-01-01 00:30:00", "2024-01-01 01:00:00"),
    ("1969-12-31 23:10:00", "1969-12-31 23:00:00"),
])
def test_centred_hour(spark, at, hour):
    assert one(spark, times.centred_hour(times.ts(at)))[0] == stamp(hour)


@pytest.mark.parametrize("at, day", [
    ("2026-03-02 01:00:00", "2026-03-03"), ("2026-03-03 00:00:00", "2026-03-03"), ("2026-03-03 00:00:01", "2026-03-04"), ("2026-03-03 23:00:00", "2026-03-04"),
])
def test_day_file_holds_one_to_midnight(spark, at, day):
    # Records come on the hour; a second past midnight belongs to the hour that follows.
    at = stamp(at)
    if at.second:
        at = at.replace(second=0) + dt.timedelta(hours=1)
    assert one(spark, times.file_date(times.ts(str(at))))[0] == stamp(day)


@pytest.mark.parametrize("cycle, lead", [("2024-05-01 06:00:00", 48), ("2024-05-01 07:00:00", 18), ("2020-12-01 18:00:00", 36), ("2020-12-02 00:00:00", 48)])
def test_longest_lead(spark, cycle, lead):
    assert one(spark, times.max_lead(times.ts(cycle)))[0] == lead


@pytest.mark.parametrize("at, cycle", [("2024-01-01 05:00:00", "2024-01-01 05:00:00"), ("2024-01-01 06:00:00", "2024-01-01 11:00:00"), ("2024-01-01 00:00:00", "2024-01-01 05:00:00"), ("2024-01-01 23:30:00", "2024-01-01 23:00:00")])
def test_nowcast_cycle(spark, at, cycle):
    assert one(spark, times.nowcast_cycle(times.ts(at)))[0] == stamp(cycle)


def test_record_axis_brackets_the_request_and_refuses_odd_starts(spark):
    df = spark.createDataFrame([(1, stamp("2024-01-01 06:00:00"), 2)], "request int, start timestamp_ntz, hours int")
    got = [r.time for r in times.frame_times(df, "start", "hours").orderBy("time").collect()]
    assert got == [stamp("2024-01-01 05:00:00") + dt.timedelta(hours=k) for k in range(5)]
    odd = spark.createDataFrame([(1, stamp("2024-01-01 06:20:00"), 2)], "request int, start timestamp_ntz, hours int")
    with pytest.raises(Exception, match="not on the hour"):
        times.frame_times(odd, "start", "hours").collect()


def test_longitudes_and_seam(spark):
    lon = F.explode(F.array(*[F.lit(x) for x in (179.0, 181.0, -179.5, 0.0, -181.0)]))
    df = spark.range(1).select(lon.alias("lon"))
    assert [r[0] for r in df.select(geo.wrap_lon(F.col("lon"))).collect()] == [179.0, -179.0, -179.5, 0.0, 179.0]
    inside = [r.lon for r in df.where(geo.seam_filter(F.col("lon"), 178.5, -179.2)).collect()]
    assert inside == [179.0, -179.5, -181.0]


def test_local_metres_and_back(spark):
    x, y = geo.to_local(F.lit(-73.2), F.lit(41.1), -73.0, 41.0)
    lon, lat = geo.from_local(x, y, -73.0, 41.0)
    got = one(spark, x, y, lon, lat)
    assert got[0] == pytest.approx(-0.2 * math.pi / 180 * 6.371e6 * math.cos(math.radians(41)))
    assert (got[2], got[3]) == pytest.approx((-73.2, 41.1))


def test_distance_to_box_is_zero_inside(spark):
    box = (-74.0, 40.0, -73.0, 41.0)
    got = one(spark, geo.distance_to_box_km(F.lit(-73.5), F.lit(40.5), *box), geo.distance_to_box_km(F.lit(-73.5), F.lit(42.0), *box))
    assert got[0] == 0.0
    assert got[1] == pytest.approx(6371.0 * math.pi / 180)


def test_lambert_rotation_keeps_speed_and_is_null_on_the_central_meridian(spark):
    cone = math.sin(math.radians(38.5))
    mid = winds.rotate_by(F.lit(3.0), F.lit(4.0), winds.lambert_angle(F.lit(262.5), cone, -97.5))
    side = winds.rotate_by(F.lit(3.0), F.lit(4.0), winds.lambert_angle(F.lit(-73.0), cone, 262.5))
    got = one(spark, *mid, *side)
    assert (got[0], got[1]) == pytest.approx((3.0, 4.0))
    a = math.radians(cone * 24.5)
    assert (got[2], got[3]) == pytest.approx((math.cos(a) * 3 + math.sin(a) * 4, -math.sin(a) * 3 + math.cos(a) * 4))


def test_rotated_pole_round_trip(spark):
    r = winds.geographic_to_rotated(F.lit(-73.0), F.lit(41.0), -36.08852, -114.694858)
    g = winds.rotated_to_geographic(*r, -36.08852, -114.694858)
    assert tuple(one(spark, *g)) == pytest.approx((-73.0, 41.0))


def test_flip_and_components(spark):
    u, v = winds.components(F.lit(20.0), F.lit(90.0))
    got = one(spark, winds.flip_dir(F.lit(270.0)), winds.flip_dir(F.lit(10.0)), u, v)
    assert tuple(got) == pytest.approx((90.0, 190.0, 0.2, 0.0))


def test_omega(spark):
    w = one(spark, winds.omega_to_w(F.lit(-1.0), F.lit(280.0), F.lit(90000.0)))[0]
    assert w == pytest.approx(1.0 / (90000.0 / (287.05 * 280.0) * 9.80665))


@pytest.mark.parametrize("log", [False, True])
def test_codes_round_trip_within_half_a_step(spark, log):
    lo, hi = 0.05, 2.0
    df = spark.range(200).select((F.lit(lo) + (hi - lo) * F.col("id") / 199.0).alias("v"))
    code = scales.encode(F.col("v"), F.lit(lo), F.lit(hi), F.lit(log))
    rows = df.select("v", code.alias("c")).withColumn("d", scales.decode(F.col("c"), F.lit(lo), F.lit(hi), F.lit(log))).collect()
    assert min(r.c for r in rows) == 1 and max(r.c for r in rows) == 255
    half = (math.log(hi) - math.log(lo)) / 508 if log else (hi - lo) / 508
    for r in rows:
        err = abs(math.log(r.d) - math.log(r.v)) if log else abs(r.d - r.v)
        assert err <= half + 1e-12


def test_codes_at_and_beyond_the_ends(spark):
    v = [F.lit(x).cast("double") for x in (-9.0, 9.0)] + [F.lit(None).cast("double"), F.lit(float("nan"))]
    assert list(one(spark, *[scales.encode(x, F.lit(0.0), F.lit(1.0), F.lit(False)) for x in v])) == [1, 255, 0, 0]
    with pytest.raises(Exception, match="no colour scale"):
        one(spark, scales.encode(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(False)))


def test_levels_cover_the_depth(spark):
    centres, faces = vertical.z_levels(11.0, 5.0)
    assert faces == [-15.0, -10.0, -5.0, 0.0] and centres == [-12.5, -7.5, -2.5]
    assert one(spark, vertical.levels_for_depth(F.lit(11.0), 5.0))[0] == centres
    with pytest.raises(ValueError):
        vertical.z_levels(10.0, 0.0)


def test_column_interpolation(spark):
    z = F.array(*[F.lit(x) for x in (-1.0, -3.0, -5.0)])
    v = F.array(*[F.lit(x) for x in (10.0, 30.0, 50.0)])
    at = [vertical.column_at(z, v, F.lit(t), F.lit(-6.0)) for t in (-0.2, -2.0, -5.5, -6.5)]
    land = vertical.column_at(z, v, F.lit(-1.0), F.lit(None).cast("double"))
    assert list(one(spark, *at, land)) == [10.0, 20.0, 50.0, None, None]


def test_box_names(spark):
    name = keys.box_name(F.lit(-73.8), F.lit(40.85), F.lit(-71.8), F.lit(41.3))
    got = one(spark, name, *keys.parse_box_name(name), keys.parse_box_name(F.lit("x"))[0])
    assert got[0] == "40.850N_41.300N_073.800W_071.800W"
    assert list(got)[1:] == [-73.8, 40.85, -71.8, 41.3, None]


def test_keyword_order_decides(spark):
    rules = (("hrrr", "A"), ("ocean", "B"))
    got = one(spark, keys.classify(F.lit("Ocean_HRRR"), rules), keys.classify(F.lit("none"), rules), keys.classify_stem(F.lit("x_ocean_1"), rules), keys.classify_stem(F.lit("xocean"), rules))
    assert list(got) == ["A", None, "B", None]


def test_request_ids_depend_on_the_schema(spark):
    a, b, c = (keys.request_id("atm", s, [F.lit(1), F.lit(v)]) for s, v in (("v1", "x"), ("v2", "x"), ("v1", "x")))
    got = one(spark, a, b, c)
    assert got[0] == got[2] != got[1] and len(got[0]) == len("atm_") + 12


def test_values_that_are_not_finite_are_missing(spark):
    from fieldspark.operators import catalog

    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1, inf), (2, -inf), (3, nan), (4, None), (5, 2.0)], "k int, v double")
    got = {r.k: r.c for r in df.select("k", scales.encode(F.col("v"), F.lit(0.0), F.lit(4.0), F.lit(False)).alias("c")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 128}
    rows = spark.createDataFrame([(1, 10.0, 20.0), (1, nan, 21.0), (1, 12.0, inf)], "store_id int, lon double, lat double").withColumn("time", F.lit("2024-01-01").cast("timestamp_ntz"))
    box = catalog.footprints(rows).first()
    assert (box.west, box.south, box.east, box.north, box.records) == (10.0, 20.0, 12.0, 21.0, 3)
