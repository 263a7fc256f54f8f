"""Series operators against brute force and known answers, with a key that holds a third of all rows."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random
import statistics

import pandas as pd
import pytest
from fieldspark.functions import ordered
from fieldspark.operators import forecast, scales, selection, series
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 3, 1)


def skewed(n=3000, keys=40, seed=3):
    """(key, i, v) with distinct i per key; key 0 has a third of the rows."""
    rng = random.Random(seed)
    seen, rows = set(), []
    while len(rows) < n:
        k = 0 if rng.random() < 1 / 3 else rng.randrange(1, keys)
        i = rng.randrange(20_000 if k == 0 else 900)
        if (k, i) not in seen:
            seen.add((k, i))
            rows.append((k, i, rng.randrange(100)))
    return rows


@pytest.mark.parametrize("extra", [False, True])
def test_neighbours_in_pieces(spark, extra):
    rows = skewed()
    df = spark.createDataFrame(rows, "k int, i int, v int")
    if extra:
        df = df.withColumn("w", F.col("v") * 2)
    got = ordered.with_neighbours(df, ["k"], ["i"], F.floor(F.col("i") / 37), prev={"pi": "i", "pv": "v"}, next={"nv": "v"})
    pdf = pd.DataFrame(rows, columns=["k", "i", "v"]).sort_values(["k", "i"])
    g = pdf.groupby("k")
    want = {(r.k, r.i): (a, b, c) for r, a, b, c in zip(pdf.itertuples(), g["i"].shift(1), g["v"].shift(1), g["v"].shift(-1))}
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        assert tuple(float("nan") if x is None else x for x in (r.pi, r.pv, r.nv)) == pytest.approx(want[(r.k, r.i)], nan_ok=True)


def test_running_sum_in_pieces(spark):
    rows = skewed(seed=5)
    df = spark.createDataFrame(rows, "k int, i int, v int")
    got = ordered.with_running_sum(df, ["k"], ["i"], F.floor(F.col("i") / 11), F.col("v"), "s")
    pdf = pd.DataFrame(rows, columns=["k", "i", "v"]).sort_values(["k", "i"])
    pdf["s"] = pdf.groupby("k")["v"].cumsum()
    want = {(r.k, r.i): r.s for r in pdf.itertuples()}
    assert {(r.k, r.i): r.s for r in got.collect()} == want


@pytest.mark.parametrize("gap, most", [(1, None), (1, 3), (9, None)])
def test_runs(spark, gap, most):
    rows = skewed(seed=7)
    got = series.runs(spark.createDataFrame(rows, "k int, i int, v int"), ["k"], "i", max_gap=gap, max_len=most, block=16)
    want = []
    for k in sorted({r[0] for r in rows}):
        run = []
        for i in sorted(r[1] for r in rows if r[0] == k):
            if run and i - run[-1] <= gap and (most is None or len(run) < most):
                run.append(i)
            else:
                if run:
                    want.append((k, run[0], run[-1], len(run)))
                run = [i]
        want.append((k, run[0], run[-1], len(run)))
    assert sorted(tuple(r) for r in got.collect()) == want


def hourly_frame(spark, hours, station=1):
    rows = [(station, T0 + dt.timedelta(hours=h), float(v)) for h, v in hours.items()]
    return spark.createDataFrame(rows, "station int, time timestamp_ntz, value double")


def window_frame(spark, start, end, station=1):
    return spark.createDataFrame([(station, T0 + dt.timedelta(hours=start), T0 + dt.timedelta(hours=end))], "station int, start timestamp_ntz, end timestamp_ntz")


def values(df):
    return {int((r.time - T0).total_seconds() // 3600): r for r in df.collect()}


def ladder(spark, hours, start, end, n, days=(), normals=(), **kw):
    daily = spark.createDataFrame([(1, d, v) for d, v in days], "station int, date date, value double")
    norm = spark.createDataFrame([(1, d, v) for d, v in normals], "station int, mm_dd string, value double")
    return values(series.gap_ladder(hourly_frame(spark, hours), window_frame(spark, start, end), ["station"], n, daily, norm, **kw))


def test_ladder_rungs(spark):
    hours = {h: 10.0 + h for h in range(0, 72) if h not in (5, 6) and not 10 <= h < 20 and not 30 <= h < 40}
    got = ladder(spark, hours, 0, 71, 3, days=[(T0.date(), 7.0)], normals=[("03-02", 3.0), ("03-01", 1.0)])
    assert sorted(got) == list(range(72))
    assert (got[5].value, got[5].flag) == (15.0, 1) and (got[6].value, got[6].flag) == (16.0, 1)
    assert all((got[h].value, got[h].flag) == (7.0, 2) for h in range(10, 20))
    assert all((got[h].value, got[h].flag) == (3.0, 3) for h in range(30, 40))
    assert all((got[h].value, got[h].flag) == (10.0 + h, 0) for h in hours)


def test_ladder_uses_hours_outside_but_counts_only_those_inside(spark):
    # Measured three hours before the window and at its hour 2: hours 0 and 1 are a run of two.
    got = ladder(spark, {-3: 0.0, 2: 5.0, 3: 6.0}, 0, 3, 2)
    assert (got[0].value, got[0].flag) == (3.0, 1) and (got[1].value, got[1].flag) == (4.0, 1)
    # Too far before the window (more than max_gap + 1): the run is open.
    got = ladder(spark, {-4: 0.0, 2: 5.0}, 0, 3, 2)
    assert got[0].value is None and got[0].flag == 0 and got[3].value is None


def test_ladder_with_no_reading_at_all(spark):
    got = ladder(spark, {500: 1.0}, 0, 4, 6, normals=[("03-01", 2.5)])
    assert [(got[h].value, got[h].flag) for h in range(5)] == [(2.5, 3)] * 5


def test_strict_ladder_refuses_a_hole(spark):
    with pytest.raises(Exception, match="no value for"):
        ladder(spark, {0: 1.0, 30: 2.0}, 0, 30, 2, strict=True)


def test_limited_interpolation_fills_the_head_of_a_long_gap(spark):
    got = values(series.interpolate_limit(hourly_frame(spark, {0: 0.0, 10: 10.0}), window_frame(spark, 0, 12), ["station"], 3))
    assert [got[h].value for h in range(13)] == [0.0, 1.0, 2.0, 3.0] + [None] * 6 + [10.0, None, None]


def test_gaps_match_pandas(spark):
    rng = random.Random(11)
    hours = {h: rng.random() for h in range(-8, 208) if rng.random() < 0.45}
    n = 3
    got = ladder(spark, hours, 0, 199, n)
    s = pd.Series({h: v for h, v in hours.items() if -n - 1 <= h <= 199 + n + 1})
    full = s.reindex(sorted(set(range(200)) | set(s.index)))
    miss = full.isna().to_numpy()
    fill = full.interpolate(method="index", limit_area="inside")
    i = 0
    while i < len(full):
        j = i
        while j < len(full) and miss[j]:
            j += 1
        if j > i and i > 0 and j < len(full) and j - i <= n:
            full.iloc[i:j] = fill.iloc[i:j]
        i = max(j, i + 1)
    for h in range(200):
        want = full[h]
        assert got[h].value == pytest.approx(want) if want == want else got[h].value is None


def test_clean_hourly_keeps_the_last_of_duplicates_and_drops_negatives(spark):
    m = dt.timedelta(minutes=1)
    rows = [(1, T0, 4.0, 1), (1, T0, 8.0, 2), (1, T0 + 29 * m, 2.0, 3), (1, T0 + 30 * m, 9.0, 4), (1, T0 - 30 * m, 5.0, 5), (1, T0 - 31 * m, 7.0, 6), (1, T0 + 40 * m, -1.0, 7), (1, T0 + 50 * m, None, 8)]
    df = spark.createDataFrame(rows, "station int, time timestamp_ntz, value double, arrival int")
    got = values(series.clean_hourly(df, ["station"], "arrival"))
    assert {h: r.value for h, r in got.items()} == {-1: 7.0, 0: 5.0, 1: 9.0}
    two = series.hourly_centred(series.clean(df, ["station", "time"], ["arrival"]), ["station"])
    assert {h: r.value for h, r in values(two).items()} == {-1: 7.0, 0: 5.0, 1: 9.0}


def test_resample_bridges_each_field_on_its_own_steps(spark):
    rows = [("zeta", T0 + dt.timedelta(hours=h), 1, float(h * h)) for h in range(7)]
    rows += [("u", T0 + dt.timedelta(hours=h), c, float(10 * h + c)) for h in (0, 3, 6) for c in (1, 2) if not (h == 3 and c == 2)]
    rows += [("once", T0 + dt.timedelta(hours=2), 1, 5.0)]
    df = spark.createDataFrame(rows, "field string, time timestamp_ntz, cell int, value double")
    got = {(r.field, r.cell, int((r.time - T0).total_seconds() // 3600)): r.value for r in series.resample_hourly(df, ["cell"]).collect()}
    # Every cell of a field has a row for each hour of the axis, null where a bracket is missing.
    assert set(got) == {(f, c, h) for f, c in (("zeta", 1), ("u", 1), ("u", 2), ("once", 1)) for h in range(7)}
    got = {k: v for k, v in got.items() if v is not None}
    assert all(got[("zeta", 1, h)] == h * h for h in range(7))
    assert all(got[("u", 1, h)] == pytest.approx(10 * h + 1) for h in range(7))
    assert [h for f, c, h in sorted(got) if f == "u" and c == 2] == [0, 6]
    assert [h for f, c, h in got if f == "once"] == [2]


def test_first_valid_goes_field_by_field(spark):
    df = spark.createDataFrame([(1, 1, None, 4.0), (1, 2, 3.0, 5.0), (2, 1, None, None)], "k int, n int, u double, v double")
    got = {r.k: (r.u, r.v) for r in series.first_valid(df, ["k"], ["u", "v"], "n").collect()}
    assert got == {1: (3.0, 4.0), 2: (None, None)}


def test_dedupe_by_hash_and_by_row(spark):
    df = spark.createDataFrame([(1, 1, 5.0, "a"), (1, 2, None, "b"), (2, 1, 7.0, "c")], "k int, n int, v double, s string")
    assert sorted(tuple(r) for r in series.dedupe(df, ["k"], ["n"]).collect()) == [(1, 2, None, "b"), (2, 1, 7.0, "c")]
    slim = df.drop("s")
    assert sorted(tuple(r) for r in series.dedupe(slim, ["k"], ["n"]).collect()) == [(1, 2, None), (2, 1, 7.0)]
    assert sorted(tuple(r) for r in series.dedupe(slim, ["k"], ["n"], "first").collect()) == [(1, 1, 5.0), (2, 1, 7.0)]


def test_contiguity_lists_bad_steps(spark):
    hours = [0, 1, 2, 2, 5, 4]
    df = spark.createDataFrame([("s", i, T0 + dt.timedelta(hours=h)) for i, h in enumerate(hours)], "store string, n int, time timestamp_ntz")
    got = {r.n: r.fault for r in series.contiguity(df, ["store"], "n").collect()}
    assert got == {3: "not increasing", 4: "not one hour", 5: "not increasing"}


def test_weighted_percentiles_match_brute_force(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.4 else f"f{i % 5}", round(rng.lognormvariate(0, 2), 3), rng.randrange(1, 9)) for i in range(4000)]
    df = spark.createDataFrame(rows, "field string, x double, w int")
    for buckets, levels in ((4, 3), (1024, 2), (16, 0)):
        got = {(r.field, r.q): r.value for r in scales.weighted_percentiles(df, ["field"], "x", "w", [0.0, 1.0, 50.0, 99.0, 100.0], levels=levels, buckets=buckets).collect()}
        for f in {r[0] for r in rows}:
            mine = sorted((x, w) for g, x, w in rows if g == f)
            total = sum(w for _, w in mine)
            for q in (0.0, 1.0, 50.0, 99.0, 100.0):
                cum = 0
                for x, w in mine:
                    cum += w
                    if cum >= q / 100 * total:
                        break
                assert got[(f, q)] == x


def test_no_task_orders_more_than_the_stated_size(spark, monkeypatch):
    """Heavy tails: nearly all values lie in a millionth of the range, and one value has a third of all rows."""
    rng = random.Random(6)
    rows = [(rng.choice("ab"), math.exp(rng.gauss(0, 9)) if rng.random() < 0.66 else 1.0, rng.randrange(1, 9)) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "field string, x double, w int")
    ranges = []
    stored = selection.materialise
    monkeypatch.setattr(selection, "materialise", lambda frame, name: ranges.append(stored(frame, name)) or ranges[-1])
    got = {(r.field, r.q): r.value for r in scales.weighted_percentiles(df, ["field"], "x", "w", [1.0, 50.0, 99.9], size=50, buckets=16).collect()}
    assert len(ranges) > 2 and max(r["_n"] for r in ranges[-1].collect()) <= 50
    for f in "ab":
        mine = sorted((x, w) for g, x, w in rows if g == f)
        runs = list(itertools.accumulate(w for _, w in mine))
        for q in (1.0, 50.0, 99.9):
            assert got[f, q] == next(x for (x, _), run in zip(mine, runs, strict=True) if run >= q / 100 * runs[-1])
    middle = {r.field: r.median for r in selection.medians(df, ["field"], "x", size=50).collect()}
    assert middle == {f: pytest.approx(statistics.median([x for g, x, _ in rows if g == f])) for f in "ab"}
    assert selection.medians(df.limit(0), ["field"], "x").count() == 0


def test_centred_rate_needs_the_next_hour(spark):
    df = hourly_frame(spark, {0: 3600.0, 1: 7200.0, 3: 1.0})
    got = {int((r.time - T0).total_seconds() // 3600): r.rate for r in forecast.centred_rate(df, ["station"]).collect()}
    assert got == {0: 1.5}
