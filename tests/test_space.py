"""Meshes, weights, grids and spatial joins: closed-form fields and brute force."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from fieldspark.functions import geo
from fieldspark.operators import catalog, composite, joins, mesh, scales, sizes, vertical, weights
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def square(spark):
    """Two triangles on a unit square."""
    nodes = spark.createDataFrame([(0, 0.0, 0.0, 10.0), (1, 1.0, 0.0, 20.0), (2, 1.0, 1.0, 30.0), (3, 0.0, 1.0, 40.0)], "node int, lon double, lat double, h double")
    elements = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 2, 3)], "elem int, n0 int, n1 int, n2 int")
    return nodes, elements


def test_locate_shared_edge_outside_and_weights(spark, square):
    corners = mesh.element_corners(square[1], square[0])
    points = spark.createDataFrame([(0, 0.5, 0.5), (1, 0.75, 0.25), (2, 0.25, 0.75), (3, 1.5, 0.5), (4, 0.0, 0.0)], "point int, lon double, lat double")
    got = {r.point: r for r in mesh.locate(points, corners).collect()}
    assert [got[k].elem for k in range(5)] == [0, 0, 1, None, 0]
    assert (got[1].b0, got[1].b1, got[1].b2) == pytest.approx((0.25, 0.5, 0.25))


def test_locate_matches_brute_force(spark):
    rng = random.Random(1)
    n = 8
    nodes = [(j * n + i, i + rng.uniform(-0.3, 0.3), j + rng.uniform(-0.3, 0.3)) for j in range(n) for i in range(n)]
    tri = []
    for j in range(n - 1):
        for i in range(n - 1):
            a = j * n + i
            tri += [(a, a + 1, a + n + 1), (a, a + n + 1, a + n)]
    pts = [(k, rng.uniform(-0.5, n - 0.5), rng.uniform(-0.5, n - 0.5)) for k in range(400)]
    nd = spark.createDataFrame(nodes, "node int, lon double, lat double")
    el = spark.createDataFrame([(e, *t) for e, t in enumerate(tri)], "elem int, n0 int, n1 int, n2 int")
    got = {r.point: r.elem for r in mesh.locate(spark.createDataFrame(pts, "point int, lon double, lat double"), mesh.element_corners(el, nd)).collect()}
    xy = {k: (x, y) for k, x, y in nodes}

    def host(px, py):
        for e, t in enumerate(tri):
            (x0, y0), (x1, y1), (x2, y2) = (xy[v] for v in t)
            d = (y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2)
            b0, b1 = ((y1 - y2) * (px - x2) + (x2 - x1) * (py - y2)) / d, ((y2 - y0) * (px - x2) + (x0 - x2) * (py - y2)) / d
            if min(b0, b1, 1 - b0 - b1) >= -1e-9:
                return e
        return None

    assert got == {k: host(x, y) for k, x, y in pts}


def test_neighbours_and_an_overfull_edge(spark, square):
    got = {(r.elem, r.k): r.neighbour for r in mesh.neighbours(square[1]).collect()}
    assert got == {(0, 0): -1, (0, 1): 1, (0, 2): -1, (1, 0): -1, (1, 1): -1, (1, 2): 0}
    bad = square[1].unionByName(spark.createDataFrame([(2, 2, 0, 3)], square[1].schema))
    with pytest.raises(Exception, match="more than two elements"):
        mesh.neighbours(bad).collect()


def test_subset_rim_is_not_coast(spark, square):
    elements, nodes = mesh.subset_mesh(square[1], square[0], (0.5, 0.0, 1.0, 0.5))
    r = elements.first()
    assert (r.elem, r.nb0, r.nb1, r.nb2) == (0, -1, -2, -1)
    assert {n.node: n.on_boundary for n in nodes.collect()} == {0: True, 1: True, 2: True}


def test_area_of_a_square(spark, square):
    total = mesh.element_area(mesh.element_corners(square[1], square[0])).agg(F.sum("area_m2")).first()[0]
    side = math.radians(1) * 6.371e6
    assert total == pytest.approx(side * side, rel=1e-3)


def test_polygon_area_with_a_hole(spark):
    def ring(name, w, s, size, hole):
        xy = [(w, s), (w + size, s), (w + size, s + size), (w, s + size), (w, s)]
        return [("p", name, k, x, y, hole) for k, (x, y) in enumerate(xy)]

    rows = ring("a", 0.0, 0.0, 1.0, False) + ring("b", 0.25, 0.25, 0.5, True)
    df = spark.createDataFrame(rows, "polygon string, ring string, seq int, lon double, lat double, hole boolean")
    got = mesh.polygon_area(df, ["polygon"], block=2).first()
    side = math.radians(1) * 6371.0088
    assert got.area_sqmi * 2.589988110336 == pytest.approx(side * side * 0.75, rel=1e-3) and got.rings == 2


@pytest.mark.parametrize("block", [1, 2, 100])
def test_samples_are_even_and_complete(spark, block):
    rng = random.Random(4)
    rows = [(line, k, -73 + rng.uniform(-1, 1), 41 + rng.uniform(-1, 1)) for line in range(6) for k in range(2 + line * 3)]
    df = spark.createDataFrame(rows, "line int, seq int, lon double, lat double")
    got = mesh.sample_line(df, 17, block=block).collect()
    for line in range(6):
        mine = sorted((r for r in got if r.line == line), key=lambda r: r.k)
        pts = [(x, y) for g, _, x, y in rows if g == line]
        assert [r.k for r in mine] == list(range(17))
        assert (mine[0].lon, mine[0].lat) == pytest.approx(pts[0]) and (mine[-1].lon, mine[-1].lat) == pytest.approx(pts[-1])
        steps = [b.distance - a.distance for a, b in zip(mine, mine[1:])]
        assert max(steps) == pytest.approx(min(steps))


def test_a_line_of_no_length(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 2.0), (0, 1, 1.0, 2.0)], "line int, seq int, lon double, lat double")
    got = mesh.sample_line(df, 5).collect()
    assert sorted(r.k for r in got) == [0, 1, 2, 3, 4] and {(round(r.lon, 9), round(r.lat, 9)) for r in got} == {(1.0, 2.0)}


def test_section_values_and_bed(spark, square):
    corners = mesh.element_corners(square[1], square[0], ("lon", "lat", "h"))
    line = spark.createDataFrame([(0, 0, 0.6, 0.1), (0, 1, 0.9, 0.1)], "line int, seq int, lon double, lat double")
    field = spark.createDataFrame([(e, k, float(e + 100 * k)) for e in (0, 1) for k in range(3)], "elem int, layer int, value double")
    got = mesh.section(line, corners, field, 4).collect()
    assert len(got) == 12 and {(r.layer, r.value) for r in got} == {(k, 100.0 * k) for k in range(3)}
    for r in got:  # h = 10 + 10 lon + 10 lat on element 0
        assert r.bed == pytest.approx(-(10 + 10 * r.lon + 10 * r.lat), abs=1e-3)


def test_structured_grid_and_edges(spark):
    cells = spark.createDataFrame([(j, i, not (j == 1 and i == 1)) for j in range(2) for i in range(3)], "iy int, ix int, wet boolean")
    got = mesh.export_ids(mesh.structured_mesh(cells, 3), "elem", block=3).orderBy("elem").collect()
    assert [r.local for r in got] == list(range(10)) and [r.source_index for r in got] == [0, 0, 1, 1, 2, 2, 3, 3, 5, 5]
    assert (got[0].n0, got[0].n1, got[0].n2, got[1].n2) == (0, 1, 5, 4)
    axes = spark.createDataFrame([("x", i, v) for i, v in enumerate((0.0, 1.0, 3.0))], "axis string, i int, centre double")
    assert [r.value for r in mesh.cell_edges(axes, block=2).orderBy("edge").collect()] == [-0.5, 0.5, 2.0, 4.0]


def test_corners_of_a_linear_grid_are_linear(spark):
    grid = spark.createDataFrame([(j, i, 2.0 * j + 3.0 * i) for j in range(4) for i in range(5)], "iy int, ix int, v double")
    got = {(r.jy, r.jx): r.v for r in mesh.cell_corners(grid, 4, 5, "v").collect()}
    assert len(got) == 30 and all(v == pytest.approx(2 * (j - 0.5) + 3 * (i - 0.5)) for (j, i), v in got.items())


def test_thinning_keeps_all_or_about_the_limit(spark):
    df = spark.range(2500).select(F.col("id").alias("elem"), (F.col("id") % 50 / 100.0).alias("lon"), (F.floor(F.col("id") / 50) / 100.0).alias("lat"), F.lit(1.11e6 ** 1).alias("area_m2"))
    assert mesh.thin_columns(df, 5000).count() == 2500
    assert 50 <= mesh.thin_columns(df, 100).count() <= 400


def test_idw_weights_match_brute_force_and_sum_to_one(spark):
    rng = random.Random(8)
    cells = [(j, i, -73 + i * 0.03, 41 + j * 0.03) for j in range(20) for i in range(20) if rng.random() < 0.7]
    pts = [(k, -73 + rng.uniform(-0.1, 0.7), 41 + rng.uniform(-0.1, 0.7)) for k in range(60)] + [(60, cells[5][2], cells[5][3])]
    got = {}
    df = weights.idw_weights(spark.createDataFrame(pts, "point int, lon double, lat double"), spark.createDataFrame(cells, "iy int, ix int, lon double, lat double"), 4, 6.0)
    for r in df.collect():
        got.setdefault(r.point, {})[(r.iy, r.ix)] = r.w
    for k, x, y in pts:
        d = sorted((math.hypot((cx - x) * 111.32 * math.cos(math.radians(y)), (cy - y) * 110.57), j, i) for j, i, cx, cy in cells)[:4]
        near = [t for t in d if t[0] <= 6.0]
        assert set(got.get(k, {})) == {(j, i) for _, j, i in near}
        if near:
            assert sum(got[k].values()) == pytest.approx(1.0)
            raw = [1 / t[0] ** 2 if near[0][0] > 1e-6 else float(n == 0) for n, t in enumerate(near)]
            assert [got[k][(j, i)] for _, j, i in near] == pytest.approx([w / sum(raw) for w in raw])


def test_weights_with_a_missing_cell_give_null(spark):
    w = spark.createDataFrame([(0, 0, 0, 0.5), (0, 0, 1, 0.5), (1, 0, 0, 1.0)], "target int, iy int, ix int, w double")
    f = spark.createDataFrame([(1, 0, 0, 2.0), (1, 0, 1, 4.0), (2, 0, 0, 2.0), (3, 0, 0, 2.0), (3, 0, 1, None)], "time int, iy int, ix int, v double")
    got = {(r.time, r.target): r.v for r in weights.apply_weights(f, w, ["time"], ["v"]).collect()}
    assert got == {(1, 0): 3.0, (1, 1): 2.0, (2, 0): None, (2, 1): 2.0, (3, 0): None, (3, 1): 2.0}


def test_track_interpolation_reproduces_a_linear_field(spark):
    """u = 2 lon + 3 lat + 0.5 z + 0.1 h."""
    grid = [(t, k, j, i, 2 * (-73 + 0.1 * i) + 3 * (41 + 0.1 * j) + 0.5 * (-8 + 2 * k) + 0.1 * t) for t in range(4) for k in range(4) for j in range(6) for i in range(6)]
    g = spark.createDataFrame(grid, "it int, iz int, iy int, ix int, u double")
    pts = [(0, 90.0, -72.77, 41.23, -3.3), (1, 0.0, -73.0, 41.0, -8.0), (2, 180.0, -72.5, 41.5, -2.0), (3, 30.0, -72.81, 41.07, -0.5),
           (4, 30.0, -73.2, 41.1, -3.0), (5, 30.0, -72.8, 41.1, -9.0), (6, 999.0, -72.8, 41.1, -3.0)]
    rows = [("t", o, T0 + dt.timedelta(minutes=m), x, y, z) for o, m, x, y, z in pts]
    track = spark.createDataFrame(rows, "trajectory_id string, obs int, time timestamp_ntz, lon double, lat double, z double")
    out = weights.interpolate_track(track, g, weights.Axis(-73.0, 0.1, 6), weights.Axis(41.0, 0.1, 6), str(T0), 1, 4, [-8.0, -6.0, -4.0, -2.0], ["u"])
    got = {r.obs: r.u for r in out.collect()}
    for o, m, x, y, z in pts[:4]:
        assert got[o] == pytest.approx(2 * x + 3 * y + 0.5 * min(z, -2.0) + 0.1 * m / 60)
    assert [got[o] for o in (4, 5, 6)] == [None, None, None]
    holed = g.where("NOT (it = 1 AND iz = 2 AND iy = 2 AND ix = 2)")
    out = weights.interpolate_track(track, holed, weights.Axis(-73.0, 0.1, 6), weights.Axis(41.0, 0.1, 6), str(T0), 1, 4, [-8.0, -6.0, -4.0, -2.0], ["u"])
    assert {r.obs: r.u for r in out.collect()}[0] is None


@pytest.mark.parametrize("salt", [1, 7])
def test_points_in_boxes_with_a_crowded_tile(spark, salt):
    rng = random.Random(6)
    pts = [(k, rng.choice([0.1, rng.uniform(-3, 3)]), rng.choice([0.1, rng.uniform(-3, 3)])) for k in range(600)]
    boxes = []
    for b in range(40):
        w, s = rng.uniform(-3, 2), rng.uniform(-3, 2)
        boxes.append((b, w, s, w + rng.uniform(0, 2), s + rng.uniform(0, 2)))
    got = joins.points_in_boxes(spark.createDataFrame(pts, "p int, lon double, lat double"), spark.createDataFrame(boxes, "box int, west double, south double, east double, north double"), salt=salt)
    want = sorted((p, b) for p, x, y in pts for b, w, s, e, n in boxes if w <= x <= e and s <= y <= n)
    assert sorted((r.p, r.box) for r in got.collect()) == want


def test_a_box_across_the_seam(spark):
    pts = [(k, x, 0.5) for k, x in enumerate((179.0, -179.0, 0.0, -5.0, 180.0, -180.0, -15.0, 100.0))]
    boxes = [(1, 178.0, 0.0, -178.0, 1.0), (2, -10.0, 0.0, -20.0, 1.0), (3, -6.0, 0.0, 6.0, 1.0)]
    got = joins.points_in_boxes(spark.createDataFrame(pts, "p int, lon double, lat double"), spark.createDataFrame(boxes, "box int, west double, south double, east double, north double"))
    want = {1: [0, 1, 4, 5], 2: [0, 1, 2, 3, 4, 5, 7], 3: [2, 3]}
    assert sorted((r.box, r.p) for r in got.collect()) == [(b, p) for b in want for p in want[b]]


def test_nearest_site_near_and_far(spark):
    rng = random.Random(9)
    sites = [(k, rng.uniform(-75, -74), rng.uniform(40, 41)) for k in range(50)] + [(50, 100.0, -60.0)]
    pts = [(k, rng.uniform(-75.5, -73.5), rng.uniform(39.5, 41.5)) for k in range(80)] + [(80, 95.0, -50.0), (81, 0.0, 0.0), (82, -60.0, 60.0)]
    got = {r.point: r.site for r in joins.nearest_site(spark.createDataFrame(pts, "point int, lon double, lat double"), spark.createDataFrame(sites, "site int, lon double, lat double")).collect()}
    for k, x, y in pts:
        c = math.cos(math.radians(y))
        assert got[k] == min((round(((sx - x) * c) ** 2 + (sy - y) ** 2, 12), s) for s, sx, sy in sites)[1]


def test_overlap_join_lists_each_pair_once(spark):
    rng = random.Random(10)
    def spans(n):
        out = []
        for k in range(n):
            a = rng.randrange(0, 400)
            out.append((k, T0 + dt.timedelta(hours=a), T0 + dt.timedelta(hours=a + rng.randrange(0, 90))))
        return out
    a, b = spans(60), spans(50)
    got = joins.overlap_join(spark.createDataFrame(a, "a int, a0 timestamp_ntz, a1 timestamp_ntz"), spark.createDataFrame(b, "b int, b0 timestamp_ntz, b1 timestamp_ntz"), ("a0", "a1"), ("b0", "b1"), 7 * 3_600_000_000)
    want = sorted((i, j) for i, s, e in a for j, p, q in b if s <= q and p <= e)
    assert sorted((r.a, r.b) for r in got.collect()) == want


def test_composite_ties_go_opposite_ways(spark):
    t = T0
    rows = [(0, t, 0, 0, 1.0), (1, t, 0, 0, 2.0), (0, t - dt.timedelta(days=1), 0, 1, 3.0), (1, t, 0, 1, None), (2, t - dt.timedelta(days=30), 0, 2, 9.0)]
    df = spark.createDataFrame(rows, "sensor int, time timestamp_ntz, iy int, ix int, value double")
    end = F.lit("2024-03-01 12:00:00").cast("timestamp_ntz")
    got = {r.ix: r for r in composite.composite(df, end, 7).collect()}
    assert set(got) == {0, 1} and (got[0].value, got[0].product_index, got[0].age_days) == (1.0, 0, 0.5) and got[1].age_days == 1.5
    frames = {(r.frame, r.ix): r for r in composite.composite_series(df, "2024-02-29 00:00:00", 1, 12, 2).collect()}
    assert frames[(1, 0)].value == 2.0 and frames[(3, 0)].value == 2.0 and (4, 0) not in frames
    assert {f for f, x in frames if x == 1} == {0, 1, 2} and (0, 0) not in frames
    # Sensors of any number, and of either sign, keep their order at equal times.
    many = spark.createDataFrame([(s, t, 0, s % 5, float(s)) for s in range(-100, 400)], df.schema)
    for lowest in ({r.ix: (r.value, r.product_index) for r in composite.composite(many, end, 7).collect()},):
        assert lowest == {x: (float(-100 + x), x) for x in range(5)}


def test_coast_mask_is_erosion_by_a_cross(spark):
    rng = random.Random(12)
    n = 14
    water = {(j, i): rng.random() < 0.93 for j in range(n) for i in range(n)}
    df = spark.createDataFrame([(j, i, 1.0 if w else None) for (j, i), w in water.items()], "iy int, ix int, value double")
    keep = dict(water)
    for _ in range(2):
        keep = {(j, i): all(keep.get(p, True) for p in ((j, i), (j - 1, i), (j + 1, i), (j, i - 1), (j, i + 1))) for j, i in keep}
    assert {(r.iy, r.ix) for r in composite.mask_coast(df, 2).collect()} == {p for p, k in keep.items() if k}


def test_faces_both_ways(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, None)], "i int, u double").withColumn("row", F.lit(0))
    after = {r.i: r.u for r in vertical.faces_to_centres(df, "i", ["row"], "u").collect()}
    assert after == {0: 2.0, 1: None, 2: None}
    before = {r.i: r.u for r in vertical.faces_to_centres(df, "i", ["row"], "u", before=True, land_as_zero=True, centres=4).collect()}
    assert before == {0: 1.0, 1: 2.0, 2: 1.5, 3: 0.0}


def test_levels_reach_the_deepest_wet_layer(spark):
    rows = [(0, k, 1.0 if k <= 5 else None, 2.0) for k in range(10)] + [(1, k, 1.0 if k == 0 else None, 2.0) for k in range(10)]
    got = vertical.spread_levels(spark.createDataFrame(rows, "col int, layer int, u double, v double"), ["col"], 3).collect()
    assert sorted((r.col, r.slot, r.layer, r.u) for r in got if r.col == 0) == [(0, 0, 0, 1.0), (0, 1, 2, 1.0), (0, 2, 5, 1.0)]
    assert [r.u for r in sorted((r for r in got if r.col == 1), key=lambda r: r.slot)] == [1.0, None, None]


def test_only_columns_that_points_need_are_moved(spark):
    grid = spark.createDataFrame([(t, k, j, i, 1.0) for t in range(3) for k in range(2) for j in range(20) for i in range(20)], "it int, iz int, iy int, ix int, u double")
    wanted = {(1, 4, 5), (1, 4, 6), (2, 17, 3)}
    corners = spark.createDataFrame([*wanted, *wanted], "it int, iy int, ix int")
    got = weights.needed_cells(grid, corners).collect()
    assert {(r.it, r.iy, r.ix) for r in got} == wanted and len(got) == 6
    # A look-up table of two rows only: whole squares of columns.
    some = {(r.it, r.iy, r.ix) for r in weights.needed_cells(grid, corners, most=2).collect()}
    assert wanted < some and len(some) < 100
    assert wanted < {(r.it, r.iy, r.ix) for r in weights.needed_cells(grid, corners, most=1).collect()}
    assert weights.needed_cells(grid, corners.limit(0)).count() == 0


def test_quantised_tracks_are_within_half_a_step(spark):
    rng = random.Random(13)
    rows = [(k, -73 + rng.uniform(0, 0.2), 41 + rng.uniform(0, 0.2), -rng.uniform(0, 30), k % 10 != 0) for k in range(300)]
    out = scales.quantize_track(spark.createDataFrame(rows, "k int, lon double, lat double, z double, alive boolean"), -73.0, 41.0).collect()
    assert max(r.code_z for r in out) == 32767 and min(r.code_z for r in out) == -32767
    for r in out:
        if r.alive:
            assert abs(r.offset_z + r.scale_z * r.code_z - r.z) <= r.scale_z / 2 + 1e-9
        else:
            assert (r.code_x, r.code_y, r.code_z) == (0, 0, 0)


def test_coverage_counts_hours_once(spark):
    rows = [("A", T0 + dt.timedelta(hours=20), T0 + dt.timedelta(hours=26)), ("A", T0 + dt.timedelta(hours=22), T0 + dt.timedelta(hours=22)), ("B", T0, T0 + dt.timedelta(hours=23))]
    got = {(r.family, r.day.day): (r.hours, r.stores) for r in catalog.coverage(spark.createDataFrame(rows, "family string, time_start timestamp_ntz, time_end timestamp_ntz")).collect()}
    assert got == {("A", 1): (4, 2), ("A", 2): (3, 1), ("B", 1): (24, 1)}


def test_same_cells(spark):
    rows = [("w", f, c) for f in (1, 2) for c in (1, 2, 3)] + [("x", 1, 1), ("x", 1, 2), ("x", 2, 1), ("x", 2, 3)]
    got = {r.w: r.same for r in catalog.same_cells(spark.createDataFrame(rows, "w string, f int, c int"), ["w"], ["f"], ["c"]).collect()}
    assert got == {"w": True, "x": False}


def test_broadcast_only_below_the_limit(spark):
    df = spark.range(20)
    assert "broadcast" in sizes.small(df, 20)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in sizes.small(df, 19)._jdf.queryExecution().analyzed().toString().lower()


def test_footprint_of_stores(spark):
    rows = [(1, 359.0, 10.0, T0), (1, 359.5, 11.0, T0), (2, 5.0, 95.0, T0), (3, 400.0, 1.0, T0)]
    got = {r.store_id: (r.west, r.south, r.east, r.north) for r in catalog.footprints(spark.createDataFrame(rows, "store_id int, lon double, lat double, time timestamp_ntz")).collect()}
    assert got == {1: (-1.0, 10.0, -0.5, 11.0), 2: (None,) * 4, 3: (None,) * 4}


def test_weights_reach_across_longitudes_near_a_pole(spark):
    cells = [(0, k, float(lon), lat) for k, (lon, lat) in enumerate([(10, 89.8), (-170, 89.81), (60, 89.79), (5, 89.99), (120, 89.999)])]
    points = [(1, 0.0, 89.8), (2, 100.0, 89.9995)]
    got = weights.idw_weights(
        spark.createDataFrame(points, "point int, lon double, lat double"), spark.createDataFrame(cells, "iy int, ix int, lon double, lat double"), k=5, max_km=6.0
    )
    want = set()
    for p, plon, plat in points:
        for _, ix, lon, lat in cells:
            dx = (lon - plon) * geo.KM_PER_DEG_LON * math.cos(math.radians(plat))
            if math.hypot(dx, (lat - plat) * geo.KM_PER_DEG_LAT) <= 6.0:
                want.add((p, ix))
    assert (1, 0) in want and len(want) > 2
    assert {(r.point, r.ix) for r in got.collect()} == want


def test_composite_series_of_any_number_of_sensors(spark):
    rows = [(0, 0, f"2024-01-0{1 + s // 150} 00:00:00", s, float(s)) for s in range(300)]
    pixels = spark.createDataFrame(rows, "iy int, ix int, t string, sensor int, value double").withColumn("time", F.col("t").cast("timestamp_ntz"))
    series = composite.composite_series(pixels, "2024-01-01 00:00:00", 1, 2, 7)
    assert [(r.frame, r.value, r.sensor) for r in series.orderBy("frame").collect()] == [(0, 149.0, 149), (1, 299.0, 299)]
    assert "SortAggregate" not in series._jdf.queryExecution().executedPlan().toString()
    old = pixels.withColumn("time", F.col("time") - F.expr("INTERVAL 100 YEARS")).withColumn("sensor", F.col("sensor") + F.expr("-9223372036854775807L"))
    assert composite.composite_series(old, "1924-01-01 00:00:00", 1, 1, 7).first().sensor == -(2**63) + 150
