"""Sparse weights: nearest water cells, regridding, and interpolation along tracks."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions import geo, times
from fieldspark.operators import sizes
from fieldspark.session import materialise


def idw_weights(points: DataFrame, cells: DataFrame, k: int = 4, max_km: float = 6.0, *, point: str = "point", steps: int = 2, shrink: float = 4.0) -> DataFrame:
    """(point, iy, ix, km, w): up to `k` nearest cells not farther than `max_km`, weights 1/d^2 normalised; a
    point on a cell's centre takes that cell alone. Give water cells only. Distances equal to a micrometre tie and
    go by cell.

    The radius grows by `shrink` in `steps` steps to `max_km`: where the grid is fine, k cells are found within the
    first, and only points that lack them look farther, so a fine grid never pairs every cell in reach with every
    point. Cells and points meet in tiles of the radius."""
    c = cells.select("iy", "ix", geo.wrap_lon(F.col("lon")).alias("_lon"), F.col("lat").alias("_lat"))
    left = points.select(point, F.col("lon").alias("_plon"), F.col("lat").alias("_plat"))
    order = Window.partitionBy(point).orderBy(F.floor(F.col("km") * 1e9 + 0.5), "iy", "ix")
    top = None
    for step in reversed(range(steps)):
        reach = max_km / shrink**step
        size = reach / geo.KM_PER_DEG_LAT
        # Degrees of longitude in reach; all of them close to a pole.
        wide = F.lit(reach / geo.KM_PER_DEG_LON) / F.greatest(F.cos(F.radians("_plat")), F.lit(1e-9))
        west, east = (F.when(wide < 180, F.col("_plon") + side * wide).otherwise(180.0 * side) for side in (-1, 1))
        p = left.withColumn("_tx", F.explode(geo.tile_range(west, east, size)))
        p = p.withColumn("_ty", F.explode(geo.tile_range(F.col("_plat") - size, F.col("_plat") + size, size)))
        held = c.withColumns({"_tx": geo.tile(F.col("_lon"), size), "_ty": geo.tile(F.col("_lat"), size)})
        km = geo.planar_km(F.col("_lon"), F.col("_lat"), F.col("_plon"), F.col("_plat"))
        near = p.join(held, ["_tx", "_ty"]).withColumn("km", km).where(F.col("km") <= reach)
        best = near.select(point, "_plon", "_plat", "iy", "ix", "km").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
        if step:
            enough = best.where(F.col("_r") == k).select(point)
            left = left.join(enough, point, "left_anti")
            best = best.join(enough, point, "left_semi")
        top = best if top is None else top.unionByName(best)
    every = Window.partitionBy(point)
    exact = F.min("km").over(every) < 1e-6
    raw = F.when(exact, F.when(F.col("_r") == 1, 1.0).otherwise(0.0)).otherwise(F.lit(1.0) / (F.col("km") * F.col("km")))
    return top.withColumn("_raw", raw).withColumn("w", F.col("_raw") / F.sum("_raw").over(every)).select(point, "iy", "ix", "km", "w")


def apply_weights(
    field: DataFrame, weights: DataFrame, step: Sequence[str], values: Sequence[str], *, cell: Sequence[str] = ("iy", "ix"), target: str = "target"
) -> DataFrame:
    """Each target's weighted sum per step (time, layer, ...); null where any of its cells is missing, whether
    as a null or as an absent row. Steps with none of a target's cells have no row."""
    met = sizes.weighted_cells(field.select(*step, *cell, *values), weights, cell, target)
    agg = [F.max("_n").alias("_n")]
    for v in values:
        agg += [F.sum(F.col("w") * F.col(v)).alias("_s_" + v), F.count(v).alias("_c_" + v)]
    out = met.groupBy(*step, target).agg(*agg)
    return out.select(*step, target, *[F.when(F.col("_c_" + v) == F.col("_n"), F.col("_s_" + v)).alias(v) for v in values])


@dataclass(frozen=True)
class Axis:
    """A regular axis: first centre, step and count."""

    start: float
    step: float
    count: int


def _bracket(x: Column, n: int) -> tuple[Column, Column]:
    """Lower index and share of the upper one for a fractional index within 0..n-1."""
    low = F.least(F.floor(x).cast("int"), F.lit(max(n - 2, 0)))
    return low, x - low


COLUMN = ("it", "iy", "ix")


def needed_cells(grid: DataFrame, corners: DataFrame, most: int = sizes.MOST_NARROW_ROWS) -> DataFrame:
    """The rows of `grid` in one of the columns that `corners(it, iy, ix)` names, and perhaps some near them: what is worth moving.

    The distinct corners are stored once. Their ends prune the scan of the grid as plain comparisons; the corners themselves, or where
    they are more than `most` the squares of columns that hold them, are a look-up table small enough to send to the scan."""
    wanted = materialise(corners.distinct(), "corners")
    ends = wanted.agg(*[f(c).alias(f"{n}_{c}") for c in COLUMN for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if ends is None or ends[0] is None:
        return grid.where(F.lit(False))
    for c in COLUMN:
        grid = grid.where(F.col(c).between(ends[f"lo_{c}"], ends[f"hi_{c}"]))
    side = 1
    while True:
        squares = [F.floor(F.col(c) / F.lit(1 if c == "it" else side)).cast("long").alias(f"_{c}") for c in COLUMN]
        held = wanted.select(*squares).distinct()
        if sizes.is_small(held, most):
            break
        if side > max(ends["hi_iy"] - ends["lo_iy"], ends["hi_ix"] - ends["lo_ix"]):
            return grid  # more times than a look-up table may have rows
        side *= 4
    marked = grid.select("*", *squares)
    return marked.join(F.broadcast(held), [f"_{c}" for c in COLUMN], "left_semi").select(*grid.columns)


def interpolate_track(
    track: DataFrame, grid: DataFrame, lon: Axis, lat: Axis, start: str, step_hours: int, steps: int, levels: Sequence[float],
    values: Sequence[str], *, key: Sequence[str] = ("trajectory_id", "obs"),
) -> DataFrame:
    """Values of `grid(it, iz, iy, ix, values...)` at each point of `track(key..., time, lon, lat, z)`: linear in
    time, height, latitude and longitude. `levels` are the heights of iz = 0, 1, ... in rising order; a point
    above the top level takes the top one. Outside the axes, below the lowest level, or with any of the sixteen
    corners missing, the result is null. Brackets are arithmetic, so the join is on the corners' indices."""
    z = F.least(F.col("z"), F.lit(float(max(levels))))
    fx, fy = (F.col("lon") - lon.start) / lon.step, (F.col("lat") - lat.start) / lat.step
    ft = F.timestamp_diff("MICROSECOND", times.ts(start), F.col("time")) / F.lit(float(step_hours * times.HOUR_US))
    zs = F.array(*[F.lit(float(v)) for v in levels])
    kz = F.least(F.greatest(F.size(F.filter(zs, lambda v: v <= z)) - 1, F.lit(0)), F.lit(len(levels) - 2))
    z0, z1 = F.get(zs, kz), F.get(zs, kz + 1)
    inside = (
        fx.between(0, lon.count - 1) & fy.between(0, lat.count - 1) & ft.between(0, steps - 1) & (z >= float(min(levels)))
    )
    (ix, wx), (iy, wy), (it, wt) = _bracket(fx, lon.count), _bracket(fy, lat.count), _bracket(ft, steps)
    wz = (z - z0) / (z1 - z0)
    points = track.select(*key, inside.alias("_in"), it.alias("_it"), wt.alias("_wt"), kz.alias("_iz"), wz.alias("_wz"), iy.alias("_iy"), wy.alias("_wy"), ix.alias("_ix"), wx.alias("_wx"))

    def leg(axis: str, up: int) -> Column:
        return F.col("_w" + axis) if up else F.lit(1.0) - F.col("_w" + axis)

    corners = F.array(*[
        F.struct(
            (F.col("_it") + a).alias("it"), (F.col("_iy") + c).alias("iy"), (F.col("_ix") + d).alias("ix"), (leg("t", a) * leg("y", c) * leg("x", d)).alias("w")
        )
        for a, c, d in itertools.product((0, 1), repeat=3)
    ])
    legs = points.where("_in").select(*key, "_iz", "_wz", F.explode(corners).alias("_c")).select(*key, "_iz", "_wz", "_c.*")
    # One row per water column holds its levels, so a point meets eight columns and not sixteen cells; the
    # grouping leaves the columns partitioned as the join needs them.
    column = F.map_from_entries(F.collect_list(F.struct("iz", F.struct(*values))))
    columns = needed_cells(grid, legs.select(*COLUMN)).groupBy(*COLUMN).agg(column.alias("_column"))
    met = legs.join(columns, list(COLUMN)).withColumns(
        {"_low": F.try_element_at("_column", F.col("_iz")), "_up": F.try_element_at("_column", F.col("_iz") + 1)}
    )
    agg = []
    for v in values:
        between = (F.lit(1.0) - F.col("_wz")) * F.col("_low")[v] + F.col("_wz") * F.col("_up")[v]
        agg += [F.sum(F.col("w") * between).alias("_s_" + v), F.count(between).alias("_n_" + v)]
    found = met.groupBy(*key).agg(*agg)
    answered = found.select(*key, *[F.when(F.col("_n_" + v) == 8, F.col("_s_" + v)).alias(v) for v in values])
    return track.join(answered, list(key), "left")


def track_windows(track: DataFrame, margin: float = 0.1, key: str = "trajectory_id") -> DataFrame:
    """The box, start and hours of the store that covers each trajectory."""
    w = track.groupBy(key).agg(
        (F.min("lon") - margin).alias("west"), (F.min("lat") - margin).alias("south"), (F.max("lon") + margin).alias("east"), (F.max("lat") + margin).alias("north"),
        times.add_hours(times.floor_hour(F.min("time")), -1).alias("start"), F.max("time").alias("_t1"),
    )
    ceil = F.ceil(times.micros(F.col("_t1")) / F.lit(float(times.HOUR_US))).cast("long")
    return w.withColumn("hours", (ceil + 1 - times.hour_index(F.col("start"))).cast("int")).drop("_t1")
