"""Colour scales over whole data sets, and packed tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions import geo, scales
from fieldspark.operators import selection, sizes
from fieldspark.session import materialise


def weighted_percentiles(
    df: DataFrame, by: Sequence[str], x: str, w: str, qs: Sequence[float] | Column, *, levels: int | None = None, buckets: int = selection.CUTS, size: int = selection.SIZE, few_groups: bool = False
) -> DataFrame:
    """(by..., q, value): going up the values, the one at which q percent of all weight is first gathered. Exact. `qs` may be an array column over `by`. Set `few_groups` where the groups are known
    to be few: then the goals, a row per group and q, are broadcast.

    Weights are first summed per distinct value and stored; then `selection.crossings` narrows each goal's range until it holds
    `size` values at most, which is all that one task ever orders, be the tail as heavy as it may."""
    by = list(by)
    if not by:
        out = weighted_percentiles(df.withColumn("_all", F.lit(0)), ["_all"], x, w, qs, levels=levels, buckets=buckets, size=size, few_groups=True)
        return out.drop("_all")
    percents = qs if isinstance(qs, Column) else F.array(*[F.lit(float(q)) for q in qs])
    held = materialise(df.where(scales.finite(F.col(x))).groupBy(*by, F.col(x).alias("_x")).agg(F.sum(w).alias("_w")), "weights")
    total = held.groupBy(*by).agg(F.sum("_w").alias("_total")).select(*by, "_total", F.explode(percents).alias("q"))
    goals = total.select(*by, "q", (F.col("q") / 100.0 * F.col("_total")).alias("_goal"))
    return selection.crossings(held, by, goals, size=size, cuts=buckets, levels=levels, few_goals=few_groups)


def shared_scale(
    long: DataFrame, meta: DataFrame, *, field: str = "field", value: str = "value", weight: str = "area", q: tuple[float, float] = (1.0, 99.0), q_abs: float = 99.5
) -> DataFrame:
    """(field, lo, hi) from every value of every mesh, weighted by area: the q percentiles, or for a symmetric
    field -hi..hi with hi the q_abs percentile of the magnitude. `meta(field, symmetric)` says which."""
    few = sizes.is_small(meta)
    short = meta.select(field, "symmetric")
    rows = long.join(F.broadcast(short) if few else short, field)
    size = F.when(F.col("symmetric"), F.abs(value)).otherwise(F.col(value))
    ends = F.when(F.col("symmetric"), F.array(F.lit(q_abs))).otherwise(F.array(F.lit(q[0]), F.lit(q[1])))
    found = weighted_percentiles(rows.withColumn("_size", size), [field, "symmetric"], "_size", weight, ends, few_groups=few)
    at = {p: F.max(F.when(F.col("q") == p, F.col("value"))) for p in (*q, q_abs)}
    return found.groupBy(field).agg(
        F.when(F.bool_or("symmetric"), -at[q_abs]).otherwise(at[q[0]]).alias("lo"), F.when(F.bool_or("symmetric"), at[q_abs]).otherwise(at[q[1]]).alias("hi")
    )


def encode_fields(long: DataFrame, meta: DataFrame, *, field: str = "field", value: str = "value") -> DataFrame:
    """Add `code`, each value's byte on its field's scale `meta(field, lo, hi, log)`, and `decoded`. The scales
    are one short row per field."""
    rows = long.join(sizes.small(meta.select(field, "lo", "hi", "log")), field)
    lo, hi, log = F.col("lo"), F.col("hi"), F.col("log")
    rows = rows.withColumn("code", scales.encode(F.col(value), lo, hi, log))
    return rows.withColumn("decoded", scales.decode(F.col("code"), lo, hi, log)).drop("lo", "hi", "log")


def quantize_track(track: DataFrame, lon0: float, lat0: float, by: Sequence[str] = ()) -> DataFrame:
    """Positions as int16 codes per axis spanning the alive samples of each track set, value = offset + scale *
    code; samples that are not alive get 0. Bounds are one aggregate joined back."""
    x, y = geo.to_local(F.col("lon"), F.col("lat"), lon0, lat0)
    finite = F.lit(True)
    for c in ("lon", "lat", "z"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c)
    rows = track.withColumns({"_x": x, "_y": y, "_z": F.col("z"), "_ok": F.coalesce(F.col("alive"), F.lit(True)) & finite})
    axes = ("x", "y", "z")
    ends = rows.groupBy(*by).agg(*[f(F.when(F.col("_ok"), F.col("_" + a))).alias(f"_{m}{a}") for a in axes for m, f in (("lo", F.min), ("hi", F.max))])
    joined = rows.join(ends, list(by)) if by else rows.join(sizes.one_row(ends))
    out = {}
    for a in axes:
        lo, hi = F.coalesce(F.col("_lo" + a), F.lit(0.0)), F.coalesce(F.col("_hi" + a), F.lit(0.0))
        out["offset_" + a] = (lo + hi) * 0.5
        out["scale_" + a] = F.greatest((hi - lo) * 0.5 / 32767.0, F.lit(1e-6))
    joined = joined.withColumns(out)
    codes = {
        "code_" + a: F.when(F.col("_ok"), scales.to_int16(F.col("_" + a), F.col("offset_" + a), F.col("scale_" + a))).otherwise(0) for a in axes
    }
    return joined.withColumns(codes).select(*track.columns, *codes, *out)


def layer_summary(layers: DataFrame, store: Sequence[str], *, layer: str = "layer", z: str = "z") -> DataFrame:
    """Mean height of each layer, surface first, with a label."""
    mean = layers.groupBy(*store, layer).agg(F.round(F.avg(z), 2).alias("z_mean"))
    order = Window.partitionBy(*store).orderBy(F.col("z_mean").desc(), layer)
    label = F.concat(F.format_string("%.1f", F.greatest(F.lit(0.0), -F.col("z_mean"))), F.lit(" m deep"))
    return mean.withColumn("index", (F.row_number().over(order) - 1).cast("int")).withColumn("label", label)
