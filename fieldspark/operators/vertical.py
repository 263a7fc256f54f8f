"""Water columns and C-grid faces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import vertical


def build_columns(layers: DataFrame, key: Sequence[str], *, z: str = "z", values: Sequence[str] = ("value",)) -> DataFrame:
    """Layer rows to one row per water column with arrays `z` and the values, surface first. A column is at most
    as long as the model has layers."""
    packed = F.sort_array(F.collect_list(F.struct((-F.col(z)).alias("d"), *[F.col(v).alias(v) for v in values])))
    rows = layers.groupBy(*key).agg(packed.alias("_l"))
    def field(name: str) -> Column:
        return F.transform("_l", lambda e: e[name]).alias(name)

    return rows.select(*key, F.transform("_l", lambda e: -e["d"]).alias(z), *[field(v) for v in values])


def sigma_to_z(columns: DataFrame, key: Sequence[str], levels: Sequence[float], bed: Column, *, z: str = "z", values: Sequence[str] = ("value",)) -> DataFrame:
    """Each column's layers (arrays, surface first) at fixed heights: (key..., level, z, values...). Arrays are
    worked on in place, so no row moves."""
    zs = F.array(*[F.lit(float(v)) for v in levels])
    rows = columns.select(*key, F.col(z).alias("_z"), *values, bed.alias("_bed"), F.posexplode(zs).alias("level", "_t"))
    at = [vertical.column_at(F.col("_z"), F.col(v), F.col("_t"), F.col("_bed")).alias(v) for v in values]
    return rows.select(*key, "level", F.col("_t").alias("z"), *at)


def faces_to_centres(
    faces: DataFrame, index: str, key: Sequence[str], value: str, *, before: bool = False, land_as_zero: bool = False, centres: int | None = None
) -> DataFrame:
    """Values on C-grid faces to the centres beside them along `index`.

    By default face c and c + 1 surround centre c and the last centre copies its one face; with `before`, faces
    c - 1 and c do, and both outer centres copy theirs (`centres` then bounds them). A missing face spoils the
    mean, or counts as no flow with `land_as_zero`. Every face is handed to its two centres and averaged, with
    partial sums before the shuffle."""
    v = F.coalesce(F.col(value), F.lit(0.0)) if land_as_zero else F.col(value)
    offsets = F.array(F.lit(0), F.lit(1)) if before else F.array(F.lit(0), F.lit(-1))
    rows = faces.select(*key, index, v.alias("_v"), F.explode(offsets).alias("_o"))
    rows = rows.withColumn(index, F.col(index) + F.col("_o")).where(F.col(index) >= 0)
    if centres is not None:
        rows = rows.where(F.col(index) < centres)
    return rows.groupBy(*key, index).agg(F.when(F.count("_v") == F.count(F.lit(1)), F.avg("_v")).alias(value))


def spread_levels(layers: DataFrame, column: Sequence[str], slots: int, *, layer: str = "layer", values: Sequence[str] = ("u", "v")) -> DataFrame:
    """Up to `slots` layers spread evenly from the surface to each column's deepest wet layer: (column..., slot,
    layer, values...). A layer already picked is not repeated: its first value is null. Layers count from 0 at
    the surface."""
    wet = F.lit(True)
    for v in values:
        wet = wet & F.col(v).isNotNull()
    extent = layers.groupBy(*column).agg(F.coalesce(F.max(F.when(wet, F.col(layer))), F.lit(0)).alias("_deep"))
    last = max(slots - 1, 1)

    def pick(slot: Column) -> Column:
        return F.rint(slot / F.lit(float(last)) * F.col("_deep")).cast("int")

    rows = extent.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumns({
        "_pick": pick(F.col("slot")), "_again": (F.col("slot") > 0) & (pick(F.col("slot")) == pick(F.col("slot") - 1)),
    })
    got = rows.join(layers.select(*column, F.col(layer).alias("_pick"), *values), [*column, "_pick"], "left")
    first, rest = values[0], list(values[1:])
    return got.select(*column, "slot", F.col("_pick").alias(layer), F.when(~F.col("_again"), F.col(first)).alias(first), *rest)
