"""Windows over long ordered series, in pieces.

A plain window gives one key's whole series to one task. Here a series is cut into pieces by a coarse, monotone
function of the order (a day, a block of line numbers), each piece is its own window partition, and one small row
per piece carries what neighbouring pieces need to know. A key with a third of all rows is then spread over as many
tasks as it has pieces."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], piece: Column, used: Sequence[str]):
    cut = df.withColumn("_piece", piece)
    # The rows and their per-piece summary both start from here. When they need the same columns, one exchange
    # by piece serves both and the input is computed once; else the summary is combined before its own shuffle.
    if set(df.columns) == {*keys, *order, *used}:
        cut = cut.repartition(*keys, "_piece")
    inside = Window.partitionBy(*keys, "_piece").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_piece")
    return cut, inside, across


def _fields(mapping: Mapping[str, str]) -> Column:
    return F.struct(*[F.col(source).alias(out) for out, source in mapping.items()])


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    piece: Column,
    prev: Mapping[str, str] | None = None,
    next: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add values of the row before (`prev`: new name -> column) and after (`next`) each row. `order` must be
    unique within the keys and `piece` must never decrease along it."""
    keys, order = list(keys), list(order)
    used = [*(prev or {}).values(), *(next or {}).values()]
    cut, inside, across = _pieces(df, keys, order, piece, used)
    rank = F.struct(*order)
    rows, ends, edges = cut, [], []
    if prev:
        rows = rows.withColumn("_p", F.lag(_fields(prev)).over(inside))
        ends.append(F.max_by(_fields(prev), rank).alias("_last"))
        edges.append(F.lag("_last").over(across).alias("_pe"))
    if next:
        rows = rows.withColumn("_n", F.lead(_fields(next)).over(inside))
        ends.append(F.min_by(_fields(next), rank).alias("_first"))
        edges.append(F.lead("_first").over(across).alias("_ne"))
    edge = cut.groupBy(*keys, "_piece").agg(*ends).select(*keys, "_piece", *edges)
    joined = rows.join(edge, [*keys, "_piece"])
    out = list(df.columns)
    cols = [F.col(c) for c in out]
    for name in prev or {}:
        cols.append(F.coalesce(F.col("_p"), F.col("_pe"))[name].alias(name))
    for name in next or {}:
        cols.append(F.coalesce(F.col("_n"), F.col("_ne"))[name].alias(name))
    return joined.select(*cols)


def with_running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], piece: Column, value: Column, out: str
) -> DataFrame:
    """Add the running sum of `value` up to and including each row."""
    keys, order = list(keys), list(order)
    cut, inside, across = _pieces(df.withColumn("_v", value), keys, order, piece, ["_v"])
    down = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = cut.withColumn("_s", F.sum("_v").over(down))
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    edge = cut.groupBy(*keys, "_piece").agg(F.sum("_v").alias("_t")).select(
        *keys, "_piece", F.sum("_t").over(before).alias("_o")
    )
    joined = rows.join(edge, [*keys, "_piece"])
    zero = F.lit(0).cast(joined.schema["_s"].dataType)
    return joined.select(*df.columns, (F.coalesce("_s", zero) + F.coalesce("_o", zero)).alias(out))


def with_run_start(df: DataFrame, keys: Sequence[str], index: str, piece: Column, max_gap: int, out: str) -> DataFrame:
    """Add the first index of each row's run, a run being indices (distinct within the keys) that follow each
    other by at most `max_gap`. A piece tells its neighbours its ends and where its own last run began."""
    keys = list(keys)
    cut, inside, across = _pieces(df, keys, [index], piece, [])
    before = F.lag(index).over(inside)
    # Null on a piece's first row: whether a run begins there depends on the piece before.
    rows = cut.withColumn("_own", F.when(F.col(index) - before > max_gap, F.col(index)))
    edge = rows.groupBy(*keys, "_piece").agg(F.min(index).alias("_lo"), F.max(index).alias("_hi"), F.max("_own").alias("_opened"))
    prior = F.lag("_hi").over(across)
    edge = edge.withColumn("_first", F.when(prior.isNull() | (F.col("_lo") - prior > max_gap), F.col("_lo")))
    carried = F.last(F.coalesce("_opened", "_first"), ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    edge = edge.select(*keys, "_piece", F.coalesce(F.col("_first"), carried).alias("_start"))
    down = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.withColumn("_since", F.max("_own").over(down)).join(edge, [*keys, "_piece"])
    return joined.select(*df.columns, F.coalesce("_since", "_start").alias(out))
