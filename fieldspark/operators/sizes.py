"""Broadcasts behind a check of size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from fieldspark.session import materialise, spread

MOST_ROWS = 10_000
# Narrow rows (a few numbers each).
MOST_NARROW_ROWS = 1_000_000
#: What a broadcast table may take by the width of its columns, whatever its rows.
MOST_BYTES = 64_000_000


def width(schema: T.DataType) -> int:
    """Bytes that a row of numbers takes, and a guess on the high side for text and lists."""
    if isinstance(schema, T.StructType):
        return 16 + sum(width(f.dataType) for f in schema.fields)
    return 8 if isinstance(schema, (T.NumericType, T.BooleanType, T.DatetimeType)) else 128


def is_small(df: DataFrame, rows: int = MOST_ROWS) -> bool:
    """Whether the frame is counted to have at most `rows` rows and, by their width, MOST_BYTES; the count stops there."""
    most = min(rows, MOST_BYTES // width(df.schema))
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, rows: int = MOST_ROWS) -> DataFrame:
    """A look-up table, stored once and marked for broadcast when it is small; a larger one is left to the optimiser, which
    knows its size from its files and shuffles it. The table is computed once, and counted from what is stored. Without the mark the
    large side of such a join would be shuffled before adaptive execution learns that it need not be."""
    stored = materialise(df, "look-up")
    return F.broadcast(stored) if is_small(stored, rows) else stored


def weighted_cells(field: DataFrame, weights: DataFrame, cell: Sequence[str], target: str) -> DataFrame:
    """The field's rows with the weights of their cells and _n, how many cells the target has.

    A short field is broadcast, and the weights are dealt by target: all rows of a target meet in one of many tasks, where they are
    summed without another shuffle. A longer one has parts of its own to be spread by, and meets the weights instead."""
    field = materialise(field, "field")
    short = is_small(field, MOST_NARROW_ROWS)
    w = spread(weights, target) if short else weights
    w = w.join(w.groupBy(target).agg(F.count(F.lit(1)).alias("_n")), target)
    if short:
        return w.join(F.broadcast(field), list(cell))
    return field.join(small(w, MOST_NARROW_ROWS), list(cell))


def one_row(df: DataFrame) -> DataFrame:
    """A global aggregate: one row whatever the data, so it is always broadcast."""
    return F.broadcast(df)
