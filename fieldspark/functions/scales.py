"""One-byte codes on a colour scale, and int16 packing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unit(v: Column, lo: Column, hi: Column, log: Column) -> Column:
    clipped = F.greatest(lo, F.least(hi, v))
    linear = (clipped - lo) / (hi - lo)
    # try_ guards: the branch not taken may see a zero or negative end.
    curved = F.try_divide(F.ln(clipped) - F.ln(lo), F.ln(hi) - F.ln(lo))
    return F.when(log, curved).otherwise(linear)


def finite(v: Column) -> Column:
    """Neither missing nor NaN nor infinite."""
    return F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))


def encode(v: Column, lo: Column, hi: Column, log: Column) -> Column:
    """1 at or below lo, 255 at or above hi, 0 where missing or not finite. A scale without an extent is an error."""
    ok = (hi > lo) & ~F.isnan(lo) & ~F.isnan(hi)
    code = F.when(~finite(v), 0).otherwise(F.rint(_unit(v, lo, hi, log) * 254.0).cast("int") + 1)
    return F.when(ok, code).otherwise(F.raise_error(F.lit("no colour scale")).cast("int"))


def decode(code: Column, lo: Column, hi: Column, log: Column) -> Column:
    f = (code.cast("double") - 1.0) / 254.0
    curved = F.exp(F.ln(lo) + f * (F.ln(hi) - F.ln(lo)))
    return F.when(code > 0, F.when(log, curved).otherwise(lo + f * (hi - lo)))


def unpack(raw: Column, scale: float, fill: int) -> Column:
    """A stored integer to its value; the fill value is missing."""
    return F.when(raw != fill, raw.cast("double") * scale)


def signed_byte(raw: Column) -> Column:
    """Bytes that were stored signed but arrive unsigned."""
    return F.when(raw > 127, raw - 256).otherwise(raw).cast("int")


def drop_fill(v: Column, threshold: float = 1e30) -> Column:
    """Huge magnitudes and values that are not finite to null."""
    return F.when(~F.isnan(v) & (F.abs(v) < threshold), v)


def to_int16(v: Column, offset: Column, scale: Column) -> Column:
    return F.greatest(F.lit(-32767.0), F.least(F.lit(32767.0), F.rint((v - offset) / scale))).cast("int")
