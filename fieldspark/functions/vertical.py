"""Layer heights and interpolation within one water column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def layer_height(sigma: Column, h: Column, zeta: Column) -> Column:
    """Height of a terrain-following layer: sigma runs from 0 at the surface to -1 at the bed."""
    return sigma * (h + zeta) + zeta


def stretching(s: Column, cs: Column, h: Column, hc: float) -> Column:
    """The stretched s-coordinate as a fraction of the water column (vertical transform 2)."""
    return (s * hc + h * cs) / (h + hc)


def z_levels(depth: float, spacing: float) -> tuple[list[float], list[float]]:
    """Centres and faces of the fewest layers `spacing` thick that reach from the surface down to `depth`, one at least, from
    the lowest up: what `levels_for_depth` gives, for one depth known beforehand."""
    if not spacing > 0:
        raise ValueError("layers need a thickness above zero")
    upward = range(max(1, math.ceil(depth / spacing)), 0, -1)
    return [spacing * (0.5 - k) for k in upward], [*(-spacing * k for k in upward), 0.0]


def levels_for_depth(depth: Column, spacing: float) -> Column:
    """Level centres as an array column, one array per row's own depth."""
    n = F.greatest(F.lit(1), F.ceil(depth / spacing).cast("int"))
    return F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: (k.cast("double") - 0.5) * (-spacing))


def column_at(z: Column, v: Column, target: Column, bed: Column) -> Column:
    """Value at height `target` in one column; `z` and `v` are arrays, surface first. Above the top layer
    centre the top value holds, below the bottom one the bottom value, below the bed (or on land, where the
    bed is null) nothing does."""
    n = F.size(z)
    above = F.size(F.filter(z, lambda a: a >= target))
    upper = F.least(F.greatest(above - 1, F.lit(0)), n - 1) + 1
    lower = F.least(F.greatest(above, F.lit(0)), n - 1) + 1
    zu, zl = F.element_at(z, upper), F.element_at(z, lower)
    vu, vl = F.element_at(v, upper), F.element_at(v, lower)
    span = zu - zl
    w = F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (zu - target) / span))).otherwise(0.0)
    # A layer whose weight is nothing still spoils the result when it is missing, so no coalesce here.
    return F.when(bed.isNotNull() & (target >= bed), (F.lit(1.0) - w) * vu + w * vl)
