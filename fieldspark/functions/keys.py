"""Deterministic ids, ordered keyword rules and entry checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def request_id(prefix: str, schema: str, parts: Sequence[Column], digits: int = 12) -> Column:
    """`prefix_` and the first hex digits of a hash over the schema version and the request's parts. The schema
    is part of the hash, so a stored result of an older layout is never taken for a new request."""
    text = F.concat_ws("_", F.lit(prefix), F.lit(schema), *[p.cast("string") for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(text, 256), 1, digits))


def fixed(x: Column, digits: int) -> Column:
    """A number with a fixed count of decimals, so its text does not depend on the engine."""
    return F.format_string(f"%.{digits}f", x)


def classify(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first keyword, in the rules' order, that the lower-cased text contains."""
    low = F.lower(text)
    out = None
    for keyword, label in rules:
        hit = low.contains(keyword)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def classify_stem(stem: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first keyword that the file stem starts with or holds between underscores."""
    low = F.lower(stem)
    out = None
    for keyword, label in rules:
        hit = low.startswith(keyword) | low.contains(f"_{keyword}_")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def reason(checks: Sequence[tuple[Column, Column | str]]) -> Column:
    """The first failed check's reason, null where none fails."""
    out = None
    for failed, why in checks:
        why = why if isinstance(why, Column) else F.lit(why)
        out = F.when(failed, why) if out is None else out.when(failed, why)
    return out if out is not None else F.lit(None).cast("string")


def box_name(west: Column, south: Column, east: Column, north: Column) -> Column:
    """A box as a directory name: south, north, west, east to three decimals with hemisphere letters."""
    def part(x: Column, width: int, plus: str, minus: str) -> Column:
        return F.concat(F.lpad(F.format_string("%.3f", F.abs(x)), width, "0"), F.when(x >= 0, plus).otherwise(minus))

    return F.concat_ws("_", part(south, 6, "N", "S"), part(north, 6, "N", "S"), part(west, 7, "E", "W"), part(east, 7, "E", "W"))


def parse_box_name(name: Column) -> list[Column]:
    """(west, south, east, north) from a box name, nulls where the name is not a box."""
    pattern = r"^(\d{2}\.\d{3})([NS])_(\d{2}\.\d{3})([NS])_(\d{3}\.\d{3})([EW])_(\d{3}\.\d{3})([EW])$"

    def part(group: int) -> Column:
        value = F.regexp_extract(name, pattern, group)
        sign = F.when(F.regexp_extract(name, pattern, group + 1).isin("S", "W"), -1.0).otherwise(1.0)
        return F.when(value != "", value.try_cast("double") * sign)

    south, north, west, east = part(1), part(3), part(5), part(7)
    return [west, south, east, north]
