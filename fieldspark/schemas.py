"""Canonical schemas of the field model and checks against them. Fixed layouts, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType

_TYPES = {
    "string": T.StringType(), "timestamp_ntz": T.TimestampNTZType(), "int": T.IntegerType(), "bigint": T.LongType(), "smallint": T.ShortType(),
    "tinyint": T.ByteType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "array<double>": T.ArrayType(T.DoubleType()), "array<string>": T.ArrayType(T.StringType()),
}


def _layout(columns: str) -> StructType:
    """`name type, name type, ...`; no session is needed, as none exists when this module is read."""
    pairs = [c.split() for c in columns.split(", ")]
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


SCHEMAS: dict[str, StructType] = {
    name: _layout(columns)
    for name, columns in {
        "grid_cell": "store_id string, time timestamp_ntz, iz int, iy int, ix int, u float, v float, temp float, salt float",
        "grid_surface": "store_id string, time timestamp_ntz, iy int, ix int, zeta float",
        "grid_static": "store_id string, iy int, ix int, lat double, lon double, h float, mask tinyint",
        "level_static": "store_id string, level int, iy int, ix int, z float, p float",
        "forecast_grid": "cycle timestamp_ntz, lead int, iy int, ix int, hs float, tp float, dir float, shts float, ws float, wdir float",
        "forecast_point": "issue_time timestamp_ntz, valid_time timestamp_ntz, lead_h int, point string, field string, value double",
        "mesh_node": "mesh_id string, node int, lon double, lat double, h double, siglay array<double>, siglev array<double>",
        "mesh_element": "mesh_id string, elem int, n0 int, n1 int, n2 int",
        "mesh_elem_field": "mesh_id string, time timestamp_ntz, layer int, elem int, u float, v float, w float",
        "mesh_node_field": "mesh_id string, time timestamp_ntz, layer int, node int, temp float, salt float",
        "field_meta": "field string, units string, kind string, lo double, hi double, log boolean, symmetric boolean",
        "section_sample": "section_id string, k int, distance double, lon double, lat double, elem int, layer int, z double, value double",
        "track": "time timestamp_ntz, particle int, lon double, lat double, z double, alive boolean",
        "trajectory": "trajectory_id string, obs int, time timestamp_ntz, lon double, lat double, z double",
        "obs": "station string, parameter string, time timestamp_ntz, value double, quality string",
        "mouth": "name string, lon double, lat double, include array<string>, exclude array<string>, lag_hours int",
        "site": "site string, site_type string, area_sqmi double",
        "site_record": "site string, statistic string, begin timestamp_ntz, end timestamp_ntz",
        "site_below": "site string, below string",
        "pixel_obs": "product string, time timestamp_ntz, iy int, ix int, value float",
        "composite": "iy int, ix int, value float, age_days float, product_index tinyint",
        "radar_raw": "time timestamp_ntz, iy int, ix int, u smallint, v smallint, n_sites smallint",
        "catalog": "store_id string, path string, family string, kind string, west double, south double, east double, north double, "
        "time_start timestamp_ntz, time_end timestamp_ntz, bytes bigint, modified timestamp_ntz",
        "place_value": "time timestamp_ntz, place string, field string, value double",
    }.items()
}


def differences(df: DataFrame, name: str) -> list[str]:
    """How a frame's columns differ from a canonical schema; empty when they agree (order does not count)."""
    want = {f.name: f.dataType for f in SCHEMAS[name].fields}
    got = {f.name: f.dataType for f in df.schema.fields}
    out = [f"missing {c}" for c in want if c not in got] + [f"unknown {c}" for c in got if c not in want]
    return out + [f"{c} is {got[c].simpleString()}, not {t.simpleString()}" for c, t in want.items() if c in got and got[c] != t]


def checked(df: DataFrame, name: str) -> DataFrame:
    """The frame in canonical column order, or an error that lists every difference."""
    wrong = differences(df, name)
    if wrong:
        raise ValueError(f"not a {name} frame: {'; '.join(wrong)}")
    return df.select(*SCHEMAS[name].names)
