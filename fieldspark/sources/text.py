"""Text ingest: observation files, index sidecars and file names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import keys, ordered, times

# The columns of a standard meteorological buoy file that are carried through, and the number
# that stands for a missing value in each.
STDMET_MISSING = {
    "WDIR": 999.0, "WSPD": 99.0, "GST": 99.0, "WVHT": 99.0, "DPD": 99.0, "PRES": 9999.0, "ATMP": 999.0, "WTMP": 999.0,
}


def full_year(year: Column) -> Column:
    """Two-digit years: 70..99 are of the last century."""
    return F.when(year >= 100, year).when(year >= 70, year + 1900).otherwise(year + 2000)


def ingest_stdmet(
    df: DataFrame, columns: Sequence[str], missing: Mapping[str, float] = STDMET_MISSING, *, text: str = "value", minutes: bool = True
) -> DataFrame:
    """Lines `YY MM DD hh [mm] values...` to typed rows. `MM`, text that is not a number, and a column's own
    missing number are null: 99 is missing for a wind speed and a true bearing for a wind direction. Header
    lines (starting with #) and blank lines are dropped."""
    lines = df.where(~F.trim(F.col(text)).startswith("#") & (F.trim(F.col(text)) != ""))
    part = F.split(F.trim(F.col(text)), r"\s+")

    def number(k: int, kind: str) -> Column:
        return F.get(F.col("_p"), F.lit(k)).try_cast(kind)

    first = 5 if minutes else 4
    out = lines.withColumn("_p", part)
    stamp = F.expr(
        "try_make_timestamp_ntz(_y, _mo, _d, _h, _mi, 0)"
    )
    out = out.withColumns({
        "_y": full_year(number(0, "int")),
        "_mo": number(1, "int"),
        "_d": number(2, "int"),
        "_h": number(3, "int"),
        "_mi": number(4, "int") if minutes else F.lit(0),
    }).withColumn("time", stamp)
    values = {}
    for k, name in enumerate(columns):
        v = number(first + k, "double")
        values[name] = F.when(v != missing[name], v) if name in missing else v
    keep = [c for c in df.columns if c != text]
    return out.withColumns(values).select(*keep, "time", *columns)


def byte_ranges(
    df: DataFrame, patterns: Sequence[str], *, file: str = "file", line: str = "line", text: str = "text", block: int = 4096
) -> DataFrame:
    """(file, line, start, end) of the messages whose index line contains any pattern. The end is the offset of
    the next message of the file, so neighbours are found before the filter; null means to the end of the file.
    Files are cut in blocks of lines, so one long index does not become one task."""
    part = F.split(F.col(text), ":")
    entries = df.withColumn("start", F.when(F.size(part) >= 3, F.get(part, F.lit(1)).try_cast("long"))).where(
        F.col("start").isNotNull()
    )
    piece = F.floor(F.col(line) / F.lit(block)).cast("long")
    ranged = ordered.with_neighbours(entries, [file], [line], piece, next={"end": "start"})
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col(text).contains(p)
    return ranged.where(hit).select(file, line, "start", "end")


def parse_radar_name(df: DataFrame, path: str = "path") -> DataFrame:
    """Grid, box and day from `grid_<g>km/<box>/YYYY/MM/radar_<g>km_YYYYMMDD.nc`; nulls where a name does not
    have that form."""
    full = r"grid_([126]km)/([^/]+)/\d{4}/\d{2}/radar_[126]km_(\d{8})\.nc$"
    def group(k: int) -> Column:
        text = F.regexp_extract(F.col(path), full, k)
        return F.when(text != "", text)

    west, south, east, north = keys.parse_box_name(F.col("box_name"))
    named = df.withColumns({"grid": group(1), "box_name": group(2)})
    return named.withColumns({
        "west": west, "south": south, "east": east, "north": north,
        "day": F.to_date(group(3), "yyyyMMdd"),
    })


def cycle_file_name(office: Column, grid: Column, cycle: Column) -> Column:
    """`<office>_<grid>_YYYYMMDD_HH00.grib2`: the name of a wave cycle's file."""
    return F.concat_ws("_", office, grid, F.date_format(cycle, "yyyyMMdd"), F.concat(F.date_format(cycle, "HH"), F.lit("00.grib2")))


def parse_cycle_name(name: Column) -> Column:
    """The cycle a wave file name stands for."""
    pattern = r"_(\d{8})_(\d{2})00\.grib2$"
    digits = F.concat(F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2))
    return F.when(digits != "", F.try_to_timestamp(digits, F.lit("yyyyMMddHH")).cast("timestamp_ntz"))


def lead_file_name(cycle: Column, variable: Column, level: Column, lead: Column) -> Column:
    """`YYYYMMDDTHHZ_<variable>_<level>_PTnnnH.grib2`: one variable of one lead of a run."""
    return F.concat(
        F.date_format(cycle, "yyyyMMdd"), F.lit("T"), F.date_format(cycle, "HH"), F.lit("Z_"), variable, F.lit("_"), level,
        F.format_string("_PT%03dH.grib2", lead),
    )
