"""Window-and-box scans, source resolution, archives and crops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import geo, keys, scales, times
from fieldspark.operators import joins, sizes


def scan_window(
    df: DataFrame, start: str, end: str, box: Sequence[float] | None = None, *, time="time", lon="lon", lat="lat"
) -> DataFrame:
    """Rows with start <= time < end and, when given, inside the box. Plain comparisons on stored columns, so
    both prune files and row groups."""
    df = df.where((F.col(time) >= times.ts(start)) & (F.col(time) < times.ts(end)))
    if box is not None:
        df = df.where(geo.in_box(F.col(lon), F.col(lat), *box))
    return df


def resolve_source(wanted: DataFrame, files: DataFrame, *, time: str = "time") -> DataFrame:
    """Add the preferred file holding each wanted hour (null when none does). A file of `files(preference, file,
    begin, end)` holds begin < t <= end. The catalogue is turned into one best file per hour first, so the
    wanted hours meet one row each and are never aggregated."""
    hours = files.withColumn(
        "_hour", F.explode(F.sequence(times.hour_index(F.col("begin")) + 1, times.hour_index(F.col("end"))))
    )
    best = hours.groupBy("_hour").agg(F.min(F.struct("preference", "file")).alias("_best"))
    best = sizes.small(best, sizes.MOST_NARROW_ROWS)
    return (
        wanted.withColumn("_hour", times.hour_index(F.col(time)))
        .join(best, "_hour", "left")
        .select(*wanted.columns, F.col("_best.preference").alias("preference"), F.col("_best.file").alias("file"))
    )


def missing_hours(expected: DataFrame, got: DataFrame, on: Sequence[str]) -> DataFrame:
    """The expected rows that were not got."""
    return expected.join(got.select(*on).distinct(), list(on), "left_anti")


def serve_decision(expected: DataFrame, got: DataFrame, request: str, on: Sequence[str], time: str = "time") -> DataFrame:
    """Per request: hours expected and missing, the first missing hour, and whether it may be served (all or
    nothing)."""
    held = got.select(*on).distinct().withColumn("_held", F.lit(True))
    return (
        expected.join(held, list(on), "left")
        .groupBy(request)
        .agg(
            F.count(F.lit(1)).alias("n_expected"),
            F.count_if(F.col("_held").isNull()).alias("n_missing"),
            F.min(F.when(F.col("_held").isNull(), F.col(time))).alias("first_missing"),
        )
        .withColumn("may_serve", F.col("n_missing") == 0)
    )


# Archives --------------------------------------------------------------------------------------


def ready_days(df: DataFrame, group: Sequence[str], as_of: Column, *, time: str = "time", lag_hours: int = 6) -> DataFrame:
    """(group..., day) of every UTC day the source has published past and whose lag is over at `as_of`. Days are
    reduced first; the newest time comes from the same reduction."""
    days = df.groupBy(*group, times.day_index(F.col(time)).alias("_day")).agg(F.max(time).alias("_last"))
    newest = days.groupBy(*group).agg(F.max("_last").alias("_newest"))
    stop = times.from_day(F.col("_day") + 1)
    return (
        days.join(newest, list(group))
        .where((F.col("_newest") >= stop) & (as_of >= times.add_hours(stop, lag_hours)))
        .select(*group, times.from_day(F.col("_day")).alias("day"))
    )


def archive_days(
    df: DataFrame, archived: DataFrame, group: Sequence[str], as_of: Column, *, time: str = "time", lag_hours: int = 6
) -> DataFrame:
    """Rows of the ready days not yet in `archived(group..., day)`, with their day: what a create-only archive
    appends. A day once kept is never offered again."""
    todo = ready_days(df, group, as_of, time=time, lag_hours=lag_hours).join(archived, [*group, "day"], "left_anti")
    return df.withColumn("day", times.floor_day(F.col(time))).join(todo, [*group, "day"], "left_semi")


def choose_archive(request_days: DataFrame, archive: DataFrame, request: str = "request") -> DataFrame:
    """Per requested day the smallest archived box that contains the request (ties: the lower box), else live.
    Requests carry (west, south, east, north, day), the archive (box, day, west, south, east, north).

    A box that contains a request holds its south-western corner, so boxes are listed by day under tiles of their own size
    and each corner looks into one tile on each level in use: no request meets all boxes of a day."""
    mine = [f"_{c}" for c in joins.BOX]
    # Boxes archived twice under several ids are one.
    boxes = archive.groupBy("day", *joins.BOX).agg(F.min("box").alias("box")).select("day", "box", *[F.col(c).alias("_" + c) for c in joins.BOX])
    tiled = joins.box_tiles(boxes, mine)
    corners = joins.point_tiles(request_days.select(request, "day", *joins.BOX), tiled, "west", "south")
    fits = geo.contains(*[F.col(c) for c in mine], *[F.col(c) for c in joins.BOX])
    found = corners.join(tiled, ["day", "_level", "_tx", "_ty"]).where(fits & (F.col("west") >= F.col("_pw")) & (F.col("west") <= F.col("_pe")))
    area = geo.box_area(*[F.col(c) for c in mine])
    best = found.groupBy(request, "day").agg(F.min(F.struct(area.alias("area"), F.col("box").alias("box"))).alias("_best"))
    return (
        request_days.select(request, "day").distinct().join(best, [request, "day"], "left")
        .select(request, "day", F.col("_best.box").alias("box"), F.when(F.col("_best").isNull(), "live").otherwise("archive").alias("source"))
    )


def load_window(archive_rows: DataFrame, live_rows: DataFrame, choice: DataFrame, requests: DataFrame | None = None, request: str = "request") -> DataFrame:
    """Archived rows of the chosen (box, day), with the live rows of the days no archived box serves.

    With `requests` (request, west, south, east, north, start, end) each request gets its own rows, marked with its id and source:
    those in its box and in [start, end). Requests are listed by source, day and tiles of their own size, so a box and day
    that many requests chose is not met whole by each of them. Without them the rows of all chosen days come uncut."""
    if requests is None:
        chosen = choice.where(F.col("source") == "archive").select("box", "day").distinct()
        live = choice.where(F.col("source") == "live").select("day").distinct()
        return archive_rows.join(chosen, ["box", "day"], "left_semi").unionByName(
            live_rows.join(live, "day", "left_semi"), allowMissingColumns=True
        )
    wanted = choice.join(requests.select(request, *joins.BOX, "start", "end"), request)
    tiled = joins.box_tiles(wanted.withColumnsRenamed({c: "_" + c for c in (*joins.BOX, "start", "end")}), [f"_{c}" for c in joins.BOX])
    tiled = tiled.withColumn("_from", F.coalesce(F.concat(F.lit("box "), F.col("box").cast("string")), F.lit("live"))).drop("box")
    rows = archive_rows.withColumn("_from", F.concat(F.lit("box "), F.col("box").cast("string"))).drop("box").unionByName(
        live_rows.drop("box").withColumn("_from", F.lit("live")), allowMissingColumns=True
    )
    placed = joins.point_tiles(rows, tiled)
    on = ["_from", "day", "_level", "_tx", "_ty"]
    inside = geo.in_box(F.col("lon"), F.col("lat"), F.col("_pw"), F.col("_south"), F.col("_pe"), F.col("_north"))
    met = placed.join(tiled, on).where(inside & (F.col("time") >= F.col("_start")) & (F.col("time") < F.col("_end")))
    return met.select(request, "source", *[c for c in rows.columns if c != "_from"])


def latest_issue(df: DataFrame, key: Sequence[str], issue: Sequence[str]) -> DataFrame:
    """The newest issue of each key. `max_by` combines before the shuffle; there is no window."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*issue)).alias("_row"))
    return best.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def preferred_series(obs: DataFrame, order: Sequence[str], *, station="station", series="parameter", value="value") -> DataFrame:
    """Each station's rows of the first series in `order` that has data there."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(series))
    ranked = obs.withColumn("_rank", rank).where(F.col("_rank") > 0)
    best = ranked.where(F.col(value).isNotNull()).groupBy(station).agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, [station, "_rank"]).select(*obs.columns)


# Crops -----------------------------------------------------------------------------------------


def crop(grid: DataFrame, box: Sequence[float], pad: int, fields: Sequence[str], wet: str = "wet") -> DataFrame:
    """The bounding index rectangle of the wet cells in the box, padded by `pad`; the fields of cells that are
    outside the box or dry become null. The rectangle is one row, so it is broadcast."""
    inside = geo.in_box(F.col("lon"), F.col("lat"), *box) & F.col(wet)
    limits = grid.where(inside).agg(
        (F.min("iy") - pad).alias("_y0"), (F.max("iy") + pad).alias("_y1"), (F.min("ix") - pad).alias("_x0"), (F.max("ix") + pad).alias("_x1")
    )
    cut = grid.join(sizes.one_row(limits), F.col("iy").between(F.col("_y0"), F.col("_y1")) & F.col("ix").between(F.col("_x0"), F.col("_x1")))
    return cut.select(
        *[F.when(inside, F.col(c)).alias(c) if c in fields else F.col(c) for c in grid.columns]
    )


def crop_rectangles(hits: DataFrame, request: str, shape: DataFrame, pad: int) -> DataFrame:
    """The padded index rectangle of each request from its wet cells (`hits(request, iy, ix)`), clipped to the
    grid of `shape(ny, nx)`, one row."""
    box = hits.groupBy(request).agg(
        F.min("iy").alias("y0"), F.max("iy").alias("y1"), F.min("ix").alias("x0"), F.max("ix").alias("x1"), F.count(F.lit(1)).alias("n_wet")
    )
    return box.join(sizes.one_row(shape)).select(
        request,
        F.greatest(F.lit(0), F.col("y0") - pad).alias("y0"),
        F.least(F.col("ny") - 1, F.col("y1") + pad).alias("y1"),
        F.greatest(F.lit(0), F.col("x0") - pad).alias("x0"),
        F.least(F.col("nx") - 1, F.col("x1") + pad).alias("x1"),
        "n_wet",
    )


# Columns of a source ---------------------------------------------------------------------------


def canonical(df: DataFrame, candidates: dict[str, Sequence[str]], keep: Sequence[str] = ()) -> DataFrame:
    """Rename the first candidate column that exists to its canonical name and keep only canonical fields (and
    `keep`). Only the schema is looked at."""
    cols = [F.col(c) for c in keep]
    for name, options in candidates.items():
        found = next((c for c in options if c in df.columns), None)
        if found is not None:
            cols.append(F.col(found).alias(name))
    return df.select(*cols)


def normalise(df: DataFrame, schema: str) -> DataFrame:
    """A legacy layout (`depth` positive down, `latitude`, `longitude` in 0..360) in canonical names and signs;
    the canonical layout as it is; any other schema is refused."""
    if schema == "z-v3":
        return df
    if schema not in ("legacy", ""):
        raise ValueError(f"unknown schema {schema!r}")
    df = df.withColumnsRenamed({"latitude": "lat", "longitude": "lon"})
    if "depth" in df.columns:
        df = df.withColumn("depth", -F.col("depth")).withColumnRenamed("depth", "z")
    return df.withColumn("lon", geo.wrap_lon(F.col("lon")))


def select_layers(df: DataFrame, layers: Sequence[int], count: int, *, layer: str = "layer") -> DataFrame:
    """Rows of the named layers; negative indices count from the bottom, duplicates collapse, and an index
    outside -count..count-1 is an error."""
    bad = [k for k in layers if not -count <= k < count]
    if bad or not layers:
        raise ValueError(f"layers must lie in -{count}..{count - 1}; got {list(layers)}")
    return df.where(F.col(layer).isin(sorted({k % count for k in layers})))


def decode_packed(df: DataFrame, fields: dict[str, tuple[str, float, int]], signed: dict[str, str] | None = None) -> DataFrame:
    """Add decoded fields: new name -> (stored column, scale, fill); `signed` repairs bytes: new name -> column."""
    out = {name: scales.unpack(F.col(c), s, f) for name, (c, s, f) in fields.items()}
    out |= {name: scales.signed_byte(F.col(c)) for name, c in (signed or {}).items()}
    return df.withColumns(out)


def mask_fill(df: DataFrame, fields: Sequence[str], threshold: float = 1e30) -> DataFrame:
    return df.withColumns({c: scales.drop_fill(F.col(c), threshold) for c in fields})


def validate(df: DataFrame, checks: Sequence[tuple[Column, Column | str]]) -> DataFrame:
    """Add `reason`, the first failed check of each row; rows are kept, good ones have a null reason."""
    return df.withColumn("reason", keys.reason(checks))
