"""Not-modified revisits: an as-of join by canonical URL to the latest earlier full response, whose validators must agree;
the revisit gets that response's body and headers, updated by those that a not-modified answer may change.

The join is a window over time, in pieces: one URL with a third of all captures is spread over as many tasks as it has
pieces, and each piece hands one row on to the later ones. Bodies stay out of it until the end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed by RFC 9110, 15.4.5: what a 304 answer may say anew.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Seconds of a piece.
PIECE = 3600


def latest_before(records: DataFrame, piece: int = PIECE) -> DataFrame:
    """`records` (record_id, canonical, ts, full) and `source`: the record_id of the latest full record with the same canonical
    and a smaller ts, the larger id among equals; null where there is none, or where canonical or ts is null."""
    micros = F.unix_micros("ts")
    own = F.when(F.col("full"), F.struct(F.col("_at").alias("at"), F.col("record_id").alias("id")))
    known = F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    apart = records.filter(~known).withColumn("source", F.lit(None).cast(records.schema["record_id"].dataType))  # in no window
    rows = records.filter(known).withColumn("_at", micros).withColumn("_piece", F.floor(F.col("_at") / (piece * 1_000_000)).cast("long")).withColumn("_own", own)
    inside = Window.partitionBy("canonical", "_piece").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    ends = rows.filter("full").groupBy("canonical", "_piece").agg(F.max("_own").alias("_end"))
    pieces = rows.select("canonical", "_piece").distinct().join(ends, ["canonical", "_piece"], "left")
    across = Window.partitionBy("canonical").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("canonical", "_piece", F.max("_end").over(across).alias("_past"))
    found = rows.withColumn("_near", F.max("_own").over(inside)).join(pieces, ["canonical", "_piece"], "left")
    return found.select(*records.columns, F.coalesce("_near", "_past")["id"].alias("source")).unionByName(apart)


def merged_headers(of_response: Column, of_revisit: Column, permitted: Sequence[str] = PERMITTED) -> Column:
    """The response's headers, permitted ones replaced or added from the revisit. Names are lower case."""
    none = F.create_map().cast("map<string,string>")
    own, new = F.coalesce(of_response, none), F.coalesce(of_revisit, none)
    new = F.map_filter(new, lambda k, v: k.isin(list(permitted)) & v.isNotNull())
    return F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(new, k)), new)


def validated(response: Column, revisit: Column) -> Column:
    """Whether the revisit speaks of this response: its etag if it has one (weak and strong alike), else its last-modified. With
    neither nothing shows that it does."""
    value = lambda headers, name: F.regexp_replace(F.try_element_at(headers, F.lit(name)), "^W/", "")
    tag, date = value(revisit, "etag"), value(revisit, "last-modified")
    same = F.when(tag.isNotNull(), tag == value(response, "etag")).when(date.isNotNull(), date == value(response, "last-modified"))
    return F.coalesce(same, F.lit(False))


def resolve_revisits(records: DataFrame, body: Sequence[str], piece: int = PIECE) -> DataFrame:
    """One row per revisit among `records` (record_id unique, canonical, ts, type: response or revisit, status, headers, and
    the `body` columns): record_id, canonical, ts, source, outcome, headers and body. The outcome is resolved; or no earlier
    response; or changed, when the validators disagree, and then headers are the revisit's own and the body is null. A response
    is full with status 200. Null canonical or ts: no earlier response. Null headers count as none. Other types and columns are
    ignored."""
    kind = F.coalesce("type", F.lit(""))
    full = (kind == "response") & F.coalesce(F.col("status") == 200, F.lit(False))
    marked = records.filter((kind == "revisit") | full).select("record_id", "canonical", "ts", full.alias("full"))
    asked = latest_before(marked, piece).filter("not full").drop("full")
    none = F.create_map().cast("map<string,string>")
    revisits = records.filter(kind == "revisit").select("record_id", F.coalesce("headers", none).alias("_new"))
    sources = records.filter(full).select(F.col("record_id").alias("source"), F.coalesce("headers", none).alias("_old"), *body)
    met = asked.join(revisits, "record_id").join(sources, "source", "left")
    ok = F.col("source").isNotNull() & validated(F.col("_old"), F.col("_new"))
    outcome = F.when(F.col("source").isNull(), "no earlier response").when(ok, "resolved").otherwise("changed")
    headers = F.when(ok, merged_headers(F.col("_old"), F.col("_new"))).otherwise(F.col("_new"))
    return met.select("record_id", "canonical", "ts", "source", outcome.alias("outcome"), headers.alias("headers"), *[F.when(ok, F.col(c)).alias(c) for c in body])


def header_lines(headers: Column) -> Column:
    lines = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return F.array_join(lines, "\n")
