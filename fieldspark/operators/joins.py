"""Spatial and interval joins as equi-joins on tiles and time buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions import geo, ordered, times
from fieldspark.operators import sizes
from fieldspark.session import materialise, spread

BOX = ("west", "south", "east", "north")
#: Sites, once for each level of tiles in use, that go to all executors at most: 120 bytes each there.
MOST_SITES = 1_500_000


def box_parts(boxes: DataFrame, box: Sequence[str] = BOX) -> DataFrame:
    """Boxes by their parts (_pw, _pe), with the level of tiles that fits the size of each (_level)."""
    west, south, east, north = (F.col(c) for c in box)

    def part(low: Column, high: Column) -> Column:
        return F.struct(low.alias("w"), high.alias("e"))

    # A box across the seam (west > east) stands as its two parts.
    parts = F.when(west > east, F.array(part(west, F.lit(180.0)), part(F.lit(-180.0), east))).otherwise(F.array(part(west, east)))
    rows = boxes.withColumn("_part", F.explode(parts)).withColumns({"_pw": F.col("_part.w"), "_pe": F.col("_part.e")}).drop("_part")
    return rows.withColumn("_level", geo.box_level(F.col("_pe") - F.col("_pw"), north - south))


def box_tiles(boxes: DataFrame, box: Sequence[str] = BOX) -> DataFrame:
    """Boxes listed under the tiles they touch, on the level that fits their own size (at most four each):
    adds (_level, _tx, _ty) and the part of the box they belong to (_pw, _pe). Large and small boxes do not share tiles, so neither a crowd of small boxes nor one
    huge box makes every point nearby a candidate."""
    south, north = F.col(box[1]), F.col(box[3])
    rows = box_parts(boxes, box)
    for mark, low, high in (("_tx", F.col("_pw"), F.col("_pe")), ("_ty", south, north)):
        rows = rows.withColumn(mark, F.explode(F.sequence(geo.level_tile(low, F.col("_level")), geo.level_tile(high, F.col("_level")))))
    return rows


def point_tiles(points: DataFrame, tiled: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points with their one tile on each level that `tiled` boxes use: one row per level, a handful at most."""
    used = sizes.one_row(tiled.agg(F.collect_set("_level").alias("_used")))
    rows = points.join(used).withColumn("_level", F.explode_outer("_used")).drop("_used")
    return rows.withColumns({"_tx": geo.level_tile(F.col(lon), F.col("_level")), "_ty": geo.level_tile(F.col(lat), F.col("_level"))})


def points_in_boxes(points: DataFrame, boxes: DataFrame, *, salt: int = 1, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Every (point, box) pair with the point in the box. A point lies in one tile per level and a box is listed
    under its tiles on one level, so a pair meets once. `salt` spreads the points of a crowded tile over that
    many tasks, at the cost of as many copies of the boxes; without it adaptive execution splits such tiles."""
    b = box_tiles(boxes)
    p = point_tiles(points, b, lon, lat)
    on = ["_level", "_tx", "_ty"]
    if salt > 1:
        p = p.withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.lit(salt)).cast("int"))
        b = b.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        on.append("_salt")
    inside = geo.in_box(F.col(lon), F.col(lat), F.col("_pw"), F.col("south"), F.col("_pe"), F.col("north"))
    return p.join(b, on).where(inside).drop(*on, "_pw", "_pe")


def stations_for_boxes(sites: DataFrame, boxes: DataFrame, box: str, proxies: Sequence[int], site: str = "site") -> DataFrame:
    """(box, site, within_box, distance_km): the sites inside each box or, where there is none, the proxy sites
    with their distance, marked as outside."""
    sites = materialise(sites, "sites")
    own = boxes.select(box, *BOX)
    levels = box_parts(own).select("_level").distinct()
    on = ["_level", "_tx", "_ty"]
    tiles = point_tiles(sites.select(site, "lon", "lat"), levels)
    # As far as they are few enough, sites go to where the boxes are: else boxes are moved by tile, and a tile's pairs are one task's. Neighbouring
    # boxes share a task, and each meets its sites one after another, so files of pairs state a box once and list few different sites.
    few = tiles.limit(MOST_SITES + 1).count() <= MOST_SITES
    if few:
        level = geo.box_level(F.col("east") - F.col("west"), F.col("north") - F.col("south"))
        place = [level, geo.level_tile(F.col("west"), level), geo.level_tile(F.col("south"), level), F.col(box)]
        near = own.repartitionByRange(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), *place)
        meets = geo.in_box(F.col("lon"), F.col("lat"), F.col("_pw"), F.col("south"), F.col("_pe"), F.col("north"))
        hits = box_tiles(near).join(F.broadcast(tiles), on).where(meets).select(box, site)
    else:
        hits = points_in_boxes(sites, own).select(box, site)
    # Whether a box has any site is known by the first; the pairs are not listed again for it.
    tiled = box_tiles(spread(own))
    p = point_tiles(sites.select("lon", "lat").distinct(), levels)
    p = F.broadcast(p) if few else p
    met = geo.in_box(F.col("p.lon"), F.col("p.lat"), F.col("b._pw"), F.col("b.south"), F.col("b._pe"), F.col("b.north"))
    for c in on:
        met = met & (F.col(f"b.{c}") == F.col(f"p.{c}"))
    occupied = tiled.alias("b").join(p.alias("p"), met, "left_semi").select(box).distinct()
    inside = hits.select(box, site, F.lit(True).alias("within_box"), F.lit(0.0).alias("distance_km"))
    empty = boxes.join(occupied, box, "left_anti")
    kind = sites.schema[site].dataType
    listed = empty.withColumn(site, F.explode(F.array(*[F.lit(s).cast(kind) for s in proxies])))
    outside = listed.join(sites.select(site, "lon", "lat").where(F.col(site).isin(list(proxies))), site).select(
        box,
        site,
        F.lit(False).alias("within_box"),
        F.round(geo.distance_to_box_km(F.col("lon"), F.col("lat"), *[F.col(c) for c in BOX]), 1).alias("distance_km"),
    )
    return inside.unionByName(outside)


def overlap_join(
    left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width_us: int, on: Sequence[str] = ()
) -> DataFrame:
    """Rows whose closed time spans share an instant. Both sides are listed under each bucket they touch; a pair
    is kept only in the first bucket both touch, so it appears once without a distinct."""
    def cut(df: DataFrame, span: tuple[str, str], first: str) -> DataFrame:
        low, high = (times.step_index(F.col(c), width_us) for c in span)
        return df.withColumn(first, low).withColumn("_bucket", F.explode(F.sequence(low, F.greatest(low, high))))

    a, b = cut(left, left_span, "_fa"), cut(right, right_span, "_fb")
    keep = (
        (F.col("_bucket") == F.greatest("_fa", "_fb"))
        & (F.col(left_span[0]) <= F.col(right_span[1]))
        & (F.col(right_span[0]) <= F.col(left_span[1]))
    )
    return a.join(b, [*on, "_bucket"]).where(keep).drop("_bucket", "_fa", "_fb")


#: The shortest bucket of time spans; each level doubles it.
FINEST_SPAN_US = 3_600_000_000


def span_level(first: Column, last: Column) -> Column:
    """The first level whose buckets are at least as long as the span."""
    steps = F.ceil(F.log2((times.micros(last) - times.micros(first)) / F.lit(float(FINEST_SPAN_US)))).cast("int")
    return F.greatest(F.lit(0), F.coalesce(steps, F.lit(0)))


def _span_bucket(t: Column, level: Column) -> Column:
    return F.floor(times.micros(t) / (F.pow(F.lit(2.0), level) * FINEST_SPAN_US)).cast("long")


def catalog_candidates(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, store_id) and both boxes and spans (marked _b and _a) of the pairs that share a place in two hierarchies, one of tiles and one
    of time buckets, whose levels fit the boxes' and spans' own sizes.

    Of a pair the coarser one is listed on its own level only, the finer one on each coarser level that the other side uses; both
    under the tiles that they touch there, mostly one or two. Two fine boxes so never meet on a coarse level. A pair counts in the
    first tile that both touch. Spans do the same, each independently."""

    def slim(df: DataFrame, key: str, mark: str) -> DataFrame:
        own = geo.box_level(F.col("east") - F.col("west"), F.col("north") - F.col("south"))
        start, end = F.col("time_start"), F.col("time_end")
        whole = (F.col("west") <= F.col("east")) & (F.col("south") <= F.col("north")) & (start <= end)
        return df.where(whole).select(
            key, start.alias(mark + "0"), end.alias(mark + "1"), own.alias(mark + "level"), span_level(start, end).alias(mark + "span"), *[F.col(c).alias(mark + c) for c in BOX]
        )

    a, b = slim(catalog, "store_id", "_a"), slim(requests, "request", "_b")
    used = [sizes.one_row(df.agg(F.collect_set(mark + "level").alias(mark + "_levels"), F.collect_set(mark + "span").alias(mark + "_spans"))) for df, mark in ((a, "_a"), (b, "_b"))]

    def side(df: DataFrame, mark: str, other: str, equal: bool) -> DataFrame:
        west, south, east, north = (F.col(mark + c) for c in BOX)
        start, end = F.col(mark + "0"), F.col(mark + "1")

        def owned(name: str, levels: str) -> Column:
            """Levels to be listed on, with the side whose level it is: the own one, and the other side's coarser ones."""
            v = F.col(mark + name)
            above = F.filter(other + levels, lambda x: (x >= v) if equal else (x > v))
            mine = F.array(F.struct(F.lit(mark).alias("o"), v.alias("v")))
            return F.concat(mine, F.transform(above, lambda x: F.struct(F.lit(other).alias("o"), x.alias("v"))))

        for each in used:
            df = df.join(each)
        df = df.withColumn("_s", F.explode(owned("level", "_levels"))).withColumn("_t", F.explode(owned("span", "_spans")))
        level, span = F.col("_s.v"), F.col("_t.v")
        df = df.withColumns({mark + "x": geo.level_tile(west, level), mark + "y": geo.level_tile(south, level), mark + "b": _span_bucket(start, span)})
        for name, first, last in (("_tx", "x", geo.level_tile(east, level)), ("_ty", "y", geo.level_tile(north, level)), ("_tb", "b", _span_bucket(end, span))):
            df = df.withColumn(name, F.explode(F.sequence(F.col(mark + first), last)))
        return df.withColumns({"_so": F.col("_s.o"), "_sl": level, "_to": F.col("_t.o"), "_tl": span}).drop("_a_levels", "_b_levels", "_a_spans", "_b_spans", "_s", "_t")

    on = ["_so", "_sl", "_tx", "_ty", "_to", "_tl", "_tb"]
    met = side(a, "_a", "_b", True).join(side(b, "_b", "_a", False), on)
    first = [F.col(tile) == F.greatest("_a" + c, "_b" + c) for tile, c in (("_tx", "x"), ("_ty", "y"), ("_tb", "b"))]
    return met.where(first[0] & first[1] & first[2]).drop(*on)


def search_catalog(catalog: DataFrame, requests: DataFrame, *, families: Sequence[str] | None = None, kind: str | None = None) -> DataFrame:
    """(request, store_id) of the stores whose box and time span overlap a request's, ends included. Give boxes with
    west <= east; one with a null side or end, or whose end is before its start, overlaps nothing."""
    if families is not None:
        catalog = catalog.where(F.col("family").isin(list(families)))
    if kind is not None:
        catalog = catalog.where(F.col("kind") == kind)
    both = geo.overlaps(*[F.col("_a" + c) for c in BOX], *[F.col("_b" + c) for c in BOX])
    together = (F.col("_a0") <= F.col("_b1")) & (F.col("_b0") <= F.col("_a1"))
    return catalog_candidates(catalog, requests).where(both & together).select("request", "store_id")


# Donors ----------------------------------------------------------------------------------------


def rank_donors(requests: DataFrame, donors: DataFrame, delivered: DataFrame | None = None) -> DataFrame:
    """Donors whose domain contains each request's box, ranked by domain area, resolution and id. With
    `delivered(request, domain)`, `chosen` marks the first ranked donor that delivers."""
    wide = donors.select("domain", "resolution_m", *BOX)
    asked = requests.select("request", *[F.col(c).alias("_" + c) for c in BOX], F.col("west").alias("lon"), F.col("south").alias("lat"))
    held = points_in_boxes(asked, wide).where(
        geo.contains(*[F.col(c) for c in BOX], *[F.col("_" + c) for c in BOX])
    )
    area = geo.box_area(*[F.col(c) for c in BOX])
    order = Window.partitionBy("request").orderBy("area", "resolution_m", "domain")
    ranked = held.select("request", "domain", area.alias("area"), "resolution_m").withColumn("rank", F.row_number().over(order))
    if delivered is None:
        return ranked
    got = delivered.select("request", "domain").distinct().withColumn("_got", F.lit(True))
    every = Window.partitionBy("request")
    best = F.min(F.when(F.col("_got"), F.col("rank"))).over(every)
    return ranked.join(got, ["request", "domain"], "left").withColumn("chosen", F.coalesce(F.col("rank") == best, F.lit(False))).drop("_got")


# Nearest ---------------------------------------------------------------------------------------


def nearest_site(points: DataFrame, sites: DataFrame, *, point: str = "point", site: str = "site", size: float = 1 / 32, grow: int = 16) -> DataFrame:
    """The nearest site to each point, longitude scaled by the point's own cosine. Distances equal to twelve
    decimals tie, and the lower id wins.

    Sites at one position count once, and a position shared by many points is looked up once. Sites within one
    tile ring are certain to include the nearest when the best found is closer than a tile, so crowded places are
    settled on small tiles; places without such a site go on with tiles `grow` times larger. There the occupied
    small tiles are weighed first, by the least and the greatest distance their sites can have, and only the
    sites of tiles that can hold the nearest are looked at. Each ring's answers are stored, so the next one starts from the few
    places that are left, and the search ends with the first ring that leaves none. The last ring spans the globe, poles too."""
    s = materialise(sites.groupBy(F.col("lon").alias("_slon"), F.col("lat").alias("_slat")).agg(F.min(site).alias(site)), "positions")
    where = points.select(point, F.col("lon").alias("_plon"), F.col("lat").alias("_plat"))
    left = where.select("_plon", "_plat").distinct()
    here = ["_plon", "_plat"]
    ring = F.sequence(F.lit(-1), F.lit(1))
    cos = F.cos(F.radians("_plat"))

    def probes(side: float) -> DataFrame:
        around = left.withColumn("_dx", F.explode(ring)).withColumn("_dy", F.explode(ring))
        return around.select(*here, (geo.tile(F.col("_plon"), side) + F.col("_dx")).alias("_cx"), (geo.tile(F.col("_plat"), side) + F.col("_dy")).alias("_cy"))

    # A tile that does not exist, other for each place, so places without a tile do not crowd one task.
    nowhere = F.lit(-(10**12)) - F.pmod(F.xxhash64(*here), F.lit(1_000_000))

    def squared(dx: Column, dy: Column) -> Column:
        return dx * cos * dx * cos + dy * dy

    answers = None
    while True:
        last = size >= 360.0
        if answers is None:
            fine = size
            look = probes(size).withColumnsRenamed({"_cx": "_tx", "_cy": "_ty"})
        else:
            fine = size / grow
            tiles = s.groupBy(geo.tile(F.col("_slon"), fine).alias("_tx"), geo.tile(F.col("_slat"), fine).alias("_ty")).agg(
                F.min("_slon").alias("_w"), F.max("_slon").alias("_e"), F.min("_slat").alias("_s"), F.max("_slat").alias("_n")
            ).withColumns({"_cx": F.floor(F.col("_tx") / grow), "_cy": F.floor(F.col("_ty") / grow)})
            x, y = F.col("_plon"), F.col("_plat")
            zero = F.lit(0.0)
            least = squared(F.greatest(F.col("_w") - x, x - F.col("_e"), zero), F.greatest(F.col("_s") - y, y - F.col("_n"), zero))
            most = squared(F.greatest(F.abs(F.col("_w") - x), F.abs(F.col("_e") - x)), F.greatest(F.abs(F.col("_s") - y), F.abs(F.col("_n") - y)))
            near = probes(size).join(tiles, ["_cx", "_cy"], "left").select(*here, "_tx", "_ty", least.alias("_least"), most.alias("_most"))
            bound = F.min("_most").over(Window.partitionBy(*here))
            look = near.withColumn("_bound", bound).where(F.col("_bound").isNull() | (F.col("_least") <= F.col("_bound") * (1 + 1e-9))).select(
                *here, F.coalesce(F.col("_tx"), nowhere).alias("_tx"), "_ty"
            )
        held = s.withColumns({"_tx": geo.tile(F.col("_slon"), fine), "_ty": geo.tile(F.col("_slat"), fine)})
        d2 = F.floor(squared(F.col("_slon") - F.col("_plon"), F.col("_slat") - F.col("_plat")) * 1e12 + 0.5).cast("long")
        # Points without a site in the ring stay, with nothing found.
        hit = F.when(F.col(site).isNotNull(), F.struct(d2.alias("d2"), F.col(site).alias(site)))
        best = look.join(held, ["_tx", "_ty"], "left").groupBy(*here).agg(F.min(hit).alias("_best"))
        sure = F.lit(True) if last else F.coalesce(F.sqrt(F.col("_best.d2") / 1e12) < cos * size, F.lit(False))
        found = materialise(best.withColumn("_sure", sure), "ring")
        done = found.where("_sure").drop("_sure")
        answers = done if answers is None else answers.unionByName(done)
        left = found.where(~F.col("_sure")).select(*here)
        if last or left.isEmpty():
            break
        size *= grow
    return where.join(answers, here).select(point, F.col(f"_best.{site}").alias(site), (F.col("_best.d2") / 1e12).alias("d2"))


def snap_pixels(pixels: DataFrame, base: DataFrame, step: float) -> DataFrame:
    """Match each pixel centre (lon, lat) to the base grid's nearest centre (iy, ix, lon, lat) not more than half
    a cell away in each axis; unmatched pixels keep nulls. Give distinct centres, not observations."""
    def index(c: str) -> Column:
        return F.floor(F.col(c) / step + 0.5).cast("long")

    near = F.sequence(F.lit(-1), F.lit(1))
    probe = pixels.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near)).withColumns(
        {"_tx": index("lon") + F.col("_dx"), "_ty": index("lat") + F.col("_dy")}
    )
    held = base.select("iy", "ix", F.col("lon").alias("_blon"), F.col("lat").alias("_blat")).withColumns(
        {"_tx": F.floor(F.col("_blon") / step + 0.5).cast("long"), "_ty": F.floor(F.col("_blat") / step + 0.5).cast("long")}
    )
    dx, dy = F.abs(F.col("_blon") - F.col("lon")), F.abs(F.col("_blat") - F.col("lat"))
    tolerance = step / 2.0
    hit = F.when((dx <= tolerance) & (dy <= tolerance), F.struct((dx + dy).alias("d"), F.col("iy").alias("iy"), F.col("ix").alias("ix")))
    return probe.join(held, ["_tx", "_ty"], "left").groupBy("lon", "lat").agg(F.min(hit).alias("_b")).select(
        "lon", "lat", F.col("_b.iy").alias("iy"), F.col("_b.ix").alias("ix")
    )


# Segments and fields on shared times -----------------------------------------------------------


def split_window(requests: DataFrame, segments: DataFrame, *, width_us: int = 30 * times.DAY_US) -> DataFrame:
    """Each request's window [start, end] cut at source switches: (request, segment, piece_start, piece_end,
    tidal). The last segment is open-ended, a switch time belongs to the newer one, and a request that begins
    before the first segment gets no pieces. The ends of segments are found in pieces of a day, so switches may be as
    many as they like; of two at one time the lower segment ends at once."""
    ends = requests.agg(F.max("end").alias("_far")).join(segments.agg(F.min("start").alias("_first")))
    one = segments.select(F.lit(0).alias("_all"), "segment", "start", "tidal")
    swept = ordered.with_neighbours(one, ["_all"], ["start", "segment"], times.day_index(F.col("start")), next={"_next": "start"})
    spans = (
        swept.select("segment", F.col("start").alias("_s0"), "_next", "tidal")
        .join(sizes.one_row(ends))
        .withColumn("_s1", F.greatest(F.col("_s0"), F.coalesce(F.col("_next"), F.col("_far"))))
        .where(F.col("_s0") <= F.col("_far"))
    )
    pairs = overlap_join(requests.select("request", "start", "end"), spans, ("start", "end"), ("_s0", "_s1"), width_us)
    serves = (F.col("start") >= F.col("_first")) & (F.col("_next").isNull() | (F.col("_next") > F.col("start"))) & (
        (F.col("_s0") < F.col("end")) | (F.col("_s0") <= F.col("start"))
    )
    return pairs.where(serves).select(
        "request",
        "segment",
        F.greatest("start", "_s0").alias("piece_start"),
        F.least("end", F.coalesce("_next", "end")).alias("piece_end"),
        "tidal",
    )


def tidal_content(pieces: DataFrame) -> DataFrame:
    """Per request whether its pieces are all tidal, none, or mixed."""
    return pieces.groupBy("request").agg(
        F.when(F.bool_and("tidal"), "included").when(F.bool_or("tidal"), "mixed").otherwise("none").alias("tides"),
        F.count(F.lit(1)).alias("n_pieces"),
    )


def stitch(rows: DataFrame, key: Sequence[str], newest: str) -> DataFrame:
    """Pieces appended; where a time appears in two, the copy of the newer source is kept."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(newest)).alias("_row"))
    return best.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*rows.columns)


def merge_fields(parts: dict[str, DataFrame], key: Sequence[str], *, time: str = "time", value: str = "value") -> DataFrame:
    """Fields of different cadences side by side on all their times, trimmed to the span every field shares.
    Parts are stacked and grouped once instead of joined one by one."""
    stacked = None
    for name, part in parts.items():
        one = part.select(*key, F.col(value).alias(name))
        stacked = one if stacked is None else stacked.unionByName(one, allowMissingColumns=True)
    wide = stacked.groupBy(*key).agg(*[F.max(n).alias(n) for n in parts])
    present = [F.when(F.col(n).isNotNull(), F.col(time)) for n in parts]
    edge = wide.agg(F.array(*[F.min(t) for t in present]).alias("_first"), F.array(*[F.max(t) for t in present]).alias("_last"))
    span = edge.select(F.array_max("_first").alias("_t0"), F.array_min("_last").alias("_t1"))
    return wide.join(sizes.one_row(span)).where(F.col(time).between(F.col("_t0"), F.col("_t1"))).drop("_t0", "_t1")
