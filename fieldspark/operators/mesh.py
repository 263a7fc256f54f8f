"""Triangle meshes: location, neighbours, subsets, sections, areas and grids drawn as meshes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions import geo, ordered
from fieldspark.operators import joins, sizes

# Neighbour codes at the coast and outside a subset.
COAST, OUTSIDE = -1, -2
EDGE_TOLERANCE = -1e-9


def _corner_rows(elements: DataFrame) -> DataFrame:
    """One row per element and corner: (elem, k, node)."""
    return elements.select("elem", F.posexplode(F.array("n0", "n1", "n2")).alias("k", "node"))


def element_corners(elements: DataFrame, nodes: DataFrame, fields: Sequence[str] = ("lon", "lat")) -> DataFrame:
    """Elements with each field of their three nodes side by side: lon0, lon1, lon2, lat0, ... One join and one
    grouping instead of three joins."""
    rows = _corner_rows(elements).join(nodes.select("node", *fields), "node")
    pick = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for c in fields for k in range(3)]
    ids = [F.max(F.when(F.col("k") == k, F.col("node"))).alias(f"n{k}") for k in range(3)]
    return rows.groupBy("elem").agg(*ids, *pick)


def locate(points: DataFrame, corners: DataFrame, *, carry: Sequence[str] = ()) -> DataFrame:
    """Add (elem, b0, b1, b2) to each point (..., lon, lat; distinct rows): the element that contains it and its
    weights on the element's corners, null outside the mesh; `carry` brings more columns of the element along.
    On a shared edge the lowest element wins.

    Each triangle is listed under the tiles of its own size that its bounding box touches, so river elements of
    metres and ocean elements of kilometres both stand in few tiles with few others. The best hit is kept while
    grouping by point, so nothing is joined back."""
    lon, lat = [F.col(f"lon{k}") for k in range(3)], [F.col(f"lat{k}") for k in range(3)]
    tol = 1e-9
    boxed = corners.select(
        "elem", *[f"lon{k}" for k in range(3)], *[f"lat{k}" for k in range(3)], *carry,
        (F.least(*lon) - tol).alias("_w"), (F.least(*lat) - tol).alias("_s"), (F.greatest(*lon) + tol).alias("_e"), (F.greatest(*lat) + tol).alias("_n"),
    )
    t = joins.box_tiles(boxed, ("_w", "_s", "_e", "_n"))
    p = joins.point_tiles(points, t)
    b = geo.barycentric(F.col("lon"), F.col("lat"), lon[0], lat[0], lon[1], lat[1], lon[2], lat[2])
    inside = (b[0] >= EDGE_TOLERANCE) & (b[1] >= EDGE_TOLERANCE) & (b[2] >= EDGE_TOLERANCE)
    hit = F.when(inside, F.col("elem"))
    # Each number by itself, all for the lowest element: fixed-width buffers, so Spark groups by hash.
    first = [F.min_by(v, hit).alias(c) for c, v in (("b0", b[0]), ("b1", b[1]), ("b2", b[2]), *[(c, F.col(c)) for c in carry])]
    return p.join(t, ["_level", "_tx", "_ty"], "left").groupBy(*points.columns).agg(F.min(hit).alias("elem"), *first)


def neighbours(elements: DataFrame) -> DataFrame:
    """(elem, k, neighbour): the element across the edge opposite corner k, -1 on the mesh boundary. An edge in
    more than two elements is an error. Each edge is one group of at most two rows."""
    edges = _edge_groups(elements)
    checked = edges.withColumn(
        "_n", F.when(F.col("_n") > 2, F.raise_error(F.lit("more than two elements meet at one edge")).cast("long")).otherwise(F.col("_n"))
    )
    both = F.array(
        F.struct(F.col("_a.elem").alias("elem"), F.col("_a.k").alias("k"), F.when(F.col("_n") == 2, F.col("_b.elem")).otherwise(COAST).alias("neighbour")),
        F.struct(F.col("_b.elem").alias("elem"), F.col("_b.k").alias("k"), F.when(F.col("_n") == 2, F.col("_a.elem")).alias("neighbour")),
    )
    out = checked.select(F.explode(both).alias("_r")).select("_r.*")
    return out.where(F.col("neighbour").isNotNull())


def _edge_groups(elements: DataFrame) -> DataFrame:
    """One row per edge: its nodes (a, b), the count of elements and their first and last (elem, k)."""
    n = [F.col("n0"), F.col("n1"), F.col("n2")]
    opposite = F.array(*[
        F.struct(F.lit(k).alias("k"), F.least(n[(k + 1) % 3], n[(k + 2) % 3]).alias("a"), F.greatest(n[(k + 1) % 3], n[(k + 2) % 3]).alias("b"))
        for k in range(3)
    ])
    rows = elements.select("elem", F.explode(opposite).alias("_e")).select("elem", "_e.*")
    return rows.groupBy("a", "b").agg(F.min(F.struct("elem", "k")).alias("_a"), F.max(F.struct("elem", "k")).alias("_b"), F.count(F.lit(1)).alias("_n"))


def boundary_nodes(elements: DataFrame) -> DataFrame:
    """Nodes on an edge that belongs to one element only."""
    edge = _edge_groups(elements).where(F.col("_n") == 1)
    return edge.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def subset_elements(corners: DataFrame, box: Sequence[float]) -> DataFrame:
    """Elements whose centroid lies in the box, with global ids."""
    lon = (F.col("lon0") + F.col("lon1") + F.col("lon2")) / 3.0
    lat = (F.col("lat0") + F.col("lat1") + F.col("lat2")) / 3.0
    return corners.where(geo.in_box(lon, lat, *box))


def subset_mesh(elements: DataFrame, nodes: DataFrame, box: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """(elements, nodes) of a box. Elements carry nb0..nb2: the neighbour's global id, -1 at the coast, -2 where
    it lies outside the subset. Nodes carry `on_boundary`. The whole mesh decides both: where the box cuts through water there is
    no shore."""
    kept = subset_elements(element_corners(elements, nodes), box).select("elem", "n0", "n1", "n2")
    ids = kept.select("elem")
    across = neighbours(elements).join(ids, "elem", "left_semi")
    held = ids.select(F.col("elem").alias("neighbour"), F.lit(True).alias("_in"))
    code = F.when(F.col("neighbour") == COAST, COAST).when(F.col("_in"), F.col("neighbour")).otherwise(OUTSIDE)
    wide = across.join(held, "neighbour", "left").groupBy("elem").agg(
        *[F.max(F.when(F.col("k") == k, code)).alias(f"nb{k}") for k in range(3)]
    )
    used = _corner_rows(kept).select("node").distinct()
    rim = boundary_nodes(elements).withColumn("_rim", F.lit(True))
    sub_nodes = nodes.join(used, "node", "left_semi").join(rim, "node", "left").withColumn("on_boundary", F.coalesce("_rim", F.lit(False))).drop("_rim")
    return kept.join(wide, "elem"), sub_nodes


def export_ids(rows: DataFrame, key: str, *, block: int = 65_536, out: str = "local") -> DataFrame:
    """Dense 0-based ids in the order of `key`, as an exported subset carries them; counted in blocks of keys."""
    piece = F.floor(F.col(key) / F.lit(block)).cast("long")
    ranked = ordered.with_running_sum(rows.withColumn("_all", F.lit(0)), ["_all"], [key], piece, F.lit(1), "_rank")
    return ranked.withColumn(out, F.col("_rank") - 1).drop("_all", "_rank")


def to_elements(node_field: DataFrame, elements: DataFrame, step: Sequence[str], value: str = "value") -> DataFrame:
    """Element value as the mean of its three nodes; null when one is missing."""
    rows = _corner_rows(elements).join(node_field, "node")
    return rows.groupBy(*step, "elem").agg(F.when(F.count(value) == 3, F.avg(value)).alias(value))


def element_area(corners: DataFrame) -> DataFrame:
    area = geo.triangle_area_m2([F.col(f"lon{k}") for k in range(3)], [F.col(f"lat{k}") for k in range(3)])
    return corners.select("elem", area.alias("area_m2"))


def polygon_area(rings: DataFrame, polygon: Sequence[str], *, ring: str = "ring", block: int = 4096) -> DataFrame:
    """Square miles of each polygon of `rings(polygon..., ring, seq, lon, lat, hole)`: outer rings less holes."""
    piece = F.floor(F.col("seq") / F.lit(block)).cast("long")
    key = [*polygon, ring, "hole"]
    edges = ordered.with_neighbours(rings, key, ["seq"], piece, next={"_lon": "lon", "_lat": "lat"}).where(F.col("_lon").isNotNull())
    total = edges.groupBy(*key).agg(F.sum(geo.ring_segment(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"))).alias("_t"))
    signed = geo.ring_area_km2(F.col("_t")) * F.when(F.col("hole"), -1.0).otherwise(1.0)
    return total.groupBy(*polygon).agg((F.sum(signed) / geo.SQKM_PER_SQMI).alias("area_sqmi"), F.count(F.lit(1)).alias("rings"))


# Sections --------------------------------------------------------------------------------------


def sample_line(lines: DataFrame, n: int, *, line: str = "line", block: int = 4096) -> DataFrame:
    """`n` points evenly spaced by distance along each polyline (line, seq, lon, lat), both ends included:
    (line, k, distance, lon, lat). Each segment lists the samples that fall on it, so none is searched for."""
    if n < 2:
        raise ValueError("n must be at least 2")
    centre = lines.groupBy(line).agg(F.avg("lon").alias("_lon0"), F.avg("lat").alias("_lat0"))
    rows = lines.join(centre, line)
    x, y = geo.to_local(F.col("lon"), F.col("lat"), F.col("_lon0"), F.col("_lat0"))
    rows = rows.select(line, "seq", "_lon0", "_lat0", x.alias("_x"), y.alias("_y"))
    legs = _cumulative(rows, line, block)
    step = F.col("_total") / float(n - 1)
    k0 = F.when(F.col("_total") > 0, F.ceil(F.try_divide(F.col("_c0"), step)).cast("int")).otherwise(0)
    k1 = F.when(F.col("_closing"), n - 1).otherwise(F.ceil(F.try_divide(F.col("_c1"), step)).cast("int") - 1)
    listed = legs.withColumns({"_k0": F.coalesce(k0, F.lit(0)), "_k1": F.coalesce(k1, F.lit(-1))}).where(F.col("_k0") <= F.col("_k1"))
    listed = listed.withColumn("k", F.explode(F.sequence("_k0", "_k1"))).withColumn("distance", F.col("k") * step)
    f = F.coalesce(F.try_divide(F.col("distance") - F.col("_c0"), F.col("_d")), F.lit(0.0))
    px, py = F.col("_x") + (F.col("_x1") - F.col("_x")) * f, F.col("_y") + (F.col("_y1") - F.col("_y")) * f
    lon, lat = geo.from_local(px, py, F.col("_lon0"), F.col("_lat0"))
    return listed.select(line, F.col("k").cast("int").alias("k"), "distance", lon.alias("lon"), lat.alias("lat"))


def _cumulative(rows: DataFrame, line: str, block: int) -> DataFrame:
    """Legs between consecutive vertices (line, seq, _x, _y) with the distance along the line before (_c0) and
    after (_c1) each, the whole length (_total), and which leg is the last (_closing). Lines are walked in blocks of
    vertices; what a block needs of the others is one row per block."""
    cut = rows.withColumn("_piece", F.floor(F.col("seq") / F.lit(block)).cast("long"))
    inside = Window.partitionBy(line, "_piece").orderBy("seq")
    down = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    vertex = F.struct("_x", "_y", "seq")

    def length(a: str, b: str) -> Column:
        return F.hypot(F.col(b + "._x") - F.col(a + "._x"), F.col(b + "._y") - F.col(a + "._y"))

    here = cut.withColumn("_here", vertex).withColumn("_n", F.lead("_here").over(inside))
    blocks = here.groupBy(line, "_piece").agg(
        F.coalesce(F.sum(length("_here", "_n")), F.lit(0.0)).alias("_own"), F.min_by("_here", "seq").alias("_first"), F.max_by("_here", "seq").alias("_last")
    )
    across, whole = Window.partitionBy(line).orderBy("_piece"), Window.partitionBy(line)
    blocks = blocks.withColumn("_next", F.lead("_first").over(across)).withColumn("_len", F.col("_own") + F.coalesce(length("_last", "_next"), F.lit(0.0)))
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_len").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    blocks = blocks.select(
        line, "_piece", "_next", "_off", F.lead("_off").over(across).alias("_off1"), F.sum("_len").over(whole).alias("_total"), F.max("_last.seq").over(whole).alias("_final")
    )
    legs = here.join(blocks, [line, "_piece"]).withColumn("_bridge", F.col("_n").isNull()).withColumn("_n", F.coalesce("_n", "_next"))
    legs = legs.where(F.col("_n").isNotNull()).withColumn("_d", length("_here", "_n"))
    run = F.sum("_d").over(down)
    # A leg ends at the very number the next one starts from, also across blocks, so no sample is lost or doubled.
    return legs.select(
        "*", F.col("_n._x").alias("_x1"), F.col("_n._y").alias("_y1"), (F.col("_n.seq") == F.col("_final")).alias("_closing"),
        (F.col("_off") + F.coalesce(F.sum("_d").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).alias("_c0"),
        F.when(F.col("_bridge"), F.coalesce("_off1", "_total")).otherwise(F.col("_off") + run).alias("_c1"),
    )


def section(lines: DataFrame, corners: DataFrame, field: DataFrame, n: int, *, line: str = "line") -> DataFrame:
    """Samples along each line with their host element and that element's value in every layer of `field(elem,
    layer, value)`; the bed is interpolated from the corners' depth when they carry it. Samples outside the mesh
    keep nulls."""
    depth = [c for c in ("h0", "h1", "h2") if c in corners.columns]
    samples = locate(sample_line(lines, n, line=line), corners, carry=depth)
    if depth:
        bed = -(F.col("b0") * F.col("h0") + F.col("b1") * F.col("h1") + F.col("b2") * F.col("h2"))
        samples = samples.withColumn("bed", bed).drop(*depth)
    return samples.join(field, "elem", "left").drop("b0", "b1", "b2")


# Grids as meshes -------------------------------------------------------------------------------


def cell_edges(axes: DataFrame, *, axis: Sequence[str] = ("axis",), block: int = 4096) -> DataFrame:
    """Edges of 1-D axes (axis..., i, centre): midpoints, the ends half a cell beyond the outer centres; edge i
    lies before centre i, and the last centre has one more after it."""
    piece = F.floor(F.col("i") / F.lit(block)).cast("long")
    rows = ordered.with_neighbours(axes, axis, ["i"], piece, prev={"_p": "centre"}, next={"_n": "centre"})
    c, p, nx = F.col("centre"), F.col("_p"), F.col("_n")
    low = F.when(p.isNotNull(), (p + c) * 0.5).otherwise(c * 2.0 - (c + nx) * 0.5)
    high = F.when(nx.isNull(), c * 2.0 - (p + c) * 0.5)
    both = F.array(F.struct(F.col("i").alias("edge"), low.alias("value")), F.struct((F.col("i") + 1).alias("edge"), high.alias("value")))
    return rows.select(*axis, F.explode(both).alias("_e")).select(*axis, "_e.edge", "_e.value").where(F.col("value").isNotNull())


def cell_corners(grid: DataFrame, ny: int | Column, nx: int | Column, value: str = "lon") -> DataFrame:
    """Corners (jy, jx, value) of a whole curvilinear grid of centres: the mean of the four around each, the grid
    extended linearly by one ghost row and column on every side. `ny` and `nx` may be columns of the grid."""
    def ghost(df: DataFrame, along: str, count) -> DataFrame:
        count = count if isinstance(count, Column) else F.lit(count)
        last = count - 1
        i = F.col(along)
        spread = F.array(
            F.struct(i.alias("i"), F.lit(1.0).alias("f")),
            F.struct(F.when(i.isin(0, 1), -1).alias("i"), F.when(i == 0, 2.0).otherwise(-1.0).alias("f")),
            F.struct(F.when((i == last) | (i == last - 1), count).alias("i"), F.when(i == last, 2.0).otherwise(-1.0).alias("f")),
        )
        other = "ix" if along == "iy" else "iy"
        rows = df.select(other, "_ny", "_nx", "_v", F.explode(spread).alias("_g")).where(F.col("_g.i").isNotNull())
        return rows.groupBy(other, F.col("_g.i").alias(along), "_ny", "_nx").agg(F.sum(F.col("_v") * F.col("_g.f")).alias("_v"))

    base = grid.select(
        "iy", "ix", F.col(value).alias("_v"), (ny if isinstance(ny, Column) else F.lit(ny)).alias("_ny"), (nx if isinstance(nx, Column) else F.lit(nx)).alias("_nx")
    )
    full = ghost(ghost(base, "iy", F.col("_ny")), "ix", F.col("_nx"))
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    spread = full.withColumn("_o", F.explode(around))
    return spread.groupBy((F.col("iy") + F.col("_o.a")).alias("jy"), (F.col("ix") + F.col("_o.b")).alias("jx")).agg(
        F.sum("_v").alias("_s"), F.count(F.lit(1)).alias("_n")
    ).where(F.col("_n") == 4).select("jy", "jx", (F.col("_s") * 0.25).alias(value))


def structured_mesh(cells: DataFrame, nx: int, wet: str = "wet") -> DataFrame:
    """Each wet cell as two triangles: (elem, n0, n1, n2, source_index). Corners are numbered row by row on the
    grid of corners; element ids come from the cell's flat index, so they need no global count (`export_ids`
    makes them dense)."""
    flat = F.col("iy") * nx + F.col("ix")
    sw = F.col("iy") * (nx + 1) + F.col("ix")
    se, nw = sw + 1, sw + nx + 1
    ne = nw + 1
    pair = F.array(
        F.struct((flat * 2).alias("elem"), sw.alias("n0"), se.alias("n1"), ne.alias("n2")),
        F.struct((flat * 2 + 1).alias("elem"), sw.alias("n0"), ne.alias("n1"), nw.alias("n2")),
    )
    return cells.where(F.col(wet)).select(flat.alias("source_index"), F.explode(pair).alias("_t")).select("_t.*", "source_index")


def thin_columns(columns: DataFrame, limit: int) -> DataFrame:
    """At most about `limit` of the columns (elem, lon, lat, area_m2): the first of each square of an even grid
    whose squares come from the water's own area; all of them when there are no more than `limit`."""
    whole = columns.agg(
        F.count(F.lit(1)).alias("_n"), F.avg("lon").alias("_lon0"), F.avg("lat").alias("_lat0"),
        F.greatest(F.sqrt(F.sum("area_m2") / float(limit)), F.lit(1.0)).alias("_side"),
    )
    rows = columns.join(sizes.one_row(whole))
    x, y = geo.to_local(F.col("lon"), F.col("lat"), F.col("_lon0"), F.col("_lat0"))
    crowded = F.col("_n") > limit
    kx = F.when(crowded, F.floor(x / F.col("_side")).cast("long")).otherwise(F.col("elem").cast("long"))
    ky = F.when(crowded, F.floor(y / F.col("_side")).cast("long")).otherwise(F.lit(-1).cast("long"))
    return rows.groupBy(kx.alias("_kx"), ky.alias("_ky")).agg(F.min("elem").alias("elem")).select("elem")


def contract_violations(nodes: DataFrame, elements: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(rule, id, n) rows of everything wrong with a mesh: corners without a node, elements with a repeated
    corner, duplicate ids, coordinates out of range, and elements whose layer count differs from the mesh's."""
    def found(df: DataFrame, rule: str, key: str, count: Column | None = None) -> DataFrame:
        n = F.lit(1).cast("long") if count is None else count
        return df.select(F.lit(rule).alias("rule"), F.col(key).cast("long").alias("id"), n.alias("n"))

    def flagged(df: DataFrame, key: str, tests: dict[str, Column]) -> DataFrame:
        """All per-id tests in one grouping; each gives a count, and a row where it is set."""
        counted = df.groupBy(key).agg(*[c.alias(f"_{i}") for i, c in enumerate(tests.values())])
        each = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(key).cast("long").alias("id"), F.col(f"_{i}").alias("n")) for i, rule in enumerate(tests)])
        return counted.select(F.explode(each).alias("_r")).select("_r.*").where(F.col("n").isNotNull())

    many = F.when(F.count(F.lit(1)) > 1, F.count(F.lit(1)))
    same = (F.col("n0") == F.col("n1")) | (F.col("n1") == F.col("n2")) | (F.col("n0") == F.col("n2"))
    outside = (F.abs("lat") > 90) | (F.col("lon") < -180) | (F.col("lon") > 360)
    dangling = _corner_rows(elements).join(nodes.select("node"), "node", "left_anti").groupBy("elem").agg(F.count(F.lit(1)).alias("_n"))
    out = (
        found(dangling, "corner without a node", "elem", F.col("_n"))
        .unionByName(flagged(elements, "elem", {"element listed twice": many, "repeated corner": F.nullif(F.count_if(same), F.lit(0))}))
        .unionByName(flagged(nodes, "node", {"node listed twice": many, "coordinate out of range": F.nullif(F.count_if(outside), F.lit(0))}))
    )
    if fields is not None:
        per = fields.groupBy("elem").agg(F.count_distinct("layer").alias("_n"))
        most = per.agg(F.max("_n").alias("_most"))
        out = out.unionByName(found(per.join(sizes.one_row(most)).where(F.col("_n") < F.col("_most")), "layer count", "elem", F.col("_n")))
        unknown = fields.join(elements.select("elem"), "elem", "left_anti").groupBy("elem").agg(F.count(F.lit(1)).alias("_n"))
        out = out.unionByName(found(unknown, "field without an element", "elem", F.col("_n")))
    return out
