"""Exact search for the largest inner products of integer vectors by a table of distances to pivots.

|q - x| follows from the product and the norms, so a lower bound on that distance is an upper bound on the score. Each row
keeps its distances to PIVOTS pivots. Two bounds come from them: the largest of |d(q, p) - d(x, p)| over the pivots, and,
as the distances also fix where q and x stand in the pivots' own subspace, the product there plus the most that what lies
outside of it can add. Candidates are evaluated in the order of the bound until it falls below the k-th score.

Rows are cut into blocks, by nearest pivot and then by a hash, so that no block grows with the number of equal rows. A query
first searches one block of its own pivot, which gives it a k-th score to start with; then it goes only to blocks whose range
of distances leaves a chance. Queries reach a block in groups of bounded size."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.base import ship
from fieldspark.session import materialise

PIVOTS = 56
#: Pivots are picked from so many rows at most (by hash). It only decides how much is pruned, never what is found.
SAMPLE = 2_048
#: Rows of a block: a 64th of all, between these. Queries that meet a block together.
LEAST, MOST, TOGETHER = 256, 8_192, 8_192
#: Queries whose bounds are in memory at once, and candidates that are evaluated for each of them in one step.
CHUNK, STEP = 128, 32


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component x as a long; null where the vector is null, holds a null or a component that is
    not finite, or components so large that a product might not fit a long."""
    y = F.transform(vector, lambda x: F.floor(F.when(F.abs(x) < 2.0**40, x.cast("double")) * scale))
    fits = F.forall(y, lambda x: F.coalesce(F.abs(x) * F.sqrt(F.size(vector)) < 2.0**31, F.lit(False)))
    return F.when(fits, y)


def pick_pivots(rows: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: first the longest, then again and again the one farthest from all picked."""
    norms = (rows * rows).sum(1)
    at = int(norms.argmax())
    picked, near = [at], np.full(len(rows), np.inf)
    while len(picked) < count:
        near = np.minimum(near, norms + norms[at] - 2 * (rows @ rows[at]))
        at = int(near.argmax())
        if near[at] <= 0:
            break
        picked.append(at)
    return rows[picked]


class Pivots:
    """The pivots of one length of vector, and the way from distances to coordinates in their subspace."""

    def __init__(self, points: np.ndarray):
        self.points, self.norms = points, (points * points).sum(1)
        values, vectors = np.linalg.eigh(points @ points.T)
        good = values > 1e-6 * max(values.max(initial=0), 1e-300)
        self.turn = vectors[:, good] / np.sqrt(values[good])

    def distances(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((v * v).sum(1)[:, None] + self.norms - 2 * (v @ self.points.T), 0))

    def coordinates(self, norms: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates in the pivots' subspace, and the length of what is outside."""
        inside = ((norms[:, None] + self.norms - distances**2) / 2) @ self.turn
        return inside, np.sqrt(np.maximum(norms - (inside**2).sum(1), 0))


class Block:
    """Rows as arrays: ids, vectors, their squared lengths, distances to the pivots and coordinates from these."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, distances: np.ndarray, pivots: Pivots):
        self.ids, self.v = ids, vectors
        self.norms = (vectors.astype(np.float64) ** 2).sum(1)
        self.distances = distances
        self.inside, self.outside = pivots.coordinates(self.norms, distances)

    def __len__(self) -> int:
        return len(self.ids)


def search(asks: Block, floor: np.ndarray, rows: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of asks, id, score) of each ask's k best rows other than itself, ties to smaller ids; those below the ask's floor
    may be left out. All rows are bounded, and evaluated from the highest bound down until it is below the k-th score."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    exact = np.sqrt(asks.norms.max(initial=0) * rows.norms.max(initial=0)) < 2**52
    kind = np.float64 if exact else np.int64  # floats hold these sums exactly, and are faster
    av, rv = asks.v.astype(kind), rows.v.astype(kind)
    for start in range(0, len(asks), CHUNK):
        part = slice(start, start + CHUNK)
        n = len(asks.ids[part])
        slack = 1e-5 * np.sqrt(np.outer(asks.norms[part], rows.norms)) + 0.5
        bound = asks.inside[part] @ rows.inside.T + np.outer(asks.outside[part], rows.outside) + slack
        bound[(bound < floor[part, None]) | (asks.ids[part, None] == rows.ids[None, :])] = -np.inf
        a, b = np.nonzero(bound > -np.inf)
        for s in range(0, len(a), 1 << 18):
            x, y = a[s : s + (1 << 18)], b[s : s + (1 << 18)]
            apart = np.zeros(len(x))
            for p in range(asks.distances.shape[1]):
                np.maximum(apart, np.abs(asks.distances[start + x, p] - rows.distances[y, p]), out=apart)
            bound[x, y] = np.minimum(bound[x, y], (asks.norms[start + x] + rows.norms[y] - apart**2) / 2 + slack[x, y])
        bound[bound < floor[part, None]] = -np.inf
        left = int((bound > -np.inf).sum(1).max(initial=0))
        if not left:
            continue
        top = np.argpartition(-bound, left - 1, axis=1)[:, :left] if left < len(rows) else np.broadcast_to(np.arange(len(rows)), (n, len(rows)))
        order = np.take_along_axis(top, np.argsort(-np.take_along_axis(bound, top, 1), axis=1, kind="stable"), 1)
        best = np.full((n, k), -np.inf) if exact else np.full((n, k), np.iinfo(np.int64).min)
        whose = np.full((n, k), np.iinfo(np.int64).max)
        filled = np.zeros((n, k), bool)
        kth = floor[part].copy()
        for s in range(0, left, STEP):
            cols = order[:, s : s + STEP]
            here = np.take_along_axis(bound, cols, 1)
            act = np.nonzero((here[:, 0] > -np.inf) & (here[:, 0] >= kth))[0]
            if not len(act):
                break
            live = here[act] > -np.inf
            scores = np.einsum("qd,qsd->qs", av[start + act], rv[cols[act]])
            scores = np.concatenate([best[act], scores], 1)
            ids = np.concatenate([whose[act], rows.ids[cols[act]]], 1)
            live = np.concatenate([filled[act], live], 1)
            by = np.lexsort((ids, -scores, ~live), axis=1)[:, :k]
            best[act], whose[act], filled[act] = (np.take_along_axis(z, by, 1) for z in (scores, ids, live))
            kth[act] = np.where(filled[act, k - 1], np.maximum(kth[act], best[act, k - 1]), kth[act])
        x, y = np.nonzero(filled & (best >= floor[part, None]))
        found.append((start + x, whose[x, y], best[x, y].astype(np.int64)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))  # type: ignore[return-value]


def _vectors(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int32).reshape(len(column), dims).astype(np.int64)


def _lists(column, width: int) -> np.ndarray:
    return np.array(list(column), np.float64).reshape(len(column), width)


def top_products(queries: DataFrame, vectors: DataFrame, k: int = 20, pivots: int = PIVOTS, sample: int = SAMPLE, least: int = LEAST, together: int = TOGETHER) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of `vectors` (vec_id, v) with the largest inner product with each
    row of `queries` (query_id, v), v an array of longs as `quantised` makes it; equal scores by smaller vec_id.

    A query doesn't meet rows of its own id. Null ids and null or empty vectors take no part, and vectors of different lengths don't
    meet. Repeated rows of `vectors` count each; repeated queries are answered once, and one query_id with two vectors is
    two queries. An empty table gives no rows; other columns are ignored."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), "v").filter("id IS NOT NULL AND size(v) > 0")
    asks = queries.select(F.col("query_id").cast("long").alias("id"), "v").filter("id IS NOT NULL AND size(v) > 0").distinct()
    picked: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample).collect():
        picked.setdefault(len(r.v), []).append(r.v)
    known = {dims: Pivots(pick_pivots(np.array(v, np.float64), pivots)) for dims, v in picked.items()}

    def of(dims: int) -> Pivots:
        """Vectors of a length that the sample doesn't have get one pivot, the origin."""
        return known[dims] if dims in known else Pivots(np.zeros((1, dims)))

    table_type = "id long, dims int, v binary, norm double, d array<double>, cell int"

    def measure(batches):
        for batch in batches:
            ids, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for dims in sorted({len(v) for v in vs}):
                own = [i for i, v in enumerate(vs) if len(v) == dims]
                v = np.array([vs[i] for i in own], np.int64)
                d = of(dims).distances(v.astype(np.float64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in own], pa.int64()), pa.array([dims] * len(own), pa.int32()), pa.array([x.tobytes() for x in v.astype(np.int32)], pa.binary()),
                        pa.array((v.astype(np.float64) ** 2).sum(1)), pa.array(list(d), pa.list_(pa.float64())), pa.array(d.argmin(1).astype(np.int32)),
                    ],
                    ["id", "dims", "v", "norm", "d", "cell"],
                )

    rows = materialise(rows.mapInArrow(measure, table_type), "pivot-table")
    asks = materialise(asks.mapInArrow(measure, table_type).withColumn("q", F.xxhash64("v")), "pivot-queries")
    per_cell = materialise(rows.groupBy("dims", "cell").agg(F.count("*").alias("n")), "cells")
    total = per_cell.agg(F.sum("n")).first()[0] or 0
    n_asks = asks.count()
    size = min(MOST, max(least, ceil(total / 64)))
    groups = max(1, ceil(n_asks / together))
    cells = per_cell.select("dims", "cell", F.ceil(F.col("n") / size).cast("int").alias("blocks"))
    blocks = rows.join(cells, ["dims", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    first = asks.join(cells, ["dims", "cell"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
    first = first.withColumn("part", F.pmod(F.xxhash64("id", "q"), F.lit(groups)).cast("int")).drop("blocks")
    key = ["dims", "cell", "block"]

    def block(frame: pd.DataFrame, dims: int) -> Block:
        return Block(frame["id"].to_numpy(np.int64), _vectors(frame["v"], dims), _lists(frame["d"], len(of(dims).points)), of(dims))

    # A block tells its ranges once, in part 0; its queries come in groups as they do later.
    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part")
    crowd = first.select(*key, "part").distinct().unionByName(blocks.select(*key).distinct().withColumn("part", F.lit(0))).distinct() if groups > 1 else None
    sent = blocks.select("*", each).join(crowd, [*key, "part"], "left_semi") if crowd is not None else blocks.withColumn("part", F.lit(0))
    seed_type = "id long, q long, vec_id long, score long, dims int, cell int, block int, lo array<double>, hi array<double>, top double"

    def seed(at, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        dims, cell, number, part = (int(x) for x in at)
        longs, lists = ["id", "q", "vec_id", "score"], ["lo", "hi"]
        parts = []
        if len(left):
            here = block(left, dims)
            if part == 0:
                parts.append(pd.DataFrame({"lo": [here.distances.min(0).tolist()], "hi": [here.distances.max(0).tolist()], "top": [here.norms.max()]}))
            if len(right):
                who, ids, scores = search(block(right, dims), np.full(len(right), -np.inf), here, k)
                parts.append(pd.DataFrame({"id": right["id"].to_numpy()[who], "q": right["q"].to_numpy()[who], "vec_id": ids, "score": scores}))
        # Of each row one half is null: a hit has no ranges, a block's ranges no query.
        frame = pd.DataFrame({c: pd.Series([x for p in parts for x in (p[c].tolist() if c in p else [None] * len(p))], dtype=object) for c in (*longs, *lists, "top")})
        return frame.assign(dims=dims, cell=cell, block=number)

    seeded = sent.groupBy(*key, "part").cogroup(first.groupBy(*key, "part")).applyInPandas(seed, seed_type)
    seeded = materialise(seeded, "pivot-seeds")
    ranges = seeded.filter("lo IS NOT NULL").select(*key, "lo", "hi", "top")
    hits = seeded.filter("vec_id IS NOT NULL").select("id", "q", "vec_id", "score")
    floors = hits.groupBy("id", "q").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    # Where a query may still find something: not in its first block, and not where the ranges rule it out.
    was = first.select("id", "q", F.col("cell").alias("own"), F.col("block").alias("done"))
    slim = asks.select("id", "q", "dims", "norm", "d").join(floors, ["id", "q"], "left").join(was, ["id", "q"], "left")
    open_ = slim.join(cells, "dims").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(ranges, key)
    over = F.zip_with("d", "hi", lambda x, y: x - y)
    under = F.zip_with("lo", "d", lambda x, y: x - y)
    apart = F.greatest(F.array_max(F.zip_with(over, under, lambda x, y: F.greatest(x, y))), F.lit(0.0))
    most = (F.col("norm") + F.col("top") - apart * apart) / 2 + 1e-5 * F.sqrt(F.col("norm") * F.col("top")) + 0.5
    open_ = open_.filter((F.col("floor").isNull() | (most >= F.col("floor"))) & ~F.coalesce((F.col("own") == F.col("cell")) & (F.col("done") == F.col("block")), F.lit(False)))
    open_ = open_.select("id", "q", *key, "floor", F.pmod(F.xxhash64("id", "q"), F.lit(groups)).cast("int").alias("part"))
    going = open_.join(asks.select("id", "q", "v", "d"), ["id", "q"])
    if groups > 1:
        going = materialise(going, "pivot-going")
        sent = blocks.select("*", each).join(going.select(*key, "part").distinct(), [*key, "part"], "left_semi")
    else:
        sent = blocks.withColumn("part", F.lit(0))

    def rest(at, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        dims = int(at[0])
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "q": [], "vec_id": [], "score": []}, dtype=np.int64)
        floor = right["floor"].to_numpy(np.float64, na_value=-np.inf)
        who, ids, scores = search(block(right, dims), np.where(np.isnan(floor), -np.inf, floor), block(left, dims), k)
        return pd.DataFrame({"id": right["id"].to_numpy()[who], "q": right["q"].to_numpy()[who], "vec_id": ids, "score": scores})

    others = sent.groupBy(*key, "part").cogroup(going.groupBy(*key, "part")).applyInPandas(rest, "id long, q long, vec_id long, score long")
    ranked = Window.partitionBy("id", "q").orderBy(F.desc("score"), "vec_id")
    best = hits.unionByName(others).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return best.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
