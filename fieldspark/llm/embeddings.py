"""Near-duplicates among embeddings: signs against random hyperplanes, in several tables, say which vectors are compared;
their exact cosine decides; links make components.

Vectors that are equal in every component are one class, which meets others once. A bucket of a table is compared in
blocks of rows, each pair of blocks by one task, so a bucket that holds a third of all rows is spread out. A pair is
counted in the first table in which its vectors meet; within a block pair, links go out as counts and as one edge for each
vector to its group's smallest, never as pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.base import ship
from fieldspark.llm.components import components, reach
from fieldspark.session import materialise

#: Rows of a block, and of a bucket on average.
BLOCK, SPREAD = 1024, 128
SEED = 20_240_607


def planes(dims: int, tables: int, bits: int) -> np.ndarray:
    """(tables * bits, dims) normal vectors, the same wherever they are made."""
    return np.random.default_rng(SEED + dims).standard_normal((tables * bits, dims))


def codes(unit: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """(rows, tables) of `bits` signs each as an integer."""
    signs = unit @ planes(unit.shape[1], tables, bits).T > 0
    return signs.reshape(len(unit), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def table_bits(classes: int) -> int:
    """Bits of a table: about SPREAD vectors for each bucket were they spread evenly, from 8 to 24."""
    return int(min(24, max(8, np.ceil(np.log2(max(1, classes) / SPREAD)))))


def table_count(bits: int, cosine: float, recall: float) -> int:
    """Tables in which a pair at the threshold meets at least once with probability `recall`."""
    meet = (1 - np.arccos(cosine) / np.pi) ** bits
    return int(np.ceil(np.log(1 - recall) / np.log1p(-meet)))


def compare(left: tuple, right: tuple | None, at: int, cosine: float):
    """(ids, links, roots) of the rows that have a link: left and right are (ids, vectors, codes, copies); right is None
    for a block with itself. Links count each other class by its copies."""
    ids, v, code, copies = left
    if right is None:
        hit = np.triu(v @ v.T >= cosine, 1)
        a, b = np.nonzero(hit)
    else:
        a, b = np.nonzero(v @ right[1].T >= cosine)
        b = b + len(ids)
        ids, code, copies = np.concatenate([ids, right[0]]), np.concatenate([code, right[2]]), np.concatenate([copies, right[3]])
    if at and len(a):
        new = (code[a, :at] != code[b, :at]).all(1)
        a, b = a[new], b[new]
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    order = np.argsort(ids, kind="stable")  # so that the smallest row is the smallest id
    place = np.empty_like(order)
    place[order] = np.arange(len(ids))
    root = ids[order[reach(len(ids), place[a], place[b])[place]]]
    some = links > 0
    return ids[some], links[some], root[some]


def usable() -> Column:
    """Vectors with a direction: not null or empty, all components finite, not all zero."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.9999, block: int = BLOCK) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding): n_links (other rows linked directly), component_id (smallest vec_id
    reachable) and kept (vec_id = component_id). Two link when their cosine in double precision is at least `cosine`;
    a pair at the threshold is found with probability `recall`, closer ones more surely. Unusable vectors, and vectors of
    different lengths, don't link. Rows that share a vec_id count as one node of components; a null vec_id has no links and a
    null component. Other columns are ignored."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select("vec_id", "embedding", (usable() & F.col("vec_id").isNotNull()).alias("ok"))
    good = rows.filter("ok").withColumn("key", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)))
    classes = materialise(good.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    bits = table_bits(classes.count())
    tables = table_count(bits, cosine, recall)

    def unit(keys) -> np.ndarray:
        v = np.array(keys, np.float64)
        v = v / np.abs(v).max(1, keepdims=True)
        return v / np.sqrt((v * v).sum(1, keepdims=True))

    def hash_rows(batches):
        for batch in batches:
            rep, copies, key = (batch.column(c).to_pylist() for c in ("rep", "copies", "key"))
            for dims in sorted({len(x) for x in key}):
                own = [i for i, x in enumerate(key) if len(x) == dims]
                u = unit([key[i] for i in own])
                c = codes(u, tables, bits)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([rep[i] for i in own], pa.int64()),
                        pa.array([copies[i] for i in own], pa.int64()),
                        pa.array([dims] * len(own), pa.int32()),
                        pa.array([x.tobytes() for x in u], pa.binary()),
                        pa.array(list(c), pa.list_(pa.int64())),
                    ],
                    ["rep", "copies", "dims", "unit", "codes"],
                )

    hashes = classes.select("rep", "copies", "key").mapInArrow(hash_rows, "rep long, copies long, dims int, unit binary, codes array<long>")
    hashes = materialise(hashes, "hashes")
    placed = hashes.select("rep", "dims", F.posexplode("codes").alias("at", "code"))
    # How many blocks each bucket takes; a row's block is its hash's. Buckets of one row have no pairs.
    sizes = placed.groupBy("dims", "at", "code").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    placed = placed.join(sizes, ["dims", "at", "code"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # A row goes to each pair of blocks that has its own: (own, j) for j >= own and (i, own) for i < own.
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    sent = placed.withColumn("j", F.explode(other)).select(
        "rep", "at", "code", "dims", "own", F.least("own", "j").alias("i"), F.greatest("own", "j").alias("j")
    )
    sent = sent.join(hashes.select("rep", "dims", "copies", "unit", "codes"), ["rep", "dims"])

    def meet(key, pdf):
        import pandas as pd

        at, i, j = key[1], key[3], key[4]
        pdf = pdf.sort_values("rep")
        parts = []
        for k in (i, j) if i != j else (i,):
            p = pdf[pdf["own"] == k]
            v = np.frombuffer(b"".join(p["unit"]), np.float64).reshape(len(p), key[0]) if len(p) else np.zeros((0, key[0]))
            parts.append((p["rep"].to_numpy(np.int64), v, np.array(p["codes"].tolist(), np.int64).reshape(len(p), tables), p["copies"].to_numpy(np.int64)))
        ids, links, roots = compare(parts[0], parts[1] if i != j else None, at, cosine)
        return pd.DataFrame({"id": ids, "links": links, "root": roots})

    met = sent.groupBy("dims", "at", "code", "i", "j").applyInPandas(meet, "id long, links long, root long")
    met = materialise(met, "met")
    others = met.groupBy("id").agg(F.sum("links").alias("others"))
    found = components(met.select(F.col("id").alias("a"), F.col("root").alias("b")).filter("a <> b").distinct())
    # From classes back to rows, by the vector itself.
    known = classes.join(others, classes.rep == others.id, "left").drop("id").join(found, classes.rep == found.id, "left").drop("id")
    known = known.select("key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    matched = good.select("vec_id", "key").join(known, "key").select("vec_id", "n_links", "component_id")
    rest = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return matched.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
