"""A blocked Bloom filter as a table: one row per block of 256 bits, four longs. A key sets bits of one block only, so
testing it is one look-up by block. Its size is fixed beforehand, so it may be broadcast whatever the keys are; when they
are more than it can hold it lets more pass, and never fewer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 65,536 blocks are 2 MB of bits and room for about a million keys.
BLOCKS = 1 << 16
BITS = 6
WORDS = 4


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks)).cast("int")


def _masks(h: Column) -> list[Column]:
    """The four words with this key's bits: each bit's place among 256 comes from eight bits of a second hash."""
    second = F.xxhash64(h, F.lit(7))
    places = [F.shiftrightunsigned(second, 8 * k).bitwiseAND(F.lit(255)).cast("int") for k in range(BITS)]
    out = []
    for w in range(WORDS):
        mask = F.lit(0).cast("long")
        for p in places:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(64)))
            mask = mask.bitwiseOR(F.when(F.shiftright(p, 6) == w, bit).otherwise(F.lit(0).cast("long")))
        out.append(mask)
    return out


def build(keys: DataFrame, *columns: str, blocks: int = BLOCKS) -> DataFrame:
    """(block, w0..w3) of the keys in `columns`; one row per block in use. Bits are combined before the shuffle."""
    h = keys.select(F.xxhash64(*columns).alias("_h"))
    marked = h.select(_block(F.col("_h"), blocks).alias("_block"), *[m.alias(f"_w{i}") for i, m in enumerate(_masks(F.col("_h")))])
    return marked.groupBy("_block").agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS)])


def flagged(rows: DataFrame, filled: DataFrame, *columns: str, blocks: int = BLOCKS) -> DataFrame:
    """The rows and _maybe: false only where the key is certainly not in the filter, or null."""
    own = rows.columns
    probe = rows.withColumn("_h", F.xxhash64(*columns)).withColumn("_block", _block(F.col("_h"), blocks))
    met = probe.join(F.broadcast(filled), "_block", "left")
    hit = F.lit(True)
    for name in columns:
        hit = hit & F.col(name).isNotNull()
    for i, m in enumerate(_masks(F.col("_h"))):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(m) == m)
    return met.select(*own, F.coalesce(hit, F.lit(False)).alias("_maybe"))
