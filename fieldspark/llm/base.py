"""Shared by the operators: white space, words, letters, and code for Python workers."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as the contracts state it.
SPACE = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For bytes.translate and str.translate: A-Z only.
LOWER_STR = str.maketrans(UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def ship(spark: SparkSession) -> None:
    """Let the Python workers of a local session import this package, wherever the session was started. On a
    cluster the package is installed or passed with --py-files."""
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        spark.sparkContext.addFile(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), recursive=True)


#: Spark's limit to an Arrow batch, and what texts are handed over by: a batch stands in the JVM and in the worker, on its way in and out.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at BATCH_BYTES, unless the session states a limit of its own. Ten thousand texts, Spark's other limit, are 20 MB
    and more, and neither the JVM nor the worker gives back all that such batches took. It is read when a frame runs, so it stays set."""
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def plain_names(df: DataFrame) -> DataFrame:
    """The frame with doc_id and text as they are and c0, c1, ... for all other columns, which so clash with nothing; `named`
    gives them their names again."""
    return df.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(df.columns)])


def named(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of `plain_names(...)` under their own names, in their order."""
    return df.select(*[F.col(c if c in ("doc_id", "text") else f"c{i}").alias(c) for i, c in enumerate(columns)])


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """Arrow batches through the function that `make` builds once in each task."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)

    def run(batches):
        step = make()
        for batch in batches:
            yield from step(batch)

    return df.mapInArrow(run, schema)
