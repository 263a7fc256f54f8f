"""Session helpers: UTC session settings and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "fieldspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times, ANSI arithmetic and adaptive execution; `conf` adds or overrides settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session time zone; every operator assumes UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder in `spark.checkpoint.dir`. Only a session in one process may do without
    that setting: it gets a temporary folder, which goes when the process ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="fieldspark-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that are about to be multiplied, dealt over as many tasks as a shuffle has (by `columns`, where given). Files and adaptive
    execution go by the size of what is read, so a short table whose rows give thousands each would stay in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """A result that several later steps need, written once to the shared folder and read back. It cuts the
    lineage, survives the loss of an executor, and gives the optimiser a size to plan joins with."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
