"""Session, shared scratch space and lineage cuts."""

from __future__ import annotations

import gc
import tempfile
import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def session(app: str = "fieldspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise on reliable storage and forget the lineage; survives lost executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of finished rounds.

    It does so when the JVM collects the plans that own them, which a driver with a roomy heap may not do for hours.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def listing(spark: SparkSession, tasks_a_core: int = 4) -> Iterator[None]:
    """Folders are listed in a few tasks a core; Spark's default is a task for each of up to 10,000 folders."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(tasks_a_core * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def literal_map(values: dict) -> Column:
    """A fixed lookup as a map literal (no join)."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def sorted_side(df: DataFrame) -> DataFrame:
    """A side that is joined by sort and merge.

    Compressed files say little about the rows that come out of them, and a side taken for small is broadcast through the driver.
    """
    return df.hint("merge")


def join_salted(big: DataFrame, side: DataFrame, keys: list[str], row_key: list[str], salts: int = 16,
                how: str = "left") -> DataFrame:
    """Equi-join of a table whose keys may be hot with a table holding few rows per key.

    The small side is repeated once per salt, so a key with a third of all rows spreads over
    ``salts`` tasks. The salt is derived from ``row_key`` and is the same on every re-run.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*row_key), F.lit(salts)).cast("int"))
    right = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, keys + ["_salt"], how).drop("_salt")
