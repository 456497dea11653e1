"""Session helpers: worker path, checkpoint folder, key-safe ranking."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROOT = str(Path(__file__).resolve().parent.parent)


def build_session(app: str = "folioscope", cores: int | str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where driver and executors
    share the file system; elsewhere pass it with ``--py-files``. Gives the
    session a checkpoint folder if it has none."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder named by ``spark.checkpoint.dir``. Only where the
    setting is missing and the master runs in this process (tests, bench) a
    local folder is made; on a cluster the missing setting is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local[") or context.master == "local":
        context.setCheckpointDir(tempfile.mkdtemp(prefix="folioscope-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the checkpoint folder, so that a lost executor costs no
    recomputation of what came before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def even_rank(df: DataFrame, key: str, order: list[str], name: str, buckets: int | None = None) -> DataFrame:
    """Adds ``name``: a rank from 0 without gaps within each ``key``, the same
    on every run, for keys of which one may hold most of the rows.

    A window over ``key`` alone would put a hot key into one task. Here the
    rows of a key go to hash buckets of their ``order`` columns; a small table
    (keys x buckets) of counts gives each bucket its start, and the window
    runs within (key, bucket). Rows are ordered by bucket, then by ``order``,
    which must tell the rows of a key apart. Null keys form a key of their own.
    """
    buckets = buckets or 4 * shuffle_width(df.sparkSession)
    salted = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = salted.groupBy(key, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(key).alias("__key"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    inside = Window.partitionBy(key, "__bucket").orderBy(*order)
    ranked = salted.withColumn("__r", F.row_number().over(inside) - 1)
    joined = ranked.join(starts, ranked[key].eqNullSafe(starts["__key"]) & (ranked["__bucket"] == starts["__b"]))
    return joined.withColumn(name, (F.col("__start") + F.col("__r")).cast("long")).drop("__bucket", "__b", "__key", "__start", "__r")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, key: str, by: str, columns: list[str] | None = None) -> DataFrame:
    """One row per ``key``: the one delivered last; a tie takes the greatest
    row. Null keys count as one key. Only ``columns`` (all by default) are read
    and moved; name the ones that are needed."""
    kept = columns or df.columns
    rows = df.groupBy(key).agg(F.max_by(F.struct(*kept), F.struct(by, F.xxhash64(*kept))).alias("__row"))
    return rows.select("__row.*")
