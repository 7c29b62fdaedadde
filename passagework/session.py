"""Session settings, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "passagework", cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings the queries are written for; on a cluster
    the submitter's settings hold and this function isn't used."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """Partitions a shuffle of this session has before adaptive coalescing."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df in at least as many partitions as a shuffle has: a few input files must not leave cores idle in a Python-bound
    scan. Input that is split finely enough already isn't shuffled."""
    n = parallelism(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, F.xxhash64(*keys))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there.

    The folder is the session's ``spark.checkpoint.dir``; only a local session where that is unset
    (tests, notebooks) takes a folder of this machine, which goes when Python ends. A cluster without the setting is an error,
    since its executors don't share such a folder.
    """
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_checkpoints(spark: SparkSession) -> str:
    """The session's checkpoint folder; sets it if need be."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="passagework-checkpoint-", dir=os.environ.get("TMPDIR"))
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def salted_lookup(left: DataFrame, right: DataFrame, key: str, row_id: str, salts: int = 16) -> DataFrame:
    """left LEFT JOIN right on ``key`` where ``right`` has one row per key.

    Every key of ``right`` is repeated ``salts`` times and every row of ``left`` picks one
    of the copies by its row id, so a key that holds a third of ``left`` is spread over
    ``salts`` tasks. Null keys match nothing; they are spread as well.
    """
    spread = left.withColumn("__salt", F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int"))
    copies = right.where(F.col(key).isNotNull()).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [key, "__salt"], "left").drop("__salt")


def spread_lookup(left: DataFrame, right: DataFrame, key: str, row_id: str, counted: DataFrame | None = None, hot: int = 64, salts: int = 32) -> DataFrame:
    """left LEFT JOIN right on ``key``, where ``right`` has one row per key and a few keys may hold much of ``left``.

    The ``hot`` most frequent keys (so a list of fixed length) are salted: their rows are spread by row id over ``salts``
    copies of their row of ``right``. All other keys are joined as they are, so nothing else is copied. Null keys match
    nothing and are spread too. ``counted``: rows with the same keys, if ``left`` itself is costly to go over twice.
    """
    counts = (left if counted is None else counted).where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1000")
    listed = [r[key] for r in counts.orderBy(F.desc("count"), key).limit(hot).collect()]
    often = F.col(key).isin(listed) if listed else F.lit(False)
    salt = F.when(often | F.col(key).isNull(), F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int")).otherwise(0)
    copies = right.where(F.col(key).isNotNull()).withColumn("__salt", F.explode(F.when(often, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.withColumn("__salt", salt).join(copies, [key, "__salt"], "left").drop("__salt")
