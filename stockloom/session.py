"""Session defaults and the one place that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "stockloom", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("STOCKLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        # no call-site capture per column expression: halves the time to build wide plans
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir, or a scratch one in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="stockloom-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a frame that several branches read, surviving executor loss.

    Used where one reduced frame feeds more than one aggregate, so the sales
    scan behind it runs once.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, *keys) -> DataFrame:
    """Rows dealt out by keys, to as many tasks as a shuffle has at most.

    The number is given, so Spark does not join small pieces again: for rows that become many, or that several
    sorts and sums hold in memory, within the task that gets them. Sums and windows over these keys need no further exchange.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A folder name under the shared one that no other run uses."""
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
