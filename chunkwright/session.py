"""Session construction and the one place that decides where checkpoints go."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "chunkwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes: UTC, AQE with skew handling, Arrow transfer."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Makes ``DataFrame.checkpoint`` usable.

    The folder named in ``spark.checkpoint.dir`` is used wherever that is set. A local
    session without it gets a temporary folder; a cluster session without it is an error,
    since a folder on one machine wouldn't outlive that machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="chunkwright-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
