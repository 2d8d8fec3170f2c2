"""The session this library is written for, and results that are kept across jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with ANSI mode, UTC and adaptive execution; ``conf`` adds settings (dots as double underscores)."""
    b = SparkSession.builder.appName("pdmspark")
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that the driver and all executors share; only local mode may leave it unset."""
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not folder and not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or "/tmp/checkpoints").rstrip("/")


def stable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder that all executors share."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
