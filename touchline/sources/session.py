"""The session: Python workers must find this library."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver has it, if they are not told already."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session or its context names it; an error if neither does."""
    named, own = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc().getCheckpointDir()
    if not named and not own.isDefined():
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not own.isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return (named or own.get()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in the shared folder: what follows neither repeats its work nor depends on lost executors. Spark removes the files
    when the table is no longer used."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
