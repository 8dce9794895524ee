"""Tables that are replaced as a whole: each state is a version of its own, and a manifest that is written last tells which one counts.

A version's files are written under ``versions/<id>``, then ``manifest/<number>.json`` names it. Until that file is there, readers see the version
before; a crash at any step loses nothing and leaves at most files that no manifest names (vacuum() removes them). A table may be replaced
by what was read from it. All files go through Spark and the file system of the path, so any store that Spark writes to will do.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TooOld(Exception):
    """The table's last version is older than the reader accepts."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The last manifest that is whole: number, version, written_at (seconds), rows, source; None if there is no version yet."""
    for name in reversed(_names(spark, f"{path}/manifest")):
        text = spark.read.option("wholetext", True).text(f"{path}/manifest/{name}").first()
        try:
            return json.loads(text["value"]) | {"number": int(name.split(".")[0])}
        except (TypeError, ValueError):
            continue  # its writer was stopped halfway
    return None


def _announce(spark: SparkSession, path: str, number: int, told: dict) -> None:
    """Write a manifest that isn't there yet; an error if another writer was first."""
    fs, at = _fs(spark, f"{path}/manifest/{number:012d}.json")
    out = fs.create(at, False)
    out.write(bytearray(json.dumps(told).encode()))
    out.close()


def replace(df: DataFrame, path: str, source: str = "", now: float | None = None) -> dict:
    """Make ``df`` the table's content. Returns the manifest. If two writers come at once, one of them fails, and the other's version counts."""
    spark, path = df.sparkSession, path.rstrip("/")
    last = manifest(spark, path)
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/versions/{version}")
    rows = spark.read.schema(df.schema).parquet(f"{path}/versions/{version}").count()
    told = {"version": version, "written_at": time.time() if now is None else now, "rows": rows, "source": source, "schema": df.schema.json()}
    number = (last["number"] if last else 0) + 1
    _announce(spark, path, number, told)
    return told | {"number": number}


def read(spark: SparkSession, path: str, most_hours: float | None = None, now: float | None = None) -> DataFrame:
    """The last version. TooOld if it is older than ``most_hours``; FileNotFoundError if there is none."""
    from pyspark.sql.types import StructType

    path = path.rstrip("/")
    last = manifest(spark, path)
    if last is None:
        raise FileNotFoundError(path)
    hours = ((time.time() if now is None else now) - last["written_at"]) / 3600
    if most_hours is not None and hours > most_hours:
        raise TooOld(f"{path}: {hours:.1f} hours")
    return spark.read.schema(StructType.fromJson(json.loads(last["schema"]))).parquet(f"{path}/versions/{last['version']}")


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove all but the last ``keep`` versions, and what no manifest names. Not while a writer is at work. Returns how many were removed."""
    path = path.rstrip("/")
    names, kept = _names(spark, f"{path}/manifest"), set()
    for name in reversed(names):
        text = spark.read.option("wholetext", True).text(f"{path}/manifest/{name}").first()
        try:
            version = json.loads(text["value"])["version"]
        except (TypeError, ValueError):
            version = None
        if version and len(kept) < keep:
            kept.add(version)
        else:
            fs, at = _fs(spark, f"{path}/manifest/{name}")
            fs.delete(at, False)
    gone = [v for v in _names(spark, f"{path}/versions") if v not in kept]
    for v in gone:
        fs, at = _fs(spark, f"{path}/versions/{v}")
        fs.delete(at, True)
    return len(gone)


def cached(spark: SparkSession, path: str, load: Callable[[], DataFrame], most_hours: float, source: str = "", now: float | None = None) -> DataFrame:
    """The table if it is fresh enough, else what ``load`` gives, which becomes the table. If ``load`` fails or has no rows, the old version counts, however
    old. Adds source_label and warning."""
    told = lambda df, label, warning="": df.withColumns({"source_label": F.lit(label), "warning": F.lit(warning)})
    try:
        return told(read(spark, path, most_hours, now), "cache")
    except (TooOld, FileNotFoundError) as stale:
        why = stale
    try:
        df = load()
        if df.isEmpty():
            raise ValueError("no rows")
        replace(df, path, source, now)
        return told(read(spark, path), source or "source")
    except Exception as e:
        if isinstance(why, FileNotFoundError):
            raise
        return told(read(spark, path), "cache", f"{type(e).__name__}: older version used")
