"""Versioned tables: a crash between any two steps loses nothing, too old versions are rejected."""

import pytest
from pyspark.sql import functions as F

from touchline.sources import snapshots as S


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_crash_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        S.read(spark, path)
    S.replace(spark.range(3), path, now=0)
    S.replace(S.read(spark, path).where("id > 0"), path, now=3600)  # from what it reads itself
    assert ids(S.read(spark, path)) == [1, 2]
    # stopped after the files, before the manifest
    with monkeypatch.context() as m:
        m.setattr(S, "_announce", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            S.replace(spark.range(10), path)
    assert ids(S.read(spark, path)) == [1, 2]
    # stopped within the files
    with pytest.raises(Exception):
        S.replace(spark.range(5).withColumn("x", F.raise_error(F.lit("broken"))), path)
    assert ids(S.read(spark, path)) == [1, 2]
    # stopped within the manifest
    fs, at = S._fs(spark, f"{path}/manifest/{3:012d}.json")
    fs.create(at, False).close()
    assert ids(S.read(spark, path)) == [1, 2] and S.manifest(spark, path)["rows"] == 2
    assert S.vacuum(spark, path) >= 2 and ids(S.read(spark, path)) == [1, 2]
    S.replace(spark.range(7, 9), path)
    assert ids(S.read(spark, path)) == [7, 8]


def test_the_second_of_two_writers_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    S.replace(spark.range(2), path)
    seen = S.manifest(spark, path)
    S.replace(spark.range(3), path)
    monkeypatch.setattr(S, "manifest", lambda *a: seen)  # it looked before the other one wrote
    with pytest.raises(Exception):
        S.replace(spark.range(4), path)
    monkeypatch.undo()
    assert ids(S.read(spark, path)) == [0, 1, 2]


def test_cache(spark, tmp_path):
    path, calls = str(tmp_path / "c"), []

    def load(n):
        calls.append(n)
        return spark.range(n)

    get = lambda n, hour: S.cached(spark, path, lambda: load(n), 2, "feed", now=hour * 3600)
    assert get(3, 0).first().source_label == "feed" and get(4, 1.9).count() == 3 and calls == [3]
    with pytest.raises(S.TooOld):
        S.read(spark, path, 2, now=2.1 * 3600)
    assert get(4, 2.1).count() == 4 and calls == [3, 4]
    row = get(0, 9).first()
    assert row.source_label == "cache" and "older" in row.warning
