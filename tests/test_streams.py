"""Streams in several triggers, with a restart between, against batch results."""

import datetime

from pyspark.sql import functions as F

from touchline.operators.timeseries import rolling_elo
from touchline.plans.base import Tables
from touchline.streaming import ledger as L
from touchline.streaming.ratings import STORE, elo_stream

FOLDER = "/root/testdata/sf0.001"


def test_elo_state_survives_a_restart(spark, tmp_path):
    matches = Tables(spark, FOLDER).match.withColumn("league", F.lit(0)).orderBy("match_date", "match_id").limit(240)
    rows = matches.collect()
    frame = lambda part: spark.createDataFrame(part, matches.schema).coalesce(1)
    source, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    frame(rows[:60]).write.parquet(source)
    session = spark.newSession()
    session.conf.set(*STORE)
    run = lambda: L.run_once(elo_stream(session.readStream.schema(matches.schema).option("maxFilesPerTrigger", 1).parquet(source)), out, ckpt)
    run()
    assert spark.read.parquet(out).count() == 60
    for a, b in ((60, 150), (150, 239)):
        frame(rows[a:b]).write.mode("append").parquet(source)
    run()  # two triggers from where the first run stopped
    late = rows[10].asDict() | {"match_id": 10**9, "match_date": rows[10].match_date}
    frame([rows[239], type(rows[0])(**late)]).write.mode("append").parquet(source)
    run()
    got = {r.match_id: r for r in spark.read.parquet(out).collect()}
    assert got.pop(10**9).late and len(got) == 240
    for r in rolling_elo(matches).collect():
        x = got[r.match_id]
        assert not x.late and all(abs(x[c] - r[c]) < 1e-9 for c in ("home_pre", "away_pre", "home_post", "away_post"))


def test_late_and_missing_results(spark, tmp_path):
    """A snapshot without a result in time comes out with nulls once the watermark has passed, over a restart."""
    t = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    p, r, out, ckpt = (str(tmp_path / n) for n in ("p", "r", "out", "ckpt"))
    predictions = lambda rows: spark.createDataFrame(rows, "match_id long, kickoff_utc timestamp").coalesce(1).write.mode("append").parquet(p)
    results = lambda rows: spark.createDataFrame(rows, "match_id long, result_utc timestamp, hg long, ag long").coalesce(1).write.mode("append").parquet(r)
    predictions([(1, t(0)), (2, t(0)), (3, t(1)), (4, t(2))])
    results([(1, t(5), 1, 0), (2, t(3), 2, 2), (3, t(80), 0, 0)])  # in time, too early, too late

    def run():
        a = spark.readStream.schema("match_id long, kickoff_utc timestamp").parquet(p)
        b = spark.readStream.schema("match_id long, result_utc timestamp, hg long, ag long").parquet(r)
        L.run_once(L.with_results(a, b, how="left_outer"), out, ckpt)

    run()
    got = lambda: {x.match_id: x.hg for x in spark.read.parquet(out).collect()}
    assert got() == {1: 1}
    predictions([(9, t(400))])
    results([(9, t(410), 3, 1), (4, t(70), 5, 5)])
    run()
    predictions([(10, t(900))])
    results([(10, t(900), 0, 0)])
    run()
    assert got() == {1: 1, 2: None, 3: None, 4: 5, 9: 3}
