"""Rolling Elo as a stream: ratings are state, kept by league and team, so a restart goes on where it stopped."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import columns as C
from ..operators.timeseries import EloConfig, updated

#: setting of a session whose streams keep maps as state
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SCHEMA = "match_id long, match_date date, home long, away long, home_pre double, away_pre double, home_post double, away_post double, late boolean"


#: a match as a worker keeps it, rows that it sorts at a time, and rows that it rates at a time
RECORD = np.dtype([("day", "i4"), ("match_id", "i8"), ("home", "i8"), ("away", "i8"), ("hg", "f8"), ("ag", "f8"), ("k", "f8"), ("neutral", "?")])
RUN, PART = 1_000_000, 10_000
EPOCH = date(1970, 1, 1)


def _records(rows: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(rows), RECORD)
    out["day"] = pd.to_datetime(rows["match_date"]).to_numpy().astype("datetime64[D]").astype("i8")
    for c in RECORD.names[1:]:
        out[c] = rows[c].to_numpy()
    return out


def in_order(rows: Iterator[pd.DataFrame], run: int | None = None, part: int | None = None) -> Iterator[np.ndarray]:
    """Matches in the order of day and id, in pieces of ``part``, in bounded memory: sorted runs of about ``run`` rows lie in temporary files of the worker, and
    pieces of them are merged, so that neither the length of a trigger nor that of a day counts."""
    run, part = run or RUN, part or PART
    sort = lambda x: x[np.lexsort((x["match_id"], x["day"]))]
    files, held, n = [], [], 0
    try:
        for batch in rows:
            held.append(_records(batch))
            n += len(batch)
            if n >= run:
                files.append(tempfile.TemporaryFile())
                sort(np.concatenate(held)).tofile(files[-1])
                files[-1].seek(0)
                held, n = [], 0
        if held:
            files.append(tempfile.TemporaryFile())
            sort(np.concatenate(held)).tofile(files[-1])
            files[-1].seek(0)
            held = []
        fronts = [np.fromfile(f, RECORD, part) for f in files]
        while any(len(x) for x in fronts):
            # what no row still unread can come before: up to the least last row of the fronts
            until = min((x["day"][-1], x["match_id"][-1]) for x in fronts if len(x))
            ready = []
            for i, x in enumerate(fronts):
                upto = int(np.count_nonzero((x["day"] < until[0]) | ((x["day"] == until[0]) & (x["match_id"] <= until[1]))))
                ready.append(x[:upto])
                fronts[i] = x[upto:] if upto < len(x) else np.fromfile(files[i], RECORD, part)
            yield sort(np.concatenate(ready))
    finally:
        for f in files:
            f.close()


class Ratings(StatefulProcessor):
    """One league's matches of a trigger, in the order of day and id. The state is a rating for each team and the place of the last match; a match
    that comes after a later one has been rated is given out as late, without ratings."""

    def __init__(self, config: EloConfig = EloConfig()):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ratings = handle.getMapState("ratings", "team long", "elo double")
        self.last = handle.getValueState("last", "match_date date, match_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        known = {}
        last = tuple(self.last.get()) if self.last.exists() else None

        def rating(team: int) -> float:
            if team not in known:
                known[team] = self.ratings.getValue((team,))[0] if self.ratings.containsKey((team,)) else self.config.start
            return known[team]

        for part in in_order(rows):
            out = []
            for day, match, home, away, hg, ag, k, neutral in part.tolist():
                day = EPOCH + timedelta(day)
                if last is not None and (day, match) <= last:
                    out.append((match, day, home, away, None, None, None, None, True))
                    continue
                h, a = rating(home), rating(away)
                known[home], known[away] = updated(h, a, hg, ag, neutral, k, self.config)
                out.append((match, day, home, away, h, a, known[home], known[away], False))
                last = (day, match)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({c: "float64" for c in ("home_pre", "away_pre", "home_post", "away_post")})
        for team, elo in known.items():
            self.ratings.updateValue((int(team),), (float(elo),))
        if last is not None:
            self.last.update(last)

    def close(self) -> None:
        pass


def elo_stream(matches: DataFrame, config: EloConfig = EloConfig()) -> DataFrame:
    """rolling_elo() of a stream of matches with a league column (a stream can't tell who will ever play whom): ratings before and after each match that
    has goals, and whether it came late. A trigger's matches of a league come to one task, so bound a trigger at the source. The session of
    ``matches`` must name the state store STORE; nothing is set here, as other streams of it may use another."""
    rows = matches.where("hg is not null and ag is not null").select("league", "match_id", "match_date", "home", "away", F.col("hg").cast("double").alias("hg"), F.col("ag").cast("double").alias("ag"), "neutral", C.k_factor(F.col("comp_type")).alias("k"))
    return rows.groupBy("league").transformWithStateInPandas(Ratings(config), SCHEMA, "append", "none")
