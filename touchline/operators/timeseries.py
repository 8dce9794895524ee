"""Team time series: wide and long matches, rolling Elo, as-of joins."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.session import shared_dir


def wide_to_long(matches: DataFrame) -> DataFrame:
    """One row a side: team, opponent, is_home and goals from that side's view. One pass, no shuffle."""
    side = lambda own, other, a, b, home: F.struct(F.col(own).alias("team"), F.col(other).alias("opponent"), F.lit(home).alias("is_home"), F.col(a).alias("team_goals"), F.col(b).alias("opponent_goals"))
    rest = [c for c in matches.columns if c not in ("home", "away", "hg", "ag")]
    return matches.select(*rest, F.inline(F.array(side("home", "away", "hg", "ag", True), side("away", "home", "ag", "hg", False))))


def long_to_wide(rows: DataFrame) -> DataFrame:
    """One row a match: the home row wins, else the first by team and opponent. Aggregated map-side before the shuffle."""
    order = F.struct((~F.col("is_home")).alias("away_row"), "team", "opponent")
    row = F.struct(order.alias("o"), F.struct("match_date", "comp_type", "neutral", F.col("team").alias("home"), F.col("opponent").alias("away"), F.col("team_goals").alias("hg"), F.col("opponent_goals").alias("ag")).alias("r"))
    return rows.groupBy("match_id").agg(F.min(row).alias("x")).select("match_id", "x.r.*")


#: matches of a round of rolling_elo(), about
SPAN = 400_000


@dataclass(frozen=True)
class EloConfig:
    start: float = 1500.0
    home_bonus: float = 35.0
    most: float = 35.0
    low: float = 900.0
    high: float = 2300.0
    #: one K factor for all matches, and how much each of the first four goals of the margin adds to it; None: K by competition, and
    #: the logarithm of the margin
    k: float | None = None
    margin: float = 0.08


#: the simpler rating of recent form
SIMPLE = EloConfig(start=1700.0, home_bonus=0.0, most=1e9, low=1200.0, high=2200.0, k=24.0)


def updated(h: float, a: float, hg: float, ag: float, neutral: bool, k: float, config: EloConfig) -> tuple[float, float]:
    """Both ratings after a match."""
    expected = 1 / (1 + 10 ** ((a - h - (0 if neutral else config.home_bonus)) / 400))
    score = 1.0 if hg > ag else 0.5 if hg == ag else 0.0
    factor = k * max(1.0, math.log(abs(hg - ag) + 1)) if config.k is None else config.k * (1 + min(abs(hg - ag), 4) * config.margin)
    step = max(-config.most, min(config.most, factor * (score - expected)))
    return min(config.high, max(config.low, h + step)), min(config.high, max(config.low, a - step))


def rolling_elo(matches: DataFrame, config: EloConfig = EloConfig(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Ratings of both teams before and after each match, in the order of date and match_id.

    A match changes two teams' state, so matches can't be dealt by team; they are dealt by connected component of who has played whom.
    A component's matches pass through one task in order, batch by batch; all that it holds is the map from team to rating. More than SPAN
    matches go in rounds of about so many, in order: a round's task sorts no more, and starts with the ratings that the round before it
    left, which lie in the shared folder as a row a team, as its output does. No goals: no row. Ratings round at the end only. ``keep``: columns
    of the matches that come along, so that nobody has to join them again.
    """
    scored = matches.where("hg is not null and ag is not null")
    # teams joined by any chain of opponents share a component; one league is the usual case
    rows = scored.select("match_id", "match_date", "home", "away", F.col("hg").cast("double").alias("hg"), F.col("ag").cast("double").alias("ag"), "neutral", C.k_factor(F.col("comp_type")).alias("k"), *([F.struct(*keep).alias("kept")] if keep else []))
    leagues, names = _leagues(rows), rows.columns
    rounds = max(1, -(-rows.count() // SPAN))

    def values(column: pa.Array) -> list:
        return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()

    also = ["kept"] if keep else []

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        league, ratings, kinds = None, {}, {}

        def left() -> pa.RecordBatch:
            none = lambda kind: pa.nulls(len(ratings), kind)
            return pa.record_batch({"league": pa.array([league] * len(ratings), pa.int64()), "match_id": none(pa.int64()), "match_date": none(pa.date32()), "home": pa.array(ratings, pa.int64()), "away": none(pa.int64()), "home_pre": none(pa.float64()), "away_pre": none(pa.float64()), "home_post": pa.array(ratings.values(), pa.float64()), "away_post": none(pa.float64())} | {c: none(kinds[c]) for c in also})

        for batch in batches:
            at, out, end, kinds = 0, [], [], {c: batch.column(c).type for c in also}
            for own, match, home, away, hg, ag, neutral, k in zip(*[values(batch.column(c)) for c in ("league", "match_id", "home", "away", "hg", "ag", "neutral", "k")], strict=True):
                if own != league:
                    if rounds > 1 and ratings:
                        end.append(left())
                    league, ratings = own, {}
                if match is None:  # what the round before left
                    ratings[home], at = hg, at + 1
                    out.append((None,) * 4)
                    continue
                h, a = ratings.get(home, config.start), ratings.get(away, config.start)
                ratings[home], ratings[away] = updated(h, a, hg, ag, neutral, k, config)
                out.append((h, a, ratings[home], ratings[away]))
            columns = zip(("home_pre", "away_pre", "home_post", "away_post"), zip(*out, strict=True) if out else [[]] * 4, strict=True)
            done = pa.record_batch({c: batch.column(c) for c in ("league", "match_id", "match_date", "home", "away")} | {c: pa.array(v, pa.float64()) for c, v in columns} | {c: batch.column(c) for c in also})
            yield done.filter(done.column("match_id").is_valid()) if at else done
            yield from end
        if rounds > 1 and ratings:
            yield left()

    schema = "match_id long, match_date date, home long, away long, home_pre double, away_pre double, home_post double, away_post double"
    schema += f", kept {rows.schema['kept'].dataType.simpleString()}" if keep else ""
    flat = lambda df: df.select("*", "kept.*").drop("kept") if keep else df
    rated = lambda df: df.repartition("league").sortWithinPartitions("league", "match_date", "match_id").mapInArrow(fold, f"league long, {schema}")
    if rounds == 1:
        return flat(rated(rows.join(leagues, "home").select("league", *names)).drop("league"))
    spark, at = matches.sparkSession, f"{shared_dir(matches.sparkSession)}/touchline/elo-{uuid.uuid4().hex}"
    dealt = rows.join(leagues, "home").select("league", *names).repartitionByRange(rounds, "match_date", "match_id").withColumn("round", F.spark_partition_id())
    dealt.write.partitionBy("round").parquet(f"{at}/matches")
    dealt = spark.read.schema(dealt.schema).parquet(f"{at}/matches")
    none, before = F.lit(None), None
    for i in range(rounds):
        own = dealt.where(F.col("round") == i).drop("round")
        if before is not None:  # null days come first
            own = own.unionByName(before.select("league", none.cast("long").alias("match_id"), none.cast("date").alias("match_date"), "home", none.cast("long").alias("away"), F.col("home_post").alias("hg"), none.cast("double").alias("ag"), none.cast("boolean").alias("neutral"), none.cast("double").alias("k"), *[none.cast(rows.schema[c].dataType).alias(c) for c in also]))
        rated(own).write.parquet(f"{at}/rated/round={i}")
        before = spark.read.schema(f"league long, {schema}").parquet(f"{at}/rated/round={i}").where("match_id is null")
    return flat(spark.read.schema(schema).parquet(*[f"{at}/rated/round={i}" for i in range(rounds)]).where("match_id is not null"))


def _leagues(rows: DataFrame, rounds: int = 100) -> DataFrame:
    """home -> league: the smallest team that chains of matches reach. Teams are few next to matches, and labels settle in a few rounds."""
    pairs = rows.select("home", "away").unionByName(rows.select(F.col("away").alias("home"), F.col("home").alias("away"))).distinct().persist()
    labels = pairs.groupBy("home").agg(F.least(F.min("away"), F.col("home")).alias("league")).persist()
    for _ in range(rounds):
        near = pairs.join(labels.select(F.col("home").alias("away"), "league"), "away").groupBy("home").agg(F.min("league").alias("near"))
        new = labels.join(near, "home").select("home", F.least("league", "near").alias("league")).persist()
        moved = new.join(labels.withColumnRenamed("league", "old"), "home").where("league <> old").limit(1).count()
        if not moved:
            return new
        labels = new
    raise RuntimeError(f"leagues did not settle in {rounds} rounds")


def elo_rows(elo: DataFrame) -> DataFrame:
    """rolling_elo() by side: team, opponent, ratings before and after, and the change, rounded to 3 places. If goals were kept, also is_home,
    team_goals and opponent_goals, and what else was kept."""
    sides = {"home": ("hg", "ag"), "away": ("ag", "hg")}
    goals = lambda o: [F.lit(o == "home").alias("is_home"), *[F.col(c).alias(n) for c, n in zip(sides[o], ("team_goals", "opponent_goals"), strict=True)]] if "hg" in elo.columns else []
    side = lambda o, p: F.struct(F.col(o).alias("team"), F.col(p).alias("opponent"), *goals(o), *[F.round(f"{x}_{w}", 3).alias(f"{n}_{w}") for x, n in ((o, "team"), (p, "opponent")) for w in ("pre", "post")], F.round(F.col(f"{o}_post") - F.col(f"{o}_pre"), 3).alias("elo_change"))
    rest = [c for c in elo.columns if c not in ("home", "away", "hg", "ag", *[f"{s}_{w}" for s in sides for w in ("pre", "post")])]
    return elo.select(*rest, F.inline(F.array(side("home", "away"), side("away", "home"))))


def asof_latest(rows: DataFrame, keys: DataFrame, value: str, by: str = "team", at: str = "as_of") -> DataFrame:
    """Of each key the ``value`` of its last row strictly before the key's date, and how many rows that are before it.

    Union and window: keys and the days of rows are sorted together once per ``by``, so the cost is linear, whatever the number of dates. A
    day's rows are one row before that: its last value and how many they are.
    """
    known = F.when(F.col(value).isNotNull(), F.col("match_id"))  # not a struct of both: only plain buffers are hashed, others sort all rows of a task
    daily = rows.groupBy(by, F.col("match_date").alias("d")).agg(F.max_by(value, known).alias("v"), F.count("*").alias("n_rows"))
    both = daily.withColumn("kind", F.lit(1)).unionByName(keys.select(by, F.col(at).alias("d"), F.lit(0).alias("kind"), F.lit(None).alias("v"), F.lit(0).cast("long").alias("n_rows")))
    earlier = Window.partitionBy(by).orderBy("d", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("value", F.last("v", ignorenulls=True).over(earlier)).withColumn("n", F.sum("n_rows").over(earlier)).withColumn("last_day", F.last(F.when(F.col("kind") == 1, F.col("d")), ignorenulls=True).over(earlier))
    return seen.where("kind = 0").select(by, F.col("d").alias(at), F.col("value").alias(value), F.col("n").alias("matches_used"), F.col("last_day").alias("latest_match"))


def newest_in_window(rows: DataFrame, reference: Column, years: int = 4, most: int = 40) -> DataFrame:
    """The newest ``most`` rows of each team within ``years`` calendar years up to and including the reference day."""
    inside = rows.where(F.col("match_date").between(F.add_months(reference, -12 * years), reference))
    order = Window.partitionBy("team").orderBy(F.col("match_date").desc(), F.col("match_id").desc())
    return inside.withColumn("newest", F.row_number().over(order)).where(F.col("newest") <= most)
