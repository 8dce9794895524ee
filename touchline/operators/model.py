"""Match model: expected goals, truncated Poisson scorelines, market probabilities, and edges on decimal odds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

MOST_GOALS = 7


@dataclass(frozen=True)
class ModelConfig:
    elo_weight: float = 0.0032
    attack_weight: float = 0.55
    defense_weight: float = 0.45
    form_weight: float = 0.20
    environment_weight: float = 0.010
    gap_scale: float = 1.0
    multiplier: float = 1.0


def with_ratings(matches: DataFrame, ratings: DataFrame) -> DataFrame:
    """Both sides' ratings; unknown teams get neutral ones. The table has one row a team, so Spark broadcasts it while it is small."""
    neutral = {"elo": 1700.0, "attack": 0.55, "defense": 0.55, "form": 0.55}
    for side in ("home", "away"):
        own = ratings.select(F.col("team").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in neutral])
        matches = matches.join(own, side, "left").withColumns({f"{side}_{c}": F.coalesce(f"{side}_{c}", F.lit(v)) for c, v in neutral.items()})
    return matches


def environment_penalty(temp: Column, humidity: Column, altitude: Column, roof: Column, home_temp: Column, home_humidity: Column, weight: float = 0.010) -> Column:
    """A team's log-goal adjustment for heat, humidity and altitude; a closed roof leaves 15 % of the weather."""
    share = F.when(roof, 0.15).otherwise(1.0)
    heat = F.greatest(temp - 28, F.lit(0.0)) * 0.35
    humid = F.greatest(humidity - 70, F.lit(0.0)) / 10 * F.greatest(temp - 25, F.lit(0.0)) * 0.08
    gaps = F.lit(0.45) * F.abs(temp - home_temp) + F.lit(0.18) * F.abs(humidity - home_humidity) / 10
    thin = F.when(altitude > 1200, F.lit(-0.000025) * (altitude - 1200)).otherwise(0.0)
    return C.clamp(F.lit(-weight) * share * (gaps + heat + humid) + thin, -0.14, 0.04)


def weather_drag(temp: Column, wind: Column, rain: Column, altitude: Column, roof: Column, weight: float = 0.010) -> Column:
    """The log adjustment of all goals in a match."""
    share = F.when(roof, 0.15).otherwise(1.0)
    pull = F.greatest(wind - 12, F.lit(0.0)) * 0.55 + F.greatest(rain, F.lit(0.0)) * 0.80 + F.greatest(temp - 30, F.lit(0.0)) * 0.35
    return C.clamp(F.lit(-weight) * share * pull + F.when(altitude > 1200, F.lit(-0.000025) * (altitude - 1200)).otherwise(0.0), -0.16, 0.04)


def expected_goals(rated: DataFrame, config: ModelConfig = ModelConfig(), home_env: Column | None = None, away_env: Column | None = None, drag: Column | None = None) -> DataFrame:
    """home_xg and away_xg, with the steps rating -> form -> environment that lead there."""
    zero = F.lit(0.0)
    diff = F.col("home_elo") - F.col("away_elo")
    rating = lambda own, other, sign: F.lit(sign * config.elo_weight * config.gap_scale) * diff + config.attack_weight * (F.col(f"{own}_attack") - 0.6) - config.defense_weight * (F.col(f"{other}_defense") - 0.6)
    form = lambda own: config.form_weight * (F.col(f"{own}_form") - 0.6)
    home, away = rating("home", "away", 1), rating("away", "home", -1)
    total = F.exp(drag if drag is not None else zero) * config.multiplier
    final = lambda x, env: C.clamp(F.exp(x + (env if env is not None else zero)) * total, 0.15, 3.80)
    return rated.withColumns(
        {
            "elo_diff": diff,
            "home_rating_xg": F.exp(home),
            "away_rating_xg": F.exp(away),
            "home_form_xg": F.exp(home + form("home")),
            "away_form_xg": F.exp(away + form("away")),
            "home_xg": final(home + form("home"), home_env),
            "away_xg": final(away + form("away"), away_env),
        }
    )


def score_matrix(xg: DataFrame, keys: list[str]) -> DataFrame:
    """h, a, prob for 0 to 7 goals a side, scaled to sum to 1. ``xg``: one row for each combination of ``keys``.

    64 rows an input row: pass distinct pairings, not matches, and join back.
    """
    side = lambda x: F.transform(F.sequence(F.lit(0), F.lit(MOST_GOALS)), lambda k: C.poisson_pmf(k, F.col(x)))
    rows = xg.select(*keys, side("home_xg").alias("hp"), side("away_xg").alias("ap"))
    covered = F.aggregate("hp", F.lit(0.0), lambda s, x: s + x) * F.aggregate("ap", F.lit(0.0), lambda s, x: s + x)
    rows = rows.select(*keys, covered.alias("covered"), "ap", F.posexplode("hp").alias("h", "p"))
    rows = rows.select(*keys, "covered", "h", "p", F.posexplode("ap").alias("a", "q"))
    return rows.select(*keys, "h", "a", (F.col("p") * F.col("q") / F.col("covered")).alias("prob"))


#: fixed values: probability, market, selection and the scorelines that it is made of
MARKETS = [
    ("home_win", "1X2", "Home", "h > a"),
    ("draw", "1X2", "Draw", "h = a"),
    ("away_win", "1X2", "Away", "h < a"),
    ("over_2_5", "Total", "Over 2.5", "h + a >= 3"),
    ("under_2_5", "Total", "Under 2.5", "h + a <= 2"),
    ("over_3_5", "Total", "Over 3.5", "h + a >= 4"),
    ("under_3_5", "Total", "Under 3.5", "h + a <= 3"),
    ("btts_yes", "BTTS", "Yes", "h > 0 and a > 0"),
    ("btts_no", "BTTS", "No", "h = 0 or a = 0"),
    ("home_minus_1_5", "Handicap", "Home -1.5", "h - a >= 2"),
    ("away_plus_1_5", "Handicap", "Away +1.5", "h - a < 2"),
    ("away_minus_1_5", "Handicap", "Away -1.5", "a - h >= 2"),
    ("home_plus_1_5", "Handicap", "Home +1.5", "a - h < 2"),
    ("home_or_draw", "Double Chance", "Home/Draw", "h >= a"),
    ("draw_or_away", "Double Chance", "Draw/Away", "h <= a"),
]


def outcome_probabilities(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """One column for each of MARKETS, in one aggregation."""
    return matrix.groupBy(*keys).agg(*[F.expr(f"sum(prob) filter (where {rule})").alias(name) for name, _, _, rule in MARKETS])


def market_rows(probs: DataFrame, keys: list[str]) -> DataFrame:
    """The probabilities as rows: market, selection, model_prob."""
    return probs.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("market"), F.lit(s).alias("selection"), F.col(n).alias("model_prob")) for n, m, s, _ in MARKETS])))


def predict(matches: DataFrame, ratings: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    """Matches with expected goals and all outcome probabilities. Scorelines are worked out once for each pairing of teams."""
    pairs = matches.select("home", "away").distinct()
    pairs = expected_goals(with_ratings(pairs, ratings), config).select("home", "away", "home_xg", "away_xg")
    probs = outcome_probabilities(score_matrix(pairs, ["home", "away"]), ["home", "away"])
    return matches.join(pairs.join(probs, ["home", "away"]), ["home", "away"])


def top_scorelines(matrix: DataFrame, keys: list[str], n: int = 8) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("prob").desc(), "h", "a"))
    return matrix.withColumn("place", rank).where(F.col("place") <= n)


def goal_distribution(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Probability of each number of goals of either side and in total."""
    parts = F.inline(F.array(*[F.struct(F.lit(n).alias("side"), F.expr(e).alias("goals")) for n, e in (("home", "h"), ("away", "a"), ("total", "h + a"))]))
    return matrix.select(*keys, "prob", parts).groupBy(*keys, "side", "goals").agg(F.sum("prob").alias("prob"))


def goal_timeline(xg: DataFrame, keys: list[str]) -> DataFrame:
    """Chance that either side has scored by each fifth minute; goals come slightly more often late."""
    minute = F.explode(F.sequence(F.lit(0), F.lit(90), F.lit(5))).alias("minute")
    t = F.col("minute") / 90
    scored = lambda x: 1 - F.exp(-F.col(x) * (F.lit(0.85) * t + F.lit(0.15) * t * t))
    return xg.select(*keys, "home_xg", "away_xg", minute).select(*keys, "minute", scored("home_xg").alias("home_scored"), scored("away_xg").alias("away_scored"))


def decimal_edges(rows: DataFrame, odds: DataFrame, keys: list[str]) -> DataFrame:
    """fair odds and expected value on decimal odds; odds count only above 1, and rows without odds have no value."""
    joined = rows.join(odds.select(*keys, "market", "selection", F.when(F.col("odds") > 1, F.col("odds")).alias("market_odds")), [*keys, "market", "selection"], "left")
    return joined.withColumn("fair_odds", F.when(F.col("model_prob") > 0, 1 / F.col("model_prob"))).withColumn("alpha_ev", F.col("model_prob") * F.col("market_odds") - 1)


def fill_benchmark_odds(odds: DataFrame, fair: DataFrame, keys: list[str]) -> DataFrame:
    """Valid quotes, and fair odds for the selections that have none."""
    valid = odds.where("odds > 1")
    missing = fair.join(valid, keys, "left_anti")
    return valid.select(*keys, "odds", F.lit("market").alias("odds_source")).unionByName(missing.select(*keys, "odds", F.lit("generated").alias("odds_source")))


def devig(odds: DataFrame, key: str = "match_id") -> DataFrame:
    """Implied 1X2 probabilities without margin; null unless all three prices are valid."""
    inverse = lambda s: F.max(F.when((F.col("selection") == s) & (F.col("odds") > 1), 1 / F.col("odds")))
    p = odds.where("market = '1X2'").groupBy(key).agg(inverse("Home").alias("h"), inverse("Draw").alias("d"), inverse("Away").alias("a"))
    total = F.col("h") + F.col("d") + F.col("a")
    return p.select(key, *[(F.col(c) / total).alias(n) for c, n in (("h", "market_home"), ("d", "market_draw"), ("a", "market_away"))])


def scale_temperature(home: Column, draw: Column, away: Column, temperature: Column) -> list[Column]:
    """Softmax of the log probabilities over the temperature (at least 0.05)."""
    x = [F.log(C.clamp(p, 1e-6, 1.0)) / F.greatest(temperature, F.lit(0.05)) for p in (home, draw, away)]
    e = [F.exp(v - F.greatest(*x)) for v in x]
    return [v / (e[0] + e[1] + e[2]) for v in e]


def adjust(home: Column, draw: Column, away: Column, draw_inflation: Column, favorite_scale: Column, underdog_scale: Column) -> list[Column]:
    """More or less draw, favorite and underdog; each at least 0.001, then scaled to sum to 1."""
    d = draw * draw_inflation
    h = F.when(home >= away, home * favorite_scale).otherwise(home * underdog_scale)
    a = F.when(home >= away, away * underdog_scale).otherwise(away * favorite_scale)
    low = [F.greatest(x, F.lit(0.001)) for x in (h, d, a)]
    return [x / (low[0] + low[1] + low[2]) for x in low]
