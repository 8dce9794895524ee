"""Team behavior: recency-weighted indices, residuals against Elo, schedule strength, response to conditions.

``weighted`` rows have team, team_goals, opponent_goals, w (match weight) and what else a function names. Everything is one grouped
aggregation by team (and reference date), with partial sums before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

GOAL_CAP = 4.0


def weigh(rows: DataFrame, reference: Column, days: float = 365.0) -> DataFrame:
    """w = recency times competition weight; all weights of a team are 1 if none is above 0."""
    w = C.recency_weight(F.col("match_date"), reference, days) * C.competition_weight(F.col("comp_type"))
    total = F.sum("w").over(Window.partitionBy("team"))
    return rows.withColumn("w", w).withColumn("w", F.when(total <= 0, 1.0).otherwise(F.col("w")))


def residuals(rows: DataFrame, cap: float = 1.75) -> DataFrame:
    """Result and goals against what both ratings (team_elo, opponent_elo) let expect; capped goals and the weight of blowouts."""
    score = F.when(F.col("team_goals") > F.col("opponent_goals"), 1.0).when(F.col("team_goals") == F.col("opponent_goals"), 0.5).otherwise(0.0)
    bonus = F.when(F.col("neutral"), 0.0).when(F.col("is_home"), 35.0).otherwise(-35.0)
    own, other = F.col("team_elo"), F.col("opponent_elo")
    out = rows.withColumns({"expected_score": C.expected_score(own, other, bonus), "expected_for": C.expected_goals_from_elo(own, other), "expected_against": C.expected_goals_from_elo(other, own)})
    out = out.withColumns({"result_residual": score - F.col("expected_score"), "for_residual": F.col("team_goals") - F.col("expected_for"), "against_residual": F.col("opponent_goals") - F.col("expected_against")})
    return out.withColumns(
        {"for_residual_capped": C.clamp(F.col("for_residual"), -cap, cap), "against_residual_capped": C.clamp(F.col("against_residual"), -cap, cap), "blowout": C.blowout_weight(F.col("team_goals") - F.col("opponent_goals"))}
    )


def quality_modifier(elo: Column, strength: float = 0.35, baseline: float = 1500.0) -> Column:
    """Goals against stronger opponents count more."""
    return C.clamp(1 + (F.coalesce(elo, F.lit(baseline)) - baseline) / 400 * strength, 0.75, 1.25)


def _composite(parts: list[tuple[Column, float]], default: float = 0.5) -> Column:
    """Weighted mean of the parts that are there, their weights scaled up to 1."""
    value = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in parts[1:]), F.coalesce(parts[0][0] * parts[0][1], F.lit(0.0)))
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in parts[1:]), F.when(parts[0][0].isNotNull(), parts[0][1]).otherwise(0.0))
    return F.when(weight > 0, C.clamp(value / weight, 0.0, 1.0)).otherwise(default)


#: rates of matches with a condition
RATES = {
    "scoring_rate": "team_goals > 0",
    "multi_goal_rate": "team_goals >= 2",
    "clean_sheet_rate": "opponent_goals = 0",
    "multi_conceded_rate": "opponent_goals >= 2",
    "win_rate": "team_goals > opponent_goals",
    "btts_rate": "team_goals > 0 and opponent_goals > 0",
    "over_1_5_rate": "team_goals + opponent_goals >= 2",
    "over_2_5_rate": "team_goals + opponent_goals >= 3",
    "failed_to_score_rate": "team_goals = 0",
}


def sums(rows: DataFrame, *by: str, more: list[Column] | None = None) -> DataFrame:
    """What means() divides: n_matches, the sum of weights (w), and weighted sums of goals, rates, points and residuals, by ``by``. Sums of parts
    add up to those of the whole, so they can be taken by day first. Rows without a weight above 0 count in n_matches only."""
    w = F.when(F.col("w") > 0, F.col("w"))
    robust = w * F.col("blowout")
    points = F.when(F.col("team_goals") > F.col("opponent_goals"), 3.0).when(F.col("team_goals") == F.col("opponent_goals"), 1.0).otherwise(0.0)
    goals = lambda c: C.clamp(F.col(c).cast("double"), 0.0, GOAL_CAP)
    plain = {"goals_for": goals("team_goals"), "goals_against": goals("opponent_goals"), "points_per_match": points, "goal_difference": (F.col("team_goals") - F.col("opponent_goals")).cast("double"), "result_residual": F.col("result_residual")}
    plain |= {name: F.when(F.expr(rule), 1.0).otherwise(0.0) for name, rule in RATES.items()}
    capped = {"for_residual": F.col("for_residual_capped"), "against_residual": F.col("against_residual_capped")}
    known = lambda x, weight: F.sum(F.when(x.isNotNull(), weight))
    parts = [F.sum(x * w).alias(f"s_{n}") for n, x in plain.items()] + [F.sum(x * robust).alias(f"s_{n}") for n, x in capped.items()]
    parts += [known(plain["goals_for"], w).alias("w_goals"), known(plain["result_residual"], w).alias("w_result"), known(capped["for_residual"], robust).alias("w_for"), known(capped["against_residual"], robust).alias("w_against")]
    return rows.groupBy(*by).agg(F.count("*").alias("n_matches"), *parts, *(more or []))


def means(summed: DataFrame) -> DataFrame:
    """The weighted means of sums(); null without any weight."""
    of = {"result_residual": "w_result", "for_residual": "w_for", "against_residual": "w_against"}
    names = [c[2:] for c in summed.columns if c.startswith("s_")]
    return summed.withColumns({n: F.col(f"s_{n}") / F.when(F.col(of.get(n, "w_goals")) > 0, F.col(of.get(n, "w_goals"))) for n in names})


def indices(rows: DataFrame, *by: str) -> DataFrame:
    """Attack, defense and form indices (raw, from residuals, and final: 0.7 raw + 0.3 residual) and rates of goal markets."""
    out = means(sums(rows, *(by or ("team",))))
    return composed(out.drop(*[c for c in out.columns if c[:2] in ("s_", "w_")]))


def composed(agg: DataFrame) -> DataFrame:
    """The indices of rows that have the means."""
    unit = lambda x: F.when(x.isNotNull(), C.clamp(x, 0.0, 1.0))
    share = lambda c, most: unit(F.col(c) / most)
    agg = agg.withColumns(
        {
            "attack_raw": _composite([(share("goals_for", 2.65), 0.36), (F.col("scoring_rate"), 0.26), (F.col("multi_goal_rate"), 0.20)]),
            "defense_raw": _composite([(1 - share("goals_against", 2.55), 0.38), (F.col("clean_sheet_rate"), 0.24), (1 - F.col("multi_conceded_rate"), 0.20)]),
            "attack_residual": F.coalesce(unit(F.lit(0.5) + F.col("for_residual") / 3), F.lit(0.5)),
            "defense_residual": F.coalesce(unit(F.lit(0.5) - F.col("against_residual") / 3), F.lit(0.5)),
            "form_index": unit(F.lit(0.55) * share("points_per_match", 3.0) + F.lit(0.25) * F.col("win_rate") + F.lit(0.20) * unit((F.col("goal_difference") + 2) / 4)),
        }
    )
    final = lambda a, b: F.lit(0.7) * F.col(a) + F.lit(0.3) * F.col(b)
    return agg.withColumns({"attack_final": final("attack_raw", "attack_residual"), "defense_final": final("defense_raw", "defense_residual")})


def top_share(rows: DataFrame, value: str, n: int = 3) -> DataFrame:
    """What the ``n`` largest weighted residuals have of a team's total: how few matches an index hangs on."""
    x = F.abs(F.col(value)) * F.col("w") * F.col("blowout")
    ranked = rows.select("team", x.alias("x")).where("x > 0").withColumn("place", F.row_number().over(Window.partitionBy("team").orderBy(F.col("x").desc())))
    return ranked.groupBy("team").agg(F.least(F.sum(F.when(F.col("place") <= n, F.col("x"))) / F.sum("x"), F.lit(1.0)).alias("top_share"))


def schedule_strength(rows: DataFrame, strong: float = 1700.0, weak: float = 1400.0, coverage: float = 0.6) -> DataFrame:
    out = rows.groupBy("team").agg(
        F.count("*").alias("n"),
        F.avg("opponent_elo").alias("mean_elo"),
        F.median("opponent_elo").alias("median_elo"),
        F.min("opponent_elo").alias("min_elo"),
        F.max("opponent_elo").alias("max_elo"),
        F.avg(F.when(F.col("opponent_elo").isNotNull(), 1.0).otherwise(0.0)).alias("coverage"),
        F.count_if(F.col("opponent_elo") >= strong).alias("strong"),
        F.count_if(F.col("opponent_elo") <= weak).alias("weak"),
        F.count("opponent_elo").alias("known"),
    )
    s, w = F.col("strong") / F.greatest("known", F.lit(1)), F.col("weak") / F.greatest("known", F.lit(1))
    label = F.when((F.col("known") == 0) | (F.col("coverage") < coverage), "unknown").when((s >= 0.25) & (w >= 0.25), "mixed").when((F.col("mean_elo") >= 1625) | (s >= 0.35), "strong")
    return out.withColumn("label", label.when((F.col("mean_elo") <= 1450) | (w >= 0.35), "weak").otherwise("average"))


def opponent_quality(rows: DataFrame, ratings: DataFrame, least: int = 5, years: int = 4) -> DataFrame:
    """Elo of each team: the rated one, else an estimate from points and goals in the last years up to the newest match of all."""
    newest = rows.agg(F.max("match_date").alias("newest"))
    recent = rows.join(F.broadcast(newest), how="cross").where(F.col("match_date") >= F.add_months("newest", -12 * years))
    points = F.when(F.col("team_goals") > F.col("opponent_goals"), 3.0).when(F.col("team_goals") == F.col("opponent_goals"), 1.0).otherwise(0.0)
    seen = recent.groupBy("team").agg(F.count("*").alias("n"), F.avg(points).alias("ppg"), F.avg(F.col("team_goals") - F.col("opponent_goals")).alias("gd")).where(F.col("n") >= least)
    guess = C.clamp(F.lit(1500.0) + (F.col("ppg") - 1.25) * 240 + F.col("gd") * 80, 1150.0, 2050.0)
    return seen.join(ratings.select("team", "elo"), "team", "full_outer").select("team", F.coalesce(F.col("elo").cast("double"), guess).alias("elo"), F.col("elo").isNull().alias("estimated"))


def environment_response(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Of each team and condition: weighted goals with it minus without, and conceded without minus with, within 0.35."""
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("condition"), F.coalesce(c, F.lit(False)).alias("met")) for k, c in conditions.items()]))
    flat = rows.select("team", "team_goals", "opponent_goals", "w", each)
    mean = lambda c, met: C.weighted_mean(F.when(F.col("met") == met, F.col(c).cast("double")), F.col("w"))
    out = flat.groupBy("team", "condition").agg(
        F.count_if("met").alias("n"), (mean("team_goals", True) - mean("team_goals", False)).alias("attack"), (mean("opponent_goals", False) - mean("opponent_goals", True)).alias("defense")
    )
    cut = lambda c: F.when(F.col(c).isNotNull(), C.clamp(F.col(c), -0.35, 0.35)).alias(f"{c}_delta")
    return out.select("team", "condition", "n", cut("attack"), cut("defense"))


def tier(elo: Column) -> Column:
    return F.when(elo >= 1850, "elite").when(elo >= 1700, "strong").when(elo >= 1500, "average").when(elo.isNotNull(), "weak").otherwise("unknown")


def contribution() -> Column:
    """What a match adds to its team's index: weight times goals and residual signal."""
    return F.col("w") * F.col("blowout") * (F.lit(0.7) * F.col("team_goals") + F.lit(0.3) * F.col("for_residual_capped"))


def drivers(rows: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` matches that move each team's index most."""
    out = rows.withColumn("contribution", contribution())
    return out.withColumn("place", F.row_number().over(Window.partitionBy("team").orderBy(F.abs("contribution").desc(), "match_id"))).where(F.col("place") <= n)


def breakdown(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("contribution", contribution()).groupBy("team", by).agg(F.count("*").alias("n"), F.sum("contribution").alias("contribution"), F.avg("for_residual").alias("mean_for_residual"))


def reliability(n: Column, days: Column) -> Column:
    """Grade of a sample by size and age of its newest match; days is null if there is none."""
    return F.when((n >= 25) & (days <= 180), "high").when((n >= 15) & (days <= 365), "moderate").when(n >= 8, "low").otherwise("insufficient")


def blended(rows: DataFrame, most: tuple[float, float, float] = (0.12, 0.12, 0.18)) -> DataFrame:
    """Ratings moved towards behavior: only for graded samples of 8 or more, by a weight for the grade, and by ``most`` at most. Adds blend_weight and
    attack_blended, defense_blended, form_blended to rows with ratings, indices, n_matches and grade."""
    weight = F.when(F.coalesce("n_matches", F.lit(0)) < 8, 0.0).when(F.col("grade") == "high", 0.35).when(F.col("grade") == "moderate", 0.25).when(F.col("grade") == "low", 0.10).otherwise(0.0)
    rows = rows.withColumn("blend_weight", weight)
    move = lambda a, b, cap: F.col(a) + C.clamp(F.coalesce(F.col("blend_weight") * (F.col(b) - F.col(a)), F.lit(0.0)), -cap, cap)
    pairs = zip(("attack", "defense", "form"), ("attack_final", "defense_final", "form_index"), most, strict=True)
    return rows.withColumns({f"{a}_blended": move(a, b, cap) for a, b, cap in pairs})


def blend(ratings: DataFrame, behavior: DataFrame) -> DataFrame:
    """blended() of the ratings of teams, with or without behavior."""
    return blended(ratings.join(behavior, "team", "left")).select("team", "blend_weight", "attack_blended", "defense_blended", "form_blended")
