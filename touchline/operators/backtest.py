"""Back-tests that see only what lay before each match: as-of ratings in two modes, relevance of the matches before a day, parameter sets.

No match is paired with the matches before it. Weights that fall with age are decayed forward to one fixed day, where they are plain
terms of a running sum; what is read at a later day differs by a factor that all terms share, so means don't change. Weights that change
in steps with age are differences of running counts at the steps. Rows are summed by team and day first, and one sorted pass per team
over these sums and the days asked for gives all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import behavior as B
from . import evaluation as E

#: day to which weights are decayed forward; only differences to it count
LANDMARK = "2000-01-01"
#: fixed values: weight of a match for training, by kind of competition; friendlies within a year and older ones; other kinds
RELEVANCE = {"world_cup": 1.50, "world_cup_qualifier": 1.25, "continental_tournament": 1.20, "continental_qualifier": 1.10, "nations_league": 1.00}
FRIENDLY, OTHER = (0.70, 0.35), 0.50
#: fixed values: up to so many days, this factor; beyond the last of them AGED
AGES = [(90, 1.25), (365, 1.00), (730, 0.70), (1460, 0.45)]
AGED = 0.20
#: fixed values: factors of the same tournament cycle, the one before, and older ones; a cycle starts with a year like CYCLE_YEAR and has 4
CYCLES, CYCLE_YEAR = (1.15, 0.70, 0.40), 2022


def _cycle_start(day: Column) -> Column:
    return F.year(day) - F.pmod(F.year(day) - CYCLE_YEAR, F.lit(4))


def relevance(day: Column, kind: Column, at: Column) -> Column:
    """How much a match of ``day`` tells about one at ``at``, from 0.1 to 2; 0 for the same day and later ones."""
    age = F.datediff(at, day)
    weight = F.when(kind == "friendly", F.when(age <= 365, FRIENDLY[0]).otherwise(FRIENDLY[1]))
    for name, value in RELEVANCE.items():
        weight = weight.when(kind == name, value)
    recent = F.when(age <= AGES[0][0], AGES[0][1])
    for days, value in AGES[1:]:
        recent = recent.when(age <= days, value)
    back = _cycle_start(at) - _cycle_start(day)
    cycle = F.when(back == 0, CYCLES[0]).when(back == 4, CYCLES[1]).otherwise(CYCLES[2])
    return F.when(age <= 0, 0.0).otherwise(C.clamp(weight.otherwise(OTHER) * recent.otherwise(AGED) * cycle, 0.10, 2.00))


def relevance_asof(matches: DataFrame, days: DataFrame, *by: str) -> DataFrame:
    """Of each row of ``days`` (``by`` and as_of): matches before that day by kind (n_matches, n_world_cup, n_qualifier, n_friendly,
    n_recent_friendly), the sum of their relevance, its mean, and the first and last of their days.

    matches: ``by``, match_date, comp_type. Between two steps of age or cycle all matches of a kind weigh the same, so the sum is that of
    running counts at the steps times the changes of weight there. A day has at most 8 steps, whatever the number of matches.
    """
    daily = matches.groupBy(*by, "comp_type", "match_date").agg(F.count("*").alias("n"))
    start = lambda back: F.make_date(_cycle_start(F.col("as_of")) - back, F.lit(1), F.lit(1))
    steps = [F.col("as_of"), *[F.date_sub("as_of", d) for d, _ in AGES], start(0), start(4)]
    kinds = matches.select("comp_type").distinct()
    asked = days.select(*by, "as_of").distinct().withColumn("steps", F.sort_array(F.array_distinct(F.array(*steps)), asc=False)).select("*", F.posexplode("steps").alias("i", "step"))
    asked = asked.withColumn("before", F.get("steps", F.col("i") - 1)).join(F.broadcast(kinds), how="cross")  # as many kinds as the ladder has
    weight = lambda step: F.when(F.col(step).isNotNull(), relevance(F.date_sub(step, 1), F.col("comp_type"), F.col("as_of"))).otherwise(0.0)
    asked = asked.select(*by, "as_of", "comp_type", F.col("step").alias("day"), (weight("step") - weight("before")).alias("change"), (F.col("i") == 0).alias("whole"), (F.col("step") == F.date_sub("as_of", 365)).alias("year"))
    none = F.lit(None)
    both = asked.withColumns({"n": none.cast("long"), "kind": F.lit(0), "seen": none.cast("date")}).unionByName(
        daily.select(*by, none.cast("date").alias("as_of"), "comp_type", F.col("match_date").alias("day"), none.cast("double").alias("change"), none.cast("boolean").alias("whole"), none.cast("boolean").alias("year"), "n", F.lit(1).alias("kind"), F.col("match_date").alias("seen"))
    )
    earlier = Window.partitionBy(*by, "comp_type").orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = both.withColumns({"c": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "last": F.max("seen").over(earlier), "first": F.min("seen").over(earlier)}).where("kind = 0")
    of = lambda rule: F.sum(F.when(F.col("whole") & rule, F.col("c")).otherwise(0))
    friendly = F.col("comp_type") == "friendly"
    out = counted.groupBy(*by, "as_of").agg(
        of(F.lit(True)).alias("n_matches"),
        of(F.col("comp_type") == "world_cup").alias("n_world_cup"),
        of(F.contains("comp_type", F.lit("qualifier"))).alias("n_qualifier"),
        of(friendly).alias("n_friendly"),
        (of(friendly) - F.sum(F.when(F.col("year") & friendly, F.col("c")).otherwise(0))).alias("n_recent_friendly"),
        F.sum(F.col("c") * F.col("change")).alias("weight"),
        F.max(F.when(F.col("whole"), F.col("last"))).alias("latest"),
        F.min(F.when(F.col("whole"), F.col("first"))).alias("oldest"),
    )
    return out.withColumn("mean_weight", F.when(F.col("n_matches") > 0, F.col("weight") / F.col("n_matches")).otherwise(0.0))


def _decayed(day: Column, days: float) -> Column:
    """Weight of a match by its day, up to the factor that all matches before a day asked for share."""
    return F.exp(F.datediff(day, F.to_date(F.lit(LANDMARK))) / F.lit(days))


def behavior_asof(rows: DataFrame, days: DataFrame, half: float = 365.0) -> DataFrame:
    """The indices of behavior.indices() of every (team, as_of) of ``days`` over the team's matches before that day, with their number, the last
    one's day (latest) and the rating after it (elo); nulls for what there is no match for.

    rows: as residuals() gives them, with match_date, match_id, comp_type and team_post, the rating after the match.
    """
    weighted = rows.withColumn("w", _decayed(F.col("match_date"), half) * C.competition_weight(F.col("comp_type")))
    sums = B.sums(weighted, "team", "match_date", more=[F.max_by("team_post", "match_id").alias("elo")])
    parts = [c for c in sums.columns if c not in ("team", "match_date", "elo")]
    none = [F.lit(None).cast(sums.schema[c].dataType).alias(c) for c in (*parts, "elo")]
    asked = days.select("team", F.col("as_of").alias("day"), F.lit(0).alias("kind"), *none, F.lit(None).cast("date").alias("seen")).distinct()
    both = asked.unionByName(sums.withColumn("kind", F.lit(1)).withColumn("seen", F.col("match_date")).withColumnRenamed("match_date", "day"))
    earlier = Window.partitionBy("team").orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = {c: F.sum(c).over(earlier) for c in parts} | {"elo": F.last("elo", ignorenulls=True).over(earlier), "latest": F.max("seen").over(earlier)}
    found = both.withColumns(running).where("kind = 0").withColumnRenamed("day", "as_of").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    return B.composed(B.means(found).drop(*[c for c in parts if c != "n_matches"], "kind", "seen"))


MODES = ("baseline_manual", "behavior_adjusted_asof")


def ratings_asof(ratings: DataFrame, behavior: DataFrame) -> DataFrame:
    """Ratings of every (team, as_of) of ``behavior`` in both modes: Elo as of the day, other values as given, or blended with behavior."""
    graded = behavior.withColumn("grade", B.reliability(F.col("n_matches"), F.datediff("as_of", "latest")))
    base = ratings.select("team", F.col("elo").cast("double").alias("rated"), "attack", "defense", "form")
    rows = graded.withColumnRenamed("elo", "elo_asof").join(base, "team", "left").withColumn("elo", F.coalesce("elo_asof", "rated"))
    blended = B.blended(rows)
    both = [F.struct(F.lit(MODES[0]).alias("mode"), *[F.col(c).alias(c) for c in ("attack", "defense", "form")]), F.struct(F.lit(MODES[1]).alias("mode"), *[F.col(f"{c}_blended").alias(c) for c in ("attack", "defense", "form")])]
    return blended.select("team", "as_of", "elo", "n_matches", "latest", F.inline(F.array(*both)))


def poisson_outcomes(rows: DataFrame, most: int = 7) -> DataFrame:
    """home_win, draw, away_win, over_2_5 and btts_yes of home_xg and away_xg, from two short arrays a row instead of a row for each scoreline."""
    pmf = lambda x: F.array(*[C.poisson_pmf(F.lit(k), F.col(x)) for k in range(most + 1)])
    rows = rows.withColumns({"_home": pmf("home_xg"), "_away": pmf("away_xg")})
    h, a = ([F.get(f"_{s}", F.lit(k)) for k in range(most + 1)] for s in ("home", "away"))

    def total(rule) -> Column:
        terms = [sum(a[j] for j in range(most + 1) if rule(i, j)) * h[i] for i in range(most + 1) if any(rule(i, j) for j in range(most + 1))]
        return sum(terms[1:], terms[0])

    every = sum(h[1:], h[0]) * sum(a[1:], a[0])
    rules = {"home_win": lambda i, j: i > j, "draw": lambda i, j: i == j, "away_win": lambda i, j: i < j, "over_2_5": lambda i, j: i + j > 2, "btts_yes": lambda i, j: i > 0 and j > 0}
    return rows.withColumns({n: total(r) / every for n, r in rules.items()}).drop("_home", "_away")


def expected_goals(rows: DataFrame, elo: Column | float = 0.0032, attack: Column | float = 0.55, defense: Column | float = 0.45, form: float = 0.20) -> DataFrame:
    """home_xg and away_xg of rows with both sides' ratings; weights may be columns. Unknown ratings are neutral."""
    neutral = {"elo": 1700.0, "attack": 0.55, "defense": 0.55, "form": 0.55}
    r = {f"{s}_{c}": F.coalesce(f"{s}_{c}", F.lit(v)) for s in ("home", "away") for c, v in neutral.items()}
    gap = r["home_elo"] - r["away_elo"]
    log = lambda own, other, diff: elo * diff + attack * (r[f"{own}_attack"] - 0.6) - defense * (r[f"{other}_defense"] - 0.6) + form * (r[f"{own}_form"] - 0.6)
    return rows.withColumns({"home_xg": C.clamp(F.exp(log("home", "away", gap)), 0.15, 3.80), "away_xg": C.clamp(F.exp(log("away", "home", -gap)), 0.15, 3.80)})


def with_sides(matches: DataFrame, ratings: DataFrame, *more: str) -> DataFrame:
    """Matches with both sides' ratings as of the match's day, by mode if ``ratings`` has modes; ``more``: other columns to bring."""
    keys = [c for c in ("mode",) if c in ratings.columns]
    for side in ("home", "away"):
        own = ratings.select(F.col("team").alias(side), F.col("as_of").alias("match_date"), *keys, *[F.col(c).alias(f"{side}_{c}") for c in ("elo", "attack", "defense", "form", *more)])
        # ratings are a row a team and day, fewer than matches: they are hashed, so that matches are not sorted
        matches = matches.join(own.hint("shuffle_hash"), [side, "match_date", *(keys if side == "away" else [])])
    return matches


def asof_backtest(matches: DataFrame, rated: DataFrame) -> DataFrame:
    """Every match in both modes, scored: probabilities, p_actual, log_loss, brier, and for either side the number of matches used, the last of
    them, whether it lies before the match (lookahead_safe) and a warning. ``rated``: of ratings_asof() for the days of the matches."""
    rows = poisson_outcomes(expected_goals(with_sides(matches, rated, "n_matches", "latest")))
    rows = E.scored(rows.withColumn("actual", C.outcome(F.col("hg"), F.col("ag"))))
    adjusted = F.col("mode") == MODES[1]
    safe = lambda s: F.coalesce(F.col(f"{s}_latest") < F.col("match_date"), F.lit(True))
    used = {f"{s}_used": F.when(adjusted, F.col(f"{s}_n_matches")).otherwise(0) for s in ("home", "away")}
    last = {f"{s}_last": F.when(adjusted, F.col(f"{s}_latest")) for s in ("home", "away")}
    few = adjusted & (F.least("home_n_matches", "away_n_matches") < 8)
    rows = rows.withColumns(used | last | {"lookahead_safe": safe("home") & safe("away")})
    return rows.withColumn("warning", C.join_reasons((few, "insufficient_asof_behavior"), (~F.col("lookahead_safe"), "lookahead_violation")))


def asof_metrics(rows: DataFrame) -> DataFrame:
    """metrics() by mode, with the share of rows that look ahead at nothing, the mean numbers of matches used, and the rows with too few."""
    return rows.groupBy("mode").agg(
        F.count("*").alias("n"),
        F.avg("hit").alias("top_pick_accuracy"),
        F.avg("brier").alias("brier_score"),
        F.avg("log_loss").alias("multiclass_log_loss"),
        F.avg(F.col("lookahead_safe").cast("int")).alias("lookahead_safe_rate"),
        F.avg("home_used").alias("mean_home_used"),
        F.avg("away_used").alias("mean_away_used"),
        F.count_if(F.contains("warning", F.lit("insufficient_asof_behavior"))).alias("n_insufficient"),
    )


#: fixed values: parameter sets as name, base goals, factor of the Elo weight, attack, defense, draw, favourite, underdog, correlation
SETS = [
    ("baseline_current", 2.5, 1.0, 0.55, 0.45, 1.0, 1.0, 1.0, 0.0),
    ("base_goals_2.2", 2.2, 1.0, 0.55, 0.45, 1.0, 1.0, 1.0, 0.0),
    ("base_goals_2.4", 2.4, 1.0, 0.55, 0.45, 1.0, 1.0, 1.0, 0.0),
    ("base_goals_2.6", 2.6, 1.0, 0.55, 0.45, 1.0, 1.0, 1.0, 0.0),
    ("base_goals_2.8", 2.8, 1.0, 0.55, 0.45, 1.0, 1.0, 1.0, 0.0),
    ("elo_weight_0.75", 2.5, 0.75, 0.55, 0.45, 1.0, 1.0, 1.0, 0.0),
    ("elo_weight_1.25", 2.5, 1.25, 0.55, 0.45, 1.0, 1.0, 1.0, 0.0),
    ("atk_0.45_def_0.55", 2.5, 1.0, 0.45, 0.55, 1.0, 1.0, 1.0, 0.0),
    ("atk_0.65_def_0.35", 2.5, 1.0, 0.65, 0.35, 1.0, 1.0, 1.0, 0.0),
    ("draw_0.90", 2.5, 1.0, 0.55, 0.45, 0.90, 1.0, 1.0, 0.0),
    ("draw_1.10", 2.5, 1.0, 0.55, 0.45, 1.10, 1.0, 1.0, 0.0),
    ("draw_1.20", 2.5, 1.0, 0.55, 0.45, 1.20, 1.0, 1.0, 0.0),
    ("favorite_0.85", 2.5, 1.0, 0.55, 0.45, 1.0, 0.85, 1.0, 0.0),
    ("favorite_1.15", 2.5, 1.0, 0.55, 0.45, 1.0, 1.15, 1.0, 0.0),
    ("underdog_0.90", 2.5, 1.0, 0.55, 0.45, 1.0, 1.0, 0.90, 0.0),
    ("underdog_1.10", 2.5, 1.0, 0.55, 0.45, 1.0, 1.0, 1.10, 0.0),
    ("goal_corr_m0.05", 2.5, 1.0, 0.55, 0.45, 1.0, 1.0, 1.0, -0.05),
    ("goal_corr_p0.05", 2.5, 1.0, 0.55, 0.45, 1.0, 1.0, 1.0, 0.05),
]
PARAMETERS = ("parameter_set", "base_goals", "elo_factor", "attack_weight", "defense_weight", "draw_factor", "favorite_factor", "underdog_factor", "correlation")


def _scaled(rows: DataFrame, home: Column, draw: Column, away: Column) -> DataFrame:
    """1X2 probabilities replaced, each 0.001 at least, to a sum of 1."""
    rows = rows.withColumns({"_h": F.greatest(home, F.lit(0.001)), "_d": F.greatest(draw, F.lit(0.001)), "_a": F.greatest(away, F.lit(0.001))}).withColumn("_t", F.col("_h") + F.col("_d") + F.col("_a"))
    return rows.withColumns({"home_win": F.col("_h") / F.col("_t"), "draw": F.col("_d") / F.col("_t"), "away_win": F.col("_a") / F.col("_t")}).drop("_h", "_d", "_a", "_t")


def walk_forward_training(matches: DataFrame, rated: DataFrame) -> DataFrame:
    """Every match under all SETS with ratings of the mode baseline_manual as of its day: probabilities after the set's changes, scored. The sets are
    literal rows, so nothing is joined for them. base_goals is part of a set and changes no probability of this model."""
    row = lambda values: F.struct(*[F.lit(v).alias(c) for c, v in zip(PARAMETERS, values, strict=True)])
    models = list(dict.fromkeys(s[2:5] for s in SETS))  # sets that differ in what comes after the model share its probabilities
    of_model = F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("_elo", "_attack", "_defense"), m, strict=True)], F.array(*[row(s) for s in SETS if s[2:5] == m]).alias("_sets")) for m in models]))
    rows = with_sides(matches, rated.where(F.col("mode") == MODES[0]).drop("mode")).select("*", of_model)
    rows = poisson_outcomes(expected_goals(rows, F.lit(0.0032) * F.col("_elo"), F.col("_attack"), F.col("_defense")))
    rows = rows.select(*[c for c in rows.columns if c[0] != "_"], F.inline("_sets"))
    h, d, a = F.col("home_win"), F.col("draw"), F.col("away_win")
    rows = _scaled(rows, h, d * F.col("draw_factor"), a)
    one = F.lit(1.0)
    rows = _scaled(rows, h * F.when(h >= a, F.col("favorite_factor")).otherwise(one), d, a * F.when(h >= a, one).otherwise(F.col("favorite_factor")))
    rows = _scaled(rows, h * F.when(h < a, F.col("underdog_factor")).otherwise(one), d, a * F.when(h < a, one).otherwise(F.col("underdog_factor")))
    rows = rows.withColumns({"over_2_5": C.clamp(F.col("over_2_5") + F.col("correlation"), 0.01, 0.99), "btts_yes": C.clamp(F.col("btts_yes") + F.col("correlation") * 0.5, 0.01, 0.99)})
    return E.scored(rows.withColumn("actual", C.outcome(F.col("hg"), F.col("ag"))))


def training_metrics(rows: DataFrame, end: DataFrame) -> DataFrame:
    """By parameter set: means weighted by each match's relevance for the day after the last one (``end``: one row, last_day), and whether the set would be
    promoted: both scores below the baseline's, over 2.5 no more than 5 % worse, 30 matches or more."""
    rows = rows.join(F.broadcast(end), how="cross").withColumn("w", F.greatest(relevance(F.col("match_date"), F.col("comp_type"), F.date_add("last_day", 1)), F.lit(0.1)))
    mean = lambda e: F.sum(e * F.col("w")) / F.sum("w")
    over, both = F.when(F.expr("hg + ag > 2"), 1.0).otherwise(0.0), F.when(F.expr("hg > 0 and ag > 0"), 1.0).otherwise(0.0)
    by = rows.groupBy("parameter_set").agg(
        F.count("*").alias("n"),
        mean(F.col("brier")).alias("brier_score"),
        mean(F.col("log_loss")).alias("multiclass_log_loss"),
        mean(F.col("hit")).alias("accuracy"),
        mean(F.col("p_actual")).alias("mean_p_actual"),
        mean(F.pow(F.col("over_2_5") - over, 2)).alias("over_2_5_brier"),
        mean(F.pow(F.col("btts_yes") - both, 2)).alias("btts_brier"),
        mean(F.abs(F.expr("home_xg + away_xg - hg - ag"))).alias("total_goals_mae"),
        F.avg(1 - F.col("p_actual")).alias("calibration_error"),
    )
    base = by.where(F.col("parameter_set") == SETS[0][0]).select(*[F.col(c).alias(f"_{c}") for c in ("brier_score", "multiclass_log_loss", "over_2_5_brier")])
    j = by.join(F.broadcast(base), how="cross")
    better = (F.round("brier_score", 12) < F.round("_brier_score", 12)) & (F.round("multiclass_log_loss", 12) < F.round("_multiclass_log_loss", 12))
    status = F.when(F.col("parameter_set") == SETS[0][0], "current_primary_baseline").when(~better, "not_promoted_did_not_beat_baseline").when(F.col("n") < 30, "not_promoted_sample_too_small")
    return j.withColumn("status", status.when(F.col("over_2_5_brier") > F.col("_over_2_5_brier") * 1.05, "not_promoted_goal_market_worse").otherwise("promotion_candidate")).drop("_brier_score", "_multiclass_log_loss", "_over_2_5_brier")
