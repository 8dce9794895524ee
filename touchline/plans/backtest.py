"""Queries of back-tests: behavior and ratings as of each match's day, both modes, relevance, and walk-forward training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import backtest as T
from ..operators import behavior as B
from ..operators import evaluation as E
from ..operators import timeseries as S
from .base import MATERIALIZED, VIEWS, Tables, query

_RATES = {"scoring_rate": "team_goals > 0", "multi_goal_rate": "team_goals >= 2", "clean_sheet_rate": "opponent_goals = 0", "multi_conceded_rate": "opponent_goals >= 2", "win_rate": "team_goals > opponent_goals"}
_UNIT = "greatest(0e0, least(1e0, {}))"
_AGED = "exp(-(k.as_of - m.match_date) / 365e0) * cw"
VIEWS |= {
    "v_bh0": """SELECT t.*, round(e.team_pre, 3) AS team_elo, round(e.opponent_pre, 3) AS opponent_elo, round(e.team_post, 3) AS team_post, CASE comp_type WHEN 'world_cup' THEN 15e-1 WHEN 'world_cup_qualifier' THEN 115e-2 WHEN 'continental_tournament' THEN 125e-2 WHEN 'nations_league' THEN 9e-1 WHEN 'friendly' THEN 45e-2 ELSE 8e-1 END AS cw,
        CASE WHEN team_goals > opponent_goals THEN 1e0 WHEN team_goals = opponent_goals THEN 5e-1 ELSE 0e0 END AS score, CASE WHEN neutral THEN 0e0 WHEN is_home THEN 35e0 ELSE -35e0 END AS bonus FROM v_team t JOIN v_elo_team e ON e.match_id = t.match_id AND e.team = t.team""",
    "v_bh": """SELECT *, score - 1 / (1 + pow(1e1, (opponent_elo - team_elo - bonus) / 400)) AS result_residual, greatest(-175e-2, least(175e-2, team_goals - greatest(25e-2, least(35e-1, 135e-2 * exp((team_elo - opponent_elo) / 900))))) AS for_capped,
        greatest(-175e-2, least(175e-2, opponent_goals - greatest(25e-2, least(35e-1, 135e-2 * exp((opponent_elo - team_elo) / 900))))) AS against_capped, CASE WHEN abs(team_goals - opponent_goals) <= 2 THEN 1e0 ELSE greatest(55e-2, least(1e0, 1 / (1 + 35e-2 * (abs(team_goals - opponent_goals) - 2)))) END AS blowout FROM v_bh0""",
    "v_behavior": f"""SELECT *, 7e-1 * attack_raw + 3e-1 * attack_residual AS attack_final, 7e-1 * defense_raw + 3e-1 * defense_residual AS defense_final FROM (SELECT *,
        CASE WHEN goals_for IS NULL THEN 5e-1 ELSE {_UNIT.format(f"({_UNIT.format('goals_for / 265e-2')} * 36e-2 + scoring_rate * 26e-2 + multi_goal_rate * 2e-1) / (36e-2 + 26e-2 + 2e-1)")} END AS attack_raw,
        CASE WHEN goals_for IS NULL THEN 5e-1 ELSE {_UNIT.format(f"((1 - {_UNIT.format('goals_against / 255e-2')}) * 38e-2 + clean_sheet_rate * 24e-2 + (1 - multi_conceded_rate) * 2e-1) / (38e-2 + 24e-2 + 2e-1)")} END AS defense_raw,
        CASE WHEN for_residual IS NULL THEN 5e-1 ELSE {_UNIT.format("5e-1 + for_residual / 3")} END AS attack_residual, CASE WHEN against_residual IS NULL THEN 5e-1 ELSE {_UNIT.format("5e-1 - against_residual / 3")} END AS defense_residual,
        CASE WHEN points_per_match IS NOT NULL THEN {_UNIT.format(f"55e-2 * {_UNIT.format('points_per_match / 3')} + 25e-2 * win_rate + 2e-1 * {_UNIT.format('(goal_difference + 2) / 4')}")} END AS form_index
        FROM (SELECT k.team, k.as_of, count(m.match_id) AS n_matches, max(m.match_date) AS latest, arg_max(team_post, struct_pack(d := m.match_date, i := m.match_id)) AS elo, sum(least(team_goals, 4) * {_AGED}) / sum({_AGED}) AS goals_for, sum(least(opponent_goals, 4) * {_AGED}) / sum({_AGED}) AS goals_against,
        {', '.join(f"sum(CASE WHEN {rule} THEN {_AGED} ELSE 0e0 END) / sum({_AGED}) AS {name}" for name, rule in _RATES.items())}, sum(CASE WHEN team_goals > opponent_goals THEN 3 WHEN team_goals = opponent_goals THEN 1 ELSE 0 END * {_AGED}) / sum({_AGED}) AS points_per_match, sum((team_goals - opponent_goals) * {_AGED}) / sum({_AGED}) AS goal_difference,
        sum(for_capped * blowout * {_AGED}) / sum(blowout * {_AGED}) AS for_residual, sum(against_capped * blowout * {_AGED}) / sum(blowout * {_AGED}) AS against_residual
        FROM (SELECT DISTINCT team, match_date AS as_of FROM v_team) k LEFT JOIN v_bh m ON m.team = k.team AND m.match_date < k.as_of GROUP BY 1, 2))""",
    "v_rated": """SELECT team, as_of, elo, n_matches, latest, attack, defense, form, attack + CASE WHEN bw > 0 THEN greatest(-12e-2, least(12e-2, bw * (attack_final - attack))) ELSE 0 END AS attack_b, defense + CASE WHEN bw > 0 THEN greatest(-12e-2, least(12e-2, bw * (defense_final - defense))) ELSE 0 END AS defense_b, form + CASE WHEN bw > 0 THEN greatest(-18e-2, least(18e-2, bw * (form_index - form))) ELSE 0 END AS form_b
        FROM (SELECT b.team, as_of, coalesce(b.elo, r.elo) AS elo, n_matches, latest, attack, defense, form, attack_final, defense_final, form_index, CASE WHEN n_matches < 8 THEN 0e0 WHEN n_matches >= 25 AND as_of - latest <= 180 THEN 35e-2 WHEN n_matches >= 15 AND as_of - latest <= 365 THEN 25e-2 ELSE 1e-1 END AS bw FROM v_behavior b JOIN v_rating r USING (team))""",
    "v_sides": """SELECT m.match_id, m.match_date, m.home, m.away, m.hg, m.ag, m.comp_type, mode, h.elo AS h_elo, a.elo AS a_elo, CASE mode WHEN 'baseline_manual' THEN h.attack ELSE h.attack_b END AS h_att, CASE mode WHEN 'baseline_manual' THEN h.defense ELSE h.defense_b END AS h_def, CASE mode WHEN 'baseline_manual' THEN h.form ELSE h.form_b END AS h_form,
        CASE mode WHEN 'baseline_manual' THEN a.attack ELSE a.attack_b END AS a_att, CASE mode WHEN 'baseline_manual' THEN a.defense ELSE a.defense_b END AS a_def, CASE mode WHEN 'baseline_manual' THEN a.form ELSE a.form_b END AS a_form, h.n_matches AS h_n, a.n_matches AS a_n, h.latest AS h_last, a.latest AS a_last
        FROM v_match m JOIN v_rated h ON h.team = m.home AND h.as_of = m.match_date JOIN v_rated a ON a.team = m.away AND a.as_of = m.match_date, (VALUES ('baseline_manual'), ('behavior_adjusted_asof')) AS x(mode)""",
}
MATERIALIZED.update({"v_bh", "v_behavior", "v_rated", "v_sides"})


def _outcomes(rows: str, elo: str = "32e-4", attack: str = "55e-2", defense: str = "45e-2") -> str:
    """Rows of v_sides with probabilities from both sides' Poisson arrays."""
    xg = lambda own, other, sign: f"greatest(15e-2, least(38e-1, exp({sign}{elo} * (h_elo - a_elo) + {attack} * ({own}_att - 6e-1) - {defense} * ({other}_def - 6e-1) + 2e-1 * ({own}_form - 6e-1))))"
    total = lambda rule: f"list_sum(flatten(list_transform(range(8), lambda i: list_transform(range(8), lambda j: CASE WHEN {rule} THEN hp[i + 1] * ap[j + 1] ELSE 0e0 END)))) / (list_sum(hp) * list_sum(ap))"
    poisson = lambda x: f"list_transform(range(8), lambda k: exp(-{x}) * pow({x}, k) / factorial(CAST(k AS INT)))"
    return f"""SELECT * EXCLUDE (hp, ap), {total('i > j')} AS home_win, {total('i = j')} AS draw, {total('i < j')} AS away_win, {total('i + j > 2')} AS over_2_5, {total('i > 0 AND j > 0')} AS btts_yes, CASE WHEN hg > ag THEN 'home_win' WHEN hg = ag THEN 'draw' ELSE 'away_win' END AS actual
        FROM (SELECT *, {poisson('hx')} AS hp, {poisson('ax')} AS ap FROM (SELECT *, {xg('h', 'a', '')} AS hx, {xg('a', 'h', '-')} AS ax FROM ({rows})))"""


_SCORE = """CASE actual WHEN 'home_win' THEN home_win WHEN 'draw' THEN draw ELSE away_win END AS p_actual, -ln(greatest(1e-3, least(999e-3, p_actual))) AS log_loss, CASE WHEN CASE WHEN home_win >= draw AND home_win >= away_win THEN 'home_win' WHEN draw >= away_win THEN 'draw' ELSE 'away_win' END = actual THEN 1e0 ELSE 0e0 END AS hit,
    pow(home_win - CASE WHEN actual = 'home_win' THEN 1e0 ELSE 0e0 END, 2) + pow(draw - CASE WHEN actual = 'draw' THEN 1e0 ELSE 0e0 END, 2) + pow(away_win - CASE WHEN actual = 'away_win' THEN 1e0 ELSE 0e0 END, 2) AS brier"""
VIEWS["v_asof_pred"] = f"""SELECT *, {_SCORE}, CASE mode WHEN 'baseline_manual' THEN 0 ELSE h_n END AS home_used, CASE mode WHEN 'baseline_manual' THEN 0 ELSE a_n END AS away_used, CASE WHEN mode <> 'baseline_manual' THEN h_last END AS home_last, CASE WHEN mode <> 'baseline_manual' THEN a_last END AS away_last,
    coalesce(h_last < match_date, true) AND coalesce(a_last < match_date, true) AS lookahead_safe, CASE WHEN mode <> 'baseline_manual' AND least(h_n, a_n) < 8 THEN 'insufficient_asof_behavior' ELSE '' END AS warning FROM ({_outcomes('SELECT * FROM v_sides')})"""
_RELEVANT = """CASE WHEN {at} <= {day} THEN 0e0 ELSE greatest(1e-1, least(2e0, CASE {kind} WHEN 'world_cup' THEN 15e-1 WHEN 'world_cup_qualifier' THEN 125e-2 WHEN 'continental_tournament' THEN 12e-1 WHEN 'continental_qualifier' THEN 11e-1 WHEN 'nations_league' THEN 1e0 WHEN 'friendly' THEN CASE WHEN {at} - {day} <= 365 THEN 7e-1 ELSE 35e-2 END ELSE 5e-1 END
    * CASE WHEN {at} - {day} <= 90 THEN 125e-2 WHEN {at} - {day} <= 365 THEN 1e0 WHEN {at} - {day} <= 730 THEN 7e-1 WHEN {at} - {day} <= 1460 THEN 45e-2 ELSE 2e-1 END * CASE ((year({at}) + 2) // 4) - ((year({day}) + 2) // 4) WHEN 0 THEN 115e-2 WHEN 1 THEN 7e-1 ELSE 4e-1 END)) END"""


def _relevant(day: str, kind: str, at: str) -> str:
    return _RELEVANT.replace("{day}", day).replace("{kind}", kind).replace("{at}", at)


def history(t: Tables) -> DataFrame:
    """Team matches with ratings before and after each, residuals against them, and no weights yet."""
    rows = S.elo_rows(S.rolling_elo(t.match, keep=("comp_type", "neutral", "hg", "ag")))
    return B.residuals(rows.withColumnsRenamed({"team_pre": "team_elo", "opponent_pre": "opponent_elo"}))


def behavior(t: Tables) -> DataFrame:
    return T.behavior_asof(history(t), t.team_match.select("team", F.col("match_date").alias("as_of")))


def rated(t: Tables) -> DataFrame:
    return T.ratings_asof(t.rating, behavior(t))


def matches(t: Tables) -> DataFrame:
    return t.match.select("match_id", "match_date", "home", "away", "hg", "ag", "comp_type")


def predictions(t: Tables) -> DataFrame:
    return T.asof_backtest(matches(t), rated(t))


@query("behavior_asof", "team:l as_of:t n_matches:l latest:t elo:d goals_for:d win_rate:d attack_final:d defense_final:d form_index:d", "SELECT * FROM v_behavior")
def behavior_asof(t: Tables):
    return behavior(t)


@query("ratings_asof", "team:l as_of:t mode:s elo:d attack:d defense:d form:d", "SELECT team, as_of, 'baseline_manual' AS mode, elo, attack, defense, form FROM v_rated UNION ALL SELECT team, as_of, 'behavior_adjusted_asof', elo, attack_b, defense_b, form_b FROM v_rated")
def ratings_asof(t: Tables):
    return rated(t)


@query("asof_backtest", "match_id:l mode:s home_win:d draw:d away_win:d over_2_5:d btts_yes:d p_actual:d log_loss:d home_used:l away_used:l home_last:t away_last:t lookahead_safe:b warning:s", "SELECT * FROM v_asof_pred")
def asof_backtest(t: Tables):
    return predictions(t)


@query("asof_metrics", "mode:s n:l top_pick_accuracy:d brier_score:d multiclass_log_loss:d lookahead_safe_rate:d mean_home_used:d mean_away_used:d n_insufficient:l", "SELECT mode, count(*) AS n, avg(hit) AS top_pick_accuracy, avg(brier) AS brier_score, avg(log_loss) AS multiclass_log_loss, avg(lookahead_safe::int) AS lookahead_safe_rate, avg(home_used) AS mean_home_used, avg(away_used) AS mean_away_used, count(*) FILTER (warning <> '') AS n_insufficient FROM v_asof_pred GROUP BY 1")
def asof_metrics(t: Tables):
    return T.asof_metrics(predictions(t))


@query("asof_comparison", "match_id:l base_p:d other_p:d delta:d improved:b note:s", "SELECT *, other_p - base_p AS delta, delta > 0 AS improved, CASE WHEN delta > 5e-4 THEN 'improved' WHEN delta < -5e-4 THEN 'lowered' ELSE 'no material difference' END AS note FROM (SELECT match_id, max(p_actual) FILTER (mode = 'baseline_manual') AS base_p, max(p_actual) FILTER (mode <> 'baseline_manual') AS other_p FROM v_asof_pred GROUP BY 1)")
def asof_comparison(t: Tables):
    return E.compare_modes(predictions(t), *T.MODES)


_SUMMED = "count(m.match_id) AS n_matches, count(*) FILTER (m.comp_type = 'world_cup') AS n_world_cup, count(*) FILTER (m.comp_type LIKE '%qualifier%') AS n_qualifier, count(*) FILTER (m.comp_type = 'friendly') AS n_friendly, count(*) FILTER (m.comp_type = 'friendly' AND k.as_of - m.match_date <= 365) AS n_recent_friendly"


@query("relevance_asof", "as_of:t n_matches:l n_world_cup:l n_qualifier:l n_friendly:l n_recent_friendly:l weight:d mean_weight:d latest:t oldest:t", f"""SELECT as_of, sum(n)::bigint AS n_matches, coalesce(sum(n) FILTER (comp_type = 'world_cup'), 0) AS n_world_cup, coalesce(sum(n) FILTER (comp_type LIKE '%qualifier%'), 0) AS n_qualifier, coalesce(sum(n) FILTER (comp_type = 'friendly'), 0) AS n_friendly, coalesce(sum(n) FILTER (comp_type = 'friendly' AND as_of - match_date <= 365), 0) AS n_recent_friendly,
    sum(n * {_relevant('match_date', 'comp_type', 'as_of')}) AS weight, sum(n * {_relevant('match_date', 'comp_type', 'as_of')}) / greatest(sum(n), 1) AS mean_weight, max(match_date) FILTER (n > 0) AS latest, min(match_date) FILTER (n > 0) AS oldest
    FROM (SELECT k.as_of, d.match_date, d.comp_type, coalesce(d.n, 0) AS n FROM (SELECT DISTINCT match_date AS as_of FROM v_match) k LEFT JOIN (SELECT match_date, comp_type, count(*) AS n FROM v_match GROUP BY 1, 2) d ON d.match_date < k.as_of) GROUP BY 1""".replace("sum(n * CASE", "sum(CASE WHEN n = 0 THEN 0e0 ELSE n END * CASE"))
def relevance_asof(t: Tables):
    out = T.relevance_asof(t.match, t.match.select(F.col("match_date").alias("as_of")))
    return out.withColumn("weight", F.col("weight"))


@query("team_relevance_asof", "team:l as_of:t n_matches:l n_qualifier:l n_recent_friendly:l weight:d mean_weight:d", f"""SELECT k.team, k.as_of, {_SUMMED}, coalesce(sum({_relevant('m.match_date', 'm.comp_type', 'k.as_of')}) FILTER (m.match_id IS NOT NULL), 0e0) AS weight, coalesce(avg({_relevant('m.match_date', 'm.comp_type', 'k.as_of')}) FILTER (m.match_id IS NOT NULL), 0e0) AS mean_weight
    FROM (SELECT DISTINCT team, match_date AS as_of FROM v_team) k LEFT JOIN v_team m ON m.team = k.team AND m.match_date < k.as_of GROUP BY 1, 2""")
def team_relevance_asof(t: Tables):
    return T.relevance_asof(t.team_match, t.team_match.select("team", F.col("match_date").alias("as_of")), "team")


_SETS = ", ".join(f"('{n}', {b}::double, {e}::double, {at}::double, {de}::double, {d}::double, {f}::double, {u}::double, {c}::double)" for n, b, e, at, de, d, f, u, c in T.SETS)


def _renormed(inner: str, h: str, d: str, a: str) -> str:
    return f"SELECT * EXCLUDE (home_win, draw, away_win, h1, d1, a1), h1 / (h1 + d1 + a1) AS home_win, d1 / (h1 + d1 + a1) AS draw, a1 / (h1 + d1 + a1) AS away_win FROM (SELECT *, greatest(1e-3, {h}) AS h1, greatest(1e-3, {d}) AS d1, greatest(1e-3, {a}) AS a1 FROM ({inner}))"


_TRAINED = _renormed(_outcomes(f"SELECT v.*, s.* FROM v_sides v, (VALUES {_SETS}) AS s({', '.join(T.PARAMETERS)}) WHERE mode = 'baseline_manual'", "32e-4 * elo_factor", "attack_weight", "defense_weight"), "home_win", "draw * draw_factor", "away_win")
_TRAINED = _renormed(_TRAINED, "home_win * CASE WHEN home_win >= away_win THEN favorite_factor ELSE 1 END", "draw", "away_win * CASE WHEN home_win >= away_win THEN 1 ELSE favorite_factor END")
_TRAINED = _renormed(_TRAINED, "home_win * CASE WHEN home_win < away_win THEN underdog_factor ELSE 1 END", "draw", "away_win * CASE WHEN home_win < away_win THEN 1 ELSE underdog_factor END")
VIEWS["v_trained"] = f"SELECT * EXCLUDE (over_2_5, btts_yes), greatest(1e-2, least(99e-2, over_2_5 + correlation)) AS over_2_5, greatest(1e-2, least(99e-2, btts_yes + correlation / 2)) AS btts_yes, {_SCORE} FROM ({_TRAINED})"
MATERIALIZED.update({"v_asof_pred", "v_trained"})


@query("walk_forward_training", "parameter_set:s match_id:l home_win:d draw:d away_win:d over_2_5:d btts_yes:d p_actual:d log_loss:d", "SELECT * FROM v_trained")
def walk_forward_training(t: Tables):
    return T.walk_forward_training(matches(t), rated(t))


@query("training_metrics", "parameter_set:s n:l brier_score:d multiclass_log_loss:d accuracy:d mean_p_actual:d over_2_5_brier:d btts_brier:d total_goals_mae:d calibration_error:d status:s", f"""WITH w AS (SELECT *, greatest(1e-1, {_relevant('match_date', 'comp_type', 'CAST(last_day + 1 AS DATE)')}) AS w FROM v_trained, (SELECT max(match_date) AS last_day FROM v_match)),
    b AS (SELECT parameter_set, count(*) AS n, sum(brier * w) / sum(w) AS brier_score, sum(log_loss * w) / sum(w) AS multiclass_log_loss, sum(hit * w) / sum(w) AS accuracy, sum(p_actual * w) / sum(w) AS mean_p_actual, sum(pow(over_2_5 - CASE WHEN hg + ag > 2 THEN 1e0 ELSE 0e0 END, 2) * w) / sum(w) AS over_2_5_brier,
    sum(pow(btts_yes - CASE WHEN hg > 0 AND ag > 0 THEN 1e0 ELSE 0e0 END, 2) * w) / sum(w) AS btts_brier, sum(abs(hx + ax - hg - ag) * w) / sum(w) AS total_goals_mae, avg(1 - p_actual) AS calibration_error FROM w GROUP BY 1)
    SELECT b.*, CASE WHEN b.parameter_set = 'baseline_current' THEN 'current_primary_baseline' WHEN NOT (round(b.brier_score, 12) < round(o.brier_score, 12) AND round(b.multiclass_log_loss, 12) < round(o.multiclass_log_loss, 12)) THEN 'not_promoted_did_not_beat_baseline' WHEN b.n < 30 THEN 'not_promoted_sample_too_small' WHEN b.over_2_5_brier > o.over_2_5_brier * 105e-2 THEN 'not_promoted_goal_market_worse' ELSE 'promotion_candidate' END AS status FROM b, b o WHERE o.parameter_set = 'baseline_current'""")
def training_metrics(t: Tables):
    return T.training_metrics(T.walk_forward_training(matches(t), rated(t)), t.match.agg(F.max("match_date").alias("last_day")))
