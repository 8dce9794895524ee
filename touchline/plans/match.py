"""Queries on matches, ratings and the model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import behavior as B
from ..operators import calibration as W
from ..operators import evaluation as E
from ..operators import markets as K
from ..operators import model as M
from ..operators import timeseries as S
from .base import REFERENCE, Tables, query

REF = lambda: F.to_date(F.lit(REFERENCE))
METRIC = "n:l top_pick_accuracy:d brier_score:d multiclass_log_loss:d"
METRIC_SQL = "count(*) AS n, avg(hit) AS top_pick_accuracy, avg(brier) AS brier_score, avg(log_loss) AS multiclass_log_loss"


@query("q_model_metrics", f"comp_type:s {METRIC} over_2_5_brier:d btts_brier:d home_xg_mae:d", f"""SELECT comp_type, {METRIC_SQL}, avg(pow(over_2_5 - CASE WHEN hg + ag > 2.5 THEN 1e0 ELSE 0e0 END, 2)) AS over_2_5_brier,
    avg(pow(btts_yes - CASE WHEN hg > 0 AND ag > 0 THEN 1e0 ELSE 0e0 END, 2)) AS btts_brier, avg(abs(home_xg - hg)) AS home_xg_mae FROM v_prob GROUP BY 1""")
def model_metrics(t: Tables):
    return E.backtest_metrics(t.prob, "comp_type")


@query("wide_to_long", "match_id:l match_date:t team:l opponent:l is_home:b team_goals:l opponent_goals:l", "SELECT * FROM v_team")
def wide_to_long(t: Tables):
    return t.team_match


@query("long_to_wide", "match_id:l match_date:t home:l away:l hg:l ag:l comp_type:s", "SELECT * FROM v_match")
def long_to_wide(t: Tables):
    return S.long_to_wide(t.team_match)


@query("classify_result", "match_id:l actual:s home_points:l", "SELECT match_id, CASE WHEN hg > ag THEN 'home_win' WHEN hg = ag THEN 'draw' ELSE 'away_win' END AS actual, CASE WHEN hg > ag THEN 3 WHEN hg = ag THEN 1 ELSE 0 END AS home_points FROM v_match")
def classify_result(t: Tables):
    out = t.match.withColumn("actual", C.outcome(F.col("hg"), F.col("ag")))
    return out.withColumn("home_points", F.when(F.col("actual") == "home_win", 3).when(F.col("actual") == "draw", 1).otherwise(0))


@query("asof_filter", "team:l n:l latest:t", "SELECT team, count(*) AS n, max(match_date) AS latest FROM v_team WHERE match_date < DATE '1999-01-01' GROUP BY 1")
def asof_filter(t: Tables):
    return t.team_match.where(F.col("match_date") < F.to_date(F.lit("1999-01-01"))).groupBy("team").agg(F.count("*").alias("n"), F.max("match_date").alias("latest"))


@query("recent_top_n", "team:l match_id:l match_date:t newest:l", """SELECT * FROM (SELECT team, match_id, match_date, row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS newest FROM v_team
    WHERE match_date BETWEEN DATE '1997-08-01' AND DATE '2001-08-01') WHERE newest <= 40""")
def recent_top_n(t: Tables):
    return S.newest_in_window(t.team_match, REF())


@query("rolling_elo", "match_id:l home:l away:l home_pre:d away_pre:d home_post:d away_post:d", "SELECT match_id, home, away, round(home_pre, 3) AS home_pre, round(away_pre, 3) AS away_pre, round(home_post, 3) AS home_post, round(away_post, 3) AS away_post FROM v_elo")
def rolling_elo(t: Tables):
    return S.rolling_elo(t.match).withColumns({f"{s}_{w}": F.round(f"{s}_{w}", 3) for s in ("home", "away") for w in ("pre", "post")})


@query("elo_latest", "team:l elo:d n:l", "SELECT team, round(max_by(team_post, match_date::varchar || lpad(match_id::varchar, 12, '0')), 3) AS elo, count(*) AS n FROM v_elo_team GROUP BY 1")
def elo_latest(t: Tables):
    # by day first: an order by date and match in one is no plain buffer, and such aggregates sort all rows of a task
    daily = S.elo_rows(S.rolling_elo(t.match)).groupBy("team", "match_date").agg(F.max_by("team_post", "match_id").alias("elo"), F.count("*").alias("n"))
    return daily.groupBy("team").agg(F.max_by("elo", "match_date").alias("elo"), F.sum("n").alias("n"))


@query("elo_asof", "team:l as_of:t elo:d matches_used:l latest_match:t", """SELECT k.team, k.as_of, round(max_by(e.team_post, e.match_date::varchar || lpad(e.match_id::varchar, 12, '0')), 3) AS elo, count(e.match_id) AS matches_used, max(e.match_date) AS latest_match
    FROM (SELECT DISTINCT team, date_trunc('year', match_date)::date AS as_of FROM v_team) k LEFT JOIN v_elo_team e ON e.team = k.team AND e.match_date < k.as_of GROUP BY 1, 2""")
def elo_asof(t: Tables):
    keys = t.team_match.select("team", F.trunc("match_date", "year").alias("as_of")).distinct()
    return S.asof_latest(S.elo_rows(S.rolling_elo(t.match)), keys, "team_post").withColumnRenamed("team_post", "elo")


@query("elo_asof_pre", "team:l as_of:t elo:d", """SELECT k.team, k.as_of, round(max_by(e.team_pre, e.match_date::varchar || lpad(e.match_id::varchar, 12, '0')), 3) AS elo
    FROM (SELECT DISTINCT team, date_trunc('month', match_date)::date AS as_of FROM v_team) k JOIN v_elo_team e ON e.team = k.team AND e.match_date < k.as_of GROUP BY 1, 2""")
def elo_asof_pre(t: Tables):
    keys = t.team_match.select("team", F.trunc("match_date", "month").alias("as_of")).distinct()
    return S.asof_latest(S.elo_rows(S.rolling_elo(t.match)), keys, "team_pre").withColumnRenamed("team_pre", "elo").where("elo is not null")


@query("elo_corr_stats", "n:l corr:d median:d spread:d", "SELECT count(*) AS n, corr(e.elo, r.elo) AS corr, median(e.elo) AS median, stddev_pop(e.elo) AS spread FROM (SELECT team, round(max_by(team_post, match_date::varchar || lpad(match_id::varchar, 12, '0')), 3) AS elo FROM v_elo_team GROUP BY 1) e JOIN v_rating r USING (team)")
def elo_corr(t: Tables):
    return elo_latest(t).join(t.rating.select("team", F.col("elo").alias("rated")), "team").agg(F.count("*").alias("n"), F.corr("elo", "rated").alias("corr"), F.median("elo").alias("median"), F.stddev_pop("elo").alias("spread"))


@query("recency_weight", "team:l match_id:l w:d", "SELECT team, match_id, exp(-greatest(DATE '2001-08-01' - match_date, 0) / 365e0) AS w FROM v_team")
def recency_weight(t: Tables):
    return t.team_match.withColumn("w", C.recency_weight(F.col("match_date"), REF()))


@query("match_weight", "team:l match_id:l w:d", "SELECT team, match_id, w FROM v_hist0")
def match_weight(t: Tables):
    return t.history


@query("relevance_weight", "match_id:l relevance:d", """SELECT match_id, CASE WHEN match_date >= DATE '2001-01-01' THEN 0e0 ELSE greatest(1e-1, least(2e0,
    CASE comp_type WHEN 'world_cup' THEN 15e-1 WHEN 'world_cup_qualifier' THEN 125e-2 WHEN 'continental_tournament' THEN 12e-1 WHEN 'nations_league' THEN 1e0 WHEN 'friendly' THEN CASE WHEN days <= 365 THEN 7e-1 ELSE 35e-2 END ELSE 5e-1 END
    * CASE WHEN days <= 90 THEN 125e-2 WHEN days <= 365 THEN 1e0 WHEN days <= 730 THEN 7e-1 WHEN days <= 1460 THEN 45e-2 ELSE 2e-1 END
    * CASE WHEN cyc = 1998 THEN 115e-2 WHEN cyc = 1994 THEN 7e-1 ELSE 4e-1 END)) END AS relevance
    FROM (SELECT *, DATE '2001-01-01' - match_date AS days, year(match_date) - ((year(match_date) - 2022) % 4 + 4) % 4 AS cyc FROM v_match)""")
def relevance_weight(t: Tables):
    at = F.to_date(F.lit("2001-01-01"))
    days = F.datediff(at, "match_date")
    kind = C.lookup(F.col("comp_type"), {"world_cup": 1.5, "world_cup_qualifier": 1.25, "continental_tournament": 1.2, "continental_qualifier": 1.1, "nations_league": 1.0}, 0.5)
    kind = F.when(F.col("comp_type") == "friendly", F.when(days <= 365, 0.7).otherwise(0.35)).otherwise(kind)
    recent = F.when(days <= 90, 1.25).when(days <= 365, 1.0).when(days <= 730, 0.7).when(days <= 1460, 0.45).otherwise(0.2)
    cycle = lambda d: F.year(d) - F.pmod(F.year(d) - 2022, F.lit(4))
    same = F.when(cycle("match_date") == cycle(at), 1.15).when(cycle("match_date") == cycle(at) - 4, 0.7).otherwise(0.4)
    return t.match.withColumn("relevance", F.when(F.col("match_date") >= at, 0.0).otherwise(C.clamp(kind * recent * same, 0.1, 2.0)))


RES = "expected_score:d result_residual:d expected_for:d for_residual:d for_residual_capped:d against_residual_capped:d blowout:d"


@query("residuals", f"team:l match_id:l {RES}", "SELECT * FROM v_hist")
def residuals(t: Tables):
    return t.history


for _name, _cols in {
    "attack_index": "goals_for:d scoring_rate:d multi_goal_rate:d attack_raw:d attack_residual:d attack_final:d",
    "defense_index": "goals_against:d clean_sheet_rate:d multi_conceded_rate:d defense_raw:d defense_residual:d defense_final:d",
    "form_index": "points_per_match:d win_rate:d goal_difference:d form_index:d",
    "goal_market": "btts_rate:d over_1_5_rate:d over_2_5_rate:d failed_to_score_rate:d",
}.items():
    query(_name, f"team:l n_matches:l {_cols}", "SELECT * FROM v_index")(lambda t: B.indices(t.history))


@query("top3_residual_share", "team:l top_share:d", """SELECT team, least(1e0, sum(x) FILTER (place <= 3) / sum(x)) AS top_share FROM (SELECT team, x, row_number() OVER (PARTITION BY team ORDER BY x DESC) AS place
    FROM (SELECT team, abs(for_residual_capped) * w * blowout AS x FROM v_hist) WHERE x > 0) GROUP BY 1""")
def top_share(t: Tables):
    return B.top_share(t.history, "for_residual_capped")


@query("schedule_strength", "team:l n:l mean_elo:d median_elo:d min_elo:d max_elo:d strong:l weak:l label:s", """SELECT *, CASE WHEN strong * 1e0 / n >= 25e-2 AND weak * 1e0 / n >= 25e-2 THEN 'mixed' WHEN mean_elo >= 1625 OR strong * 1e0 / n >= 35e-2 THEN 'strong'
    WHEN mean_elo <= 1450 OR weak * 1e0 / n >= 35e-2 THEN 'weak' ELSE 'average' END AS label FROM (SELECT team, count(*) AS n, avg(opponent_elo) AS mean_elo, median(opponent_elo) AS median_elo, min(opponent_elo) AS min_elo, max(opponent_elo) AS max_elo,
    count(*) FILTER (opponent_elo >= 1700) AS strong, count(*) FILTER (opponent_elo <= 1400) AS weak FROM v_hist0 GROUP BY 1)""")
def schedule_strength(t: Tables):
    return B.schedule_strength(t.history)


@query("opponent_quality", "team:l elo:d estimated:b", """SELECT team, coalesce(r.elo, greatest(1150e0, least(2050e0, 1500e0 + (ppg - 125e-2) * 240 + gd * 80))) AS elo, r.elo IS NULL AS estimated FROM
    (SELECT team, avg(CASE WHEN team_goals > opponent_goals THEN 3 WHEN team_goals = opponent_goals THEN 1 ELSE 0 END) AS ppg, avg(team_goals - opponent_goals) AS gd FROM v_team
    WHERE match_date >= (SELECT max(match_date) FROM v_team) - INTERVAL 4 YEAR GROUP BY 1 HAVING count(*) >= 5) s FULL JOIN (SELECT * FROM v_rating WHERE team % 3 = 0) r USING (team)""")
def opponent_quality(t: Tables):
    return B.opponent_quality(t.team_match, t.rating.where("team % 3 = 0"))


@query("environment_response", "team:l condition:s n:l attack_delta:d defense_delta:d", """SELECT team, condition, count(*) FILTER (met) AS n,
    greatest(-35e-2, least(35e-2, sum(team_goals * w) FILTER (met) / sum(w) FILTER (met) - sum(team_goals * w) FILTER (NOT met) / sum(w) FILTER (NOT met))) AS attack_delta,
    greatest(-35e-2, least(35e-2, sum(opponent_goals * w) FILTER (NOT met) / sum(w) FILTER (NOT met) - sum(opponent_goals * w) FILTER (met) / sum(w) FILTER (met))) AS defense_delta
    FROM (SELECT team, team_goals, opponent_goals, w, unnest(['hot', 'humid', 'rain']) AS condition, unnest([match_id % 40 >= 28, match_id % 97 >= 70, match_id % 5 = 0]) AS met FROM v_hist0) GROUP BY 1, 2""")
def environment_response(t: Tables):
    met = {"hot": F.col("match_id") % 40 >= 28, "humid": F.col("match_id") % 97 >= 70, "rain": F.col("match_id") % 5 == 0}
    return B.environment_response(t.history, met)


CONTRIBUTION = "w * blowout * (7e-1 * team_goals + 3e-1 * for_residual_capped)"


@query("driver_top_n", "team:l match_id:l contribution:d place:l", f"SELECT * FROM (SELECT team, match_id, {CONTRIBUTION} AS contribution, row_number() OVER (PARTITION BY team ORDER BY round(abs({CONTRIBUTION}), 9) DESC, match_id) AS place FROM v_hist) WHERE place <= 5")
def driver_top_n(t: Tables):
    return B.drivers(t.history)


@query("tier_breakdown", "team:l tier:s n:l contribution:d mean_for_residual:d", f"""SELECT team, CASE WHEN opponent_elo >= 1850 THEN 'elite' WHEN opponent_elo >= 1700 THEN 'strong' WHEN opponent_elo >= 1500 THEN 'average' ELSE 'weak' END AS tier,
    count(*) AS n, sum({CONTRIBUTION}) AS contribution, avg(for_residual) AS mean_for_residual FROM v_hist GROUP BY 1, 2""")
def tier_breakdown(t: Tables):
    return B.breakdown(t.history.withColumn("tier", B.tier(F.col("opponent_elo"))), "tier")


@query("comp_breakdown", "team:l comp_type:s n:l contribution:d mean_for_residual:d", f"SELECT team, comp_type, count(*) AS n, sum({CONTRIBUTION}) AS contribution, avg(for_residual) AS mean_for_residual FROM v_hist GROUP BY 1, 2")
def comp_breakdown(t: Tables):
    return B.breakdown(t.history, "comp_type")


@query("behavior_table_asof", "team:l as_of:t n_matches:l goals_for:d scoring_rate:d win_rate:d", """SELECT team, as_of, count(*) AS n_matches, sum(least(team_goals, 4) * v) / sum(v) AS goals_for, coalesce(sum(v) FILTER (team_goals > 0), 0) / sum(v) AS scoring_rate, coalesce(sum(v) FILTER (team_goals > opponent_goals), 0) / sum(v) AS win_rate
    FROM (SELECT k.team, k.as_of, team_goals, opponent_goals, exp(-(k.as_of - match_date) / 365e0) AS v, row_number() OVER (PARTITION BY k.team, k.as_of ORDER BY match_date DESC, match_id DESC) AS place
    FROM (SELECT DISTINCT team, date_trunc('year', match_date)::date AS as_of FROM v_team) k JOIN v_team m ON m.team = k.team AND m.match_date < k.as_of AND m.match_date >= k.as_of - INTERVAL 4 YEAR) WHERE place <= 40 GROUP BY 1, 2""")
def behavior_asof(t: Tables):
    from pyspark.sql import Window

    keys = t.team_match.select(F.col("team").alias("k"), F.trunc("match_date", "year").alias("as_of")).distinct()
    m = t.team_match
    j = m.join(keys, (m.team == keys.k) & (m.match_date < keys.as_of) & (m.match_date >= F.add_months(keys.as_of, -48)))
    j = j.withColumn("place", F.row_number().over(Window.partitionBy("team", "as_of").orderBy(F.col("match_date").desc(), F.col("match_id").desc()))).where("place <= 40")
    w = C.recency_weight(F.col("match_date"), F.col("as_of"))
    rate = lambda e: C.weighted_mean(F.when(F.expr(e), 1.0).otherwise(0.0), w)
    return j.groupBy("team", "as_of").agg(F.count("*").alias("n_matches"), C.weighted_mean(F.least("team_goals", F.lit(4)).cast("double"), w).alias("goals_for"), rate("team_goals > 0").alias("scoring_rate"), rate("team_goals > opponent_goals").alias("win_rate"))


@query("behavior_blend", "team:l blend_weight:d attack_blended:d defense_blended:d form_blended:d", """SELECT team, bw AS blend_weight, attack + greatest(-12e-2, least(12e-2, bw * (attack_final - attack))) AS attack_blended, defense + greatest(-12e-2, least(12e-2, bw * (defense_final - defense))) AS defense_blended,
    form + greatest(-18e-2, least(18e-2, bw * (form_index - form))) AS form_blended FROM (SELECT r.*, i.attack_final, i.defense_final, i.form_index, CASE WHEN i.n_matches < 8 THEN 0e0 WHEN r.team % 4 = 0 THEN 35e-2 WHEN r.team % 4 = 1 THEN 25e-2 WHEN r.team % 4 = 2 THEN 1e-1 ELSE 0e0 END AS bw FROM v_rating r JOIN v_index i USING (team))""")
def behavior_blend(t: Tables):
    grade = F.element_at(F.array(*map(F.lit, ("high", "moderate", "low", "insufficient"))), (F.col("team") % 4 + 1).cast("int"))
    return B.blend(t.rating, B.indices(t.history).withColumn("grade", grade).select("team", "n_matches", "grade", "attack_final", "defense_final", "form_index"))


def xg(t: Tables):
    return M.expected_goals(M.with_ratings(t.match.select("home", "away").distinct(), t.rating))


@query("xg_components", "home:l away:l elo_diff:d home_rating_xg:d away_rating_xg:d home_form_xg:d home_xg:d away_xg:d", """SELECT x.home, x.away, elo_diff, exp(home_rating_log) AS home_rating_xg, exp(away_rating_log) AS away_rating_xg, exp(home_rating_log + home_form_log) AS home_form_xg, home_xg, away_xg
    FROM v_xg x SEMI JOIN v_match m ON m.home = x.home AND m.away = x.away""")
def xg_components(t: Tables):
    return xg(t)


@query("environment_xg", "home:l away:l penalty:d drag:d env_xg:d", """SELECT home, away, penalty, drag, greatest(15e-2, least(38e-1, exp(home_rating_log + home_form_log + penalty) * exp(drag))) AS env_xg FROM (SELECT x.*,
    greatest(-14e-2, least(4e-2, -1e-2 * share * (45e-2 * abs(tmp - 20) + 18e-2 * abs(hum - 60) / 10 + greatest(tmp - 28, 0) * 35e-2 + greatest(hum - 70, 0) / 10 * greatest(tmp - 25, 0) * 8e-2) + CASE WHEN alt > 1200 THEN -25e-6 * (alt - 1200) ELSE 0 END)) AS penalty,
    greatest(-16e-2, least(4e-2, -1e-2 * share * (greatest(wind - 12, 0) * 55e-2 + greatest(rain, 0) * 8e-1 + greatest(tmp - 30, 0) * 35e-2) + CASE WHEN alt > 1200 THEN -25e-6 * (alt - 1200) ELSE 0 END)) AS drag
    FROM (SELECT *, 15e0 + home % 20 AS tmp, 40e0 + away % 50 AS hum, home * 80e0 AS alt, away * 1e0 AS wind, home % 4 * 1e0 AS rain, CASE WHEN away % 5 = 0 THEN 15e-2 ELSE 1e0 END AS share FROM v_xg) x SEMI JOIN v_match m ON m.home = x.home AND m.away = x.away)""")
def environment_xg(t: Tables):
    h, a = F.col("home"), F.col("away")
    env = {"temp": F.lit(15.0) + h % 20, "humidity": F.lit(40.0) + a % 50, "altitude": h * 80.0, "wind": a * 1.0, "rain": h % 4 * 1.0, "roof": a % 5 == 0}
    pen = M.environment_penalty(env["temp"], env["humidity"], env["altitude"], env["roof"], F.lit(20.0), F.lit(60.0))
    drag = M.weather_drag(env["temp"], env["wind"], env["rain"], env["altitude"], env["roof"])
    out = M.expected_goals(M.with_ratings(t.match.select("home", "away").distinct(), t.rating), home_env=pen, drag=drag)
    return out.withColumns({"penalty": pen, "drag": drag, "env_xg": F.col("home_xg")})


@query("score_matrix", "home:l away:l h:l a:l prob:d", "SELECT x.* FROM v_matrix x SEMI JOIN v_match m ON m.home = x.home AND m.away = x.away")
def score_matrix(t: Tables):
    return M.score_matrix(xg(t), ["home", "away"])


PROBS = [n for n, *_ in M.MARKETS]


@query("outcome_probs", "match_id:l " + " ".join(f"{n}:d" for n in PROBS), "SELECT * FROM v_prob")
def outcome_probs(t: Tables):
    return t.prob


@query("market_map", "home:l away:l market:s selection:s model_prob:d", f"""SELECT x.home, x.away, unnest({[m for _, m, _, _ in M.MARKETS]}) AS market, unnest({[s for _, _, s, _ in M.MARKETS]}) AS selection, unnest([{', '.join(PROBS)}]) AS model_prob
    FROM v_outcome x SEMI JOIN v_match m ON m.home = x.home AND m.away = x.away""")
def market_map(t: Tables):
    return M.market_rows(M.outcome_probabilities(score_matrix(t), ["home", "away"]), ["home", "away"])


@query("goal_distribution", "home:l away:l side:s goals:l prob:d", "SELECT home, away, side, goals, sum(prob) AS prob FROM (SELECT x.home, x.away, prob, unnest(['home', 'away', 'total']) AS side, unnest([h, a, h + a]) AS goals FROM v_matrix x SEMI JOIN v_match m ON m.home = x.home AND m.away = x.away) GROUP BY 1, 2, 3, 4")
def goal_distribution(t: Tables):
    return M.goal_distribution(score_matrix(t), ["home", "away"])


@query("top_scorelines", "home:l away:l place:l prob:d", "SELECT * FROM (SELECT x.home, x.away, prob, row_number() OVER (PARTITION BY x.home, x.away ORDER BY prob DESC, h, a) AS place FROM v_matrix x SEMI JOIN v_match m ON m.home = x.home AND m.away = x.away) WHERE place <= 8")
def top_scorelines(t: Tables):
    return M.top_scorelines(score_matrix(t), ["home", "away"])


@query("score_timeline", "home:l away:l minute:l home_scored:d away_scored:d", "SELECT x.home, x.away, minute, 1 - exp(-home_xg * (85e-2 * minute / 9e1 + 15e-2 * (minute / 9e1) * (minute / 9e1))) AS home_scored, 1 - exp(-away_xg * (85e-2 * minute / 9e1 + 15e-2 * (minute / 9e1) * (minute / 9e1))) AS away_scored FROM v_xg x SEMI JOIN v_match m ON m.home = x.home AND m.away = x.away, range(0, 91, 5) AS r(minute)")
def score_timeline(t: Tables):
    return M.goal_timeline(xg(t), ["home", "away"])


def one_x_two(t: Tables):
    return M.market_rows(t.prob, ["match_id"]).where("market = '1X2'")


@query("alpha_decimal", "match_id:l selection:s model_prob:d fair_odds:d market_odds:d alpha_ev:d", """SELECT p.match_id, p.selection, p.model_prob, 1 / p.model_prob AS fair_odds, CASE WHEN odds > 1 THEN odds END AS market_odds, p.model_prob * CASE WHEN odds > 1 THEN odds END - 1 AS alpha_ev
    FROM (SELECT match_id, unnest(['Home', 'Draw', 'Away']) AS selection, unnest([home_win, draw, away_win]) AS model_prob FROM v_prob) p LEFT JOIN v_odds o USING (match_id, selection)""")
def alpha_decimal(t: Tables):
    return M.decimal_edges(one_x_two(t), t.odds, ["match_id"])


@query("benchmark_odds_fill", "match_id:l selection:s odds:d odds_source:s", """SELECT p.match_id, p.selection, CASE WHEN odds > 1 THEN odds ELSE 1 / p.model_prob END AS odds, CASE WHEN odds > 1 THEN 'market' ELSE 'generated' END AS odds_source
    FROM (SELECT match_id, unnest(['Home', 'Draw', 'Away']) AS selection, unnest([home_win, draw, away_win]) AS model_prob FROM v_prob) p LEFT JOIN v_odds o USING (match_id, selection)""")
def benchmark_fill(t: Tables):
    return M.fill_benchmark_odds(t.odds, one_x_two(t).withColumn("odds", 1 / F.col("model_prob")), ["match_id", "market", "selection"])


@query("devig_1x2", "match_id:l market_home:d market_draw:d market_away:d", "SELECT * FROM v_devig")
def devig(t: Tables):
    return M.devig(t.odds)


QUOTES = """SELECT match_id, home_win, CASE WHEN match_id % 2 = 0 THEN home_win ELSE 1 - home_win END AS p, (5 + match_id % 90) / 1e2 AS price, match_id % 700 * 1e0 AS liquidity,
    CASE match_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'manual' WHEN 2 THEN 'medium' ELSE 'low' END AS mapping FROM v_prob"""


def quotes(t: Tables):
    m = F.col("match_id")
    mapping = F.element_at(F.array(*map(F.lit, ("high", "manual", "medium", "low"))), (m % 4 + 1).cast("int"))
    rows = t.prob.select("match_id", F.col("home_win").alias("model_prob"), F.when(m % 2 == 0, "YES").otherwise("NO").alias("side"), (m % 90 + 5).cast("double").alias("price"), (m % 700).cast("double").alias("liquidity"), mapping.alias("mapping"))
    rows = rows.withColumns({"warning": F.when(m % 9 == 0, "market closed").otherwise(""), "model_confidence": F.when(m % 6 == 0, "Low").otherwise("High"), "calibrated": m % 3 != 0, "supported": m % 5 != 0, "behavior_delta": F.when(m % 8 == 0, 0.2)})
    return K.edges(rows)


@query("alpha_cents", "match_id:l fair_cents:d price_cents:d gap_cents:d alpha_ev:d", f"SELECT match_id, p * 100 AS fair_cents, price * 100 AS price_cents, (p - price) * 100 AS gap_cents, p / price - 1 AS alpha_ev FROM ({QUOTES})")
def alpha_cents(t: Tables):
    return quotes(t)


@query("signal_policy", "match_id:l signal:s reasons:s", f"""SELECT match_id, CASE WHEN gap < 3 OR closed OR illiquid THEN 'No trade' WHEN why <> '' THEN 'Watchlist' WHEN gap >= 8 THEN 'Strong edge' WHEN gap >= 5 THEN 'Small edge' ELSE 'Watchlist' END AS signal,
    CASE WHEN gap <= 0 THEN 'non-positive model gap' WHEN gap < 3 THEN 'gap below watchlist threshold' ELSE why END AS reasons FROM (SELECT *, concat_ws('; ', CASE WHEN closed THEN 'unresolved mapping or price status' END, CASE WHEN illiquid THEN 'insufficient liquidity' END,
    CASE WHEN mapping NOT IN ('high', 'manual') THEN 'mapping confidence below high/manual' END, CASE WHEN match_id % 6 = 0 THEN 'low model confidence' END, CASE WHEN match_id % 3 = 0 THEN 'calibrated probability unavailable' END,
    CASE WHEN match_id % 5 = 0 THEN 'insufficient historical support' END, CASE WHEN match_id % 8 = 0 THEN 'large behavior disagreement' END, CASE WHEN gap >= 20 AND match_id % 5 = 0 THEN 'extreme model-market gap without validation' END) AS why
    FROM (SELECT *, (p - price) * 100 AS gap, match_id % 9 = 0 AS closed, liquidity < 100 AS illiquid FROM ({QUOTES})))""")
def signal_policy(t: Tables):
    return K.signals(quotes(t))


@query("market_groups", "home:l away:l grp:s n:l total:d", f"""SELECT home, away, grp, count(*) AS n, sum(model_prob) AS total FROM (SELECT home, away, model_prob, CASE WHEN (market = 'Total' AND selection LIKE 'Over%') OR (market = 'BTTS' AND selection = 'Yes') THEN 'High Scoring'
    WHEN (market = 'Total' AND selection LIKE 'Under%') OR (market = 'BTTS' AND selection = 'No') THEN 'Low Scoring' WHEN selection = 'Draw' THEN 'Other Markets' WHEN selection LIKE 'Away%' OR selection = 'Draw/Away' THEN 'Result Away' ELSE 'Result Home' END AS grp
    FROM (SELECT x.home, x.away, unnest({[m for _, m, _, _ in M.MARKETS]}) AS market, unnest({[s for _, _, s, _ in M.MARKETS]}) AS selection, unnest([{', '.join(PROBS)}]) AS model_prob FROM v_outcome x SEMI JOIN v_match m ON m.home = x.home AND m.away = x.away)) GROUP BY 1, 2, 3""")
def market_groups(t: Tables):
    return market_map(t).withColumn("grp", K.group_of(F.col("market"), F.col("selection"))).groupBy("home", "away", "grp").agg(F.count("*").alias("n"), F.sum("model_prob").alias("total"))


@query("edge_scores", "match_id:l ev_score:l gap_score:l", f"""SELECT match_id, CASE WHEN ev > 0 THEN trunc(least(100, ev * 400)) ELSE 0 END AS ev_score, CASE WHEN gap > 0 THEN trunc(least(100, gap * 10 * CASE WHEN mapping IN ('high', 'manual') THEN 1e0 WHEN mapping = 'low' THEN 65e-2 ELSE 75e-2 END * greatest(35e-2, least(1e0, liquidity / 500)))) ELSE 0 END AS gap_score
    FROM (SELECT *, p / price - 1 AS ev, (p - price) * 100 AS gap FROM ({QUOTES}))""")
def edge_scores(t: Tables):
    return quotes(t).withColumns({"ev_score": K.ev_score(F.col("alpha_ev")), "gap_score": K.gap_score(F.col("gap_cents"), F.col("mapping"), F.col("liquidity"))})


@query("backtest_metrics", f"{METRIC} mean_probability_of_actual:d total_goals_mae:d", f"SELECT {METRIC_SQL}, avg(greatest(1e-3, least(999e-3, p_actual))) AS mean_probability_of_actual, avg(abs(home_xg + away_xg - hg - ag)) AS total_goals_mae FROM v_prob")
def backtest_metrics(t: Tables):
    return E.backtest_metrics(t.prob)


OVR = "SELECT match_id, comp_type, unnest(['home_win', 'draw', 'away_win']) AS outcome, unnest([home_win, draw, away_win]) AS p, actual FROM v_prob"
BIN = "CASE WHEN p <= 2e-1 THEN '0.00-0.20' WHEN p <= 4e-1 THEN '0.20-0.40' WHEN p <= 6e-1 THEN '0.40-0.60' WHEN p <= 8e-1 THEN '0.60-0.80' ELSE '0.80-1.00' END"
BINNED = f"SELECT *, {BIN} AS bin, CASE WHEN outcome = actual THEN 1e0 ELSE 0e0 END AS y FROM ({OVR})"
BIN_COLUMNS = "bin:s n:l avg_p:d observed:d calibration_error:d"


@query("calib_bins_all", BIN_COLUMNS, f"SELECT b AS bin, coalesce(n, 0) AS n, avg_p, observed, abs(avg_p - observed) AS calibration_error FROM unnest({E.BINS}) AS u(b) LEFT JOIN (SELECT bin, count(*) AS n, avg(p) AS avg_p, avg(y) AS observed FROM ({BINNED}) GROUP BY 1) ON bin = b")
def calib_bins_all(t: Tables):
    return E.calibration_bins(t.prob, empties=True)


@query("calib_bins_nonempty", f"outcome:s {BIN_COLUMNS}", f"SELECT outcome, bin, count(*) AS n, avg(p) AS avg_p, avg(y) AS observed, abs(avg(p) - avg(y)) AS calibration_error FROM ({BINNED}) GROUP BY 1, 2")
def calib_bins(t: Tables):
    return E.calibration_bins(t.prob, "outcome")


@query("ece_pooled", "comp_type:s n:l ece:d", f"SELECT comp_type, sum(n) AS n, sum(n * e) / sum(n) AS ece FROM (SELECT comp_type, bin, count(*) AS n, abs(avg(p) - avg(y)) AS e FROM ({BINNED}) GROUP BY 1, 2) GROUP BY 1")
def ece_pooled(t: Tables):
    return E.expected_calibration_error(t.prob, "comp_type")


@query("ece_by_outcome", "n:l ece:d", f"SELECT sum(n) AS n, sum(n * e) / sum(n) AS ece FROM (SELECT outcome, bin, count(*) AS n, abs(avg(p) - avg(y)) AS e FROM ({BINNED}) GROUP BY 1, 2)")
def ece_by_outcome(t: Tables):
    return E.expected_calibration_error(t.prob, per_outcome=True)


@query("calib_slope", "comp_type:s n:l slope:d intercept:d", "SELECT comp_type, count(*) AS n, regr_slope(hit, x) AS slope, regr_intercept(hit, x) AS intercept FROM (SELECT comp_type, hit, greatest(1e-3, least(999e-3, p_actual)) AS q, ln(q / (1 - q)) AS x FROM v_prob) GROUP BY 1")
def calib_slope(t: Tables):
    return E.calibration_line(t.prob, "comp_type")


@query("perf_by_dimension", f"band:s {METRIC}", f"SELECT CASE WHEN f < 4e-1 THEN '0.00-0.40' WHEN f < 5e-1 THEN '0.40-0.50' WHEN f < 6e-1 THEN '0.50-0.60' WHEN f < 7e-1 THEN '0.60-0.70' ELSE '0.70-1.00' END AS band, {METRIC_SQL} FROM (SELECT *, greatest(home_win, away_win) AS f FROM v_prob) GROUP BY 1")
def perf_by_dimension(t: Tables):
    return E.metrics(t.prob.withColumn("band", C.fine_favorite_band(F.greatest("home_win", "away_win"))), "band")


@query("context_grouping_sets", f"dimension:s segment:s {METRIC}", f"""SELECT dimension, segment, {METRIC_SQL} FROM (SELECT hit, brier, log_loss, unnest(['comp_type', 'neutral', 'draw_band']) AS dimension, unnest([comp_type, CASE WHEN neutral THEN 'true' ELSE 'false' END, {BIN}]) AS segment FROM (SELECT *, draw AS p FROM v_prob)) GROUP BY 1, 2""")
def contexts(t: Tables):
    return E.by_contexts(t.prob.withColumn("draw_band", C.right_closed_bin(F.col("draw"))), ["comp_type", "neutral", "draw_band"])


@query("model_vs_market", "segment:s n:l brier:d market_brier:d log_loss:d market_log_loss:d", """SELECT segment, count(*) AS n, avg(brier) AS brier, avg(mb) AS market_brier, avg(log_loss) AS log_loss, avg(ml) AS market_log_loss FROM (SELECT *, unnest(['all', CASE WHEN gap < 5 THEN 'agree_under_5pp' WHEN gap < 10 THEN 'disagree_5_10pp' WHEN gap < 20 THEN 'disagree_10_20pp' ELSE 'disagree_over_20pp' END]) AS segment FROM (
    SELECT p.*, pow(market_home - CASE WHEN actual = 'home_win' THEN 1 ELSE 0 END, 2) + pow(market_draw - CASE WHEN actual = 'draw' THEN 1 ELSE 0 END, 2) + pow(market_away - CASE WHEN actual = 'away_win' THEN 1 ELSE 0 END, 2) AS mb,
    -ln(greatest(1e-3, least(999e-3, CASE actual WHEN 'home_win' THEN market_home WHEN 'draw' THEN market_draw ELSE market_away END))) AS ml, 100 * greatest(abs(home_win - market_home), abs(draw - market_draw), abs(away_win - market_away)) AS gap
    FROM v_prob p JOIN v_devig d USING (match_id) WHERE market_home IS NOT NULL)) GROUP BY 1""")
def model_vs_market(t: Tables):
    return E.model_vs_market(t.prob.join(M.devig(t.odds), "match_id"))


@query("worst_misses", "match_id:l log_loss:d brier:d top_pick:s actual:s", "SELECT * FROM v_prob ORDER BY round(log_loss, 9) DESC, round(brier, 9) DESC, match_id LIMIT 20")
def worst_misses(t: Tables):
    p = t.prob.withColumns({"log_loss": F.round("log_loss", 9), "brier": F.round("brier", 9)})
    return E.worst(p)


@query("postmortem_summary", f"actual:s top_pick:s {METRIC}", f"SELECT actual, top_pick, {METRIC_SQL} FROM v_prob GROUP BY 1, 2")
def postmortem(t: Tables):
    return E.metrics(t.prob, "actual", "top_pick")


@query("team_errors", f"team:l {METRIC}", f"SELECT team, {METRIC_SQL} FROM (SELECT *, unnest([home, away]) AS team FROM v_prob) GROUP BY 1")
def team_errors(t: Tables):
    return E.metrics(t.prob.select("hit", "brier", "log_loss", F.explode(F.array("home", "away")).alias("team")), "team")


def two_modes(t: Tables):
    h, d, a = M.scale_temperature(F.col("home_win"), F.col("draw"), F.col("away_win"), F.lit(1.5))
    cooled = E.scored(t.prob.withColumns({"_h": h, "_d": d, "_a": a}).withColumns({"home_win": F.col("_h"), "draw": F.col("_d"), "away_win": F.col("_a")}))
    return t.prob.select("match_id", "p_actual", F.lit("base").alias("mode")).unionByName(cooled.select("match_id", "p_actual", F.lit("cooled").alias("mode")))


COOLED = "SELECT match_id, p_actual AS base_p, CASE actual WHEN 'home_win' THEN eh WHEN 'draw' THEN ed ELSE ea END / (eh + ed + ea) AS other_p, eh / (eh + ed + ea) AS home, ed / (eh + ed + ea) AS draw, ea / (eh + ed + ea) AS away FROM (SELECT *, pow(greatest(1e-6, home_win), 1 / 15e-1) AS eh, pow(greatest(1e-6, draw), 1 / 15e-1) AS ed, pow(greatest(1e-6, away_win), 1 / 15e-1) AS ea FROM v_prob)"


@query("compare_modes", "match_id:l base_p:d other_p:d delta:d improved:b note:s", f"SELECT *, other_p - base_p AS delta, delta > 0 AS improved, CASE WHEN delta > 5e-4 THEN 'improved' WHEN delta < -5e-4 THEN 'lowered' ELSE 'no material difference' END AS note FROM ({COOLED})")
def compare_modes(t: Tables):
    return E.compare_modes(two_modes(t), "base", "cooled")


@query("temperature_scale", "match_id:l home:d draw:d away:d", COOLED)
def temperature(t: Tables):
    h, d, a = M.scale_temperature(F.col("home_win"), F.col("draw"), F.col("away_win"), F.lit(1.5))
    return t.prob.select("match_id", h.alias("home"), d.alias("draw"), a.alias("away"))


#: fixed values: parameter sets as (name, draw inflation, favourite scale, underdog scale)
SETS = [("baseline", 1.0, 1.0, 1.0), ("draw_0.90", 0.9, 1.0, 1.0), ("draw_1.10", 1.1, 1.0, 1.0), ("draw_1.20", 1.2, 1.0, 1.0), ("favorite_0.85", 1.0, 0.85, 1.0), ("favorite_1.15", 1.0, 1.15, 1.0), ("underdog_0.90", 1.0, 1.0, 0.9), ("underdog_1.10", 1.0, 1.0, 1.1)]


def sweep(t: Tables):
    """Every match under every set; the sets are a few literal rows in the plan, so nothing is joined."""
    sets = F.inline(F.array(*[F.struct(F.lit(n).alias("parameter_set"), F.lit(d).alias("di"), F.lit(f).alias("fs"), F.lit(u).alias("us")) for n, d, f, u in SETS]))
    rows = t.prob.select("match_id", "home_win", "draw", "away_win", "over_2_5", "hg", "ag", "actual", sets)
    h, d, a = M.adjust(F.col("home_win"), F.col("draw"), F.col("away_win"), F.col("di"), F.col("fs"), F.col("us"))
    rows = rows.withColumns({"_h": h, "_d": d, "_a": a}).withColumns({"home_win": F.col("_h"), "draw": F.col("_d"), "away_win": F.col("_a")})
    over = F.avg(F.pow(F.col("over_2_5") - F.when(F.expr("hg + ag > 2.5"), 1.0).otherwise(0.0), 2)).alias("over_2_5_brier")
    return E.scored(rows).groupBy("parameter_set").agg(F.count("*").alias("n"), F.avg("brier").alias("brier_score"), F.avg("log_loss").alias("multiclass_log_loss"), over)


_SETS = ", ".join(f"('{n}', {d}::double, {f}::double, {u}::double)" for n, d, f, u in SETS)
SWEEP = f"""SELECT parameter_set, count(*) AS n, avg(pow(h / s - CASE WHEN actual = 'home_win' THEN 1 ELSE 0 END, 2) + pow(d / s - CASE WHEN actual = 'draw' THEN 1 ELSE 0 END, 2) + pow(a / s - CASE WHEN actual = 'away_win' THEN 1 ELSE 0 END, 2)) AS brier_score,
    avg(-ln(greatest(1e-3, least(999e-3, CASE actual WHEN 'home_win' THEN h WHEN 'draw' THEN d ELSE a END / s)))) AS multiclass_log_loss, avg(pow(over_2_5 - CASE WHEN hg + ag > 2.5 THEN 1e0 ELSE 0e0 END, 2)) AS over_2_5_brier
    FROM (SELECT *, greatest(1e-3, home_win * CASE WHEN home_win >= away_win THEN fs ELSE us END) AS h, greatest(1e-3, draw * di) AS d, greatest(1e-3, away_win * CASE WHEN home_win >= away_win THEN us ELSE fs END) AS a, h + d + a AS s FROM v_prob, (VALUES {_SETS}) AS x(parameter_set, di, fs, us)) GROUP BY 1"""
SWEEP_COLUMNS = "parameter_set:s n:l brier_score:d multiclass_log_loss:d over_2_5_brier:d"


@query("param_sweep", SWEEP_COLUMNS, SWEEP)
def param_sweep(t: Tables):
    return sweep(t)


@query("promotion_gate", "parameter_set:s status:s", f"""SELECT s.parameter_set, CASE WHEN s.parameter_set = 'baseline' THEN 'baseline' WHEN s.n < 30 THEN 'sample_too_small' WHEN s.brier_score < b.brier_score AND s.multiclass_log_loss < b.multiclass_log_loss AND s.over_2_5_brier <= b.over_2_5_brier * 105e-2 THEN 'promoted' ELSE 'not_promoted' END AS status
    FROM ({SWEEP}) s, ({SWEEP}) b WHERE b.parameter_set = 'baseline'""")
def promotion_gate(t: Tables):
    return E.promotion(sweep(t), "baseline")


@query("robustness", "match_id:l supporting:l robustness:s", f"SELECT match_id, n AS supporting, CASE WHEN n >= 2 THEN 'robust' ELSE 'unstable' END AS robustness FROM (SELECT match_id, (p * 9e-1 > price)::int + (p > price)::int + (p * 11e-1 > price)::int AS n FROM ({QUOTES}))")
def robustness(t: Tables):
    scaled = F.explode(F.array(F.lit(0.9), F.lit(1.0), F.lit(1.1))).alias("scale")
    rows = quotes(t).select("match_id", "fair_cents", "price_cents", scaled).withColumn("fair_cents", F.col("fair_cents") * F.col("scale"))
    return K.robust(rows, ["match_id"])


BLENDS = (0.0, 0.25, 0.5, 1.0)
BLENDED = "SELECT x.w AS blend, p.match_id, p.home, p.away, p.actual, (1 - x.w) * home_win + x.w / 3 AS h, (1 - x.w) * draw + x.w / 3 AS d, (1 - x.w) * away_win + x.w / 3 AS a, CASE actual WHEN 'home_win' THEN h WHEN 'draw' THEN d ELSE a END AS pa FROM v_prob p, (VALUES (0e0), (25e-2), (5e-1), (1e0)) AS x(w)"


def blended(t: Tables):
    w = F.explode(F.array(*map(F.lit, BLENDS))).alias("blend")
    rows = t.prob.select("match_id", "home", "away", "actual", "home_win", "draw", "away_win", w)
    return E.scored(rows.withColumns({c: (1 - F.col("blend")) * F.col(c) + F.col("blend") / 3 for c in E.P}))


@query("blend_sensitivity", "blend:d n:l brier_score:d log_loss:d rank_by_brier:l rank_by_log_loss:l", f"""SELECT *, rank() OVER (ORDER BY brier_score) AS rank_by_brier, rank() OVER (ORDER BY log_loss) AS rank_by_log_loss FROM (SELECT blend, count(*) AS n, avg(-ln(greatest(1e-3, least(999e-3, pa)))) AS log_loss,
    avg(pow(h - CASE WHEN actual = 'home_win' THEN 1 ELSE 0 END, 2) + pow(d - CASE WHEN actual = 'draw' THEN 1 ELSE 0 END, 2) + pow(a - CASE WHEN actual = 'away_win' THEN 1 ELSE 0 END, 2)) AS brier_score FROM ({BLENDED}) GROUP BY 1)""")
def blend_sensitivity(t: Tables):
    from pyspark.sql import Window

    m = blended(t).groupBy("blend").agg(F.count("*").alias("n"), F.avg("brier").alias("brier_score"), F.avg("log_loss").alias("log_loss"))
    return m.withColumns({"rank_by_brier": F.rank().over(Window.orderBy("brier_score")), "rank_by_log_loss": F.rank().over(Window.orderBy("log_loss"))})


@query("team_sensitivity", "team:l best_blend:d best_p:d base_p:d", f"SELECT team, arg_max(blend, struct_pack(p := round(p, 9), o := -blend)) AS best_blend, max(p) AS best_p, max(p) FILTER (blend = 0) AS base_p FROM (SELECT team, blend, avg(pa) AS p FROM (SELECT *, unnest([home, away]) AS team FROM ({BLENDED})) GROUP BY 1, 2) GROUP BY 1")
def team_sensitivity(t: Tables):
    by = blended(t).select("blend", "p_actual", F.explode(F.array("home", "away")).alias("team")).groupBy("team", "blend").agg(F.avg("p_actual").alias("p"))
    return by.groupBy("team").agg(F.max_by("blend", F.struct(F.round("p", 9), -F.col("blend"))).alias("best_blend"), F.max("p").alias("best_p"), F.max(F.when(F.col("blend") == 0, F.col("p"))).alias("base_p"))


_LOST = ", ".join(f"round(sum(-ln(greatest(1e-3, least(999e-3, (1 - {w}e0) * i.p_actual + {w}e0 * CASE i.actual WHEN 'home_win' THEN t.bh WHEN 'draw' THEN t.bd ELSE t.ba END)))) / count(*), 9)" for w in [0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5])


def calibrated(t: Tables):
    """Scored rows with market probabilities, and derived values for disagreement and confidence."""
    rows = t.prob.select("match_id", "match_date", *E.P, "actual")
    market = M.devig(t.odds)
    i = F.col("match_id")
    return rows.join(market, "match_id", "left").withColumns({"disagreement": (i * 7 % 45).cast("double"), "high": i % 3 == 0})


@query("walk_forward_calib", "match_id:l weight:d home_win:d draw:d away_win:d", f"""WITH c AS (SELECT *, row_number() OVER o AS rn, 1 + coalesce(sum((actual = 'home_win')::int) OVER w, 0) AS nh, 1 + coalesce(sum((actual = 'draw')::int) OVER w, 0) AS nd, 1 + coalesce(sum((actual = 'away_win')::int) OVER w, 0) AS na FROM v_prob WINDOW o AS (ORDER BY match_date, match_id), w AS (ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    n AS MATERIALIZED (SELECT *, nh / (nh + nd + na) AS bh, nd / (nh + nd + na) AS bd, na / (nh + nd + na) AS ba FROM c), f AS (SELECT t.rn, [{_LOST}] AS lost FROM n t JOIN n i ON i.rn < t.rn WHERE t.rn > 30 GROUP BY t.rn)
    SELECT match_id, w AS weight, (1 - w) * home_win + w * bh AS home_win, (1 - w) * draw + w * bd AS draw, (1 - w) * away_win + w * ba AS away_win FROM (SELECT n.*, (list_position(lost, list_min(lost)) - 1) / 2e1 AS w FROM n JOIN f USING (rn))""")
def walk_forward(t: Tables):
    fitted = W.walk_forward(calibrated(t))
    return fitted.select("match_id", F.col("shrinkage").alias("weight"), *[F.col(f"v2_{c}").alias(c) for c in E.P])


@query("calibration_variants", "match_id:l model:s home_win:d draw:d away_win:d brier:d log_loss:d", None)
def calibration_variants(t: Tables):
    rows = calibrated(t)
    return W.variants(W.walk_forward(rows), rows)


@query("calibration_metrics", "model:s n:l brier_score:d log_loss:d top_pick_accuracy:d brier_delta:d log_loss_delta:d status:s", None)
def calibration_metrics(t: Tables):
    rows = calibrated(t)
    return W.variant_metrics(W.variants(W.walk_forward(rows), rows))


@query("goal_stats_by_comp", "comp_type:s n:l goals_mean:d over_share:d btts_share:d draw_share:d", "SELECT comp_type, count(*) AS n, avg(hg + ag) AS goals_mean, avg((hg + ag >= 3)::int) AS over_share, avg((hg > 0 AND ag > 0)::int) AS btts_share, avg((hg = ag)::int) AS draw_share FROM v_match GROUP BY 1")
def goal_stats(t: Tables):
    share = lambda e: F.avg(F.expr(e).cast("int"))
    return t.match.groupBy("comp_type").agg(F.count("*").alias("n"), F.avg(F.expr("hg + ag")).alias("goals_mean"), share("hg + ag >= 3").alias("over_share"), share("hg > 0 and ag > 0").alias("btts_share"), share("hg = ag").alias("draw_share"))
