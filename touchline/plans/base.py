"""Catalogue of queries: a Spark plan, the SQL that gives the same rows, and the columns that both return."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"l": "bigint", "d": "double", "s": "string", "b": "boolean", "t": "date", "x": "timestamp_ntz"}
SQL_TYPES = TYPES | {"s": "varchar", "x": "timestamp"}


@dataclass(frozen=True)
class Query:
    columns: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def _columns(self) -> list[tuple[str, str]]:
        return [tuple(c.rsplit(":", 1)) for c in self.columns.split()]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The plan's columns in their sink types: numbers of 64 bits, doubles rounded to 6 places (never -0)."""
        out = self.plan(Tables(spark, sf_dir))
        col = lambda n, t: F.round(F.col(n).cast("double"), 6) + 0.0 if t == "d" else F.col(n).cast(TYPES[t])
        return out.select(*[col(n, t).alias(n) for n, t in self._columns()])

    def oracle(self, views: dict[str, str]) -> str | None:
        if self.sql is None:
            return None
        col = lambda n, t: f"round(CAST({n} AS DOUBLE), 6) + 0.0 AS {n}" if t == "d" else f"CAST({n} AS {SQL_TYPES[t]}) AS {n}"
        used: list[str] = []

        def need(text: str) -> None:
            for name, body in views.items():
                if name not in used and re.search(rf"\b{name}\b", text):
                    need(body)
                    used.append(name)

        need(self.sql)
        ctes = ", ".join(f"{n} AS {'MATERIALIZED ' if n in MATERIALIZED else ''}({views[n]})" for n in used)
        recursive = "RECURSIVE " if any("UNION ALL" in views[n] for n in used) or "UNION ALL" in self.sql else ""
        return (f"WITH {recursive}{ctes} " if ctes else "") + f"SELECT {', '.join(col(n, t) for n, t in self._columns())} FROM ({self.sql}) AS q"


CATALOG: dict[str, Query] = {}
#: views that are made once in a query's SQL
MATERIALIZED = {"v_numbered", "v_elo", "v_prob"}


def query(name: str, columns: str, sql: str | None):
    def add(plan: Callable[[Tables], DataFrame]):
        CATALOG[name] = Query(columns, plan, sql)
        return plan

    return add


class Tables:
    """The tables of a folder, and the deterministic match data that the catalogue derives from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        from ..sources.session import importable

        importable(spark)
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str, **tables: DataFrame) -> DataFrame:
        return self.spark.sql(text, **tables)

    @property
    def match(self) -> DataFrame:
        return self.match_of(self("orders"))

    def match_of(self, o: DataFrame) -> DataFrame:
        """Matches derived from orders, read as a table or as a stream."""
        kind = F.element_at(F.array(*map(F.lit, KINDS)), F.substring("o_orderpriority", 1, 1).cast("int"))
        m = o.select(
            F.col("o_orderkey").alias("match_id"),
            F.col("o_orderdate").cast("date").alias("match_date"),
            (F.col("o_custkey") % 32).alias("home"),
            ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 32).alias("away"),
            (F.floor("o_totalprice") % 5).alias("hg"),
            (F.floor(F.col("o_totalprice") / 7) % 4).alias("ag"),
            kind.alias("comp_type"),
            (F.col("o_orderstatus") == "P").alias("neutral"),
        )
        return m.where("home <> away")

    @property
    def team_match(self) -> DataFrame:
        from ..operators.timeseries import wide_to_long

        return wide_to_long(self.match)

    @property
    def rating(self) -> DataFrame:
        team = self("customer").select((F.col("c_custkey") % 32).alias("team")).distinct()
        part = lambda k: F.lit(0.35) + F.col("team") * k % 50 / F.lit(100.0)
        return team.select("team", (F.lit(1400.0) + F.col("team") * 97 % 600).alias("elo"), part(7).alias("attack"), part(11).alias("defense"), part(17).alias("form"))

    @property
    def prob(self) -> DataFrame:
        from ..functions import columns as C
        from ..operators.evaluation import scored
        from ..operators.model import predict

        return scored(predict(self.match, self.rating).withColumn("actual", C.outcome(F.col("hg"), F.col("ag"))))

    @property
    def odds(self) -> DataFrame:
        """Synthetic decimal odds on 1X2; some are missing or not valid."""
        o = self.match.select("match_id", F.inline(F.array(*[F.struct(F.lit("1X2").alias("market"), F.lit(s).alias("selection"), F.expr(e).alias("odds")) for s, e in ODDS])))
        return o.where("match_id % 11 <> 3 or selection <> 'Draw'")

    @property
    def history(self) -> DataFrame:
        """Team matches with both ratings, residuals and weights as of REFERENCE."""
        from ..operators.behavior import residuals, weigh

        r = self.rating.select("team", "elo")
        rows = self.team_match.join(r.withColumnRenamed("elo", "team_elo"), "team").join(r.withColumnsRenamed({"team": "opponent", "elo": "opponent_elo"}), "opponent")
        return weigh(residuals(rows), F.to_date(F.lit(REFERENCE)))


#: fixed values of the match data that is derived from the tables
KINDS = ["world_cup", "world_cup_qualifier", "continental_tournament", "nations_league", "friendly"]
ODDS = [("Home", "1 + match_id % 17 / 4D"), ("Draw", "2.5D + match_id % 7 / 5D"), ("Away", "1 + match_id % 13 / 3D")]
REFERENCE = "2001-08-01"

_KINDS = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS, 1))
VIEWS = {
    "v_match": f"""SELECT * FROM (SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS match_date, o_custkey % 32 AS home, (o_custkey * 7 + o_orderkey) % 32 AS away,
        CAST(floor(o_totalprice) AS BIGINT) % 5 AS hg, CAST(floor(o_totalprice / 7) AS BIGINT) % 4 AS ag,
        CASE CAST(substr(o_orderpriority, 1, 1) AS INT) {_KINDS} END AS comp_type, o_orderstatus = 'P' AS neutral FROM orders) WHERE home <> away""",
    "v_team": """SELECT match_id, match_date, comp_type, neutral, home AS team, away AS opponent, TRUE AS is_home, hg AS team_goals, ag AS opponent_goals FROM v_match
        UNION ALL BY NAME SELECT match_id, match_date, comp_type, neutral, away AS team, home AS opponent, FALSE AS is_home, ag AS team_goals, hg AS opponent_goals FROM v_match""",
    "v_rating": "SELECT team, 1400e0 + team * 97 % 600 AS elo, 35e-2 + team * 7 % 50 / 1e2 AS attack, 35e-2 + team * 11 % 50 / 1e2 AS defense, 35e-2 + team * 17 % 50 / 1e2 AS form FROM (SELECT DISTINCT c_custkey % 32 AS team FROM customer)",
    "v_xg": """SELECT h.team AS home, a.team AS away, h.elo - a.elo AS elo_diff,
        32e-4 * (h.elo - a.elo) + 55e-2 * (h.attack - 6e-1) - 45e-2 * (a.defense - 6e-1) AS home_rating_log, -32e-4 * (h.elo - a.elo) + 55e-2 * (a.attack - 6e-1) - 45e-2 * (h.defense - 6e-1) AS away_rating_log,
        2e-1 * (h.form - 6e-1) AS home_form_log, 2e-1 * (a.form - 6e-1) AS away_form_log,
        greatest(15e-2, least(38e-1, exp(home_rating_log + home_form_log))) AS home_xg, greatest(15e-2, least(38e-1, exp(away_rating_log + away_form_log))) AS away_xg
        FROM v_rating h, v_rating a WHERE h.team <> a.team""",
    "v_matrix": """SELECT home, away, home_xg, away_xg, h, a, p / sum(p) OVER (PARTITION BY home, away) AS prob FROM (
        SELECT home, away, home_xg, away_xg, h, a, exp(-home_xg) * pow(home_xg, h) / factorial(CAST(h AS INT)) * (exp(-away_xg) * pow(away_xg, a) / factorial(CAST(a AS INT))) AS p
        FROM v_xg, range(8) AS x(h), range(8) AS y(a))""",
    "v_outcome": """SELECT home, away, any_value(home_xg) AS home_xg, any_value(away_xg) AS away_xg,
        sum(prob) FILTER (h > a) AS home_win, sum(prob) FILTER (h = a) AS draw, sum(prob) FILTER (h < a) AS away_win, sum(prob) FILTER (h + a >= 3) AS over_2_5, sum(prob) FILTER (h + a <= 2) AS under_2_5,
        sum(prob) FILTER (h + a >= 4) AS over_3_5, sum(prob) FILTER (h + a <= 3) AS under_3_5, sum(prob) FILTER (h > 0 AND a > 0) AS btts_yes, sum(prob) FILTER (h = 0 OR a = 0) AS btts_no,
        sum(prob) FILTER (h - a >= 2) AS home_minus_1_5, sum(prob) FILTER (h - a < 2) AS away_plus_1_5, sum(prob) FILTER (a - h >= 2) AS away_minus_1_5, sum(prob) FILTER (a - h < 2) AS home_plus_1_5,
        sum(prob) FILTER (h >= a) AS home_or_draw, sum(prob) FILTER (h <= a) AS draw_or_away FROM v_matrix GROUP BY home, away""",
    "v_prob": """SELECT *, CASE actual WHEN 'home_win' THEN home_win WHEN 'draw' THEN draw ELSE away_win END AS p_actual, -ln(greatest(1e-3, least(999e-3, p_actual))) AS log_loss,
        CASE WHEN home_win >= draw AND home_win >= away_win THEN 'home_win' WHEN draw >= away_win THEN 'draw' ELSE 'away_win' END AS top_pick, CASE WHEN top_pick = actual THEN 1e0 ELSE 0e0 END AS hit,
        pow(home_win - CASE WHEN actual = 'home_win' THEN 1e0 ELSE 0e0 END, 2) + pow(draw - CASE WHEN actual = 'draw' THEN 1e0 ELSE 0e0 END, 2) + pow(away_win - CASE WHEN actual = 'away_win' THEN 1e0 ELSE 0e0 END, 2) AS brier
        FROM (SELECT m.*, o.* EXCLUDE (home, away), CASE WHEN hg > ag THEN 'home_win' WHEN hg = ag THEN 'draw' ELSE 'away_win' END AS actual FROM v_match m JOIN v_outcome o USING (home, away))""",
    "v_odds": """SELECT * FROM (SELECT match_id, '1X2' AS market, unnest(['Home', 'Draw', 'Away']) AS selection, unnest([1 + match_id % 17 / 4e0, 25e-1 + match_id % 7 / 5e0, 1 + match_id % 13 / 3e0]) AS odds FROM v_match)
        WHERE match_id % 11 <> 3 OR selection <> 'Draw'""",
    "v_devig": """SELECT match_id, h / (h + d + a) AS market_home, d / (h + d + a) AS market_draw, a / (h + d + a) AS market_away FROM (
        SELECT match_id, max(1 / odds) FILTER (selection = 'Home' AND odds > 1) AS h, max(1 / odds) FILTER (selection = 'Draw' AND odds > 1) AS d, max(1 / odds) FILTER (selection = 'Away' AND odds > 1) AS a FROM v_odds GROUP BY 1)""",
    "v_hist0": """SELECT t.*, r.elo AS team_elo, o.elo AS opponent_elo,
        exp(-greatest(DATE '2001-08-01' - match_date, 0) / 365e0) * CASE comp_type WHEN 'world_cup' THEN 15e-1 WHEN 'world_cup_qualifier' THEN 115e-2 WHEN 'continental_tournament' THEN 125e-2 WHEN 'nations_league' THEN 9e-1 WHEN 'friendly' THEN 45e-2 ELSE 8e-1 END AS w,
        CASE WHEN team_goals > opponent_goals THEN 1e0 WHEN team_goals = opponent_goals THEN 5e-1 ELSE 0e0 END AS score,
        CASE WHEN neutral THEN 0e0 WHEN is_home THEN 35e0 ELSE -35e0 END AS bonus
        FROM v_team t JOIN v_rating r ON r.team = t.team JOIN v_rating o ON o.team = t.opponent""",
    "v_hist": """SELECT *, 1 / (1 + pow(1e1, (opponent_elo - team_elo - bonus) / 400)) AS expected_score, score - expected_score AS result_residual,
        greatest(25e-2, least(35e-1, 135e-2 * exp((team_elo - opponent_elo) / 900))) AS expected_for, greatest(25e-2, least(35e-1, 135e-2 * exp((opponent_elo - team_elo) / 900))) AS expected_against,
        team_goals - expected_for AS for_residual, opponent_goals - expected_against AS against_residual,
        greatest(-175e-2, least(175e-2, for_residual)) AS for_residual_capped, greatest(-175e-2, least(175e-2, against_residual)) AS against_residual_capped,
        CASE WHEN abs(team_goals - opponent_goals) <= 2 THEN 1e0 ELSE greatest(55e-2, least(1e0, 1 / (1 + 35e-2 * (abs(team_goals - opponent_goals) - 2)))) END AS blowout FROM v_hist0""",
    "v_index": """SELECT *, 7e-1 * attack_raw + 3e-1 * attack_residual AS attack_final, 7e-1 * defense_raw + 3e-1 * defense_residual AS defense_final FROM (SELECT *,
        greatest(0e0, least(1e0, (greatest(0e0, least(1e0, goals_for / 265e-2)) * 36e-2 + scoring_rate * 26e-2 + multi_goal_rate * 2e-1) / (36e-2 + 26e-2 + 2e-1))) AS attack_raw,
        greatest(0e0, least(1e0, ((1 - greatest(0e0, least(1e0, goals_against / 255e-2))) * 38e-2 + clean_sheet_rate * 24e-2 + (1 - multi_conceded_rate) * 2e-1) / (38e-2 + 24e-2 + 2e-1))) AS defense_raw,
        greatest(0e0, least(1e0, 5e-1 + for_residual / 3)) AS attack_residual, greatest(0e0, least(1e0, 5e-1 - against_residual / 3)) AS defense_residual,
        greatest(0e0, least(1e0, 55e-2 * greatest(0e0, least(1e0, points_per_match / 3)) + 25e-2 * win_rate + 2e-1 * greatest(0e0, least(1e0, (goal_difference + 2) / 4)))) AS form_index
        FROM (SELECT team, count(*) AS n_matches, sum(least(team_goals, 4) * w) / sum(w) AS goals_for, sum(least(opponent_goals, 4) * w) / sum(w) AS goals_against, sum(w) FILTER (team_goals > 0) / sum(w) AS scoring_rate,
        sum(w) FILTER (team_goals >= 2) / sum(w) AS multi_goal_rate, sum(w) FILTER (opponent_goals = 0) / sum(w) AS clean_sheet_rate, sum(w) FILTER (opponent_goals >= 2) / sum(w) AS multi_conceded_rate,
        sum(w) FILTER (team_goals > opponent_goals) / sum(w) AS win_rate, sum(w) FILTER (team_goals > 0 AND opponent_goals > 0) / sum(w) AS btts_rate, sum(w) FILTER (team_goals + opponent_goals >= 2) / sum(w) AS over_1_5_rate,
        sum(w) FILTER (team_goals + opponent_goals >= 3) / sum(w) AS over_2_5_rate, sum(w) FILTER (team_goals = 0) / sum(w) AS failed_to_score_rate,
        sum(CASE WHEN team_goals > opponent_goals THEN 3 WHEN team_goals = opponent_goals THEN 1 ELSE 0 END * w) / sum(w) AS points_per_match, sum((team_goals - opponent_goals) * w) / sum(w) AS goal_difference,
        sum(for_residual_capped * w * blowout) / sum(w * blowout) AS for_residual, sum(against_residual_capped * w * blowout) / sum(w * blowout) AS against_residual, sum(result_residual * w) / sum(w) AS result_residual
        FROM v_hist GROUP BY team))""",
    "v_numbered": """SELECT match_id, match_date, home, away, hg, ag, CASE WHEN neutral THEN 0e0 ELSE 35e0 END AS bonus, row_number() OVER (ORDER BY match_date, match_id) AS rn,
        greatest(1e0, ln(abs(hg - ag) + 1e0)) * CASE comp_type WHEN 'world_cup' THEN 45e0 WHEN 'world_cup_qualifier' THEN 35e0 WHEN 'continental_tournament' THEN 35e0 WHEN 'nations_league' THEN 25e0 WHEN 'friendly' THEN 15e0 ELSE 20e0 END AS k,
        CASE WHEN hg > ag THEN 1e0 WHEN hg = ag THEN 5e-1 ELSE 0e0 END AS score FROM v_match""",
    "v_elo": """WITH RECURSIVE r AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS match_id, CAST(NULL AS DATE) AS match_date, CAST(0 AS BIGINT) AS home, CAST(0 AS BIGINT) AS away, 0e0 AS home_pre, 0e0 AS away_pre, [1500e0 for i in range(32)] AS st
        UNION ALL SELECT m.rn, m.match_id, m.match_date, m.home, m.away, r.st[m.home + 1], r.st[m.away + 1],
        list_transform(r.st, lambda v, i: greatest(900e0, least(2300e0, v + (CASE WHEN i = m.home + 1 THEN 1 WHEN i = m.away + 1 THEN -1 ELSE 0 END) * greatest(-35e0, least(35e0, m.k * (m.score - 1 / (1 + pow(1e1, (r.st[m.away + 1] - r.st[m.home + 1] - m.bonus) / 400))))))))
        FROM r JOIN v_numbered m ON m.rn = r.rn + 1)
        SELECT rn, match_id, match_date, home, away, home_pre, away_pre, st[home + 1] AS home_post, st[away + 1] AS away_post FROM r WHERE rn > 0""",
    "v_elo_team": """SELECT match_id, match_date, home AS team, away AS opponent, home_pre AS team_pre, home_post AS team_post, away_pre AS opponent_pre, away_post AS opponent_post FROM v_elo
        UNION ALL SELECT match_id, match_date, away, home, away_pre, away_post, home_pre, home_post FROM v_elo""",
}
