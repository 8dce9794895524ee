"""Queries on tables, ledgers, identity, text and tournaments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators import identity as I
from ..operators import markets as K
from ..operators import tables as D
from ..operators import timeseries as S
from ..operators import tournament as G
from ..schemas import conform
from ..sources.readers import parse_report
from ..streaming import ledger as L
from .base import VIEWS, Tables, query


@query("scan_conform", "match_id:s date_utc:t odds:d missing:s", "SELECT CAST(o_orderkey AS VARCHAR) AS match_id, CAST(o_orderdate AS DATE) AS date_utc, o_totalprice AS odds, CAST(NULL AS VARCHAR) AS missing FROM orders")
def scan_conform(t: Tables):
    o = t("orders").withColumnsRenamed({"o_orderkey": "match_id", "o_orderdate": "date_utc", "o_totalprice": "odds"})
    return conform(o, T.StructType.fromDDL("match_id string, date_utc date, odds double, missing string"))


@query("key_normalize", "doc_id:l key:s", r"SELECT doc_id, trim(regexp_replace(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '&', ' and ', 'g'), '[^a-z0-9'']+', ' ', 'g')) AS key FROM documents")
def key_normalize(t: Tables):
    return t("documents").select("doc_id", C.text_key(F.col("text")).alias("key"))


FLAGS = ["1", "true", " Yes ", "no", "0", "closed", "1.0", ""]


@query("coerce_bool", "o_orderkey:l flag:b", "SELECT o_orderkey, o_orderkey % 8 IN (0, 1, 2, 5, 6) AS flag FROM orders")
def coerce_bool(t: Tables):
    text = F.element_at(F.array(*map(F.lit, FLAGS)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return t("orders").select("o_orderkey", C.to_bool(text).alias("flag"))


@query("coerce_float", "event_id:l value:d", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN 75e-1 ELSE 75e-1 END AS value FROM events")
def coerce_float(t: Tables):
    i = F.col("event_id") % 4
    text = F.when(i == 0, F.col("value").cast("string")).when(i == 1, F.lit("n/a")).when(i == 2, F.lit("NaN"))
    return t("events").select("event_id", C.to_double(text, 7.5).alias("value"))


NAMES = ["FIFA World Cup", "World Cup Qualification", "UEFA Euro 2024", "Nations League A", "International Friendly", "Copa America", "Club tour", ""]


@query("comp_type_ladder", "p_partkey:l comp_type:s", """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'world_cup' WHEN 1 THEN 'world_cup_qualifier' WHEN 2 THEN 'continental_tournament' WHEN 3 THEN 'nations_league' WHEN 4 THEN 'friendly' WHEN 5 THEN 'continental_tournament' ELSE 'other' END AS comp_type FROM part""")
def comp_type(t: Tables):
    n = F.lower(F.trim(F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % 8 + 1).cast("int"))))
    cont = n.rlike("european championship|euro|copa america|africa cup|afcon|asian cup|gold cup|concacaf championship|oceania nations cup")
    kind = F.when(n.contains("friendly"), "friendly").when(n.contains("nations league"), "nations_league").when(n.contains("world cup") & n.contains("qualif"), "world_cup_qualifier")
    kind = kind.when(n.contains("fifa world cup") | (n == "world cup"), "world_cup").when(cont, "continental_tournament").otherwise("other")
    return t("part").select("p_partkey", kind.alias("comp_type"))


@query("future_fixture_filter", "match_id:l match_date:t", "SELECT match_id, match_date FROM v_match WHERE match_date BETWEEN DATE '2000-01-01' AND DATE '2000-01-31' AND home <> 5 AND away <> 5")
def future_filter(t: Tables):
    now = F.to_date(F.lit("2000-01-01"))
    placeholder = lambda c: F.concat(F.when(F.col(c) == 5, "Winner Group A").otherwise(F.concat(F.lit("Team "), F.col(c)))).rlike(r"(?i)^(winner|loser|runner-up|3rd|third) (of )?(group|match)\b")
    return t.match.where((F.col("match_date") >= now) & (F.col("match_date") <= F.date_add(now, 30)) & ~placeholder("home") & ~placeholder("away"))


@query("fixture_audit_reason", "match_id:l reason:s", "SELECT match_id, CASE WHEN match_id % 50 = 0 THEN 'invalid_kickoff' WHEN match_date NOT BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' THEN 'outside_window' WHEN match_date < DATE '2000-01-01' THEN 'past' WHEN home = 5 THEN 'unresolved' END AS reason FROM v_match")
def audit_reason(t: Tables):
    day = F.when(F.col("match_id") % 50 != 0, F.col("match_date"))
    d = lambda x: F.to_date(F.lit(x))
    why = F.when(day.isNull(), "invalid_kickoff").when(~day.between(d("1999-01-01"), d("2000-12-31")), "outside_window").when(day < d("2000-01-01"), "past").when(F.col("home") == 5, "unresolved")
    return t.match.select("match_id", why.alias("reason"))


@query("simple_elo", "match_id:l home_post:d away_post:d", """WITH RECURSIVE r AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS match_id, CAST(0 AS BIGINT) AS home, CAST(0 AS BIGINT) AS away, [1700e0 for i in range(32)] AS st
    UNION ALL SELECT m.rn, m.match_id, m.home, m.away, list_transform(r.st, lambda v, i: greatest(1200e0, least(2200e0, v + (CASE WHEN i = m.home + 1 THEN 1 WHEN i = m.away + 1 THEN -1 ELSE 0 END) * 24 * (1 + least(abs(m.hg - m.ag), 4) * 8e-2) * (m.score - 1 / (1 + pow(1e1, (r.st[m.away + 1] - r.st[m.home + 1]) / 400))))))
    FROM r JOIN v_numbered m ON m.rn = r.rn + 1) SELECT match_id, round(st[home + 1], 3) AS home_post, round(st[away + 1], 3) AS away_post FROM r WHERE rn > 0""")
def simple_elo(t: Tables):
    return S.rolling_elo(t.match, S.SIMPLE).withColumns({c: F.round(c, 3) for c in ("home_post", "away_post")})


def with_repeats(t: Tables) -> DataFrame:
    """Matches, a third of them twice, with who supplied them and when."""
    m = t.match
    again = m.where("match_id % 3 = 0").select("match_id", "match_date", "home", "away", (F.col("hg") + 1).alias("hg"), "ag", F.lit("feed").alias("source"), F.date_add("match_date", 2).alias("updated"))
    return m.select("match_id", "match_date", "home", "away", "hg", "ag", F.lit("manual").alias("source"), F.date_add("match_date", 1).alias("updated")).unionByName(again)


REPEATS = "SELECT match_id, match_date, home, away, hg, ag, 'manual' AS source, match_date + 1 AS updated FROM v_match UNION ALL SELECT match_id, match_date, home, away, hg + 1, ag, 'feed', match_date + 2 FROM v_match WHERE match_id % 3 = 0"
KEPT = "match_id:l hg:l source:s"
#: fixed values: target, key and order of preference of each deduplication policy (Spark, SQL)
POLICIES = {
    "historical_merge": (["match_id"], ["source"], "match_id", "source"),
    "historical_ingestion": (["match_id"], ["case when source = 'manual' then 0 else 1 end", "-unix_date(updated)"], "match_id", "source DESC, updated DESC"),
    "completed_results": (["match_id"], ["-unix_date(updated)"], "match_id", "updated DESC"),
    "results_import": (["match_id"], ["-unix_date(updated)", "source"], "match_id", "updated DESC, source"),
    "backtest_pool": (["concat_ws(':', match_date, least(home, away), greatest(home, away))"], ["case when source = 'manual' then 0 else 1 end", "match_id", "hg"], "match_date, least(home, away), greatest(home, away)", "source DESC, match_id, hg"),
    "fixtures": (["concat_ws(':', match_date, home, away)"], ["case when source = 'feed' then 0 else 10 end", "match_id"], "match_date, home, away", "source, match_id"),
    "learning_ledger": (["match_id"], ["-unix_date(updated)"], "match_id", "updated DESC"),
    "market_mapping": (["home", "away"], ["case when source = 'manual' then 0 else 1 end", "-unix_date(match_date)", "-match_id"], "home, away", "source DESC, match_date DESC, match_id DESC"),
    "market_cache": (["home", "away"], ["-unix_date(updated)", "-match_id", "source"], "home, away", "updated DESC, match_id DESC, source"),
    "pdf_backfill": (["home", "away", "hg", "ag"], ["updated", "match_id", "source"], "home, away, hg, ag", "updated, match_id, source"),
    "aliases": (["home"], ["-match_id", "source"], "home", "match_id DESC, source"),
}
for _name, (_keys, _order, _by, _sort) in POLICIES.items():
    query(f"dedup_{_name}", KEPT, f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_by} ORDER BY {_sort}) AS place FROM ({REPEATS})) WHERE place = 1")(
        lambda t, keys=_keys, order=_order: D.keep_one(with_repeats(t), [*map(F.expr, keys)], [*map(F.expr, order)])
    )


@query("dedup_odds", "match_id:l selection:s odds:d", "SELECT match_id, selection, CASE WHEN odds > 1 THEN odds ELSE 2e0 END AS odds FROM v_odds")
def dedup_odds(t: Tables):
    both = t.odds.withColumn("rank", F.when(F.col("odds") > 1, 0).otherwise(2)).unionByName(t.odds.withColumns({"odds": F.lit(2.0), "rank": F.lit(1)}))
    return D.keep_one(both, ["match_id", "market", "selection"], ["rank"])


@query("ledger_upsert", "match_id:l hg:l", "SELECT match_id, CASE WHEN match_id % 3 = 0 THEN hg + 10 ELSE hg END AS hg FROM v_match")
def ledger_upsert(t: Tables):
    m = t.match.select("match_id", "hg")
    return D.upsert(m.where("match_id % 2 = 0 or match_id % 3 = 0"), m.where("match_id % 2 = 1 or match_id % 3 = 0").withColumn("hg", F.when(F.col("match_id") % 3 == 0, F.col("hg") + 10).otherwise(F.col("hg"))), "match_id")


@query("bulk_sync_conflict", "match_id:l hg:l status:s", "SELECT match_id, hg + CASE WHEN match_id % 12 = 0 THEN 1 ELSE 0 END AS hg, CASE match_id % 3 WHEN 2 THEN CASE WHEN match_id % 4 = 0 THEN 'conflict_needs_review' ELSE 'unchanged' END WHEN 1 THEN 'kept' ELSE 'inserted' END AS status FROM v_match")
def bulk_sync(t: Tables):
    m = t.match.select("match_id", "hg")  # a third of the matches is old, a third new, and a third on both sides
    new = m.where("match_id % 3 <> 1").withColumn("hg", F.when(F.col("match_id") % 4 == 0, F.col("hg") + 1).otherwise(F.col("hg")))
    return D.bulk_sync(m.where("match_id % 3 <> 0"), new, "match_id", ["hg"])


SNAPS = "SELECT event_id, ts, user_id, user_id % 7 AS version, TIMESTAMP '2024-01-16 12:00:00' + to_hours(CAST(user_id % 200 AS INT)) AS kickoff, value FROM events"


def snaps(t: Tables) -> DataFrame:
    return t("events").select("event_id", "ts", "user_id", (F.col("user_id") % 7).alias("version"), (F.expr("timestamp_ntz'2024-01-16 12:00:00' + make_dt_interval(0, cast(user_id % 200 as int))")).alias("kickoff"), "value")


@query("latest_snapshot", "user_id:l version:l event_id:l", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, version ORDER BY ts DESC, event_id) AS place FROM ({SNAPS}) WHERE ts < kickoff) WHERE place = 1")
def latest_snapshot(t: Tables):
    return D.latest_before(snaps(t), ["user_id", "version"], "ts", "kickoff", "event_id")


@query("duplicate_snapshot_mark", "event_id:l status:s", f"SELECT event_id, CASE WHEN ts >= kickoff THEN 'after_kickoff' WHEN row_number() OVER (PARTITION BY user_id, ts < kickoff ORDER BY ts DESC, event_id) = 1 THEN 'used' ELSE 'superseded' END AS status FROM ({SNAPS})")
def duplicate_mark(t: Tables):
    s = snaps(t).withColumn("early", F.col("ts") < F.col("kickoff"))
    place = F.row_number().over(Window.partitionBy("user_id", "early").orderBy(F.col("ts").desc(), "event_id"))
    return s.withColumn("place", place).select("event_id", F.when(~F.col("early"), "after_kickoff").when(F.col("place") == 1, "used").otherwise("superseded").alias("status"))


@query("snapshot_suppress", "event_id:l", f"""WITH RECURSIVE n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id, version, event_type ORDER BY ts, event_id) AS rn FROM (SELECT s.*, e.event_type FROM ({SNAPS}) s JOIN events e USING (event_id))),
    r AS (SELECT user_id, version, event_type, rn, event_id, true AS kept, CASE WHEN ts < kickoff THEN ts END AS latest FROM n WHERE rn = 1
    UNION ALL SELECT n.user_id, n.version, n.event_type, n.rn, n.event_id, r.latest IS NULL OR r.latest < n.ts - INTERVAL 60 MINUTE, CASE WHEN (r.latest IS NULL OR r.latest < n.ts - INTERVAL 60 MINUTE) AND n.ts < n.kickoff THEN n.ts ELSE r.latest END
    FROM r JOIN n ON n.user_id = r.user_id AND n.version = r.version AND n.event_type = r.event_type AND n.rn = r.rn + 1) SELECT event_id FROM r WHERE kept""")
def suppress(t: Tables):
    s = snaps(t).join(t("events").select("event_id", F.col("event_type").alias("mode")), "event_id")
    return D.suppressed(s, ["user_id", "version", "mode"], "ts", "kickoff", "event_id")


SEM = "SELECT match_id, CASE WHEN match_id % 10 = 0 THEN NULL ELSE hg END AS hg, ag, CASE match_id % 3 WHEN 0 THEN 'Regular time' WHEN 1 THEN 'after extra time' ELSE '90 minutes' END AS txt, CASE WHEN match_id % 7 = 0 THEN 'draw' WHEN hg > ag THEN 'home_win' WHEN hg = ag THEN 'draw' ELSE 'away_win' END AS stored FROM v_match"


@query("result_semantics", "match_id:l status:s", f"SELECT match_id, CASE WHEN hg IS NULL THEN 'semantics_needs_review' WHEN stored <> CASE WHEN hg > ag THEN 'home_win' WHEN hg = ag THEN 'draw' ELSE 'away_win' END THEN 'actual_result_mismatch' WHEN txt = 'after extra time' THEN 'not_90_minute_eligible' ELSE 'ok' END AS status FROM ({SEM})")
def semantics(t: Tables):
    m = t.match
    text = F.element_at(F.array(F.lit("Regular time"), F.lit("after extra time"), F.lit("90 minutes")), (F.col("match_id") % 3 + 1).cast("int"))
    stored = F.when(F.col("match_id") % 7 == 0, "draw").otherwise(C.outcome(F.col("hg"), F.col("ag")))
    return m.select("match_id", D.result_semantics(text, F.when(F.col("match_id") % 10 != 0, F.col("hg")), F.col("ag"), stored).alias("status"))


@query("interval_result_match", "match_id:l n:l nearest:l", """SELECT a.match_id, count(*) AS n, arg_min(b.match_id, struct_pack(d := abs(a.match_date - b.match_date), m := b.match_id)) AS nearest FROM v_match a JOIN v_match b ON least(a.home, a.away) = least(b.home, b.away) AND greatest(a.home, a.away) = greatest(b.home, b.away)
    AND abs(a.match_date - b.match_date) <= 3 AND a.match_id <> b.match_id GROUP BY 1""")
def interval(t: Tables):
    m = t.match.select("match_id", "match_date", D.team_key(F.col("home"), F.col("away")).alias("pair"))
    return D.near_days(m, "pair", "match_id", "match_date").where("n > 0")


@query("nearest_weather", "event_id:l nearest_id:l nearest_value:d gap_s:d", """SELECT * FROM (SELECT a.event_id, b.event_id AS nearest_id, b.value AS nearest_value, abs(epoch_us(a.ts) - epoch_us(b.ts)) / 1e6 AS gap_s, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(a.ts) - epoch_us(b.ts)), b.event_id) AS place
    FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view') WHERE place = 1""")
def nearest(t: Tables):
    e = t("events")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("t"), F.col("event_id").alias("id"), F.col("value").alias("v"))
    return I.nearest(e.where("event_type = 'purchase'"), views, "user_id", "ts", "event_id").where("nearest_id is not null")


@query("full_reconcile", "k:l n_left:l n_right:l status:s", """SELECT k, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right, CASE WHEN b.n IS NULL THEN 'unmatched' WHEN a.n IS NULL THEN 'unused' WHEN a.n > 1 OR b.n > 1 THEN 'ambiguous' ELSE 'matched' END AS status
    FROM (SELECT c_custkey - c_custkey % 30 // 29 AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_suppkey * 3 AS k, count(*) AS n FROM supplier GROUP BY 1) b USING (k)""")
def reconcile(t: Tables):
    return D.reconcile(t("customer").select(F.expr("c_custkey - c_custkey % 30 div 29").alias("k")), t("supplier").select((F.col("s_suppkey") * 3).alias("k")), "k")


@query("semi_join", "c_custkey:l", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi(t: Tables):
    return t("customer").join(t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("anti_join", "c_custkey:l", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti(t: Tables):
    return t("customer").join(t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


KEYS = {"union_distinct": ("UNION", lambda a, b: a.union(b).distinct()), "except_keys": ("EXCEPT", lambda a, b: a.subtract(b)), "intersect_keys": ("INTERSECT", lambda a, b: a.intersect(b))}
for _name, (_op, _f) in KEYS.items():
    query(_name, "k:l", f"(SELECT c_custkey AS k FROM customer) {_op} (SELECT s_suppkey * 7 AS k FROM supplier)")(lambda t, f=_f: f(t("customer").select(F.col("c_custkey").alias("k")), t("supplier").select((F.col("s_suppkey") * 7).alias("k"))))


def groups(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Groups of four teams, and the matches within them up to 1996."""
    rows = t.team_match.where("team div 4 = opponent div 4 and match_date < date'1996-07-01'").withColumn("grp", F.expr("team div 4"))
    return rows, t.rating.select(F.expr("team div 4").alias("grp"), "team")


STANDINGS = """SELECT *, row_number() OVER (PARTITION BY grp ORDER BY points DESC, goal_difference DESC, goals_for DESC, team) AS position FROM (SELECT team // 4 AS grp, r.team, count(match_id) AS played, coalesce(sum(CASE WHEN team_goals > opponent_goals THEN 3 WHEN team_goals = opponent_goals THEN 1 ELSE 0 END) FILTER (match_id IS NOT NULL), 0) AS points,
    coalesce(sum(team_goals), 0) AS goals_for, coalesce(sum(opponent_goals), 0) AS goals_against, coalesce(sum(team_goals - opponent_goals), 0) AS goal_difference FROM v_rating r LEFT JOIN (SELECT * FROM v_team WHERE team // 4 = opponent // 4 AND match_date < DATE '1996-01-01') m USING (team) GROUP BY 1, 2)"""


@query("standings_asof", "grp:l team:l played:l points:l goals_for:l goals_against:l goal_difference:l position:l", STANDINGS)
def standings(t: Tables):
    rows, teams = groups(t)
    return G.standings(rows, teams, F.to_date(F.lit("1996-01-01")))


NEEDS = f"""SELECT *, CASE WHEN position <= 2 AND remaining <= 1 AND position = 2 AND margin <= 0 THEN 'needs_win' WHEN position <= 2 AND remaining <= 1 AND margin >= 1 THEN 'draw_enough' WHEN position <= 2 THEN 'must_not_lose' WHEN remaining <= 1 AND points + 1 <= cutoff THEN 'needs_win' WHEN points + 3 < cutoff THEN 'already_eliminated_likely' ELSE 'needs_win' END AS label
    FROM (SELECT s.*, team % 3 AS remaining, max(points) FILTER (position = 2) OVER (PARTITION BY grp) AS cutoff, points - coalesce(max(points) FILTER (position = 3) OVER (PARTITION BY grp), 0) AS margin FROM ({STANDINGS}) s)"""


@query("qualification_need", "grp:l team:l points:l position:l margin:l label:s", NEEDS)
def needs(t: Tables):
    table = standings(t)
    return G.needs(table, table.select("grp", "team", (F.col("team") % 3).alias("remaining")))


CONTEXT = f"""SELECT p.match_id, home_win, draw, away_win, over_2_5, h.label AS hl, a.label AS al, CASE WHEN hl = 'needs_win' AND al = 'needs_win' THEN 'both_need_win' WHEN (hl = 'needs_win' AND al = 'draw_enough') OR (al = 'needs_win' AND hl = 'draw_enough') THEN 'one_needs_win_other_draw_enough' WHEN hl = 'draw_enough' AND al = 'draw_enough' THEN 'both_draw_ok'
    WHEN hl = 'already_eliminated_likely' AND al = 'already_eliminated_likely' THEN 'dead_rubber' WHEN (hl = 'needs_win' AND al = 'already_eliminated_likely') OR (al = 'needs_win' AND hl = 'already_eliminated_likely') THEN 'one_safe_other_needs_win' ELSE 'unknown' END AS context FROM v_prob p JOIN ({NEEDS}) h ON h.team = p.home JOIN ({NEEDS}) a ON a.team = p.away"""


@query("context_adjust", "match_id:l context:s adj_home_win:d adj_draw:d adj_away_win:d adj_over_2_5:d", f"""SELECT match_id, context, h / (h + d + a) AS adj_home_win, d / (h + d + a) AS adj_draw, a / (h + d + a) AS adj_away_win, greatest(1e-2, least(99e-2, over_2_5 + so)) AS adj_over_2_5 FROM (SELECT *, greatest(1e-2, least(98e-2, home_win + sh)) AS h, greatest(1e-2, least(98e-2, draw + sd)) AS d, greatest(1e-2, least(98e-2, away_win + sa)) AS a FROM (SELECT *,
    CASE context WHEN 'one_needs_win_other_draw_enough' THEN 3e-2 WHEN 'both_need_win' THEN -25e-3 WHEN 'both_draw_ok' THEN 4e-2 WHEN 'one_safe_other_needs_win' THEN -1e-2 ELSE 0e0 END AS sd, CASE context WHEN 'one_needs_win_other_draw_enough' THEN -15e-3 WHEN 'both_need_win' THEN 2e-2 WHEN 'both_draw_ok' THEN -2e-2 WHEN 'one_safe_other_needs_win' THEN 15e-3 ELSE 0e0 END AS so,
    CASE context WHEN 'one_needs_win_other_draw_enough' THEN CASE WHEN hl = 'draw_enough' THEN -2e-2 ELSE -1e-2 END WHEN 'both_need_win' THEN 125e-4 WHEN 'both_draw_ok' THEN -2e-2 ELSE 0e0 END AS sh, CASE context WHEN 'one_needs_win_other_draw_enough' THEN CASE WHEN hl = 'draw_enough' THEN -1e-2 ELSE -2e-2 END WHEN 'both_need_win' THEN 125e-4 WHEN 'both_draw_ok' THEN -2e-2 ELSE 0e0 END AS sa FROM ({CONTEXT})))""")
def context_adjust(t: Tables):
    n = needs(t).select("team", "label")
    rows = t.prob.join(n.withColumnsRenamed({"team": "home", "label": "home_label"}), "home").join(n.withColumnsRenamed({"team": "away", "label": "away_label"}), "away")
    return G.adjusted(rows.withColumn("context", G.context_of(F.col("home_label"), F.col("away_label"))))


@query("strength_scaling", "team:l from_rank:d from_points:d from_elo:d", "SELECT team, 9e-1 - (greatest(1, least(210, team * 8 + 1)) - 1) / 209e0 * 55e-2 AS from_rank, greatest(35e-2, least(9e-1, 35e-2 + (elo - 900) / 1e3 * 55e-2)) AS from_points, greatest(35e-2, least(9e-1, 35e-2 + (elo - 1200) / 1e3 * 55e-2)) AS from_elo FROM v_rating")
def strength(t: Tables):
    scale = lambda x, low, width: C.clamp(F.lit(0.35) + (x - low) / width * 0.55, 0.35, 0.90)
    rank = F.lit(0.90) - (C.clamp((F.col("team") * 8 + 1).cast("double"), 1.0, 210.0) - 1) / 209 * 0.55
    return t.rating.select("team", rank.alias("from_rank"), scale(F.col("elo"), 900, 1000).alias("from_points"), scale(F.col("elo"), 1200, 1000).alias("from_elo"))


@query("review_proposal", "team:l action:s attack:d form:d", """SELECT team, CASE team % 4 WHEN 0 THEN 'skip_manual_reviewed' WHEN 1 THEN 'preserve_existing_manual' ELSE 'review_candidate' END AS action, CASE WHEN team % 4 <= 1 THEN attack ELSE greatest(35e-2, least(9e-1, 6e-1 * attack + 25e-2 * attack_final + 15e-2 * greatest(35e-2, least(9e-1, 35e-2 + (elo - 1200) / 1e3 * 55e-2)))) END AS attack,
    CASE WHEN team % 4 <= 1 THEN form ELSE greatest(35e-2, least(9e-1, 6e-1 * form + 4e-1 * form_index)) END AS form FROM v_rating JOIN v_index USING (team)""")
def review(t: Tables):
    from ..operators.behavior import indices

    keep = F.col("team") % 4 <= 1
    j = t.rating.join(indices(t.history).select("team", "attack_final", "form_index"), "team")
    elo = C.clamp(F.lit(0.35) + (F.col("elo") - 1200) / 1000 * 0.55, 0.35, 0.90)
    action = F.when(F.col("team") % 4 == 0, "skip_manual_reviewed").when(F.col("team") % 4 == 1, "preserve_existing_manual").otherwise("review_candidate")
    attack = C.clamp(F.lit(0.60) * F.col("attack") + F.lit(0.25) * F.col("attack_final") + F.lit(0.15) * elo, 0.35, 0.90)
    form = C.clamp(F.lit(0.60) * F.col("form") + F.lit(0.40) * F.col("form_index"), 0.35, 0.90)
    return j.select("team", action.alias("action"), F.when(keep, F.col("attack")).otherwise(attack).alias("attack"), F.when(keep, F.col("form")).otherwise(form).alias("form"))


@query("external_calibration", "team:l attack_delta:d calibrated_attack:d", "SELECT team, greatest(-1e-1, least(1e-1, x - attack)) AS attack_delta, attack + greatest(-1e-1, least(1e-1, x - attack)) AS calibrated_attack FROM (SELECT team, attack, 45e-2 * attack + 25e-2 * attack_final + 3e-1 * greatest(35e-2, least(9e-1, 35e-2 + (elo - 1200) / 1e3 * 55e-2)) AS x FROM v_rating JOIN v_index USING (team))")
def external(t: Tables):
    from ..operators.behavior import indices

    j = t.rating.join(indices(t.history).select("team", "attack_final"), "team")
    x = F.lit(0.45) * F.col("attack") + F.lit(0.25) * F.col("attack_final") + F.lit(0.30) * C.clamp(F.lit(0.35) + (F.col("elo") - 1200) / 1000 * 0.55, 0.35, 0.90)
    delta = C.clamp(x - F.col("attack"), -0.10, 0.10)
    return j.select("team", delta.alias("attack_delta"), (F.col("attack") + delta).alias("calibrated_attack"))


@query("forecast_confidence", "match_id:l confidence_score:d label:s", """SELECT match_id, s AS confidence_score, CASE WHEN s >= 75 THEN 'High' WHEN s >= 50 THEN 'Moderate' ELSE 'Low' END AS label FROM (SELECT match_id, greatest(0, least(100 - CASE WHEN uncal THEN 25 ELSE 0 END - CASE WHEN small THEN 20 ELSE 0 END - CASE WHEN nojoin THEN 15 ELSE 0 END - CASE WHEN gap >= 20 THEN 25 WHEN gap >= 10 THEN 12 ELSE 0 END
    - CASE WHEN draw >= 28e-2 THEN 8 ELSE 0 END - CASE WHEN fav >= 75e-2 AND uncal THEN 8 ELSE 0 END - 3, CASE WHEN uncal OR small OR nojoin THEN 60 ELSE 100 END, CASE WHEN gap >= 20 THEN 45 WHEN gap >= 10 THEN 65 ELSE 100 END)) AS s
    FROM (SELECT match_id, draw, greatest(home_win, away_win) AS fav, match_id % 2 = 0 AS uncal, match_id % 3 = 0 AS small, match_id % 5 = 0 AS nojoin, match_id % 30 AS gap FROM v_prob))""")
def confidence(t: Tables):
    i = F.col("match_id")
    uncal, small, nojoin, gap = i % 2 == 0, i % 3 == 0, i % 5 == 0, i % 30
    fav = F.greatest("home_win", "away_win")
    less = lambda c, n: F.when(c, float(n)).otherwise(0.0)
    score = F.lit(100.0) - less(uncal, 25) - less(small, 20) - less(nojoin, 15) - F.when(gap >= 20, 25.0).when(gap >= 10, 12.0).otherwise(0.0) - less(F.col("draw") >= 0.28, 8) - less((fav >= 0.75) & uncal, 8) - 3
    cap = F.least(F.when(uncal | small | nojoin, 60.0).otherwise(100.0), F.when(gap >= 20, 45.0).when(gap >= 10, 65.0).otherwise(100.0))
    out = t.prob.select("match_id", F.greatest(F.lit(0.0), F.least(score, cap)).alias("confidence_score"))
    return out.withColumn("label", F.when(F.col("confidence_score") >= 75, "High").when(F.col("confidence_score") >= 50, "Moderate").otherwise("Low"))


@query("percentile_of_score", "team:l percentile:d", "SELECT team, 100 * cume_dist() OVER (ORDER BY elo) AS percentile FROM v_rating")
def percentile(t: Tables):
    return t.rating.select("team", (F.cume_dist().over(Window.orderBy("elo")) * 100).alias("percentile"))


@query("sha_ids", "event_id:l sha_id:s", "SELECT event_id, substr(sha1(concat_ws('|', CAST(event_id AS VARCHAR), event_type, CAST(user_id AS VARCHAR))), 1, 16) AS sha_id FROM events")
def sha_ids(t: Tables):
    return t("events").select("event_id", C.short_id(F.col("event_id"), F.col("event_type"), F.col("user_id")).alias("sha_id"))


@query("json_explode", "event_id:l key:s value:s", "SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.k') AS value FROM events")
def json_explode(t: Tables):
    return K.outcomes_of(t("events"))


@query("html_text", "page_id:l text:s", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages")
def html_text(t: Tables):
    return t("pages").select("page_id", K.visible_text(F.col("html")).alias("text"))


#: fixed values: tokens and their weights
TERMS = [("the", 60), ("die", 12), ("les", 14), ("que", 10), ("trash", 8), ("version", 30)]


@query("term_score", "doc_id:l score:l n_terms:l confidence:s", f"""SELECT doc_id, sum(weight) AS score, count(*) AS n_terms, CASE WHEN sum(weight) >= 80 THEN 'high' WHEN sum(weight) >= 50 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT doc_id, unnest(list_distinct(string_split(trim(regexp_replace(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '&', ' and ', 'g'), '[^a-z0-9'']+', ' ', 'g')), ' '))) AS token FROM documents)
    JOIN (VALUES {', '.join(map(str, TERMS))}) AS v(token, weight) USING (token) GROUP BY 1""")
def term_score(t: Tables):
    return K.score_terms(t("documents"), t.spark.createDataFrame(TERMS, "token string, weight long"), "doc_id")


def pairs(t: Tables) -> DataFrame:
    code = lambda c: F.lower(F.concat(F.lit("n"), F.col(c).cast("string")))
    return t.match.select(F.col("match_id").alias("pair_id"), code("home").alias("home_code"), code("away").alias("away_code"), F.col("match_date").alias("day"))


SLUGS = """SELECT match_id AS pair_id, pos, 'fif-' || CASE WHEN pos % 2 = 0 THEN 'n' || home || '-n' || away ELSE 'n' || away || '-n' || home END || '-' || strftime(match_date + [0, 0, -1, -1, 1, 1][pos + 1], '%Y-%m-%d') AS slug FROM v_match, range(6) AS r(pos)"""


@query("slug_candidates", "pair_id:l pos:l slug:s", SLUGS)
def slugs(t: Tables):
    return K.slug_candidates(pairs(t))


@query("slug_first_listed", "pair_id:l slug:s", f"SELECT pair_id, arg_min(slug, pos) AS slug FROM ({SLUGS}) WHERE slug IN (SELECT slug FROM ({SLUGS}) WHERE pair_id % 3 = 0 AND pos IN (1, 2)) GROUP BY 1")
def first_listed(t: Tables):
    c = K.slug_candidates(pairs(t))
    return K.first_listed(c, c.where("pair_id % 3 = 0 and pos in (1, 2)"))


#: the group of a match between two teams of one group
_GROUPED = "SELECT chr(CAST(65 + home % 8 AS INT)) AS grp, 'T' || home AS home, 'T' || away AS away, CASE WHEN match_id % 9 <> 0 THEN hg END AS hg, ag FROM v_match WHERE home % 8 = away % 8 AND home % 8 <> 6"
VIEWS["v_group_table"] = f"""SELECT *, row_number() OVER (PARTITION BY grp ORDER BY points DESC, goal_difference DESC, goals_for DESC, team) AS position FROM (SELECT grp, team, sum(CASE WHEN a > b THEN 3 WHEN a = b THEN 1 ELSE 0 END) AS points, sum(a - b) AS goal_difference, sum(a) AS goals_for
    FROM (SELECT grp, home AS team, hg AS a, ag AS b FROM ({_GROUPED}) WHERE hg IS NOT NULL UNION ALL SELECT grp, away, ag, hg FROM ({_GROUPED}) WHERE hg IS NOT NULL) GROUP BY 1, 2)"""
#: customers as matches of a bracket: match i is between the winners of 2i and 2i + 1, the outer half between places of groups; some slots, results and references are odd
_SLOT = """CASE WHEN i % 41 = 7 AND {k} = 1 THEN 'Winner Match ' || i WHEN i % 43 = 9 AND {k} = 1 THEN 'Winner of the play-off' WHEN i % 47 = 11 AND {k} = 0 THEN 'Winner Match ' || (i + 1000000) WHEN 2 * i + 1 <= n THEN CASE WHEN i % 5 = 0 THEN 'Loser' ELSE 'Winner' END || ' Match ' || (2 * i + {k})
    WHEN i % 4 = 0 THEN 'T' || (i % 32 + {k}) WHEN i % 4 = 1 THEN 'Winner Group ' || chr(CAST(65 + (i + {k}) % 8 AS INT)) WHEN i % 4 = 2 THEN 'Runner-up Group ' || chr(CAST(65 + (i + {k}) % 8 AS INT)) ELSE '3rd Group ' || chr(CAST(65 + i % 6 AS INT)) || '/' || chr(CAST(65 + (i + {k}) % 8 AS INT)) || '/C' END"""
VIEWS["v_bracket"] = f"""SELECT i AS match_no, {_SLOT.format(k=0)} AS home, {_SLOT.format(k=1)} AS away, CASE WHEN i % 37 <> 5 THEN CAST(floor(abs(c_acctbal)) AS BIGINT) % 3 END AS hg, i % 3 AS ag, CASE WHEN i % 11 = 3 THEN NULL WHEN i % 2 = 0 THEN 'home' ELSE 'away' END AS advancing
    FROM (SELECT c_custkey + 1 AS i, c_acctbal, count(*) OVER () AS n FROM customer)"""


def bracket(t: Tables) -> DataFrame:
    size = t("customer").agg(F.count("*").alias("n"))
    c = t("customer").join(F.broadcast(size), how="cross").select((F.col("c_custkey") + 1).alias("i"), "c_acctbal", "n")
    slot = lambda k: F.expr(_SLOT.format(k=k))
    advancing = F.expr("case when i % 11 = 3 then null when i % 2 = 0 then 'home' else 'away' end")
    return c.select(F.col("i").alias("match_no"), slot(0).alias("home"), slot(1).alias("away"), F.expr("case when i % 37 <> 5 then cast(floor(abs(c_acctbal)) as bigint) % 3 end").alias("hg"), F.expr("i % 3").alias("ag"), advancing.alias("advancing"))


def group_matches(t: Tables) -> DataFrame:
    team = lambda c: F.concat(F.lit("T"), F.col(c).cast("string"))
    m = t.match.where("home % 8 = away % 8 and home % 8 <> 6")
    return m.select(F.expr("chr(65 + home % 8)").alias("grp"), team("home").alias("home"), team("away").alias("away"), F.when(F.col("match_id") % 9 != 0, F.col("hg")).alias("hg"), "ag")


@query("group_tables", "grp:s team:s points:l goal_difference:l goals_for:l position:l", "SELECT * FROM v_group_table")
def group_tables(t: Tables):
    return G.group_tables(group_matches(t))


@query("bracket_resolve", "match_no:l home:s away:s home_status:s away_status:s status:s", r"""WITH RECURSIVE s AS MATERIALIZED (SELECT b.match_no, side, text, lower(regexp_extract(text, '^(?i)(winner|loser) match ([0-9]+)$', 1)) AS mode, TRY_CAST(regexp_extract(text, '^(?i)(winner|loser) match ([0-9]+)$', 2) AS BIGINT) AS ref, replace(lower(regexp_extract(text, '^(?i)(winner|runner-up) group ([a-z])$', 1)), '-', ' ') AS place,
    regexp_extract(text, '^(?i)(winner|runner-up) group ([a-z])$', 2) AS grp, regexp_extract(text, '^(?i)3rd group ([a-z/]+)$', 1) AS thirds FROM (SELECT match_no, 0 AS side, home AS text FROM v_bracket UNION ALL SELECT match_no, 1, away FROM v_bracket) b),
    o AS (SELECT match_no, hg IS NOT NULL AS over, CASE WHEN hg > ag THEN 0 WHEN hg < ag THEN 1 WHEN advancing = 'home' THEN 0 WHEN advancing = 'away' THEN 1 END AS won FROM v_bracket),
    x AS (SELECT s.match_no, s.side, arg_min(team, struct_pack(p := -points, d := -goal_difference, g := -goals_for, t := team)) AS best, count(*) AS have, any_value(n) AS n FROM (SELECT match_no, side, len(string_split(thirds, '/')) AS n, unnest(string_split(thirds, '/')) AS g FROM s WHERE thirds <> '') s JOIN v_group_table t ON t.position = 3 AND t.grp = g GROUP BY 1, 2),
    p AS MATERIALIZED (SELECT s.match_no, s.side, text, CASE WHEN mode <> '' AND won IS NOT NULL THEN s.ref * 2 + CASE WHEN mode = 'winner' THEN won ELSE 1 - won END END AS target, CASE WHEN mode <> '' THEN NULL WHEN place <> '' THEN t.team WHEN thirds <> '' THEN CASE WHEN have = n THEN best END WHEN NOT regexp_matches(text, '(?i)^(winner|loser|runner[- ]up|3rd|third)\b') THEN text END AS team,
    CASE WHEN mode <> '' THEN CASE WHEN won IS NOT NULL THEN 'points' WHEN over THEN 'manual' ELSE 'pending' END WHEN place <> '' THEN CASE WHEN t.team IS NULL THEN 'pending' ELSE 'resolved' END WHEN thirds <> '' THEN CASE WHEN have = n THEN 'resolved' ELSE 'pending' END WHEN regexp_matches(text, '(?i)^(winner|loser|runner[- ]up|3rd|third)\b') THEN 'manual' ELSE 'source' END AS state
    FROM s LEFT JOIN o ON o.match_no = s.ref AND mode <> '' LEFT JOIN v_group_table t ON t.grp = s.grp AND t.position = CASE place WHEN 'winner' THEN 1 WHEN 'runner up' THEN 2 END LEFT JOIN x ON x.match_no = s.match_no AND x.side = s.side),
    w AS (SELECT match_no, side, target AS at, 1 AS n FROM p WHERE target IS NOT NULL UNION ALL SELECT w.match_no, w.side, p.target, n + 1 FROM w JOIN p ON p.match_no * 2 + p.side = w.at WHERE p.target IS NOT NULL AND n < 40),
    e AS (SELECT w.match_no, w.side, any_value(p.team) AS team, any_value(p.state) AS state FROM w JOIN p ON p.match_no * 2 + p.side = w.at WHERE p.target IS NULL GROUP BY 1, 2),
    f AS (SELECT p.match_no, p.side, coalesce(p.team, e.team, p.text) AS name, CASE WHEN p.target IS NULL THEN p.state WHEN e.state IS NULL THEN 'cycle' WHEN e.team IS NULL THEN 'pending' ELSE 'resolved' END AS st FROM p LEFT JOIN e ON e.match_no = p.match_no AND e.side = p.side),
    g AS (SELECT match_no, max(name) FILTER (side = 0) AS home, max(name) FILTER (side = 1) AS away, max(st) FILTER (side = 0) AS home_status, max(st) FILTER (side = 1) AS away_status FROM f GROUP BY 1)
    SELECT *, CASE WHEN 'cycle' IN (home_status, away_status) THEN 'cycle' WHEN 'manual' IN (home_status, away_status) THEN 'manual' WHEN 'pending' IN (home_status, away_status) THEN 'pending' WHEN 'resolved' IN (home_status, away_status) THEN 'resolved' ELSE 'source' END AS status FROM g""")
def bracket_resolve(t: Tables):
    return G.resolve_bracket(bracket(t), G.group_tables(group_matches(t)))


@query("pdf_text_parse", "match_id:l home_win:d draw:d away_win:d status:s", "SELECT match_id, (match_id % 60) / 1e2 AS home_win, CASE WHEN match_id % 9 <> 0 THEN 25e-2 END AS draw, (75 - match_id % 60) / 1e2 AS away_win, CASE WHEN match_id % 9 = 0 THEN 'missing_probabilities' ELSE 'importable' END AS status FROM v_match")
def pdf_parse(t: Tables):
    i = F.col("match_id")
    text = F.concat(F.lit("Report\nHome win: 1.0%\nHome Win: "), (i % 60).cast("string"), F.lit(".0 %\n"), F.when(i % 9 != 0, "Draw: 25%\n").otherwise("\n"), F.lit("AWAY WIN "), (75 - i % 60).cast("string"), F.lit("%"))
    return parse_report(t.match.select("match_id", text.alias("text")))


def _streamed(t: Tables, name: str, make, session: SparkSession | None = None) -> DataFrame:
    """What a stream gives out that is run to its end: ``make`` turns tables read as streams (in ``session``) into one. Its files lie in the shared folder."""
    import uuid

    from ..sources.session import shared_dir

    at = f"{shared_dir(t.spark)}/touchline/{name}-{uuid.uuid4().hex}"

    def source(table: str) -> DataFrame:
        path = f"{t.dir}/{table}.parquet"
        return (session or t.spark).readStream.schema(t(table).schema).parquet(path if "://" in t.dir else f"{path}*")

    out = make(source)
    L.run_once(out, f"{at}/out", f"{at}/ckpt")
    return t.spark.read.schema(out.schema).parquet(f"{at}/out")


KICKOFF = "timestamp_ntz'2024-01-16 12:00:00' + make_dt_interval(0, cast(user_id % 200 as int))"


@query("stream_ledger", "match_id:l version:l n:l", "SELECT user_id AS match_id, user_id % 7 AS version, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16 12:00:00' + to_hours(CAST(user_id % 200 AS INT)) GROUP BY 1, 2")
def stream_ledger(t: Tables):
    """Snapshots in time, by match and version, of a stream over the events table."""
    make = lambda source: L.flagged(source("events").select(F.col("user_id").alias("match_id"), (F.col("user_id") % 7).alias("version"), F.col("ts").alias("snapshot_utc"), F.expr(KICKOFF).alias("kickoff_utc")))
    return _streamed(t, "ledger", make).where("prediction_before_kickoff").groupBy("match_id", "version").agg(F.count("*").alias("n"))


@query("stream_results", "match_id:l result_utc:x hg:l ag:l", """SELECT p.event_id AS match_id, r.result_utc, r.hg, r.ag FROM events p JOIN (SELECT event_id, ts + to_hours(CAST(event_id % 100 AS INT)) AS result_utc, event_id % 4 AS hg, event_id % 3 AS ag FROM events WHERE event_id % 5 <> 0) r ON r.event_id = p.event_id AND r.result_utc >= p.ts + INTERVAL 4 HOUR AND r.result_utc <= p.ts + INTERVAL 3 DAY""")
def stream_results(t: Tables):
    """A stream of predictions (an event each, kickoff at its time) joined to a stream of delayed results."""

    def make(source):
        p = source("events").select(F.col("event_id").alias("match_id"), F.col("ts").cast("timestamp").alias("kickoff_utc"))
        late = F.expr("cast(ts as timestamp) + make_dt_interval(0, cast(event_id % 100 as int))")
        r = source("events").where("event_id % 5 <> 0").select(F.col("event_id").alias("match_id"), late.alias("result_utc"), F.expr("event_id % 4").alias("hg"), F.expr("event_id % 3").alias("ag"))
        return L.with_results(p, r)

    return _streamed(t, "results", make)


@query("stream_elo", "match_id:l home:l away:l home_post:d away_post:d late:b", "SELECT match_id, home, away, round(home_post, 3) AS home_post, round(away_post, 3) AS away_post, false AS late FROM v_elo")
def stream_elo(t: Tables):
    """Ratings of a stream over the orders table, from state by league and team."""
    from ..streaming.ratings import STORE, elo_stream

    session = t.spark.newSession()
    session.conf.set(*STORE)
    out = _streamed(t, "elo", lambda source: elo_stream(t.match_of(source("orders")).withColumn("league", F.lit(0))), session)
    return out.withColumns({c: F.round(c, 3) for c in ("home_post", "away_post")})


@query("league_context", "team:l played:l points:l share_of_best:d", "SELECT team, played, points, points * 1e0 / max(points) OVER () AS share_of_best FROM (SELECT team, count(*) AS played, sum(CASE WHEN team_goals > opponent_goals THEN 3 WHEN team_goals = opponent_goals THEN 1 ELSE 0 END) AS points FROM v_team GROUP BY 1)")
def league_context(t: Tables):
    points = F.when(F.col("team_goals") > F.col("opponent_goals"), 3).when(F.col("team_goals") == F.col("opponent_goals"), 1).otherwise(0)
    by = t.team_match.groupBy("team").agg(F.count("*").alias("played"), F.sum(points).alias("points"))
    return by.withColumn("share_of_best", F.col("points") / F.max("points").over(Window.partitionBy(F.lit(0))))
