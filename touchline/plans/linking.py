"""Queries on names and on which rows belong together: keys, aliases, similar names, fixtures, results and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import linking as L
from ..operators import similarity as S
from .base import MATERIALIZED, VIEWS, Tables, query

#: fixed values: names of the 32 teams, what is put after them, and accents of a spelling
TEAMS = ["Albania", "Algeria", "Angola", "Argentina", "Armenia", "Australia", "Austria", "Belgium", "Bolivia", "Botswana", "Brazil", "Bulgaria", "Burundi", "Cameroon", "Canada", "Colombia"]
TEAMS += ["Denmark", "Ecuador", "Egypt", "Finland", "Greece", "Guinea", "Iceland", "India", "Indonesia", "Iran", "Iraq", "Jamaica", "Lithuania", "Slovakia", "Slovenia", "Venezuela"]
ACCENTS = ("aeiou", "áęîőú")


def _key(x: str, letters: str) -> str:
    return f"trim(regexp_replace(replace(strip_accents(lower({x})), '&', ' and '), '[^{letters}]+', ' ', 'g'))"


def ratio_sql(pairs: str) -> str:
    """SQL of a, b, ratio for a query of pairs (a, b): the longest common block, first in a, then in b, and the same left and right of it."""
    block = """list_reduce(list_prepend({'k': 0, 'i': 0, 'j': 0}, flatten(list_transform(range(t.al, t.ah + 1), lambda i: list_transform(range(t.bl, t.bh + 1),
        lambda j: {'k': list_reduce(list_prepend(0, range(1, least(t.ah - i, t.bh - j) + 2)), lambda s, q: CASE WHEN s = q - 1 AND a[i + q - 1] = b[j + q - 1] THEN q ELSE s END), 'i': i, 'j': j})))), lambda x, y: CASE WHEN y.k > x.k THEN y ELSE x END)"""
    return f"""WITH RECURSIVE r AS (SELECT a, b, 0 AS m, [{{'al': 1, 'ah': length(a), 'bl': 1, 'bh': length(b)}}] AS todo FROM ({pairs})
        UNION ALL SELECT a, b, m + f.k, list_concat(todo[2:], CASE WHEN f.k = 0 THEN [] ELSE [{{'al': t.al, 'ah': f.i - 1, 'bl': t.bl, 'bh': f.j - 1}}, {{'al': f.i + f.k, 'ah': t.ah, 'bl': f.j + f.k, 'bh': t.bh}}] END)
        FROM (SELECT a, b, m, todo, t, {block} AS f FROM (SELECT a, b, m, todo, todo[1] AS t FROM r WHERE len(todo) > 0)))
        SELECT a, b, 2e0 * max(m) / (length(a) + length(b)) AS ratio FROM r WHERE len(todo) = 0 GROUP BY a, b"""


def _near(least: float) -> str:
    """Pairs of names that can reach a ratio by their lengths; exactness comes later."""
    return f"2e0 * least(length(a), length(b)) >= {least} * (length(a) + length(b))"


_KIND = "CASE WHEN match_id % 29 = 0 THEN '' ELSE replace(comp_type, '_', ' ') END"
_TYPED = "CASE WHEN i % 11 IN (5, 6) THEN 'Squad ' || team WHEN i % 11 IN (7, 8) THEN replace(name, 'football', 'footbal') WHEN i % 11 = 10 THEN upper(translate(name, 'aeiou', 'áęîőú')) ELSE name END"
_SHIFT = "CASE match_id % 11 WHEN 2 THEN 20 WHEN 4 THEN -30 WHEN 6 THEN 30 WHEN 8 THEN 30 WHEN 9 THEN 120 ELSE 0 END"
VIEWS |= {
    "v_name": f"SELECT team, {TEAMS}[team + 1] || ' football union' AS name FROM (SELECT DISTINCT c_custkey % 32 AS team FROM customer)",
    "v_alias": "SELECT 'Squad ' || team AS alias, 'team ' || team AS canonical, team AS place FROM v_name UNION ALL BY NAME SELECT 'team ' || team AS alias, 'Side-' || team AS canonical, team AS place FROM v_name UNION ALL BY NAME SELECT 'side ' || team AS alias, name AS canonical, team AS place FROM v_name UNION ALL BY NAME SELECT 'here' AS alias, 'there' AS canonical, 0 AS place UNION ALL BY NAME SELECT 'there' AS alias, 'here' AS canonical, 0 AS place",
    "v_fixture": f"""SELECT CAST(match_id AS VARCHAR) AS match_id, h.name AS home, a.name AS away, CAST(match_date AS TIMESTAMP) + to_hours(CAST(match_id % 24 AS INT)) AS moment, {_KIND} AS competition
        FROM v_match JOIN v_name h ON h.team = home JOIN v_name a ON a.team = away""",
    "v_typed": f"SELECT i, team, {_TYPED} AS name FROM v_name, range(11) AS r(i)",
    "v_result": f"""SELECT m.match_id AS result_id, CASE WHEN m.match_id % 11 = 0 THEN '' ELSE 'p' END || m.match_id AS match_id, h.name AS home, a.name AS away, CAST(match_date AS TIMESTAMP) + to_hours(CAST({_SHIFT} AS INT)) AS moment,
        CASE WHEN match_id % 13 = 0 THEN '' WHEN match_id % 17 = 0 THEN 'Other cup' ELSE replace(comp_type, '_', '-') END AS competition, hg, ag FROM v_match m
        JOIN v_typed h ON h.i = match_id % 11 AND h.team = CASE WHEN match_id % 11 IN (3, 4) THEN m.away ELSE m.home END JOIN v_typed a ON a.i = match_id % 11 AND a.team = CASE WHEN match_id % 11 IN (3, 4) THEN m.home ELSE m.away END""",
    "v_prediction": f"""SELECT match_id AS prediction_id, CASE match_id % 5 WHEN 0 THEN CAST(match_id AS VARCHAR) WHEN 1 THEN CAST(match_id AS VARCHAR) WHEN 2 THEN 'p' || match_id ELSE 'q' || match_id END AS match_id, CASE WHEN match_id % 7 = 3 THEN a.name WHEN match_id % 7 = 4 THEN 'SIDE ' || home ELSE h.name END AS home,
        CASE WHEN match_id % 7 = 3 THEN h.name ELSE a.name END AS away, CAST(match_date AS TIMESTAMP) + to_hours(CAST(match_id % 24 AS INT)) AS moment, {_KIND} AS competition FROM v_match JOIN v_name h ON h.team = home JOIN v_name a ON a.team = away""",
    "v_closed": f"""SELECT alias_key, {_key("name", "a-z0-9''")} AS name_key FROM (WITH RECURSIVE s AS (SELECT {_key("alias", "a-z0-9''")} AS k, {_key("canonical", "a-z0-9''")} AS c, canonical FROM v_alias), c AS (SELECT k AS alias_key, c, canonical AS name, 1 AS n FROM s
        UNION ALL SELECT alias_key, s.c, s.canonical, n + 1 FROM c JOIN s ON s.k = c.c WHERE n < 9) SELECT alias_key, name FROM c WHERE c NOT IN (SELECT k FROM s))""",
}


def _keyed(view: str, id_: str) -> str:
    """A view's rows with plain keys, keys after aliases, day and competition key."""
    return f"""SELECT v.{id_} AS id, v.match_id, moment, CAST(moment AS DATE) AS day, hp, ap, coalesce(c1.name_key, hk) AS hk, coalesce(c2.name_key, ak) AS ak, CASE WHEN comp LIKE '%world cup%' THEN 'world cup' ELSE comp END AS comp
        FROM (SELECT *, {_key("home", "a-z0-9")} AS hp, {_key("away", "a-z0-9")} AS ap, {_key("home", "a-z0-9''")} AS hk, {_key("away", "a-z0-9''")} AS ak, {_key("competition", "a-z0-9")} AS comp FROM {view}) v LEFT JOIN v_closed c1 ON c1.alias_key = hk LEFT JOIN v_closed c2 ON c2.alias_key = ak"""


_SIM = "SELECT DISTINCT a.k AS a, b.k AS b FROM (SELECT hk AS k FROM {left} UNION SELECT ak FROM {left}) a, (SELECT hk AS k FROM {right} UNION SELECT ak FROM {right}) b WHERE " + _near(0.89).replace("length(a)", "length(a.k)").replace("length(b)", "length(b.k)")
_FITS = "(r.comp = '' OR f.comp = '' OR r.comp = f.comp)"
_SECONDS = "abs(epoch(f.moment) - epoch(r.moment))"
VIEWS |= {
    "v_rk": _keyed("v_result", "result_id"),
    "v_fk": _keyed("v_fixture", "match_id"),
    "v_pk": _keyed("v_prediction", "prediction_id"),
    "v_like": f"SELECT * FROM ({ratio_sql(_SIM.format(left='v_rk', right='v_fk'))}) WHERE ratio >= 0.92e0",
    "v_like_result": f"SELECT * FROM ({ratio_sql(_SIM.format(left='v_pk', right='v_rk'))}) WHERE ratio >= 0.89e0",
    "v_crosswalk": f"""WITH c AS (SELECT r.id AS r_id, f.id AS f_id, 1 AS rule, 1e0 AS score, {_SECONDS} / 3600e0 AS delta, false AS turned FROM v_rk r JOIN v_fk f ON r.match_id = f.match_id WHERE r.match_id <> ''
        UNION ALL SELECT r.id, f.id, CASE WHEN r.hp = f.hp AND r.ap = f.ap THEN CASE WHEN r.day = f.day THEN 2 ELSE 3 END WHEN r.day = f.day THEN 4 ELSE 5 END, 1e0, {_SECONDS} / 3600e0, r.hp <> f.hp FROM v_rk r JOIN v_fk f ON least(r.hp, r.ap) = least(f.hp, f.ap) AND greatest(r.hp, r.ap) = greatest(f.hp, f.ap) WHERE {_SECONDS} <= 129600 AND {_FITS}
        UNION ALL SELECT r.id, f.id, CASE WHEN r.day = f.day THEN 6 ELSE 7 END, 1e0, {_SECONDS} / 3600e0, false FROM v_rk r JOIN v_fk f ON r.hk = f.hk AND r.ak = f.ak WHERE {_SECONDS} <= 129600 AND {_FITS}),
        z AS (SELECT r.id AS r_id, f.id AS f_id, r.day = f.day AS today, least(s1.ratio, s2.ratio) AS score, {_SECONDS} / 3600e0 AS delta, turned FROM (SELECT *, false AS turned, hk AS one, ak AS two FROM v_fk UNION ALL SELECT *, true, ak, hk FROM v_fk) f JOIN v_like s1 ON s1.b = f.one JOIN v_like s2 ON s2.b = f.two JOIN v_rk r ON r.hk = s1.a AND r.ak = s2.a WHERE {_SECONDS} <= 129600 AND {_FITS}),
        u AS (SELECT * FROM c UNION ALL SELECT r_id, f_id, CASE WHEN any_value(today) THEN 8 ELSE 9 END, max(score), any_value(delta), arg_max(turned, score * 2 + CASE WHEN turned THEN 0 ELSE 1e-9 END) FROM z WHERE r_id NOT IN (SELECT r_id FROM c) GROUP BY r_id, f_id),
        n AS (SELECT *, row_number() OVER (PARTITION BY r_id ORDER BY rule, CASE WHEN rule >= 8 THEN -score ELSE 0 END, delta, f_id) AS place, min(rule) OVER (PARTITION BY r_id) AS first FROM u),
        t AS (SELECT a.*, b.r_id IS NULL AS alone, CASE WHEN a.rule >= 8 THEN a.score - b.score >= 3e-2 ELSE a.rule IN (3, 5, 7) AND a.delta + 6 < b.delta END AS ahead FROM n a LEFT JOIN n b ON b.r_id = a.r_id AND b.place = 2 AND b.rule = b.first WHERE a.place = 1)
        SELECT r.id AS result_id, CASE WHEN alone OR ahead THEN f_id END AS fixture_id, CASE WHEN rule IS NULL THEN 'no_fixture_match' WHEN alone OR ahead THEN ['exact_match_id', 'exact_home_away_same_utc_date', 'exact_home_away_within_36h', 'reversed_home_away_same_utc_date', 'reversed_home_away_within_36h', 'normalized_home_away_same_date', 'normalized_home_away_within_36h', 'fuzzy_team_match_same_date', 'fuzzy_team_match_within_36h'][rule] ELSE 'ambiguous_multiple_candidates' END AS method,
        CASE WHEN alone OR ahead THEN least([1e0, 98e-2, 96e-2, 93e-2, 9e-1, 9e-1, 88e-2, 84e-2, 82e-2][rule], score) - CASE WHEN NOT alone AND rule < 8 THEN 1e-2 ELSE 0 END ELSE 0e0 END AS confidence, CASE WHEN rule IS NULL THEN 'unknown' WHEN alone OR ahead THEN CASE WHEN turned THEN 'reversed' ELSE 'same' END ELSE 'ambiguous' END AS team_order,
        CASE WHEN alone OR ahead THEN delta END AS delta_hours FROM v_rk r LEFT JOIN t ON t.r_id = r.id""",
}
MATERIALIZED.update({"v_closed", "v_rk", "v_fk", "v_pk", "v_like", "v_like_result", "v_crosswalk", "v_name"})


def names(t: Tables) -> DataFrame:
    team = t("customer").select((F.col("c_custkey") % 32).alias("team")).distinct()
    return team.select("team", F.concat(F.element_at(F.array(*map(F.lit, TEAMS)), (F.col("team") + 1).cast("int")), F.lit(" football union")).alias("name"))


def aliases(t: Tables) -> DataFrame:
    team = F.col("team").cast("string")
    one = lambda a, c: F.struct(a.alias("alias"), c.alias("canonical"))
    chain = names(t).select(F.inline(F.array(one(F.concat(F.lit("Squad "), team), F.concat(F.lit("team "), team)), one(F.concat(F.lit("team "), team), F.concat(F.lit("Side-"), team)), one(F.concat(F.lit("side "), team), F.col("name")))), F.col("team").alias("place"))
    circle = names(t).where("team = 0").select(F.inline(F.array(one(F.lit("here"), F.lit("there")), one(F.lit("there"), F.lit("here")))), F.lit(0).cast("long").alias("place"))
    return chain.unionByName(circle)


def _teams(t: Tables, rows: DataFrame, home: str, away: str) -> DataFrame:
    n = names(t)
    return rows.join(n.withColumnsRenamed({"team": home, "name": "home_name"}), home).join(n.withColumnsRenamed({"team": away, "name": "away_name"}), away)


def _at(hours: str) -> Column:
    return F.expr(f"cast(match_date as timestamp_ntz) + make_dt_interval(0, cast({hours} as int))")


def fixtures(t: Tables) -> DataFrame:
    m = _teams(t, t.match, "home", "away")
    kind = F.when(F.col("match_id") % 29 == 0, "").otherwise(F.replace("comp_type", F.lit("_"), F.lit(" ")))
    return m.select(F.col("match_id").cast("string").alias("match_id"), F.col("home_name").alias("home"), F.col("away_name").alias("away"), _at("match_id % 24").alias("at"), kind.alias("competition"))


def results(t: Tables) -> DataFrame:
    i = F.col("match_id") % 11
    turned = i.isin(3, 4)
    m = t.match.withColumns({"h": F.when(turned, F.col("away")).otherwise(F.col("home")), "a": F.when(turned, F.col("home")).otherwise(F.col("away"))})
    m = _teams(t, m, "h", "a")

    def typed(name: str, team: str):
        x = F.col(name)
        return F.when(i.isin(5, 6), F.concat(F.lit("Squad "), F.col(team).cast("string"))).when(i.isin(7, 8), F.replace(x, F.lit("football"), F.lit("footbal"))).when(i == 10, F.upper(F.translate(x, *ACCENTS))).otherwise(x)

    kind = F.when(F.col("match_id") % 13 == 0, "").when(F.col("match_id") % 17 == 0, "Other cup").otherwise(F.replace("comp_type", F.lit("_"), F.lit("-")))
    shift = "case match_id % 11 when 2 then 20 when 4 then -30 when 6 then 30 when 8 then 30 when 9 then 120 else 0 end"
    return m.select(F.col("match_id").alias("result_id"), F.concat(F.when(i == 0, "").otherwise("p"), F.col("match_id").cast("string")).alias("match_id"), typed("home_name", "h").alias("home"), typed("away_name", "a").alias("away"), _at(shift).alias("at"), kind.alias("competition"), "hg", "ag")


def predictions(t: Tables) -> DataFrame:
    i, m = F.col("match_id"), _teams(t, t.match, "home", "away")
    id_ = F.concat(F.when(i % 5 <= 1, "").when(i % 5 == 2, "p").otherwise("q"), i.cast("string"))
    home = F.when(i % 7 == 3, F.col("away_name")).when(i % 7 == 4, F.concat(F.lit("SIDE "), F.col("home").cast("string"))).otherwise(F.col("home_name"))
    kind = F.when(i % 29 == 0, "").otherwise(F.replace("comp_type", F.lit("_"), F.lit(" ")))
    return m.select(i.alias("prediction_id"), id_.alias("match_id"), home.alias("home"), F.when(i % 7 == 3, F.col("home_name")).otherwise(F.col("away_name")).alias("away"), _at("match_id % 24").alias("at"), kind.alias("competition"))


@query("name_keys", "result_id:l home_key:s away_plain:s", f"SELECT result_id, {_key('home', chr(97) + '-z0-9' + chr(39) * 2)} AS home_key, {_key('away', 'a-z0-9')} AS away_plain FROM v_result")
def name_keys(t: Tables):
    return results(t).select("result_id", N.name_key(F.col("home")).alias("home_key"), N.plain_key(F.col("away")).alias("away_plain"))


@query("alias_representatives", "alias_key:s name:s", f"SELECT k.alias_key, c.name_key AS name FROM (SELECT DISTINCT {_key('alias', chr(97) + '-z0-9' + chr(39) * 2)} AS alias_key FROM v_alias) k LEFT JOIN v_closed c USING (alias_key)")
def alias_representatives(t: Tables):
    return L.representatives(aliases(t)).select(F.col("key").alias("alias_key"), F.when(F.col("name").isNotNull(), N.name_key(F.col("name"))).alias("name"))


def crosswalk(t: Tables) -> DataFrame:
    return L.crosswalk(results(t), fixtures(t), L.representatives(aliases(t)))


@query("crosswalk_cascade", "result_id:l fixture_id:s method:s confidence:d team_order:s delta_hours:d", "SELECT * FROM v_crosswalk")
def crosswalk_cascade(t: Tables):
    return crosswalk(t)


@query("join_audit_status", "method:s team_order:s n:l", "SELECT method, team_order, count(*) AS n FROM v_crosswalk GROUP BY ALL")
def audit(t: Tables):
    return crosswalk(t).groupBy("method", "team_order").agg(F.count("*").alias("n"))


@query("result_orientation", "result_id:l home_goals:l away_goals:l outcome:s", """SELECT result_id, CASE WHEN team_order = 'reversed' THEN ag ELSE hg END AS home_goals, CASE WHEN team_order = 'reversed' THEN hg ELSE ag END AS away_goals,
    CASE WHEN hg = ag THEN 'draw' WHEN (hg > ag) <> (team_order = 'reversed') THEN 'home_win' ELSE 'away_win' END AS outcome FROM v_crosswalk JOIN v_result USING (result_id) WHERE fixture_id IS NOT NULL""")
def orientation(t: Tables):
    return L.oriented(crosswalk(t).where("fixture_id is not null").join(results(t).select("result_id", "hg", "ag"), "result_id"))


_SAME = "r.hk = {h} AND r.ak = {a} AND r.day = p.day AND (p.comp = '' OR r.comp = '' OR r.comp = p.comp)"
PREDICTED = f"""WITH w AS (SELECT m.*, r.match_id AS own_id, n.n = 1 AS uni FROM v_crosswalk m JOIN v_rk r ON r.id = m.result_id LEFT JOIN (SELECT match_id, count(*) AS n FROM v_rk GROUP BY 1) n ON n.match_id = r.match_id WHERE fixture_id IS NOT NULL),
    g AS (SELECT fixture_id, count(*) AS n, count(*) FILTER (own_id = fixture_id) AS n_own, max(struct_pack(own := own_id = fixture_id, id := result_id, sure := confidence, turned := team_order = 'reversed', uni := uni)) AS x FROM w GROUP BY 1),
    b AS (SELECT p.id, coalesce(f.hk, k.hk) AS hk, coalesce(f.ak, k.ak) AS ak, coalesce(f.day, k.day) AS day, coalesce(f.comp, k.comp) AS comp FROM v_pk p LEFT JOIN v_fk f ON f.match_id = p.match_id LEFT JOIN (SELECT hk, ak, day, comp FROM v_fk GROUP BY ALL HAVING count(*) = 1) k ON f.match_id IS NULL AND k.hk = p.hk AND k.ak = p.ak AND k.day = p.day AND k.comp = p.comp WHERE f.match_id IS NOT NULL OR k.hk IS NOT NULL),
    c AS (SELECT p.id, 1 AS rule, r.id AS r_id, 1e0 AS conf, false AS turned FROM v_pk p JOIN v_rk r ON r.match_id = p.match_id
    UNION ALL SELECT p.id, 2, CASE WHEN g.x.uni THEN g.x.id END, g.x.sure, g.x.turned FROM v_pk p JOIN g ON g.fixture_id = p.match_id WHERE n = 1 OR n_own = 1 UNION ALL SELECT p.id, 2, NULL, NULL, false FROM v_pk p JOIN g ON g.fixture_id = p.match_id, range(2) WHERE n > 1 AND n_own <> 1
    UNION ALL SELECT p.id, 3, r.id, 98e-2, false FROM b p JOIN v_rk r ON {_SAME.format(h='p.hk', a='p.ak')} UNION ALL SELECT p.id, 4, r.id, 95e-2, false FROM v_pk p JOIN v_rk r ON {_SAME.format(h='p.hk', a='p.ak')} UNION ALL SELECT p.id, 5, r.id, 92e-2, true FROM v_pk p JOIN v_rk r ON {_SAME.format(h='p.ak', a='p.hk')}),
    d AS (SELECT id, rule, count(*) AS n, min(r_id) AS r_id, max(conf) AS conf, bool_or(turned) AS turned FROM c WHERE (id, rule) IN (SELECT (id, min(rule)) FROM c GROUP BY id) GROUP BY 1, 2),
    z0 AS (SELECT p.id, r.id AS r_id, least(s1.ratio, s2.ratio) AS score, turned FROM v_pk p JOIN v_like_result s1 ON s1.a = p.hk JOIN v_like_result s2 ON s2.a = p.ak JOIN (SELECT *, false AS turned, hk AS one, ak AS two FROM v_rk UNION ALL SELECT *, true, ak, hk FROM v_rk) r ON r.day = p.day AND r.one = s1.b AND r.two = s2.b AND (p.comp = '' OR r.comp = '' OR r.comp = p.comp) WHERE p.id NOT IN (SELECT id FROM c)),
    z1 AS (SELECT id, r_id, max(score) AS score, arg_max(turned, score * 2 + CASE WHEN turned THEN 0 ELSE 1e-9 END) AS turned FROM z0 GROUP BY 1, 2), z AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, turned, r_id) AS place, lead(score) OVER (PARTITION BY id ORDER BY score DESC, turned, r_id) AS after FROM z1)
    SELECT p.id AS prediction_id, CASE WHEN d.n = 1 THEN d.r_id WHEN d.id IS NULL THEN z.r_id END AS result_id, CASE WHEN d.n > 1 THEN ['ambiguous_exact_match_id', 'ambiguous_result_fixture_crosswalk', 'ambiguous_fixture_bridge', 'ambiguous_normalized_team_date', 'ambiguous_symmetric_team_date'][d.rule] WHEN d.n = 1 AND d.r_id IS NULL THEN 'result_fixture_crosswalk_missing_result'
    WHEN d.n = 1 THEN ['exact_match_id', 'result_fixture_crosswalk', 'fixture_bridge', 'normalized_team_date', 'symmetric_team_date'][d.rule] WHEN z.id IS NOT NULL THEN 'fuzzy_team_date' ELSE 'no_result_found' END AS method, CASE WHEN d.n = 1 AND d.r_id IS NOT NULL THEN d.conf WHEN d.id IS NULL AND z.id IS NOT NULL THEN z.score ELSE 0e0 END AS confidence,
    CASE WHEN (d.n = 1 AND d.r_id IS NOT NULL) OR (d.id IS NULL AND z.id IS NOT NULL) THEN CASE WHEN coalesce(d.turned, z.turned) THEN 'reversed' ELSE 'same' END END AS team_order FROM v_pk p LEFT JOIN d ON d.id = p.id LEFT JOIN z ON z.id = p.id AND place = 1 AND score >= 92e-2 AND (after IS NULL OR score - after >= 3e-2)"""


@query("prediction_cascade", "prediction_id:l result_id:l method:s confidence:d team_order:s", PREDICTED)
def prediction_cascade(t: Tables):
    closed = L.representatives(aliases(t))
    return L.link_predictions(predictions(t), results(t), fixtures(t), L.crosswalk(results(t), fixtures(t), closed), closed)


_SPELLED = "CASE s_suppkey % 3 WHEN 0 THEN replace(s_name, 'Supplier', 'Suplier') WHEN 1 THEN replace(s_name, '0000', '00O0') ELSE left(s_name, 17) END"
_PAIRS = f"SELECT DISTINCT block, a, b FROM (SELECT s_nationkey % 5 AS block, s_name AS a FROM supplier) JOIN (SELECT s_nationkey % 5 AS block, {_SPELLED} AS b FROM supplier) USING (block)"


@query("fuzzy_ratio", "block:l a:s b:s ratio:d status:s", f"""WITH p AS MATERIALIZED ({_PAIRS}), s AS (SELECT p.*, q.ratio FROM p JOIN ({ratio_sql("SELECT DISTINCT a, b FROM p")}) q USING (a, b)), n AS (SELECT *, row_number() OVER (PARTITION BY block, a ORDER BY ratio DESC, b) AS place, lead(ratio) OVER (PARTITION BY block, a ORDER BY ratio DESC, b) AS after FROM s)
    SELECT block, a, CASE WHEN ratio >= 92e-2 THEN b END AS b, CASE WHEN ratio >= 92e-2 THEN n.ratio END AS ratio, CASE WHEN n.ratio < 92e-2 THEN 'no_match' WHEN n.ratio - after < 3e-2 THEN 'ambiguous' ELSE 'matched' END AS status FROM n WHERE place = 1""")
def fuzzy(t: Tables):
    s = t("supplier").select("s_suppkey", "s_name", (F.col("s_nationkey") % 5).cast("long").alias("block"))
    return S.fuzzy(s.withColumnRenamed("s_name", "name"), s.withColumn("name", F.expr(_SPELLED)), "block", "name")
