"""Queries on rating inputs, priors, reviews, prediction logs and market slugs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import markets as K
from ..operators import records as R
from .base import CATALOG, Tables, query
from .linking import TEAMS, names
from .tables import SLUGS, pairs


@query("recent_features", "team:l n_matches:l attack:d defense:d recent_form:d", """WITH n AS (SELECT team, rank, ln(2) / 5 AS k, exp(-ln(2) * rank / 5) AS w, team_goals AS g, opponent_goals AS c, (1400e0 + opponent * 97 % 600 - 1750e0) / 500 * 18e-2 AS raw, CASE WHEN team_goals > opponent_goals THEN 1e0 WHEN team_goals = opponent_goals THEN 5e-1 ELSE 0e0 END AS s
    FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) - 1 AS rank FROM v_team WHERE team % 9 <> 4) WHERE rank < 40),
    a AS (SELECT team, count(*) AS n_matches, sum(g * greatest(85e-2, least(115e-2, 1 + raw)) * w) / sum(w) AS sc, sum(c * greatest(85e-2, least(115e-2, 1 - raw)) * w) / sum(w) AS co, sum(s * w) FILTER (rank < 10) / sum(w) FILTER (rank < 10) AS f FROM n GROUP BY 1)
    SELECT r.team, coalesce(n_matches, 0) AS n_matches, CASE WHEN n_matches > 0 THEN greatest(2e-1, least(95e-2, 22e-2 + sc / 27e-1 * 73e-2)) ELSE attack END AS attack, CASE WHEN n_matches > 0 THEN greatest(2e-1, least(95e-2, 95e-2 - co / 28e-1 * 73e-2)) ELSE defense END AS defense, CASE WHEN n_matches > 0 THEN greatest(0e0, least(1e0, f)) ELSE form END AS recent_form FROM v_rating r LEFT JOIN a USING (team)""")
def recent_features(t: Tables):
    rows = t.team_match.where("team % 9 <> 4").withColumn("opponent_elo", F.lit(1400.0) + F.col("opponent") * 97 % 600)
    return R.recent_features(rows, t.rating)


_RAW = "SELECT CASE WHEN c_custkey % 97 = 3 THEN ' ' ELSE ' team ' || c_custkey || ' ' END AS team, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 200 AS VARCHAR) WHEN c_custkey % 8 = 0 THEN 'n/a' END AS rank, CASE WHEN c_custkey % 3 = 0 THEN 1000 + c_custkey % 1500 END AS elo, CASE WHEN c_custkey % 5 = 0 THEN (c_custkey % 13) / 10e0 END AS attack, CASE WHEN c_custkey % 7 = 0 THEN (c_custkey % 17) / 10e0 END AS defense, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 9) / 10e0 END AS recent_form, CASE WHEN c_custkey % 6 = 0 THEN 31e0 END AS temp, CASE WHEN c_custkey % 10 = 1 THEN 'reviewed' END AS quality FROM customer"


@query("normalised_ratings", "team:s rank:l elo:d attack:d defense:d recent_form:d training_temp_c:d training_humidity_pct:d data_quality:s", f"""SELECT trim(team) AS team, CAST(r AS BIGINT) AS rank, round(greatest(1200e0, least(2200e0, coalesce(elo, greatest(132e1, least(211e1, 211e1 - (b - 1) * 53e-1))))), 1) AS elo, round(greatest(0e0, least(1e0, coalesce(attack, s))), 3) AS attack, round(greatest(0e0, least(1e0, coalesce(defense, s))), 3) AS defense,
    round(greatest(0e0, least(1e0, coalesce(recent_form, s * 85e-2))), 3) AS recent_form, coalesce(temp, 2e1) AS training_temp_c, 6e1 AS training_humidity_pct, coalesce(quality, 'manual_csv') AS data_quality FROM (SELECT *, greatest(24e-2, least(92e-2, 92e-2 - (b - 1) * 48e-4)) AS s FROM (SELECT *, greatest(1e0, least(15e1, r)) AS b FROM (SELECT *, coalesce(TRY_CAST(rank AS DOUBLE), 8e1) AS r FROM ({_RAW}) WHERE trim(team) <> '')))""")
def normalised_ratings(t: Tables):
    k = F.col("c_custkey")
    tenth = lambda every, mod: F.when(k % every == 0, k % mod / 10.0)
    raw = t("customer").select(
        F.when(k % 97 == 3, " ").otherwise(F.concat(F.lit(" team "), k.cast("string"), F.lit(" "))).alias("team"), F.when(k % 4 != 0, (k % 200).cast("string")).when(k % 8 == 0, "n/a").alias("rank"), F.when(k % 3 == 0, 1000 + k % 1500).alias("elo"), tenth(5, 13).alias("attack"), tenth(7, 17).alias("defense"), tenth(2, 9).alias("recent_form"),
        F.when(k % 6 == 0, 31.0).alias("training_temp_c"), F.lit(None).cast("double").alias("training_humidity_pct"), F.when(k % 10 == 1, "reviewed").alias("data_quality"),
    )
    return R.normalised_ratings(raw)


@query("merge_priors", "team:s reference_attack:d reference_overall:d source:s", """WITH e AS (SELECT 'Team ' || c_custkey AS team, c_custkey % 10 / 1e1 AS ra, CASE WHEN c_custkey % 3 = 0 THEN 5e-1 END AS ro, 'old' AS source FROM customer),
    p AS (SELECT o_custkey AS k, o_orderkey AS place, CASE WHEN o_orderkey % 4 <> 1 THEN round(o_totalprice / 1e6, 3) END AS ra, CASE WHEN o_orderkey % 3 = 0 THEN 25e-2 END AS ro, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'feed ' || o_orderkey % 7 END AS source FROM orders WHERE o_orderkey % 6 <> 2),
    n AS (SELECT 'Team ' || k AS team, arg_max(ra, place) FILTER (ra IS NOT NULL) AS na, arg_max(ro, place) FILTER (ro IS NOT NULL) AS no, arg_max(source, place) FILTER (source <> '' AND (ra IS NOT NULL OR ro IS NOT NULL)) AS ns FROM p GROUP BY 1)
    SELECT team, coalesce(na, ra) AS reference_attack, coalesce(no, ro) AS reference_overall, coalesce(ns, source) AS source FROM e LEFT JOIN n USING (team)""")
def merge_priors(t: Tables):
    none = F.lit(None).cast("double")
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    existing = t("customer").select(F.concat(F.lit("Team "), k.cast("string")).alias("team"), (k % 10 / 10).alias("reference_attack"), none.alias("reference_defense"), none.alias("reference_form"), F.when(k % 3 == 0, 0.5).alias("reference_overall"), F.lit("old").alias("source"))
    proposed = t("orders").select(F.concat(F.lit("TEAM  "), F.col("o_custkey").cast("string")).alias("team"), (o % 6 != 2).alias("ready"), o.alias("place"), F.when(o % 4 != 1, F.round(F.col("o_totalprice") / 1e6, 3)).alias("reference_attack"), none.alias("reference_defense"), none.alias("reference_form"), F.when(o % 3 == 0, 0.25).alias("reference_overall"), F.when(o % 5 == 0, "").otherwise(F.concat(F.lit("feed "), (o % 7).cast("string"))).alias("source"))
    return R.merge_priors(existing, proposed)


@query("apply_reviews", "team:s attack:d form:d data_quality:s notes:s", """WITH e AS (SELECT 'Team ' || c_custkey AS team, c_custkey % 10 / 1e1 AS attack, 6e-1 AS form, ['generated_from_behavior', 'manual_review_candidate', 'manual_csv'][c_custkey % 3 + 1] AS q, CASE WHEN c_custkey % 2 = 0 THEN 'note' ELSE '' END AS notes FROM customer),
    s AS (SELECT 'Team ' || o_custkey AS team, arg_min(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 11 / 1e1 END, o_orderkey) FILTER (true) AS x, arg_min(struct_pack(a := CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 11 / 1e1 END, n := CASE WHEN o_orderkey % 2 = 0 THEN 'ok' ELSE '' END), o_orderkey) AS r FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY 1)
    SELECT team, CASE WHEN t THEN round(greatest(35e-2, least(9e-1, coalesce(r.a, attack))), 3) ELSE attack END AS attack, CASE WHEN t THEN 6e-1 ELSE form END AS form, CASE WHEN t THEN 'manual_reviewed' ELSE q END AS data_quality, CASE WHEN t THEN trim(CASE WHEN notes <> '' THEN notes || ' ' ELSE '' END || 'External prior review approved; manual reviewed prior.' || CASE WHEN r.n <> '' THEN ' ' || r.n ELSE '' END) ELSE notes END AS notes
    FROM (SELECT e.*, s.r, s.r IS NOT NULL AND q <> 'manual_csv' AS t FROM e LEFT JOIN s USING (team))""")
def apply_reviews(t: Tables):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    quality = F.element_at(F.array(*map(F.lit, ("generated_from_behavior", "manual_review_candidate", "manual_csv"))), (k % 3 + 1).cast("int"))
    ratings = t("customer").select(F.concat(F.lit("Team "), k.cast("string")).alias("team"), (k % 10 / 10).alias("attack"), F.lit(0.5).alias("defense"), F.lit(0.6).alias("form"), quality.alias("data_quality"), F.when(k % 2 == 0, "note").otherwise("").alias("notes"))
    none = F.lit(None).cast("double")
    sheet = t("orders").select(F.concat(F.lit("team "), F.col("o_custkey").cast("string")).alias("team"), F.when(o % 3 != 1, " Approved").otherwise("open").alias("review_status"), o.alias("place"), F.when(o % 5 != 0, o % 11 / 10).alias("recommended_attack"), none.alias("recommended_defense"), none.alias("recommended_form"), F.when(o % 2 == 0, "ok").alias("human_notes"))
    return R.apply_reviews(ratings, sheet)


def log_rows(t: Tables):
    """Three log rows a match, one a side; some without a primary probability or a price."""
    i = F.col("match_id")
    each = F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("p"), F.lit(n).alias("place")) for n, s in enumerate(R.SIDES)]))
    rows = t.prob.select("match_id", "hg", "ag", each)
    return rows.select(
        "match_id", "hg", "ag", "place", "side", F.when(i % 4 != 1, F.col("p")).alias("primary"), F.when(i % 13 != 5, F.col("p") * 0.9).alias("fallback"), F.when(i % 3 != 0, F.col("p")).alias("behavior"),
        F.when((i + F.col("place")) % 7 != 0, F.round(F.col("p") * 100)).alias("price_cents"), F.when((i + F.col("place")) % 5 == 0, "no").otherwise("YES").alias("price_side"), F.element_at(F.array(*map(F.lit, ("high", "Low", "medium"))), ((i + F.col("place") * (i % 2)) % 3 + 1).cast("int")).alias("mapping_confidence"),
    )


_SIDE = {"home_win": 0, "draw": 1, "away_win": 2}
_LOG = "SELECT match_id, hg, ag, p.n AS place, p.s AS side, p.p AS p FROM (SELECT *, unnest([struct_pack(s := 'home_win', n := 0, p := home_win), struct_pack(s := 'draw', n := 1, p := draw), struct_pack(s := 'away_win', n := 2, p := away_win)]) AS p FROM v_prob)"
_QUOTE = "CASE WHEN (match_id + place) % 7 <> 0 THEN CASE WHEN (match_id + place) % 5 = 0 THEN 1 - round(p * 100) / 100 ELSE round(p * 100) / 100 END END"


@query("prediction_log_pivot", "match_id:l raw_home_win:d raw_draw:d raw_away_win:d behavior_home_win:d market_home_win:d market_away_win:d market_status:s mapping_confidence:s", f"""SELECT match_id, r[1] / list_sum(r) AS raw_home_win, r[2] / list_sum(r) AS raw_draw, r[3] / list_sum(r) AS raw_away_win, CASE WHEN match_id % 3 <> 0 THEN b[1] / list_sum(b) END AS behavior_home_win, CASE WHEN m THEN q[1] / list_sum(q) END AS market_home_win, CASE WHEN m THEN q[3] / list_sum(q) END AS market_away_win,
    CASE WHEN m THEN 'joined_price' ELSE 'event_found_no_usable_price' END AS market_status, ['low', 'medium', 'high'][low] AS mapping_confidence FROM (SELECT match_id, list(CASE WHEN match_id % 4 <> 1 THEN p ELSE p * 9e-1 END ORDER BY place) AS r, list(p ORDER BY place) AS b, list({_QUOTE} ORDER BY place) AS q, count({_QUOTE}) = 3 AND sum({_QUOTE}) > 0 AS m, min([3, 1, 2][(match_id + place * (match_id % 2)) % 3 + 1]) AS low, bool_and(match_id % 4 <> 1 OR match_id % 13 <> 5) AS known FROM ({_LOG}) GROUP BY 1) WHERE known""")
def log_pivot(t: Tables):
    return R.pivot_log(log_rows(t), "match_id")


@query("log_ledger_metrics", "signal:s n:l brier_score:d log_loss:d mean_gap:d hit_rate:d", f"""WITH s AS (SELECT p AS prob, CASE WHEN (match_id + place) % 5 = 0 THEN 1 - y ELSE y END AS y, ['Strong', 'Weak', ''][match_id % 3 + 1] AS signal, match_id % 9 AS gap FROM (SELECT *, CASE WHEN CASE side WHEN 'home_win' THEN hg > ag WHEN 'draw' THEN hg = ag ELSE hg < ag END THEN 1 ELSE 0 END AS y FROM ({_LOG}) WHERE match_id % 8 <> 0))
    SELECT signal, count(*) AS n, avg(pow(prob - y, 2)) AS brier_score, avg(-(y * ln(greatest(1e-3, least(999e-3, prob))) + (1 - y) * ln(1 - greatest(1e-3, least(999e-3, prob))))) AS log_loss, avg(gap) AS mean_gap, avg(y) AS hit_rate FROM (SELECT *, 'all' AS signal FROM (SELECT prob, y, gap FROM s) UNION ALL BY NAME SELECT * FROM s) GROUP BY 1""")
def log_metrics(t: Tables):
    log = log_rows(t).join(t.prob.select("match_id", *R.SIDES), "match_id")
    p = F.when(F.col("side") == "home_win", F.col("home_win")).when(F.col("side") == "draw", F.col("draw")).otherwise(F.col("away_win"))
    signal = F.element_at(F.array(*map(F.lit, ("Strong", "Weak", ""))), (F.col("match_id") % 3 + 1).cast("int"))
    log = log.select("match_id", "side", p.alias("probability"), "price_side", signal.alias("signal_strength"), (F.col("match_id") % 9).alias("gap"))
    return R.log_metrics(R.scored_log(log, t.match.select("match_id", "hg", "ag", (F.col("match_id") % 8 != 0).alias("completed"))))


@query("slug_scores", "match_id:l slug:s score:l confidence:s warning:s", f"""WITH s AS (SELECT DISTINCT slug FROM (SELECT CASE WHEN pair_id % 2 = 0 THEN slug ELSE replace(slug, 'fif-', 'cup-') END AS slug FROM ({SLUGS}) WHERE pair_id % 3 = 0 AND pos IN (1, 2))), p AS (SELECT slug, string_split(slug, '-') AS w FROM s),
    k AS (SELECT slug, w[1] AS pre, w[2] AS one, w[3] AS two, CAST(array_to_string(w[4:6], '-') AS DATE) AS hint FROM p), f AS (SELECT match_id, match_date AS day, 'n' || home AS h, 'n' || away AS a FROM v_match)
    SELECT match_id, slug, score, CASE WHEN day = hint AND pre = 'fif' THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN day = hint THEN '' ELSE 'date mismatch' END AS warning FROM (SELECT *, 35 * (h IN (one, two))::int + 35 * (a IN (one, two))::int + 20 * (day = hint)::int + 10 * (pre = 'fif')::int AS score, row_number() OVER (PARTITION BY match_id ORDER BY score DESC, slug) AS place FROM f JOIN k ON least(h, a) = least(one, two) AND greatest(h, a) = greatest(one, two)) WHERE place = 1""")
def slug_scores(t: Tables):
    listed = K.slug_candidates(pairs(t)).where("pair_id % 3 = 0 and pos in (1, 2)")
    slugs = listed.select(F.when(F.col("pair_id") % 2 == 0, F.col("slug")).otherwise(F.replace("slug", F.lit("fif-"), F.lit("cup-"))).alias("slug"))
    return R.slug_scores(slugs, pairs(t).withColumnRenamed("pair_id", "match_id"))


_QUESTION = "CASE match_id % 6 WHEN 0 THEN 'Will ' || h || ' beat ' || a || '?' WHEN 1 THEN h || ' vs ' || a || ': total goals' WHEN 2 THEN h || ' and ' || a || ' election: next president' WHEN 3 THEN h || ' to win the World Cup' WHEN 4 THEN a || ' v. ' || h || ' friendly football match' ELSE h || ', ' || a END"
_CATEGORY = "CASE match_id % 4 WHEN 0 THEN 'Sports' WHEN 1 THEN 'Politics' WHEN 2 THEN '' ELSE 'Soccer' END"
_WORDS = lambda words: "regexp_matches(' ' || text || ' ', ' (" + "|".join(words) + ") ')"


@query("map_markets", "match_id:l market_id:l score:d confidence:s", f"""WITH n AS (SELECT team, {TEAMS}[team + 1] AS name FROM v_name), m AS MATERIALIZED (SELECT match_id AS market_id, trim(regexp_replace(lower({_QUESTION}), '[^a-z0-9'']+', ' ', 'g')) AS text, lower({_CATEGORY}) AS category, match_date + CAST(match_id % 7 - 3 AS INT) AS day, CASE match_id % 6 WHEN 3 THEN NULL ELSE least(home, away) END AS low, greatest(home, away) AS high FROM (SELECT v.*, x.name AS h, y.name AS a FROM v_match v JOIN n x ON x.team = home JOIN n y ON y.team = away)),
    r AS (SELECT f.match_id, market_id, {_WORDS(K.MATCHUP_WORDS)} AS mu, {_WORDS(K.SPORTS_WORDS)} AS sp, {_WORDS(K.POLITICAL_WORDS)} AS po, category IN ('sports', 'soccer', 'football') AS sc, category LIKE '%politic%' AS pc, contains(' ' || text || ' ', ' ' || replace(comp_type, '_', ' ') || ' ') AS co, abs(day - match_date) <= 2 AS near FROM v_match f JOIN m ON low = least(home, away) AND high = greatest(home, away)),
    s AS (SELECT *, 60e0 + CASE WHEN mu THEN 12 ELSE 0 END + CASE WHEN sp THEN 14 ELSE 0 END + CASE WHEN sc THEN 10 ELSE 0 END + CASE WHEN co THEN 8 ELSE 0 END + CASE WHEN near THEN 6 ELSE 0 END AS score FROM r WHERE NOT ((po OR pc) AND NOT sp) AND (sp OR mu OR sc))
    SELECT match_id, market_id, score, CASE WHEN (sp OR sc) AND score >= 75 THEN 'high' WHEN score >= 55 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY score DESC, market_id) AS place FROM s) WHERE place = 1""")
def map_markets(t: Tables):
    n = names(t).select("team", F.replace("name", F.lit(" football union"), F.lit("")).alias("term"))
    m = t.match.join(n.withColumnsRenamed({"team": "home", "term": "h"}), "home").join(n.withColumnsRenamed({"team": "away", "term": "a"}), "away")
    markets = m.select(F.col("match_id").alias("market_id"), F.expr(_QUESTION).alias("text"), F.expr(_CATEGORY).alias("category"), F.expr("date_add(match_date, cast(match_id % 7 - 3 as int))").alias("day"))
    fixtures = t.match.select("match_id", "home", "away", F.replace("comp_type", F.lit("_"), F.lit(" ")).alias("competition"), F.col("match_date").alias("day"))
    return K.map_markets(markets, fixtures, n)


@query("context_evaluation", "n:l baseline_brier:d context_brier:d baseline_log_loss:d context_log_loss:d draw_calibration_delta:d", f"""SELECT count(*) AS n, avg(p.brier / 3) AS baseline_brier, avg((pow(adj_home_win - CASE WHEN actual = 'home_win' THEN 1 ELSE 0 END, 2) + pow(adj_draw - CASE WHEN actual = 'draw' THEN 1 ELSE 0 END, 2) + pow(adj_away_win - CASE WHEN actual = 'away_win' THEN 1 ELSE 0 END, 2)) / 3) AS context_brier, avg(log_loss) AS baseline_log_loss,
    avg(-ln(greatest(1e-3, least(999e-3, CASE actual WHEN 'home_win' THEN adj_home_win WHEN 'draw' THEN adj_draw ELSE adj_away_win END)))) AS context_log_loss, avg(adj_draw) - avg((actual = 'draw')::int) AS draw_calibration_delta FROM v_prob p JOIN ({CATALOG['context_adjust'].sql}) c ON c.match_id = p.match_id""")
def context_evaluation(t: Tables):
    from ..operators import tournament as G

    adjusted = CATALOG["context_adjust"].plan(t).select("match_id", "adj_home_win", "adj_draw", "adj_away_win")
    return G.context_evaluation(t.prob.join(adjusted, "match_id"))
