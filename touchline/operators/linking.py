"""Which result belongs to which fixture, and which to which prediction: waterfalls of ever looser rules.

No row meets all that lie near it in time, as these grow with the square of the rows once days fill up. Of one pair of names a row needs the two
times before and after it, which one sorted pass over both tables gives, or how many rows a day has, which are sums. Only rows that no
earlier rule has decided go on. Similar names come from one similarity join over the distinct names, not from pairs of rows. What decides
within a rule is the first two candidates of a row. Nulls in ids, names, times and competitions match nothing by that rule, but for an empty competition, which
fits any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import competition_key, name_key, plain_key
from ..sources.session import cut
from .similarity import similar_names

#: hours in which a result may lie before or after kickoff, and by which the nearest of several must be ahead of the next
NEAR_HOURS, AHEAD_HOURS = 36, 6
#: ratio of names that counts as like, and by which the best candidate must be ahead of the next
LIKE, MARGIN = 0.92, 0.03
#: fixed values: rule, its confidence, and the order of teams in it
RULES = [
    ("exact_match_id", 1.0, "same"),
    ("exact_home_away_same_utc_date", 0.98, "same"),
    ("exact_home_away_within_36h", 0.96, "same"),
    ("reversed_home_away_same_utc_date", 0.93, "reversed"),
    ("reversed_home_away_within_36h", 0.90, "reversed"),
    ("normalized_home_away_same_date", 0.90, "same"),
    ("normalized_home_away_within_36h", 0.88, "same"),
    ("fuzzy_team_match_same_date", 0.84, ""),
    ("fuzzy_team_match_within_36h", 0.82, ""),
]


def representatives(aliases: DataFrame) -> DataFrame:
    """alias, canonical (pairs of names; place: the later one wins for an alias) -> key, name: what each alias's key stands for after following
    aliases of aliases to the end. Each round follows twice as many steps. An alias that leads into a circle stands for nothing (null name)."""
    step = aliases.select(name_key(F.col("alias")).alias("key"), name_key(F.col("canonical")).alias("to"), F.btrim("canonical").alias("name"), "place").where("key <> '' and to <> '' and key <> to")
    now = cut(step.groupBy("key").agg(F.max_by(F.struct("to", "name"), F.struct("place", "to")).alias("x")).select("key", "x.to", "x.name"))
    for _ in range(now.count().bit_length() + 1):
        onward = now.select(F.col("key").alias("to"), F.col("to").alias("further"), F.col("name").alias("further_name"))
        now = now.select("key", "to", "name").join(onward, "to", "left")
        now = cut(now.select("key", F.coalesce("further", "to").alias("to"), F.coalesce("further_name", "name").alias("name"), F.col("further").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            break
    return now.select("key", F.when(~F.col("moved"), F.col("name")).alias("name"))  # what still moves has no end


def canonical(rows: DataFrame, column: str, closed: DataFrame, into: str) -> DataFrame:
    """``rows`` with ``into``: the key of what the name in ``column`` stands for, itself where no alias is known. ``closed``: of representatives()."""
    named = closed.where("name is not null").select(F.col("key").alias("_key"), name_key(F.col("name")).alias("_to"))
    return rows.withColumn("_key", name_key(F.col(column))).join(named, "_key", "left").withColumn(into, F.coalesce("_to", "_key")).drop("_key", "_to")


def _few(texts: DataFrame, most: int = 100_000) -> DataFrame:
    """Texts to join rows with: sent to all tasks if they are few, as one text may have very many rows."""
    return F.broadcast(texts) if texts.count() <= most else texts


def _prepared(rows: DataFrame, prefix: str, id_: str, closed: DataFrame) -> DataFrame:
    """id, match_id, home, away, at, competition with all keys, each column with a prefix; written once, as every rule reads it."""
    own = rows.select(F.col(id_).alias("id"), F.col("match_id").cast("string").alias("match_id"), "home", "away", "at", "competition")
    # keys cost much more than a join: they are made once for each text, not for each row
    texts = canonical(own.select(F.col("home").alias("text")).union(own.select("away")).distinct(), "text", closed, "key").withColumn("plain", plain_key(F.col("text")))
    texts = _few(cut(texts.where("text is not null")))
    for c in ("home", "away"):
        own = own.join(texts.select(F.col("text").alias(c), F.col("key").alias(f"{c}_key"), F.col("plain").alias(f"{c}_plain")), c, "left").fillna("", [f"{c}_key", f"{c}_plain"])
    kinds = _few(cut(own.select("competition").where("competition is not null").distinct().withColumn("kind", competition_key(F.col("competition")))))
    own = own.join(kinds, "competition", "left").withColumn("competition", F.coalesce("kind", F.lit(""))).drop("kind")
    own = own.withColumns({"day": F.to_date("at"), "second": F.unix_seconds(F.col("at").cast("timestamp"))})
    return cut(own.select(*[F.col(c).alias(f"{prefix}_{c}") for c in own.columns if c not in ("home", "away", "at")]))


def _streams(competition: str, asked: bool) -> Column:
    """A known row lies in the stream of its competition and in that of all; an asked row looks in those of its competition and of none, or in that of all."""
    own = F.col(competition)
    return F.explode(F.when(own == "", F.array(F.lit("*"))).otherwise(F.array(own, F.lit(""))) if asked else F.array(own, F.lit("*")))


def _nearest(asked: DataFrame, known: DataFrame) -> DataFrame:
    """The first two candidates of each row of ``asked`` in each stream that it looks in: r_id, f_id, rule, score, delta, turned.

    asked: r_id, home, away, competition, second, day, base (the rule of the same day; the next one is that of NEAR_HOURS), score, turned; known: f_id, home,
    away, competition, second, day. Rows of one pair of names and stream are sorted by time, once; the two known times before a row and the two
    after it hold the nearest of its day and of all, as days follow each other.
    """
    key = ["home", "away", "stream"]
    times = known.where("second is not null").select("home", "away", _streams("competition", False).alias("stream"), "second", "day", "f_id").groupBy(*key, "second").agg(F.struct(F.col("second").alias("s"), F.min("day").alias("d"), F.count("*").alias("n"), F.min("f_id").alias("f_id")).alias("known"))
    probes = asked.where("second is not null").select("home", "away", _streams("competition", True).alias("stream"), "second", F.struct("r_id", "day", "base", "score", "turned").alias("asked"))
    both = times.unionByName(probes, allowMissingColumns=True)
    order = f"(partition by {', '.join(key)} order by second, known is null)"
    look = {f"{way}{i}": F.expr(f"{way}(known, {i}) ignore nulls over {order}") for way in ("lag", "lead") for i in (1, 2)}
    seen = both.withColumns(look).where("asked is not null").select("asked.*", "second", *look)

    def candidate(x: str, again: bool = False) -> Column:
        rule = F.when(F.col(f"{x}.d") == F.col("day"), F.col("base")).otherwise(F.col("base") + 1)
        row = F.struct(rule.alias("rule"), (F.abs(F.col(f"{x}.s") - F.col("second")) / F.lit(3600.0)).alias("delta"), F.col(f"{x}.f_id").alias("f_id"))
        return F.when(F.col(f"{x}.n") >= (2 if again else 1), row)

    every = F.array(*[candidate(x, again) for x in look for again in ((False, True) if x.endswith("1") else (False,))])
    two = F.slice(F.array_sort(F.filter(every, lambda x: x.isNotNull() & (x["delta"] <= NEAR_HOURS))), 1, 2)
    return seen.select("r_id", "score", "turned", F.explode(two).alias("x")).select("r_id", "x.f_id", "x.rule", "score", "x.delta", "turned")


def _hours() -> Column:
    return F.abs(F.col("f_second") - F.col("r_second")) / F.lit(3600.0)


def _ranked(candidates: DataFrame, order: list) -> DataFrame:
    """Of each row the two first candidates of its first rule: r_id, rule, best and next (structs of f_id, score, delta, order)."""
    place = Window.partitionBy("r_id").orderBy("rule", *order)
    two = candidates.withColumn("place", F.row_number().over(place)).where("place <= 2")
    own = F.struct("rule", "f_id", "score", "delta", "turned")
    both = two.groupBy("r_id").agg(F.max(F.when(F.col("place") == 1, own)).alias("best"), F.max(F.when(F.col("place") == 2, own)).alias("next"))
    return both.withColumn("next", F.when(F.col("next.rule") == F.col("best.rule"), F.col("next")))


def _decided(ranked: DataFrame, sure: Column, late: Column) -> DataFrame:
    """r_id, fixture_id, method, confidence, team_order, delta_hours of ranked rows: ``sure`` tells that the best is alone, ``late`` that it is ahead of the next."""
    rule = lambda i: F.element_at(F.array(*[F.lit(r[i]) for r in RULES]), F.col("best.rule"))
    one = sure | late
    turned = F.when(F.col("best.turned"), "reversed").otherwise("same")
    confidence = F.least(rule(1), F.col("best.score")) - F.when(~sure & late, 0.01).otherwise(0.0)
    return ranked.select(
        "r_id",
        F.when(one, F.col("best.f_id")).alias("fixture_id"),
        F.when(one, rule(0)).otherwise("ambiguous_multiple_candidates").alias("method"),
        F.when(one, confidence).otherwise(0.0).alias("confidence"),
        F.when(one, turned).otherwise("ambiguous").alias("team_order"),
        F.when(one, F.col("best.delta")).alias("delta_hours"),
    )


def crosswalk(results: DataFrame, fixtures: DataFrame, closed: DataFrame) -> DataFrame:
    """Each result's fixture by the first of nine rules that fits any: result_id, fixture_id, method, confidence, team_order, delta_hours.

    results: result_id, match_id, home, away, at (timestamp), competition; fixtures: match_id, home, away, at (kickoff), competition; ``closed``:
    of representatives(). If the rule fits several fixtures, the nearest counts if its rule is one of hours and the next is more than
    AHEAD_HOURS further (0.01 less sure); if its rule is one of likeness, the most alike counts if the next is MARGIN less alike. Else
    the result is ambiguous, and looser rules are not tried. A result of no rule is no_fixture_match.
    """
    r, f = _prepared(results, "r", "result_id", closed), _prepared(fixtures.withColumn("id", F.col("match_id")), "f", "id", closed)
    kept = ["r_id", "f_id", "rule", "score", "delta", "turned"]
    one, no = F.lit(1.0), F.lit(False)
    by_id = r.where("r_match_id <> ''").join(f, F.col("r_match_id") == F.col("f_match_id")).withColumns({"rule": F.lit(1), "score": one, "delta": _hours(), "turned": no}).select(*kept)

    def asked(rows: DataFrame, home: str, away: str, base: int, turned: bool = False) -> DataFrame:
        told = rows.where((F.col(home) != "") & (F.col(away) != "")).withColumns({"base": F.lit(base), "score": one, "turned": F.lit(turned)})
        return told.select("r_id", F.col(home).alias("home"), F.col(away).alias("away"), F.col("r_competition").alias("competition"), F.col("r_second").alias("second"), F.col("r_day").alias("day"), "base", "score", "turned")

    known = lambda kind: f.select("f_id", F.col(f"f_home_{kind}").alias("home"), F.col(f"f_away_{kind}").alias("away"), F.col("f_competition").alias("competition"), F.col("f_second").alias("second"), F.col("f_day").alias("day"))
    ahead = F.col("best.rule").isin(3, 5, 7) & (F.col("best.delta") + AHEAD_HOURS < F.col("next.delta"))
    decide = lambda found: cut(_decided(_ranked(found, ["delta", "f_id"]), F.col("next").isNull(), F.coalesce(ahead, no)))
    orders = asked(r, "r_home_plain", "r_away_plain", 2).unionByName(asked(r.where("r_home_plain <> r_away_plain"), "r_away_plain", "r_home_plain", 4, True))
    settled = decide(by_id.unionByName(_nearest(orders, known("plain"))))
    rest = r.join(settled.select("r_id"), "r_id", "left_anti")
    by_key = decide(_nearest(asked(rest, "r_home_key", "r_away_key", 6), known("key")))
    rest = cut(rest.join(by_key.select("r_id"), "r_id", "left_anti"))
    like = _alike(rest, f, LIKE).select("r_id", "home", "away", F.col("r_competition").alias("competition"), F.col("r_second").alias("second"), F.col("r_day").alias("day"), F.lit(8).alias("base"), "score", "turned")
    ranked = _ranked(_nearest(like, known("key")), [F.desc("score"), "delta", "f_id"])
    fuzzy = _decided(ranked, F.col("next").isNull() | (F.col("best.score") - F.col("next.score") >= MARGIN), no)
    none = results.select(F.col("result_id").alias("r_id")).join(settled.unionByName(by_key).unionByName(fuzzy), "r_id", "left")
    fill = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return none.select(F.col("r_id").alias("result_id"), "fixture_id", fill("method", "no_fixture_match"), fill("confidence", 0.0), fill("team_order", "unknown"), "delta_hours")


def _alike(r: DataFrame, f: DataFrame, least: float) -> DataFrame:
    """Rows of ``r`` with each pair of names of ``f`` that is like theirs (home, away), its score (the lesser of both names' ratios, in the better order of
    teams) and turned. Pairs of names meet, not rows."""
    left = r.select(F.col("r_home_key").alias("a")).union(r.select("r_away_key"))
    right = f.select(F.col("f_home_key").alias("b")).union(f.select("f_away_key"))
    pairs = cut(similar_names(left, right, least))
    own, there = r.select("r_home_key", "r_away_key").distinct(), f.select(F.col("f_home_key").alias("home"), F.col("f_away_key").alias("away")).distinct()
    found = []
    for turned in (False, True):
        first, second = ("away", "home") if turned else ("home", "away")
        met = own.join(pairs.select(F.col("a").alias("r_home_key"), F.col("b").alias(first), F.col("ratio").alias("s1")), "r_home_key").join(pairs.select(F.col("a").alias("r_away_key"), F.col("b").alias(second), F.col("ratio").alias("s2")), "r_away_key")
        found.append(met.select("r_home_key", "r_away_key", "home", "away", F.struct(F.least("s1", "s2").alias("score"), F.lit(not turned).alias("same")).alias("x")))
    best = found[0].unionByName(found[1]).groupBy("r_home_key", "r_away_key", "home", "away").agg(F.max("x").alias("x")).join(there, ["home", "away"])
    return r.join(best, ["r_home_key", "r_away_key"]).select(*r.columns, "home", "away", "x.score", (~F.col("x.same")).alias("turned"))


#: fixed values: rule of predictions, its confidence (null: that of the crosswalk, or the ratio), and what it is called if it fits several
PREDICTION_RULES = [
    ("exact_match_id", 1.0, "ambiguous_exact_match_id"),
    ("result_fixture_crosswalk", None, "ambiguous_result_fixture_crosswalk"),
    ("fixture_bridge", 0.98, "ambiguous_fixture_bridge"),
    ("normalized_team_date", 0.95, "ambiguous_normalized_team_date"),
    ("symmetric_team_date", 0.92, "ambiguous_symmetric_team_date"),
]


def link_predictions(predictions: DataFrame, results: DataFrame, fixtures: DataFrame, mapped: DataFrame, closed: DataFrame) -> DataFrame:
    """Each prediction's result: prediction_id, result_id, method, confidence, team_order.

    predictions: prediction_id, match_id, home, away, at (kickoff), competition; ``mapped``: of crosswalk(). Rules in turn: the result has the
    prediction's match_id; the crosswalk maps a result to that fixture; the fixture of that match_id (or the only one with its names, day and
    competition) has a result of its names and day; a result has the prediction's names and day; the same with teams exchanged. A rule that fits
    several is ambiguous and ends the search. Last, the result of the day whose names are most alike, if their ratio is LIKE or more and
    the next one's MARGIN less; else no_result_found. A result's competition must be the prediction's, or empty.
    """
    p, r = _prepared(predictions, "r", "prediction_id", closed), _prepared(results, "f", "result_id", closed)
    null, names = F.lit(None), ["r_id", "rule", "f_id", "confidence", "turned", "n"]
    row = lambda df, rule, confidence=null, turned=F.lit(False), n=F.lit(1): df.withColumns({"rule": F.lit(rule), "confidence": confidence.cast("double"), "turned": turned, "n": n}).select(*names)
    by_id = r.where("f_match_id <> ''").select("f_id", "f_match_id")
    found = [row(p.join(by_id, F.col("r_match_id") == F.col("f_match_id")), 1)]

    # the crosswalk: one result of the fixture, or the one that has the fixture's id; its id must be that of one result
    ids = by_id.groupBy("f_match_id").agg(F.count("*").alias("n_ids"))
    known = mapped.where("fixture_id is not null").join(r.select(F.col("f_id").alias("result_id"), "f_match_id"), "result_id").join(ids, "f_match_id", "left")
    known = known.select("result_id", "fixture_id", F.col("confidence").alias("sure"), (F.col("team_order") == "reversed").alias("turned"), (F.col("f_match_id") == F.col("fixture_id")).alias("own"), (F.coalesce("n_ids", F.lit(0)) == 1).alias("unique"))
    pick = F.struct(F.col("own").alias("first"), "result_id", "sure", "turned", "unique")
    of_fixture = known.groupBy("fixture_id").agg(F.count("*").alias("n"), F.count_if("own").alias("n_own"), F.max(pick).alias("x"))
    via = p.join(of_fixture, F.col("r_match_id") == F.col("fixture_id"))
    single = (F.col("n") == 1) | (F.col("n_own") == 1)
    one = via.where(single).withColumn("f_id", F.when(F.col("x.unique"), F.col("x.result_id")))
    found.append(row(one, 2, F.col("x.sure"), F.col("x.turned")))
    several = via.where(~single).withColumn("f_id", F.explode(F.array(F.lit(None).cast("long"), F.lit(None).cast("long"))))
    found.append(row(several, 2))

    # the fixture of the prediction, by id or by its whole key
    x = _prepared(fixtures.withColumn("id", F.col("match_id")), "x", "id", closed)
    x_key = ["x_home_key", "x_away_key", "x_day", "x_competition"]
    only = lambda keys: x.groupBy(*keys).agg(F.count("*").alias("n"), *[F.min(c).alias(f"b_{c}") for c in x_key]).where("n = 1")
    bridged = p.join(only(["x_match_id"]), F.col("r_match_id") == F.col("x_match_id"), "left")
    by_key = only(x_key).select(*x_key, F.lit(True).alias("keyed"))
    bridged = bridged.join(by_key, [F.col("r_home_key") == F.col("x_home_key"), F.col("r_away_key") == F.col("x_away_key"), F.col("r_day") == F.col("x_day"), F.col("r_competition") == F.col("x_competition")], "left")
    by_id_known = F.col("b_x_home_key").isNotNull()
    side = lambda c: F.when(by_id_known, F.col(f"b_x_{c}")).when(F.col("keyed"), F.col(f"r_{c}"))
    bridged = bridged.select("r_id", *[side(c).alias(f"r_{c}") for c in ("home_key", "away_key", "day", "competition")]).where("r_home_key is not null")

    # results of a day by names and competition are sums, of which two say ambiguous
    key = ["home", "away", "day", "stream"]
    results_of = cut(r.select(F.col("f_home_key").alias("home"), F.col("f_away_key").alias("away"), F.col("f_day").alias("day"), _streams("f_competition", False).alias("stream"), "f_id").groupBy(*key).agg(F.count("*").alias("day_n"), F.min("f_id").alias("f_id")))

    def same(left: DataFrame, home: str, away: str) -> DataFrame:
        named = left.where("r_home_key <> '' and r_away_key <> ''")
        return named.select("r_id", F.col(home).alias("home"), F.col(away).alias("away"), F.col("r_day").alias("day"), _streams("r_competition", True).alias("stream")).join(results_of, key)

    n = F.col("day_n")
    found += [row(same(bridged, "r_home_key", "r_away_key"), 3, n=n), row(same(p, "r_home_key", "r_away_key"), 4, n=n), row(same(p, "r_away_key", "r_home_key"), 5, turned=F.lit(True), n=n)]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    by_rule = every.groupBy("r_id", "rule").agg(F.sum("n").alias("n"), F.min("f_id").alias("f_id"), F.max("confidence").alias("confidence"), F.max("turned").alias("turned"))
    first = by_rule.groupBy("r_id").agg(F.min(F.struct("rule", "n", "f_id", "confidence", "turned")).alias("x")).select("r_id", "x.*")
    text = lambda i: F.element_at(F.array(*[F.lit(v[i]) for v in PREDICTION_RULES]), F.col("rule"))
    method = F.when(F.col("n") > 1, text(2)).when(F.col("f_id").isNull(), "result_fixture_crosswalk_missing_result").otherwise(text(0))
    got = (F.col("n") == 1) & F.col("f_id").isNotNull()
    settled = first.select("r_id", F.when(got, F.col("f_id")).alias("f_id"), method.alias("method"), F.when(got, F.coalesce(text(1), "confidence")).otherwise(0.0).alias("confidence"), F.when(got, F.when(F.col("turned"), "reversed").otherwise("same")).alias("team_order"))

    settled = cut(settled)
    rest = cut(p.join(settled.select("r_id"), "r_id", "left_anti"))
    like = _alike(rest, r, LIKE - MARGIN).select("r_id", "home", "away", F.col("r_day").alias("day"), _streams("r_competition", True).alias("stream"), "score", "turned").join(results_of, key)
    like = like.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("day_n", F.lit(2)).cast("int"))))  # what is second to itself isn't sure
    two = like.withColumn("place", F.row_number().over(Window.partitionBy("r_id").orderBy(F.desc("score"), "turned", "f_id"))).where("place <= 2")
    best, after = F.when(F.col("place") == 1, F.struct("score", "f_id", "turned")), F.when(F.col("place") == 2, F.col("score"))
    fuzzy = two.groupBy("r_id").agg(F.max(best).alias("x"), F.max(after).alias("after")).where((F.col("x.score") >= LIKE) & (F.coalesce(F.col("x.score") - F.col("after") >= MARGIN, F.lit(True))))
    fuzzy = fuzzy.select("r_id", F.col("x.f_id").alias("f_id"), F.lit("fuzzy_team_date").alias("method"), F.col("x.score").alias("confidence"), F.when(F.col("x.turned"), "reversed").otherwise("same").alias("team_order"))
    none = predictions.select(F.col("prediction_id").alias("r_id")).join(settled.unionByName(fuzzy), "r_id", "left")
    return none.select(F.col("r_id").alias("prediction_id"), F.col("f_id").alias("result_id"), F.coalesce("method", F.lit("no_result_found")).alias("method"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "team_order")


def oriented(matched: DataFrame) -> DataFrame:
    """home_goals, away_goals and outcome of a result (hg, ag) as the linked side sees them: exchanged where team_order is reversed."""
    flip = F.coalesce(F.col("team_order") == "reversed", F.lit(False))
    from ..functions.columns import outcome

    out = matched.withColumns({"home_goals": F.when(flip, F.col("ag")).otherwise(F.col("hg")), "away_goals": F.when(flip, F.col("hg")).otherwise(F.col("ag"))})
    return out.withColumn("outcome", outcome(F.col("home_goals"), F.col("away_goals")))
