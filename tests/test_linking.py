"""Name keys by Unicode's rule, similar names against all pairs, and the parts of the cascades that the catalogue's data doesn't reach."""

import datetime
import random
import re
import unicodedata
from difflib import SequenceMatcher
from functools import cache

import pytest

from touchline.functions import names as N
from touchline.operators import linking as L
from touchline.operators import markets as K
from touchline.operators.similarity import fuzzy, similar_names


def plain(name, letters):
    x = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower()
    return " ".join(re.sub(f"[^{letters}]+", " ", x.replace("&", " and ") if "'" in letters else x).split())


def test_keys_follow_unicode(spark):
    names = ["Côte d'Ivoire", "Curaçao", "İstanbul", "Việt Nam", "Türkiye & Co", "Þór", "Łódź", "ﬁne ﬂow", "Ⅷ. Bezirk", "Ａｂｃ１２", "Straße", "Ångström", "ŉgoni", "Ĳssel", "naïve-name", "Ωmega Ǖber", "北京 FC", "𝔘nion", "①st", "", "  ", "O’Higgins", "e\u0301te\u0301"]
    got = spark.createDataFrame([(x,) for x in names], "x string").select("x", N.name_key(N.F.col("x")).alias("k"), N.plain_key(N.F.col("x")).alias("p")).collect()
    assert {r.x: r.k for r in got} == {x: plain(x, "a-z0-9'") for x in names}
    assert {r.x: r.p for r in got} == {x: plain(x, "a-z0-9") for x in names}
    assert spark.sql("select cast(null as string) x").select(N.name_key(N.F.col("x")).alias("k")).first().k == ""


@pytest.mark.parametrize("least", [0.78, 0.89, 0.92])
def test_similar_names_as_all_pairs(spark, least):
    r = random.Random(int(least * 100))
    words = ["united", "city", "real", "sporting", "athletic", "north", "south", "republic", "of", "st", "abab", "aaaa", "x"]
    base = [" ".join(r.choices(words, k=r.randrange(1, 5))) for _ in range(60)]

    def typo(x):
        for _ in range(r.randrange(0, 4)):
            i = r.randrange(len(x) + 1)
            x = x[:i] + r.choice(["", "a", "q", " "]) + x[i + r.randrange(2) :]
        return x

    left, right = [typo(x) for x in base] + ["", None, "a", "ab"], [typo(x) for x in base] + ["a", "ab", "abc", None]
    frame = lambda x, c: spark.createDataFrame([(v,) for v in x], f"{c} string")
    got = {(x.a, x.b): x.ratio for x in similar_names(frame(left, "a"), frame(right, "b"), least).collect()}
    want = {(a, b): SequenceMatcher(None, a, b).ratio() for a in set(left) - {None, ""} for b in set(right) - {None, ""}}
    want = {k: v for k, v in want.items() if v >= least}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items()) and len(want) > 12


def test_fuzzy_in_a_hot_block(spark):
    r = random.Random(1)
    names = ["".join(r.choices("abcdefgh", k=16)) for _ in range(300)]
    left = spark.createDataFrame([(1, x) for x in names] + [(2, names[0]), (2, "zz")], "block int, name string")
    right = spark.createDataFrame([(1, x[:7] + "y" + x[8:]) for x in names] + [(1, names[3][:-1] + "q")], "block int, name string")
    got = {(x.block, x.a): x.status for x in fuzzy(left, right, "block", "name").collect()}
    assert got[2, names[0]] == got[2, "zz"] == "no_match" and got[1, names[3]] == "ambiguous"
    assert sum(v == "matched" for v in got.values()) == 299


def test_a_second_name_below_the_limit_makes_a_match_ambiguous(spark):
    name = "abcdefghijklmnop"
    left = spark.createDataFrame([(k, name) for k in (1, 2, 3)], "block int, name string")
    right = spark.createDataFrame([(1, "abcdefghXjklmnop"), (2, "abcdefghXjklmnop"), (2, "abcdefghXjklmnopq"), (3, "abcdefghXjklmnopq")], "block int, name string")
    assert {(x.block, x.status, x.ratio) for x in fuzzy(left, right, "block", "name").collect()} == {(1, "matched", 0.9375), (2, "ambiguous", 0.9375), (3, "no_match", None)}


def test_ambiguous_and_nearest_fixtures(spark):
    """Two fixtures of one pairing within 36 hours: the nearer one counts if the other is more than 6 hours further."""
    t = lambda h: datetime.datetime(2024, 5, 1) + datetime.timedelta(hours=h)
    fixtures = spark.createDataFrame([("f1", "Aland", "Borduria", t(0), "Cup"), ("f2", "Aland", "Borduria", t(52), "Cup"), ("f3", "Syldavia", "Borduria", t(0), ""), ("f3", "Syldavia", "Borduria", t(1), ""), ("f4", None, "Borduria", t(0), "Cup")], "match_id string, home string, away string, at timestamp, competition string")
    rows = [(1, "", "Aland", "Borduria", t(30), "Cup"), (2, "", "Aland", "Borduria", t(23), "Cup"), (3, "f3", "x", "y", t(0), "Cup"), (4, "", "Aland", "Borduria", t(30), "League"), (5, None, None, "Borduria", t(0), "Cup"), (6, "", "Åland", "BORDURIA", None, "Cup"), (7, "", "Syldavia", "Borduria", t(0), "Cup"), (8, "", "Borduria", "aland!", t(53), "")]
    results = spark.createDataFrame(rows, "result_id long, match_id string, home string, away string, at timestamp, competition string")
    aliases = L.representatives(spark.createDataFrame([], "alias string, canonical string, place long"))
    got = {x.result_id: (x.fixture_id, x.method, x.confidence and round(x.confidence, 2)) for x in L.crosswalk(results, fixtures, aliases).collect()}
    assert got[1] == ("f2", "exact_home_away_within_36h", 0.95) and got[2] == ("f1", "exact_home_away_same_utc_date", 0.98)
    assert got[3] == got[7] == (None, "ambiguous_multiple_candidates", 0.0)
    assert got[4] == got[5] == got[6] == (None, "no_fixture_match", 0.0) and got[8] == ("f2", "reversed_home_away_same_utc_date", 0.93)


def test_full_days_as_all_pairs(spark, monkeypatch):
    """Many fixtures of a pairing within 36 hours, ties, empty competitions, exchanged and misspelt names: as by comparing each result with every
    fixture, while only a few candidates of each result are ranked."""
    r, start = random.Random(5), datetime.datetime(2024, 5, 1)
    teams = ["albania football union", "albanie football union", "borduria football union", "syldavia"]
    misspelt = {x: x.replace("football", "footbal") for x in teams}
    at = lambda: start + datetime.timedelta(hours=r.choice([*range(0, 48, 6), 100, 130, 131, 137, 200, 300]))
    fixtures = [(f"f{i:03d}", *r.sample(teams, 2), at(), r.choice(["cup", "league", "league", ""])) for i in range(480)]
    ratio = cache(lambda a, b: SequenceMatcher(None, a, b).ratio())
    results, pairs = [], 0
    for i in range(260):
        spell = r.choice([lambda x: x, lambda x: misspelt[x], lambda x: x.replace(" ", "' ")])
        results.append((i, r.choice(["", "", "", "f007"]) if i % 9 == 0 else "", *map(spell, r.sample(teams, 2)), at() + datetime.timedelta(hours=r.choice([0, 0, 30, 3])), r.choice(["cup", "league", "", "other"])))
    want = {}
    for i, id_, home, away, when, competition in results:
        found = []
        for f, h, a, kickoff, c in fixtures:
            hours, today, fits = abs((kickoff - when).total_seconds()) / 3600, when.date() == kickoff.date(), competition == "" or c in ("", competition)
            if id_ == f:
                found.append((1, 0, hours, f, False))
            if hours > 36 or not fits:
                continue
            hp, ap = plain(home, "a-z0-9"), plain(away, "a-z0-9")
            for rule, same, turned in ((2, (hp, ap) == (h, a), False), (4, (hp, ap) == (a, h), True), (6, (home, away) == (h, a), False)):
                if same:
                    found.append((rule + (not today), 0, hours, f, turned))
            like = max((min(ratio(home, x), ratio(away, y)), not t) for x, y, t in ((h, a, False), (a, h, True)))
            if like[0] >= 0.92:
                found.append((9 - today, -like[0], hours, f, not like[1]))
        found.sort()
        pairs += len(found)
        rule = found[0][0] if found else 0
        of_rule = [x for x in found if x[0] == rule][:2]
        sure = len(of_rule) == 1 or (rule >= 8 and of_rule[1][1] - of_rule[0][1] >= 0.03) or (rule in (3, 5, 7) and of_rule[0][2] + 6 < of_rule[1][2]) if found else False
        want[i] = (of_rule[0][3], L.RULES[rule - 1][0], "reversed" if of_rule[0][4] else "same", of_rule[0][2]) if sure else (None, "ambiguous_multiple_candidates" if found else "no_fixture_match", "ambiguous" if found else "unknown", None)
    ranked, real = [], L._ranked
    monkeypatch.setattr(L, "_ranked", lambda rows, order: ranked.append(rows.count()) or real(rows, order))
    columns = "match_id string, home string, away string, at timestamp, competition string"
    aliases = L.representatives(spark.createDataFrame([], "alias string, canonical string, place long"))
    crossed = L.crosswalk(spark.createDataFrame(results, f"result_id long, {columns}"), spark.createDataFrame(fixtures, columns), aliases)
    got = {x.result_id: (x.fixture_id, x.method, x.team_order, x.delta_hours) for x in crossed.collect()}
    assert {k: (got[k], v) for k, v in want.items() if got[k] != v} == {}
    assert len({v[1] for v in want.values()}) >= 8 and sum(ranked) < 8 * len(results) < pairs / 2


def test_markets_meet_fixtures_by_what_they_name(spark):
    markets = spark.createDataFrame([(1, "Will Korea Republic beat São Tomé?", "Sports"), (2, "Korea vs Tomé", ""), (3, "são tomé v korea republic, football", ""), (4, "Korea Republic and São Tomé president election", ""), (5, None, None)], "market_id long, text string, category string").selectExpr("*", "cast(null as date) as day")
    fixtures = spark.createDataFrame([(10, 1, 2, "Cup")], "match_id long, home long, away long, competition string").selectExpr("*", "date'2024-01-01' as day")
    terms = spark.createDataFrame([(1, "Korea Republic"), (2, "Sao Tome")], "team long, term string")
    assert {(x.market_id, x.team) for x in K.mentions(markets, terms).collect()} == {(1, 1), (1, 2), (3, 1), (3, 2), (4, 1), (4, 2)}
    got = [(x.market_id, x.score, x.confidence) for x in K.map_markets(markets, fixtures, terms, 5).orderBy("market_id").collect()]
    assert got == [(1, 82.0, "high"), (3, 86.0, "high")]
