"""Steps whose work must grow as their input: against plain counting, and against themselves in pieces."""

import datetime
import random
import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest

from touchline.operators import backtest as T
from touchline.operators import markets as K
from touchline.operators import records as L
from touchline.operators import similarity as M
from touchline.operators import tables as D
from touchline.operators import timeseries as S
from touchline.operators import tournament as G
from touchline.plans import CATALOG
from touchline.plans import backtest as Q
from touchline.plans.base import Tables
from touchline.streaming import ratings as R

FOLDER = "/root/testdata/sf0.001"


def test_elo_in_rounds(spark, monkeypatch):
    """Several leagues and rounds: the ratings that a round leaves are those the next one starts with."""
    matches = Tables(spark, FOLDER).match.selectExpr("match_id", "match_date", "hg", "ag", "comp_type", "neutral", "home % 16 + 100 * (match_id % 3) as home", "16 + away % 16 + 100 * (match_id % 3) as away")
    whole = {r.match_id: r for r in S.rolling_elo(matches).collect()}
    monkeypatch.setattr(S, "SPAN", len(whole) // 4 + 1)
    rounds = S.rolling_elo(matches)
    assert {r.match_id: r for r in rounds.collect()} == whole and len(rounds.inputFiles()) >= 4


def test_rounds_hold_few_matches_and_days_one_row(spark):
    """What a task sorts doesn't grow with the matches: rounds of less than half a million, and one row a team and day in as-of joins."""
    assert S.SPAN < 500_000
    day = lambda i: datetime.date(2020, 1, 1 + i)
    rows = spark.createDataFrame([(1, day(i % 3), i, None if i % 30 > 26 else float(i)) for i in range(90)], "team long, match_date date, match_id long, v double")
    keys = spark.createDataFrame([(1, day(i)) for i in range(4)] + [(2, day(1))], "team long, as_of date")
    found = S.asof_latest(rows, keys, "v")
    assert {(x.team, x.as_of.day): (x.v, x.matches_used, x.latest_match) for x in found.collect()} == {(1, 1): (None, 0, None), (1, 2): (84.0, 30, day(0)), (1, 3): (85.0, 60, day(1)), (1, 4): (86.0, 90, day(2)), (2, 2): (None, 0, None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Union") < plan.index("Aggregate")


def test_history_joins_no_matches(spark, monkeypatch):
    """Ratings come with their matches, in rounds too: goals and kinds are not joined to them again."""
    t = Tables(spark, FOLDER)
    given = {r.match_id: (r.comp_type, r.neutral, r.hg, r.ag) for r in t.match.collect()}
    whole = {r.match_id: tuple(r) for r in S.rolling_elo(t.match).collect()}
    monkeypatch.setattr(S, "SPAN", len(given) // 3 + 1)
    kept = S.rolling_elo(t.match, keep=("comp_type", "neutral", "hg", "ag")).collect()
    assert {r.match_id: tuple(r) for r in kept} == {k: (*whole[k], *given[k]) for k in given} and len(kept) == len(given)
    plan = Q.history(t)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in x and "match_id" in x for x in plan.split("\n"))


def test_last_ratings_are_hashed(spark):
    """No task sorts its matches to find a day's or a team's last one."""
    t = Tables(spark, FOLDER)
    for name in ("elo_asof_pre", "elo_asof", "elo_latest"):
        plan = CATALOG[name].plan(t)._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan, name


def test_stream_sorts_in_pieces():
    r = np.random.default_rng(1)
    rows = pd.DataFrame({"match_date": [datetime.date(2020, 1, 1) + datetime.timedelta(int(d)) for d in r.integers(0, 40, 5000)], "match_id": r.permutation(5000), "home": 1, "away": 2, "hg": 1.0, "ag": 0.0, "k": 20.0, "neutral": False})
    parts = list(R.in_order(iter([rows[i : i + 300] for i in range(0, 5000, 300)]), run=900, part=50))
    got = [(int(d), int(m)) for p in parts for d, m in zip(p["day"], p["match_id"], strict=True)]
    assert got == sorted(((d - R.EPOCH).days, m) for d, m in zip(rows["match_date"], rows["match_id"], strict=True))
    assert max(map(len, parts)) <= 50 * 6
    assert list(R.in_order(iter([]))) == []


def test_near_days_as_all_pairs(spark):
    r = random.Random(4)
    rows = [(i, r.choice("ab"), datetime.date(2020, 1, 1) + datetime.timedelta(r.choice([0, 0, 1, 3, 9, 40, 44, 90 + i]))) for i in r.sample(range(1000), 120)]
    got = {x.id: (x.n, x.nearest) for x in D.near_days(spark.createDataFrame(rows, "id long, by string, day date"), "by", "id", "day").collect()}
    for i, by, day in rows:
        others = [(abs((d - day).days), j) for j, b, d in rows if b == by and j != i and abs((d - day).days) <= 3]
        assert got[i] == (len(others), min(others)[1] if others else None)


def test_markets_of_a_pair_do_not_all_meet_its_fixtures(spark):
    """Every fixture's first markets as by comparing it with all, and no join whose rows are fixtures times markets."""
    r, day = random.Random(6), datetime.date(2020, 1, 1)
    said = ["A vs B", "A and B soccer friendly", "world cup A B game", "A, B", "election A v B", "A beat B world cup"]
    markets = [(i, r.choice(said), r.choice(["Sports", "", "Politics"]), r.choice([None, day + datetime.timedelta(r.randrange(30))])) for i in range(400)]
    fixtures = [(i, 1, 2, r.choice(["world cup", "friendly", ""]), day + datetime.timedelta(r.randrange(30))) for i in range(60)]
    m = spark.createDataFrame(markets, "market_id long, text string, category string, day date")
    f = spark.createDataFrame(fixtures, "match_id long, home long, away long, competition string, day date")
    found = K.map_markets(m, f, spark.createDataFrame([(1, "A"), (2, "B")], "team long, term string"), 3)
    want = set()
    for i, _, _, competition, kickoff in fixtures:
        scored = []
        for j, text, category, at in markets:
            words = f" {' '.join(text.lower().replace(',', ' ').split())} "
            has = lambda x: any(f" {w} " in words for w in x)  # noqa: B023, E731
            sports, matchup, sporting = has(K.SPORTS_WORDS), has(K.MATCHUP_WORDS), category == "Sports"
            if (sports or matchup or sporting) and not ((has(K.POLITICAL_WORDS) or category == "Politics") and not sports):
                score = 60 + 12 * matchup + 14 * sports + 10 * sporting + 8 * bool(competition and f" {competition} " in words) + 6 * (at is not None and abs((at - kickoff).days) <= 2)
                scored.append((-score, j, "high" if (sports or sporting) and score >= 75 else "medium"))
        want |= {(i, j, float(-s), c) for s, j, c in sorted(scored)[:3]}
    assert {tuple(x) for x in found.collect()} == want


def test_sets_share_their_model(spark, monkeypatch):
    """A match's probabilities are taken once for each model, not for each set."""
    asked, real = [], T.poisson_outcomes
    monkeypatch.setattr(T, "poisson_outcomes", lambda rows: asked.append(rows) or real(rows))
    t = Tables(spark, FOLDER)
    out = T.walk_forward_training(Q.matches(t), Q.rated(t))
    assert out.count() == len(T.SETS) * t.match.count() and asked[0].count() == 5 * t.match.count()


def test_names_that_are_all_alike(spark, monkeypatch):
    """Numbers with a long common start: every similar pair within its block, and hardly any other pair is compared."""
    r = random.Random(2)
    left = [(i % 3, f"Supplier#{i:09d}") for i in range(700)]
    right = [(b, r.choice([n.replace("pp", "p"), n[:17], n.replace("0000", "00O0")])) for b, n in left]
    a, b = spark.createDataFrame(left, "block int, a string"), spark.createDataFrame(right, "block int, b string")
    ratios = {(k, x, y): SequenceMatcher(None, x, y).ratio() for k, x in set(left) for j, y in set(right) if j == k}
    want = {k: v for k, v in ratios.items() if v >= 0.89}
    assert {(x.block, x.a, x.b): x.ratio for x in M.similar_names(a, b, 0.89, ("block",)).collect()} == want
    monkeypatch.setattr(M, "ratio", lambda a, b: M.F.lit(1.0))
    assert len(want) <= M.similar_names(a, b, 0.89, ("block",)).count() <= 1.2 * len(want) < 0.35 * len(ratios)


def test_bracket_rounds_follow_its_depth(spark, tmp_path, monkeypatch):
    """A chain of 70 matches and a long cycle among many: every slot told, and cycles add no rounds."""
    n, turn = 70, 1000
    rows = [(i, f"Winner Match {i + 1}" if i < n else "T0", "T1", 1, 0, None) for i in range(1, n + 1)]
    rows += [(turn + i, f"Loser of Match {turn + (i + 1) % 40}", " 3rd Group A/B ", 0, 1, None) for i in range(40)]
    rows += [(2000, f"Loser Match {turn}", "Runner-up Group A", None, 1, None), (2001, "Winner Match 2000", "3rd group B/C", 1, 1, "away"), (2002, "Loser Match 2001", "Loser Match 3000", 1, 1, None), (2003, "Winner Match 2002", "Third place", 1, 0, None)]
    bracket = spark.createDataFrame(rows, "match_no long, home string, away string, hg long, ag long, advancing string")
    tables = spark.createDataFrame([(g, f"{g}{p}", 10 - p - (g == "B"), 0, 0, p) for g in "AB" for p in (1, 2, 3)] + [("LONG", "X", 1, 0, 0, 1)], "grp string, team string, points long, goal_difference long, goals_for long, position int")
    monkeypatch.setattr("touchline.sources.session.shared_dir", lambda s: str(tmp_path))
    got = {r.match_no: (r.home, r.away, r.home_status, r.away_status) for r in G.resolve_bracket(bracket, tables).collect()}
    assert all(got[i] == ("T0", "T1", "resolved" if i < n else "source", "source") for i in range(1, n + 1))
    assert all(got[turn + i][1:] == ("A3", "cycle", "resolved") for i in range(40))
    assert got[2000] == (f"Loser Match {turn}", "A2", "cycle", "resolved") and got[2001] == ("Winner Match 2000", "3rd group B/C", "pending", "pending")
    assert got[2002] == ("Loser Match 2001", "Loser Match 3000", "pending", "pending")
    assert got[2003] == ("Winner Match 2002", "Third place", "manual", "manual") and len(got) == len(rows)
    assert 7 <= len(list(tmp_path.glob("touchline/bracket-*/round-*"))) <= 9  # 69 steps: 2^7, and two more


def test_backtest_sorts_no_matches(spark):
    t = Tables(spark, FOLDER)
    plan = Q.predictions(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and not any("SortMergeJoin" in x and "match_date" in x for x in plan.split("\n"))


def rows_of_joins(node):
    """Rows that leave the joins of a plan that has run."""
    kids = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
    return ("Join" in node.nodeName() and node.metrics().apply("numOutputRows").value()) + sum(map(rows_of_joins, kids))


@pytest.mark.parametrize("top", [1, 2, 5])
def test_fixtures_meet_few_slugs(spark, top):
    """Against plain counting, odd rows included; and a fixture meets the first slugs of its day and of its pair, not all of the pair."""
    r = random.Random(top)
    day = lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(i)
    slugs = [f"{r.choice(['fif', 'cup', 'ab'])}-{'-'.join(r.sample(['n1', 'n2', 'n3'], 2))}-{day(r.randrange(90))}" for _ in range(1500)]
    slugs += [None, "", "fif-n1-n2", "cup-n2-n1", "fif-n1-n1-2020-01-05", "fif-n1-n2-2020-02-31", "FIF-n1-n2-2020-01-05", "fif-n1-n2-2020-01-05x", "fif-n4-n5", "fif-n1-n2"]
    fixtures = [(i, *r.sample(["n1", "n2", "n3", "n9"], 2), day(r.randrange(-5, 95))) for i in range(600)] + [(700, "n1", "n2", None), (701, "n2", "n2", day(3)), (702, "n4", "n5", day(3)), (703, None, "n2", day(3)), (5, "n2", "n3", day(7))]
    want = {}
    for i, home, away, when in fixtures:
        for s in set(slugs) - {None}:
            m = re.fullmatch(r"([a-z]+)-([a-z0-9]+)-([a-z0-9]+)(?:-(\d{4}-\d\d-\d\d))?", s)
            if m and home != away and m[2] != m[3] and {home, away} == {m[2], m[3]}:
                on, own = m[4] == str(when), m[1] == "fif"
                want.setdefault(i, []).append((-70 - 20 * on - 10 * own, s, "high" if on and own else "medium", "" if on else "date mismatch"))
    want = sorted((i, s, -score, label, told) for i, rows in want.items() for score, s, label, told in sorted(rows)[:top])
    found = L.slug_scores(spark.createDataFrame([(s,) for s in slugs], "slug string"), spark.createDataFrame(fixtures, "match_id long, home_code string, away_code string, day date"), top)
    assert sorted(map(tuple, found.collect())) == want
    assert 0 < rows_of_joins(found._jdf.queryExecution().executedPlan()) <= 4 * top * len(fixtures)
