"""Group tables as of a day, what teams need, context shifts, and bracket resolution."""

from __future__ import annotations

import uuid
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def standings(rows: DataFrame, teams: DataFrame, before: Column, by: str = "grp") -> DataFrame:
    """rows: long team matches with grp, team, goals and match_date; teams: grp, team. Only matches strictly before ``before`` count;
    teams without any are there with zeros. Position is by points, goal difference, goals, then name."""
    points = F.when(F.col("team_goals") > F.col("opponent_goals"), 3).when(F.col("team_goals") == F.col("opponent_goals"), 1).otherwise(0)
    played = rows.where(F.col("match_date") < before).groupBy(by, "team").agg(
        F.count("*").alias("played"), F.sum(points).alias("points"), F.sum("team_goals").alias("goals_for"), F.sum("opponent_goals").alias("goals_against")
    )
    table = teams.join(played, [by, "team"], "left").fillna(0, ["played", "points", "goals_for", "goals_against"]).withColumn("goal_difference", F.col("goals_for") - F.col("goals_against"))
    order = Window.partitionBy(by).orderBy(F.col("points").desc(), F.col("goal_difference").desc(), F.col("goals_for").desc(), "team")
    return table.withColumn("position", F.row_number().over(order))


def needs(table: DataFrame, remaining: DataFrame, advance: int = 2, by: str = "grp") -> DataFrame:
    """incentive label of each team from its group's table; remaining: grp, team, remaining (matches left)."""
    group = Window.partitionBy(by)
    cut = F.max(F.when(F.col("position") == advance, F.col("points"))).over(group)
    chaser = F.coalesce(F.max(F.when(F.col("position") == advance + 1, F.col("points"))).over(group), F.lit(-99))
    t = table.join(remaining, [by, "team"], "left").withColumn("remaining", F.coalesce("remaining", F.lit(0))).withColumns({"cutoff": cut, "margin": F.col("points") - chaser})
    inside, last = F.col("position") <= advance, F.col("remaining") <= 1
    label = (
        F.when(inside & last & (F.col("position") == advance) & (F.col("margin") <= 0), "needs_win")
        .when(inside & last & (F.col("margin") >= 1), "draw_enough")
        .when(inside & last & (F.col("margin") >= 4), "already_qualified_likely")
        .when(inside, "must_not_lose")
        .when(last & (F.col("points") + 1 <= F.col("cutoff")), "needs_win")
        .when(F.col("points") + 3 < F.col("cutoff"), "already_eliminated_likely")
        .otherwise("needs_win")
    )
    return t.withColumn("label", label)


def context_of(home: Column, away: Column) -> Column:
    """Kind of match from both teams' labels."""
    both = lambda x: (home == x) & (away == x)
    either = lambda x, y: ((home == x) & (away == y)) | ((home == y) & (away == x))
    safe = lambda x: x.isin("already_qualified_likely", "already_eliminated_likely")
    return (
        F.when(both("needs_win"), "both_need_win")
        .when(either("needs_win", "draw_enough"), "one_needs_win_other_draw_enough")
        .when(both("draw_enough"), "both_draw_ok")
        .when(safe(home) & safe(away), "dead_rubber")
        .when(((home == "needs_win") & safe(away)) | ((away == "needs_win") & safe(home)), "one_safe_other_needs_win")
        .otherwise("unknown")
    )


#: fixed values: change of draw, over 2.5 and both to score in each context (fractions of 1)
SHIFTS = {
    "one_needs_win_other_draw_enough": (0.03, -0.015, 0.01),
    "both_need_win": (-0.025, 0.02, 0.02),
    "both_draw_ok": (0.04, -0.02, -0.01),
    "one_safe_other_needs_win": (-0.01, 0.015, 0.015),
}


def adjusted(rows: DataFrame, most: float = 0.05) -> DataFrame:
    """1X2 and goal markets moved by the context; each of 1X2 by ``most`` at most, then scaled to sum to 1; complements follow."""
    c = F.col("context")
    pick = lambda i: C.lookup(c, {k: v[i] for k, v in SHIFTS.items()}, 0.0)
    asym = c == "one_needs_win_other_draw_enough"
    home_ok = F.col("home_label") == "draw_enough"
    half = F.when(c.isin("both_need_win", "both_draw_ok"), -pick(0) / 2).otherwise(0.0)
    dh = F.when(asym & home_ok, -0.02).when(asym, -0.01).otherwise(half)
    da = F.when(asym & home_ok, -0.01).when(asym, -0.02).otherwise(half)
    moved = {"home_win": dh, "draw": pick(0), "away_win": da}
    low = {k: F.greatest(F.lit(0.01), F.least(F.lit(0.98), F.col(k) + F.greatest(F.lit(-most), F.least(F.lit(most), d)))) for k, d in moved.items()}
    total = low["home_win"] + low["draw"] + low["away_win"]
    out = {f"adj_{k}": v / total for k, v in low.items()}
    out |= {"adj_over_2_5": F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("over_2_5") + pick(1))), "adj_btts_yes": F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("btts_yes") + pick(2)))}
    return rows.withColumns(out).withColumns({"adj_under_2_5": 1 - F.col("adj_over_2_5"), "adj_btts_no": 1 - F.col("adj_btts_yes")})


def context_evaluation(rows: DataFrame) -> DataFrame:
    """One row: how baseline and adjusted probabilities did on completed matches (Brier scores here are divided by three), and how far the adjusted mean
    draw lies from the share of draws. rows: home_win, draw, away_win, adj_home_win, adj_draw, adj_away_win, actual."""
    sets = {"baseline": ("home_win", "draw", "away_win"), "context": ("adj_home_win", "adj_draw", "adj_away_win")}
    p = {n: [F.col(c) for c in cols] for n, cols in sets.items()}
    y = F.col("actual")
    return rows.where("actual is not null").agg(
        F.count("*").alias("n"),
        *[F.avg(C.brier(*p[n], y) / 3).alias(f"{n}_brier") for n in sets],
        *[F.avg(C.log_loss(C.of_actual(*p[n], y))).alias(f"{n}_log_loss") for n in sets],
        (F.avg("adj_draw") - F.avg((y == "draw").cast("int"))).alias("draw_calibration_delta"),
    )


#: a slot of a match that names no team yet, and its parts
SLOT = r"(?i)^(winner|loser|runner[- ]up|3rd|third)\b"
MATCH_SLOT = r"(?i)^(winner|loser)\s+(?:of\s+)?match\s+([0-9]+)$"
GROUP_SLOT = r"(?i)^(winner|runner[- ]up)\s+(?:of\s+)?group\s+([a-z])$"
THIRD_SLOT = r"(?i)^(?:3rd|third)\s+(?:of\s+)?groups?\s+([a-z](?:\s*[/,]\s*[a-z])*)$"


def group_tables(matches: DataFrame) -> DataFrame:
    """grp, team, points, goal_difference, goals_for, position of matches with grp, home, away, hg, ag; matches without goals don't count, and teams
    without a match that does aren't there. Sums are partial before rows move; a table has a row a team."""
    side = lambda own, a, b: F.struct(F.col(own).alias("team"), F.col(a).alias("own"), F.col(b).alias("other"))
    rows = matches.where("hg is not null and ag is not null").select("grp", F.inline(F.array(side("home", "hg", "ag"), side("away", "ag", "hg"))))
    points = F.when(F.col("own") > F.col("other"), 3).when(F.col("own") == F.col("other"), 1).otherwise(0)
    table = rows.groupBy("grp", "team").agg(F.sum(points).alias("points"), F.sum(F.col("own") - F.col("other")).alias("goal_difference"), F.sum("own").alias("goals_for"))
    order = Window.partitionBy("grp").orderBy(F.desc("points"), F.desc("goal_difference"), F.desc("goals_for"), "team")
    return table.withColumn("position", F.row_number().over(order))


def resolve_bracket(bracket: DataFrame, tables: DataFrame) -> DataFrame:
    """Teams of a bracket's slots: match_no, home, away (resolved where that can be proven, else as given), home_status, away_status, status.

    bracket: match_no (unique), home, away (a team, or `Winner Match 12`, `Loser Match 12`, `Winner Group A`, `Runner-up Group A`, `3rd Group A/B/C`),
    hg, ag, advancing (`home` or `away`: who goes on after a draw); tables: of group_tables(). The winner's side of a match follows from
    its result alone, so a slot that names a match points to one slot of that match. Pointers are followed by doubling: each round joins
    every slot that has not reached an end with the one it points to, until a round ends none; there are as many rounds as the logarithm of the
    bracket's depth and two more, whether or not there are cycles, and no cap. The third of several groups is the best of their thirds, if all of them have one.

    Statuses: `source` (a team was given), `resolved`, `pending` (no such match, no result, a group without a table, or a slot behind it is not
    resolved), `manual` (a draw without advancing, or a text of another form), `cycle` (the slot depends on itself).
    """
    from ..sources.session import shared_dir

    spark, at = bracket.sparkSession, f"{shared_dir(bracket.sparkSession)}/touchline/bracket-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    side = lambda n, c: F.struct(F.lit(n).alias("side"), F.col(c).alias("text"))
    # dealt first: texts are costly to read, and a bracket may lie in one small file
    slots = bracket.repartition("match_no").select("match_no", F.inline(F.array(side(0, "home"), side(1, "away"))))
    text = F.btrim("text")
    slots = slots.withColumns({"mode": F.lower(F.regexp_extract(text, MATCH_SLOT, 1)), "ref": F.regexp_extract(text, MATCH_SLOT, 2).try_cast("long"), "place": F.regexp_replace(F.lower(F.regexp_extract(text, GROUP_SLOT, 1)), "-", " "), "grp": F.upper(F.regexp_extract(text, GROUP_SLOT, 2)), "groups": F.split(F.upper(F.regexp_replace(F.regexp_extract(text, THIRD_SLOT, 1), r"\s", "")), "[/,]"), "free": ~text.rlike(SLOT)})
    # a slot names groups by one letter, so these are a few rows, whatever the number of tables
    lettered = tables.where(F.col("grp").rlike("^[A-Z]$"))
    named = lettered.where("position <= 2").select("grp", F.when(F.col("position") == 1, "winner").otherwise("runner up").alias("place"), F.col("team").alias("ranked"))
    third = F.struct((-F.col("points")).alias("p"), (-F.col("goal_difference")).alias("d"), (-F.col("goals_for")).alias("g"), "team")
    thirds = lettered.where("position = 3").agg(F.map_from_entries(F.collect_list(F.struct("grp", third.alias("third")))).alias("thirds"))
    slots = slots.join(F.broadcast(named), ["grp", "place"], "left").join(F.broadcast(thirds), how="cross")
    found = F.transform("groups", lambda g: F.try_element_at("thirds", g))
    best = F.when(F.forall(found, lambda x: x.isNotNull()), F.array_min(found).getField("team"))
    of_match, of_group, of_third = F.col("mode") != "", F.col("place") != "", F.col("groups")[0] != ""
    name = F.when(of_group, F.col("ranked")).when(of_third, best).when(F.col("free"), F.col("text"))
    state = F.when(of_match, None).when(name.isNotNull(), F.when(of_group | of_third, "resolved").otherwise("source")).when(of_group | of_third, "pending").otherwise("manual")
    read = written(slots.select((F.col("match_no") * 2 + F.col("side")).alias("slot"), "match_no", "side", "text", "mode", "ref", F.when(~of_match, name).alias("team"), state.alias("state")), "slots")
    won = F.when(F.col("hg") > F.col("ag"), 0).when(F.col("hg") < F.col("ag"), 1).when(F.col("advancing") == "home", 0).when(F.col("advancing") == "away", 1)
    played = bracket.select(F.col("match_no").alias("ref"), won.alias("won"), (F.col("hg").isNotNull() & F.col("ag").isNotNull()).alias("over"))
    # only slots that name a match look for one: the others have no key and would all meet in one task
    naming = read.where("mode <> ''").join(played, "ref", "left")
    points = F.col("won").isNotNull()
    target = F.when(points, F.col("ref") * 2 + F.when(F.col("mode") == "winner", F.col("won")).otherwise(1 - F.col("won")))
    waiting = F.when(points, "points").when(F.coalesce("over", F.lit(False)), "manual").otherwise("pending")
    now = written(naming.select("slot", "match_no", "side", "text", target.alias("target"), "team", waiting.alias("state")).unionByName(read.where("mode = ''").select("slot", "match_no", "side", "text", F.lit(None).cast("long").alias("target"), "team", "state")), "now")
    ends = now.where("target is null").select(F.col("slot").alias("target"), F.col("team").alias("end_team"), F.col("state").alias("end_state"))
    # pointers of pointers; one whose slot points no further has ended and rests. Lengths of ways to an end have no gaps, so after a round in which
    # none ends only cycles are left
    active, rested = now.where("target is not null").select("slot", "target"), None
    for i in count():
        onward = (active if rested is None else active.unionByName(rested)).select(F.col("slot").alias("target"), F.col("target").alias("further"))
        moved = written(active.join(onward, "target", "left").select("slot", F.coalesce("further", "target").alias("target"), F.col("further").isNull().alias("ended")), f"round-{i}")
        ended, active = moved.where("ended").drop("ended"), moved.where("not ended").drop("ended")
        if ended.isEmpty():
            break
        rested = ended if rested is None else rested.unionByName(ended)
    found = (active if rested is None else active.unionByName(rested)).join(ends, "target", "left")
    team, status = F.col("end_team"), F.when(F.col("end_state").isNull(), "cycle").when(F.col("end_team").isNull(), "pending").otherwise("resolved")
    told = now.join(found.select("slot", team.alias("far_team"), status.alias("far_status")), "slot", "left")
    told = told.select("match_no", "side", F.coalesce("team", "far_team", "text").alias("name"), F.coalesce("far_status", "state").alias("status"))
    both = told.groupBy("match_no").agg(*[F.max(F.when(F.col("side") == k, F.col(c))).alias(n) for k, s in enumerate(("home", "away")) for c, n in (("name", s), ("status", f"{s}_status"))])
    any_ = lambda x: (F.col("home_status") == x) | (F.col("away_status") == x)
    overall = F.when(any_("cycle"), "cycle").when(any_("manual"), "manual").when(any_("pending"), "pending").when(any_("resolved"), "resolved").otherwise("source")
    return both.withColumn("status", overall)
