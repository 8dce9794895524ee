"""Rating inputs, priors, reviews, prediction logs and the mapping of markets to fixtures, as joins and sums over tables of any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.names import name_key
from ..sources.session import cut

#: fixed values: matches after which a match counts half, rating of an unknown opponent, and how far an opponent moves a match's weight
HALF_LIFE, UNKNOWN_ELO, STEP = 5.0, 1750.0, 0.18


def recent_features(rows: DataFrame, fallback: DataFrame, most: int = 40, form_matches: int = 10) -> DataFrame:
    """attack, defense and recent_form of each team from its newest matches, weighted by rank: half for every HALF_LIFE matches back. Goals count more, and
    conceded ones less, against strong opponents. ``fallback`` (team, attack, defense, form) is for teams without a match.

    rows: team, match_date, match_id, team_goals, opponent_goals, opponent_elo. Only a team's ``most`` newest rows pass the window.
    """
    newest = Window.partitionBy("team").orderBy(F.desc("match_date"), F.desc("match_id"))
    own = rows.withColumn("rank", F.row_number().over(newest) - 1).where(F.col("rank") < most)
    weight = F.exp(F.col("rank") * (-math.log(2) / HALF_LIFE))
    raw = (F.coalesce("opponent_elo", F.lit(UNKNOWN_ELO)) - UNKNOWN_ELO) / 500 * STEP
    score = F.when(F.col("team_goals") > F.col("opponent_goals"), 1.0).when(F.col("team_goals") == F.col("opponent_goals"), 0.5).otherwise(0.0)
    late = F.col("rank") < form_matches
    mean = lambda x, w: F.sum(x * w) / F.sum(w)
    seen = own.groupBy("team").agg(
        F.count("*").alias("n_matches"),
        mean(F.col("team_goals") * C.clamp(1 + raw, 0.85, 1.15), weight).alias("scored"),
        mean(F.col("opponent_goals") * C.clamp(1 - raw, 0.85, 1.15), weight).alias("conceded"),
        mean(F.when(late, score), F.when(late, weight)).alias("form_mean"),
    )
    both = seen.join(fallback.select("team", *[F.col(c).alias(f"given_{c}") for c in ("attack", "defense", "form")]), "team", "full_outer")
    given = lambda x, c: F.when(F.col("n_matches") > 0, x).otherwise(F.coalesce(f"given_{c}", F.lit(0.55)))
    return both.select(
        "team",
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        given(C.clamp(F.lit(0.22) + F.col("scored") / 2.7 * 0.73, 0.20, 0.95), "attack").alias("attack"),
        given(C.clamp(F.lit(0.95) - F.col("conceded") / 2.8 * 0.73, 0.20, 0.95), "defense").alias("defense"),
        given(C.clamp(F.col("form_mean"), 0.0, 1.0), "form").alias("recent_form"),
    )


def normalised_ratings(raw: DataFrame) -> DataFrame:
    """Ratings with what is missing derived from the rank, all within their bounds: team (trimmed; none: left out), rank, elo, attack, defense, recent_form,
    training_temp_c, training_humidity_pct, data_quality."""
    number = lambda c, default: F.coalesce(C.to_double(F.col(c).cast("string")), default if isinstance(default, Column) else F.lit(float(default)))
    rows = raw.withColumn("team", F.btrim(F.col("team").cast("string"))).where("team <> ''").withColumn("_rank", number("rank", 80.0))
    bounded = C.clamp(F.col("_rank"), 1.0, 150.0)
    rows = rows.withColumn("_score", C.clamp(F.lit(0.92) - (bounded - 1) * 0.0048, 0.24, 0.92))
    elo = number("elo", C.clamp(F.lit(2110.0) - (bounded - 1) * 5.3, 1320.0, 2110.0))
    unit = lambda c, default: F.round(C.clamp(number(c, default), 0.0, 1.0), 3).alias(c)
    return rows.select(
        "team",
        F.bround("_rank").cast("long").alias("rank"),
        F.round(C.clamp(elo, 1200.0, 2200.0), 1).alias("elo"),
        unit("attack", F.col("_score")),
        unit("defense", F.col("_score")),
        unit("recent_form", F.col("_score") * 0.85),
        number("training_temp_c", 20.0).alias("training_temp_c"),
        number("training_humidity_pct", 60.0).alias("training_humidity_pct"),
        F.coalesce("data_quality", F.lit("manual_csv")).alias("data_quality"),
    )


REFERENCES = ("reference_attack", "reference_defense", "reference_form", "reference_overall")


def merge_priors(existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """Existing priors with the numbers of proposed ones for the same team (by key) where these are ready and numbers; text columns follow if any number
    did. Teams that aren't there yet stay out. proposed: team, ready, place (the later row wins, column by column), REFERENCES, source."""
    number = lambda c: C.to_double(F.col(c).cast("string"))
    known = F.coalesce(*[number(c) for c in REFERENCES]).isNotNull()
    last = lambda x: F.max_by(x, F.when(x.isNotNull(), F.col("place")))
    source = F.when(known & (F.btrim("source") != ""), F.col("source"))
    new = proposed.where("ready").groupBy(name_key(F.col("team")).alias("_key")).agg(*[last(F.round(number(c), 3)).alias(f"new_{c}") for c in REFERENCES], last(source).alias("new_source"))
    j = existing.withColumn("_key", name_key(F.col("team"))).join(new, "_key", "left")
    return j.select("team", *[F.coalesce(f"new_{c}", c).alias(c) for c in REFERENCES], F.coalesce("new_source", "source").alias("source"))


def apply_reviews(ratings: DataFrame, sheet: DataFrame) -> DataFrame:
    """Ratings with the recommended values of approved reviews (within 0.35 and 0.9), where the rating was generated or a candidate for review. A later approved row
    (place) of a team finds it reviewed already, so the first one counts."""
    approved = sheet.where("lower(trim(review_status)) = 'approved'").withColumn("_key", name_key(F.col("team"))).where("_key <> ''")
    first = approved.groupBy("_key").agg(F.min_by(F.struct(*[F.col(f"recommended_{c}").alias(c) for c in ("attack", "defense", "form")], F.btrim(F.coalesce("human_notes", F.lit(""))).alias("notes")), "place").alias("r"))
    j = ratings.withColumn("_key", name_key(F.col("team"))).join(first, "_key", "left")
    take = F.col("r").isNotNull() & F.col("data_quality").isin("generated_from_behavior", "manual_review_candidate")
    value = lambda c: F.when(take, F.round(C.clamp(F.coalesce(C.to_double(F.col(f"r.{c}").cast("string")), F.col(c)), 0.35, 0.90), 3)).otherwise(F.col(c)).alias(c)
    note = F.btrim(F.concat_ws(" ", F.when(F.col("notes") != "", F.col("notes")), F.lit("External prior review approved; manual reviewed prior."), F.when(F.col("r.notes") != "", F.col("r.notes"))))
    return j.select("team", value("attack"), value("defense"), value("form"), F.when(take, "manual_reviewed").otherwise(F.col("data_quality")).alias("data_quality"), F.when(take, note).otherwise(F.col("notes")).alias("notes"))


SIDES = ("home_win", "draw", "away_win")


def pivot_log(log: DataFrame, *keys: str) -> DataFrame:
    """A prediction log's rows (one a side) as one row for each of ``keys``: raw, behavior and market 1X2 probabilities, each set scaled to 1 or null as a
    whole, market_status and the lowest mapping_confidence. Without all raw probabilities there is no row.

    log: keys, place (the last row of a side counts), side, primary, fallback, behavior, price_cents, price_side, mapping_confidence."""
    valid = lambda c: F.when((F.col(c) >= 0) & (F.col(c) <= 1), F.col(c))
    price = F.col("price_cents") / 100
    price = F.when(F.upper(F.coalesce("price_side", F.lit("YES"))) == "NO", 1 - price).otherwise(price)
    values = {"raw": F.coalesce(valid("primary"), F.col("fallback")), "behavior": F.col("behavior"), "market": price}
    # a row without a price leaves the one before it; other values are those of the side's last row
    counts = {"raw": F.lit(True), "behavior": F.lit(True), "market": price.isNotNull()}
    of = lambda n, s: F.max_by(values[n], F.when((F.col("side") == s) & counts[n], F.col("place")))
    order = F.when(F.lower("mapping_confidence") == "low", 0).when(F.lower("mapping_confidence") == "medium", 1).when(F.lower("mapping_confidence") == "high", 2).otherwise(99)
    lowest = F.min_by(F.lower("mapping_confidence"), F.when(F.col("mapping_confidence").isNotNull(), order))
    wide = log.groupBy(*keys).agg(*[of(n, s).alias(f"{n}_{s}") for n in values for s in SIDES], lowest.alias("mapping_confidence"))
    for n in values:
        whole = F.lit(True)
        for s in SIDES:
            whole = whole & F.coalesce(F.col(f"{n}_{s}").between(0, 1), F.lit(False))
        total = F.col(f"{n}_home_win") + F.col(f"{n}_draw") + F.col(f"{n}_away_win")
        wide = wide.withColumn("_sum", F.when(whole & (total > 0), total)).withColumns({f"{n}_{s}": F.col(f"{n}_{s}") / F.col("_sum") for s in SIDES}).drop("_sum")
    status = F.when(F.col("market_home_win").isNotNull(), "joined_price").otherwise("event_found_no_usable_price")
    return wide.where("raw_home_win is not null").withColumn("market_status", status)


#: sides of a market and what of a result decides them
DECIDED = {
    "home_win": "hg > ag",
    "away_win": "hg < ag",
    "draw": "hg = ag",
    "over_2_5": "hg + ag > 2",
    "under_2_5": "hg + ag <= 2",
    "btts_yes": "hg > 0 and ag > 0",
    "btts_no": "hg = 0 or ag = 0",
    "home_not_win": "hg <= ag",
    "away_or_draw": "hg <= ag",
    "away_not_win": "hg >= ag",
    "home_or_draw": "hg >= ag",
}


def scored_log(log: DataFrame, results: DataFrame) -> DataFrame:
    """Log rows of completed matches whose side a result decides: prob, actual (turned round for a NO side), signal_strength, gap. log: match_id, side,
    probability, price_side, signal_strength, gap; results: match_id, hg, ag, completed."""
    j = log.join(results.where("completed").select("match_id", "hg", "ag"), "match_id")
    came = F.lit(None).cast("boolean")
    for side, rule in DECIDED.items():
        came = F.when(F.lower("side") == side, F.expr(rule)).otherwise(came)
    came = F.when(F.upper(F.coalesce("price_side", F.lit("YES"))) == "NO", ~came).otherwise(came)
    rows = j.select("match_id", F.col("probability").alias("prob"), came.cast("int").alias("actual"), "signal_strength", "gap")
    return rows.where("actual is not null and prob between 0 and 1")


def log_metrics(scored: DataFrame) -> DataFrame:
    """n, Brier score, log loss, mean gap and hit rate, of all rows (signal null) and by signal strength, in one pass."""
    p = C.clamp(F.col("prob"), 0.001, 0.999)
    loss = -(F.col("actual") * F.log(p) + (1 - F.col("actual")) * F.log(1 - p))
    each = F.explode(F.array(F.lit("all"), F.coalesce("signal_strength", F.lit("")))).alias("signal")
    return scored.select("prob", "actual", "gap", loss.alias("loss"), each).groupBy("signal").agg(
        F.count("*").alias("n"), F.avg(F.pow(F.col("prob") - F.col("actual"), 2)).alias("brier_score"), F.avg("loss").alias("log_loss"), F.avg("gap").alias("mean_gap"), F.avg("actual").alias("hit_rate")
    )


def slug_scores(slugs: DataFrame, fixtures: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` slugs of each fixture: 35 for either team's code, 20 for the day, 10 for the competition's prefix. A slug without both codes is rejected, so
    slugs and fixtures meet by their unordered pair of codes, and no fixture is compared with all slugs.

    What a fixture adds to a slug's own points is whether the days agree. So of each pair the ``top`` slugs are kept twice, with the prefix and without: of each
    day, for the fixtures of that day, and of all days, for the others; a fixture meets only these, and no fixture meets all slugs of its pair.

    slugs: slug (prefix-code-code-yyyy-MM-dd); fixtures: match_id, home_code, away_code, day. Ties go to the first slug by name.
    """
    part = lambda i: F.regexp_extract("slug", r"^([a-z]+)-([a-z0-9]+)-([a-z0-9]+)(?:-(\d{4}-\d{2}-\d{2}))?$", i)
    parsed = slugs.select("slug").distinct().select("slug", part(1).alias("prefix"), part(2).alias("one"), part(3).alias("two"), part(4).try_cast("date").alias("hint")).where("one <> '' and one <> two")
    key = lambda a, b: [F.least(a, b).alias("low"), F.greatest(a, b).alias("high")]

    def first(df: DataFrame, *by: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("low", "high", "own", *by).orderBy("slug"))
        return df.withColumn("place", place).where(F.col("place") <= top).drop("place")

    daily = cut(first(parsed.select("slug", "hint", (F.col("prefix") == "fif").alias("own"), *key(F.col("one"), F.col("two"))), "hint"))
    met = fixtures.where("home_code <> away_code").select("match_id", "day", *key(F.col("home_code"), F.col("away_code")))
    on_day = met.join(daily.withColumnRenamed("hint", "day"), ["low", "high", "day"]).select("match_id", "slug", "own", F.lit(True).alias("on_day"))
    # slugs of the fixture's own day among those of all days have come already, and stand before the others
    other = met.join(first(daily), ["low", "high"]).where(~F.coalesce(F.col("hint") == F.col("day"), F.lit(False))).select("match_id", "slug", "own", F.lit(False).alias("on_day"))
    score = F.lit(70) + F.when(F.col("on_day"), 20).otherwise(0) + F.when(F.col("own"), 10).otherwise(0)
    label = F.when(F.col("on_day") & F.col("own"), "high").otherwise("medium")
    place = F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("score"), "slug"))
    found = on_day.unionByName(other).withColumns({"score": score, "confidence": label}).withColumn("place", place).where(F.col("place") <= top)
    return found.select("match_id", "slug", "score", "confidence", F.when(F.col("on_day"), "").otherwise("date mismatch").alias("warning"))
