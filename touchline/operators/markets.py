"""Market quotes in cents: edges, signal policy, groups, scores, and finding the market of a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.names import name_key
from ..sources.session import cut


def edges(quotes: DataFrame) -> DataFrame:
    """quotes: model_prob, side (YES or NO), price (cents or probability). Adds fair price, gap (cents) and expected value."""
    p = F.when(F.upper("side") == "NO", 1 - F.col("model_prob")).otherwise(F.col("model_prob"))
    price = C.price_probability(F.col("price"))
    return quotes.withColumns({"fair_cents": p * 100, "price_cents": price * 100, "gap_cents": (p - price) * 100, "alpha_ev": F.when(price > 0, p / price - 1)})


def signals(rows: DataFrame, least_liquidity: float = 100.0) -> DataFrame:
    """rows: gap_cents, mapping, liquidity, warning, model_confidence, calibrated, supported, behavior_delta. Adds signal and reasons."""
    gap = F.col("gap_cents")
    unresolved = F.coalesce(F.lower("warning"), F.lit("")).rlike("mapping uncertain|manual confirmation required|market closed|price missing")
    illiquid = ~F.coalesce(F.col("liquidity") >= least_liquidity, F.lit(False))
    reasons = C.join_reasons(
        (unresolved, "unresolved mapping or price status"),
        (illiquid, "insufficient liquidity"),
        (~F.coalesce(F.lower("mapping").isin("high", "manual"), F.lit(False)), "mapping confidence below high/manual"),
        (F.lower("model_confidence") == "low", "low model confidence"),
        (~F.col("calibrated"), "calibrated probability unavailable"),
        (~F.col("supported"), "insufficient historical support"),
        (F.abs("behavior_delta") >= 0.10, "large behavior disagreement"),
        ((gap >= 20) & ~F.col("supported"), "extreme model-market gap without validation"),
    )
    why = F.when(gap.isNull(), "missing alpha gap").when(gap <= 0, "non-positive model gap").when(gap < 3, "gap below watchlist threshold").otherwise(reasons)
    signal = F.when(gap.isNull() | (gap < 3) | unresolved | illiquid, "No trade").when(reasons != "", "Watchlist").when(gap >= 8, "Strong edge").when(gap >= 5, "Small edge").otherwise("Watchlist")
    return rows.withColumns({"reasons": why, "signal": signal})


def group_of(market: Column, selection: Column) -> Column:
    s = F.lower(selection)
    result = market.isin("1X2", "Double Chance", "Handicap")
    return (
        F.when(((market == "Total") & s.contains("over")) | ((market == "BTTS") & (s == "yes")), "High Scoring")
        .when(((market == "Total") & s.contains("under")) | ((market == "BTTS") & (s == "no")), "Low Scoring")
        .when(result & s.contains("draw") & ~s.contains("/"), "Other Markets")
        .when(result & (s.contains("away") | s.contains("draw/")), "Result Away")
        .when(result & (s.contains("home") | s.contains("/draw")), "Result Home")
        .otherwise("Other Markets")
    )


def ev_score(ev: Column) -> Column:
    return F.when(ev > 0, F.least(F.lit(100.0), ev * 400).cast("int")).otherwise(0)


def gap_score(gap: Column, mapping: Column, liquidity: Column) -> Column:
    sure = F.when(F.lower(mapping).isin("high", "manual"), 1.0).when(F.lower(mapping) == "low", 0.65).otherwise(0.75)
    liquid = F.when(liquidity.isNull(), 0.65).otherwise(C.clamp(liquidity / 500, 0.35, 1.0))
    return F.when(gap > 0, F.least(F.lit(100.0), gap * 10 * sure * liquid).cast("int")).otherwise(0)


def robust(by_scenario: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """by_scenario: keys, scenario, fair_cents, price_cents. An edge is robust if it is there in ``least`` scenarios or more."""
    out = by_scenario.groupBy(*keys).agg(F.count_if(F.col("fair_cents") > F.col("price_cents")).alias("supporting"))
    return out.withColumn("robustness", F.when(F.col("supporting") >= least, "robust").otherwise("unstable"))


def outcomes_of(events: DataFrame, props: str = "props", schema: str = "map<string,string>") -> DataFrame:
    """A row for each entry of an event's JSON; broken JSON has none."""
    return events.select("event_id", F.explode(F.from_json(props, schema)).alias("key", "value"))


def slug_candidates(pairs: DataFrame, prefix: str = "fif") -> DataFrame:
    """Slugs under which the market of a pairing may be listed: both orders, the day and the days around it, in order of preference."""
    days = F.transform(F.array(F.lit(0), F.lit(-1), F.lit(1)), lambda d: F.date_format(F.date_add("day", d), "yyyy-MM-dd"))
    both = lambda d: F.array(F.concat_ws("-", F.lit(prefix), "home_code", "away_code", d), F.concat_ws("-", F.lit(prefix), "away_code", "home_code", d))
    return pairs.select("pair_id", F.posexplode(F.array_distinct(F.flatten(F.transform(days, both)))).alias("pos", "slug"))


def first_listed(candidates: DataFrame, listed: DataFrame) -> DataFrame:
    """The first candidate of each pairing that is listed."""
    return candidates.join(listed.select("slug").distinct(), "slug").groupBy("pair_id").agg(F.min_by("slug", "pos").alias("slug"))


def score_terms(texts: DataFrame, terms: DataFrame, id_: str) -> DataFrame:
    """Sum of the weights of the terms that each text has, by an equi-join on tokens; terms: token, weight (a small table)."""
    tokens = texts.select(id_, F.explode(F.array_distinct(F.split(C.text_key(F.col("text")), " "))).alias("token"))
    scored = tokens.join(F.broadcast(terms), "token").groupBy(id_).agg(F.sum("weight").alias("score"), F.count("*").alias("n_terms"))
    return scored.withColumn("confidence", F.when(F.col("score") >= 80, "high").when(F.col("score") >= 50, "medium").otherwise("low"))


def visible_text(html: Column) -> Column:
    """Text of a page: no scripts, styles, comments or tags; white space squeezed."""
    bare = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), "[ \\t\\r\\n]+", " "))


def best_quote(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """Of each selection the quote with a price and the largest gap."""
    order = Window.partitionBy(*keys).orderBy(F.col("price_cents").isNull(), F.abs("gap_cents").desc_nulls_last(), "market_id")
    return quotes.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


#: fixed values: words that tell what a market is about
MATCHUP_WORDS = ("vs", "v", "versus", "beat", "defeat", "draw", "tie")
SPORTS_WORDS = ("fifa", "football", "game", "match", "soccer", "world cup")
POLITICAL_WORDS = ("approval", "bitcoin", "congress", "crypto", "election", "fed", "government", "inflation", "interest rate", "mayor", "minister", "poll", "president", "senate", "tariff", "vote", "war")
#: fixed values: points of both teams, matchup words, sports words, sports category, competition, a date within two days; and of what speaks against it
POINTS = {"teams": 60.0, "matchup": 12.0, "sports": 14.0, "category": 10.0, "competition": 8.0, "date": 6.0, "political": -80.0, "no_context": -20.0}


def mentions(markets: DataFrame, terms: DataFrame) -> DataFrame:
    """market_id, team of every term (team, term; one word or several) that is in a market's text as whole words. Texts meet terms by the term's first word, so
    no text is searched for all terms."""
    return _mentions(markets.select("market_id", name_key(F.col("text")).alias("text")), terms)


def _mentions(keyed: DataFrame, terms: DataFrame) -> DataFrame:
    """mentions() of texts that are keys already."""
    tokens = keyed.select("market_id", "text").withColumn("word", F.explode(F.array_distinct(F.split("text", " "))))
    known = terms.select("team", name_key(F.col("term")).alias("term")).where("term <> ''").distinct().withColumn("word", F.substring_index("term", " ", 1))
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    return tokens.join(known, "word").where(F.contains(padded("text"), padded("term"))).select("market_id", "team").distinct()


def map_markets(markets: DataFrame, fixtures: DataFrame, terms: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` markets of each fixture that name both teams and aren't rejected: match_id, market_id, score, confidence. A market without both teams is rejected
    whatever else it says, so markets and fixtures meet by the pairs of teams that a text names. Ties go to the lowest market_id.

    What a fixture adds to a market's own points is whether the text names its competition and whether the days are near. So of each pair of teams the
    ``top`` markets are kept four times: of all, of each competition named, of each day, and of both; a fixture meets only these, and no fixture meets all
    markets of its pair.

    markets: market_id, text, category, day; fixtures: match_id, home, away, competition, day; terms: team, term.
    """
    # keys cost more than all else, so each is made once
    keyed = cut(markets.select("market_id", name_key(F.col("text")).alias("text"), name_key(F.col("category")).alias("category"), "day"))
    said = cut(_mentions(keyed, terms))
    pairs = said.withColumnRenamed("team", "low").join(said.withColumnRenamed("team", "high"), "market_id").where("low < high")
    met = fixtures.where("home <> away").select("match_id", F.least("home", "away").alias("low"), F.greatest("home", "away").alias("high"), name_key(F.col("competition")).alias("competition"), F.col("day").alias("kickoff"))
    met = cut(met)
    has = lambda words: F.concat(F.lit(" "), F.col("text"), F.lit(" ")).rlike(" (" + "|".join(words) + ") ")
    about = keyed.select("market_id", "day", has(MATCHUP_WORDS).alias("matchup"), has(SPORTS_WORDS).alias("sports"), has(POLITICAL_WORDS).alias("political"), F.col("category").isin("sports", "soccer", "football").alias("sporting"), F.contains("category", F.lit("politic")).alias("politics"))
    point = lambda c, n: F.when(c, POINTS[n]).otherwise(0.0)
    against = (F.col("political") | F.col("politics")) & ~F.col("sports")
    rejected = against | ~(F.col("sports") | F.col("matchup") | F.col("sporting"))
    own = F.lit(POINTS["teams"]) + point(F.col("matchup"), "matchup") + point(F.col("sports"), "sports") + point(F.col("sporting"), "category")
    rows = pairs.join(about.where(~rejected), "market_id").select("market_id", "low", "high", "day", own.alias("score"), (F.col("sports") | F.col("sporting")).alias("sure"))
    rows = cut(rows)
    kinds = met.select(F.col("competition").alias("team")).where("team <> ''").distinct()
    named = _mentions(keyed, kinds.withColumn("term", F.col("team"))).withColumnRenamed("team", "competition")
    named = cut(rows.join(named, "market_id"))

    def best(df: DataFrame, points: float, *by: str) -> DataFrame:
        def first(df: DataFrame, *keys: str) -> DataFrame:
            place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "market_id"))
            return df.withColumn("place", place).where(F.col("place") <= top).drop("place")

        keys = ["low", "high", *by]
        if "kickoff" in by:  # the first of each day, before it goes to the days around it
            df = first(df.where("day is not null"), *[c for c in keys if c != "kickoff"], "day")
            df = df.withColumn("kickoff", F.explode(F.array(*[F.date_add("day", d) for d in range(-2, 3)])))
        kept = first(df, *keys).select(*keys, "market_id", (F.col("score") + points).alias("score"), "sure")
        return met.join(kept, keys).select("match_id", "market_id", "score", "sure")

    near, told = POINTS["date"], POINTS["competition"]
    found = best(rows, 0.0).unionByName(best(rows, near, "kickoff")).unionByName(best(named, told, "competition")).unionByName(best(named, told + near, "competition", "kickoff"))
    # a market may come by several ways; the one with most points is true of it
    found = found.groupBy("match_id", "market_id").agg(F.max("score").alias("score"), F.first("sure").alias("sure"))
    label = F.when(F.col("sure") & (F.col("score") >= 75), "high").when(F.col("score") >= 55, "medium").otherwise("low")
    place = F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("score"), "market_id"))
    return found.withColumn("place", place).where(F.col("place") <= top).select("match_id", "market_id", "score", label.alias("confidence"))
