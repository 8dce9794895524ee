"""Column builders: coercion, bands, probabilities and weights. All stay inside Catalyst expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: texts that count as true
TRUE_WORDS = ("1", "true", "yes", "y", "closed")
#: fixed values: Elo K factor and behavior weight by kind of competition
K_FACTORS = {"world_cup": 45.0, "world_cup_qualifier": 35.0, "continental_tournament": 35.0, "nations_league": 25.0, "friendly": 15.0, "other": 20.0}
COMPETITION_WEIGHTS = {"world_cup": 1.50, "world_cup_qualifier": 1.15, "continental_tournament": 1.25, "nations_league": 0.90, "friendly": 0.45, "other": 0.80}


def to_double(c: Column, default: float | None = None) -> Column:
    """A number, or ``default`` where the value is missing, not a number, or NaN."""
    x = c.try_cast("double")
    return F.coalesce(F.when(~F.isnan(x), x), F.lit(default).cast("double"))


def to_bool(c: Column) -> Column:
    """True for the texts in TRUE_WORDS and for the number 1 in any type; false for anything else, missing values too."""
    text = F.lower(F.trim(c.cast("string")))
    return F.coalesce(text.isin(*TRUE_WORDS) | (text.try_cast("double") == 1), F.lit(False))


def text_key(c: Column) -> Column:
    """Key of a name: no accents (Latin letters), lower case, `&` as `and`, other signs as one blank."""
    plain = F.translate(F.lower(F.coalesce(c, F.lit(""))), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "&", " and "), "[^a-z0-9']+", " "))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def ladder(c: Column, steps: Iterable[tuple[float, str]], last: str, missing: str | None = None) -> Column:
    """The label of the first step whose bound the value is below; ``last`` beyond all of them, ``missing`` for null."""
    out = F.when(c.isNull(), F.lit(missing))
    for bound, label in steps:
        out = out.when(c < bound, F.lit(label))
    return out.otherwise(F.lit(last))


def lookup(c: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for key, value in reversed(table.items()):
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def k_factor(kind: Column) -> Column:
    return lookup(kind, K_FACTORS, K_FACTORS["other"])


def competition_weight(kind: Column) -> Column:
    return lookup(kind, COMPETITION_WEIGHTS, COMPETITION_WEIGHTS["other"])


def recency_weight(day: Column, reference: Column, days: float = 365.0) -> Column:
    """exp(-days since / ``days``); later dates count as the same day, missing ones as weight 0."""
    return F.coalesce(F.exp(-F.greatest(F.datediff(reference, day), F.lit(0)) / F.lit(max(days, 1.0))), F.lit(0.0))


def outcome(home: Column, away: Column) -> Column:
    return F.when(home > away, "home_win").when(home == away, "draw").when(home < away, "away_win")


def expected_score(own: Column, other: Column, bonus: Column | float = 0.0) -> Column:
    """Elo's expected result; ``bonus`` is what playing at home adds to the own rating."""
    bonus = F.lit(bonus) if isinstance(bonus, float) else bonus
    return 1 / (1 + F.pow(F.lit(10.0), (other - own - bonus) / 400))


def expected_goals_from_elo(own: Column, other: Column, base: float = 1.35) -> Column:
    return clamp(F.lit(base) * F.exp((own - other) / 900), 0.25, 3.5)


def blowout_weight(margin: Column) -> Column:
    """Less weight for margins of more than two goals, not below 0.55."""
    m = F.abs(margin)
    return F.when(m <= 2, 1.0).otherwise(clamp(1 / (1 + F.lit(0.35) * (m - 2)), 0.55, 1.0))


def poisson_pmf(k: Column, mean: Column) -> Column:
    return F.exp(-mean) * F.pow(mean, k) / F.factorial(k.cast("int"))


def log_loss(p: Column) -> Column:
    return -F.log(clamp(p, 0.001, 0.999))


def logit(p: Column) -> Column:
    q = clamp(p, 0.001, 0.999)
    return F.log(q / (1 - q))


def brier(home: Column, draw: Column, away: Column, actual: Column) -> Column:
    """Sum of the three squared errors, not divided by three."""
    square = lambda p, name: F.pow(p - F.when(actual == name, 1.0).otherwise(0.0), 2)
    return square(home, "home_win") + square(draw, "draw") + square(away, "away_win")


def of_actual(home: Column, draw: Column, away: Column, actual: Column) -> Column:
    return F.when(actual == "home_win", home).when(actual == "draw", draw).when(actual == "away_win", away)


def top_pick(home: Column, draw: Column, away: Column) -> Column:
    """The likeliest outcome; on ties home before draw before away."""
    return F.when((home >= draw) & (home >= away), "home_win").when(draw >= away, "draw").otherwise("away_win")


def right_closed_bin(p: Column) -> Column:
    """The fifth of [0, 1] that a probability is in; upper bounds belong to their bin, and 0 to the first one."""
    q = clamp(p, 0.0, 1.0)
    return F.when(q <= 0.2, "0.00-0.20").when(q <= 0.4, "0.20-0.40").when(q <= 0.6, "0.40-0.60").when(q <= 0.8, "0.60-0.80").when(q <= 1.0, "0.80-1.00")


def favorite_band(p: Column) -> Column:
    return ladder(p, [(0.4, "0.00-0.40"), (0.6, "0.40-0.60"), (0.8, "0.60-0.80")], "0.80-1.00", "missing")


def fine_favorite_band(p: Column) -> Column:
    return ladder(p, [(0.4, "0.00-0.40"), (0.5, "0.40-0.50"), (0.6, "0.50-0.60"), (0.7, "0.60-0.70")], "0.70-1.00", "missing")


def gap_band(gap: Column) -> Column:
    return ladder(gap, [(0.05, "0.00-0.05"), (0.1, "0.05-0.10"), (0.2, "0.10-0.20")], "0.20+", "missing")


def agreement(points: Column) -> Column:
    return ladder(points, [(5.0, "agree_under_5pp"), (10.0, "disagree_5_10pp"), (20.0, "disagree_10_20pp")], "disagree_over_20pp", "missing")


def price_probability(price: Column) -> Column:
    """A price as probability: above 1 it is in cents; null outside 0 to 1."""
    p = F.when(price > 1, price / 100).otherwise(price)
    return F.when(p.between(0, 1), p)


def short_id(*parts: Column) -> Column:
    """16 hex digits that name the parts."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 16)


def join_reasons(*pairs: tuple[Column, str]) -> Column:
    """The texts whose condition holds, in order, joined by `; `."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in pairs])), "; ")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: mean of the values that are there, by positive weights; null without any."""
    use = value.isNotNull() & (weight > 0)
    return F.sum(F.when(use, value * weight)) / F.sum(F.when(use, weight))
