"""Scores, calibration and walk-forward validation of 1X2 probabilities.

All functions take scored rows: home_win, draw, away_win (probabilities), actual (outcome) and what they group by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

P = ("home_win", "draw", "away_win")


def scored(df: DataFrame, actual: str = "actual") -> DataFrame:
    """Adds brier, p_actual, log_loss, top_pick and hit."""
    h, d, a, y = (F.col(c) for c in (*P, actual))
    out = df.withColumns({"brier": C.brier(h, d, a, y), "p_actual": C.of_actual(h, d, a, y), "top_pick": C.top_pick(h, d, a)})
    return out.withColumns({"log_loss": C.log_loss(F.col("p_actual")), "hit": (F.col("top_pick") == y).cast("double")})



def _metrics() -> list[Column]:
    return [F.count("*").alias("n"), F.avg("hit").alias("top_pick_accuracy"), F.avg("brier").alias("brier_score"), F.avg("log_loss").alias("multiclass_log_loss")]


def metrics(rows: DataFrame, *by: str) -> DataFrame:
    """n, accuracy, Brier score and log loss by ``by`` (null is a group too)."""
    return rows.groupBy(*by).agg(*_metrics())


def backtest_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """metrics(), and Brier scores of over 2.5 and both to score, and errors of expected goals."""
    indicator = lambda e: F.when(F.expr(e), 1.0).otherwise(0.0)
    return rows.groupBy(*by).agg(
        *_metrics(),
        F.avg(F.least(F.greatest("p_actual", F.lit(0.001)), F.lit(0.999))).alias("mean_probability_of_actual"),
        F.avg(F.pow(F.col("over_2_5") - indicator("hg + ag > 2.5"), 2)).alias("over_2_5_brier"),
        F.avg(F.pow(F.col("btts_yes") - indicator("hg > 0 and ag > 0"), 2)).alias("btts_brier"),
        F.avg(F.abs(F.col("home_xg") - F.col("hg"))).alias("home_xg_mae"),
        F.avg(F.abs(F.col("away_xg") - F.col("ag"))).alias("away_xg_mae"),
        F.avg(F.abs(F.col("home_xg") + F.col("away_xg") - F.col("hg") - F.col("ag"))).alias("total_goals_mae"),
    )


def one_vs_rest(rows: DataFrame, *keep: str) -> DataFrame:
    """Three rows a match: outcome, p and whether it came."""
    return rows.select(*keep, F.inline(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).alias("p"), F.when(F.col("actual") == o, 1.0).otherwise(0.0).alias("y")) for o in P]))).where("p is not null")


BINS = ["0.00-0.20", "0.20-0.40", "0.40-0.60", "0.60-0.80", "0.80-1.00"]


def calibration_bins(rows: DataFrame, *by: str, empties: bool = False) -> DataFrame:
    """By ``by`` and fifth of the probability: n, mean probability, how often it came, and the error. ``empties`` (without ``by``) adds
    the fifths that nothing is in, with n = 0."""
    binned = one_vs_rest(rows, *[b for b in by if b != "outcome"]).withColumn("bin", C.right_closed_bin(F.col("p")))
    out = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("avg_p"), F.avg("y").alias("observed"))
    if empties:
        out = rows.sparkSession.createDataFrame([(b,) for b in BINS], "bin string").join(out, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("calibration_error", F.abs(F.col("avg_p") - F.col("observed")))


def expected_calibration_error(rows: DataFrame, *by: str, per_outcome: bool = False) -> DataFrame:
    """Mean calibration error by n: over fifths of all outcomes pooled, or over the fifths of each outcome."""
    bins = calibration_bins(rows, *by, *(["outcome"] if per_outcome else []))
    return bins.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("calibration_error")) / F.sum("n")).alias("ece"))


def calibration_line(rows: DataFrame, *by: str) -> DataFrame:
    """Least-squares line of hits on the logit of the actual outcome's probability; null below 3 rows or without spread."""
    out = rows.withColumn("x", C.logit(F.col("p_actual"))).groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("hit", "x").alias("s"), F.regr_intercept("hit", "x").alias("i"), F.stddev_pop("x").alias("spread"))
    usable = (F.col("n") >= 3) & (F.col("spread") > 1e-9)
    return out.select(*by, "n", F.when(usable, F.col("s")).alias("slope"), F.when(usable, F.col("i")).alias("intercept"))


def by_contexts(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """metrics() by each dimension on its own, as one table: dimension, segment. One pass: rows are expanded, then grouped once."""
    each = F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("segment")) for d in dimensions]))
    return metrics(rows.select("hit", "brier", "log_loss", each), "dimension", "segment")


def model_vs_market(rows: DataFrame) -> DataFrame:
    """Overall and by agreement of the favourites' probabilities: scores of model and market over rows that have both."""
    m = [F.col(c) for c in ("market_home", "market_draw", "market_away")]
    both = rows.where("market_home is not null").withColumns({"market_brier": C.brier(*m, F.col("actual")), "market_log_loss": C.log_loss(C.of_actual(*m, F.col("actual")))})
    gap = F.greatest(*[F.abs(F.col(p) - q) for p, q in zip(P, m, strict=True)]) * 100
    both = both.withColumn("segment", C.agreement(gap))
    return both.select("brier", "market_brier", "log_loss", "market_log_loss", F.explode(F.array(F.lit("all"), "segment")).alias("segment")).groupBy("segment").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("brier", "market_brier", "log_loss", "market_log_loss")]
    )


def worst(rows: DataFrame, n: int = 20) -> DataFrame:
    return rows.orderBy(F.col("log_loss").desc(), F.col("brier").desc(), "match_id").limit(n)


def compare_modes(rows: DataFrame, base: str, other: str) -> DataFrame:
    """Both modes' probability of the actual outcome, match by match, from one grouping instead of a self-join."""
    of = lambda m: F.max(F.when(F.col("mode") == m, F.col("p_actual")))
    both = rows.groupBy("match_id").agg(of(base).alias("base_p"), of(other).alias("other_p")).where("base_p is not null and other_p is not null")
    delta = F.col("other_p") - F.col("base_p")
    note = F.when(delta > 0.0005, "improved").when(delta < -0.0005, "lowered").otherwise("no material difference")
    return both.withColumns({"delta": delta, "improved": delta > 0, "note": note})


def promotion(by_set: DataFrame, base: str, least: int = 30) -> DataFrame:
    """Which sets beat the base set: both scores better, over 2.5 not over 5 % worse, and enough rows. The base row is joined as one row."""
    b = by_set.where(F.col("parameter_set") == base).select(*[F.col(c).alias(f"base_{c}") for c in ("brier_score", "multiclass_log_loss", "over_2_5_brier")])
    j = by_set.join(F.broadcast(b), how="cross")
    better = (F.col("brier_score") < F.col("base_brier_score")) & (F.col("multiclass_log_loss") < F.col("base_multiclass_log_loss")) & (F.col("over_2_5_brier") <= F.col("base_over_2_5_brier") * 1.05)
    return j.withColumn("status", F.when(F.col("parameter_set") == base, "baseline").when(F.col("n") < least, "sample_too_small").when(better, "promoted").otherwise("not_promoted"))
