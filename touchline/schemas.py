"""Table schemas, and conforming a DataFrame to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: fixed values: names and types of the tables' columns
DDL = {
    "fixtures": "match_id string, date_utc date, time_utc string, competition string, `group` string, home string, away string, venue string, city string, country string",
    "team_ratings": "team string, elo double, attack double, defense double, recent_form double, fifa_rank_proxy int, training_temp_c double, training_humidity_pct double, data_quality string, last_updated string, notes string",
    "team_name_aliases": "alias string, canonical string",
    "historical_matches": "match_id string, date_utc date, competition string, competition_type string, team string, opponent string, is_home boolean, is_neutral boolean, venue string, city string, country string, team_goals int, opponent_goals int, team_xg double, opponent_xg double, shots_for double, shots_against double, shots_on_target_for double, shots_on_target_against double, possession_pct double, opponent_elo double, team_elo_pre double, temperature_c double, humidity_pct double, altitude_m double, wind_kmh double, precipitation_mm double, roof_closed boolean, source string, last_updated string",
    "venues": "venue string, city string, country string, latitude double, longitude double, altitude_m double, temp_c double, humidity_pct double, wind_kmh double, precipitation_mm double, roof_expected_closed boolean, neutral_site boolean",
    "market_odds": "match_id string, market string, selection string, odds double, source string, last_updated string",
    "results_log": "match_id string, home string, away string, home_goals int, away_goals int, result_home_win int, result_draw int, result_away_win int, over_2_5 int, under_2_5 int, btts_yes int, btts_no int, completed boolean, result_source string, last_updated string",
    "results_ledger": "match_id string, date_utc date, competition string, home string, away string, home_goals int, away_goals int, actual_result string, total_goals int, btts_actual int, over_0_5_actual int, over_1_5_actual int, over_2_5_actual int, over_3_5_actual int, actual_advancing_team string, result_semantics string, result_source string, last_updated string, evaluation_eligible_1x2 boolean, had_extra_time boolean, had_penalties boolean, penalties_home int, penalties_away int",
    "model_parameter_sets": "parameter_set_id string, base_total_goals double, elo_xg_weight double, attack_weight double, defense_weight double, draw_inflation_factor double, favorite_strength_scale double, underdog_resistance_scale double, external_prior_weight double, rating_gap_to_xg_scale double, goal_correlation_adjustment double, notes string",
}


def schema_of(table: str) -> T.StructType:
    """A table's schema; Spark parses it, so there must be a session."""
    return T.StructType.fromDDL(DDL[table])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order and types: missing ones are null, values that don't convert too, extra columns go."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def drift(df: DataFrame, schema: T.StructType) -> dict[str, list[str]]:
    """Columns that are missing from ``df``, and those that the schema doesn't know."""
    have, want = set(df.columns), {f.name for f in schema.fields}
    return {"missing": sorted(want - have), "extra": sorted(have - want)}
