"""The prediction ledger as a stream: snapshots are deduplicated, late ones flagged, and results joined after a delay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flagged(events: DataFrame) -> DataFrame:
    """Snapshots with prediction_before_kickoff, which marks those in time; the others stay."""
    return events.withColumn("prediction_before_kickoff", F.col("snapshot_utc") < F.col("kickoff_utc"))


def with_results(ledger: DataFrame, results: DataFrame, delay: str = "4 hours", most: str = "3 days", how: str = "inner") -> DataFrame:
    """Snapshots joined to results that come at least ``delay`` after kickoff and within ``most`` of it; both sides' state is bounded by
    watermarks. ``how``: inner, or left_outer, which gives out a snapshot without a result once the watermark says that none can come."""
    left = ledger.withWatermark("kickoff_utc", delay).alias("p") if ledger.isStreaming else ledger.alias("p")
    right = results.withWatermark("result_utc", delay).alias("r") if results.isStreaming else results.alias("r")
    on = (F.col("p.match_id") == F.col("r.match_id")) & (F.col("r.result_utc") >= F.col("p.kickoff_utc") + F.expr(f"interval {delay}")) & (F.col("r.result_utc") <= F.col("p.kickoff_utc") + F.expr(f"interval {most}"))
    return left.join(right, on, how).select("p.*", "r.result_utc", "r.hg", "r.ag")


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a restart goes on from the checkpoint."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
