"""Which row of another table is nearest in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(rows: DataFrame, candidates: DataFrame, key: str, at: str, id_: str) -> DataFrame:
    """Of each row the candidate with the same key that is nearest in time; the lowest id on ties. Two windows over the union of both sides
    look back and ahead once, so a key's rows are never paired with all its candidates."""
    r = rows.select(key, F.col(at).alias("t"), F.lit(0).alias("kind"), F.col(id_).alias("rid"), F.lit(None).cast("struct<t:timestamp_ntz,id:bigint,v:double>").alias("c"))
    c = candidates.select(key, "t", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("rid"), F.struct("t", "id", "v").alias("c"))
    c = c.groupBy(key, "t", "kind", "rid").agg(F.min_by("c", "c.id").alias("c"))
    both = r.unionByName(c)
    back = Window.partitionBy(key).orderBy("t", F.col("kind").desc(), "rid").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy("t", "kind", "rid").rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumn("before", F.last("c", ignorenulls=True).over(back)).withColumn("after", F.first("c", ignorenulls=True).over(ahead)).where("kind = 0")
    gap = lambda x: F.abs(F.unix_micros(F.col(f"{x}.t").cast("timestamp")) - F.unix_micros(F.col("t").cast("timestamp")))
    later = F.col("before").isNull() | (gap("after") < gap("before")) | ((gap("after") == gap("before")) & (F.col("after.id") < F.col("before.id")))
    pick = F.when(F.col("after").isNotNull() & later, F.col("after")).otherwise(F.col("before"))
    return both.select(F.col("rid").alias(id_), key, pick["id"].alias("nearest_id"), pick["v"].alias("nearest_value"), (F.when(F.col("after").isNotNull() & later, gap("after")).otherwise(gap("before")) / 1000000).alias("gap_s"))
