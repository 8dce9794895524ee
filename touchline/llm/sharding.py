"""Contiguous shards of near equal size: global prefix sums of bytes, built from the totals of range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import stage

#: rows of a range partition, about; a partition's rows (some 40 bytes each) are sorted by one task
PARTITION_ROWS = 1_000_000


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """Cut the documents, in the order of doc_id, into ``shards`` runs of near equal bytes.

    Returns one row for each row of ``docs``: doc_id, size (UTF-8 bytes of the text, none if null, plus ``overhead``), text_crc32
    (unsigned; of no bytes if null), shard (0 to shards - 1) and slot (place in the shard, gapless from 0). A document goes to the
    shard that its middle byte falls in, so each shard is off its target by at most one document. Rows of one doc_id are ordered
    by text_crc32 and size; equal rows are interchangeable. Empty texts count ``overhead``; an empty table gives no rows.

    Only (doc_id, size, text_crc32) move. Range partitions are cut by doc_id, then by text_crc32 and by a number within equal
    rows, so a doc_id that very many rows have is spread too. The table of partition totals, one row for each partition, is
    the only one that a single task sums up, and the only one broadcast, with that of the shards' first places.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = stage(rows.withColumn("spread", F.pmod(F.monotonically_increasing_id(), F.lit(1024))), "shard-sizes")
    count, total = rows.agg(F.count("*"), F.sum("size")).first()
    if not count:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // PARTITION_ROWS))
    order = ["doc_id", "text_crc32", "size", "spread"]
    ranged = stage(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "shard-ranges")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"))
    own = Window.partitionBy("part").orderBy(*order)
    placed = ranged.join(F.broadcast(totals), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("rows_before") + F.row_number().over(own) - 1).alias("place"),
        (F.col("bytes_before") + F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
    )
    placed = placed.withColumn("shard", F.expr(f"cast((2 * start + size) * {shards} div (2 * {total}L) as int)"))
    placed = stage(placed.select("doc_id", "size", "text_crc32", "shard", "place"), "shard-places")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
