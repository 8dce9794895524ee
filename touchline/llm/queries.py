"""The queries of this subpackage, each over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, langid, licenses, mixing, ngram_join, pii, prefix_trie, quality, sharding, toxicity, transport, vector_dedup
from .base import table
from .sql import ORACLES  # noqa: F401


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.sanitise(table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.round_trip(table(spark, sf_dir, "documents")))


def as_files(docs: DataFrame) -> DataFrame:
    """documents as files of a tree: a directory for each source, one for each language in it, and four in each of these. Every 16th document
    lies directly in a language's directory, as one of its licence files; so does every 32nd (from the 8th on) in the innermost ones."""
    number = lambda k: F.pmod("doc_id", F.lit(k))
    folder = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")))
    inner = F.concat(F.lit("d"), F.pmod(F.expr("doc_id div 32"), F.lit(4)).cast("string"))
    plain = F.concat_ws("/", folder, inner, F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    path = F.when(number(16) == 0, F.concat_ws("/", folder, F.concat(F.lit("LICENSE."), "doc_id"))).when(number(32) == 8, F.concat_ws("/", folder, inner, F.concat(F.lit("COPYING."), "doc_id"))).otherwise(plain)
    return docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(as_files(table(spark, sf_dir, "documents"))).withColumnRenamed("file_id", "doc_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = transport.read_media(transport.to_media(table(spark, sf_dir, "documents")))
    point = F.transform(F.arrays_zip("access_units", "access_pts"), lambda x: F.concat_ws("@", x["access_units"], x["access_pts"]))
    return read.withColumn("access_sha256", F.sha2(F.array_join(point, ",").cast("binary"), 256))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents"), 3, 90)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.tree(table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.report(divergence.audit(table(spark, sf_dir, "documents"), 3), 200)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_pii, op2_toxicity, op3_bpe, op4_licenses, op5_quality, op6_sharding, op7_transport, op8_mixing, op9_ngram_join, op10_langid, op11_prefix_trie, op12_vector_dedup, op13_divergence, pipeline)}
