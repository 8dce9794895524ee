"""Documents to token ids: toxic ones go, one of each group of near copies stays, personal data is replaced, sources are mixed to
target weights, and texts are encoded. Each stage takes (spark, docs, sf_dir); what it returns is written and read again.

From the mix on, a column (mixing.slot_name: mix_slot, unless documents have one) tells the place of each row in the mix. All other columns
of documents pass every stage as they are, whatever they are called; null ids, repeated rows and null or empty texts too, as each
operator's docstring says; empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import bpe, mixing, ngram_join, pii, toxicity
from touchline.llm.base import stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with a toxicity below 0.5; a null or empty text stays. Columns called score or passages are left alone."""
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest doc_id, of each group of texts that are alike; texts without words all stay."""
    return ngram_join.without_copies(docs, 5, 80)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data and what discloses it taken out of the texts; a null text stays null."""
    return pii.sanitised(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, some twice, and the slot of each; texts without words go."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row of the mix: doc_id, its slot, the number of tokens, and the digests of ids and decoded text; no tokens for a null text."""
    *own, last = docs.columns
    slot = (last,) if last == mixing.slot_name(own) else ()
    return bpe.digest(bpe.round_trip(docs, keep=slot), slot)


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_copies), ("pii", sanitise), ("mixing", mix_sources), ("bpe", encode)]
#: no SQL engine has the classifier and the tokenizer; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
