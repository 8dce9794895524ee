"""What the operators of this subpackage share: reading tables, cutting lineage, words in SQL, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes 0x20 and 0x09 to 0x0D end a word
WORD = r"[^\x20\x09-\x0D]+"


#: rows of an Arrow batch, where the session keeps Spark's default of 10 000: that many long texts, several times over, are too much for a worker
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def importable(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver has it, if they are not told already, and keep their batches small."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(BATCH_ROWS))
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: that of the session, or of its context; an error if neither names one."""
    sc = spark.sparkContext
    named, own = spark.conf.get("spark.checkpoint.dir", None), sc._jsc.sc().getCheckpointDir()
    if not named and not own.isDefined():
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not own.isDefined():
        sc.setCheckpointDir(named)
    return named or own.get()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later jobs neither repeat its work nor depend on lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/touchline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


#: whether the shuffle files of a query go when it ends; if not, they stay until the driver happens to collect its garbage
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def swept(df: DataFrame, name: str) -> DataFrame:
    """stage() for large shuffles, whose files go as soon as the table is written."""
    conf = df.sparkSession.conf
    before = conf.get(SWEEP, None)
    conf.set(SWEEP, "true")
    try:
        return stage(df, name)
    finally:
        conf.unset(SWEEP) if before is None else conf.set(SWEEP, before)


def release(staged: DataFrame) -> None:
    """Remove the files of a table that stage() gave, once nothing reads it any more. What isn't released lies in the shared folder's
    ``touchline`` folder until the application's owner clears it."""
    path = staged.sparkSession._jvm.org.apache.hadoop.fs.Path(staged.stage_path)
    path.getFileSystem(staged.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() for small tables; Spark removes the files when the table is no longer used."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores after it as keep it apart from the names in ``taken`` (in any case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def spaced(text: Column) -> Column:
    """The text with a blank for each other kind of white space; an empty one for a null."""
    return F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")


def words(text: Column) -> Column:
    """Array of the maximal runs without white space; empty for a null or empty text."""
    return F.filter(F.split(spaced(text), " ", -1), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def small_or_shuffled(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast ``df`` if its counted ``rows`` are at most ``most``; else leave the join to a shuffle."""
    return F.broadcast(df) if rows <= most else df.hint("shuffle_merge")


#: rows of 64 bits in the bitmap of perhaps()
BITMAP_ROWS = 1 << 18


def perhaps(df: DataFrame, among: DataFrame, key: str, keep: str = "") -> DataFrame:
    """Rows of ``df`` whose ``key`` (a 64-bit hash) may be among those of ``among``: all that are, and few others as long as there are few
    keys for the 2 ** 24 bits of a bitmap. It has BITMAP_ROWS rows at most, so it is broadcast at every size. A join that follows
    then shuffles little; once the bitmap is full it shuffles all. ``keep``: a column that tells, all rows stay."""
    word, bit = F.pmod(F.col(key), F.lit(BITMAP_ROWS)), F.lit(1).cast("long") * F.pow(F.lit(2), F.pmod(F.shiftright(key, 24), F.lit(62))).cast("long")
    bits = among.groupBy(word.alias("bitmap_word")).agg(F.bit_or(bit).alias("bitmap_bits"))
    joined = df.withColumn("bitmap_word", word).join(F.broadcast(bits), "bitmap_word", "left" if keep else "inner")
    hit = F.coalesce(F.col("bitmap_bits").bitwiseAND(bit) != 0, F.lit(False))
    out = joined.withColumn(keep, hit) if keep else joined.where(hit)
    return out.drop("bitmap_word", "bitmap_bits")


#: edges that a task contracts at once, and edges of a partition between two rounds, about
FOREST_EDGES, ROUND_EDGES = 200_000, 20_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars with the same components as the edges (a, b): each node but the smallest of its component, and that one."""
    values, dense = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = dense[: len(a)], dense[len(a) :]
    label = np.arange(len(values))
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != (further := new[new])).any():
            new = further
        if (new == label).all():
            break
        label = new
    leaf = label != np.arange(len(values))
    return values[leaf], values[label[leaf]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task as stars, FOREST_EDGES at a time."""
    held, n = [], 0
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += len(batch)
        if n and (batch is None or n >= FOREST_EDGES):
            u, v = forest(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.record_batch({"u": u, "v": v})
            held, n = [], 0


def _stars(now: DataFrame) -> bool:
    """Whether each node u has one edge, to a node v that is no other edge's u."""
    ends = now.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("hub")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("hub")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("hub").alias("hub")).where("out + hub > 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), after each task has contracted its own edges.

    ``edges``: two long columns without nulls, in any order, repeats and loops allowed. Returns ``node, component`` for every node
    with an edge to another node; the component is its smallest node. Each step aggregates before it joins, so a node with
    very many neighbours is never gathered in one group. The steps end once all edges are stars. Partitions between two rounds
    are in proportion to the edges.
    """
    now = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").mapInArrow(_forests, "u long, v long").distinct())
    for _ in range(rounds):
        if _stars(now):
            break
        parts = max(8, now.count() // ROUND_EDGES)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        now = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = now.groupBy("u").agg(F.min("v").alias("m"))
        now = now.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = cut(now.coalesce(parts))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.unionByName(named.select(F.col("component").alias("node"), "component").distinct())
