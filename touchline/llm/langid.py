"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, trained with FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut
from .toxicity import fold

#: documents that training uses at most, those with the lowest hash of doc_id, and the part of these that sets the temperature
SAMPLE, TEMPERATURE_PART = 6_000, 5
#: n-grams are hashed to so many features
FEATURES = 1 << 16
ORDERS = (1, 2, 3)
#: FTRL-proximal: step sizes, and the elastic net's l1 and l2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.1
SHARDS, ROUNDS = 4, 3


class Model(NamedTuple):
    langs: tuple[str, ...]
    #: idf times weight of each feature and language, and the bias
    table: np.ndarray
    bias: np.ndarray
    temperature: float


def features(text: str) -> np.ndarray:
    """Feature of every character n-gram of a text in lower case, white space as one blank; repeats stay."""
    chars = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for n in ORDERS:
        if len(chars) >= n:
            h = np.full(len(chars) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h = (h ^ chars[k : len(chars) - n + 1 + k]) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
            out.append(h & np.uint32(FEATURES - 1))
    return np.concatenate(out)


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task: how many of its documents have each feature; documents as feature -1."""
    count, n, seen = np.zeros(FEATURES, np.int64), 0, np.zeros(FEATURES, bool)
    for batch in batches:
        for x in batch.column("text"):
            f = features(x.as_py() or "")
            seen[f] = True
            count += seen
            seen[f] = False
            n += 1
    if n:
        used = np.flatnonzero(count)
        yield pa.record_batch({"feature": pa.array(np.concatenate([[-1], used])), "n": pa.array(np.concatenate([[n], count[used]]))})


def _vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF of a text: its features and their values; tf is the share of the text's n-grams."""
    f, n = np.unique(features(text), return_counts=True)
    return f, n / n.sum() * idf[f]


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL-proximal in closed form: 0 where |z| is within L1, so the weights are sparse."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _train(shared):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        idf, langs, z, n = shared.value
        z, n = z.copy(), n.copy()
        rows = sorted(zip(group.column("h").to_pylist(), group.column("lang").to_pylist(), group.column("text").to_pylist(), strict=True))
        for _, lang, text in rows:
            f, v = _vector(text, idf)
            f, v = np.append(f, FEATURES), np.append(v * SCALE, 1.0)
            w = _weights(z[f], n[f])
            g = _softmax(v @ w)
            g[langs.index(lang)] -= 1
            g = v[:, None] * g
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA
            z[f] += g - sigma * w
            n[f] += g * g
        used = np.flatnonzero(n.any(1))
        return pa.table({"shard": pa.array([key[0].as_py()] * len(used), pa.int32()), "feature": used, "z": pa.array(list(z[used])), "n": pa.array(list(n[used]))})

    return run


#: makes TF-IDF values, which are shares, about as large as the bias
SCALE = 20.0


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from text and non-null lang of documents whose crc32 fold of 4 is not 2.

    Document frequencies, for idf, are over all of these. The classifier is fitted on ``sample`` of them at most, with the lowest hash of
    doc_id, dealt to SHARDS tasks; each runs FTRL over its shard from the same state, and the states are averaged (ROUNDS times).
    A fifth of the sample is kept from this and sets the temperature. At most FEATURES rows a shard come to the driver.
    Without any usable document the model has no language, and all predictions are `und`.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null and doc_id is not null").where(fold(F.col("doc_id"), 4) != 2)
    counted = rows.select("text").mapInArrow(_document_frequency, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    df = dict(zip(counted.column("feature").to_pylist(), counted.column("n").to_pylist(), strict=True))
    total = df.pop(-1, 0)
    if not total:
        return Model((), np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    idf = np.full(FEATURES, np.log(1.0 + total))
    idf[list(df)] = np.log((1.0 + total) / (1.0 + np.array(list(df.values()))))
    idf += 0.1  # n-grams that all documents have still say something by how often
    h = F.xxhash64("doc_id")
    chosen = rows.select("doc_id", "lang", h.alias("h")).orderBy("h", "doc_id").limit(sample)
    chosen = chosen.select("doc_id", "lang", "h").distinct()
    train = cut(rows.join(F.broadcast(chosen), ["doc_id", "lang"]).withColumn("shard", F.pmod(F.shiftright("h", 8), F.lit(SHARDS + 1)).cast("int")))
    langs = tuple(r[0] for r in train.select("lang").distinct().orderBy("lang").collect())
    z = n = np.zeros((FEATURES + 1, len(langs)))
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((idf, langs, z, n))
        out = train.where(F.col("shard") < SHARDS).groupBy("shard").applyInArrow(_train(shared), "shard int, feature long, z array<double>, n array<double>").toArrow()
        shards = len(set(out.column("shard").to_pylist()))
        zs, ns = np.repeat(z[None], max(shards, 1), 0), np.repeat(n[None], max(shards, 1), 0)
        for s, own in enumerate(sorted(set(out.column("shard").to_pylist()))):
            part = out.filter(pa.compute.equal(out.column("shard"), own))
            at = part.column("feature").to_numpy()
            zs[s][at], ns[s][at] = (np.array(part.column(c).to_pylist()).reshape(-1, len(langs)) for c in ("z", "n"))
        z, n = zs.mean(0), ns.mean(0)
    w = _weights(z, n)
    model = Model(langs, (w[:-1] * idf[:, None] * SCALE).astype(np.float32), w[-1], 1.0)
    kept = _logits(train.where(F.col("shard") == SHARDS).select("doc_id", "text", "lang"), model, "lang string").select("lang", "logits").toArrow()
    return model._replace(temperature=_temperature(np.array(kept.column("logits").to_pylist()).reshape(-1, len(langs)), [langs.index(x) for x in kept.column("lang").to_pylist()]))


def _temperature(logits: np.ndarray, y: list[int]) -> float:
    """The temperature with the lowest log loss, on a grid from 1/8 to 8; the middle one without documents."""
    if not len(y):
        return 1.0
    grid = 2.0 ** np.linspace(-3, 3, 49)
    losses = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean().round(9) for t in grid]
    return float(grid[int(np.argmin(losses))])


def _logits(docs: DataFrame, model: Model, more: str = "") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            rows, letters = [], []
            for x in batch.column("text"):
                text = x.as_py() or ""
                letters.append(any(map(str.isalpha, text)))
                f = features(text)
                rows.append((model.bias + model.table[f].sum(0, dtype=np.float64) / len(f)).tolist())
            out = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            yield pa.record_batch(out | {"letters": pa.array(letters, pa.bool_()), "logits": pa.array(rows, pa.list_(pa.float64()))})

    return docs.mapInArrow(run, f"doc_id long, {more + ', ' if more else ''}letters boolean, logits array<double>")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred (a learned language; `und` if the text is null or has no letter) and score (the calibrated probability of that
    language; 0 for `und`). Ties go to the first language by name. A row in, a row out; only the text is looked at."""
    rows = _logits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    if not model.langs:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    top = F.array_max("logits")
    place = F.array_position("logits", top)
    score = 1 / F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp((x - top) / F.lit(model.temperature)))
    name = F.element_at(F.array(*map(F.lit, model.langs)), place.cast("int"))
    return rows.select("doc_id", F.when(F.col("letters"), name).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), score).otherwise(0.0).alias("score"))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score, as learn() and predict() say."""
    return predict(docs, learn(docs, sample)).select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
