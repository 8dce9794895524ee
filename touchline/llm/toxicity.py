"""Toxicity by maximum-scoring segments: log-odds of tokens, all significant passages, extreme-value calibration.

Learning. Of near copies with one label about one counts (rows of equal smallest hash of a window of words): the words of a copied text
are no independent evidence. Tokens are words and how words begin (prefixes of a few lengths, for inflected and compound forms). From labelled
documents, each one's log-odds between toxic and other documents, counted once a document, are taken with an informative Dirichlet
prior (its frequency in both), together with their variance. Every token scores its log-odds, shrunk towards 0 by so many standard
errors, so rare ones say little; a word scores the best of its tokens, or the worst if none is above 0, less a drift.
Scanning. The linear-time algorithm of Ruzzo and Tompa finds all maximal-scoring segments of a document's token scores.
Calibration. By extreme-value theory (Karlin and Altschul) the number of segments that score S or more by chance in a document of N
tokens is Poisson with mean K N exp(-lambda (S - S0)); K, lambda and the lowest score S0 are estimated on the other documents. How unlikely the best r segments are,
for the r that is the most so, is then turned into a probability by a logistic fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textblocks as tb
from .base import cut, free_name

#: labelled rows that learning uses at most; those with the lowest hash of doc_id
LABELLED = 40_000
#: tokens are counted by hash in so many buckets; so many that words of other documents seldom fall into those that score
BUCKETS = 1 << 32
#: of the lowest bits of a bucket there is a map, to pass over most that don't score
MAP = 1 << 20
#: weight of the prior, in counts; standard errors that log-odds are shrunk by, and what each word's score is lowered by. Chosen by
#: cross-validation among rows whose fold of 5 isn't 0 (tests/llm/choose_toxicity.py)
PRIOR, BOUND, DRIFT = 500.0, 1.64, -0.5
#: what each token has of the prior besides its share by frequency
FLAT = 0.5
#: bytes of the prefixes that count as tokens besides whole words
PREFIXES = (4, 5, 6, 7)
#: words of a window, for the hash that near copies mostly share
SHINGLE = 5
#: a segment is significant if fewer than so many as good are expected in a document by chance
EXPECTED = 0.05


class Model(NamedTuple):
    """Buckets whose score isn't 0, in order, the score of each, and the map of them; lambda, K and S0; logistic coefficients;
    drift of each word."""

    buckets: np.ndarray
    scores: np.ndarray
    known: np.ndarray
    lam: float
    k: float
    low: float
    fit: tuple[float, ...]
    drift: float = 0.0


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the doc_id's text, modulo ``parts``: which rows are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments as (score, begin, end), in order. Linear time; scores that are 0 or less only separate."""
    total = 0.0
    found: list[tuple[float, float, int, int]] = []  # (sum before, sum after, begin, end)
    # jump[i]: the last segment before i whose sum before is lower than that of i
    jump: list[int] = []
    for i, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        low, high, begin = before, total, i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= low:
                j = jump[j]
            if j < 0 or found[j][1] >= high:
                break
            low, begin = found[j][0], found[j][2]
            del found[j:], jump[j:]
        found.append((low, high, begin, i + 1))
        jump.append(j)
    return [(high - low, begin, end) for low, high, begin, end in found]


def _tokens(piece: tb.Piece) -> tuple[tb.Words, list[tuple[np.ndarray, np.ndarray]]]:
    """Words, and of each kind of token (whole words first) the words that have it and its bucket."""
    w = tb.words(piece, tb.ALNUM, lower=True)
    data, lens = tb.LOWER[piece.data], w.ends - w.starts
    kinds = [(np.arange(len(lens)), w.hashes)]
    for k in PREFIXES:
        own = np.flatnonzero(lens > k)
        kinds.append((own, tb.hashes_of(data, w.starts[own], w.starts[own] + k) + np.uint64(k)))
    return w, [(own, (h % np.uint64(BUCKETS)).astype(np.int64)) for own, h in kinds]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest hash of a window of SHINGLE words, or of a word where there are fewer; 0 without words."""
    for batch in batches:
        for piece in tb.pieces(batch.column("text")):
            with np.errstate(over="ignore"):
                w = tb.words(piece, tb.ALNUM, lower=True)
                first, grams = tb.windows(w, SHINGLE)
            short = w.counts[w.doc] < SHINGLE
            least = np.full(piece.n, np.iinfo(np.uint64).max)
            np.minimum.at(least, np.concatenate([w.doc[first], w.doc[short]]), np.concatenate([grams, w.hashes[short]]))
            rest = batch.slice(piece.first, piece.n)
            yield pa.record_batch({"doc_id": rest.column("doc_id"), "toxic": rest.column("toxic"), "sign": pa.array(np.where(w.counts > 0, least, np.uint64(0)).view(np.int64))})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and bucket: documents of either class that have it."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for piece in tb.pieces(batch.column("text")):
            with np.errstate(over="ignore"):
                w, kinds = _tokens(piece)
            both = np.unique(np.concatenate([w.doc[own] * BUCKETS + bucket for own, bucket in kinds]))
            bucket, label = both % BUCKETS, toxic[piece.first : piece.first + piece.n][both // BUCKETS]
            used = np.unique(bucket)
            n = np.bincount(np.searchsorted(used, bucket) * 2 + label, minlength=2 * len(used)).reshape(-1, 2)
            yield pa.record_batch({"bucket": pa.array(used), "n0": pa.array(n[:, 0].copy()), "n1": pa.array(n[:, 1].copy())})


def _best(model: Model, w: tb.Words, kinds: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, list[list[tuple[float, int, int]]]]:
    """Of each document: score of the best segment, tokens, and the segments (word positions) if it has a word above 0."""
    high, low = np.zeros(len(w.doc)), np.zeros(len(w.doc))
    for own, bucket in kinds:
        maybe = np.flatnonzero(model.known[bucket % MAP])
        at = np.searchsorted(model.buckets, bucket[maybe])
        maybe, at = (x[(at < len(model.buckets)) & (model.buckets[np.minimum(at, len(model.buckets) - 1)] == bucket[maybe])] for x in (maybe, at))
        high[own[maybe]] = np.maximum(high[own[maybe]], model.scores[at])
        low[own[maybe]] = np.minimum(low[own[maybe]], model.scores[at])
    score = np.where(high > 0, high, low) + model.drift
    ends = np.cumsum(w.counts)
    best, found = np.zeros(n), [[] for _ in range(n)]
    for d in np.unique(w.doc[score > 0]).tolist():
        found[d] = segments(score[ends[d] - w.counts[d] : ends[d]].tolist())
        best[d] = max(s for s, _, _ in found[d])
    return best, w.counts, found


def _features(model: Model, n: np.ndarray, found: list[list[float]]) -> np.ndarray:
    """Of each document with segment scores ``found``: 1, and how unlikely these are, as the root of the largest of Chernoff's
    bounds r ln(r / E) - r + E on a Poisson number of r or more segments."""
    out = np.zeros((len(n), 2))
    out[:, 0] = 1
    for i, scores in enumerate(found):
        if len(scores):
            r = np.arange(1, len(scores) + 1)
            ln_e = math.log(model.k * max(int(n[i]), 1)) - model.lam * (np.sort(scores)[::-1] - model.low)  # E itself can be too small for a double
            out[i, 1] = np.sqrt(np.where(np.log(r) > ln_e, r * (np.log(r) - ln_e) - r + np.exp(np.minimum(ln_e, np.log(r))), 0).max())
    return out


def _scan(shared, spans: bool, carry: bool = False, names: tuple[str, str] = ("score", "passages")):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for piece in tb.pieces(batch.column("text")):
                with np.errstate(over="ignore"):
                    w, kinds = _tokens(piece)
                best, n, found = _best(model, w, kinds, piece.n)
                out = {c: batch.column(c).slice(piece.first, piece.n) for c in batch.schema.names if carry or c != "text"}
                scores = [[s for s, _, _ in x] for x in found]
                if not spans:
                    out |= {"best": pa.array(best), "n": pa.array(n.astype(np.int64)), "scores": pa.array(scores, pa.list_(pa.float64()))}
                else:
                    p = 1 / (1 + np.exp(-np.clip(_features(model, n, scores) @ np.array(model.fit), -30, 30)))
                    first = np.cumsum(w.counts) - w.counts
                    rows = []
                    for d, segs in enumerate(found):
                        limit = (math.log(max(int(n[d]), 1) * model.k) - math.log(EXPECTED)) / model.lam + model.low
                        at = piece.offsets[d]
                        rows.append([{"begin": int(w.starts[first[d] + b] - at), "end": int(w.ends[first[d] + e - 1] - at), "score": s} for s, b, e in segs if s >= limit])
                    out |= {names[0]: pa.array(p), names[1]: pa.array(rows, pa.list_(pa.struct({"begin": pa.int64(), "end": pa.int64(), "score": pa.float64()})))}
                yield pa.record_batch(out)

    return run


def _gumbel(best: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """lambda, K and S0 from the best scores of documents that aren't toxic: K from how often there is a segment a token, lambda from the
    mean excess of these scores over the lowest of them."""
    hit = best[best > 0]
    k = (len(hit) + 1) / max(float(n.sum()), 1.0)
    excess = float((hit - hit.min()).mean()) if len(hit) > 1 else 1.0
    return 1 / max(excess, 0.1), k, float(hit.min()) if len(hit) else 0.0


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton steps of a logistic fit with a weak Gaussian prior, each halved until the loss doesn't grow."""
    w = np.zeros(x.shape[1])
    loss = lambda w: np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)).sum() + 5e-3 * w @ w
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
        while loss(w + step) > loss(w) and np.abs(step).max() >= 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    """Learn from ``labels`` (doc_id, toxic 0 or 1; null: left out) of documents whose crc32 fold of 5 is not 0. At most ``labelled`` of
    these rows count, those with the lowest hash of doc_id, and about one of near copies; only their texts go through the token counts. Without any toxic label
    all scores come out below 0.5. Repeated labels of a doc_id: toxic if any is."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("toxic is not null and doc_id is not null").where(fold(F.col("doc_id"), 5) != 0)
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = train.join(F.broadcast(chosen), "doc_id").mapInArrow(_sign, "doc_id long, toxic int, sign long")
    chosen = cut(signed.groupBy("sign", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic").distinct())
    train = train.join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    counts = train.mapInArrow(_count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).persist()
    n0, n1 = (float(x or 0) for x in counts.agg(F.sum("n0"), F.sum("n1")).first())
    prior = (F.col("n0") + F.col("n1")) / F.lit(max(n0 + n1, 1.0)) * F.lit(PRIOR) + F.lit(FLAT)
    weight = PRIOR + FLAT * counts.count()
    odds = lambda n, total: F.log((F.col(n) + prior) / (F.lit(total + weight) - F.col(n) - prior))
    delta = odds("n1", n1) - odds("n0", n0)
    spread = F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior))
    shrunk = F.signum("delta") * F.greatest(F.abs("delta") - F.col("spread") * BOUND, F.lit(0.0))
    found = counts.select("bucket", delta.alias("delta"), spread.alias("spread")).select("bucket", shrunk.alias("score")).where("score <> 0").orderBy("bucket").toArrow()  # tokens of the `labelled` rows at most
    buckets, scores = (found.column(c).to_numpy() for c in ("bucket", "score"))
    known = np.zeros(MAP, bool)
    known[buckets % MAP] = True
    counts.unpersist()
    model = Model(buckets, scores, known, 1.0, 1e-3, 0.0, (0.0, 0.0), DRIFT)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    seen = train.mapInArrow(_scan(shared, False), "toxic int, best double, n long, scores array<double>").toArrow()  # `labelled` rows at most
    y, best, n = (seen.column(c).to_numpy() for c in ("toxic", "best", "n"))
    scores = seen.column("scores").to_pylist()
    lam, k, low = _gumbel(best[y == 0], n[y == 0])
    model = model._replace(lam=lam, k=k, low=low)
    if not (y == 1).any():
        return model._replace(fit=(-5.0, 0.0))
    x = _features(model, n, scores)
    order = np.lexsort((x[:, 1], n, y))  # the rows' order is not defined, and sums of floats depend on it
    return model._replace(fit=_logistic(x[order], y[order].astype(float)))


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "passages")) -> DataFrame:
    """All columns of ``docs``, with score (probability of being toxic) and passages (array of begin, end in UTF-8 bytes, and score of
    every significant segment) of every whole text, under these ``names``. A null or empty text has no tokens and the score of that. A row
    in, a row out; columns that have these names already are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop(*names)
    schema = T.StructType([*rows.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])))])
    return rows.mapInArrow(_scan(shared, True, True, names), schema)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a score below 0.5, as they are: also columns that are called score or passages."""
    names = free_name("score", docs.columns), free_name("passages", docs.columns)
    return score(docs, model, names).where(F.col(names[0]) < 0.5).select(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5) and passages, as learn() and score() say."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), learn(docs, labels, labelled))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
