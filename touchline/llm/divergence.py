"""Source divergence audit: how far the words of each source of a language lie from those of the other sources and of the language.

How it scales
1. Each task counts document frequencies of its (language, term) hashes in a count-min sketch of ``CELLS`` saturating bytes. Sketches move as
   pages and merge by a saturating sum, so a merged cell never underestimates. Its size doesn't depend on the data: it is broadcast.
2. A second pass over the texts discards every term whose least cell is below ``min_docs`` before anything is shuffled; what is left is
   counted exactly. A full sketch discards less, and the result stays the same.
3. Of two sources, most terms are in neither. Divergence is written as that of two sources without any term, plus what the terms of one
   change (by histograms of counts), plus what terms of both change (a join by term): nothing has the size of vocabulary times pairs.

A null language, source or text is an empty one; repeated rows are documents of their own; an empty table has no rows; columns other
than text, lang and source are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textblocks as T
from .base import small_or_shuffled, stage

#: rows and cells of a row of the sketch, and bytes of a page in which it moves
DEPTH, CELLS, PAGE = 4, 1 << 20, 1 << 12
#: rows of the table of groups that is broadcast at most
GROUPS = 100_000
#: bytes of texts whose terms a task sums at once, and rows of such sums that it holds before it sums them again and gives them out
PIECE, HELD = 1 << 21, 600_000

#: a term: ASCII letters and every byte of a character beyond ASCII
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Audit(NamedTuple):
    """``groups``: lang, source, n_terms (kept terms of the language), n_group, n_lang (their occurrences); ``terms``: lang, source, term,
    count, total (in the language), p and q (parts in 10 ** 9, plus one); ``pairs``: lang, source, other, value."""

    groups: DataFrame
    terms: DataFrame
    pairs: DataFrame


def _keys(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string; equal strings, equal hash."""
    codes = values.dictionary_encode()
    names = codes.dictionary.to_pylist()
    data = [np.frombuffer(b"\x01" + x.encode(), np.uint8) for x in names]
    ends = np.cumsum([len(x) for x in data])
    hashes = T.hashes_of(np.concatenate(data), ends - [len(x) for x in data], ends) if data else np.zeros(0, np.uint64)
    return hashes[codes.indices.to_numpy(zero_copy_only=False)]


def _cells(hashes: np.ndarray, cells: int) -> np.ndarray:
    """Cell of each hash in each row of the sketch, as places in the flat sketch."""
    steps = np.arange(1, DEPTH + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    return (T.mix(hashes[None, :] ^ steps) % np.uint64(cells)).astype(np.int64) + np.arange(DEPTH)[:, None] * cells


def _added(sketch: np.ndarray, cells: np.ndarray, n: np.ndarray) -> None:
    """Add ``n`` at its cell in each row, up to 255."""
    at, inverse = np.unique(cells.reshape(-1), return_inverse=True)
    sketch[at] = np.minimum(sketch[at] + np.bincount(inverse, np.tile(n, DEPTH)), 255)


def _in_docs(doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """Of each of n terms, in how many documents it is, from the document and the term of each occurrence."""
    return np.bincount(np.unique(doc.astype(np.int64) * n + term) % n, minlength=n)


def _sketches(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """lang, text -> the pages of the task's sketch that aren't empty."""
        sketch = np.zeros(DEPTH * cells, np.uint8)
        for batch in batches:
            lang = _keys(batch.column(0))
            for piece in T.pieces(batch.column(1), PIECE):
                w = T.words(piece, LETTER, lower=True)
                terms, at = np.unique(T.mix(w.hashes ^ lang[piece.first + w.doc]), return_inverse=True)
                if len(terms):
                    _added(sketch, _cells(terms, cells), _in_docs(w.doc, at, len(terms)))
        pages = sketch.reshape(-1, PAGE)
        full = np.flatnonzero(pages.any(axis=1))
        for i in range(0, len(full), 256):
            part = full[i : i + 256]
            yield pa.record_batch({"page": part, "cells": pa.array([pages[k].tobytes() for k in part], pa.binary())})

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Saturating sum of the cells of each page. A task holds each of its pages once."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for page, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            new = np.frombuffer(cells, np.uint8)
            held[page] = np.minimum(held[page].astype(np.uint16) + new, 255).astype(np.uint8) if page in held else new
    if held:
        yield pa.record_batch({"page": pa.array(list(held), pa.int64()), "cells": pa.array([x.tobytes() for x in held.values()], pa.binary())})


def sketch(docs: DataFrame, cells: int = CELLS) -> np.ndarray:
    """Merged count-min sketch of document frequencies by language and term: DEPTH * ``cells`` bytes, at every size of ``docs``."""
    pages = docs.select("lang", "text").mapInArrow(_sketches(cells), "page long, cells binary").repartition("page").mapInArrow(_merged, "page long, cells binary")
    out = np.zeros((DEPTH * cells // PAGE, PAGE), np.uint8)
    for row in pages.toArrow().to_pylist():
        out[row["page"]] = np.frombuffer(row["cells"], np.uint8)
    return out.reshape(-1)


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans as an array of strings."""
    lens = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lens)])
    pos = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lens)
    return pa.LargeStringArray.from_buffers(len(lens), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[pos].tobytes())).cast(pa.string())


def _summed(held: list[tuple[np.ndarray, pa.RecordBatch]]) -> pa.RecordBatch:
    """Rows of several pieces as one row for each key."""
    rows = pa.Table.from_batches([x for _, x in held]).combine_chunks()
    _, first, at = np.unique(np.concatenate([k for k, _ in held]), return_index=True, return_inverse=True)
    out = rows.take(pa.array(first))
    for c in ("count", "docs"):
        out = out.set_column(out.schema.get_field_index(c), c, pa.array(np.bincount(at, rows.column(c).to_numpy()).astype(np.int64)))
    return out.to_batches()[0]


def _survivors(shared: Broadcast, min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """lang, source, text -> lang, source, term, occurrences and documents of what the sketch lets through, summed over HELD rows of pieces at a time."""
        sketch, held, n_held = shared.value, [], 0
        for batch in batches:
            lang, source = batch.column(0), batch.column(1)
            lang_key, source_key = _keys(lang), _keys(source)
            group_key = T.mix(lang_key ^ T.mix(source_key))
            for piece in T.pieces(batch.column(2), PIECE):
                w = T.words(piece, LETTER, lower=True)
                if not len(w.doc):
                    continue
                row = piece.first + w.doc
                terms, inverse = np.unique(T.mix(w.hashes ^ lang_key[row]), return_inverse=True)
                may = (sketch[_cells(terms, len(sketch) // DEPTH)].min(axis=0) >= min_docs)[inverse]
                if not may.any():
                    continue
                row, hashes, starts, ends = row[may], w.hashes[may], w.starts[may], w.ends[may]
                keys, first, at, n = np.unique(T.mix(group_key[row] ^ hashes), return_index=True, return_inverse=True, return_counts=True)
                docs = _in_docs(row, at, len(first))
                names = _strings(T.LOWER[piece.data], starts[first], ends[first])
                held.append((keys, pa.record_batch({"lang": lang.take(pa.array(row[first])), "source": source.take(pa.array(row[first])), "term": names, "count": n.astype(np.int64), "docs": docs.astype(np.int64)})))
                n_held += len(keys)
                if n_held >= HELD:
                    yield _summed(held)
                    held, n_held = [], 0
        if held:
            yield _summed(held)

    return run


def counts(docs: DataFrame, min_docs: int = 3, cells: int = CELLS) -> DataFrame:
    """lang, source, term, count, docs: exact for every term that is in ``min_docs`` documents of its language; of others some may be missing."""
    held = docs.sparkSession.sparkContext.broadcast(sketch(docs, cells))
    found = docs.select("lang", "source", "text").mapInArrow(_survivors(held, min_docs), "lang string, source string, term string, count long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10 ** 9 (count + 1) / (n + v)), exact at every count."""
    return F.lit(1).cast("long") + F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)"), F.greatest(n + v, F.lit(1)).cast("decimal(20,0)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q)"""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(documents: DataFrame, min_docs: int = 3, cells: int = CELLS) -> Audit:
    """Divergence of every (language, source) from the language's other sources, and of every kept term from the language: see Audit."""
    docs = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = stage(counts(docs, min_docs, cells), "divergence-counts")
    kept = stage(found.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"), "divergence-kept")
    own = stage(found.select("lang", "source", "term", "count").join(kept, ["lang", "term"]), "divergence-own")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("total").alias("n_lang"))
    of_group = own.groupBy("lang", "source").agg(F.sum("count").alias("n_group"))
    names = docs.select("lang", "source").distinct()
    groups = stage(names.join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_terms", "n_group", "n_lang")]), "divergence-groups")
    few = groups.count()
    small = groups.withColumn("p0", share(F.lit(0), F.col("n_group"), F.col("n_terms")))
    terms = own.join(small_or_shuffled(small, few, GROUPS), ["lang", "source"])
    terms = terms.select("lang", "source", "term", "count", "total", "p0", share(F.col("count"), F.col("n_group"), F.col("n_terms")).alias("p"), share(F.col("total"), F.col("n_lang"), F.col("n_terms")).alias("q"))
    terms = stage(terms, "divergence-terms")
    return Audit(groups, terms.drop("p0"), _pairs(small, terms, few))


def _pairs(groups: DataFrame, terms: DataFrame, few: int) -> DataFrame:
    """lang, source, other and the sum of gap() over all kept terms of the language, for every two sources of one."""
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    both = groups.join(small_or_shuffled(other, few, GROUPS), "lang").where("source <> other")
    parts = [both.select("lang", "source", "other", (F.col("n_terms") * gap(p0, q0)).alias("value"))]
    bars = terms.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("n"))
    parts.append(bars.join(small_or_shuffled(other, few, GROUPS), "lang").where("source <> other").select("lang", "source", "other", (F.col("n") * (gap(p, q0) - gap(p0, q0))).alias("value")))
    bars = bars.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"), F.col("p").alias("q"), "n")
    mine = groups.select("lang", "source", "p0")
    parts.append(bars.join(small_or_shuffled(mine, few, GROUPS), "lang").where("source <> other").select("lang", "source", "other", (F.col("n") * (gap(p0, q) - gap(p0, q0))).alias("value")))
    theirs = terms.select("lang", "term", F.col("source").alias("other"), F.col("p0").alias("q0"), F.col("p").alias("q"))
    met = terms.select("lang", "term", "source", "p0", "p").join(theirs.hint("merge"), ["lang", "term"]).where("source <> other")
    parts.append(met.select("lang", "source", "other", (gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0)).alias("value")))
    summed = parts[0]
    for x in parts[1:]:
        summed = summed.unionByName(x.groupBy("lang", "source", "other").agg(F.sum("value").alias("value")))
    return summed.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def report(found: Audit, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources of a group by divergence (part ``pair``), and its ``top`` terms that are
    more frequent than in the language (part ``term``); ties by the item's bytes."""
    pairs = found.pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    terms = found.terms.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))
