"""Quality rules whose cutoffs adapt to each language and source, from mergeable quantile sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textblocks as tb
from .base import stage

#: significant bits of a value in a sketch, so quantiles are at most 1/32 too low
BITS = 6
#: (feature in thousandths, numerator, denominator, per cent of documents that are taken to be sound in this respect)
RULES = [
    ("symbols", "n_symbols", "n_words", 90),
    ("word_length", "word_chars", "n_words", 90),
    ("dup_lines", "n_dup_lines", "n_words", 99),
    ("repeats", "n_repeat_words", "n_words", 98),
]
#: a group's cutoff counts with its documents, that of its language, and in turn that of all, with so many
PRIOR_DOCS = 200
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 8


def _counts(piece: tb.Piece) -> dict[str, np.ndarray]:
    data, n = piece.data, piece.n
    w = tb.words(piece)
    total = lambda doc: np.bincount(doc, minlength=n).astype(np.int64)
    owner = lambda at: np.searchsorted(piece.offsets, at, "right") - 1
    chars = np.flatnonzero(tb.SPACES[data] & (data & 0xC0 != 0x80))  # a code point begins with a byte that continues none
    # lines with a word: the byte runs between newlines, whole
    inside = np.ones(256, bool)
    inside[10] = False
    starts, ends = tb.spans(piece, inside)
    with_word = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[with_word], ends[with_word]
    line, doc = tb.hashes_of(data, starts, ends), owner(starts)
    order = np.lexsort((line, doc))
    again = (line[order][1:] == line[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    dup_lines = total(doc[order][1:][again])
    # words in windows that occur twice or more
    first, grams = tb.windows(w, WINDOW)
    doc = w.doc[first]
    order = np.lexsort((grams, doc))
    same = (grams[order][1:] == grams[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(first), bool)
    twice[1:][same] = True
    twice[:-1][same] = True
    edge = np.zeros(len(w.hashes) + 1, np.int64)
    at = first[order][twice]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return {
        "n_words": w.counts.astype(np.int64),
        "word_chars": total(owner(chars)),
        "n_symbols": total(owner(np.flatnonzero(SYMBOLS[data]))),
        "n_dup_lines": dup_lines,
        "n_repeat_words": total(w.doc[covered]),
    }


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the five counts of every whole text; a null or blank text has zeros. A row in, a row out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tb.pieces(batch.column("text")):
                with np.errstate(over="ignore"):
                    counts = _counts(piece)
                rest = batch.slice(piece.first, piece.n)
                yield pa.record_batch({c: rest.column(c) for c in ("doc_id", "lang", "source")} | {k: pa.array(v) for k, v in counts.items()})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(run, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")


def rounded(x: Column) -> Column:
    """A whole number with all but its BITS highest bits cleared: the bucket that a sketch counts it in."""
    spare = F.greatest(F.char_length(F.bin(x)) - BITS, F.lit(0))
    return x - x % F.pow(F.lit(2), spare).cast("long")


def sketch(features: DataFrame, *keys: str) -> DataFrame:
    """Quantile sketch of each feature in each group: how many documents have each rounded value. Some 64 + 32 a bit rows at most
    for a feature and group, whatever the number of documents; sketches merge by adding the counts of equal rows."""
    return features.groupBy(*keys, "feature", "value").agg(F.sum("n").alias("n"))


def cutoffs(sketches: DataFrame, *keys: str) -> DataFrame:
    """Of each group and feature: how many documents, and q + 2 * (q - q50) with the quantiles taken from the sketch: q is the rule's own,
    and the cutoff lies twice as far above what is sound as that lies above the middle."""
    group = Window.partitionBy(*keys, "feature")
    running = sketches.withColumn("upto", F.sum("n").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("docs", F.sum("n").over(group))
    own = F.element_at(F.create_map(*[x for name, _, _, percent in RULES for x in (F.lit(name), F.lit(percent))]), F.col("feature"))
    at = lambda percent: F.min(F.when(F.col("upto") * 100 >= F.col("docs") * percent, F.col("value")))
    return running.groupBy(*keys, "feature").agg(F.max("docs").alias("docs"), (at(own) * 3 - at(F.lit(50)) * 2).alias("cutoff"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed and kept of every document.

    base_failed: fewer than 20 words, or over 30 per cent of them in repeated windows. The others are kept unless a feature lies beyond
    its cutoff, which comes from the sketch of the documents (that did not fail) of the same language and source; nothing is fixed
    beforehand. A group's cutoff is shrunk towards its language's, and this towards that of all (both from merged sketches), as if
    these were PRIOR_DOCS more documents: so there is no least size of a group. Null languages and sources are groups like others. A
    null, empty or blank text fails. Rows with equal doc_id are judged each by its own text.
    """
    counts = stage(measure(docs), "quality-counts").withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))
    thousandths = {name: F.expr(f"{a} * 1000 div greatest({b}, 1)") for name, a, b, _ in RULES}
    features = counts.where("not base_failed").select("lang", "source", F.lit(1).cast("long").alias("n"), F.inline(F.array(*[F.struct(F.lit(k).alias("feature"), rounded(v).alias("value")) for k, v in thousandths.items()])))
    fine = stage(sketch(features, "lang", "source"), "quality-sketches")
    by_lang, overall = cutoffs(sketch(fine, "lang"), "lang"), cutoffs(sketch(fine.withColumn("all", F.lit(1)), "all"), "all")
    limits = cutoffs(fine, "lang", "source").alias("s").join(by_lang.alias("l"), F.col("s.lang").eqNullSafe(F.col("l.lang")) & (F.col("s.feature") == F.col("l.feature")))
    limits = limits.join(overall.alias("o"), F.col("s.feature") == F.col("o.feature"))
    limits = limits.withColumn("wide", F.expr(f"(l.docs * l.cutoff + {PRIOR_DOCS} * o.cutoff) div (l.docs + {PRIOR_DOCS})"))
    limits = limits.select("s.lang", "s.source", "s.feature", F.expr(f"(s.docs * s.cutoff + {PRIOR_DOCS} * wide) div (s.docs + {PRIOR_DOCS})").alias("cutoff"))
    limits = limits.groupBy("lang", "source").agg(*[F.max(F.when(F.col("feature") == name, F.col("cutoff"))).alias(f"max_{name}") for name, *_ in RULES])
    joined = counts.alias("c").join(limits.alias("t"), F.col("c.lang").eqNullSafe(F.col("t.lang")) & F.col("c.source").eqNullSafe(F.col("t.source")), "left")
    good = F.lit(True)
    for name, *_ in RULES:
        good = good & (thousandths[name] <= F.col(f"max_{name}"))
    return joined.select("c.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(good, F.lit(False))).alias("kept"))
