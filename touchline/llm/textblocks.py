"""Vectorised tokenising of Arrow string batches: words, their hashes and k-word windows, all on byte arrays.

Used inside ``mapInArrow`` tasks only. A batch is walked in pieces of whole documents of about ``PIECE`` bytes, so memory
stays at a small multiple of the larger of that size and one document, whatever the batch or the table holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)

#: bytes that end a word: space and 0x09 to 0x0D
SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
#: letters, digits and every byte of a character beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: A-Z become a-z, all else stays
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Piece(NamedTuple):
    """Some documents: rows ``first`` to ``first + n`` of the batch, their bytes and where each begins and ends."""

    first: int
    n: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Words of a piece: begin and end byte, hash, the document of each, and how many words each document has."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray
    counts: np.ndarray


def pieces(texts: pa.Array | pa.ChunkedArray, piece: int = PIECE) -> Iterator[Piece]:
    """Yield the documents of a string column in order; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + piece, "right")) - 1)
        to = min(to, len(texts))
        yield Piece(at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def spans(piece: Piece, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each longest run of bytes for which ``inside`` holds; no run crosses documents."""
    word = inside[piece.data]
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(word) + 1, bool)
    edge[piece.offsets] = True
    begins, closes = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    closes[:-1] &= ~word[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(closes) + 1


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span (not empty); equal bytes, equal hash."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    base = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(base, lens)
    powers = np.multiply.accumulate(np.full(int(lens.max()), _BASE))
    terms = (data[pos + np.repeat(starts, lens)].astype(np.uint64) + np.uint64(1)) * powers[pos]
    return mix(np.add.reduceat(terms, base) + lens.astype(np.uint64))


def words(piece: Piece, inside: np.ndarray = SPACES, lower: bool = False) -> Words:
    starts, ends = spans(piece, inside)
    data = LOWER[piece.data] if lower else piece.data
    doc = np.searchsorted(piece.offsets, starts, "right") - 1
    return Words(starts, ends, hashes_of(data, starts, ends), doc, np.bincount(doc, minlength=piece.n))


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of each window of ``k`` words within one document."""
    n = len(w.hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(w.doc[:n] == w.doc[k - 1 :])
    total, factor = np.full(len(first), np.uint64(k)), np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            factor = factor * _STEP
            total = total + w.hashes[first + j] * factor
    return first, mix(total)
