"""Byte-pair encoding and decoding with a published vocabulary (lower case, word ends marked, white space dropped).

Encoding keeps the symbols of a word in a doubly linked list and the possible merges in a priority queue of (rank, place);
entries whose symbols have changed meanwhile are stale and skipped. Decoding joins the vocabulary's strings.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: words whose ids a task remembers, beyond which it starts anew, and characters of a word that it remembers: at most some 70 MB in all
REMEMBERED, REMEMBERED_CHARS = 120_000, 64
#: rows, and bytes of text or ids, that a task works on at once; a longer text is on its own
ROWS, BYTES = 256, 4 << 20
#: kinds of normalizers that the encoder has in code; a vocabulary file with others is refused
NORMALIZERS = ["Lowercase", "NFC", "Replace"]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files of this kind."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Known(dict):
    """Ids of words seen before, as bytes."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.bpe.word(word)).tobytes()
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class Bpe:
    """Encoder of one vocabulary file (its JSON text)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        if sorted(x["type"] for x in spec["normalizer"]["normalizers"]) != NORMALIZERS:
            raise ValueError("the vocabulary's normalizer is not the one that this encoder has")
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.literal = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = regex.compile(next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"))
        #: id of each byte's symbol inside a word, and as its last one; -1: none
        symbols = byte_symbols()
        self.inner = [self.vocab.get(x, -1) for x in symbols]
        self.last = [self.vocab.get(x + self.end, -1) for x in symbols]
        #: left id << 32 | right id -> rank << 32 | id of the merged symbol
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a] << 32 | self.vocab[b]] = rank << 32 | self.vocab[a + b]
        self.known = Known(self)

    def word(self, word: str) -> list[int]:
        """Ids of one word."""
        data = word.encode()
        ids = [self.inner[x] for x in data]
        ids[-1] = self.last[data[-1]]
        if -1 in ids:
            ids = [x for x in ids if x >= 0]
        n, merges = len(ids), self.merges
        # a queue entry is rank << 32 | place, so the lowest rank comes first and the leftmost place of it
        queue = [found >> 32 << 32 | i for i in range(n - 1) if (found := merges.get(ids[i] << 32 | ids[i + 1])) is not None]
        if not queue:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j < 0 or ids[i] < 0 or (found := merges.get(ids[i] << 32 | ids[j])) is None or found >> 32 != entry >> 32:
                continue  # stale: one of the two symbols is merged already
            ids[i], ids[j] = found & 0xFFFFFFFF, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (found := merges.get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(queue, found >> 32 << 32 | i)
            h = before[i]
            if h >= 0 and (found := merges.get(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(queue, found >> 32 << 32 | h)
        return [x for x in ids if x >= 0]

    def strings(self) -> Strings:
        return Strings(self.vocab, self.added)

    def _plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # no final form of sigma
        return b"".join(map(self.known.__getitem__, self.pieces.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.literal is None or not self.literal.search(text):
            return self._plain(text)
        parts = self.literal.split(text)
        return b"".join(np.array([self.added[x]], "<u4").tobytes() if x in self.added else self._plain(x) for x in parts if x)


class Strings:
    """What decoding needs of a vocabulary file: the string of each id."""

    def __init__(self, vocab: dict[str, int], added: dict[str, int]):
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in added.items()}

    @classmethod
    def of(cls, source: str) -> Strings:
        spec = json.loads(source)
        return cls(spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]})

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[tuple, Bpe | Strings] = {}


def _made(kind: type, source):
    """The encoder or decoder of a vocabulary, made once in a worker."""
    if (key := (kind.__name__, hash(source.value))) not in _loaded:
        _loaded.clear()
        _loaded[key] = kind.of(source.value) if kind is Strings else kind(source.value)
    return _loaded[key]


def _source(df: DataFrame, vocabulary: str | None):
    """The vocabulary file's text (a few MB, whatever the data), sent to the executors."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ROWS rows and about BYTES bytes of ``column``."""
    ends = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)])
    at = 0
    while at < len(batch):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, "right"))
        to = min(max(to, at + 1), at + ROWS, len(batch))
        yield batch.slice(at, to - at)
        at = to


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) of every whole text, in the order of the rows.

    A null or empty text has no ids (an empty binary). The literal strings of the vocabulary's special tokens in a text become
    their ids. Repeated rows, clashing extra columns and empty tables need nothing special: a row in, a row out.
    """
    source = _source(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _made(Bpe, source)
        for batch in batches:
            for rows in _slices(batch, "text"):
                yield pa.record_batch({"doc_id": rows.column("doc_id"), "ids": pa.array([bpe.encode(x.as_py() or "") for x in rows.column("text")], pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids and text: the vocabulary's strings of the ids, joined by spaces (this vocabulary has no decoder of its own,
    so word ends stay visible). Null ids count as none."""
    source = _source(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = _made(Strings, source)
        for batch in batches:
            for rows in _slices(batch, "ids"):
                yield pa.record_batch({"doc_id": rows.column("doc_id"), "ids": rows.column("ids"), "text": pa.array([strings.decode(x.as_py() or b"") for x in rows.column("ids")], pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """What decode(encode(docs)) gives, with one Python worker a task instead of two, and the columns ``keep`` of ``docs`` (of other names)."""
    source = _source(docs, vocabulary)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[docs.schema[c] for c in keep], T.StructField("ids", T.BinaryType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _made(Bpe, source)
        strings = bpe.strings()
        for batch in batches:
            for rows in _slices(batch, "text"):
                ids = [bpe.encode(x.as_py() or "") for x in rows.column("text")]
                own = {c: rows.column(c) for c in ("doc_id", *keep)}
                yield pa.record_batch(own | {"ids": pa.array(ids, pa.binary()), "text": pa.array(map(strings.decode, ids), pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text").mapInArrow(run, schema)


def digest(decoded: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, n_tokens and the digests of ids and decoded text."""
    return decoded.select(
        "doc_id",
        *keep,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
