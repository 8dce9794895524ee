"""Media columns: texts as payload of MPEG transport streams (ISO/IEC 13818-1), written and read back.

A stream has one programme: a PAT and a PMT, then one elementary stream of private data. Each access unit of 576 samples is one
PES packet with a presentation time stamp and takes four transport packets; every sixteenth is a random-access point.
The reader trusts nothing that the writer knows: it follows PAT and PMT, checks their CRCs and every PID's continuity
counter, strips adaptation fields and PES headers, and keeps time stamps with random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
PACKET = 188
PMT_PID, DATA_PID = 0x0100, 0x0101
#: ticks of the 90 kHz clock between access units: 576 samples at 48 kHz
TICKS = 1080
#: access units from one random-access point to the next
RANDOM_ACCESS = 16


def payload_of(text: str | None) -> bytes:
    """UTF-8, filled up with bytes 255 to a positive multiple of UNIT."""
    data = (text or "").encode()
    return data + b"\xff" * (UNIT - len(data) if not data else -len(data) % UNIT)


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def section(pid: int, table: int, number: int, body: bytes) -> bytes:
    """One transport packet that holds a whole table section."""
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    data = (0x47400010 | pid << 8).to_bytes(4, "big") + b"\x00" + head + crc32_mpeg(head).to_bytes(4, "big")
    return data + b"\xff" * (PACKET - len(data))


TABLES = section(0, 0, 1, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big")) + section(
    PMT_PID, 2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + b"\x06" + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
)


def write_stream(payload: bytes) -> bytes:
    """A transport stream of ``payload``, whose length is a multiple of UNIT."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    n = len(units)
    out = np.full((n, 4, PACKET), 0xFF, np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2] = 0x47, DATA_PID >> 8, DATA_PID & 0xFF
    out[:, 0, 1] |= 0x40  # a PES packet begins
    out[:, :, 3] = 0x10 | (np.arange(n * 4).reshape(n, 4) & 15)
    out[:, (0, 3), 3] |= 0x20  # these two have an adaptation field
    # first packet: flags, then the PES header of 14 bytes; the field is two bytes, so 168 bytes are left
    out[:, 0, 4], out[:, 0, 5] = 1, np.where(np.arange(n) % RANDOM_ACCESS == 0, 0x40, 0)
    pts = np.arange(n, dtype=np.int64) * TICKS & (1 << 33) - 1
    out[:, 0, 6:15] = np.frombuffer(b"\x00\x00\x01\xbd" + (UNIT + 8).to_bytes(2, "big") + b"\x80\x80\x05", np.uint8)
    for k, value in enumerate((0x21 | pts >> 29 & 0x0E, pts >> 22, pts >> 14 | 1, pts >> 7, pts << 1 | 1)):
        out[:, 0, 15 + k] = value & 0xFF
    out[:, 0, 20:] = units[:, :168]
    out[:, 1, 4:], out[:, 2, 4:] = units[:, 168:352], units[:, 352:536]
    # last packet: 40 bytes are left of the unit, the adaptation field fills the rest
    out[:, 3, 4], out[:, 3, 5] = PACKET - 5 - (UNIT - 536), 0
    out[:, 3, PACKET - (UNIT - 536) :] = units[:, 536:]
    return TABLES + out.tobytes()


class Stream(NamedTuple):
    """What a transport stream holds: of each elementary PID the bytes, time stamps and random-access points."""

    programs: dict[int, int]
    kinds: dict[int, int]
    data: dict[int, bytes]
    pts: dict[int, np.ndarray]
    access: dict[int, np.ndarray]
    packets: int
    counter_errors: int


def _section_of(packets: np.ndarray, begins: np.ndarray, pid: int, table: int) -> bytes:
    """Body of the first whole section of ``table`` on ``pid`` (between its 8-byte header and its CRC)."""
    for row, at in zip(packets, begins, strict=True):
        if not row[1] & 0x40:
            continue
        data = row[at:].tobytes()
        data = data[1 + data[0] :]
        size = 3 + (int.from_bytes(data[1:3], "big") & 0x0FFF)
        if data[0] == table and size <= len(data):
            if crc32_mpeg(data[:size]):
                raise ValueError(f"the CRC of the section on PID {pid} is wrong")
            return data[8 : size - 4]
    raise ValueError(f"PID {pid} has no section of table {table}")


def read_stream(media: bytes) -> Stream:
    if len(media) % PACKET or not media:
        raise ValueError(f"{len(media)} bytes aren't whole transport packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != 0x47).any():
        raise ValueError("a packet doesn't begin with the sync byte")
    pid = (packets[:, 1].astype(np.int64) & 0x1F) << 8 | packets[:, 2]
    control = packets[:, 3] >> 4 & 3
    begins = np.where(control & 2, 5 + packets[:, 4].astype(np.int64), 4)
    begins = np.where(control & 1, begins, PACKET)
    flags = np.where((control & 2 > 0) & (packets[:, 4] > 0), packets[:, 5], 0)
    # continuity: the counter of a PID goes up by one with every packet that has a payload, unless a discontinuity is signalled
    order = np.flatnonzero(control & 1)
    order = order[np.argsort(pid[order], kind="stable")]
    counter = packets[order, 3].astype(np.int64) & 15
    same = pid[order][1:] == pid[order][:-1]
    errors = int((same & (counter[1:] != counter[:-1] + 1 & 15) & (flags[order][1:] & 0x80 == 0)).sum())
    pat = _section_of(packets[pid == 0], begins[pid == 0], 0, 0)
    programs = {int.from_bytes(pat[i : i + 2], "big"): int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF for i in range(0, len(pat), 4)}
    kinds: dict[int, int] = {}
    for number, where in programs.items():
        if number:
            pmt = _section_of(packets[pid == where], begins[pid == where], where, 2)
            at = 4 + (int.from_bytes(pmt[2:4], "big") & 0x0FFF)
            while at < len(pmt):
                kinds[int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF] = pmt[at]
                at += 5 + (int.from_bytes(pmt[at + 3 : at + 5], "big") & 0x0FFF)
    data, pts, access = {}, {}, {}
    for own in kinds:
        mine = np.flatnonzero((pid == own) & (control & 1 > 0))
        rows, at = packets[mine], begins[mine].copy()
        first = rows[:, 1] & 0x40 > 0
        heads = np.flatnonzero(first)
        h = at[heads]
        get = lambda k: rows[heads, h + k].astype(np.int64)  # noqa: B023, E731
        if (get(0) | get(1) | get(2) - 1).any():
            raise ValueError(f"a PES packet on PID {own} has no start code")
        stamped = get(7) & 0x80 > 0
        stamp = (get(9) >> 1 & 7) << 30 | get(10) << 22 | get(11) >> 1 << 15 | get(12) << 7 | get(13) >> 1
        pts[own] = np.where(stamped, stamp, -1)
        access[own] = flags[mine][heads] & 0x40 > 0
        size = get(4) << 8 | get(5)
        skip = 3 + get(8)
        at[heads] += 6 + skip
        lens = np.maximum(PACKET - at, 0)
        got = np.add.reduceat(lens, heads) if len(heads) else lens[:0]
        if len(heads) and (heads[0] != 0 or (got != size - skip)[size > 0].any()):
            raise ValueError(f"a PES packet on PID {own} isn't whole")
        data[own] = rows[np.arange(PACKET) >= at[:, None]].tobytes()
    return Stream(programs, kinds, data, pts, access, len(packets), errors)


def feature(s: Stream) -> str:
    """What later steps ask of a stream, as text."""
    own = min(s.kinds)
    pts, access = s.pts[own], s.access[own]
    points = ",".join(f"{i}@{t}" for i, t in zip(np.flatnonzero(access)[:8].tolist(), pts[access][:8].tolist(), strict=True))
    return f"programs={len(s.programs)};pid={own};type={s.kinds[own]};packets={s.packets};units={len(pts)};pts={pts.min()}-{pts.max()};access={int(access.sum())}:{points};continuity_errors={s.counter_errors}"


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8), media (the transport stream) of every whole text; a null text counts as empty.

    A row in, a row out; equal texts have equal streams. An empty text gives one unit of bytes 255.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                rows = batch.slice(at, 512)
                media = [write_stream(payload_of(x.as_py())) for x in rows.column("text")]
                yield pa.record_batch({"doc_id": rows.column("doc_id"), "n_bytes": rows.column("n_bytes"), "media": pa.array(media, pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload (the elementary stream), the stream's size and digest, time stamps of the random-access points
    (pts, in 90 kHz ticks, with the number of their unit) and the feature text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                rows = batch.slice(at, 512)
                stored = [x.as_py() for x in rows.column("media")]
                read = [read_stream(x) for x in stored]
                payload = [s.data[min(s.kinds)] for s in read]
                yield pa.record_batch(
                    {
                        "doc_id": rows.column("doc_id"),
                        "n_bytes": rows.column("n_bytes"),
                        "payload_bytes": pa.array([len(x) for x in payload], pa.int64()),
                        "payload_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in payload]),
                        "tail_crc32": pa.array([zlib.crc32(x[-32:]) for x in payload], pa.int64()),
                        "media_bytes": pa.array([len(x) for x in stored], pa.int64()),
                        "media_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in stored]),
                        "access_units": pa.array([np.flatnonzero(s.access[min(s.kinds)]).tolist() for s in read], pa.list_(pa.int64())),
                        "access_pts": pa.array([s.pts[min(s.kinds)][s.access[min(s.kinds)]].tolist() for s in read], pa.list_(pa.int64())),
                        "feature": pa.array([feature(s) for s in read]),
                    }
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, access_units array<long>, access_pts array<long>, feature string",
    )
