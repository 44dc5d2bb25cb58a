"""Media columns: bytes kept as MPEG transport streams, and read back with their timestamps."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

# Fixed values of the format: packet size, packet ids, stream type (private data in PES packets) and stream id.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, STREAM_PID = 0, 0x1000, 0x0100
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
#: Bytes of payload in an access unit, 90 kHz ticks between units, and units from one random-access point to the next.
UNIT_BYTES, UNIT_TICKS, RANDOM_ACCESS_EVERY = 32_768, 3_003, 4


@functools.lru_cache(maxsize=None)
def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
        table.append(c)
    return table


@functools.lru_cache(maxsize=1024)
def section_crc(data: bytes) -> int:
    """CRC-32 of program tables (polynomial 04C11DB7, most significant bit first, no final inversion)."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _crc_table()[(c >> 24) ^ b]
    return c


def _section_packet(pid: int, table: bytes) -> bytes:
    body = table + section_crc(table).to_bytes(4, "big")
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + body).ljust(PACKET, b"\xff")


@functools.lru_cache(maxsize=1)
def _tables() -> bytes:
    pat = bytes([0x00, 0xB0, 13, 0, 1, 0xC1, 0, 0, 0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF])
    pmt = bytes([0x02, 0xB0, 18, 0, 1, 0xC1, 0, 0, 0xE0 | STREAM_PID >> 8, STREAM_PID & 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | STREAM_PID >> 8, STREAM_PID & 0xFF, 0xF0, 0])
    return _section_packet(PAT_PID, pat) + _section_packet(PMT_PID, pmt)


def _pts_bytes(pts: int) -> bytes:
    pts &= (1 << 33) - 1
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def to_transport_stream(payload: bytes) -> bytes:
    """The payload as one program with one elementary stream: a PAT and a PMT packet, then each
    access unit as a PES packet with its timestamp, its clock and, on every fourth, the random-access mark."""
    out = [_tables()]
    counter = 0
    for k, start in enumerate(range(0, len(payload), UNIT_BYTES)):
        unit = payload[start : start + UNIT_BYTES]
        pts = k * UNIT_TICKS
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts_bytes(pts) + unit
        pcr = (pts << 15 | 0x7E00).to_bytes(6, "big")
        adaptation = bytes([0x10 | 0x40 * (k % RANDOM_ACCESS_EVERY == 0)]) + pcr
        first = min(len(pes), PACKET - 5 - len(adaptation))
        adaptation += b"\xff" * (PACKET - 5 - len(adaptation) - first)
        out.append(bytes([SYNC, 0x40 | STREAM_PID >> 8, STREAM_PID & 0xFF, 0x30 | counter & 15, len(adaptation)]) + adaptation + pes[:first])
        counter += 1
        full, rest = divmod(len(pes) - first, PACKET - 4)
        if full:
            packets = np.empty((full, PACKET), dtype=np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF
            packets[:, 3] = 0x10 | (counter + np.arange(full)) % 16
            packets[:, 4:] = np.frombuffer(pes, np.uint8, full * (PACKET - 4), first).reshape(full, -1)
            out.append(packets.tobytes())
            counter += full
        if rest:
            room = PACKET - 4 - rest
            stuffing = bytes([room - 1]) + (b"\x00" + b"\xff" * (room - 2) if room > 1 else b"")
            out.append(bytes([SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF, 0x30 | counter & 15]) + stuffing + pes[-rest:])
            counter += 1
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes = b""
    units: list[tuple[int | None, int, int, bool]] = field(default_factory=list)  # pts, offset, length, random access
    packets: int = 0
    discontinuities: int = 0
    damaged: int = 0  # packets without sync or with a transport error, tables with a wrong CRC, bad PES headers
    stream_type: int | None = None


def _sections(packets: np.ndarray, pid: int, out: Stream) -> list[bytes]:
    found = []
    for p in np.flatnonzero(((packets[:, 1] & 0x1F).astype(int) << 8 | packets[:, 2]) == pid):
        raw = packets[p].tobytes()
        if not raw[1] & 0x40 or not raw[3] & 0x10:
            continue
        at = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
        at += 1 + raw[at] if at < PACKET else 0
        if at + 3 > PACKET:
            continue
        size = (raw[at + 1] & 0x0F) << 8 | raw[at + 2]
        section = raw[at : at + 3 + size]
        if len(section) == 3 + size and size >= 9 and section_crc(section[:-4]) == int.from_bytes(section[-4:], "big"):
            found.append(section)
        else:
            out.damaged += 1
    return found


def read_transport_stream(data: bytes | None) -> Stream:
    """The first elementary stream of the first program: its bytes, and each access unit's timestamp,
    place and random-access mark. Repeated packets are passed over, gaps of the continuity counter counted."""
    out = Stream()
    if not data:
        return out
    out.packets, odd = divmod(len(data), PACKET)
    out.damaged += odd > 0
    packets = np.frombuffer(data, np.uint8, out.packets * PACKET).reshape(-1, PACKET)
    good = (packets[:, 0] == SYNC) & (packets[:, 1] & 0x80 == 0)
    out.damaged += int(len(good) - good.sum())
    packets = packets[good]
    pmt_pid = stream_pid = None
    for s in _sections(packets, PAT_PID, out):
        for i in range(8, len(s) - 4, 4):
            if s[0] == 0 and s[i] << 8 | s[i + 1] and pmt_pid is None:
                pmt_pid = (s[i + 2] & 0x1F) << 8 | s[i + 3]
    for s in _sections(packets, pmt_pid, out) if pmt_pid is not None else []:
        at = 12 + ((s[10] & 0x0F) << 8 | s[11])
        if s[0] == 2 and stream_pid is None and at + 5 <= len(s) - 4:
            out.stream_type, stream_pid = s[at], (s[at + 1] & 0x1F) << 8 | s[at + 2]
    if stream_pid is None:
        return out
    packets = packets[((packets[:, 1] & 0x1F).astype(int) << 8 | packets[:, 2]) == stream_pid]
    packets = packets[packets[:, 3] & 0x10 > 0]  # those with a payload
    counters = (packets[:, 3] & 15).astype(np.int16)
    step = np.diff(counters) % 16
    repeated = np.concatenate([[False], step == 0])[: len(packets)]
    out.discontinuities = int(((step != 1) & (step != 0)).sum())
    packets = packets[~repeated]
    adapted = packets[:, 3] & 0x20 > 0
    begin = 4 + np.where(adapted, 1 + packets[:, 4].astype(int), 0)
    marked = adapted & (packets[:, 4] > 0) & (packets[:, 5] & 0x40 > 0)
    starts = np.flatnonzero(packets[:, 1] & 0x40)
    parts, offset = [], 0
    for k, p in enumerate(starts):
        stop = starts[k + 1] if k + 1 < len(starts) else len(packets)
        body, lead = packets[p:stop], begin[p:stop]
        plain = int(np.argmax(lead[1:] != 4)) + 1 if (lead[1:] != 4).any() else len(body)
        pes = body[0, lead[0] :].tobytes() + body[1:plain, 4:].tobytes() + b"".join(body[i, lead[i] :].tobytes() for i in range(plain, len(body)))
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
            out.damaged += 1
            continue
        size, head = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
        unit = pes[head : 6 + size if size else None]
        out.damaged += size > 0 and len(pes) < 6 + size
        pts = None
        if pes[7] & 0x80 and pes[8] >= 5:
            pts = (pes[9] >> 1 & 7) << 30 | pes[10] << 22 | pes[11] >> 1 << 15 | pes[12] << 7 | pes[13] >> 1
        parts.append(unit)
        out.units.append((pts, offset, len(unit), bool(marked[p])))
        offset += len(unit)
    out.payload = b"".join(parts)
    return out


def padded(text: str | None, multiple: int = 64) -> bytes:
    """UTF-8 and zero bytes up to a positive multiple of ``multiple``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(multiple, -(-len(raw) // multiple) * multiple) - len(raw))


@F.pandas_udf(BinaryType())
def _stored(texts: pd.Series) -> pd.Series:
    return pd.Series([to_transport_stream(padded(t)) for t in texts], dtype="object")


_UNIT = StructType([StructField("pts", LongType()), StructField("offset", LongType()), StructField("length", LongType()), StructField("random_access", BooleanType())])
_READ = StructType(
    [
        StructField("payload", BinaryType()),
        StructField("units", ArrayType(_UNIT)),
        StructField("packets", LongType()),
        StructField("discontinuities", LongType()),
        StructField("damaged", LongType()),
        StructField("stream_type", IntegerType()),
    ]
)


@F.pandas_udf(_READ)
def _loaded(media: pd.Series) -> pd.DataFrame:
    names = [f.name for f in _UNIT]
    rows = []
    for m in media:
        s = read_transport_stream(m)
        rows.append((s.payload, [dict(zip(names, u)) for u in s.units], s.packets, s.discontinuities, s.damaged, s.stream_type))
    out = pd.DataFrame(rows, columns=[f.name for f in _READ])
    out["stream_type"] = out["stream_type"].astype("Int32")
    return out


def store_media(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``media`` (binary): the whole text as UTF-8, padded with bytes 0
    to a positive multiple of 64, as an MPEG transport stream. Null texts count as empty; equal
    texts give equal media; a column named ``media`` is replaced; an empty table stays empty."""
    kept = [c for c in docs.columns if c.lower() != "media"]
    return docs.select(*[docs[c] for c in kept], _stored(docs[text].cast("string")).alias("media"))


def read_media(stored: DataFrame, *, media: str = "media") -> DataFrame:
    """All columns of ``stored`` plus ``payload`` (the bytes read back), ``units`` (timestamp, offset,
    length and random-access mark of each access unit), ``packets``, ``discontinuities``, ``damaged``
    and ``stream_type``. Null or empty media give an empty payload; damage is counted, never raised;
    streams of any length are read whole, repeated rows one by one; columns named like the results are
    replaced; an empty table stays empty."""
    kept = [c for c in stored.columns if c.lower() not in {f.name for f in _READ}]
    return stored.select(*[stored[c] for c in kept], _loaded(stored[media]).alias("_read")).select(*kept, "_read.*")


def media_digest(docs: DataFrame) -> DataFrame:
    """Sizes and checksums of each document's stored and re-read bytes, and the features of its stream.

    Null texts count as empty; texts of any length are stored whole; equal texts, repeated rows too, give equal
    values; other columns, whatever their names, are left out; an empty table gives an empty result.
    """
    read = read_media(store_media(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))))
    marked = F.filter("units", lambda u: u["random_access"])
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("packets="), "packets"),
        F.concat(F.lit("units="), F.size("units")),
        F.concat(F.lit("random_access="), F.array_join(F.transform(marked, lambda u: F.concat(u["pts"], F.lit("@"), u["offset"])), ",")),
        F.concat(F.lit("last_pts="), F.element_at("units", -1)["pts"]),
        F.concat(F.lit("discontinuities="), "discontinuities"),
        F.concat(F.lit("damaged="), "damaged"),
    )
    return read.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
