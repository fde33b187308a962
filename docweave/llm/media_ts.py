"""MPEG transport streams as media columns: bytes are muxed into 188-byte packets and read back.

The muxer writes a program association table, a program map table and one private elementary
stream.  Each packetized elementary stream (PES) packet holds one access unit with a presentation
timestamp; its first transport packet carries a clock reference and the random-access flag.  The reader
parses both tables (with their checksums), checks the continuity counter of each stream, joins
the payloads of the elementary stream, and lists each access unit's timestamp and whether one
can start there.  All steps on packets are numpy operations on whole streams.

Defined results: null and empty texts store 576 bytes of 255; equal texts give equal values;
repeated rows give repeated rows; an empty table gives an empty table.  A stream that breaks a
rule raises ``ValueError`` in ``demux`` unless only a counter is off, which is counted.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, utf8

# Fixed values of the format (ISO/IEC 13818-1): packet and payload sizes, sync byte, stream numbers, clock, checksum polynomial.
PACKET, BODY, SYNC, CLOCK, POLYNOMIAL = 188, 184, 0x47, 90_000, 0x04C11DB7
PAT_PID, PMT_PID, MEDIA_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0x0000, 0x1000, 0x0100, 1, 0x06, 0xBD
#: Bytes of a PES header with a timestamp, and of an adaptation field with a clock reference.
PES_HEAD, CLOCK_FIELD = 14, 8
#: Packets of a full access unit; its payload fills them exactly.
UNIT_PACKETS = 50
UNIT = CLOCK_FIELD * -1 + BODY * UNIT_PACKETS - PES_HEAD
#: Clock ticks between access units (25 a second); payloads are padded to a multiple of PAD.
TICKS, PAD = 3600, 576


@functools.cache
def _crc_table() -> tuple[int, ...]:
    """The byte table of CRC-32/MPEG-2, from its polynomial."""
    table = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1) ^ (POLYNOMIAL if value & 0x80000000 else 0)
        table.append(value & 0xFFFFFFFF)
    return tuple(table)


def crc32_mpeg(data: bytes) -> int:
    value, table = 0xFFFFFFFF, _crc_table()
    for byte in data:
        value = ((value << 8) & 0xFFFFFFFF) ^ table[(value >> 24) ^ byte]
    return value


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (5 + len(body) + 4), number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    body = b"\0" + section
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + body).ljust(PACKET, b"\xff")


@functools.cache
def _tables() -> bytes:
    pat = _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
    pmt = _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | MEDIA_PID, 0xF000, STREAM_TYPE, 0xE000 | MEDIA_PID, 0xF000))
    return _table_packet(PAT_PID, pat) + _table_packet(PMT_PID, pmt)


def _stamp(ticks: int) -> bytes:
    """A 33-bit timestamp with its marker bits."""
    return bytes([0x21 | (ticks >> 29) & 0x0E, (ticks >> 22) & 0xFF, 0x01 | (ticks >> 14) & 0xFE, (ticks >> 7) & 0xFF, 0x01 | (ticks << 1) & 0xFE])


def _unstamp(b) -> int:
    b = [int(x) for x in b]
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _pes_head(length: int, ticks: int) -> bytes:
    return b"\0\0\1" + struct.pack(">BHBBB", STREAM_ID, length + 8, 0x84, 0x80, 5) + _stamp(ticks)


def _clock_field(ticks: int) -> bytes:
    return bytes([CLOCK_FIELD - 1, 0x50]) + struct.pack(">IH", ticks >> 1 & 0xFFFFFFFF, (ticks & 1) << 15 | 0x7E00)


def _wrap(n: int) -> int:
    return n & ((1 << 33) - 1)


def mux(payload: bytes) -> bytes:
    """A transport stream that holds the payload: tables, then an access unit for each UNIT bytes."""
    full = len(payload) // UNIT
    parts = [_tables()]
    if full:
        units = np.frombuffer(payload, np.uint8, full * UNIT).reshape(full, UNIT)
        out = np.zeros((full, UNIT_PACKETS, PACKET), np.uint8)
        out[:, :, 0], out[:, :, 1], out[:, :, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 0xFF
        out[:, 0, 1] |= 0x40
        counter = np.arange(full * UNIT_PACKETS).reshape(full, UNIT_PACKETS) & 15
        out[:, :, 3] = 0x10 | counter
        out[:, 0, 3] |= 0x20
        heads = b"".join(_clock_field(_wrap(i * TICKS)) + _pes_head(UNIT, _wrap(i * TICKS)) for i in range(full))
        out[:, 0, 4 : 4 + CLOCK_FIELD + PES_HEAD] = np.frombuffer(heads, np.uint8).reshape(full, -1)
        first = BODY - CLOCK_FIELD - PES_HEAD
        out[:, 0, 4 + CLOCK_FIELD + PES_HEAD :] = units[:, :first]
        out[:, 1:, 4:] = units[:, first:].reshape(full, UNIT_PACKETS - 1, BODY)
        parts.append(out.tobytes())
    counter = full * UNIT_PACKETS
    rest = payload[full * UNIT :]
    if rest:
        ticks = _wrap(full * TICKS)
        data, field = _pes_head(len(rest), ticks) + rest, _clock_field(ticks)
        at, start = 0, 0x4000
        while at < len(data):
            room = BODY - len(field)
            part = data[at : at + room]
            if short := room - len(part):  # stuffing goes into the adaptation field
                if field:
                    field = bytes([field[0] + short]) + field[1:] + b"\xff" * short
                else:
                    field = b"\0" if short == 1 else bytes([short - 1, 0]) + b"\xff" * (short - 2)
            parts.append(struct.pack(">BHB", SYNC, start | MEDIA_PID, (0x30 if field else 0x10) | counter & 15) + field + part)
            at, start, field, counter = at + len(part), 0, b"", counter + 1
    return b"".join(parts)


@dataclass
class Stream:
    """What the reader found: the payload, each unit's timestamp, first byte and whether decoding can start there, and counter errors."""

    payload: bytes
    stamps: list[int]
    starts: list[int]
    random_access: list[bool]
    counter_errors: int
    packets: int


def _read_table(packets: np.ndarray, offset: np.ndarray, pids: np.ndarray, pid: int, table_id: int) -> bytes:
    """The section of the first packet of pid, without head and checksum."""
    at = np.flatnonzero(pids == pid)
    if not len(at):
        raise ValueError(f"no packet of stream {pid}")
    raw = packets[at[0]].tobytes()[int(offset[at[0]]) :]
    raw = raw[1 + raw[0] :]
    size = 3 + (struct.unpack(">H", raw[1:3])[0] & 0xFFF)
    if raw[0] != table_id or len(raw) < size or crc32_mpeg(raw[: size - 4]) != struct.unpack(">I", raw[size - 4 : size])[0]:
        raise ValueError(f"bad table of stream {pid}")
    return raw[8 : size - 4]


def demux(stream: bytes) -> Stream:
    """Read a transport stream back: its first program's first elementary stream."""
    if not stream or len(stream) % PACKET:
        raise ValueError("not whole packets")
    p = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise ValueError("no sync byte")
    pids = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    has_field, has_body = p[:, 3] & 0x20 > 0, p[:, 3] & 0x10 > 0
    offset = 4 + np.where(has_field, p[:, 4].astype(np.int32) + 1, 0)
    offset[~has_body] = PACKET
    pat = _read_table(p, offset, pids, PAT_PID, 0)
    pmt_pid = next(b & 0x1FFF for a, b in struct.iter_unpack(">HH", pat) if a)
    pmt = _read_table(p, offset, pids, pmt_pid, 2)
    at = 4 + (struct.unpack(">H", pmt[2:4])[0] & 0xFFF)
    media = struct.unpack(">H", pmt[at + 1 : at + 3])[0] & 0x1FFF
    errors = 0
    for pid in np.unique(pids):
        mine = (pids == pid) & has_body
        count = p[mine, 3] & 15
        errors += int((np.diff(count.astype(np.int32)) % 16 != 1).sum())
    own = np.flatnonzero((pids == media) & has_body)
    rows, offset = p[own], offset[own]
    size = PACKET - offset
    if (size < 0).any():
        raise ValueError("an adaptation field leaves its packet")
    body = rows[np.arange(PACKET) >= offset[:, None]]
    begins = np.concatenate(([0], np.cumsum(size)))[:-1]
    heads = np.flatnonzero(rows[:, 1] & 0x40)
    data, stamps, starts, random, done = [], [], [], [], 0
    edges = [*begins[heads].tolist(), len(body)]
    for k, (row, a, b) in enumerate(zip(heads.tolist(), edges, edges[1:], strict=False)):
        head = body[a : a + 9].tolist()
        if head[:3] != [0, 0, 1]:
            raise ValueError(f"access unit {k} has no start code")
        length, extra = head[4] << 8 | head[5], 9 + head[8]
        end = a + 6 + length if length else b
        if end > b or not head[7] & 0x80:
            raise ValueError(f"access unit {k} is cut off or has no timestamp")
        stamps.append(_unstamp(body[a + 9 : a + 14]))
        starts.append(done)
        random.append(bool(has_field[own[row]] and rows[row, 4] and rows[row, 5] & 0x40))
        data.append(body[a + extra : end])
        done += end - a - extra
    return Stream(np.concatenate(data).tobytes() if data else b"", stamps, starts, random, errors, len(p))


def padded(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of PAD."""
    return data + b"\xff" * (-len(data) % PAD if data else PAD)


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's padded UTF-8 as a transport stream."""

    def make():
        def f(ids, texts):
            raw = [utf8(t) for t in texts]
            return ids, [len(x) for x in raw], [mux(padded(x)) for x in raw]

        return f

    return map_rows(df, [id_col, text_col], f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_bytes long, media binary", make)


def index(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, payload, counter_errors, units): what a media column holds, its units with timestamps and random-access points."""

    def make():
        def f(ids, streams):
            found = [demux(x) for x in streams]
            units = [[{"pts": p, "start": s, "random_access": r} for p, s, r in zip(x.stamps, x.starts, x.random_access, strict=True)] for x in found]
            return ids, [x.payload for x in found], [x.counter_errors for x in found], units

        return f

    kind = media.schema[id_col].dataType.simpleString()
    return map_rows(media, [id_col, "media"], f"{id_col} {kind}, payload binary, counter_errors long, units array<struct<pts: long, start: long, random_access: boolean>>", make)


def digest(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of each stored stream and of the payload read back from it.

    ``feature``: packets, access units, random-access points, last timestamp in seconds, counter errors.
    """

    def make():
        def f(ids, sizes, streams):
            found = [demux(x) for x in streams]
            return (
                ids,
                sizes,
                [len(x.payload) for x in found],
                [hashlib.sha256(x.payload).hexdigest() for x in found],
                [zlib.crc32(x.payload[-32:]) for x in found],
                [len(x) for x in streams],
                [hashlib.sha256(x).hexdigest() for x in streams],
                [f"packets={x.packets} units={len(x.stamps)} random_access={sum(x.random_access)} last_pts={x.stamps[-1] / CLOCK:.2f} counter_errors={x.counter_errors}" for x in found],
            )

        return f

    kind = media.schema[id_col].dataType.simpleString()
    return map_rows(media, [id_col, "n_bytes", "media"], f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", make)
