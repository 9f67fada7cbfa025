"""Media columns: MPEG transport streams.

`mux` stores bytes as the 8-bit samples (8000 a second) of one private elementary stream: a program association table, a
program map table and one PES packet a second, each with a presentation timestamp and, on its first transport packet, a
clock reference and the random access flag. `demux` reads streams back, those of other writers too: it joins table sections over packets and
checks their CRCs, follows the association table to a program and its map to an elementary stream (the first of each, or those asked for),
checks the continuity counters (a packet that announces a discontinuity is none), drops repeated packets, joins the packet
payloads and splits them at unit starts.

The media column is a table: mux_documents' rows are written to the shared folder and read from there by demux_streams.

A null or empty text has the smallest payload, 64 zero bytes; very long ones are stored whole. Equal texts give equal streams. Repeated
rows give repeated rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_slices
from .textbytes import text_bytes

PACKET, RATE, CLOCK = 188, 8000, 90_000
PMT_PID, DATA_PID, PRIVATE_STREAM, STREAM_TYPE = 0x1000, 0x0100, 0xBD, 0x06

_CRC_TABLE = []
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = (_c << 1) ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1
    _CRC_TABLE.append(_c & 0xFFFFFFFF)


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC_TABLE[crc >> 24 ^ byte]
    return crc


def _section(table_id: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 4) >> 8, (len(body) + 4) & 255])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (b"\x47" + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(0, _section(0, b"\x00\x01\xc1\x00\x00" + b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID,
    _section(2, b"\x00\x01\xc1\x00\x00" + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"),
)


def _timestamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, pts >> 14 & 254 | 1, pts >> 7 & 255, pts << 1 & 254 | 1])


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, counter = [_TABLES], 0
    for at in range(0, len(payload), RATE):
        unit = payload[at : at + RATE]
        pts = at // RATE * CLOCK & (1 << 33) - 1
        data = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(pts) + unit
        # first packet: adaptation field with the random access flag, a clock reference and, in a short unit, stuffing
        clock = (pts << 15 | 0x7E00).to_bytes(6, "big")
        stuffing = max(0, 176 - len(data))
        out.append(b"\x47" + (0x4000 | DATA_PID).to_bytes(2, "big") + bytes([0x30 | counter & 15, 7 + stuffing, 0x50]) + clock + b"\xff" * stuffing + data[:176])
        counter += 1
        rest = data[176:]
        whole = len(rest) // 184
        if whole:
            block = np.empty((whole, PACKET), np.uint8)
            block[:, :3] = (0x47, DATA_PID >> 8, DATA_PID & 255)
            block[:, 3] = 0x10 | (counter + np.arange(whole)) & 15
            block[:, 4:] = np.frombuffer(rest, np.uint8, whole * 184).reshape(whole, 184)
            out.append(block.tobytes())
            counter += whole
        if tail := rest[whole * 184 :]:
            room = 183 - len(tail)
            field = bytes([room]) + (b"\x00" + b"\xff" * (room - 1) if room else b"")
            out.append(b"\x47" + DATA_PID.to_bytes(2, "big") + bytes([0x30 | counter & 15]) + field + tail)
            counter += 1
    return b"".join(out)


def _payload(packet: np.ndarray) -> bytes:
    return packet[4 + (1 + int(packet[4]) if packet[3] & 0x20 else 0) :].tobytes() if packet[3] & 0x10 else b""


def _section_body(packets: np.ndarray, pid: np.ndarray, wanted: int, table_id: int) -> bytes:
    """The body of the first whole section of a table on a PID, CRC checked; sections may span packets."""
    data = None
    for packet in packets[pid == wanted]:
        part = _payload(packet)
        if packet[1] & 0x40 and part:  # a section starts after the pointer; what is before it ends the one at hand
            pieces = [(data or b"") + part[1 : 1 + part[0]], part[1 + part[0] :]] if data is not None else [part[1 + part[0] :]]
        elif data is not None:
            pieces = [data + part]
        else:
            continue
        for data in pieces:
            while len(data) >= 3 and data[0] != 0xFF:
                length = 3 + ((data[1] & 0x0F) << 8 | data[2])
                if length > len(data):
                    break
                if data[0] == table_id and crc32_mpeg(data[:length]) == 0:
                    return data[8 : length - 4]
                data = data[length:]
    raise ValueError(f"no whole table {table_id} on PID {wanted}")


def streams_of(packets: np.ndarray, pid: np.ndarray) -> tuple[dict[int, list[tuple[int, int]]], list[int]]:
    """The (stream type, PID) lists of each program, and the numbers of programs whose map table is absent or broken."""
    table, out, broken = _section_body(packets, pid, 0, 0), {}, []
    for i in range(0, len(table), 4):
        if number := table[i] << 8 | table[i + 1]:  # number 0 names the network table
            try:
                body = _section_body(packets, pid, (table[i + 2] & 0x1F) << 8 | table[i + 3], 2)
            except ValueError:
                broken.append(number)
                continue
            at, out[number] = 4 + ((body[2] & 0x0F) << 8 | body[3]), []
            while at < len(body):
                out[number].append((body[at], (body[at + 1] & 0x1F) << 8 | body[at + 2]))
                at += 5 + ((body[at + 3] & 0x0F) << 8 | body[at + 4])
    return out, broken


def demux(stream: bytes, program: int | None = None, stream_pid: int | None = None) -> dict:
    """payload, stream type, packet and unit counts, continuity errors, unit timestamps, and (pts, payload offset) of the random access points of one elementary stream."""
    if len(stream) % PACKET:
        raise ValueError("a transport stream holds whole packets")
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != 0x47).any():
        raise ValueError("lost synchronisation")
    pid = (packets[:, 1] & 0x1F).astype(np.int64) << 8 | packets[:, 2]
    programs, broken = streams_of(packets, pid)
    found = [s for number, streams in programs.items() if program in (None, number) for s in streams if stream_pid in (None, s[1])]
    if not found:
        raise ValueError("no such program or stream")
    kind, data_pid = found[0]

    own = packets[(pid == data_pid) & (packets[:, 3] & 0x10 > 0)]
    if len(own) > 1:  # a packet may be sent twice
        again = np.concatenate([[False], (own[1:, 3] & 15 == own[:-1, 3] & 15) & (own[1:, 4:] == own[:-1, 4:]).all(1)])
        own = own[~again]
    counters = (own[:, 3] & 15).astype(np.int64)
    adapted = own[:, 3] & 0x20 > 0
    begin = np.where(adapted, 5 + own[:, 4].astype(np.int64), 4)
    flags = np.where(adapted & (begin > 5), own[:, 5], 0)
    errors = int((((np.diff(counters) - 1) % 16 != 0) & (flags[1:] & 0x80 == 0)).sum())
    data = own[np.arange(PACKET) >= begin[:, None]].tobytes()
    ends = np.cumsum(PACKET - begin)
    first = np.flatnonzero(own[:, 1] & 0x40)
    units, points, times, size = [], [], [], 0
    for k, i in enumerate(first):
        a, b = int(ends[i] - (PACKET - begin[i])), int(ends[first[k + 1] - 1]) if k + 1 < len(first) else len(data)
        unit = data[a:b]
        if unit[:3] != b"\x00\x00\x01":
            raise ValueError("a unit starts without its prefix")
        length, head = int.from_bytes(unit[4:6], "big"), 9 + unit[8]
        if unit[7] & 0x80:
            t = unit[9:14]
            times.append((t[0] & 0x0E) << 29 | t[1] << 22 | (t[2] & 254) << 14 | t[3] << 7 | t[4] >> 1)
            if flags[i] & 0x40:
                points.append((times[-1], size))
        units.append(unit[head : 6 + length if length else len(unit)])
        size += len(units[-1])
    return {"payload": b"".join(units), "stream_type": kind, "packets": len(packets), "units": len(units), "continuity_errors": errors, "times": times, "access_points": points, "broken_programs": broken}


def feature_of(got: dict) -> str:
    times, payload = got["times"], got["payload"]
    span = f"{times[0]}..{times[-1]}" if times else "none"
    mean = np.frombuffer(payload, np.uint8).mean() if payload else 0.0
    return f"mpegts type={got['stream_type']} packets={got['packets']} units={got['units']} continuity_errors={got['continuity_errors']} access_points={len(got['access_points'])} pts={span} mean={mean:.3f}" + (f" broken_programs={len(got['broken_programs'])}" if got["broken_programs"] else "")


def padded(text: bytes, block: int = 64) -> bytes:
    return text + b"\x00" * (max(block, -(-len(text) // block) * block) - len(text))


def mux_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the transport stream of the zero-padded text)."""

    def store(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = text_bytes(batch.column(1))
        texts = [raw[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_slices(docs.select("doc_id", "text"), "text", store, "doc_id long, n_bytes long, media binary")


ACCESS = pa.list_(pa.struct([("pts", pa.int64()), ("byte_offset", pa.int64())]))


def demux_streams(streams: DataFrame) -> DataFrame:
    """What the stored streams hold: digests of payload and stream, a feature text, and the random access points."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(2):
                media = value.as_buffer()
                got = demux(media)
                payload, points = got["payload"], got["access_points"]
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(got), [{"pts": p, "byte_offset": o} for p, o in points]))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), ACCESS]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "access_points"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", *names])

    return streams.mapInArrow(
        read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, access_points array<struct<pts: long, byte_offset: long>>"
    )
