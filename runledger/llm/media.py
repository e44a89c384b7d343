"""Media columns: payloads stored in and read from Ogg containers (RFC 3533).

`encode` stores a payload as unsigned 8-bit samples: one logical stream of sample packets, multiplexed page by page
with a second one that describes the file. `decode` verifies every page's checksum, reassembles packets from lacing
values (over page borders too), demultiplexes the logical streams by serial number and derives packet times from
granule positions. Serial numbers come from the payload, so equal payloads give equal files.

Defined results: null and empty texts are a payload of 64 zero bytes; repeated rows give repeated rows; a broken
file (lost bytes, wrong checksum, missing page or unfinished packet) raises ValueError in `decode`; an empty table
gives no rows; other columns are ignored. One value is handled at a time; batches are cut by size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

RATE = 8000
PACKET = 16_000
ALIGN = 64
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")


def page_checksum(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 0x04c11db7, not reflected, from 0): zlib's reflected one over reversed bits."""
    r = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(r.to_bytes(4, "little").translate(_REVERSED), "big")


def write_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """The pages of one logical stream; packets with the granule position at which each ends.

    The first packet has a page of its own, as the format asks. A page holds at most 255 lacing values."""
    segments: list[tuple[int, int, bool]] = []  # packet, length, ends the packet
    for k, (data, _) in enumerate(packets):
        segments += [(k, 255, False)] * (len(data) // 255) + [(k, len(data) % 255, True)]
    first = len(packets[0][0]) // 255 + 1
    cuts = [0, *range(min(first, 255), len(segments), 255), len(segments)]
    pages, offset = [], [0] * len(packets)
    for seq, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part, granule, body = segments[a:b], -1, []
        lacing = bytes(n for _, n, _ in part)
        at = a
        while at < b:  # whole runs of a packet at once
            k, to, size = segments[at][0], at, 0
            while to < b and segments[to][0] == k:
                size += segments[to][1]
                to += 1
            body.append(packets[k][0][offset[k] : offset[k] + size])
            offset[k] += size
            if segments[to - 1][2]:
                granule = packets[k][1]
            at = to
        kind = (1 if a and not segments[a - 1][2] else 0) | (2 if seq == 0 else 0) | (4 if b == len(segments) else 0)
        page = b"".join([_HEAD.pack(b"OggS", 0, kind, granule, serial, seq, 0, len(part)), lacing, *body])
        pages.append(page[:22] + page_checksum(page).to_bytes(4, "little") + page[26:])
    return pages


def encode(payload: bytes, note: bytes = b"") -> bytes:
    """An Ogg file with the payload as 8-bit samples and a note; without payload only the headers."""
    serial = zlib.crc32(payload) & 0xFFFFFFFE
    sound: list[tuple[bytes, int]] = [(b"PCM8u\0" + struct.pack("<IQ", RATE, len(payload)), 0)]
    sound += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    a, b = write_pages(serial, sound), write_pages(serial | 1, [(b"note\0", 0), (note, len(payload))])
    return b"".join([a[0], b[0], *(p for i in range(1, max(len(a), len(b))) for p in a[i : i + 1] + b[i : i + 1])])


@dataclass
class Stream:
    """packets: data, start and end granule position."""
    serial: int
    packets: list[tuple[bytes, int, int]] = field(default_factory=list)
    ended: bool = False
    _held: list[bytes] = field(default_factory=list)
    _next: int = 0
    _at: int = 0


def decode(data: bytes) -> list[Stream]:
    """The logical streams, in order of their first pages."""
    streams: dict[int, Stream] = {}
    view, at = memoryview(data), 0
    while at < len(data):
        if len(data) - at < 27:
            raise ValueError("page cut off")
        magic, version, kind, granule, serial, seq, crc, n = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at {at}")
        lacing = data[at + 27 : at + 27 + n]
        start = at + 27 + n
        end = start + sum(lacing)
        if end > len(data) or len(lacing) < n:
            raise ValueError("page cut off")
        if page_checksum(b"".join((view[at : at + 22], b"\0\0\0\0", view[at + 26 : end]))) != crc:
            raise ValueError(f"checksum of the page at {at}")
        if kind & 2:
            if serial in streams:
                raise ValueError("stream begins twice")
            streams[serial] = Stream(serial)
        s = streams.get(serial)
        if s is None or s.ended or s._next != seq or bool(kind & 1) != bool(s._held):
            raise ValueError(f"page {seq} of stream {serial} doesn't follow")
        s._next, s.ended = seq + 1, bool(kind & 4)
        done: list[bytes] = []
        for size in lacing:
            s._held.append(view[start : start + size])
            start += size
            if size < 255:
                done.append(b"".join(s._held))
                s._held = []
        ends = granule
        times = []
        for p in reversed(done):  # the granule position is that of the last packet that ends on the page
            length = len(p) if len(s.packets) + len(done) > 1 and granule > 0 else 0
            times.append((max(0, ends - length), ends))
            ends -= length
        s.packets += [(p, *t) for p, t in zip(done, reversed(times), strict=True)]
        at = end
    for s in streams.values():
        if s._held or not s.ended:
            raise ValueError(f"stream {s.serial} has no end")
    return list(streams.values())


def samples(data: bytes) -> tuple[bytes, bytes, float]:
    """Payload, note and seconds of a file that `encode` made."""
    sound, note = decode(data)
    rate, size = struct.unpack_from("<IQ", sound.packets[0][0], 6)
    payload = b"".join(p for p, _, _ in sound.packets[1:])
    if len(payload) != size:
        raise ValueError("samples are missing")
    return payload, note.packets[1][0], sound.packets[-1][2] / rate


def features(payload: bytes, seconds: float) -> str:
    """Duration, mean, deviation, zero-crossing rate and the entropy of the samples."""
    x = np.frombuffer(payload, np.uint8)
    if not x.size:
        return f"{seconds:.6f}|0|0|0|0"
    h = np.bincount(x, minlength=256)
    p = h[h > 0] / x.size
    values = np.arange(256)
    mean = float(h @ values) / x.size
    dev = max(0.0, float(h @ (values * values)) / x.size - mean * mean) ** 0.5
    cross = float(np.count_nonzero(np.diff(x > mean))) / x.size
    return f"{seconds:.6f}|{mean:.6f}|{dev:.6f}|{cross:.6f}|{float(-(p * np.log2(p)).sum()):.6f}"


def pad(text: bytes) -> bytes:
    return text + bytes(max(ALIGN, -(-len(text) // ALIGN) * ALIGN) - len(text))


SCHEMA = ("{id} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
          "media_sha256 string, feature string")


def media_column(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with a binary column: each text's payload as an Ogg file."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    @F.pandas_udf(T.BinaryType())
    def to_ogg(texts):
        return texts.map(lambda t: encode(pad(b := (t or "").encode()), str(len(b)).encode()))

    return df.withColumn(media, to_ogg(F.col(text)))


def media_digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each text as a file, reads the stored bytes back and computes sizes, digests and features from them."""

    def run(batches):
        for part in slices(batches, 8 << 20):
            out = []
            for doc, text_ in zip(part[0].to_pylist(), part[1], strict=True):
                buf = text_.as_buffer() if text_.is_valid else None
                raw = buf.to_pybytes() if buf is not None else b""
                stored = encode(pad(raw), str(len(raw)).encode())
                payload, note, seconds = samples(stored)
                out.append((doc, int(note), len(payload), hashlib.sha256(payload).hexdigest(),
                            zlib.crc32(payload[-ALIGN:]), len(stored), hashlib.sha256(stored).hexdigest(),
                            features(payload, seconds)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return df.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"cast(`{text}` as string) text").mapInArrow(run, SCHEMA.format(id="doc_id"))
