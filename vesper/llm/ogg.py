"""Ogg: pages with checksums, packets from lacing values, interleaved logical streams, times from granules.

``mux`` writes packets of several logical streams as one physical stream; ``demux`` verifies every
page's checksum, puts packets together across segments and pages, separates the streams by serial
number and turns granule positions into times. ``store`` keeps bytes losslessly as 8-bit samples in
such a stream; ``load`` gets them back.

Defined results: empty input to ``store`` is an empty sample stream; null bytes give null. ``demux``
of damaged bytes never fails: pages whose checksum is wrong, and the packets that they cut, are left
out and counted, and reading goes on at the next capture pattern.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1

SAMPLES_SERIAL, NOTES_SERIAL = 1, 2
RATE = 8000
PACKET = 4000
PACKETS_A_PAGE = 15

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(data: bytes) -> int:
    """CRC with polynomial 0x04C11DB7, most significant bit first, register and output unchanged.

    It is the mirrored zlib CRC of mirrored bytes, so that the library's fast code does the work.
    """
    raw = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "big").translate(_REVERSED), "little")


def lacing(size: int) -> bytes:
    """Segment sizes of a packet: 255 again and again, then one below 255 that ends it."""
    return b"\xff" * (size // 255) + bytes([size % 255])


@dataclass
class Stream:
    """A logical stream read back."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of each page that ends a packet
    begun: bool = False
    ended: bool = False
    pages: int = 0
    expected: int = 0
    gaps: int = 0
    open: list[bytes] | None = None

    def seconds(self, rate: int) -> float:
        """The time at the stream's end: its last granule position over the granules a second."""
        return self.granules[-1] / rate if self.granules else 0.0


@dataclass
class Physical:
    streams: dict[int, Stream]
    pages: int
    damaged: int


def page(serial: int, number: int, flags: int, granule: int, laces: bytes, body: bytes) -> bytes:
    head = bytearray(HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(laces)))
    head += laces
    head += body
    head[22:26] = checksum(bytes(head)).to_bytes(4, "little")
    return bytes(head)


def pages_of(serial: int, packets: list[bytes], granules: list[int], per_page: int = PACKETS_A_PAGE) -> list[bytes]:
    """Pages of one logical stream; the first packet has a page of its own. Packets may span pages."""
    out: list[bytes] = []
    laces, body, ended, open_before, held = bytearray(), bytearray(), NO_GRANULE, False, 0

    def close(final: bool) -> None:
        nonlocal laces, body, ended, open_before, held
        flags = CONTINUED * open_before + FIRST * (not out) + LAST * final
        out.append(page(serial, len(out), flags, ended, bytes(laces), bytes(body)))
        open_before = bool(laces) and laces[-1] == 255
        laces, body, ended, held = bytearray(), bytearray(), NO_GRANULE, 0

    for i, (packet, granule) in enumerate(zip(packets, granules)):
        sizes, at = lacing(len(packet)), 0
        while sizes:
            room = 255 - len(laces)
            part, sizes = sizes[:room], sizes[room:]
            laces += part
            n = sum(part)
            body += packet[at : at + n]
            at += n
            if sizes:
                close(False)
        ended, held = granule, held + 1
        if i + 1 == len(packets) or i == 0 or held == per_page or len(laces) == 255:
            close(i + 1 == len(packets))
    return out


def mux(streams: dict[int, tuple[list[bytes], list[int]]]) -> bytes:
    """One physical stream: all first pages, then the others in turn."""
    queues = [pages_of(serial, *got) for serial, got in streams.items()]
    out = [q.pop(0) for q in queues if q]
    while any(queues):
        out += [q.pop(0) for q in queues if q]
    return b"".join(out)


def demux(data: bytes) -> Physical:
    found, streams, damaged, at = 0, {}, 0, 0
    while (at := data.find(CAPTURE, at)) >= 0:
        if at + HEADER.size > len(data):
            damaged += 1
            break
        _, version, flags, granule, serial, number, stated, count = HEADER.unpack_from(data, at)
        start = at + HEADER.size
        laces = data[start : start + count]
        end = start + count + sum(laces)
        whole = data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]
        if version or len(laces) < count or end > len(data) or checksum(whole) != stated:
            damaged += 1
            at += len(CAPTURE)
            continue
        found += 1
        stream = streams.setdefault(serial, Stream())
        _take(stream, flags, granule, number, laces, data[start + count : end])
        at = end
    return Physical(streams, found, damaged)


def _take(stream: Stream, flags: int, granule: int, number: int, laces: bytes, body: bytes) -> None:
    if number != stream.expected:
        stream.gaps += 1
        stream.open = None
    stream.expected, stream.pages = number + 1, stream.pages + 1
    stream.begun |= bool(flags & FIRST)
    stream.ended |= bool(flags & LAST)
    if not flags & CONTINUED:
        stream.open = None
    skip = bool(flags & CONTINUED) and stream.open is None  # its beginning is lost
    at, size, done = 0, 0, False
    for lace in laces:
        size += lace
        if lace == 255:
            continue
        part = body[at : at + size]
        if not skip:
            stream.packets.append(b"".join([*(stream.open or []), part]))
        at, size, stream.open, skip, done = at + size, 0, None, False, True
    if laces and laces[-1] == 255 and not skip:
        stream.open = [*(stream.open or []), body[at:]]
    if done and granule != NO_GRANULE:
        stream.granules.append(granule)


def store(payload: bytes, note: bytes = b"") -> bytes:
    """The payload as unsigned 8-bit mono samples in one stream, a note in a second one."""
    head = b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, 1, RATE, 8, 1, PACKET, 0)
    parts = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    granules = [min(len(payload), PACKET * (i + 1)) for i in range(len(parts))]
    return mux({SAMPLES_SERIAL: ([head, *parts], [0, *granules]), NOTES_SERIAL: ([b"NOTE" + note], [0])})


def load(media: bytes) -> tuple[bytes, Physical]:
    """The samples of ``store``, and what was read."""
    got = demux(media)
    stream = got.streams.get(SAMPLES_SERIAL, Stream())
    return b"".join(stream.packets[1:]), got


READ = T.StructType(
    [
        T.StructField("payload", T.BinaryType()),
        T.StructField("note", T.BinaryType()),
        T.StructField("pages", T.LongType()),
        T.StructField("damaged", T.LongType()),
        T.StructField("streams", T.LongType()),
        T.StructField("packets", T.LongType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("rms", T.DoubleType()),
        T.StructField("crossings", T.LongType()),
    ]
)


def _features(payload: bytes) -> tuple[float, float, int]:
    """Mean, root mean square and crossings of the middle, of the samples as signed values."""
    import numpy as np

    if not payload:
        return 0.0, 0.0, 0
    total = squares = crossings = 0
    last = None
    for i in range(0, len(payload), 1 << 20):
        x = np.frombuffer(payload, dtype=np.uint8, offset=i, count=min(1 << 20, len(payload) - i)).astype(np.int32) - 128
        total, squares = total + int(x.sum()), squares + int((x * x).sum())
        sign = x >= 0
        crossings += int((sign[1:] != sign[:-1]).sum()) + int(last is not None and bool(sign[0]) != last)
        last = bool(sign[-1])
    return total / len(payload), (squares / len(payload)) ** 0.5, crossings


def encode(df: DataFrame, payload: Column, output: str = "media", note: Column | None = None) -> DataFrame:
    """Add ``output``: the payload column stored as Ogg; null where the payload is null."""
    from pyspark.sql.functions import arrow_udf

    def put(data: pa.Array, notes: pa.Array) -> pa.Array:
        return pa.array([None if x is None else store(x, y or b"") for x, y in zip(data.to_pylist(), notes.to_pylist())], pa.binary())

    put.__annotations__ = {"data": pa.Array, "notes": pa.Array, "return": pa.Array}
    return df.withColumn(output, arrow_udf(put, T.BinaryType())(payload, note if note is not None else F.lit(b"")))


def decode(df: DataFrame, media: Column, output: str = "read") -> DataFrame:
    """Add the struct ``output`` of READ's fields: what the Ogg bytes hold; null where they are null."""
    from pyspark.sql.functions import arrow_udf

    def one(data: bytes) -> dict:
        payload, got = load(data)
        mean, rms, crossings = _features(payload)
        note = got.streams.get(NOTES_SERIAL, Stream()).packets[:1]
        samples = got.streams.get(SAMPLES_SERIAL, Stream())
        return {"payload": payload, "note": note[0][4:] if note else None, "pages": got.pages, "damaged": got.damaged, "streams": len(got.streams), "packets": sum(len(s.packets) for s in got.streams.values()), "seconds": samples.seconds(RATE), "mean": mean, "rms": rms, "crossings": crossings}

    kind = pa.struct([("payload", pa.binary()), ("note", pa.binary()), *[(n, pa.int64()) for n in ("pages", "damaged", "streams", "packets")], ("seconds", pa.float64()), ("mean", pa.float64()), ("rms", pa.float64()), ("crossings", pa.int64())])

    def get(data: pa.Array) -> pa.Array:
        return pa.array([None if x is None else one(x) for x in data.to_pylist()], kind)

    get.__annotations__ = {"data": pa.Array, "return": pa.Array}
    return df.withColumn(output, arrow_udf(get, READ)(media))
