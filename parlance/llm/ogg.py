"""Media columns as Ogg: writing and reading pages, packets and logical streams.

The container follows RFC 3533: pages with a checksum (CRC-32 of polynomial 0x04C11DB7, not reflected, no
inversion), a segment table whose lacing values give packet lengths (a value below 255 ends a packet), serial numbers that tell
interleaved logical streams apart, and granule positions from which times follow.

A payload is stored as 8-bit unsigned samples in a PCM stream (an identification packet with format, rate and
channels, then packets of samples); a second stream holds the CRC-32 of each of these packets. A reader verifies
page checksums, page order, packet checksums and the final granule position.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import textops
from parlance.runtime import ship

RATE, CHANNELS, PACKET, BLOCK = 8000, 1, 4096, 64
CONTINUED, FIRST, LAST = 1, 2, 4
_HEADER = struct.Struct("<4sBBqIIIB")
_PCM = struct.Struct("<8sHHIIBBHI")
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """The bytes are no intact Ogg file."""


def checksum(page: bytes) -> int:
    """The page checksum: zlib's CRC-32 has the same polynomial over mirrored bits, so bytes and result are mirrored."""
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "big").translate(_MIRROR), "little")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def pages(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[tuple[int, bytes]]:
    """(granule, page) of one logical stream of (packet, granule position at its end); the first packet has its own page.

    A packet may go on over pages; a page on which no packet ends has granule position -1.
    """
    number, flags = 0, FIRST
    lacing, body, granule = bytearray(), [], -1
    last = len(packets) - 1
    for k, (packet, end) in enumerate(packets):
        at, lengths = 0, len(packet) // 255 + 1
        while lengths:
            room = min(255 - len(lacing), lengths)
            take = packet[at : at + 255 * room]
            whole = room == lengths
            lacing += b"\xff" * (room - whole) + (bytes([len(packet) % 255]) if whole else b"")
            body.append(take)
            at, lengths = at + len(take), lengths - room
            granule = end if whole else granule
            if len(lacing) == 255 or (whole and k in (0, last)):
                yield granule, page(flags | (LAST if whole and k == last else 0), granule, serial, number, bytes(lacing), b"".join(body))
                number, flags = number + 1, 0 if whole else CONTINUED
                lacing, body, granule = bytearray(), [], -1


def multiplex(streams: list[tuple[int, list[tuple[bytes, int]]]]) -> bytes:
    """One file of several (serial, packets): all first pages, then the streams' pages in turn."""
    rest = [iter(pages(serial, packets)) for serial, packets in streams]
    out = [next(x)[1] for x in rest]
    while rest:
        for x in list(rest):
            found = next(x, None)
            if found is None:
                rest.remove(x)
            else:
                out.append(found[1])
    return b"".join(out)


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    #: Granule position of the page on which each packet ends, for the last such packet of a page; else None.
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    _open: list[bytes] = field(default_factory=list)


def demultiplex(data: bytes) -> dict[int, Stream]:
    """The logical streams by serial number; OggError for anything that isn't intact."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < _HEADER.size:
            raise OggError("cut off in a page header")
        magic, version, flags, granule, serial, number, crc, n = _HEADER.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        start = at + _HEADER.size
        lacing = data[start : start + n]
        end = start + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError("cut off in a page")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"bad checksum of the page at byte {at}")
        if flags & FIRST:
            if serial in streams:
                raise OggError("serial number used twice")
            streams[serial] = Stream()
        stream = streams.get(serial)
        if stream is None or stream.ended or number != stream.pages or bool(flags & CONTINUED) != bool(stream._open):
            raise OggError(f"page {number} of stream {serial} is out of order")
        where, ends = start + n, 0
        run = 0
        for value in lacing:
            run += value
            if value < 255:
                stream._open.append(data[where : where + run])
                stream.packets.append(b"".join(stream._open))
                stream.granules.append(None)
                stream._open.clear()
                where, run, ends = where + run, 0, ends + 1
        if run:
            stream._open.append(data[where : where + run])
        if (granule == -1) != (ends == 0):
            raise OggError("granule position does not agree with the packets")
        if ends:
            stream.granules[-1] = granule
        stream.pages += 1
        stream.ended = bool(flags & LAST)
        at = end
    if any(not s.ended or s._open for s in streams.values()):
        raise OggError("a stream does not end")
    return streams


def store(payload: bytes, rate: int = RATE) -> bytes:
    """payload as an Ogg file: a PCM stream of 8-bit samples and a stream of packet checksums. Depends on nothing but the payload."""
    serial = zlib.crc32(payload)
    cuts = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    head = _PCM.pack(b"PCM     ", 0, 0, 1, rate, 8, CHANNELS, PACKET, 0)
    samples, done = [(head, 0)], 0
    for cut in cuts:
        done += len(cut) // CHANNELS
        samples.append((cut, done))
    sums = struct.pack(f"<{len(cuts)}I", *map(zlib.crc32, cuts))
    return multiplex([(serial, samples), (serial ^ 0xFFFFFFFF, [(b"PCMCRC32", 0), (sums, done)])])


@dataclass
class Media:
    payload: bytes
    rate: int
    channels: int
    packets: int
    pages: int
    #: Seconds at the end of each page of samples.
    times: list[float]


def load(data: bytes) -> Media:
    """The stored payload, checked at every level."""
    streams = demultiplex(data)
    sound = next((s for s in streams.values() if s.packets and s.packets[0].startswith(b"PCM     ")), None)
    sums = next((s for s in streams.values() if s.packets and s.packets[0] == b"PCMCRC32"), None)
    if sound is None or sums is None:
        raise OggError("no PCM stream, or none of checksums")
    _, _, _, kind, rate, bits, channels, _, extra = _PCM.unpack(sound.packets[0])
    if kind != 1 or bits != 8:
        raise OggError("not unsigned 8-bit samples")
    cuts = sound.packets[1 + extra :]
    if b"".join(sums.packets[1:]) != struct.pack(f"<{len(cuts)}I", *map(zlib.crc32, cuts)):
        raise OggError("a packet differs from its checksum")
    payload = b"".join(cuts)
    ends = [g for g in sound.granules[1 + extra :] if g is not None]
    if not ends or ends[-1] != len(payload) // channels:
        raise OggError("the last granule position is not the number of samples")
    return Media(payload, rate, channels, len(cuts), sum(s.pages for s in streams.values()), [g / rate for g in ends])


def feature(media: Media) -> str:
    """What is told of a medium: its form, its duration from the granule positions, and statistics of its samples."""
    x = np.frombuffer(media.payload, dtype=np.uint8)
    total, square = int(x.sum(dtype=np.int64)), int(np.dot(x.astype(np.float64), x))
    return f"rate={media.rate};channels={media.channels};packets={media.packets};pages={media.pages};ms={round(media.times[-1] * 1000)};mean={total / len(x):.4f};rms={(square / len(x)) ** 0.5:.4f};peak={int(x.max())}"


def padded(text: bytes) -> bytes:
    """text and bytes 0 up to a positive multiple of BLOCK."""
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


def row(text: bytes) -> tuple:
    media = store(padded(text))
    found = load(media)
    return len(text), len(found.payload), hashlib.sha256(found.payload).hexdigest(), zlib.crc32(found.payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(found), media


def writer(with_media: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            data, offsets = textops.utf8(batch.column("text"))
            for i, j in textops.chunks(offsets):
                rows = [row(data[a:b].tobytes()) for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist())]
                columns = [batch.column("doc_id")[i:j], *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))]
                if with_media:
                    columns.append(pa.array([r[7] for r in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names] + ["media"] * with_media)

    return run


def media_columns(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; with_media: also media, the file.

    The payload is the text's UTF-8, padded (a null text counts as empty: 64 bytes 0); the digests are of what is read
    back from the stored form. Equal texts give equal values, whatever their doc_id; a null doc_id stays null.
    A very long text is stored whole, by one task. An empty table gives an empty result. Other columns are not read.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(writer(with_media), schema)
