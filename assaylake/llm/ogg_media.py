"""Media columns in the Ogg container: writer, verifying reader and features.

A payload is stored as 8-bit samples in one logical stream, beside a second stream with its
description; both are interleaved page by page. The reader verifies every page checksum, reassembles
packets from lacing values across pages, splits the logical streams by serial number and derives
times from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.session import ship_package

RATE = 8000  # samples a second
PACKET = 8000  # samples a packet: one second
ALIGN = 64
# Fixed values of the container: capture pattern, header flags, the longest lacing row.
CAPTURE, CONTINUED, FIRST, LAST, LACES = b"OggS", 1, 2, 4, 255
MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
HEADER = struct.Struct("<4sBBqIIIB")


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 04c11db7, most significant bit first, no initial or final inversion.

    It equals zlib's mirrored CRC over mirrored bytes, mirrored back, without the two inversions.
    """
    mirrored = zlib.crc32(page.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(MIRROR), "big")


def stream_pages(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """The pages of one logical stream; the first packet has the first page to itself."""
    laces, ends, body = [], {}, b"".join(packets)
    for packet, granule in zip(packets, granules, strict=True):
        laces += [255] * (len(packet) // 255) + [len(packet) % 255]
        ends[len(laces)] = granule
    first = len(packets[0]) // 255 + 1
    cuts = [0, *range(first, len(laces), LACES), len(laces)]
    pages, at = [], 0
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        granule = next((ends[i] for i in range(b, a, -1) if i in ends), -1)
        flags = (CONTINUED if a and a not in ends else 0) | (FIRST if not k else 0) | (LAST if b == len(laces) else 0)
        part = body[at : at + sum(laces[a:b])]
        at += len(part)
        head, tail = HEADER.pack(CAPTURE, 0, flags, granule, serial, k, 0, b - a), bytes(laces[a:b]) + part
        pages.append(head[:22] + struct.pack("<I", page_checksum(head + tail)) + head[26:] + tail)
    return pages


def encode(payload: bytes, n_bytes: int) -> bytes:
    """Payload as samples in one stream, its description in another, interleaved."""
    serial = zlib.crc32(payload)
    packets = [b"\x80pcm8" + struct.pack("<IQ", RATE, len(payload)), *(payload[i : i + PACKET] for i in range(0, len(payload), PACKET))]
    granules = [0, *(min(i + PACKET, len(payload)) for i in range(0, len(payload), PACKET))]
    audio = stream_pages(serial, packets, granules)
    about = stream_pages(serial ^ 0xFFFFFFFF, [b"\x80about" + struct.pack("<I", RATE), struct.pack("<QI", n_bytes, zlib.crc32(payload))], [0, len(payload)])
    body, rest = audio[1:], about[1:]
    return b"".join([audio[0], about[0], *body[:1], *rest, *body[1:]])


def read_streams(media: bytes) -> dict[int, dict]:
    """Per serial number: packets, the granule of each page's last whole packet, pages. Raises on any damage."""
    streams: dict[int, dict] = {}
    at = 0
    while at < len(media):
        capture, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        if capture != CAPTURE or version:
            raise ValueError(f"no page at byte {at}")
        laces = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(laces)
        if len(laces) < n or end > len(media):
            raise ValueError(f"the page at byte {at} is cut off")
        if page_checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            raise ValueError(f"wrong checksum of the page at byte {at}")
        s = streams.setdefault(serial, {"packets": [], "open": None, "pages": 0, "ends": [], "closed": False})
        if bool(flags & FIRST) != (s["pages"] == 0) or number != s["pages"] or s["closed"] or bool(flags & CONTINUED) != (s["open"] is not None):
            raise ValueError(f"the page at byte {at} is out of order")
        place, packet, done = at + 27 + n, s["open"] or [], 0
        for lace in laces:
            packet.append(media[place : place + lace])
            place += lace
            if lace < 255:
                s["packets"].append(b"".join(packet))
                packet, done = [], done + 1
        s["open"] = packet if laces and laces[-1] == 255 else None
        if (granule >= 0) != bool(done):
            raise ValueError(f"the granule position of the page at byte {at} doesn't fit its packets")
        s["ends"] += [granule] * bool(done)
        s["pages"] += 1
        s["closed"] = bool(flags & LAST)
        at = end
    if any(s["open"] is not None or not s["closed"] for s in streams.values()):
        raise ValueError("a stream doesn't end")
    return streams


def decode(media: bytes) -> tuple[bytes, int, int, list[float], int]:
    """Payload, unpadded bytes, rate, end time in seconds of each page of samples, pages of all streams."""
    streams = read_streams(media)
    sound = next(s for s in streams.values() if s["packets"][0].startswith(b"\x80pcm8"))
    about = next(s for s in streams.values() if s["packets"][0].startswith(b"\x80about"))
    rate, samples = struct.unpack("<IQ", sound["packets"][0][5:])
    n_bytes, crc = struct.unpack("<QI", about["packets"][1])
    payload = b"".join(sound["packets"][1:])
    if len(payload) != samples or sound["ends"][-1] != samples or zlib.crc32(payload) != crc:
        raise ValueError("the samples don't fit their description")
    return payload, n_bytes, rate, [g / rate for g in sound["ends"]], sum(s["pages"] for s in streams.values())


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media: each text's UTF-8 bytes, padded by zeros to a positive multiple of 64, as an Ogg file.

    A null text is stored as an empty one (64 zero bytes). Ids may be null or repeated; each row has
    its own file and equal texts have equal files. Other columns are ignored.
    """
    ship_package(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                raw = text or b""
                media.append(encode(raw.ljust(max(ALIGN, -(-len(raw) // ALIGN) * ALIGN), b"\0"), len(raw)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(write, f"doc_id {docs.schema[id_col].dataType.simpleString()}, media binary")


def feature(samples: np.ndarray, ends: list[float], pages: int, rate: int) -> str:
    """Duration, packet and page counts, mean, root mean square and zero crossings about the middle level."""
    level = samples.astype(np.int64) - 128
    crossings = int(np.count_nonzero((level[1:] < 0) != (level[:-1] < 0)))
    rms = (int(level @ level) / len(level)) ** 0.5
    return f"seconds={ends[-1]:.6f};rate={rate};pages={pages};mean={samples.mean():.6f};rms={rms:.6f};crossings={crossings}"


def read_features(media: DataFrame) -> DataFrame:
    """Verify and read a media column: payload_bytes, digests and features per row; a damaged file fails the job."""
    ship_package(media.sparkSession)
    made = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stored in batch.column(1).to_pylist():
                payload, n_bytes, rate, ends, pages = decode(stored)
                rows.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(np.frombuffer(payload, np.uint8), ends, pages, rate)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(made)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, made.values(), strict=True))], ["doc_id", *made])

    key = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(read, f"doc_id {key}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
