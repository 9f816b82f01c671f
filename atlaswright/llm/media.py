"""Media columns: every text stored as an audio track in a Matroska file, and read back.

``mux`` writes EBML (header, segment, info, one 8-bit PCM track, clusters of laced
simple blocks, cues); ``demux`` parses any such file again: variable-length ids and sizes,
clusters, the four kinds of lacing, and the cues that give each cluster's place, into a
table of packets with track, timestamp and byte range.

Edge cases: a null or empty text is one frame of 192 blanks; unpaired surrogates cannot
occur in Spark strings; repeated rows give repeated results; a null ``doc_id`` stays null;
an empty table gives no rows; other columns are ignored whatever their names. A file that
cannot be parsed (``demux`` raises ``ValueError``) has one row in the packet table, with the
``error``, and no payload; a null file has no packets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FRAME = 192  # bytes, which are samples
RATE = 8000  # samples a second: 24 ms a frame
LACE = 64  # frames of a block
BLOCKS = 20  # blocks of a cluster, which so lasts under 32.767 s

# Fixed values of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, TIMESTAMP_SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, TRACK_TYPE, CODEC = 0x4282, 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x83, 0x86
AUDIO, FREQUENCY, CHANNELS, BIT_DEPTH, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE1, 0xB5, 0x9F, 0x6264, 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TRACK_UID, MUXING_APP, WRITING_APP, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x73C5, 0x4D80, 0x5741, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


#: What ends an element of unknown size: nothing that could be its child.
_PARTS = frozenset({INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS})
_NAME = b"atlaswright"


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def vint(x: int, width: int = 0) -> bytes:
    """An EBML size: as many leading zero bits as bytes follow; all ones is reserved."""
    width = width or next(w for w in range(1, 9) if x < (1 << (7 * w)) - 1)
    return (x | 1 << (7 * width)).to_bytes(width, "big")


def element(name: int, body: bytes) -> bytes:
    return _id(name) + vint(len(body)) + body


def _uint(name: int, x: int) -> bytes:
    return element(name, x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big"))


def mux(payload: bytes, frame: int = FRAME, rate: int = RATE) -> bytes:
    """A Matroska file of one mono 8-bit track; ``payload`` is a multiple of ``frame``."""
    ms = frame * 1000 // rate
    frames = len(payload) // frame
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, _NAME) + element(WRITING_APP, _NAME) + element(DURATION, struct.pack(">d", frames * ms)))
    audio = element(AUDIO, element(FREQUENCY, struct.pack(">d", rate)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    at, body, cues = len(info) + len(tracks), [], []
    for first in range(0, frames, LACE * BLOCKS):
        blocks = [_uint(TIMESTAMP, first * ms)]
        for k in range(first, min(frames, first + LACE * BLOCKS), LACE):
            n = min(LACE, frames - k)
            lace = (b"\x84" + bytes([n - 1])) if n > 1 else b"\x80"  # key frame, fixed-size lacing
            blocks.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">h", (k - first) * ms) + lace + payload[k * frame : (k + n) * frame]))
        body.append(element(CLUSTER, b"".join(blocks)))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, first * ms) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        at += len(body[-1])
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    return head + element(SEGMENT, info + tracks + b"".join(body) + element(CUES, b"".join(cues)))


class Packet(NamedTuple):
    track: int
    timestamp_ms: float
    start: int
    stop: int
    key: bool


def _number(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """A variable-length number at ``at`` and where it ends; ``keep``: with its length bits."""
    first = data[at] if at < len(data) else 0
    if not first or at + 9 - first.bit_length() > len(data):
        raise ValueError(f"no variable-length number of up to 8 bytes at byte {at}")
    width = 9 - first.bit_length()
    x = int.from_bytes(data[at : at + width], "big")
    if not keep:
        x ^= 1 << (7 * width)
        if x == (1 << (7 * width)) - 1:
            x = -1  # unknown size
    return x, at + width


class Element(NamedTuple):
    name: int
    head: int
    start: int
    stop: int


def children(data: bytes, at: int, end: int) -> Iterator[Element]:
    """The elements between two places; one of unknown size lasts until an element that
    cannot be part of it (a segment's next part, or a next segment), or to the end."""
    while at < end:
        head = at
        name, at = _number(data, at, True)
        size, at = _number(data, at, False)
        stop = at + size if size >= 0 else _unknown(data, at, end, name)
        if stop > end:
            raise ValueError(f"element {name:#x} at byte {head} ends after its parent")
        yield Element(name, head, at, stop)
        at = stop


def _unknown(data: bytes, at: int, end: int, name: int) -> int:
    """Where an element of unknown size whose children start at ``at`` ends."""
    ends = frozenset({EBML, SEGMENT}) | (frozenset() if name == SEGMENT else _PARTS)
    while at < end:
        child, then = _number(data, at, True)
        if child in ends:
            return at
        size, then = _number(data, then, False)
        at = then + size if size >= 0 else _unknown(data, then, end, child)
    return end


def laced(data: bytes, at: int, stop: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block whose lacing head, if any, is at ``at``."""
    if kind == NO_LACING:
        return [(at, stop)]
    n, at = data[at] + 1, at + 1
    if kind == FIXED:
        each, over = divmod(stop - at, n)
        if over:
            raise ValueError(f"{stop - at} bytes do not make {n} frames of one size")
        return [(at + k * each, at + (k + 1) * each) for k in range(n)]
    sizes: list[int] = []
    for k in range(n - 1):
        if kind == XIPH:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:  # the first size, then signed differences
            before = at
            x, at = _number(data, at, False)
            size = x if not k else sizes[-1] + x - ((1 << (7 * (at - before) - 1)) - 1)
        sizes.append(size)
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    if at > stop or min(sizes, default=0) < 0:
        raise ValueError(f"frames of {sizes} bytes do not fit their block")
    return [*out, (at, stop)]


def _value(data: bytes, e: Element) -> int:
    return int.from_bytes(data[e.start : e.stop], "big")


def _track(data: bytes, entry: Element) -> tuple[int, dict]:
    parts = {e.name: e for e in children(data, entry.start, entry.stop)}
    sound = {e.name: e for e in children(data, parts[AUDIO].start, parts[AUDIO].stop)} if AUDIO in parts else {}
    rate = sound.get(FREQUENCY)
    return _value(data, parts[TRACK_NUMBER]), {
        "codec": data[parts[CODEC].start : parts[CODEC].stop].decode(),
        "rate": struct.unpack(">d" if rate.stop - rate.start == 8 else ">f", data[rate.start : rate.stop])[0] if rate else 8000.0,
        "bits": _value(data, sound[BIT_DEPTH]) if BIT_DEPTH in sound else 0,
        "channels": _value(data, sound[CHANNELS]) if CHANNELS in sound else 1,
    }


def _packets(data: bytes, cluster: Element, tracks: dict[int, dict], scale: int) -> Iterator[Packet]:
    base = 0
    for e in children(data, cluster.start, cluster.stop):
        if e.name == TIMESTAMP:
            base = _value(data, e)
        blocks = [e] if e.name == SIMPLE_BLOCK else [x for x in children(data, e.start, e.stop) if x.name == BLOCK] if e.name == BLOCK_GROUP else []
        for block in blocks:
            track, at = _number(data, block.start, False)
            (ticks,), flags = struct.unpack_from(">h", data, at), data[at + 2]
            about = tracks.get(track, {})
            time, each = (base + ticks) * scale / 1e6, 8e3 / (about.get("rate") or 8e3) / (about.get("bits") or 8) / about.get("channels", 1)
            for start, stop in laced(data, at + 3, block.stop, flags >> 1 & 3):
                yield Packet(track, time, start, stop, bool(flags & 0x80) and block.name == SIMPLE_BLOCK)
                time += (stop - start) * each


def demux(data: bytes) -> tuple[dict[int, dict], list[Packet]]:
    """Tracks by number, and the packets in the order of the cues (clusters that no cue
    names follow as they lie)."""
    tracks: dict[int, dict] = {}
    packets: list[Packet] = []
    for segment in children(data, 0, len(data)):
        if segment.name != SEGMENT:
            continue
        scale, clusters, cued = 1_000_000, {}, {}
        for part in children(data, segment.start, segment.stop):
            inner = () if part.name == CLUSTER else children(data, part.start, part.stop)
            if part.name == CLUSTER:
                clusters[part.head - segment.start] = part  # as cues count
            elif part.name == INFO:
                scale = next((_value(data, e) for e in inner if e.name == TIMESTAMP_SCALE), scale)
            elif part.name == TRACKS:
                tracks |= dict(_track(data, e) for e in inner if e.name == TRACK_ENTRY)
            elif part.name == CUES:
                for point in inner:
                    for place in children(data, point.start, point.stop):
                        if place.name == CUE_POSITIONS:
                            cued |= {_value(data, e): None for e in children(data, place.start, place.stop) if e.name == CUE_CLUSTER}
        for at in [*(c for c in cued if c in clusters), *(c for c in clusters if c not in cued)]:
            packets += _packets(data, clusters[at], tracks, scale)
    return tracks, packets


def _read(data: bytes) -> tuple[dict[int, dict], list[Packet], str | None]:
    """What ``demux`` gives, or nothing and the error of a damaged file."""
    try:
        return *demux(data), None
    except (ValueError, IndexError, KeyError, struct.error) as e:
        return {}, [], f"{type(e).__name__}: {e}"


def payload_of(text: str | None, frame: int = FRAME) -> tuple[bytes, int]:
    """The text's UTF-8, filled up with blanks to a positive multiple of ``frame``, and its own length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % frame or (0 if raw else frame)), len(raw)


def features(tracks: dict[int, dict], packets: list[Packet], samples: bytes) -> str:
    """Packets, length in milliseconds, and mean, loudness, roughness and spread of the 8-bit samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    size = max(1, len(x))
    steps = np.abs(np.diff(x)).sum() if len(x) > 1 else 0
    rate = next((t["rate"] for t in tracks.values()), RATE)
    return (
        f"tracks={len(tracks)};packets={len(packets)};ms={round(1000 * len(x) / rate)};mean={x.sum() / size:.4f};"
        f"rms={np.sqrt((x * x).sum() / size):.4f};step={steps / size:.4f};distinct={np.count_nonzero(np.bincount(x, minlength=256))}"
    )


def _mapped(docs: DataFrame, columns: list[str], schema: str, run) -> DataFrame:
    """``run(rows)`` gives a row for each of ``columns``' rows or several; a batch goes out per batch in."""
    names = [c.rsplit(" ", 1)[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[c.rsplit(" ", 1)[1]] for c in schema.split(", ")]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # media are as large again as texts
                part = batch.slice(at, 256)
                rows = [out for row in zip(*(c.to_pylist() for c in part.columns), strict=True) for out in run(*row)]
                cells = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names)

    return docs.select(*columns).mapInArrow(mapped, schema)


def media(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, n_bytes, media)``: each text's Matroska file."""

    def run(doc_id, text):
        payload, n = payload_of(text)
        yield doc_id, n, mux(payload)

    return _mapped(docs, ["doc_id", "text"], "doc_id long, n_bytes long, media binary", run)


def packets(files: DataFrame) -> DataFrame:
    """The packet table of ``files(doc_id, media)``: one row per frame, with its byte range in the file."""

    def run(doc_id, data):
        _, found, error = _read(data) if data else ({}, [], None)
        for k, p in enumerate(found):
            yield doc_id, k, p.track, p.timestamp_ms, p.start, p.stop, p.key, None
        if error:
            yield doc_id, None, None, None, None, None, None, error

    return _mapped(files, ["doc_id", "media"], "doc_id long, packet int, track int, timestamp_ms double, start long, stop long, key boolean, error string", run)


def digests(files: DataFrame) -> DataFrame:
    """Per file of ``files(doc_id, n_bytes, media)``: what reading its packets back gives."""

    def run(doc_id, n, data):
        tracks, found, error = _read(data)
        got = b"".join([data[p.start : p.stop] for p in found])
        yield doc_id, n, len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-16:]), len(data), hashlib.sha256(data).hexdigest(), error or features(tracks, found, got)

    return _mapped(files, ["doc_id", "n_bytes", "media"], "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", run)
