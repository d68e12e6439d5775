"""Matroska: muxing bytes into EBML clusters and reading packet tables back.

``mux`` stores a byte payload as 8-bit PCM samples on one audio track; ``parse``
reads any element tree of the kind (known and unknown sizes, SimpleBlocks and
BlockGroups, all three lacings, cues) and returns one row per frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, texts

# Element ids of the container format.
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0x2AD7B1, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285

_PARENTS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
#: Elements that end a cluster of unknown size.
_TOP = {CLUSTER, CUES, INFO, TRACKS, SEGMENT, EBML}

SAMPLE_RATE = 8000
FRAME_BYTES = 512
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 16


def write_size(value: int, width: int = 0) -> bytes:
    """A variable-length size; all ones are reserved for the unknown size."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def read_size(data, at: int) -> tuple[int | None, int]:
    """Value (None: unknown) and the position behind it."""
    first = data[at]
    if not first:
        raise ValueError(f"bad variable-length size at byte {at}")
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise ValueError("size runs past the end")
    value = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def read_id(data, at: int) -> tuple[int, int]:
    width = 9 - data[at].bit_length()
    if width > 4:
        raise ValueError(f"bad element id at byte {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + write_size(len(body)) + body


def unsigned(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], mode: str) -> tuple[int, bytes]:
    """Lacing flag bits and the body: "none", "xiph", "ebml" or "fixed"."""
    if mode == "none":
        return 0, frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if mode == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
        return 0x02, head + b"".join(frames)
    if mode == "fixed":
        return 0x04, head + b"".join(frames)
    head += write_size(sizes[0])
    for before, now in zip(sizes, sizes[1:-1]):
        width = next(w for w in range(1, 9) if abs(now - before) < (1 << 7 * w - 1) - 1)
        head += write_size(now - before + (1 << 7 * width - 1) - 1, width)
    return 0x06, head + b"".join(frames)


def unlace(data, at: int, end: int, flags: int) -> list[tuple[int, int]]:
    """Byte ranges (start, end) of the frames of one block body."""
    mode = flags & 0x06
    if not mode:
        return [(at, end)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if mode == 0x02:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
            sizes.append(n)
    elif mode == 0x04:
        sizes = [(end - at) // count] * (count - 1)
    elif count > 1:
        first, at = read_size(data, at)
        sizes.append(first or 0)
        for _ in range(count - 2):
            before = at
            value, at = read_size(data, at)
            width = at - before
            value = (1 << 7 * width) - 1 if value is None else value
            sizes.append(sizes[-1] + value - ((1 << 7 * width - 1) - 1))
    ranges = []
    for n in [*sizes, end - at - sum(sizes)]:
        if n < 0 or at + n > end:
            raise ValueError("a lace runs past its block")
        ranges.append((at, at + n))
        at += n
    return ranges


def mux(payload: bytes) -> bytes:
    """A complete file: header, track, clusters of laced blocks, and cues."""
    head = element(EBML, element(DOC_TYPE, b"matroska") + unsigned(DOC_TYPE_VERSION, 4) + unsigned(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000))
    audio = element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + unsigned(CHANNELS, 1) + unsigned(DEPTH, 8))
    track = element(TRACKS, element(TRACK, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    frames = [payload[i : i + FRAME_BYTES] for i in range(0, len(payload), FRAME_BYTES)]
    clusters, cues, at = [], [], len(info) + len(track)
    per = FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for first in range(0, len(frames), per):
        began = first * FRAME_BYTES * 1000 // SAMPLE_RATE
        body = [unsigned(TIMESTAMP, began)]
        for i in range(first, min(first + per, len(frames)), FRAMES_PER_BLOCK):
            group = frames[i : i + FRAMES_PER_BLOCK]
            equal = len({len(f) for f in group}) == 1
            mode = "none" if len(group) == 1 else "fixed" if equal else "ebml"
            flags, laced = lace(group, mode)
            time = i * FRAME_BYTES * 1000 // SAMPLE_RATE - began
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", time, 0x80 | flags) + laced))
        clusters.append(element(CLUSTER, b"".join(body)))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, began) + element(CUE_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, at))))
        at += len(clusters[-1])
    return head + element(SEGMENT, info + track + b"".join(clusters) + element(CUES, b"".join(cues)))


@dataclass
class Packets:
    """Packet table of one file: (track, timestamp_ns, start, end, keyframe, lacing, cluster) and its cues."""

    rows: list[tuple[int, int, int, int, bool, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    scale: int = 1_000_000
    segment: int = 0
    clusters: list[int] = field(default_factory=list)


def parse(data: bytes) -> Packets:
    """Read every element; raises ValueError where the structure is broken."""
    out = Packets()
    state = {"time": 0, "track": {}, "cue": {}}

    def block(at: int, end: int, simple: bool) -> None:
        track, at = read_size(data, at)
        if at + 3 > end:
            raise ValueError("a block is too short")
        offset, flags = struct.unpack_from(">hB", data, at)
        stamp = (state["time"] + offset) * out.scale
        for start, stop in unlace(data, at + 3, end, flags):
            out.rows.append((track, stamp, start, stop, bool(flags & 0x80) if simple else True, flags >> 1 & 3, len(out.clusters) - 1))

    def walk(at: int, end: int, parent: int) -> int:
        while at < end:
            begin = at
            kind, at = read_id(data, at)
            if parent == CLUSTER and kind in _TOP:
                return begin
            size, at = read_size(data, at)
            stop = end if size is None else at + size
            if stop > end:
                raise ValueError(f"element {kind:x} runs past its parent")
            if kind == SEGMENT:
                out.segment = at
            if kind == CLUSTER:
                out.clusters.append(begin - out.segment)
            if kind in _PARENTS:
                if kind in (TRACK, CUE_POINT):
                    state["track" if kind == TRACK else "cue"] = {}
                reached = walk(at, stop, kind if size is None or kind != CLUSTER else 0)
                if kind == TRACK:
                    out.tracks[state["track"].get(TRACK_NUMBER, 0)] = state["track"]
                if kind == CUE_POINT:
                    out.cues.append(tuple(state["cue"].get(k, 0) for k in (CUE_TIME, CUE_TRACK, CUE_CLUSTER)))
                at = reached
                continue
            value = data[at:stop]
            if kind == TIMESTAMP:
                state["time"] = int.from_bytes(value, "big")
            elif kind == TIMESTAMP_SCALE:
                out.scale = int.from_bytes(value, "big")
            elif kind in (TRACK_NUMBER, TRACK_TYPE, CHANNELS, DEPTH):
                state["track"][kind] = int.from_bytes(value, "big")
            elif kind in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                state["cue"][kind] = int.from_bytes(value, "big")
            elif kind in (SIMPLE_BLOCK, BLOCK):
                block(at, stop, kind == SIMPLE_BLOCK)
            at = stop
        return at

    walk(0, len(data), 0)
    return out


def samples(data: bytes, packets: Packets, track: int = 1) -> bytes:
    view = memoryview(data)
    return b"".join(view[start:end] for number, _, start, end, *_ in packets.rows if number == track)


def feature(data: bytes, packets: Packets) -> str:
    """Text of the packet table's shape and of the mean and spread of its samples."""
    wave = np.frombuffer(samples(data, packets), np.uint8)
    lacings = [0, 0, 0, 0]
    for row in packets.rows:
        lacings[row[5]] += 1
    last = max((row[1] for row in packets.rows), default=0)
    clusters = set(packets.clusters)
    seekable = sum(place in clusters for _, _, place in packets.cues)
    total, squares = int(wave.sum(dtype=np.int64)), int(np.square(wave, dtype=np.int64).sum())
    return f"tracks={len(packets.tracks)};clusters={len(packets.clusters)};frames={len(packets.rows)};lacing={','.join(map(str, lacings))};cues={seekable};last_ms={last // 1_000_000};sum={total};squares={squares}"


def packet_table(media: DataFrame) -> DataFrame:
    """media_id, media (binary) -> one row per frame with track, timestamp and byte range.

    Null or broken files give one row with ``error`` set and the rest null.
    """

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for media_id, data in zip(batch.column("media_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                try:
                    if data is None:
                        raise ValueError("null file")
                    rows = [(media_id, i, track, stamp, start, end, key, lacing, None) for i, (track, stamp, start, end, key, lacing, _) in enumerate(parse(data).rows)]
                except (ValueError, IndexError, RecursionError) as problem:
                    rows = [(media_id, None, None, None, None, None, None, None, str(problem) or "truncated")]
                for row in rows:
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            names = ["media_id", "packet", "track", "timestamp_ns", "start", "end", "keyframe", "lacing", "error"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    shape = "media_id long, packet long, track long, timestamp_ns long, start long, end long, keyframe boolean, lacing int, error string"
    return media.select("media_id", "media").mapInArrow(run, shape)


def padded(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def store_texts(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Each text's file and what is read back from it; null text is empty, repeated rows get equal values.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature and on demand media (binary).
    """

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for text in batch.column("text").to_pylist():
            raw = text.encode()
            media = mux(padded(raw))
            packets = parse(media)
            back = samples(media, packets)
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(media, packets), media if keep_media else None))
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media")
        return {"doc_id": batch.column("doc_id")} | dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    shape = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary"
    made = arrow_map(texts(docs), run, shape)
    return made if keep_media else made.drop("media")
