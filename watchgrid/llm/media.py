"""Matroska as columns: write, parse into packets, read back.

An EBML element is an identifier, a size of variable length and a body. The parser walks segment, tracks, clusters,
block groups and cues; it takes unknown sizes of segments and clusters, all kinds of lacing (none, Xiph, fixed, EBML), and
yields one packet a frame with track, timestamp and byte range. Cues lead to the cluster of a time without reading those before.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from watchgrid.llm.words import parts
from watchgrid.session import ship

# Element identifiers of the public format.
EBML, SEGMENT, INFO, SCALE, TRACKS, ENTRY = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
NUMBER, UID, KIND, CODEC, LACING, AUDIO, RATE, CHANNELS, DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, EACH = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x23E383
CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_PLACE = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_MASTERS = {SEGMENT, INFO, TRACKS, ENTRY, AUDIO, CLUSTER, GROUP, CUES, POINT, POSITIONS}
#: Elements of a segment, any of which ends a cluster of unknown size.
_TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
RATE_HZ = 8000
FRAME = 800
LACED = 8
CLUSTERED = 4


def size_code(n: int, width: int = 0) -> bytes:
    """A size in the fewest bytes, or in ``width``; all ones are kept for unknown."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + size_code(len(body)) + body


def number(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes]) -> bytes:
    """The body of a block's frames after its flags: EBML lacing, or none for one frame."""
    if len(frames) == 1:
        return frames[0]
    out = [bytes([len(frames) - 1]), size_code(len(frames[0]))]
    for a, b in zip(frames, frames[1:-1]):
        step = len(b) - len(a)
        width = next(w for w in range(1, 9) if abs(step) < 1 << (7 * w - 1))
        out.append(size_code(step + (1 << (7 * width - 1)) - 1, width))
    return b"".join([*out, *frames])


def write(payload: bytes) -> bytes:
    """A Matroska file of one track of unsigned 8-bit samples: laced blocks in clusters, cues at the end."""
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    info = element(INFO, number(SCALE, 1_000_000) + element(0x4D80, b"watchgrid") + element(0x5741, b"watchgrid"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", RATE_HZ)) + number(CHANNELS, 1) + number(DEPTH, 8))
    track = element(ENTRY, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + audio)
    body = [info, element(TRACKS, track)]
    place, cues = sum(map(len, body)), []
    block, cluster = FRAME * LACED, FRAME * LACED * CLUSTERED
    for c in range(0, len(payload), cluster):
        at = c * 1000 // RATE_HZ
        blocks = [number(TIME, at)]
        for b in range(c, min(c + cluster, len(payload)), block):
            frames = [payload[f : f + FRAME] for f in range(b, min(b + block, len(payload)), FRAME)]
            flags = 0x80 | (0x06 if len(frames) > 1 else 0)
            blocks.append(element(SIMPLE, size_code(1) + struct.pack(">hB", b * 1000 // RATE_HZ - at, flags) + _laced(frames)))
        whole = element(CLUSTER, b"".join(blocks))
        cues.append(element(POINT, number(CUE_TIME, at) + element(POSITIONS, number(CUE_TRACK, 1) + number(CUE_PLACE, place))))
        body.append(whole)
        place += len(whole)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


def _size(data: bytes, at: int) -> tuple[int | None, int]:
    """(value or None for unknown, next place)."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no size at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"size cut off at byte {at}")
    value = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def _head(data: bytes, at: int) -> tuple[int, int | None, int]:
    """(name, size or None for unknown, body's start) of the element at a byte."""
    if not data[at] >> 4:
        raise ValueError(f"no element at byte {at}")
    width = 9 - data[at].bit_length()
    n, start = _size(data, at + width)
    return int.from_bytes(data[at : at + width], "big"), n, start


def _cluster_end(data: bytes, at: int, end: int) -> int:
    """Where a cluster of unknown size, whose children begin at ``at``, ends: at the next element of a segment."""
    while at < end:
        name, n, start = _head(data, at)
        if name in _TOP:
            return at
        if n is None:
            raise ValueError(f"element {name:X} of unknown size in a cluster at byte {at}")
        at = start + n
    return end


def elements(data: bytes, at: int, end: int):
    """(name, body's start, body's end) of the elements from ``at`` to ``end``. An unknown size lasts to the parent's end, a
    cluster's to the next element of its level."""
    while at < end:
        name, n, start = _head(data, at)
        stop = start + n if n is not None else _cluster_end(data, start, end) if name == CLUSTER else end
        if stop > end:
            raise ValueError(f"element {name:X} passes its parent's end at byte {at}")
        yield name, start, stop
        at = stop


def frames(data: bytes, at: int, end: int):
    """(track, relative time, start, end) of each frame of a block."""
    track, at = _size(data, at)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        yield track, relative, at, end
        return
    n = data[at] + 1
    at += 1
    sizes = []
    if lacing == 1:
        for _ in range(n - 1):
            total = 0
            while data[at] == 255:
                total, at = total + 255, at + 1
            sizes.append(total + data[at])
            at += 1
    elif lacing == 3 and n > 1:
        first, at = _size(data, at)
        sizes.append(first)
        for _ in range(n - 2):
            begin = at
            step, at = _size(data, at)
            if step is None:
                step = (1 << 7 * (at - begin)) - 1
            sizes.append(sizes[-1] + step - ((1 << (7 * (at - begin) - 1)) - 1))
    else:
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced sizes pass the block's end")
    for s in sizes:
        yield track, relative, at, at + s
        at += s


def _durations(track: dict, sizes: list[int]) -> list[int]:
    """Nanoseconds of each frame of a laced block: the track's default, else of plain samples their time, else 0."""
    if EACH in track:
        return [track[EACH]] * len(sizes)
    second = track.get(RATE, 0) * track.get(CHANNELS, 1) * track.get(DEPTH, 0) / 8
    if track.get(CODEC, "").startswith("A_PCM") and second > 0:
        return [round(n * 1_000_000_000 / second) for n in sizes]
    return [0] * len(sizes)


class Parser:
    """Reads a file: ``packets`` (track, timestamp in ns, start, end), ``cues`` (ns, track, byte of the cluster), ``tracks`` (dicts)."""

    def __init__(self, data: bytes, clusters: bool = True):
        self.data, self.clusters = data, clusters
        self.packets: list[tuple] = []
        self.cues: list[tuple] = []
        self.tracks: list[dict] = []
        self.scale, self.origin = 1_000_000, 0
        self._walk(0, len(data), {})

    def _whole(self, a: int, b: int) -> int:
        return int.from_bytes(self.data[a:b], "big")

    def _walk(self, at: int, end: int, into: dict) -> None:
        for name, a, b in elements(self.data, at, end):
            if name == SCALE:
                self.scale = self._whole(a, b)
            elif name in (NUMBER, CHANNELS, DEPTH, CUE_TIME, CUE_TRACK, CUE_PLACE, EACH):
                into[name] = self._whole(a, b)
            elif name == CODEC:
                into[name] = self.data[a:b].decode("ascii", "replace")
            elif name == RATE:
                into[name] = struct.unpack(">d" if b - a == 8 else ">f", self.data[a:b])[0]
            elif name == CLUSTER:
                if self.clusters:
                    self.cluster(a, b)
            elif name in _MASTERS:
                if name == SEGMENT:
                    self.origin = a
                mine = {} if name in (ENTRY, POINT) else into
                self._walk(a, b, mine)
                if name == ENTRY:
                    self.tracks.append(mine)
                elif name == POINT:
                    self.cues.append((mine.get(CUE_TIME, 0) * self.scale, mine.get(CUE_TRACK, 0), self.origin + mine.get(CUE_PLACE, 0)))

    def cluster(self, at: int, end: int) -> None:
        time = 0
        of = {t.get(NUMBER): t for t in self.tracks}
        for name, a, b in elements(self.data, at, end):
            if name == TIME:
                time = self._whole(a, b)
            blocks = [(a, b)] if name == SIMPLE else [(x, y) for n, x, y in elements(self.data, a, b) if n == BLOCK] if name == GROUP else []
            for x, y in blocks:
                found = list(frames(self.data, x, y))
                t = (time + found[0][1]) * self.scale
                for (track, _, start, stop), step in zip(found, _durations(of.get(found[0][0], {}), [f[3] - f[2] for f in found])):
                    self.packets.append((track, t, start, stop))
                    t += step


def packets(data: bytes) -> tuple[list[tuple], list[tuple], list[dict]]:
    """(packets, cues, tracks); see ``Parser``."""
    found = Parser(data)
    return found.packets, found.cues, found.tracks


def packets_from(data: bytes, at_ns: int) -> list[tuple]:
    """Packets of ``at_ns`` or later, from the cluster of the last cue that is no later; without cues, from the start."""
    found = Parser(data, clusters=False)
    before = [c for c in found.cues if c[0] <= at_ns]
    if not found.cues or not before:
        found = Parser(data)
    else:
        # a segment's children from that cluster on
        for name, a, b in elements(data, max(before)[2], len(data)):
            if name == CLUSTER:
                found.cluster(a, b)
    return [p for p in found.packets if p[1] >= at_ns]


def read(data: bytes, track: int = 1) -> bytes:
    """The samples of a track, frame after frame."""
    return b"".join([data[a:b] for t, _, a, b in Parser(data).packets if t == track])


def padded(text: bytes) -> bytes:
    """Bytes 0 are appended, up to a positive multiple of 64."""
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def describe(found: list[tuple], cues: list[tuple], samples: bytes) -> str:
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(x >= 0)))
    return f"packets={len(found)};cues={len(cues)};last_ms={found[-1][1] // 1_000_000 if found else 0};mean={x.sum() / len(x):.4f};power={int((x * x).sum()) / len(x):.4f};crossings={crossings}"


NEW = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_PACKETS = "packets array<struct<track:int,timestamp_ns:long,start:long,end:long>>"


def media_columns(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """The rows and columns of ``docs`` with the columns of ``NEW`` and, with ``keep_media``, ``media`` (binary) and its
    ``packets``; these replace columns of those names. A null text is stored as an empty one: 64 bytes 0. Equal texts give equal
    values; nothing depends on the order of rows, and repeated rows stay.
    """
    ship(docs.sparkSession)
    more = T._parse_datatype_string(NEW + (f", media binary, {_PACKETS}" if keep_media else "")).fields
    new = [f.name for f in more]
    docs = docs.drop(*new, "media", "packets")
    names = docs.columns
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.struct([("track", pa.int32()), ("timestamp_ns", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))]

    def run(batches):
        for texts, *columns in parts(batches, names):
            rows = []
            for text in texts:
                media = write(padded(text))
                found, cues, _ = packets(media)
                back = b"".join([media[a:b] for _, _, a, b in found])
                row = (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), describe(found, cues, back))
                if keep_media:
                    row += (media, [dict(zip(("track", "timestamp_ns", "start", "end"), p)) for p in found])
                rows.append(row)
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=[*names, *new])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def op9_media_columns(spark, sf_dir: str) -> DataFrame:
    """Per document: sizes and digests of the payload read back and of its stored form."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return media_columns(docs, keep_media=False).drop("text")
