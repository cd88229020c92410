"""Matroska media columns: variable-length EBML elements, clusters, lacing and cues as packet tables."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import slices

# Fixed values of the container format: element ids.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, TRACKS, TRACK_ENTRY = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x1654AE6B, 0xAE
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, DEFAULT_DURATION, CODEC_ID, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xD7, 0x73C5, 0x83, 0x23E383, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that end an element of unknown size.
TOP = frozenset([CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367])
LACING = ["none", "xiph", "fixed", "ebml"]


def _id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def _size(n: int) -> bytes:
    """The shortest variable-length number for n (all ones would mean unknown)."""
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return _id(kind) + _size(len(body)) + body


def _uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], mode: str) -> bytes:
    """Frames of one block behind their lacing header; "none" holds one frame, "fixed" equal ones."""
    if mode == "none":
        return frames[0]
    head = bytes([len(frames) - 1])
    if mode == "xiph":
        for f in frames[:-1]:
            head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif mode == "ebml":
        head += _size(len(frames[0]))
        for a, b in zip(frames, frames[1:-1]):
            d = len(b) - len(a)
            width = 1
            while abs(d) >= 1 << 7 * width - 1:
                width += 1
            head += (d + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return head + b"".join(frames)


def mux_samples(payload: bytes, frame: int = 1024, frames: int = 6, blocks: int = 32, rate: int = 8000) -> bytes:
    """A file with one track of 8-bit samples: blocks of laced frames, clusters of blocks, a cue for each cluster.

    Full blocks take fixed lacing, those with a shorter last frame EBML or Xiph lacing by turns.
    """
    head = element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / rate)))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", float(rate))) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(DEFAULT_DURATION, frame * 1_000_000_000 // rate) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, cues, place = [info, tracks], [], len(info) + len(tracks)
    for at in range(0, len(payload), frame * frames * blocks):
        start = at * 1000 // rate
        body = [_uint(TIMESTAMP, start)]
        for b, lo in enumerate(range(at, min(at + frame * frames * blocks, len(payload)), frame * frames)):
            group = [payload[i : i + frame] for i in range(lo, min(lo + frame * frames, len(payload)), frame)]
            mode = "none" if len(group) == 1 else "fixed" if len(group[-1]) == frame else ("ebml", "xiph")[b % 2]
            flags = 0x80 | LACING.index(mode) << 1
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", lo * 1000 // rate - start, flags) + lace(group, mode)))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, place))))
        parts.append(cluster)
        place += len(cluster)
    return head + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """(number, next place) of a variable-length number; None is the unknown size."""
    first = data[at]
    if not first:
        raise ValueError(f"no element at byte {at}")
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise ValueError("the file ends within a number")
    n = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


@dataclass
class Parsed:
    """Packets (track, timestamp, start, size, keyframe, lacing, cluster), cues (time, track, byte of the cluster) and tracks (number, type, codec)."""

    packets: list[tuple[int, int, int, int, bool, str, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    tracks: list[tuple[int, int, str]] = field(default_factory=list)
    frame_ns: dict[int, int] = field(default_factory=dict)
    clusters: int = 0
    scale: int = 1_000_000
    whole: bool = True


def _children(data: bytes, at: int, end: int):
    """(kind, start, end) of the elements within a range; an element of unknown size ends where the next top element begins."""
    while at < end:
        kind, body = vint(data, at, keep_marker=True)
        size, body = vint(data, body)
        if size is None:
            stop = end if kind == SEGMENT else _unknown_end(data, body, end)
            yield kind, body, stop
        else:
            stop = body + size
            yield kind, body, min(stop, end)
            if stop > end:
                raise ValueError("an element reaches beyond its parent")
        at = stop


def _unknown_end(data: bytes, at: int, end: int) -> int:
    """Where an element of unknown size ends; others of unknown size within it are entered, which takes no stack."""
    while at < end:
        kind, body = vint(data, at, keep_marker=True)
        if kind in TOP:
            return at
        size, body = vint(data, body)
        at = body if size is None else body + size
    return end


def _long(n: int) -> int:
    """n, if a long holds it."""
    if not -(2**63) <= n < 2**63:
        raise ValueError("a number is too large")
    return n


def _number(data: bytes, a: int, b: int) -> int:
    return _long(int.from_bytes(data[a : min(b, a + 9)], "big"))


def _block(data: bytes, a: int, b: int, base: int, out: Parsed, keyframe: bool | None) -> None:
    track, at = vint(data, a)
    delta, flags = struct.unpack_from(">hB", data, at)
    at += 3
    mode = LACING[flags >> 1 & 3]
    key = bool(flags & 0x80) if keyframe is None else keyframe
    if mode == "none":
        sizes = [b - at]
    else:
        n, at = data[at] + 1, at + 1
        if mode == "fixed":
            sizes = [(b - at) // n] * n
        elif mode == "xiph":
            sizes = []
            for _ in range(n - 1):
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                sizes.append(size + data[at])
                at += 1
        else:
            size, at = vint(data, at)
            sizes = [size]
            for _ in range(n - 2):
                start = at
                d, at = vint(data, at)
                d = (1 << 7 * (at - start)) - 1 if d is None else d
                size += d - ((1 << 7 * (at - start) - 1) - 1)
                sizes.append(size)
            sizes = sizes[: n - 1]
        if mode != "fixed":
            sizes.append(b - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > b:
        raise ValueError("lacing reaches beyond its block")
    for i, size in enumerate(sizes):  # later frames of a lace follow at the track's frame duration
        out.packets.append((track, _long(base + delta + i * out.frame_ns.get(track, 0) // out.scale), at, size, key, mode, out.clusters - 1))
        at += size


def parse(data: bytes) -> Parsed:
    """Packets, cues and tracks of a file. A damaged file gives what stands before the damage, with whole false."""
    out = Parsed()
    try:
        for kind, a, b in _children(data, 0, len(data)):
            if kind == SEGMENT:
                _segment(data, a, b, out)
    except (ValueError, IndexError, struct.error, OverflowError):
        out.whole = False
    return out


def _segment(data: bytes, begin: int, end: int, out: Parsed) -> None:
    for kind, a, b in _children(data, begin, end):
        if kind == CLUSTER:
            base = 0
            out.clusters += 1
            for sub, c, d in _children(data, a, b):
                if sub == TIMESTAMP:
                    base = _number(data, c, d)
                elif sub == SIMPLE_BLOCK:
                    _block(data, c, d, base, out, None)
                elif sub == BLOCK_GROUP:
                    inner = list(_children(data, c, d))
                    for k, e, f in inner:
                        if k == BLOCK:
                            _block(data, e, f, base, out, all(x[0] != REFERENCE_BLOCK for x in inner))
        elif kind == INFO:
            for sub, c, d in _children(data, a, b):
                if sub == TIMESTAMP_SCALE:
                    out.scale = _number(data, c, d) or 1_000_000
        elif kind == TRACKS:
            for _, c, d in _children(data, a, b):
                f = {sub: (e, g) for sub, e, g in _children(data, c, d)}
                if DEFAULT_DURATION in f and TRACK_NUMBER in f:
                    out.frame_ns[_number(data, *f[TRACK_NUMBER])] = _number(data, *f[DEFAULT_DURATION])
                out.tracks.append((_number(data, *f.get(TRACK_NUMBER, (0, 0))), _number(data, *f.get(TRACK_TYPE, (0, 0))), data[slice(*f.get(CODEC_ID, (0, 0)))].decode("latin-1")))
        elif kind == CUES:
            for _, c, d in _children(data, a, b):
                time, places = 0, []
                for sub, e, f in _children(data, c, d):
                    if sub == CUE_TIME:
                        time = _number(data, e, f)
                    elif sub == CUE_TRACK_POSITIONS:
                        places.append({k: _number(data, g, h) for k, g, h in _children(data, e, f)})
                out.cues += [(time, p.get(CUE_TRACK, 0), _long(begin + p.get(CUE_CLUSTER_POSITION, 0))) for p in places]


PACKET = T.StructType([T.StructField("track", T.LongType()), T.StructField("timestamp", T.LongType()), T.StructField("start", T.LongType()), T.StructField("size", T.LongType()), T.StructField("keyframe", T.BooleanType()), T.StructField("lacing", T.StringType()), T.StructField("cluster", T.LongType())])
CUE = T.StructType([T.StructField("time", T.LongType()), T.StructField("track", T.LongType()), T.StructField("start", T.LongType())])
_PACKETS = pa.list_(pa.struct([("track", pa.int64()), ("timestamp", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.string()), ("cluster", pa.int64())]))
_CUES = pa.list_(pa.struct([("time", pa.int64()), ("track", pa.int64()), ("start", pa.int64())]))


def store_samples(df: DataFrame, payload_col: str, out_col: str = "media") -> DataFrame:
    """Adds out_col: the bytes of payload_col as 8-bit samples in a Matroska file. Null gives null, empty a file without clusters.

    Other columns are kept; one named out_col is replaced. The file depends on the bytes alone.
    """
    rest = [c for c in df.columns if c != out_col]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(out_col, T.BinaryType())])
    place = rest.index(payload_col)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, payload_col):
                made = [None if x is None else mux_samples(x) for x in batch.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def read_media(df: DataFrame, media_col: str = "media", samples: bool = True) -> DataFrame:
    """Adds to each row what its Matroska file holds.

    packets: track, timestamp (in units of the file), byte start and size, keyframe, lacing and cluster
    of each packet in file order; cues: time, track and byte start of the cluster; whole: false where
    the file is damaged, whose packets before the damage are kept; samples, if asked for: the bytes of
    the packets of the first track. Null media: null columns. Bytes that are no file: no packets,
    whole is false unless there are none. Other columns are kept; those of these names are replaced.
    """
    added = ["packets", "cues", "whole", *["samples"] * samples]
    rest = [c for c in df.columns if c not in added]
    place = rest.index(media_col)
    fields = {"packets": T.ArrayType(PACKET), "cues": T.ArrayType(CUE), "whole": T.BooleanType(), "samples": T.BinaryType()}
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(c, fields[c]) for c in added])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, media_col):
                media = batch.column(place).to_pylist()
                found = [None if x is None else parse(x) for x in media]
                packets = [None if p is None else [dict(zip(PACKET.names, x)) for x in p.packets] for p in found]
                cues = [None if p is None else [dict(zip(("time", "track", "start"), x)) for x in p.cues] for p in found]
                out = [*batch.columns, pa.array(packets, _PACKETS), pa.array(cues, _CUES), pa.array([None if p is None else p.whole for p in found], pa.bool_())]
                if samples:
                    first = [None if p is None else next((x[0] for x in p.packets), 0) for p in found]
                    out.append(pa.array([None if p is None else b"".join([x[s : s + n] for t, _, s, n, *_ in p.packets if t == f]) for x, p, f in zip(media, found, first)], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def packet_table(df: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """A row for each packet of each file: id_col, packet (from 0 in file order) and the packet's columns."""
    found = read_media(df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{media_col}`").alias("media")), samples=False)
    return found.select(F.col("__id").alias(id_col), F.posexplode("packets").alias("packet", "p")).select(id_col, "packet", "p.*")
