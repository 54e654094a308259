"""Media columns: Matroska files as bytes, and tables of their packets.

``mux`` stores 8-bit mono samples losslessly as a Matroska file: EBML header, segment, track entry,
clusters of laced blocks, and cues. ``parse`` reads any Matroska bytes: element ids and sizes of
variable length (unknown sizes too), clusters, simple blocks and block groups, all four kinds of
lacing, and cues; it gives a row per packet with track, timestamp and byte range. Frames of one lace
follow each other by the default duration of their track, if the file tells it. ``packet_table``
and ``cue_table`` do so for a binary column of a DataFrame; the files of a task are handled one after
the other, nothing is shuffled, and a group of equal or long files is just more rows.

Defined cases: null text is stored as empty; null or empty media has no packets; damaged media gives
the packets that lie whole before the damage; repeated rows give repeated rows; ids may be null.
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

from quire.llm.common import documents

# Fixed values of the format: element ids.
EBML, EBML_VERSION, EBML_READ_VERSION, MAX_ID_LENGTH, MAX_SIZE_LENGTH = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
DEFAULT_DURATION = 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that end a cluster of unknown size.
TOP = {CLUSTER, CUES, INFO, TRACKS, SEGMENT, EBML}
LACES = ("none", "xiph", "fixed", "ebml")

#: Layout of the files written here: samples a second, bytes a frame, frames a block, blocks a cluster.
RATE, FRAME, LACED, BLOCKS = 8000, 512, 8, 16
FRAME_NS = FRAME * 1_000_000_000 // RATE
PAD = 64


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    keyframe: bool
    cluster: int
    lacing: str
    start: int
    size: int


class Cue(NamedTuple):
    timestamp_ns: int
    track: int
    cluster_position: int


def size_bytes(n: int, length: int = 0) -> bytes:
    """n as an element size: a run of zero bits and a one give the length."""
    length = length or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * length).to_bytes(length, "big")


def element(eid: int, body: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def uint(eid: int, n: int) -> bytes:
    return element(eid, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


HEADER = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(MAX_ID_LENGTH, 4) + uint(MAX_SIZE_LENGTH, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
PREFIX = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"quire") + element(WRITING_APP, b"quire")) + element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + uint(DEFAULT_DURATION, FRAME_NS) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))))


def lace_header(sizes: list[int], kind: str) -> bytes:
    """Count and sizes of laced frames; of the last frame the size is what is left."""
    if kind == "none":
        return b""
    out = bytes([len(sizes) - 1])
    if kind == "xiph":
        return out + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if kind == "ebml":
        out += size_bytes(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            d = b - a
            k = next(k for k in range(1, 9) if abs(d) < (1 << 7 * k - 1))
            out += size_bytes(d + (1 << 7 * k - 1) - 1, k)
    return out


def simple_block(track: int, ticks: int, frames: list[bytes], kind: str) -> bytes:
    head = size_bytes(track) + struct.pack(">hB", ticks, 0x80 | LACES.index(kind) << 1)
    return element(SIMPLE_BLOCK, head + lace_header([len(f) for f in frames], kind) + b"".join(frames))


def mux(samples: bytes) -> bytes:
    """8-bit mono samples as a Matroska file."""
    clusters, cues, at = [], [], len(PREFIX)
    step = FRAME * LACED
    for begin in range(0, len(samples), step * BLOCKS):
        body = uint(TIMESTAMP, begin * 1000 // RATE)
        for b in range(begin, min(len(samples), begin + step * BLOCKS), step):
            frames = [samples[f : f + FRAME] for f in range(b, min(len(samples), b + step), FRAME)]
            kind = "none" if len(frames) == 1 else "fixed" if len(frames[-1]) == FRAME else "ebml"
            body += simple_block(1, (b - begin) * 1000 // RATE, frames, kind)
        clusters.append(element(CLUSTER, body))
        cues.append(element(CUE_POINT, uint(CUE_TIME, begin * 1000 // RATE) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        at += len(clusters[-1])
    return HEADER + element(SEGMENT, PREFIX + b"".join(clusters) + element(CUES, b"".join(cues)))


def read_size(data: bytes, at: int, keep: bool = False) -> tuple[int | None, int]:
    """Value and length of the variable-length number at a place; None: unknown. keep: with its length bits, as in ids."""
    if at >= len(data) or not data[at]:
        raise ValueError("no number here")
    length = 9 - data[at].bit_length()
    if at + length > len(data):
        raise ValueError("cut short")
    n = int.from_bytes(data[at : at + length], "big")
    if keep:
        return n, length
    n &= (1 << 7 * length) - 1
    return (None if n == (1 << 7 * length) - 1 else n), length


class Element(NamedTuple):
    eid: int
    start: int
    begin: int  # of the body
    stop: int
    whole: bool  # its body lies in the data


def elements(data: bytes, at: int, end: int) -> Iterator[Element]:
    """The elements in a stretch, until damage; one of unknown size reaches to the end of the stretch."""
    while at < end:
        try:
            eid, a = read_size(data, at, keep=True)
            n, b = read_size(data, at + a)
        except ValueError:
            return
        begin = at + a + b
        stop = end if n is None else begin + n
        yield Element(eid, at, begin, min(stop, end), stop <= end)
        at = stop


def lace_sizes(data: bytes, at: int, end: int, kind: str) -> tuple[list[int], int]:
    """Sizes of the frames of a block, and where the first begins."""
    if kind == "none":
        return [end - at], at
    n, at = data[at] + 1, at + 1
    if kind == "fixed":
        if (end - at) % n:
            raise ValueError("uneven frames")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if kind == "xiph":
            size = 0
            while True:
                size, last, at = size + data[at], data[at], at + 1
                if last != 255:
                    break
        else:
            v, length = read_size(data, at)
            at += length
            if v is None:
                v = (1 << 7 * length) - 1
            size = v if k == 0 else sizes[-1] + v - ((1 << 7 * length - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("frames beyond the block")
    return sizes, at


def unsigned(data: bytes, e: "Element") -> int:
    return int.from_bytes(data[e.begin : e.stop], "big")


def parse(data: bytes) -> tuple[list[Packet], list[Cue]]:
    """Packets and cues of Matroska bytes, in file order."""
    packets: list[Packet] = []
    cues: list[Cue] = []
    scale, number = 1_000_000, -1
    duration: dict[int, int] = {}  # of a frame, by track

    def block(e: Element, time: int, simple: bool) -> None:
        if not e.whole:
            return
        track, a = read_size(data, e.begin)
        ticks, flags = struct.unpack_from(">hB", data, e.begin + a)
        kind = LACES[flags >> 1 & 3]
        sizes, at = lace_sizes(data, e.begin + a + 3, e.stop, kind)
        for k, n in enumerate(sizes):
            packets.append(Packet(track, (time + ticks) * scale + k * duration.get(track, 0), bool(flags & 0x80) or not simple, number, kind, at, n))
            at += n

    def cluster(at: int, end: int) -> int:
        """Where the cluster ends: at the end of its body, or, if it had no size, at the next element of the segment."""
        time = 0
        for e in elements(data, at, end):
            if e.eid in TOP:
                return e.start
            if e.eid == TIMESTAMP:
                time = unsigned(data, e)
            elif e.eid == SIMPLE_BLOCK:
                block(e, time, True)
            elif e.eid == BLOCK_GROUP:
                for x in elements(data, e.begin, e.stop):
                    if x.eid == BLOCK:
                        block(x, time, False)
        return end

    def cue(e: Element) -> None:
        time = 0
        for x in elements(data, e.begin, e.stop):
            if x.eid == CUE_TIME:
                time = unsigned(data, x)
            elif x.eid == CUE_TRACK_POSITIONS:
                got = {y.eid: unsigned(data, y) for y in elements(data, x.begin, x.stop)}
                cues.append(Cue(time * scale, got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER_POSITION, 0)))

    def walk(at: int, end: int) -> None:
        nonlocal scale, number
        while (e := next(elements(data, at, end), None)) is not None:
            at = e.stop
            if e.eid in (SEGMENT, INFO, TRACKS):
                at = e.begin  # what it holds comes next; however deep it lies, nothing is stacked
            elif e.eid == TRACK_ENTRY:
                got = {x.eid: unsigned(data, x) for x in elements(data, e.begin, e.stop) if x.eid in (TRACK_NUMBER, DEFAULT_DURATION)}
                duration[got.get(TRACK_NUMBER, 0)] = got.get(DEFAULT_DURATION, 0)
            elif e.eid == CLUSTER:
                number += 1
                at = cluster(e.begin, e.stop)
            elif e.eid == TIMESTAMP_SCALE:
                scale = unsigned(data, e)
            elif e.eid == CUES:
                for x in elements(data, e.begin, e.stop):
                    if x.eid == CUE_POINT:
                        cue(x)

    try:
        walk(0, len(data))
    except (ValueError, IndexError, struct.error):
        pass  # what lies before the damage stands
    return packets, cues


def payload(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text, and these padded with zeros to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % PAD if raw else PAD)


def feature(packets: list[Packet], cues: list[Cue], samples: bytes) -> str:
    x = np.frombuffer(samples, np.uint8)
    centred = x.astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"packets={len(packets)};cues={len(cues)};ms={len(x) * 1000 // RATE};sum={int(centred.sum())};energy={int((centred * centred).sum())};crossings={crossings}"


def packet_table(media: DataFrame, key: str, column: str) -> DataFrame:
    """A row per packet of each file: key, number in the file, track, timestamp and byte range."""
    kind = media.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for k, data in zip(b.column(0), b.column(1)):
                rows, _ = parse(data.as_py() or b"")
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(rows), b.schema.field(0).type), pa.array(range(len(rows)), pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.int64())], ["id", "packet", "track", "timestamp_ns", "keyframe", "cluster", "lacing", "start", "size"])

    return media.select(media[key], media[column]).mapInArrow(run, f"id {kind}, packet long, track long, timestamp_ns long, keyframe boolean, cluster long, lacing string, start long, size long")


def cue_table(media: DataFrame, key: str, column: str) -> DataFrame:
    """A row per cue of each file."""
    kind = media.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [(k.as_py(), *c) for k, data in zip(b.column(0), b.column(1)) for c in parse(data.as_py() or b"")[1]]
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *(pa.array(c, pa.int64()) for c in cols[1:])], ["id", "timestamp_ns", "track", "cluster_position"])

    return media.select(media[key], media[column]).mapInArrow(run, f"id {kind}, timestamp_ns long, track long, cluster_position long")


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id and media, the padded text of each row stored as a Matroska file."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([mux(payload(t)[1]) for t in part.column(1).to_pylist()], pa.binary())], ["doc_id", "media"])

    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(run, "doc_id long, media binary")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: sizes and hashes of the payload as read back from its file, of the file, and features."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def row(text):
        n, samples = payload(text)
        media = mux(samples)
        packets, cues = parse(media)
        back = b"".join([media[p.start : p.start + p.size] for p in packets])
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature(packets, cues, back)

    def run(batches):
        for b in batches:
            cols = list(zip(*[row(t.as_py()) for t in b.column(1)])) or [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types[1:]))], names)

    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op1(spark, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
