import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from helpers import SF

from quire.llm import matroska as m


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.integers(1, 700))
def test_round_trip(seed, times):
    samples = (seed or b"x") * times
    packets, cues = m.parse(m.mux(samples))
    data = m.mux(samples)
    assert b"".join(data[p.start : p.start + p.size] for p in packets) == samples
    assert len(cues) == len({p.cluster for p in packets})
    assert all(p.track == 1 and p.keyframe for p in packets)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 700), min_size=2, max_size=9), st.sampled_from(["xiph", "ebml"]))
def test_lacing(sizes, kind):
    frames = [bytes([i % 256]) * n for i, n in enumerate(sizes)]
    data = m.HEADER + m.element(m.SEGMENT, m.PREFIX + m.element(m.CLUSTER, m.uint(m.TIMESTAMP, 7) + m.simple_block(3, -2, frames, kind)))
    packets, _ = m.parse(data)
    assert [data[p.start : p.start + p.size] for p in packets] == frames
    assert {(p.track, p.timestamp_ns, p.lacing) for p in packets} == {(3, 5_000_000, kind)}  # track 3 tells no duration


def test_frames_of_a_lace_have_their_own_times():
    packets, _ = m.parse(m.mux(bytes(20_000)))
    assert [p.timestamp_ns for p in packets] == [k * m.FRAME_NS for k in range(40)]


def test_deep_nesting_ends():
    data = b""
    for _ in range(3000):
        data = m.element(m.SEGMENT, data)
    assert m.parse(m.HEADER + data) == ([], [])


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = m.op1(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        want = raw + bytes(-len(raw) % 64 if raw else 64)
        signed = [b - 128 for b in want]
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(signed, signed[1:]))
        frames = -(-len(want) // m.FRAME)
        clusters = -(-len(want) // (m.FRAME * m.LACED * m.BLOCKS))
        feature = f"packets={frames};cues={clusters};ms={len(want) // 8};sum={sum(signed)};energy={sum(x * x for x in signed)};crossings={crossings}"
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]), feature)
        assert r.media_sha256 == hashlib.sha256(m.mux(want)).hexdigest() and r.media_bytes == len(m.mux(want))


def test_unknown_sizes_groups_and_damage():
    unknown = b"\x01" + b"\xff" * 7
    cluster = m.CLUSTER.to_bytes(4, "big") + unknown
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, b"\x81" + struct.pack(">hB", 4, 0) + b"abc"))
    data = m.HEADER + m.SEGMENT.to_bytes(4, "big") + unknown + m.PREFIX
    for k in range(3):
        data += cluster + m.uint(m.TIMESTAMP, 10 * k) + group
    packets, _ = m.parse(data)
    assert [(p.cluster, p.timestamp_ns) for p in packets] == [(k, (10 * k + 4) * 1_000_000) for k in range(3)]
    assert len(m.parse(data[:-1])[0]) == 2  # the last block isn't whole
    assert m.parse(b"") == ([], []) and m.parse(b"\x00\x01") == ([], [])


def test_cues_point_at_clusters():
    data = m.mux(bytes(200_000))
    packets, cues = m.parse(data)
    body = data.index(m.PREFIX)
    for c in cues:
        assert data[body + c.cluster_position :][:4] == m.CLUSTER.to_bytes(4, "big")
    assert [c.timestamp_ns for c in cues] == sorted({p.timestamp_ns for p in packets if p.timestamp_ns in {c.timestamp_ns for c in cues}})


def test_tables(spark):
    text = "héllo " * 5000
    docs = spark.createDataFrame([(1, "a", 9), (2, None, 9), (3, "", 9), (None, text, 9), (4, text, 9), (4, text, 9)], "doc_id long, text string, n_bytes int")
    rows = m.digest(docs).collect()
    assert len(rows) == 6
    by = {r.doc_id: r for r in rows}
    assert by[2].n_bytes == 0 and by[2].payload_bytes == 64 and by[2][3:] == by[3][3:]
    raw = text.encode()
    want = raw + bytes(-len(raw) % 64)
    assert by[4].payload_sha256 == hashlib.sha256(want).hexdigest() == by[None].payload_sha256
    assert by[4].tail_crc32 == zlib.crc32(want[-64:]) and by[4].n_bytes == len(raw)
    media = m.to_media(docs)
    packets = m.packet_table(media, "doc_id", "media")
    assert packets.where("doc_id is null" if "doc_id" in packets.columns else "id is null").groupBy().sum("size").collect()[0][0] == len(want)
    assert m.cue_table(media, "doc_id", "media").where("id = 1").count() == 1
    assert m.digest(docs.limit(0)).collect() == []


@pytest.mark.parametrize("cut", [10, 100, 3000])
def test_any_cut_parses(cut):
    data = m.mux(bytes(range(256)) * 40)
    packets, _ = m.parse(data[:cut])
    assert all(p.start + p.size <= cut for p in packets)
