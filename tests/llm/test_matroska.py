import hashlib
import struct
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from ionfield.llm import matroska as m
from tests.llm.conftest import clashing, docs_frame


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=300).map(lambda b: b * 70))
def test_round_trip(payload):
    media = m.encode(payload)
    table, cues, leaves = m.packets(media)
    assert b"".join(media[p.start : p.start + p.size] for p in table) == payload
    assert leaves[m.CODEC_ID] == b"A_PCM/INT/LIT" and leaves[m.BIT_DEPTH] == b"\x08"
    assert all(media[at : at + 4] == m.CLUSTER.to_bytes(4, "big") for _, at in cues) and cues
    assert [p.timestamp for p in table] == sorted(p.timestamp for p in table)


def test_many_clusters():
    payload = bytes(range(256)) * 4096
    media = m.encode(payload)
    table, cues, _ = m.packets(media)
    assert len(cues) == 4 and b"".join(media[p.start : p.start + p.size] for p in table) == payload
    assert cues[-1][0] == 3 * m.FRAME * m.LACED * m.BLOCKS * 1000 // m.RATE


def _file(cluster: bytes, unknown: bool = False) -> bytes:
    head = m.element(m.EBML, b"")
    body = m.element(m.TRACKS, b"") + cluster
    if unknown:
        return head + m.SEGMENT.to_bytes(4, "big") + b"\x01\xff\xff\xff\xff\xff\xff\xff" + body
    return head + m.element(m.SEGMENT, body)


def _block(flags: int, body: bytes, track: int = 2, time: int = 5) -> bytes:
    return m.vint(track) + struct.pack(">hB", time, flags) + body


def test_all_lacings_and_groups():
    frames = [b"a" * 300, b"b" * 10, b"c" * 7]
    xiph = _block(0x02, bytes([2, 255, 45, 10]) + b"".join(frames))
    fixed = _block(0x84, bytes([2]) + b"xxyyzz")
    ebml = _block(0x06, bytes([2]) + m.vint(300) + struct.pack(">H", 10 - 300 + 8191 | 0x4000) + b"".join(frames))
    plain = _block(0x80, b"solo")
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, _block(0x00, b"grp")))
    delta = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, _block(0x00, b"ref", time=9)) + m.unsigned(0xFB, 1))
    inner = m.unsigned(m.CLUSTER_TIMESTAMP, 1000) + m.element(0xEC, b"\0" * 9) + b"".join(m.element(m.SIMPLE_BLOCK, b) for b in (xiph, fixed, ebml, plain)) + group + delta
    open_ended = m.CLUSTER.to_bytes(4, "big") + b"\xff" + inner
    for data in (_file(m.element(m.CLUSTER, inner)), _file(open_ended + m.element(m.CUES, b""), True)):
        table, _, _ = m.packets(data)
        got = [data[p.start : p.start + p.size] for p in table]
        assert got == [*frames, b"xx", b"yy", b"zz", *frames, b"solo", b"grp", b"ref"]
        assert [p.lacing for p in table][::3][:4] == ["xiph", "fixed", "ebml", "none"]
        assert {p.track for p in table} == {2} and table[0].timestamp == 1005
        assert [p.keyframe for p in table[-3:]] == [True, True, False]


def test_whole_table(spark, odd_docs):
    rows = m.read_media(m.encode_texts(clashing(spark, odd_docs))).collect()
    assert len(rows) == len(odd_docs)
    texts = {i: t for i, t in odd_docs}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(m.encode(payload)).hexdigest()
    one = {r["doc_id"]: r for r in rows}
    assert one[7]["feature"] == one[8]["feature"] and one[1]["media_sha256"] == one[2]["media_sha256"]


def test_packet_table_and_empty(spark):
    media = m.encode_texts(docs_frame(spark, [(1, "x" * 5000)]))
    assert m.packet_table(media).count() == 5
    assert m.read_media(m.encode_texts(docs_frame(spark, []))).collect() == []


def test_a_reference_concerns_only_its_own_group():
    """Tracks that share a timestamp, a reference before and after its block, and blocks after a group."""
    delta = lambda *parts: m.element(m.BLOCK_GROUP, b"".join(parts))
    block = lambda body, track, time: m.element(m.BLOCK, _block(0x00, body, track, time))
    simple = lambda body, track, time: m.element(m.SIMPLE_BLOCK, _block(0x80, body, track, time))
    reference = m.unsigned(m.REFERENCE, 1)
    inner = m.unsigned(m.CLUSTER_TIMESTAMP, 0) + simple(b"k2", 2, 5) + delta(block(b"d1", 1, 5), reference) + delta(reference, block(b"d3", 3, 5)) + delta(block(b"k4", 4, 5)) + simple(b"k5", 1, 5)
    data = _file(m.element(m.CLUSTER, inner))
    table, _, _ = m.packets(data)
    assert [(data[p.start : p.start + p.size], p.track, p.keyframe) for p in table] == [(b"k2", 2, True), (b"d1", 1, False), (b"d3", 3, False), (b"k4", 4, True), (b"k5", 1, True)]


def test_stored_media_is_what_was_made(spark, odd_docs):
    made = m.encode_texts(clashing(spark, odd_docs))
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(map(key, m.store_media(made).collect())) == sorted(map(key, made.collect()))
