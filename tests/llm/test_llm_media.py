"""Matroska: what is written is read back, and files of other make are read."""

import hashlib
import struct
import zlib

import llm_cases
import pytest

from rosterspark.llm import matroska as m
from rosterspark.llm import queries


@pytest.mark.parametrize("value", [0, 1, 126, 127, 128, 16382, 16383, 2**21, 2**35, 2**55])
def test_variable_lengths(value):
    data = m.varint(value)
    assert m.read_varint(data, 0) == (value, len(data)) and len(data) == next(w for w in range(1, 9) if value < 2 ** (7 * w) - 1)
    assert m.read_varint(m.varint(value, 8), 0) == (value, 8)
    assert m.read_varint(b"\xff", 0) == (None, 1)


@pytest.mark.parametrize("kind", m.LACINGS)
def test_lacing(kind):
    for sizes in ([5], [0, 3], [300, 255, 254, 0, 1], [10, 10, 10], [1, 9000, 2, 70000, 70000]):
        if kind == "none" and len(sizes) > 1 or kind == "fixed" and len(set(sizes)) > 1:
            continue
        frames = [bytes([i + 1]) * s for i, s in enumerate(sizes)]
        data = b"head" + m.lace(frames, kind) + b"tail"
        got = m.unlace(data, 4, len(data) - 4, kind)
        assert [data[a : a + n] for a, n in got] == frames


def test_packets_of_a_file():
    payload = bytes(range(256)) * 150  # 38400 samples, more than one cluster
    data = m.mux(payload)
    found = m.demux(data)
    assert b"".join(data[p[2] : p[2] + p[3]] for p in found.packets) == payload
    assert [p[1] for p in found.packets] == [i * 64_000_000 for i in range(75)]
    assert found.tracks == {1: {"number": 1, "type": 2, "frame_ns": 64_000_000, "codec": "A_PCM/INT/LIT", "rate": 8000.0}}
    assert [c[0] for c in found.cues] == [0, 4_096_000_000] and {c[2] for c in found.cues} == {p[6] for p in found.packets}
    segment = data.index(m.SEGMENT.to_bytes(4, "big"))
    start = m.read_varint(data, segment + 4)[1]
    for _, _, place in found.cues:
        assert m.read_id(data, start + place)[0] == m.CLUSTER


def test_foreign_files():
    """Unknown sizes, block groups, references, void elements, Xiph lacing, a second track."""
    unknown = b"\x01" + b"\xff" * 7
    block = lambda track, time, flags, body: m.varint(track) + struct.pack(">hB", time, flags) + body
    tracks = m.element(m.TRACKS, m.element(m.TRACK_ENTRY, m.number(m.TRACK_NUMBER, 2), m.number(m.TRACK_TYPE, 1), m.element(m.SAMPLING, struct.pack(">f", 4.0))))
    one = m.CLUSTER.to_bytes(4, "big") + unknown + m.number(m.CLUSTER_TIME, 7) + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, block(2, 3, 0x02, m.lace([b"ab", b"c"], "xiph"))), m.number(m.REFERENCE, 1)) + m.element(0xEC, b"void")
    two = m.CLUSTER.to_bytes(4, "big") + unknown + m.number(m.CLUSTER_TIME, 20) + m.element(m.SIMPLE_BLOCK, block(2, -4, 0x80, b"xyz"))
    data = m.element(m.EBML, b"") + m.SEGMENT.to_bytes(4, "big") + unknown + m.element(m.INFO, m.number(m.TIMESTAMP_SCALE, 1000)) + tracks + one + two
    found = m.demux(data)
    assert [(p[0], p[1], data[p[2] : p[2] + p[3]], p[4], p[5]) for p in found.packets] == [(2, 10_000, b"ab", False, "xiph"), (2, 10_000, b"c", False, "xiph"), (2, 16_000, b"xyz", True, "none")]
    assert found.packets[0][6] != found.packets[2][6] and found.tracks[2]["rate"] == 4.0
    for bad in (b"", b"RIFF", data[:-2], m.mux(b"a" * 64)[:-40]):
        with pytest.raises((ValueError, IndexError, struct.error)):
            m.demux(bad)


def want(text):
    raw = (text or "").encode()
    payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def test_column_round_trip(spark):
    media = m.to_media(llm_cases.frame(spark))
    out = m.media_features(media).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out), key=str) == sorted(((r[0], *want(r[1])) for r in llm_cases.rows()), key=str)
    same = {}
    for r in out:
        assert same.setdefault(r["payload_sha256"] + str(r["n_bytes"]), (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert m.media_features(m.to_media(llm_cases.empty(spark))).count() == 0


def test_packet_tables(spark):
    media = spark.createDataFrame([(1, m.mux(bytes(5000))), (2, None), (None, m.mux(bytes(64))), (3, b"junk")], "doc_id long, media binary")
    rows = m.packet_table(media).collect()
    assert [r["length"] for r in rows if r["id"] == 1] == [512] * 9 + [392] and all(r["cued"] for r in rows if r["track"] == 1)
    assert [r["track"] for r in rows if r["id"] == 3] == [-1] and not [r for r in rows if r["id"] == 2] and len([r for r in rows if r["id"] is None]) == 1


def test_query_over_the_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = queries.QUERIES["op7_media_columns"](spark, folder).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out} == {d: want(t) for d, t in docs.items()}


def test_damaged_media_are_named_and_stop_nothing(spark):
    whole = bytes(m.to_media(spark.createDataFrame([(1, "some text")], "doc_id long, text string")).first()["media"])
    rows = [(1, whole), (2, whole[:-70]), (3, b"no media"), (4, None), (5, b""), (5, b"")]
    media = spark.createDataFrame(rows, "doc_id long, media binary")
    found = {(r["doc_id"], r["feature"]) for r in m.media_features(media).collect()}
    assert {d for d, f in found if f == "unreadable"} >= {3} and {d for d, f in found if f is None} == {4}
    assert m.media_features(media.limit(0)).count() == 0 and m.packet_table(media).where("id = 1").count() > 0
