import hashlib
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import mpeg_audio as A


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=6000))
def test_round_trip(data):
    payload = A.pad_payload(data)
    assert len(payload) % 64 == 0 and payload[: len(data)] == data and len(payload) > 0
    media = A.write_audio(payload)
    got = A.scan_audio(media)
    assert got["payload"] == payload and got["crc_bad"] == 0 and got["skipped"] == 0
    assert got["samples"] == 1152 * got["frames"] == 1152 * got["table"]["frames"]
    assert got["table"]["bytes"] == len(media) - A.read_tags(media)[1]
    assert got["duration_us"] == got["samples"] * 1_000_000 // 48000


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 128, 192, 383, 384, 385, 448, 576, 640, 704, 832, 895, 896, 897, 1792, 100_000])
def test_sizes(n):
    payload = A.pad_payload(bytes(random.Random(n).randrange(256) for _ in range(n)))
    assert A.scan_audio(A.write_audio(payload))["payload"] == payload


def test_resynchronises_and_reports_bad_checksums():
    payload = A.pad_payload(b"abc " * 2000)
    media = A.write_audio(payload)
    clean = A.scan_audio(media)
    spot = clean["offsets"][2]
    junk = media[:spot] + b"\xff\x00junk\xff\xfb" + media[spot:] + b"TAG" + bytes(125)
    got = A.scan_audio(junk)
    assert got["frames"] == clean["frames"] and got["skipped"] == 8 and got["payload"] == payload
    broken = bytearray(media)
    broken[spot + 8] ^= 1
    assert A.scan_audio(bytes(broken))["crc_bad"] == 1
    for k in (0, 1, 5, 11, 200):
        A.scan_audio(media[:k])
    assert A.scan_audio(b"no audio at all" * 50)["frames"] == 0


def test_other_headers():
    h = A.header(0xFFFB9064)  # MPEG-1 layer III, 128 kbit/s, 44.1 kHz
    assert (h.length, h.rate, h.samples, h.kbps, h.crc, h.side) == (417, 44100, 1152, 128, False, 32)
    assert A.header(0xFFFB9264).length == 418
    assert A.header(0xFFF3_8464).samples == 576  # MPEG-2
    assert A.header(0xFFFFFFFF) is None and A.header(0) is None


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"].encode() for r in df.collect()}
    rows = A.query(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        payload = A.pad_payload(texts[r["doc_id"]])
        media = A.write_audio(payload)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(texts[r["doc_id"]]), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_bytes"] == len(media) and r["media_sha256"] == hashlib.sha256(media).hexdigest()
        assert "crc_bad=0;skipped=0" in r["feature"]


def test_edge_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "é", 1), (3, "é", 1), (None, "x" * 70_000, 1)]
    out = A.query(spark.createDataFrame(rows, "doc_id bigint, text string, media int")).collect()
    by = sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["feature"]) for r in out)
    assert [x[:3] for x in by] == [("1", 0, 64), ("2", 0, 64), ("3", 2, 64), ("3", 2, 64), ("None", 70000, 70016)]
    assert by[2] == by[3]
    assert A.query(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def frame(word, checksum=None, body=b"", n=None):
    """A frame of that header: its checksum over the bits that a plain reading of the layer covers."""
    h = A.header(word)
    raw = bytearray(word.to_bytes(4, "big") + (b"\0\0" if h.crc else b"") + body).ljust(h.length, b"\0")
    if h.crc:
        raw[4:6] = (A.crc16_bits(A.protected(A.np.frombuffer(bytes(raw), A.np.uint8), h)) ^ (checksum or 0)).to_bytes(2, "big")
    return bytes(raw)


def test_checksum_of_bits_equals_that_of_bytes():
    data = bytes(range(40))
    rows = A.np.frombuffer(data, A.np.uint8)
    assert A.crc16_bits(A.np.unpackbits(rows)) == int(A.crc16(rows[None, :])[0])


def test_protected_bits_by_layer():
    zero = A.np.zeros(2000, A.np.uint8)
    bits = lambda word, body=zero: len(A.protected(body, A.header(word))) - 16
    assert bits(0xFFFE_90C4) == 128 and bits(0xFFFE_9004) == 256 and bits(0xFFFE_9054) == 4 * 40  # layer I: mono, stereo, joint from subband 8
    assert bits(0xFFFC_80C4) == 11 * 4 + 12 * 3 + 7 * 2  # layer II, mono, 128 kbit/s at 44.1 kHz
    assert bits(0xFFFC_A404) == 2 * (11 * 4 + 12 * 3 + 4 * 2)  # stereo, 192 kbit/s at 48 kHz
    assert bits(0xFFFC_20C4) == 2 * 4 + 6 * 3 and bits(0xFFFC_28C4) == 2 * 4 + 10 * 3  # 48 kbit/s at 44.1 and 32 kHz
    full = A.np.full(2000, 255, A.np.uint8)
    assert bits(0xFFFC_20C4, full) == 2 * 4 + 6 * 3 + 2 * 8  # a scale factor choice for each subband in use
    assert bits(0xFFFA_90C4) == 8 * 17 and bits(0xFFFA_9004) == 8 * 32


@pytest.mark.parametrize("word", [0xFFFE_90C4, 0xFFFE_9004, 0xFFFE_9054, 0xFFFC_80C4, 0xFFFC_A404, 0xFFFA_9004, 0xFFFA_90C4])
def test_checksums_of_every_layer(word):
    body = bytes(random.Random(word).randrange(256) for _ in range(90))
    good, bad = frame(word, body=body), frame(word, checksum=1, body=body)
    got = A.scan_audio(good * 3 + bad + good * 2)
    assert got["frames"] == 6 and got["crc_bad"] == 1


def test_channel_modes_may_change():
    got = A.scan_audio((frame(0xFFFA_9004, body=b"ab" * 40) + frame(0xFFFA_90C4, body=b"cd" * 40)) * 3)
    assert got["frames"] == 6 and got["crc_bad"] == 0


def test_delay_padding_and_vbri():
    plain = frame(0xFFFB_9064, body=b"x" * 50) * 5
    info = b"Info" + struct.pack(">I", 1) + struct.pack(">I", 5) + b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    got = A.scan_audio(frame(0xFFFB_9064, body=bytes(32) + info) + plain)
    assert got["table"] == {"delay": 576, "padding": 1000, "toc": [], "frames": 5}
    assert got["frames"] == 5 and got["duration_us"] == (5 * 1152 - 1576) * 1_000_000 // 44100
    vbri = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 300, 75, 4321, 5, 3, 2, 2, 1) + struct.pack(">HHH", 10, 20, 30)
    got = A.scan_audio(frame(0xFFFB_9064, body=bytes(32) + vbri) + plain)
    assert got["table"] == {"frames": 5, "bytes": 4321, "toc": [20, 60, 120], "delay": 300, "padding": 0}


def test_tags_before_and_after():
    text = b"\x01" + "Höhe".encode("utf-16")
    tag = b"TIT2" + struct.pack(">I", len(text)) + b"\0\0" + text + b"TPE1" + struct.pack(">I", 4) + b"\0\0" + b"\0abc"
    id3 = b"ID3\x03\0\0" + A.syncsafe(len(tag)) + tag
    item = struct.pack("<II", 5, 0) + b"Genre\0" + b"Jazz!"
    ape = lambda flags: b"APETAGEX" + struct.pack("<IIII", 2000, len(item) + 32, 1, flags) + bytes(8)
    v1 = b"TAG" + b"Old title".ljust(30, b"\0") + b"Someone".ljust(30) + bytes(30) + b"1999" + bytes(31)
    audio = frame(0xFFFB_9064, body=b"x" * 50) * 3
    got = A.scan_audio(id3 + audio + ape(1 << 31 | 1 << 29) + item + ape(1 << 31) + v1)
    assert got["frames"] == 3 and got["skipped"] == 0
    assert got["tags"] == {"TIT2": "Höhe", "TPE1": "abc", "Genre": "Jazz!", "title": "Old title", "artist": "Someone", "year": "1999"}


def test_texts_that_look_like_tags_come_back():
    for k in range(64, 400):
        payload = A.pad_payload(b"x" * k + b"TAG" + b"y" * 200 + b"APETAGEX" + struct.pack("<III", 2000, 40, 1) + bytes(60))
        got = A.scan_audio(A.write_audio(payload))
        assert got["payload"] == payload and got["skipped"] == 0
