"""Media columns: texts kept losslessly in MPEG audio files, and a scan of such files.

A payload is laid into the ancillary bytes of MPEG-1 Layer III frames (48 kHz, mono,
with checksum and empty side information), after an ID3v2 tag and a frame with the
variable-bitrate table. The scan takes any bytes: it resynchronises on frame headers,
parses tags (ID3v1, ID3v2 text frames, APEv2) and the table (Xing, Info with its encoder's
delay and padding, or VBRI), verifies the checksums of all three layers, frame by frame,
and gives exact durations (in samples, less delay and padding) and the byte offset of
each frame, to seek to. Free-format frames are not frames.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 64

# Fixed values of the MPEG audio header: kbit/s by (version 1 or not, layer), and Hz by version.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

# Layer II: bits of the allocation of each subband, by table; tables by kbit/s a channel are chosen below.
ALLOCATION = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4, "b": (4,) * 11 + (3,) * 12 + (2,) * 7, "c": (4,) * 2 + (3,) * 6, "d": (4,) * 2 + (3,) * 10, "lsf": (4,) * 4 + (3,) * 7 + (2,) * 19,
}
#: Names of ID3v1's fields: start and length in the last 128 bytes.
V1 = {"title": (3, 30), "artist": (33, 30), "album": (63, 30), "year": (93, 4), "comment": (97, 30)}

SIDE = 17  # bytes of side information of a mono MPEG-1 Layer III frame
HEAD = 4 + 2 + SIDE


class Header:
    """One parsed frame header."""

    __slots__ = ("length", "rate", "samples", "kbps", "crc", "side", "layer", "channels", "bound", "key")


_headers: dict[int, Header | None] = {}


def header(word: int) -> Header | None:
    """The 32-bit header ``word``, or None if it isn't one (free format counts as none)."""
    if word in _headers:
        return _headers[word]
    h = None
    version, layer, bits, rate = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if word >> 21 == 0x7FF and version != 1 and layer != 4 and 0 < bits < 15 and rate != 3:
        h = Header()
        h.layer, h.rate = layer, RATES[version][rate]
        h.kbps = BITRATES[version == 3, min(layer, 3)][bits]
        h.samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
        pad = word >> 9 & 1
        h.length = (12000 * h.kbps // h.rate + pad) * 4 if layer == 1 else h.samples // 8 * 1000 * h.kbps // h.rate + pad
        h.crc = not word >> 16 & 1
        mono = word >> 6 & 3 == 3
        h.channels = 1 if mono else 2
        # Subbands from here on share their allocation (intensity stereo).
        h.bound = (word >> 4 & 3) * 4 + 4 if word >> 6 & 3 == 1 else 32
        h.side = 0 if layer != 3 else (17 if mono else 32) if version == 3 else 9 if mono else 17
        h.key = (version, layer, rate)
    if len(_headers) < 100_000:
        _headers[word] = h
    return h


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 (0x8005, from 0xFFFF) of each row of bytes."""
    if not hasattr(crc16, "table"):
        t = np.arange(256, dtype=np.uint32) << 8
        for _ in range(8):
            t = np.where(t & 0x8000, t << 1 ^ 0x8005, t << 1) & 0xFFFF
        crc16.table = t
    crc = np.full(len(rows), 0xFFFF, np.uint32)
    for k in range(rows.shape[1]):
        crc = (crc << 8 & 0xFF00) ^ crc16.table[crc >> 8 ^ rows[:, k]]
    return crc


def _allocation(h: Header) -> tuple[int, ...]:
    """Layer II's bits a subband, for the frame's rate and kbit/s a channel."""
    if h.key[0] != 3:
        return ALLOCATION["lsf"]
    each = h.kbps // h.channels
    if each < 56:
        return ALLOCATION["d" if h.rate == 32000 else "c"]
    return ALLOCATION["a" if h.rate == 48000 or each <= 80 else "b"]


def protected(frame: np.ndarray, h: Header) -> np.ndarray:
    """The bits that the checksum of a frame with one covers: half the header, then by layer."""
    bits = np.unpackbits(frame)
    head, body = bits[16:32], bits[48:]
    if h.layer == 3:
        return np.concatenate((head, body[: 8 * h.side]))
    if h.layer == 1:
        return np.concatenate((head, body[: 4 * (32 if h.channels == 1 else 32 + h.bound)]))
    at, chosen = 0, 0
    for k, n in enumerate(_allocation(h)):
        shared = k >= h.bound
        for _ in range(1 if shared else h.channels):
            chosen += bool(body[at : at + n].any()) * (h.channels if shared else 1)
            at += n
    return np.concatenate((head, body[: at + 2 * chosen]))


def crc16_bits(bits: np.ndarray) -> int:
    """The same checksum of any number of bits."""
    crc = 0xFFFF
    for b in bits.tolist():
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ b else 0)
    return crc


def bad_checksums(raw: np.ndarray, spots: list[int], heads: list[Header]) -> int:
    """How many of the frames with a checksum it does not fit."""
    bad, by_size = 0, {}
    for i, h in zip(spots, heads, strict=True):
        if h.crc and h.layer == 3:
            by_size.setdefault(h.side, []).append(i)
        elif h.crc:
            bad += crc16_bits(protected(raw[i : i + h.length], h)) != int(raw[i + 4]) << 8 | int(raw[i + 5])
    for n, at in by_size.items():
        at = np.array(at, np.int64)
        rows = raw[at[:, None] + np.concatenate(([2, 3], 6 + np.arange(n)))]
        bad += int((crc16(rows) != (raw[at + 4].astype(np.uint32) << 8 | raw[at + 5])).sum())
    return int(bad)


def _frame_head(index: int) -> bytes:
    """Header, checksum and empty side information of a 48 kHz mono frame of that bitrate index."""
    h = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC4])
    crc = int(crc16(np.frombuffer(h[2:] + bytes(SIDE), np.uint8)[None, :])[0])
    return h + struct.pack(">H", crc) + bytes(SIDE)


def _sizes() -> list[tuple[int, int, bytes]]:
    """(payload bytes, frame bytes, head) of each bitrate, smallest first."""
    if not hasattr(_sizes, "made"):
        out = []
        for i, kbps in enumerate(BITRATES[True, 3]):
            if i and (3 * kbps - HEAD) // UNIT:
                out.append(((3 * kbps - HEAD) // UNIT * UNIT, 3 * kbps, _frame_head(i)))
        _sizes.made = out
    return _sizes.made


def syncsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def pad_payload(data: bytes) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def write_audio(payload: bytes) -> bytes:
    """The payload (a positive multiple of 64 bytes) as a file of MPEG audio frames."""
    sizes = _sizes()
    room, length, head = sizes[-1]
    full = len(payload) // room
    rest = payload[full * room :]
    body = np.zeros((full, length), np.uint8)
    if full:
        body[:, :HEAD] = np.frombuffer(head, np.uint8)
        body[:, HEAD : HEAD + room] = np.frombuffer(payload, np.uint8, full * room).reshape(full, room)
    tail = b""
    if rest:
        _, n, tail_head = next(s for s in sizes if s[0] >= len(rest))
        tail = (tail_head + rest).ljust(n, b"\0")
    frames, size = full + bool(rest), body.size + len(tail)
    # The table frame counts itself in bytes, not in frames.
    first = next(s for s in sizes if s[1] >= HEAD + 4 + 4 + 8 + 100)
    total = size + first[1]
    ends = np.minimum(np.arange(100) * frames // 100, full) * length + first[1]
    toc = bytes((ends * 256 // total).astype(np.uint8))
    table = (first[2] + b"Xing" + struct.pack(">III", 7, frames, total) + toc).ljust(first[1], b"\0")
    text = b"\x03payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + syncsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + syncsafe(len(tag)) + tag + table + body.tobytes() + tail


def read_tags(data: bytes) -> tuple[dict[str, str], int]:
    """The text frames of a leading ID3v2 tag, user ones by their names, and where the audio begins."""
    tags: dict[str, str] = {}
    if len(data) < 10 or data[:3] != b"ID3":
        return tags, 0
    n = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end = min(len(data), 10 + n(data[6:10]))
    at = 10
    while at + 10 <= end and data[at : at + 4].strip(b"\0"):
        size = n(data[at + 4 : at + 8]) if data[3] >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        kind, body = data[at : at + 4], data[at + 10 : min(end, at + 10 + size)]
        if kind[:1] == b"T" and body[:1] in (b"\0", b"\1", b"\2", b"\3"):
            text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0]], "replace")
            name, _, value = text.partition("\0") if kind == b"TXXX" else (kind.decode("latin-1"), "", text)
            tags[name] = value.lstrip("\ufeff").rstrip("\0")
        at += 10 + size
    return tags, end


def read_end_tags(data: bytes) -> tuple[dict[str, str], int]:
    """The fields of an ID3v1 and an APEv2 tag after the audio, and where the audio ends."""
    tags: dict[str, str] = {}
    end = len(data)
    if data[end - 128 : end - 125] == b"TAG" and end >= 128:
        end -= 128
        for name, (at, n) in V1.items():
            value = data[end + at : end + at + n].split(b"\0")[0].decode("latin-1").rstrip()
            if value:
                tags[name] = value
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, count, flags = struct.unpack("<III", data[end - 20 : end - 8])
        at, stop = end - size, end - 32
        whole = size + (32 if flags >> 31 else 0)
        if size >= 32 and whole <= end:
            for _ in range(count):
                if at + 9 > stop:
                    break
                n, kind = struct.unpack("<II", data[at : at + 8])
                cut = data.find(b"\0", at + 8, stop)
                if cut < 0:
                    break
                if kind >> 1 & 3 == 0:  # text
                    tags[data[at + 8 : cut].decode("latin-1")] = data[cut + 1 : min(stop, cut + 1 + n)].decode("utf-8", "replace")
                at = cut + 1 + n
            end -= whole
    return tags, end


def read_table(frame: bytes, h: Header) -> dict | None:
    """The variable-bitrate table that the first frame holds: frames, bytes, toc, and the encoder's delay and padding in samples."""
    word = lambda i: int.from_bytes(frame[i : i + 4], "big")
    half = lambda i: int.from_bytes(frame[i : i + 2], "big")
    if frame[36:40] == b"VBRI":
        n, scale, size = half(54), half(56), half(58)
        entries = [int.from_bytes(frame[62 + k * size : 62 + (k + 1) * size], "big") * scale for k in range(n) if 62 + (k + 1) * size <= len(frame)] if 0 < size <= 4 else []
        return {"frames": word(50), "bytes": word(46), "toc": np.cumsum(entries).tolist() if entries else [], "delay": half(42), "padding": 0}
    mark = 4 + 2 * h.crc + h.side
    if frame[mark : mark + 4] not in (b"Xing", b"Info"):
        return None
    flags, p, table = word(mark + 4), mark + 8, {"delay": 0, "padding": 0, "toc": []}
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            table[name], p = word(p), p + 4
    if flags & 4:
        table["toc"], p = list(frame[p : p + 100]), p + 100
    p += 4 * bool(flags & 8)
    if frame[p : p + 4] in (b"LAME", b"Lavc", b"Lavf"):
        both = int.from_bytes(frame[p + 21 : p + 24], "big")
        table["delay"], table["padding"] = both >> 12, both & 0xFFF
    return table


def scan_audio(data: bytes) -> dict:
    """Frames, durations, tags, table and payload of a file; any bytes are allowed.

    ``offsets``: where each audio frame begins. ``samples``: of all frames; ``duration_us``
    leaves out the encoder's delay and padding. ``skipped``: bytes outside tags and
    frames. A header counts if the frame before ends where it begins, or if another header
    of the same version, layer and rate, or the end of the data, follows its frame. Bytes that hold no frame give no frames.
    """
    tags, at = read_tags(data)
    after_tags, end = read_end_tags(data)
    at = min(at, end)
    spots, heads, skipped, table, key, synced = [], [], 0, None, None, -1
    word = lambda i: int.from_bytes(data[i : i + 4], "big")
    while at + 4 <= end:
        h = header(word(at))
        if h is not None and at == synced and end < at + h.length == len(data):
            after_tags, end = {}, len(data)  # what looks like a tag is the end of a frame
        if h is not None and at + h.length <= end and (key in (None, h.key)):
            after = at + h.length
            follow = header(word(after)) if after + 4 <= end else h
            if follow is not None and follow.key == h.key or at == synced:
                key, synced = h.key, after
                spots.append(at)
                heads.append(h)
                at = after
                continue
        nxt = data.find(b"\xff", at + 1, end)
        skipped += (nxt if nxt >= 0 else end) - at
        at = nxt if nxt >= 0 else end
    skipped += max(0, end - at)
    tags = after_tags | tags
    raw = np.frombuffer(data, np.uint8)
    bad = bad_checksums(raw, spots, heads)
    if spots:
        table = read_table(data[spots[0] : spots[0] + heads[0].length], heads[0])
        if table is not None:
            spots, heads = spots[1:], heads[1:]
    parts = []
    for i, h in zip(spots, heads, strict=True):
        skip = 4 + 2 * h.crc + h.side
        parts.append(data[i + skip : i + skip + (h.length - skip) // UNIT * UNIT])
    payload = b"".join(parts)
    if tags.get("payload_bytes", "").isdigit():
        payload = payload[: int(tags["payload_bytes"])]
    samples = sum(h.samples for h in heads)
    rate = heads[0].rate if heads else 0
    heard = max(0, samples - table["delay"] - table["padding"]) if table else samples
    return {
        "payload": payload, "tags": tags, "table": table, "offsets": spots, "samples": samples, "rate": rate,
        "duration_us": heard * 1_000_000 // rate if rate else 0, "frames": len(spots), "crc_bad": bad, "skipped": skipped,
        "kbps": sorted({h.kbps for h in heads}),
    }


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded, as an audio file.

    A null or empty text is 64 bytes 0. Rows with equal texts get equal files.
    """
    schema = "doc_id bigint, n_bytes bigint, media binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _pieces(batch, 1):
                data = [(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in rows.column(1)]
                media = [write_audio(pad_payload(x)) for x in data]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def scan_media(files: DataFrame) -> DataFrame:
    """``files`` (doc_id, n_bytes, media) with what the scan finds; the payload is read back."""
    schema = "doc_id bigint, n_bytes bigint, media binary, payload binary, frames bigint, samples bigint, rate int, duration_us bigint, crc_bad bigint, skipped bigint, table_frames bigint, toc array<int>, seek_offsets array<bigint>, kbps array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _pieces(batch, 2):
                found = [scan_audio(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in rows.column(2)]
                col = lambda k, t: pa.array([x[k] for x in found], t)
                tables = [x["table"] or {} for x in found]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), rows.column(2), col("payload", pa.binary()), col("frames", pa.int64()), col("samples", pa.int64()), col("rate", pa.int32()), col("duration_us", pa.int64()), col("crc_bad", pa.int64()), col("skipped", pa.int64()),
                     pa.array([x.get("frames") for x in tables], pa.int64()), pa.array([x.get("toc", []) for x in tables], pa.list_(pa.int32())), col("offsets", pa.list_(pa.int64())), col("kbps", pa.list_(pa.int32()))],
                    names=["doc_id", "n_bytes", "media", "payload", "frames", "samples", "rate", "duration_us", "crc_bad", "skipped", "table_frames", "toc", "seek_offsets", "kbps"],
                )

    return files.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("n_bytes").cast("bigint").alias("n_bytes"), "media").mapInArrow(run, schema)


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about half a megabyte of that column."""
    from .common import text_slices

    for i, j in text_slices(batch, batch.schema.names[column]):
        yield batch.slice(i, j - i)


def query(docs: DataFrame) -> DataFrame:
    s = scan_media(store_media(docs))
    feature = F.concat_ws(
        ";", F.concat(F.lit("frames="), "frames"), F.concat(F.lit("samples="), "samples"), F.concat(F.lit("us="), "duration_us"),
        F.concat(F.lit("kbps="), F.concat_ws(",", F.transform("kbps", lambda x: x.cast("string")))), F.concat(F.lit("crc_bad="), "crc_bad"), F.concat(F.lit("skipped="), "skipped"),
        F.concat(F.lit("table="), "table_frames"), F.concat(F.lit("toc="), F.md5(F.concat_ws(",", F.transform("toc", lambda x: x.cast("string"))))),
        F.concat(F.lit("seek="), F.md5(F.concat_ws(",", F.transform("seek_offsets", lambda x: x.cast("string"))))),
    )
    return s.select(
        "doc_id", "n_bytes", F.length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"), F.length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
