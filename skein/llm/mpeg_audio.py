"""Media columns: MPEG audio. Reads streams (tags, frame headers, variable-bitrate tables, checksums) and writes a lossless carrier.

Reading: ID3v2 and APEv2 tags ahead of the audio and ID3v1 after it are skipped over and reported; frame headers of
MPEG 1, 2 and 2.5, layers I to III, are resynchronised by accepting a header only if the next one (or the end of the
audio) stands where its length says; Xing, Info and VBRI tables are parsed; checksums of all three layers are verified (of
layer I over the allocation, of layer II over allocation and scale factor selection, of layer III over the side
information, each with the header's last two bytes). Durations are exact fractions (samples / rate) and seek offsets are the byte positions of all frames. Any bytes can be read: a table
that its frame cuts off is none, and bytes that are no audio give zero frames.

Writing: payload bytes travel as ancillary data of silent layer III frames (MPEG 1, mono, 32 kHz, checksum on), in units
of 192 bytes, at most seven a frame; the bitrate follows the units, so streams are truly variable and carry a Xing table.
Null and empty texts are one unit of blanks. Equal texts give equal bytes. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_slices

UNIT = 192
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_L3V1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
KBPS = {
    (3, 3): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (3, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (3, 1): _L3V1,
    (2, 3): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 1): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SIDE_MONO = 17
#: Bitrate index by units a frame; a private bit tells six units from seven.
INDEX_OF_UNITS = (0, 3, 7, 10, 11, 12, 14, 14)
UNITS_OF_INDEX = {3: 1, 7: 2, 10: 3, 11: 4, 12: 5, 14: 7}


def _crc_table() -> tuple[int, ...]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = ((c << 1) ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1
        out.append(c)
    return tuple(out)


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC[(c >> 8) ^ b]
    return c


def crc16_bits(head: bytes, data: bytes, bits: int) -> int:
    """The checksum of head and the first bits of data."""
    c = crc16(head + data[: bits // 8])
    for k in range(bits & ~7, bits):
        top = (c >> 15) ^ (data[k >> 3] >> (7 - (k & 7)) & 1)
        c = ((c << 1) & 0xFFFF) ^ (0x8005 if top else 0)
    return c


#: Bits of allocation by subband of layer II: (subbands, bits) runs of the tables B.2a to B.2d and that of the lower rates.
LAYER2_BITS = tuple(tuple(n for count, n in runs for _ in range(count)) for runs in (((11, 4), (12, 3), (4, 2)), ((11, 4), (12, 3), (7, 2)), ((2, 4), (6, 3)), ((2, 4), (10, 3)), ((4, 4), (7, 3), (19, 2))))


def layer2_table(version: int, kbps: int, channels: int, rate: int) -> tuple[int, ...]:
    each = kbps // channels
    if version != 3:
        return LAYER2_BITS[4]
    if rate == 48000 and each >= 56 or 56 <= each <= 80:
        return LAYER2_BITS[0]
    if rate != 48000 and each >= 96:
        return LAYER2_BITS[1]
    return LAYER2_BITS[2] if rate != 32000 and each <= 48 else LAYER2_BITS[3]


def checked_bits(b: bytes, at: int, end: int) -> int | None:
    """How many bits behind the checksum of the frame from at to end the checksum covers; None if the frame is too short for them."""
    _, _, rate, version, layer, _, mono, index, _ = frame_header(b, at)
    mode, bound = b[at + 3] >> 6, ((b[at + 3] >> 4 & 3) + 1) * 4
    channels, body = 1 if mono else 2, b[at + 6 : end]
    if layer == 1:
        bits = 8 * ((SIDE_MONO if mono else 32) if version == 3 else (9 if mono else 17))
    elif layer == 3:
        shared = bound if mode == 1 else 32
        bits = 4 * (shared * channels + 32 - shared if channels == 2 else 32)
    else:
        table = layer2_table(version, KBPS[3 if version == 3 else 2, layer][index], channels, rate)
        shared, bits, used, value = min(bound, len(table)) if mode == 1 else len(table), 0, 0, int.from_bytes(body[:48].ljust(48, b"\0"))
        for band, n in enumerate(table):
            for _ in range(channels if band < shared else 1):
                if value >> (384 - bits - n) & ((1 << n) - 1):
                    used += channels if band >= shared else 1
                bits += n
        bits += 2 * used
    return bits if bits <= 8 * len(body) else None


def frame_header(b: bytes, at: int) -> tuple | None:
    """(length, samples, rate, version, layer, crc, mono, bitrate index, private) of the header at a position, or None."""
    if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer, crc = (b[at + 1] >> 3) & 3, (b[at + 1] >> 1) & 3, not b[at + 1] & 1
    index, rate_index, pad = b[at + 2] >> 4, (b[at + 2] >> 2) & 3, (b[at + 2] >> 1) & 1
    if version == 1 or layer == 0 or index in (0, 15) or rate_index == 3:
        return None
    rate = RATES[version][rate_index]
    kbps = KBPS[3 if version == 3 else 2, layer][index]
    if layer == 3:
        samples, length = 384, (12 * kbps * 1000 // rate + pad) * 4
    elif layer == 1 and version != 3:
        samples, length = 576, 72 * kbps * 1000 // rate + pad
    else:
        samples, length = 1152, 144 * kbps * 1000 // rate + pad
    return length, samples, rate, version, layer, crc, b[at + 3] >> 6 == 3, index, b[at + 2] & 1


def parse_tags(b: bytes) -> tuple[dict, int, int]:
    """The tags found, and the bounds of the audio between them."""
    tags, lo, hi = {}, 0, len(b)
    while b[lo : lo + 3] == b"ID3" and lo + 10 <= hi:
        size = (b[lo + 6] & 127) << 21 | (b[lo + 7] & 127) << 14 | (b[lo + 8] & 127) << 7 | b[lo + 9] & 127
        end, at, major = min(hi, lo + 10 + size), lo + 10, b[lo + 3]
        while at + 10 <= end and b[at : at + 4].isalnum():
            n = struct.unpack(">I", b[at + 4 : at + 8])[0]
            if major == 4:
                n = (n >> 24 & 127) << 21 | (n >> 16 & 127) << 14 | (n >> 8 & 127) << 7 | n & 127
            if n == 0 or at + 10 + n > end:
                break
            tags[b[at : at + 4].decode("ascii")] = b[at + 10 : at + 10 + n].lstrip(b"\0\1\2\3").rstrip(b"\0").decode("latin-1")
            at += 10 + n
        lo = lo + 10 + size + (10 if b[lo + 5] & 16 else 0)
    if hi - lo >= 128 and b[hi - 128 : hi - 125] == b"TAG":
        tags["ID3v1"] = b[hi - 125 : hi - 95].rstrip(b"\0 ").decode("latin-1")
        hi -= 128
    if b[lo : lo + 8] == b"APETAGEX" and lo + 32 <= hi:
        lo += 32 + struct.unpack("<I", b[lo + 12 : lo + 16])[0]
    return tags, min(lo, hi), hi


def parse_stream(b: bytes) -> dict:
    """Frames, seek offsets, exact duration, checksums and table of a stream."""
    tags, lo, hi = parse_tags(b)
    offsets, lengths, units, samples, rate, ok, bad, lost, table = [], [], [], 0, 0, 0, 0, 0, None
    at, locked = lo, False
    while at + 4 <= hi:
        h = frame_header(b, at)
        if h is None or at + h[0] > hi or not (locked or at + h[0] == hi or (n := frame_header(b, at + h[0])) and n[2:5] == h[2:5]):
            nxt = b.find(b"\xff", at + 1, hi)
            nxt = hi if nxt < 0 else nxt
            lost += nxt - at
            at, locked = nxt, False
            continue
        length, count, rate, version, layer, crc, mono, index, private = h
        locked = frame_header(b, at + length) is not None or at + length == hi
        side = (SIDE_MONO if mono else 32) if version == 3 else (9 if mono else 17)
        body = at + 4 + 2 * crc
        if crc:
            bits = checked_bits(b, at, at + length)
            good = bits is not None and crc16_bits(b[at + 2 : at + 4], b[at + 6 : at + length], bits) == int.from_bytes(b[at + 4 : at + 6])
            ok, bad = ok + good, bad + (not good)
        if not offsets and table is None and layer == 1:
            table = _table(b[at : at + length], body + side - at)
            if table is not None:
                at += length
                continue
        offsets.append(at)
        lengths.append(length)
        units.append(6 if index == 14 and private else UNITS_OF_INDEX.get(index, 0))
        samples += count
        at += length
    return {
        "tags": tags, "offsets": offsets, "lengths": lengths, "units": units, "samples": samples, "rate": rate, "crc_ok": ok, "crc_bad": bad,
        "skipped": lost, "table": table, "duration": Fraction(samples, rate) if rate else Fraction(0),
    }


def _table(frame: bytes, xing: int) -> dict | None:
    """The table in the first frame, if there is one and the frame holds all that its flags announce."""
    if frame[xing : xing + 4] in (b"Xing", b"Info") and xing + 8 <= len(frame):
        flags, p = int.from_bytes(frame[xing + 4 : xing + 8]), xing + 8
        if p + 4 * (flags & 1) + 2 * (flags & 2) + 25 * (flags & 4) > len(frame):
            return None
        out = {"kind": frame[xing : xing + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], p = int.from_bytes(frame[p : p + 4]), p + 4
        if flags & 4:
            out["toc"] = tuple(frame[p : p + 100])
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 54:
        return {"kind": "VBRI", "bytes": int.from_bytes(frame[46:50]), "frames": int.from_bytes(frame[50:54])}
    return None


def _frame(units: int) -> tuple[bytes, int]:
    """Header, checksum and side information of a frame of so many units, and its whole length."""
    index = INDEX_OF_UNITS[units]
    head = bytes((0xFF, 0xFA, index << 4 | 2 << 2 | (units == 6), 0xC4))
    side = bytes(SIDE_MONO)
    return head + struct.pack(">H", crc16(head[2:] + side)) + side, 144 * _L3V1[index] * 1000 // 32000


FRAMES = tuple(_frame(k) if k else (b"", 0) for k in range(8))
_TITLE = b"TSSE" + struct.pack(">I", 11) + b"\0\0\0skein-8bit"
ID3 = b"ID3\x03\0\0" + bytes((0, 0, 0, len(_TITLE))) + _TITLE
_XING_HEAD = bytes((0xFF, 0xFA, 1 << 4 | 2 << 2, 0xC4))
_XING_HEAD = _XING_HEAD + struct.pack(">H", crc16(_XING_HEAD[2:] + bytes(SIDE_MONO))) + bytes(SIDE_MONO)


def pad(payload: bytes) -> bytes:
    return payload + b" " * (max(UNIT, -(-len(payload) // UNIT) * UNIT) - len(payload))


def encode(payload: bytes) -> bytes:
    """A stream that carries a payload of whole units."""
    parts, sizes, at = [], [], 0
    while at < len(payload):
        k = min(7, (len(payload) - at) // UNIT)
        head, length = FRAMES[k]
        body = payload[at : at + k * UNIT]
        parts.append(head + body + bytes(length - len(head) - len(body)))
        sizes.append(length)
        at += k * UNIT
    total, starts, pos = sum(sizes), [], 0
    for s in sizes:
        starts.append(pos)
        pos += s
    toc = bytes(starts[min(len(starts) - 1, i * len(starts) // 100)] * 256 // total if total else 0 for i in range(100))
    xing = _XING_HEAD + b"Xing" + struct.pack(">III", 7, len(sizes), total + 144) + toc
    return ID3 + xing + bytes(144 - len(xing)) + b"".join(parts)


def decode(b: bytes) -> tuple[bytes, dict]:
    s = parse_stream(b)
    head = 6 + SIDE_MONO
    return b"".join(b[o + head : o + head + k * UNIT] for o, k in zip(s["offsets"], s["units"])), s


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as an MPEG audio stream."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, off in text_slices(batch.column(1)):
                raw = buf.tobytes()
                media = [encode(pad(raw[a:b])) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(off[1:] - off[:-1], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def stream_columns(df: DataFrame, media: str = "media") -> DataFrame:
    """df with a struct `stream`: frames, samples, rate, exact duration as a fraction, seek offsets, checksum counts, table and tags."""
    kind = "frames long, samples long, rate int, duration string, offsets array<long>, crc_ok long, crc_bad long, skipped long, table string, tags map<string,string>"

    @F.pandas_udf(kind)
    def read(col):
        import pandas as pd

        rows = []
        for b in col:
            s = parse_stream(bytes(b) if b is not None else b"")
            rows.append((len(s["offsets"]), s["samples"], s["rate"], str(s["duration"]), s["offsets"], s["crc_ok"], s["crc_bad"], s["skipped"], (s["table"] or {}).get("kind"), s["tags"]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])

    return df.withColumn("stream", read(F.col(media)))


def digests(stored: DataFrame) -> DataFrame:
    """Reads the stored bytes back: checksums of the payload and of the stream, and its features."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "n_bad_crc"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        for batch in batches:
            rows = []
            for i, n, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                b = m.as_py()
                p, s = decode(b)
                feature = f"{len(s['offsets'])} frames, {s['samples']} samples at {s['rate']} Hz, {s['duration']} s, {(s['table'] or {}).get('kind')}, at {','.join(map(str, s['offsets']))}"
                rows.append((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(b), hashlib.sha256(b).hexdigest(), feature, len(s["offsets"]), s["crc_bad"]))
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_bad_crc long")


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
