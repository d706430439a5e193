"""MPEG audio columns: bytes stored in the frames of an MPEG-1 Layer III stream, and streams read frame by frame.

The writer puts a payload into the ancillary part of silent, CRC-protected frames, behind an ID3v2 tag and a frame with
a variable-bitrate table. The reader takes any MPEG audio: it parses tags, resynchronises on frame headers, reads the
table (Xing, Info or VBRI), verifies the checksums of Layers I and III (those of Layer II cover bits that further
tables of the format place, and are not verified), and gives exact durations and frame offsets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import added, empty_text, ready, slices

# Fixed values of the format: bit rates in kbit/s by (version 1 or 2, layer), sample rates in Hz by version.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}
BLOCK = 64
RATE = 32000
#: Bytes of a mono frame before its ancillary part: header, checksum, side information.
HEAD, SIDE = 4 + 2 + 17, 17


def _crc_table() -> tuple[int, ...]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return tuple(out)


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


def header(data: bytes, at: int) -> tuple[float, int, int, int, int, int, bool] | None:
    """(version, layer, bytes, samples, rate, channels, protected) of the frame header at a place, if there is one."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b, c, d = data[at + 1], data[at + 2], data[at + 3]
    version = {0: 2.5, 2: 2, 3: 1}.get(b >> 3 & 3)
    layer = 4 - (b >> 1 & 3)
    index, rate_index = c >> 4, c >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or rate_index == 3:
        return None
    family = (1 if version == 1 else 2, layer)
    rate, bits, samples, padding = RATES[version][rate_index], BITRATES[family][index] * 1000, SAMPLES[family], c >> 1 & 1
    size = (12 * bits // rate + padding) * 4 if layer == 1 else samples // 8 * bits // rate + padding
    return version, layer, size, samples, rate, 1 if d >> 6 == 3 else 2, not b & 1


_INDEX = {144 * kbps * 1000 // RATE: i for i, kbps in enumerate(BITRATES[1, 3]) if kbps}
_SIZES = sorted(_INDEX)


def _frame(chunk: bytes) -> bytes:
    size = next(s for s in _SIZES if s - HEAD >= len(chunk))
    tail = bytes([_INDEX[size] << 4 | 2 << 2, 0xC0])
    side = bytes(SIDE)
    return b"\xff\xfa" + tail + struct.pack(">H", crc16(tail + side)) + side + chunk + bytes(size - HEAD - len(chunk))


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def write_stream(payload: bytes, n_bytes: int) -> bytes:
    """The stream of a payload; its tag tells the payload's bytes and how many of them are not padding."""
    most = _SIZES[-1] - HEAD
    frames = [_frame(payload[i : i + most]) for i in range(0, len(payload), most)]
    text = b"\x00payload\x00" + f"{len(payload)}/{n_bytes}".encode()
    body = b"TXXX" + _syncsafe(len(text)) + b"\x00\x00" + text
    tag = b"ID3\x04\x00\x00" + _syncsafe(len(body)) + body
    ends = [0]
    for f in frames:
        ends.append(ends[-1] + len(f))
    toc = bytes(min(255, 256 * ends[i * len(frames) // 100] // max(1, ends[-1])) for i in range(100))
    first = b"\xff\xfb" + bytes([_INDEX[288] << 4 | 2 << 2, 0xC0]) + bytes(SIDE) + b"Xing" + struct.pack(">III", 15, len(frames), ends[-1]) + toc + struct.pack(">I", 0)
    return tag + first + bytes(288 - len(first)) + b"".join(frames)


def _tags(data: bytes) -> tuple[int, dict[str, bytes]]:
    """Where the ID3v2 tag at the front ends, and its frames by name."""
    if len(data) < 10 or data[:3] != b"ID3":
        return 0, {}
    safe = lambda at: sum((data[at + i] & 127) << s for i, s in enumerate((21, 14, 7, 0)))
    major = data[3]
    end = min(len(data), 10 + safe(6))
    name, head = (3, 6) if major == 2 else (4, 10)
    found, k = {}, 10
    while k + head <= end and data[k] != 0:
        # Version 4 has 7 bits in each byte of a frame's size, the older ones have 8.
        n = safe(k + 4) if major >= 4 else int.from_bytes(data[k + name : k + name + (3 if major == 2 else 4)], "big")
        found[data[k : k + name].decode("latin-1")] = data[k + head : min(k + head + n, end)]
        k += head + n
    return end, found


def _table(data: bytes, at: int, side: int) -> dict | None:
    """The variable-bitrate table in the frame at a place: Xing or Info behind the side information, VBRI at a fixed place."""
    k = at + 4 + side
    if data[k : k + 4] in (b"Xing", b"Info") and k + 8 <= len(data):
        flags, k, out = struct.unpack(">I", data[k + 4 : k + 8])[0], k + 8, {}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit and k + 4 <= len(data):
                out[name] = struct.unpack(">I", data[k : k + 4])[0]
                k += 4
        return out | {"toc": data[k : k + 100] if flags & 4 else b""}
    k = at + 36
    if data[k : k + 4] == b"VBRI" and k + 26 <= len(data):
        size, frames, entries, scale, width = struct.unpack(">IIHHH", data[k + 10 : k + 24])
        raw = data[k + 26 : k + 26 + entries * width]
        return {"frames": frames, "bytes": size, "toc": raw, "steps": [scale * int.from_bytes(raw[i : i + width], "big") for i in range(0, len(raw), width)] if width else []}
    return None


def _checked(data: bytes, at: int, layer: int, channels: int, side: int) -> bool | None:
    """Whether a protected frame's checksum is right; None for Layer II, whose protected bits depend on more tables."""
    if layer == 3:
        covered = data[at + 6 : at + 6 + side]
    elif layer == 1:
        mode = data[at + 3] >> 6
        bound = 4 * ((data[at + 3] >> 4 & 3) + 1) if mode == 1 else 32
        covered = data[at + 6 : at + 6 + (16 if channels == 1 else (32 + bound) // 2)]
    else:
        return None
    return crc16(data[at + 2 : at + 4] + covered) == int.from_bytes(data[at + 4 : at + 6], "big")


def read_stream(data: bytes) -> dict:
    """What a stream has: tags, table, frames with offsets, checksums, duration, and the payload of our own writer.

    An ID3v1 tag is only taken where the frames leave off 128 bytes before the end: what frames hold may look like one.
    The payload is None where the frames hold less than the tag tells.
    """
    end = len(data)
    at, tags = _tags(data)
    offsets, parts, samples, rate, skipped, resyncs, bad, good, rates, table = [], [], 0, 0, 0, 0, 0, 0, set(), None
    sure, kind = True, None
    while at < end:
        h = header(data, at)
        if h is None and end - at == 128 and data[at : at + 3] == b"TAG":
            tags["TAG"] = data[at + 3 :]
            break
        # A header that differs from the stream's own in version, layer, rate or channels is chance.
        odd = h is not None and kind is not None and (h[0], h[1], h[4], h[5]) != kind
        if h is None or odd or at + h[2] > end or not sure and at + h[2] < end and header(data, at + h[2]) is None:
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            if at < end - 128 < nxt and data[end - 128 : end - 125] == b"TAG":
                nxt = end - 128
            skipped += nxt - at
            resyncs += sure
            at, sure = nxt, False
            continue
        sure = True
        version, layer, size, n, rate, channels, protected = h
        kind = kind or (version, layer, rate, channels)
        side = (17 if channels == 1 else 32) if version == 1 else (9 if channels == 1 else 17)
        head = 4 + 2 * protected + side
        if table is None and not offsets and layer == 3:
            table = _table(data, at, side)
            if table is not None:
                at += size
                continue
        if protected:
            ok = _checked(data, at, layer, channels, side)
            good, bad = good + (ok is True), bad + (ok is False)
        offsets.append(at)
        parts.append(data[at + head : at + size] if layer == 3 else b"")
        samples += n
        rates.add(data[at + 2] >> 4)
        at += size
    size, used = 0, 0
    if tags.get("TXXX", b"").startswith(b"\x00payload\x00"):
        size, used = (int(x) for x in tags["TXXX"][9:].split(b"/"))
    return {
        "offsets": offsets, "samples": samples, "rate": rate, "skipped": skipped, "resyncs": resyncs, "crc_good": good, "crc_bad": bad, "vbr": len(rates) > 1, "table": table,
        "tags": sorted(tags), "payload": b"".join(parts)[:size] if size <= sum(map(len, parts)) else None, "n_bytes": used,
    }


def padded(text: bytes) -> bytes:
    """A text and bytes 0 up to a positive multiple of BLOCK."""
    return text + bytes(max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def store(docs: DataFrame, text_col: str = "text", into: str = "media") -> DataFrame:
    """docs with one more binary column `into`: the stream of each whole text; null counts as the empty text.

    A column named `into` that docs already has is replaced; other columns and rows pass through.
    """
    ready(docs.sparkSession)
    kept = [c for c in docs.columns if c != into]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text"):
                out = [write_stream(padded(b := t.encode()), len(b)) for t in part.column("__text").to_pylist()]
                yield [*part.columns[:-1], pa.array(out, pa.binary())]

    return added(docs, kept, empty_text(f"`{text_col}`"), [(into, "binary")], run)


READ = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_s double, seek_offsets array<long>"


def describe(rows: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, ...READ): what each stream holds. A null stream counts as an empty one: no frames, no payload.

    A stream whose frames hold less than its tag tells has a null payload size and digests.
    """
    ready(rows.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for data in batch.column("media").to_pylist():
                data = data or b""
                x = read_stream(data)
                p, seek = x["payload"], struct.pack(f"<{len(x['offsets'])}Q", *x["offsets"])
                t = x["table"] or {}
                feature = f"frames={len(x['offsets'])};samples={x['samples']};rate={x['rate']};vbr={int(x['vbr'])};table={t.get('frames', 0)}/{t.get('bytes', 0)};crc={x['crc_good']}/{x['crc_bad']};resyncs={x['resyncs']};skipped={x['skipped']};tags={'+'.join(x['tags'])};seek={zlib.crc32(seek):08x}"
                told = (None, None, None) if p is None else (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]))
                out.append((x["n_bytes"], *told, len(data), hashlib.sha256(data).hexdigest(), feature, x["samples"] / x["rate"] if x["rate"] else 0.0, x["offsets"]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 9
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())]
            names = [x.split()[0] for x in READ.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, f"doc_id long, {READ}")
