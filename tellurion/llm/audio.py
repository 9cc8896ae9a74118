"""Operator 9: MPEG audio columns.

`write_stream` stores a payload losslessly in an MPEG-1 Layer III stream: an ID3v2 tag with the payload's length, a
frame with the variable-bitrate table (Xing header: frames, bytes, 100 seek points), then mono frames at 48 kHz with a
checksum and empty side information (silence), whose ancillary bytes hold the payload; the last frame takes the
smallest bitrate that fits. `parse_stream` reads streams of MPEG-1/2/2.5 Layers I to III: it parses ID3v2.2 to 2.4 and ID3v1
tags and Xing, Info and VBRI tables, finds frame headers again after junk, verifies checksums of Layer III and of Layer I
frames (those of Layer II cover allocation tables and are not verified), and yields exact durations (in samples, by rate)
and the byte offset of each frame.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts

_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_V1 = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), 3: (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448)}
_V2 = {1: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), 3: (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256)}
#: Header, checksum and side information of a mono MPEG-1 Layer III frame; payload bytes of a full frame.
LEAD, FULL, SAMPLES, HERTZ = 23, 896, 1152, 48000


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@functools.lru_cache(4096)
def frame_crc(protected: bytes) -> int:
    """CRC-16 of a frame over the header's last two bytes and the side information."""
    c = 0xFFFF
    for b in protected:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


@functools.lru_cache(65536)
def read_header(raw: bytes) -> tuple[int, int, int, int, bool, int, int] | None:
    """(version, layer, frame bytes, samples, protected, hertz, side-information bytes) of four header bytes."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, code, bitrate, rate = raw[1] >> 3 & 3, raw[1] >> 1 & 3, raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or code == 0 or bitrate in (0, 15) or rate == 3 or raw[3] & 3 == 2:
        return None
    hertz, kbps, pad = _RATES[version][rate], (_V1 if version == 3 else _V2)[code][bitrate], raw[2] >> 1 & 1
    mono = raw[3] >> 6 == 3
    if code == 3:
        size, samples, side = (12 * kbps * 1000 // hertz + pad) * 4, 384, 0
    elif code == 2:
        size, samples, side = 144 * kbps * 1000 // hertz + pad, 1152, 0
    else:
        samples = 1152 if version == 3 else 576
        size, side = samples // 8 * kbps * 1000 // hertz + pad, (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return version, 4 - code, size, samples, not raw[1] & 1, hertz, side


def _syncsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def _template(index: int) -> bytes:
    head = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
    side = bytes(17)
    return head + frame_crc(head[2:] + side).to_bytes(2, "big") + side


def write_stream(payload: bytes) -> bytes:
    """The MPEG stream that holds `payload`."""
    full, rest = divmod(len(payload), FULL)
    sizes = [3 * k for k in _V1[1]]
    last = next((k for k, n in enumerate(sizes) if k and n - LEAD >= rest), 14) if rest or not full else 0
    body = bytearray()
    if full:
        frames = np.zeros((full, sizes[14]), np.uint8)
        frames[:, :LEAD] = np.frombuffer(_template(14), np.uint8)
        frames[:, LEAD : LEAD + FULL] = np.frombuffer(payload, np.uint8, full * FULL).reshape(full, FULL)
        body += frames.tobytes()
    if last:
        body += (_template(last) + payload[full * FULL :]).ljust(sizes[last], b"\0")
    text = b"\3payload_bytes\0" + str(len(payload)).encode()
    frame = b"TXXX" + _syncsafe(len(text)) + b"\0\0" + text
    tag = b"ID3\4\0\0" + _syncsafe(len(frame)) + frame
    n, total = full + bool(last), len(body) + sizes[3]
    offsets = [sizes[3] + min(k * n // 100, full) * sizes[14] for k in range(100)]
    xing = b"Xing" + (15).to_bytes(4, "big") + n.to_bytes(4, "big") + total.to_bytes(4, "big") + bytes([min(255, o * 256 // total) for o in offsets]) + (0).to_bytes(4, "big")
    return tag + (bytes([0xFF, 0xFB, 3 << 4 | 1 << 2, 0xC0]) + bytes(17) + xing).ljust(sizes[3], b"\0") + bytes(body)


def _plain(raw: bytes, bits: int = 8) -> int:
    """A big-endian number of which each byte holds so many bits."""
    n = 0
    for b in raw:
        n = n << bits | b & (1 << bits) - 1
    return n


def _tag_frames(raw: bytes, version: int, flags: int) -> dict[str, str]:
    """Frames of an ID3v2 tag's body. Version 2 has names and sizes of three bytes, 3 plain sizes, 4 sizes of seven bits a byte."""
    name, head, bits = (3, 6, 8) if version == 2 else (4, 10, 7 if version >= 4 else 8)
    out: dict[str, str] = {}
    if flags & 0x80 and version < 4:  # unsynchronisation: a zero byte follows each 255
        raw = raw.replace(b"\xff\0", b"\xff")
    at = (_plain(raw[:4], bits) + 4 * (version == 3)) if flags & 0x40 and version >= 3 else 0
    while at + head <= len(raw) and raw[at] > 32:
        n = _plain(raw[at + name : at + name + (3 if version == 2 else 4)], bits)
        body = raw[at + head : at + head + n]
        key, coding = raw[at : at + name].decode("latin-1"), {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0] if body else 0, "latin-1")
        text = body[1:].decode(coding, "replace")
        if key in ("TXXX", "TXX") and "\0" in text:
            label, _, text = text.partition("\0")
            key += ":" + label
        out[key] = text.rstrip("\0").removeprefix("\ufeff")
        at += head + n
    return out


def parse_stream(raw: bytes) -> dict:
    """tags, table (of variable bitrates, or None), frames, samples, hertz, crc_checked, crc_bad, junk (bytes skipped),
    offsets (of the audio frames), seconds (each frame's samples by its own rate), payload (ancillary bytes, cut to the tag's length; None without that tag)."""
    at, tags, end = 0, {}, len(raw)
    while raw[at : at + 3] == b"ID3" and at + 10 <= end:
        stop = min(at + 10 + _plain(raw[at + 6 : at + 10], 7), end)
        tags |= _tag_frames(raw[at + 10 : stop], raw[at + 3], raw[at + 5])
        at = stop if stop > at else end
    if end - at >= 128 and raw[end - 128 : end - 125] == b"TAG":
        tags["v1"] = raw[end - 125 : end - 95].rstrip(b"\0 ").decode("latin-1")
        end -= 128
    table, offsets, samples, checked, bad, junk, hertz, data = None, [], 0, 0, 0, 0, 0, []
    synced, view, seconds = False, memoryview(raw), Fraction(0)
    while at + 4 <= end:
        head = read_header(raw[at : at + 4])
        ok = head is not None and at + head[2] <= end
        if ok and not synced:  # a lone header may be chance: the next one must follow, or the end
            after = at + head[2]
            ok = after == end or (after + 4 <= end and read_header(raw[after : after + 4]) is not None)
        if not ok:
            synced, at, junk = False, at + 1, junk + 1
            if (next_at := raw.find(b"\xff", at, end)) > at:
                junk, at = junk + next_at - at, next_at
            elif next_at < 0:
                junk, at = junk + end - at, end
            continue
        version, layer, size, count, protected, hertz, side = head
        first = not offsets and table is None
        spot = at + 4 + 2 * protected + side
        if first and layer == 3 and raw[spot : spot + 4] in (b"Xing", b"Info"):
            flags, p, table = int.from_bytes(raw[spot + 4 : spot + 8], "big"), spot + 8, {}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    table[name], p = int.from_bytes(raw[p : p + 4], "big"), p + 4
            if flags & 4:
                table["toc"], p = list(raw[p : p + 100]), p + 100
        elif first and layer == 3 and raw[(vbri := at + 36) : vbri + 4] == b"VBRI":
            entries, scale, width = _plain(raw[vbri + 18 : vbri + 20]), _plain(raw[vbri + 20 : vbri + 22]), _plain(raw[vbri + 22 : vbri + 24])
            table = {"bytes": _plain(raw[vbri + 10 : vbri + 14]), "frames": _plain(raw[vbri + 14 : vbri + 18])}
            table["toc"] = [_plain(raw[p : p + width]) * scale for p in range(vbri + 26, min(vbri + 26 + entries * width, at + size), max(1, width))]
        else:
            if protected and layer != 2:
                checked += 1
                bad += frame_crc(raw[at + 2 : at + 4] + raw[at + 6 : spot if layer == 3 else at + 6 + (16 if raw[at + 3] >> 6 == 3 else 32)]) != int.from_bytes(raw[at + 4 : at + 6], "big")
            seconds += Fraction(count, hertz)
            offsets.append(at)
            samples += count
            data.append(view[spot : min(spot + FULL, at + size)] if layer == 3 else b"")
        synced, at = True, at + size
    junk += max(0, end - at) if at < end else 0
    n = tags.get("TXXX:payload_bytes", "")
    return {"tags": tags, "table": table, "frames": len(offsets), "samples": samples, "hertz": hertz, "seconds": float(seconds), "crc_checked": checked, "crc_bad": bad, "junk": junk, "offsets": offsets, "payload": b"".join(data)[: int(n)] if n.isdigit() else None}


def encode_media(docs: DataFrame, block: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, n_bytes of the text, `media`. The text's bytes get zero bytes up to a positive multiple of
    `block`, so a null or empty text stores one block of zeros. Null and repeated ids are kept; other columns are not read."""
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def kernel(batch: pa.RecordBatch) -> dict:
        raw = [t.encode() for t in texts(batch)]
        return {"id": batch.column("id"), "n_bytes": [len(r) for r in raw], "media": [write_stream(r.ljust(max(block, -(-len(r) // block) * block), b"\0")) for r in raw]}

    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return map_batches(source, kernel, "id long, n_bytes long, media binary", schema, 256).withColumnRenamed("id", id_col)


def read_media(media: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes"), media_col: str = "media", offsets: bool = True) -> DataFrame:
    """Per row of long columns `keep` and a stream: media_bytes, media_sha256, payload_bytes, payload_sha256, tail_crc32 (last 64
    payload bytes), frames, samples, hertz, duration_s, crc_bad, junk, seek (frame offsets, if `offsets`), feature.
    A null stream counts as an empty one: no frames, and an empty payload."""
    names = ["media_bytes", "payload_bytes", "tail_crc32", "frames", "samples", "hertz", "crc_bad", "junk"]
    fields = [*((k, pa.int64()) for k in [*keep, *names]), ("duration_s", pa.float64()), *((k, pa.string()) for k in ("media_sha256", "payload_sha256", "feature")), *[("seek", pa.list_(pa.int64()))] * offsets]
    kinds = {pa.int64(): "long", pa.float64(): "double", pa.string(): "string"}

    def kernel(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k, _ in fields if k not in keep}
        for raw in batch.column("media").to_pylist():
            raw = raw or b""
            got = parse_stream(raw)
            payload, seek = got["payload"] or b"", got["offsets"]
            table = got["table"] or {}
            out["media_bytes"].append(len(raw))
            out["media_sha256"].append(hashlib.sha256(raw).hexdigest())
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-64:]))
            for k in ("frames", "samples", "hertz", "crc_bad", "junk"):
                out[k].append(got[k])
            out["duration_s"].append(got["seconds"])
            crc = zlib.crc32(np.array(seek, "<i8").tobytes())
            out["feature"].append(f"frames={got['frames']};samples={got['samples']};hz={got['hertz']};vbr={table.get('frames', -1)}/{table.get('bytes', -1)};crc_ok={got['crc_checked'] - got['crc_bad']};junk={got['junk']};seek={crc:08x}")
            if offsets:
                out["seek"].append(seek)
        return out | {k: batch.column(k) for k in keep}

    source = media.select(*[media[k].cast("long").alias(k) for k in keep], media[media_col].alias("media"))
    return map_batches(source, kernel, ", ".join(f"{k} {kinds.get(t, 'array<long>')}" for k, t in fields), pa.schema(fields), 256)
