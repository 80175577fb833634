"""Operator 4: media columns as AVI motion-JPEG: RIFF indexes, intra frames, shots and timed clips.

A payload (the text's UTF-8 bytes, null as empty, padded with zero bytes up to a positive multiple of
64) is stored losslessly as baseline JPEG frames in an AVI file. A payload byte is the mean of one 8x8
block: the quantiser of the DC term is 8, so DC + 128 is the byte, and AC terms are absent. The DC
Huffman code of category s has 9 - s bits, so that any difference takes 9 bits with its extra bits, and
"end of block" takes one; a frame's scan is then packed and unpacked as whole arrays. Frames by other
writers (AC terms, colour, any Huffman tables, restart markers) go through the general decoder, which
keeps the DC image of the luma.

Reading goes by the file's idx1 index (a walk over the movi list where there is none). Shots start where
the difference of the histograms of two frames exceeds the running mean by three deviations of its shot,
and a floor. The last frame is filled up with zeros; the payload's length is in the INFO list.

Edge cases: empty and null texts give one frame of 64 zero bytes; very long texts are coded ``RUN`` frames at a
time; equal texts give equal rows; rows are independent, so repeated rows, ties and null ids pass through; extra
columns, whatever their names, are ignored; an empty table gives an empty result, a file without frames no clip. A
truncated or foreign file raises ValueError in ``read_avi``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm._util import sliced, table

COLS, MAX_ROWS, FPS, BINS = 64, 16, 25, 16
#: Frames encoded or decoded at a time, which bounds the memory that a long file takes besides its bytes.
RUN = 128
WINDOW, SIGMAS, FLOOR = 12, 3.0, 0.2

#: Zigzag position -> not needed for DC images; the quantiser is 8 for every term.
_SIZE = np.array([int(d).bit_length() for d in range(256)])


def _dc_code_table() -> np.ndarray:
    """9-bit codes of the differences -255..255, shifted left by the 1-bit end of block."""
    d = np.arange(-255, 256)
    s = _SIZE[np.abs(d)]
    prefix = (1 << (9 - s)) - 2  # canonical code of category s: 8 - s ones and a zero
    extra = np.where(d > 0, d, d + (1 << s) - 1)
    return ((prefix << s) | extra) << 1


_CODES = _dc_code_table().astype(np.uint64)
_DIFFS = np.full(1024, 999, np.int32)
_DIFFS[_CODES.astype(np.int64)] = np.arange(-255, 256)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLES = (
    _segment(0xDB, b"\0" + b"\x08" * 64)
    + _segment(0xC4, b"\0" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
    + _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0")
)


def _frame_head(rows: int) -> bytes:
    sof = _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, COLS * 8, 1) + b"\x01\x11\x00")
    return b"\xff\xd8" + _TABLES + sof + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


_HEADS = [b""] + [_frame_head(r) for r in range(1, MAX_ROWS + 1)]


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of samples (frames, rows, COLS)."""
    n, rows, _ = samples.shape
    v = samples.reshape(n, -1).astype(np.int32)
    d = np.empty_like(v)
    d[:, 0] = v[:, 0] - 128
    np.subtract(v[:, 1:], v[:, :-1], out=d[:, 1:])
    c = _CODES[d + 255].reshape(n, -1, 4)
    packed = (c[:, :, 0] << np.uint64(30)) | (c[:, :, 1] << np.uint64(20)) | (c[:, :, 2] << np.uint64(10)) | c[:, :, 3]
    bits = packed.astype(">u8").view(np.uint8).reshape(n, -1, 8)[:, :, 3:].reshape(n, -1)
    head = _HEADS[rows]
    return [b"".join((head, bits[i].tobytes().replace(b"\xff", b"\xff\x00"), b"\xff\xd9")) for i in range(n)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """The payload (a positive multiple of 64 bytes) as an AVI file."""
    rows = min(MAX_ROWS, len(payload) // COLS)
    unit = rows * COLS
    n = -(-len(payload) // unit)
    samples = np.frombuffer(payload + b"\0" * (n * unit - len(payload)), np.uint8).reshape(n, rows, COLS)
    frames = [f for s in range(0, n, RUN) for f in encode_frames(samples[s : s + RUN])]
    w, h = COLS * 8, rows * 8
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1000000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, w, h, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, w, h)
    strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 24, b"MJPG", w * h * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % len(payload)))
    body, index, at = [b"movi"], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(c)
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + hdrl + info + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(id or list type, start of the body, its end) of the chunks in data[at:end]."""
    while at + 8 <= end:
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > end:
            raise ValueError("truncated chunk")
        if name == b"LIST":
            yield data[at + 8 : at + 12], at + 12, at + 8 + size
        else:
            yield name, at + 8, at + 8 + size
        at += 8 + size + (size & 1)


def read_avi(data: bytes) -> tuple[dict, list[bytes]]:
    """({fps, payload_bytes or None}, the JPEG file of each video frame, by the index)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    about, movi, index = {"fps": float(FPS), "payload_bytes": None}, None, None
    for name, a, b in _walk(data, 12, min(len(data), 8 + int.from_bytes(data[4:8], "little"))):
        if name == b"hdrl":
            for sub, x, _ in _walk(data, a, b):
                if sub == b"avih" and (us := int.from_bytes(data[x : x + 4], "little")):
                    about["fps"] = 1e6 / us
        elif name == b"INFO":
            for sub, x, y in _walk(data, a, b):
                if sub == b"ICMT" and data[x : x + 8] == b"payload=":
                    about["payload_bytes"] = int(data[x + 8 : y].rstrip(b"\0"))
        elif name == b"movi":
            movi = (a, b)
        elif name == b"idx1":
            index = (a, b)
    if movi is None:
        raise ValueError("no movi list")
    if index is None:
        return about, [data[a:b] for name, a, b in _walk(data, *movi) if name[2:] in (b"dc", b"db") and b > a]
    frames, base = [], movi[0] - 4
    for name, _, at, size in struct.iter_unpack("<4sIII", data[index[0] : index[1]]):
        if name[2:] in (b"dc", b"db") and size:
            if not frames and data[base + at : base + at + 4] != name:
                base = 0  # offsets from the file's start
            frames.append(data[base + at + 8 : base + at + 8 + size])
    return about, frames


class _Bits:
    def __init__(self, data: bytes):
        self.v, self.n, self.data, self.at = 0, 0, data, 0

    def need(self, k: int) -> None:
        while self.n < k:
            b = self.data[self.at] if self.at < len(self.data) else 0
            self.at += 1
            self.v, self.n = ((self.v << 8) | b) & 0xFFFFFFFFFF, self.n + 8

    def take(self, k: int) -> int:
        if not k:
            return 0
        self.need(k)
        self.n -= k
        return (self.v >> self.n) & ((1 << k) - 1)

    def symbol(self, table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = (code << 1) | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("bad Huffman code")


def _huffman(counts: bytes, symbols: bytes) -> dict:
    table, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def decode_dc(jpeg: bytes) -> np.ndarray:
    """The luma DC image of a baseline JPEG file: one sample for each 8x8 block, as float."""
    at, quant, huff, restart, comps, size = 2, {}, {}, 0, [], (0, 0)
    while True:
        while jpeg[at] == 0xFF and jpeg[at + 1] == 0xFF:
            at += 1
        marker, length = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            size = struct.unpack(">HH", body[1:5])
            comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xDA:
            use = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
        elif 0xC0 < marker < 0xD0 and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
    hmax, vmax = max(c[1] for c in comps), max(c[2] for c in comps)
    across, down = -(-size[1] // (8 * hmax)), -(-size[0] // (8 * vmax))
    h0, v0 = (comps[0][1], comps[0][2])
    if len(comps) == 1:
        h0 = v0 = 1
        across, down = -(-size[1] // 8), -(-size[0] // 8)
    out = np.zeros((down * v0, across * h0))
    end = jpeg.rfind(b"\xff\xd9")
    scan = jpeg[at : end if end >= at else len(jpeg)]
    pieces, start = [], 0
    if restart:
        i = scan.find(b"\xff", 0)
        while i >= 0 and i + 1 < len(scan):
            if 0xD0 <= scan[i + 1] <= 0xD7:
                pieces.append(scan[start:i])
                start = i + 2
            i = scan.find(b"\xff", i + 2)
    pieces.append(scan[start:])
    mcu, total = 0, across * down
    for piece in pieces:
        bits, pred = _Bits(piece.replace(b"\xff\x00", b"\xff")), [0] * len(comps)
        for _ in range(min(restart or total, total - mcu)):
            my, mx = divmod(mcu, across)
            for k, (cid, h, v, q) in enumerate(comps):
                if len(comps) == 1:
                    h = v = 1
                dc, ac = huff[use[cid] >> 4], huff[16 | use[cid] & 15]
                for y in range(v):
                    for x in range(h):
                        s = bits.symbol(dc)
                        e = bits.take(s)
                        pred[k] += e if s and e >> (s - 1) else e - (1 << s) + 1 if s else 0
                        if not k:
                            out[my * v + y, mx * h + x] = pred[0] * quant[q] / 8 + 128
                        i = 1
                        while i < 64:
                            rs = bits.symbol(ac)
                            if rs & 15:
                                bits.take(rs & 15)
                                i += (rs >> 4) + 1
                            elif rs == 0xF0:
                                i += 16
                            else:
                                break
            mcu += 1
    return out


def decode_frames(frames: list[bytes]) -> list[np.ndarray] | np.ndarray:
    """DC images; frames of this module's own form are unpacked together."""
    rows = next((r for r in range(1, MAX_ROWS + 1) if frames and frames[0].startswith(_HEADS[r])), 0)
    head, n = _HEADS[rows], len(frames)
    if rows and all(f.startswith(head) for f in frames):
        raw = [f[len(head) : -2].replace(b"\xff\x00", b"\xff") for f in frames]
        width = rows * COLS // 4 * 5
        if all(len(x) == width for x in raw):
            g = np.frombuffer(b"".join(raw), np.uint8).reshape(n, -1, 5).astype(np.int32)
            d = np.empty((n, rows * COLS // 4, 4), np.int32)
            d[:, :, 0] = (g[:, :, 0] << 2) | (g[:, :, 1] >> 6)
            d[:, :, 1] = ((g[:, :, 1] & 63) << 4) | (g[:, :, 2] >> 4)
            d[:, :, 2] = ((g[:, :, 2] & 15) << 6) | (g[:, :, 3] >> 2)
            d[:, :, 3] = ((g[:, :, 3] & 3) << 8) | g[:, :, 4]
            diff = _DIFFS[d.reshape(n, -1)]
            if (diff < 999).all():
                return (np.cumsum(diff, axis=1, dtype=np.int32) + 128).reshape(n, rows, COLS)
    return [decode_dc(f) for f in frames]


def histograms(images: list[np.ndarray] | np.ndarray) -> np.ndarray:
    """(frames, BINS) shares of luma."""
    if isinstance(images, np.ndarray):
        n = len(images)
        flat = (images.reshape(n, -1) * BINS >> 8) + BINS * np.arange(n)[:, None]
        return np.bincount(flat.ravel(), minlength=n * BINS).reshape(n, BINS) / images[0].size
    return np.array([np.histogram(np.clip(x, 0, 255), BINS, (0, 256))[0] / x.size for x in images])


def shots(hist: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges [first, last] of the shots."""
    diff = np.abs(hist[1:] - hist[:-1]).sum(1).tolist()
    out, first, seen = [], 0, []
    for i, d in enumerate(diff, 1):
        if seen:
            mean = sum(seen) / len(seen)
            dev = (sum((x - mean) ** 2 for x in seen) / len(seen)) ** 0.5
        else:
            mean = dev = 0.0
        if d > max(FLOOR, mean + SIGMAS * dev):
            out.append((first, i - 1))
            first, seen = i, []
        else:
            seen = [*seen[-WINDOW + 1 :], d]
    return [*out, (first, len(hist) - 1)]


def clips(data: bytes) -> list[tuple[int, float, float, int]]:
    """Timed clips (number, start, end in seconds, frames) of an AVI file."""
    about, frames = read_avi(data)
    if not frames:
        return []
    fps = about["fps"]
    hist = np.concatenate([histograms(decode_frames(frames[s : s + RUN])) for s in range(0, len(frames), RUN)])
    return [(k, a / fps, (b + 1) / fps, b - a + 1) for k, (a, b) in enumerate(shots(hist))]


def _digest(raw: bytes) -> tuple:
    payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
    media = write_avi(payload)
    about, frames = read_avi(media)
    back, hist = bytearray(), []
    for s in range(0, len(frames), RUN):
        images = decode_frames(frames[s : s + RUN])
        back += images.astype(np.uint8).tobytes()
        hist.append(histograms(images))
    del back[about["payload_bytes"] :]
    cut = shots(np.concatenate(hist))
    feature = f"{len(frames)} frames; " + ",".join(f"{a}-{b}" for a, b in cut)
    told = ",".join(f"{a / about['fps']:.2f}-{(b + 1) / about['fps']:.2f}" for a, b in cut)
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, told


_OUT = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("clips", pa.string())])


def media_digests(docs: DataFrame) -> DataFrame:
    """One row per document: what is read back from its stored media."""

    def run(batches):
        for b in (part for whole in batches for part in sliced(whole, "raw")):
            rows = [_digest(x or b"") for x in b.column("raw").to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(_OUT)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t.type) for c, t in zip(cols, _OUT, strict=True)]], names=["doc_id", *_OUT.names])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips string"
    return docs.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(run, schema)


def clip_rows(media: DataFrame) -> DataFrame:
    """Timed clip rows of a table (media_id, data): media_id, clip, start_s, end_s, frames."""

    def run(batches):
        for b in (part for whole in batches for part in sliced(whole, "data")):
            got = [(i, *c) for i, data in zip(b.column("media_id").to_pylist(), b.column("data").to_pylist(), strict=True) if data is not None for c in clips(data)]
            cols = list(zip(*got, strict=True)) if got else [()] * 5
            types = (b.schema.field("media_id").type, pa.int32(), pa.float64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["media_id", "clip", "start_s", "end_s", "frames"])

    kind = dict(media.dtypes)["media_id"]
    return media.select("media_id", "data").mapInArrow(run, f"media_id {kind}, clip int, start_s double, end_s double, frames int")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
