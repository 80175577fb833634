"""Media columns: exact round trips against plain versions, files by another writer, shots and clips."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from chronofold.llm import media as M


def test_digests_equal_a_plain_version(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "é😀" * 40, "x" * 64, "x" * 65, "".join(chr(rng.randrange(32, 1000)) for _ in range(300_000)), "x" * 64]
    rows = [(i if i else None, t, i, "clash") for i, t in enumerate(texts)]
    got = M.media_digests(spark.createDataFrame(rows, "doc_id long, text string, raw int, feature string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = by[i or None]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        file = M.write_avi(padded)
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        slow = np.concatenate([M.decode_dc(f).astype(np.uint8).ravel() for f in M.read_avi(file)[1][:2]]).tobytes()
        assert slow[: len(padded)] == padded[: 2 * 1024]
    assert by[4][1:] == by[7][1:]


def foreign(luma, restart):
    """A colour JPEG, 2 x 2 luma blocks a unit, with an AC term in each block and restart markers."""
    h, w = luma.shape
    bits = ""
    scan, unit, pred = b"", 0, [0, 0, 0]

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") if bits else b""

    def block(k, dc):
        d = dc - pred[k]
        pred[k] = dc
        s = abs(d).bit_length()
        value = format(d if d > 0 else d + (1 << s) - 1, f"0{s}b") if s else ""
        return "1" * (8 - s) + "0" + value + "10" + "1" + "0"  # AC: code 10 for run 0, size 1; code 0 for the end

    units = [(y, x) for y in range(0, h, 2) for x in range(0, w, 2)]
    for n, (y, x) in enumerate(units):
        for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)):
            bits += block(0, int(luma[y + a, x + b]) - 128)
        bits += block(1, 3) + block(2, -3)
        if restart and (n + 1) % restart == 0 and n + 1 < len(units):
            scan += flush(bits) + bytes([0xFF, 0xD0 + unit % 8])
            bits, unit, pred = "", unit + 1, [0, 0, 0]
    scan += flush(bits)
    head = b"\xff\xd8" + M._segment(0xDB, b"\0" + b"\x08" * 64) + M._segment(0xC4, b"\0" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
    head += M._segment(0xC4, b"\x10" + bytes([1, 1] + [0] * 14) + b"\0\x01") + (M._segment(0xDD, struct.pack(">H", restart)) if restart else b"")
    head += M._segment(0xC0, struct.pack(">BHHB", 8, h * 8, w * 8, 3) + b"\x01\x22\0\x02\x11\0\x03\x11\0") + M._segment(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0")
    return head + scan + b"\xff\xd9"


def test_the_table_of_categories_covers_the_test_writer():
    assert M._SIZE[255] == 8


@pytest.mark.parametrize("restart", [0, 2])
def test_frames_by_another_writer(restart):
    rng = np.random.default_rng(1)
    luma = rng.integers(0, 256, (4, 6))
    assert (M.decode_dc(foreign(luma, restart)) == luma).all()


def avi(frames, index=True):
    body, idx, at = [b"movi"], [], 4
    for f in frames:
        c = M._chunk(b"00dc", f)
        idx.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(c)
        at += len(c)
    avih = M._chunk(b"LIST", b"hdrl" + M._chunk(b"avih", struct.pack("<14I", 40000, *[0] * 13)))
    return M._chunk(b"RIFF", b"AVI " + avih + M._chunk(b"LIST", b"".join(body)) + (M._chunk(b"idx1", b"".join(idx)) if index else b""))


@pytest.mark.parametrize("index", [True, False])
def test_shots_become_timed_clips(spark, index):
    rng = np.random.default_rng(3)
    frames = [foreign(np.clip(level + rng.integers(-2, 3, (4, 4)), 0, 255), 0) for level, n in ((20, 30), (120, 25), (220, 20)) for _ in range(n)]
    want = [(0, 0.0, 1.2, 30), (1, 1.2, 2.2, 25), (2, 2.2, 3.0, 20)]
    assert [(a, round(b, 6), round(c, 6), d) for a, b, c, d in M.clips(avi(frames, index))] == want
    rows = [(7, bytearray(avi(frames, index))), (7, bytearray(avi(frames, index))), (None, None), (8, bytearray(avi([])))]
    got = M.clip_rows(spark.createDataFrame(rows, "media_id long, data binary")).collect()
    assert sorted((r.media_id, r.clip, round(r.start_s, 6), round(r.end_s, 6), r.frames) for r in got) == sorted((7, *w) for w in want * 2)


def test_broken_files_raise():
    file = M.write_avi(b"x" * 640)
    for bad in (b"", b"RIFFxxxxWAVE", file[:200]):
        with pytest.raises(ValueError):
            M.read_avi(bad)
