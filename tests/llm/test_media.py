from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tremorframe.llm import media as M

ROWS = "doc_id long, text string, n_bytes int, media string"


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=400), st.integers(1, 60))
def test_round_trip(data, times):
    payload = M.payload_of(data * times)
    width, height, frames = M.parse(M.encode(payload))
    assert b"".join(f.indices.tobytes() for f in frames) == payload and width == 64


def plain_lzw(data: bytes, bits: int) -> bytes:
    """A decoder that reads one code at a time."""
    clear, out, width, table, last, buffer, held = 1 << bits, b"", bits + 1, {}, None, 0, 0
    for b in data:
        buffer |= b << held
        held += 8
        while held >= width:
            code = buffer & ((1 << width) - 1)
            buffer >>= width
            held -= width
            if code == clear:
                table, width, last = {i: bytes([i]) for i in range(clear)}, bits + 1, None
                free = clear + 2
                continue
            if code == clear + 1:
                return out
            entry = table[code] if code in table else last + last[:1]
            out += entry
            if last is not None and free < 4096:
                table[free] = last + entry[:1]
                free += 1
            if free == 1 << width and width < 12:
                width += 1
            last = entry
    return out


@pytest.mark.parametrize("seed", range(4))
def test_decoder_is_the_plain_one(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(0, [2, 5, 40, 256][seed], 30_000, dtype=np.uint8).tobytes()
    stream = M._packed(np.array(M._lzw_codes(data)))
    assert plain_lzw(stream, 8) == data
    assert M.decode_lzw(stream, 8, len(data)).tobytes() == data


def gif(frames, size=(4, 2), palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)), extra=b""):
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x80 | 1, 0, 0) + bytes(sum(palette, ())) + extra
    for left, top, w, h, delay, disposal, transparent, pixels, own, interlaced in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), delay, transparent or 0) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, (0x80 | 1 if own else 0) | (0x40 if interlaced else 0)) + (bytes(sum(own, ())) if own else b"")
        codes, width, acc, held, body = [4, *sum(([p, 4] for p in pixels), []), 5], 3, 0, 0, b""
        for c in codes:
            acc |= c << held
            held += width
        body = acc.to_bytes((held + 7) // 8, "little")
        out += b"\x02" + M._blocks(body)
    return out + b"\x3b"


def test_palettes_disposal_transparency_and_times():
    own = ((9, 9, 9), (8, 8, 8), (7, 7, 7), (6, 6, 6))
    data = gif(
        [(0, 0, 4, 2, 5, 1, None, [1] * 8, None, False), (1, 0, 2, 1, 7, 2, 0, [2, 0], None, False), (0, 1, 1, 1, 0, 3, None, [3], own, False), (3, 1, 1, 1, 1, 0, None, [3], None, False)],
        extra=b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0",
    )
    width, height, frames = M.parse(data)
    assert [f.delay_ms for f in frames] == [50, 70, 0, 10] and [f.disposal for f in frames] == [1, 2, 3, 0]
    pictures = [c.copy() for c in M.composed(width, height, frames)]
    assert (pictures[0][..., :3] == (255, 0, 0)).all()
    assert pictures[1][0, 1].tolist() == [0, 255, 0, 255] and pictures[1][0, 2].tolist() == [255, 0, 0, 255]
    assert pictures[2][0, 1].tolist() == [0, 0, 0, 0] and pictures[2][1, 0].tolist() == [6, 6, 6, 255]
    assert pictures[3][1, 0].tolist() == [255, 0, 0, 255] and pictures[3][1, 3].tolist() == [0, 0, 255, 255]
    assert M.histogram(pictures[3]).sum() == 6


def test_interlaced_rows():
    rows = [*range(0, 10, 8), *range(4, 10, 8), *range(2, 10, 4), *range(1, 10, 2)]
    data = gif([(0, 0, 1, 10, 0, 0, None, [r % 4 for r in rows], None, True)], size=(1, 10))
    assert M.parse(data)[2][0].indices.ravel().tolist() == [i % 4 for i in range(10)]


@pytest.mark.parametrize("data", [b"", b"GIF89a", b"PNG.........", M.encode(b"\0" * 64)[:-30], M.encode(b"\0" * 64)[:800]])
def test_broken_files(data):
    with pytest.raises(ValueError):
        M.parse(data)


def test_query_rows(spark):
    long = "word é " * 20_000
    rows = [(1, None), (2, ""), (3, "abc"), (4, "x" * 64), (5, long), (6, "abc"), (None, "abc")]
    df = spark.createDataFrame([(i, t, 0, "clash") for i, t in rows], ROWS)
    got = M.read_media(M.store_texts(df), keep=("doc_id", "n_bytes")).collect()
    assert len(got) == 7
    for (i, t), r in zip(rows, sorted(got, key=lambda r: [x[0] for x in rows].index(r["doc_id"])), strict=True):
        payload = M.payload_of((t or "").encode())
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"]) == (i, len((t or "").encode()), len(payload)) and len(payload) % 64 == 0 and payload
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["error"] is None
    by = {r["doc_id"]: r for r in got}
    assert by[3]["media_sha256"] == by[6]["media_sha256"] and by[3]["feature"] == by[6]["feature"] and by[5]["n_frames"] > 1
    frames = M.frames(M.store_texts(df.where("doc_id = 5"))).orderBy("frame").collect()
    assert frames[1]["start_ms"] == 40 and sum(sum(f["histogram"]) for f in frames) >= len(M.payload_of(long.encode()))
    assert [(f["start_ms"], f["delay_ms"], f["histogram"]) for f in by[5]["frames"]] == [(f["start_ms"], f["delay_ms"], f["histogram"]) for f in frames]
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"no gif"))], "doc_id long, media binary")
    assert {r["doc_id"]: r["error"] for r in M.read_media(broken).collect()} == {1: "no media", 2: "not a GIF"}
    assert M.read_media(M.store_texts(df.limit(0))).count() == 0
