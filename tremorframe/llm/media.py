"""Media columns: GIF files stored and read as columns.

``store_texts`` writes each text's bytes as palette indices of an animated GIF
(64 pixels wide, 1024 rows a frame, grey palette, greedy LZW).  ``read_media``
decodes any GIF87a/89a: LZW code streams, global and local palettes,
interlacing, disposal, transparency and frame times.  ``frames`` has one row
for each frame with a colour histogram of the composed picture.

LZW is decoded without a loop over codes: between two clear codes a code's
width depends only on its number, an entry's string is the stretch of output
that starts where the entry's code began, and chains of such references are
resolved by pointer doubling.

Nulls: a null text counts as empty (64 zero bytes); null or broken media give
null columns and the reason in ``error``.  Equal texts give equal values, so
repeated rows and ties do.  An empty table gives no rows; a very long text is a
long run of frames, encoded and read by one task.  Columns besides text or media
and those kept are not looked at, and kept ones may have any name but those of
the result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import map_arrow, text_bytes, widened

WIDTH = 64
FRAME_ROWS = 1024
FRAME_CS = 4
GREY = bytes(v for i in range(256) for v in (i, i, i))


def _lzw_codes(data: bytes) -> list[int]:
    codes, table, free = [256], {}, 258
    emit, get = codes.append, table.get
    prefix = data[0]
    for b in data[1:]:
        key = prefix << 8 | b
        code = get(key)
        if code is not None:
            prefix = code
            continue
        emit(prefix)
        prefix = b
        if free == 4096:
            emit(256)
            table.clear()
            free = 258
        else:
            table[key] = free
            free += 1
    emit(prefix)
    emit(257)
    return codes


def _widths(n: int, bits: int) -> np.ndarray:
    """Width of the n first codes after a clear code."""
    free = (1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    w = np.full(n, bits + 1)
    for k in range(bits + 1, 12):
        w[free >= 1 << k] = k + 1
    return w


def _packed(codes: np.ndarray) -> bytes:
    """Codes of 8-bit samples as a bit stream, least bit first."""
    clear = np.flatnonzero(codes == 256)
    number = np.arange(len(codes)) - np.maximum.accumulate(np.where(codes == 256, np.arange(len(codes)), 0)) - 1
    number[0] = 0
    later = clear[1:]
    number[later] = number[later - 1] + 1
    w = _widths(4100, 8)[number]
    at = np.cumsum(w) - w
    v = codes << (at & 7)
    out = np.zeros((int(at[-1] + w[-1]) >> 3) + 4, np.uint8)
    for lane in range(3):
        got = np.bincount((at >> 3) + lane, (v >> (8 * lane)) & 255, len(out))
        out[: len(got)] += got[: len(out)].astype(np.uint8)
    return out[: (int(at[-1] + w[-1]) + 7) >> 3].tobytes()


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes((len(c),)) + c for i in range(0, len(data), 255) if (c := data[i : i + 255])) + b"\0"


def encode(payload: bytes, delay_cs: int = FRAME_CS) -> bytes:
    """A grey GIF whose indices are the payload, which fills whole rows."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), GREY]
    for top in range(0, rows, FRAME_ROWS):
        part = payload[top * WIDTH : (top + FRAME_ROWS) * WIDTH]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay_cs, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08")
        out.append(_blocks(_packed(np.array(_lzw_codes(part)))))
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    palette: np.ndarray
    indices: np.ndarray


def _doubled_lengths(parent: np.ndarray) -> np.ndarray:
    length, up = np.ones(len(parent), np.int64), parent.copy()
    while (more := up >= 0).any():
        length[more] += length[up[more]]
        up[more] = up[up[more]]
    return length


def decode_lzw(data: bytes, bits: int, size: int) -> np.ndarray:
    """The first ``size`` indices of a code stream (fewer if it ends early)."""
    if not 1 <= bits <= 11:
        raise ValueError(f"LZW code size {bits}")
    clear, total = 1 << bits, len(data) * 8
    b = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int32)
    three = b[:-2] | b[1:-1] << 8 | b[2:] << 16
    out, made, at, window = [], 0, 0, 4200
    while made < size and at < total:
        w = _widths(window, bits)
        off = np.cumsum(w) - w + at
        whole = int(np.searchsorted(off + w, total, "right"))
        w, off = w[:whole], off[:whole]
        c = (three[off >> 3] >> (off & 7)) & ((1 << w) - 1)
        special = np.flatnonzero((c == clear) | (c == clear + 1))
        if not len(special) and whole == window:
            window *= 2
            continue
        n = int(special[0]) if len(special) else whole
        ended = not len(special) or c[n] == clear + 1
        at = int(off[n] + w[n]) if len(special) else total
        window = 4200
        c = c[:n]
        entry = c - clear - 2
        if n and (bad := (entry >= np.arange(n)) | (entry > 4095 - clear - 2)).any():
            raise ValueError(f"LZW code {c[bad.argmax()]} is not in the table")
        if n:
            parent = np.where(entry >= 0, entry, -1)
            length = _doubled_lengths(parent)
            start = np.cumsum(length) - length
            of = np.repeat(np.arange(n), length)
            t = np.arange(len(of))
            source = np.where(parent[of] >= 0, start[parent[of]] + t - start[of], t)
            while not np.array_equal(further := source[source], source):
                source = further
            out.append(c[of[source]].astype(np.uint8))
            made += len(of)
        if ended:
            break
    return np.concatenate(out)[:size] if out else np.zeros(0, np.uint8)


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def parse(data: bytes) -> tuple[int, int, list[Frame]]:
    """Canvas width, height and frames of a GIF."""
    try:
        if data[:6] not in (b"GIF87a", b"GIF89a"):
            raise ValueError("not a GIF")
        width, height, flags = struct.unpack_from("<HHB", data, 6)
        at, common, frames = 13, None, []
        if flags & 0x80:
            common, at = _palette(data, at, flags)
        delay, disposal, transparent = 0, 0, None
        while (kind := data[at]) != 0x3B:
            if kind == 0x21:
                label = data[at + 1]
                body, at = _sub_blocks(data, at + 2)
                if label == 0xF9 and len(body) >= 4:
                    packed, delay_cs, index = struct.unpack_from("<BHB", body)
                    delay, disposal, transparent = 10 * delay_cs, packed >> 2 & 7, index if packed & 1 else None
            elif kind == 0x2C:
                left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
                at += 10
                palette = common
                if flags & 0x80:
                    palette, at = _palette(data, at, flags)
                if palette is None:
                    raise ValueError("no palette")
                bits = data[at]
                body, at = _sub_blocks(data, at + 1)
                index = decode_lzw(body, bits, w * h)
                if len(index) < w * h:
                    raise ValueError(f"frame {len(frames)} has {len(index)} of {w * h} pixels")
                index = index.reshape(h, w)
                if flags & 0x40:
                    rows = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                    straight = np.empty_like(index)
                    straight[rows] = index
                    index = straight
                frames.append(Frame(left, top, w, h, delay, disposal, transparent, palette, index))
                delay, disposal, transparent = 0, 0, None
            else:
                raise ValueError(f"block {kind:#x}")
        return width, height, frames
    except (IndexError, struct.error) as e:
        raise ValueError("the file is cut off") from e


def composed(width: int, height: int, frames: list[Frame]):
    """The canvas (height, width, RGBA) after each frame was drawn."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        h, w = max(0, min(f.height, height - f.top)), max(0, min(f.width, width - f.left))
        area = canvas[f.top : f.top + h, f.left : f.left + w]
        index = f.indices[:h, :w]
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(f.palette), :3] = f.palette
        colours[:, 3] = 255
        if f.transparent is None:
            area[...] = colours[index]
        else:
            drawn = index != f.transparent
            area[drawn] = colours[index[drawn]]
        yield canvas
        if f.disposal == 2:
            area[...] = 0
        elif f.disposal == 3:
            canvas = before


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of 64 colours (two bits a channel) among the opaque pixels."""
    c = canvas >> 6
    bins = c[..., 0] << 4 | c[..., 1] << 2 | c[..., 2]
    return np.bincount(bins[canvas[..., 3] > 0].ravel(), minlength=64)


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % WIDTH or (0 if text else WIDTH))


def store_texts(df: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep..., n_bytes, media: every text as a GIF."""
    rows = df.select(*keep, "text")

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch["text"])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(payload_of(t)) for t in texts], pa.binary())], names=[*keep, "n_bytes", "media"])

    return map_arrow(rows, run, widened(rows.select(*keep).schema, "n_bytes long, media binary"))


def frames(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), media: str = "media") -> DataFrame:
    """A row for each frame of each GIF: number, time, place, rules, histogram."""
    rows = df.select(*keep, media)
    names = ["frame", "start_ms", "delay_ms", "x", "y", "width", "height", "disposal", "transparent", "histogram", "rgba"]
    kinds = [pa.int32(), pa.int64(), *[pa.int32()] * 7, pa.list_(pa.int64()), pa.binary()]

    def run(batches):
        for batch in batches:
            for i, data in enumerate(batch[media].to_pylist()):
                try:
                    width, height, all_frames = parse(data or b"")
                except ValueError:
                    continue
                clock, found = 0, []
                for k, (f, canvas) in enumerate(zip(all_frames, composed(width, height, all_frames), strict=True)):
                    found.append([k, clock, f.delay_ms, f.left, f.top, f.width, f.height, f.disposal, f.transparent, histogram(canvas).tolist(), canvas.tobytes()])
                    clock += f.delay_ms
                own = pa.array([i] * len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch[c].take(own) for c in keep), *(pa.array([r[j] for r in found], kind) for j, kind in enumerate(kinds))], names=[*keep, *names])

    ddl = "frame int, start_ms long, delay_ms int, x int, y int, width int, height int, disposal int, transparent int, histogram array<long>, rgba binary"
    return map_arrow(rows, run, widened(rows.select(*keep).schema, ddl))


def read_media(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), media: str = "media") -> DataFrame:
    """What the stored bytes hold: payload digests, the timed frames with their histograms (64 colours, two bits a channel), and a feature of all."""
    rows = df.select(*keep, media)
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "duration_ms", "feature", "frames", "error"]
    timed = pa.list_(pa.struct([("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("histogram", pa.list_(pa.int64()))]))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), timed, pa.string()]

    def one(data):
        if data is None:
            return [None] * 9 + ["no media"]
        try:
            width, height, all_frames = parse(data)
        except ValueError as e:
            return [None, None, None, len(data), hashlib.sha256(data).hexdigest(), None, None, None, None, str(e)]
        payload = b"".join(f.indices.tobytes() for f in all_frames)
        total, duration, held = np.zeros(64, np.int64), 0, []
        for f, canvas in zip(all_frames, composed(width, height, all_frames), strict=True):
            shown = histogram(canvas)
            part = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
            total += shown if part.shape == canvas.shape else histogram(part)
            held.append({"start_ms": duration, "delay_ms": f.delay_ms, "histogram": shown.tolist()})
            duration += f.delay_ms
        feature = f"{width}x{height};frames={len(all_frames)};ms={duration};colours=" + ",".join(f"{i}:{n}" for i, n in enumerate(total.tolist()) if n)
        return [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), len(all_frames), duration, feature, held, None]

    def run(batches):
        for batch in batches:
            found = [one(data) for data in batch[media].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *(pa.array([r[j] for r in found], kind) for j, kind in enumerate(kinds))], names=[*keep, *names])

    ddl = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames int, duration_ms long, feature string, frames array<struct<start_ms:bigint,delay_ms:int,histogram:array<bigint>>>, error string"
    return map_arrow(rows, run, widened(rows.select(*keep).schema, ddl))
