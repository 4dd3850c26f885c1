"""miniSEED files as a Spark source, and records for fixtures.

``spark.read.format("miniseed")`` (``register``) reads files in parts of some
megabytes, so a file of any size is many tasks; what is asked of headers is
tested before samples are decoded, and records come as Arrow batches.
``read_miniseed`` is the same with a way for stores that only Spark reads.  A
record's length comes from blockette 1000; broken records are skipped a step of
64 bytes at a time.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from fnmatch import fnmatchcase

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import InputPartition

RECORDS = "net string, sta string, loc string, chan string, start_us long, sample_rate double, n int, encoding int, sequence int, samples array<double>"
#: Encodings of blockette 1000.
ASCII, INT16, INT24, INT32, FLOAT32, FLOAT64, STEIM1, STEIM2 = 0, 1, 2, 3, 4, 5, 10, 11
PLAIN = {INT16: ">i2", INT32: ">i4", FLOAT32: ">f4", FLOAT64: ">f8"}
#: Bits and count of the differences of a Steim-2 word by (code, first two bits).
STEIM2_CODES = {(1, None): (8, 4), (2, 1): (30, 1), (2, 2): (15, 2), (2, 3): (10, 3), (3, 0): (6, 5), (3, 1): (5, 6), (3, 2): (4, 7)}
STEIM1_CODES = {1: (8, 4), 2: (16, 2), 3: (32, 1)}
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def _differences(codes: np.ndarray, words: np.ndarray, version: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to seven differences of each word, and how many it has (-1: no such code)."""
    out, count = np.zeros((len(words), 7), np.int64), np.zeros(len(words), np.int64)
    table = {(c, None): v for c, v in STEIM1_CODES.items()} if version == 1 else STEIM2_CODES
    count[codes > 0] = -1
    for (code, high), (bits, n) in table.items():
        hit = np.flatnonzero((codes == code) if high is None else (codes == code) & (words >> 30 == high))
        v = words[hit, None] >> (bits * np.arange(n - 1, -1, -1)) & ((1 << bits) - 1)
        out[hit, :n] = np.where(v >> (bits - 1) & 1, v - (1 << bits), v)
        count[hit] = n
    return out, count


def steim(bodies: list[bytes], sizes: list[int], version: int) -> list[np.ndarray | str]:
    """The samples of each record's Steim frames, all records at once, or what is wrong with it.

    The last sample of a record must equal the stored one.
    """
    frames = [np.frombuffer(b, ">u4", len(b) // 64 * 16).reshape(-1, 16).astype(np.int64) for b in bodies]
    own = np.array([len(f) for f in frames])
    if not own.sum():
        return [np.zeros(0) if not n else f"0 of {n} samples" for n in sizes]
    all_of, begin = np.concatenate(frames), np.cumsum(own) - own
    codes = all_of[:, :1] >> np.arange(28, -1, -2) & 3
    words, heads = all_of[:, 1:], begin[own > 0]
    ends = np.where(words[heads, :2] >> 31, words[heads, :2] - (1 << 32), words[heads, :2])
    codes[heads, :2] = 0
    values, count = _differences(codes.ravel(), words.ravel(), version)
    known = np.maximum(count, 0)
    flat = values[np.arange(7) < known[:, None]]
    # Where each record's differences begin among all, by frames of 15 words.
    at = np.concatenate(([0], np.cumsum(known)))[15 * np.concatenate((begin, [own.sum()]))]
    bad = np.concatenate(([0], np.cumsum(count < 0)))
    out: list[np.ndarray | str] = []
    head = iter(ends.tolist())
    for k, n in enumerate(sizes):
        first, last = next(head) if own[k] else (0, 0)
        d = flat[at[k] : at[k + 1]]
        # As many frames as n samples need.
        per_frame = known[15 * begin[k] : 15 * (begin[k] + own[k])].reshape(-1, 15).sum(1).cumsum()
        used = int(np.searchsorted(per_frame, n)) + 1
        if not n:
            out.append(np.zeros(0))
        elif bad[15 * (begin[k] + min(used, own[k]))] > bad[15 * begin[k]]:
            out.append("a Steim-2 code that is not known")
        elif len(d) < n:
            out.append(f"{len(d)} of {n} samples")
        else:
            x = first + np.concatenate(([0], np.cumsum(d[1:n])))
            out.append(x.astype(float) if x[-1] == last else f"last sample {x[-1]}, stored {last}")
    return out


def decode(data: bytes, encoding: int, n: int) -> np.ndarray:
    if encoding in PLAIN:
        kind = np.dtype(PLAIN[encoding])
        return np.frombuffer(data, kind, min(n, len(data) // kind.itemsize)).astype(float)
    if encoding == INT24:
        b = np.frombuffer(data, np.uint8, 3 * min(n, len(data) // 3)).reshape(-1, 3).astype(np.int32)
        v = b[:, 0] << 16 | b[:, 1] << 8 | b[:, 2]
        return np.where(v >> 23, v - (1 << 24), v).astype(float)
    if encoding in (STEIM1, STEIM2):
        (got,) = steim([data], [n], 1 if encoding == STEIM1 else 2)
        if isinstance(got, str):
            raise ValueError(got)
        return got
    raise ValueError(f"encoding {encoding}")


def rate_of(factor: int, multiplier: int) -> float:
    if not factor or not multiplier:
        return 0.0
    return abs(factor) ** (1 if factor > 0 else -1) * abs(multiplier) ** (1 if multiplier > 0 else -1)


def header(data: bytes, at: int = 0) -> tuple[dict, int]:
    """What the record at a place says, with its body, and its length; ValueError if there is none."""
    head = data[at : at + 48]
    if len(head) < 48 or not head[:6].strip().isdigit() or head[6:7] not in (b"D", b"R", b"Q", b"M"):
        raise ValueError("no record header")
    year, day, hour, minute, second, _, ticks, n, factor, multiplier = struct.unpack_from(">HHBBBBHHhh", head, 20)
    blockettes, begin, place = head[39], *struct.unpack_from(">HH", head, 44)
    encoding, big, length = None, True, 0
    for _ in range(blockettes):
        if not place or at + place + 8 > len(data):
            break
        kind, following = struct.unpack_from(">HH", data, at + place)
        if kind == 1000:
            encoding, order, power = data[at + place + 4 : at + place + 7]
            big, length = order != 0, 1 << power
        place = following
    if encoding is None or not 64 <= length <= 1 << 20 or at + length > len(data) or not big:
        raise ValueError("no usable blockette 1000")
    if not 1 <= day <= 366 or hour > 23 or minute > 59 or second > 60:
        raise ValueError("no usable time")
    codes = {k: head[a:b].decode("ascii", "replace").strip() for k, a, b in (("sta", 8, 13), ("loc", 13, 15), ("chan", 15, 18), ("net", 18, 20))}
    start = datetime(year, 1, 1, hour, minute, tzinfo=UTC) + timedelta(days=day - 1)
    start_us = int((start - EPOCH).total_seconds()) * 1_000_000 + second * 1_000_000 + ticks * 100
    return {**codes, "start_us": start_us, "sample_rate": rate_of(factor, multiplier), "n": n, "encoding": encoding, "sequence": int(head[:6]), "body": data[at + begin : at + length] if n else b""}, length


def records(data: bytes, broken: list[tuple[int, str]] | None = None, begin: int = 0, end: int | None = None, wanted: Callable[[dict], bool] | None = None) -> Iterator[dict]:
    """The records of a file's bytes, in order; Steim frames of all of them are decoded together.

    Where there is no record, or one whose samples cannot be read, the search
    goes on 64 bytes further; broken gets the place and what was wrong of every
    record that had a header.  Only records that begin from begin up to end and
    whose headers are wanted are decoded; those before are gone through by
    their lengths.
    """
    found, at, end = [], 0, len(data) if end is None else end
    while at < end and at + 48 <= len(data):
        try:
            got, length = header(data, at)
        except ValueError:
            at += 64
            continue
        if at >= begin and (wanted is None or wanted(got)):
            found.append((at, length, got))
        at += length
    made: dict[int, np.ndarray | str] = {}
    for kind in (STEIM1, STEIM2):
        own = [(at, r) for at, _, r in found if r["encoding"] == kind]
        made |= dict(zip([at for at, _ in own], steim([r["body"] for _, r in own], [r["n"] for _, r in own], 1 if kind == STEIM1 else 2), strict=True)) if own else {}
    for at, length, r in found:
        body = r.pop("body")
        try:
            samples = made[at] if at in made else decode(body, r["encoding"], r["n"]) if r["n"] else np.zeros(0)
        except ValueError as e:
            samples = str(e)
        if isinstance(samples, str):
            if broken is not None:
                broken.append((at, samples))
            inner: list[tuple[int, str]] = []
            yield from records(data[at + 64 : at + length], inner, wanted=wanted)
            if broken is not None:
                broken += [(at + 64 + k, what) for k, what in inner]
        else:
            yield {**r, "n": len(samples), "samples": samples}


def record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at a place and its length; ValueError if there is none."""
    got, length = header(data, at)
    body = got.pop("body")
    samples = decode(body, got["encoding"], got["n"]) if got["n"] else np.zeros(0)
    return {**got, "n": len(samples), "samples": samples}, length


def _steim1_words(differences: list[int]) -> list[tuple[int, int]]:
    """(code, word) with as many differences a word as fit."""
    out, at = [], 0
    while at < len(differences):
        for code, (bits, count) in STEIM1_CODES.items():
            part = differences[at : at + count]
            if all(-(1 << (bits - 1)) <= d < 1 << (bits - 1) for d in part):
                part = part + [0] * (count - len(part))
                out.append((code, sum((d & ((1 << bits) - 1)) << (bits * (count - 1 - k)) for k, d in enumerate(part))))
                at += count
                break
        else:
            raise ValueError("difference over 32 bits")
    return out


def _steim2_words(differences: list[int]) -> list[tuple[int, int]]:
    order = sorted(STEIM2_CODES.items(), key=lambda x: -x[1][1])
    out, at = [], 0
    while at < len(differences):
        for (code, high), (bits, count) in order:
            part = differences[at : at + count]
            if all(-(1 << (bits - 1)) <= d < 1 << (bits - 1) for d in part):
                part = part + [0] * (count - len(part))
                word = sum((d & ((1 << bits) - 1)) << (bits * (count - 1 - k)) for k, d in enumerate(part))
                out.append((code, word | (high or 0) << 30 if high is not None else word))
                at += count
                break
        else:
            raise ValueError("difference over 30 bits")
    return out


def encode_record(net: str, sta: str, loc: str, chan: str, start: datetime, rate: int, samples, encoding: int = INT32, length: int = 512, sequence: int = 1) -> bytes:
    """One record; ValueError if the samples do not fit."""
    x = np.asarray(samples)
    if encoding in PLAIN:
        body = x.astype(PLAIN[encoding]).tobytes()
    elif encoding == INT24:
        body = b"".join(int(v & 0xFFFFFF).to_bytes(3, "big") for v in x.astype(int).tolist())
    else:
        v = x.astype(int).tolist()
        words = (_steim1_words if encoding == STEIM1 else _steim2_words)([v[0], *np.diff(v).tolist()] if v else [])
        frames, held = [], [(0, v[0] & 0xFFFFFFFF), (0, v[-1] & 0xFFFFFFFF)] if v else []
        for w in words:
            if len(held) == 15:
                frames.append(held)
                held = []
            held.append(w)
        frames.append(held)
        body = b"".join(struct.pack(">16I", sum(c << (28 - 2 * k) for k, (c, _) in enumerate(f)), *(w for _, w in f), *[0] * (15 - len(f))) for f in frames)
    if 64 + len(body) > length:
        raise ValueError(f"{64 + len(body)} bytes in a record of {length}")
    head = f"{sequence:06d}D ".encode() + f"{sta:<5}{loc:<2}{chan:<3}{net:<2}".encode()
    head += struct.pack(">HHBBBBHHhhBBBBiHH", start.year, start.timetuple().tm_yday, start.hour, start.minute, start.second, 0, start.microsecond // 100, len(x), rate, 1, 0, 0, 0, 1, 0, 64, 48)
    head += struct.pack(">HHBBBB", 1000, 0, encoding, 1, length.bit_length() - 1, 0)
    return head.ljust(64, b"\0") + body.ljust(length - 64, b"\0")


def read_miniseed(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the files at path, in the order of each file; ``read_broken`` has the others.

    Files are read in parts by the ``miniseed`` source.  In a store that pyarrow
    does not know they are read whole, by Spark's reader of binary files.
    """
    register(spark)
    try:
        opened(path)
    except Exception:  # noqa: BLE001  pyarrow has several errors for it
        return _read_whole(spark, path)
    return spark.read.format("miniseed").load(path)


def _read_whole(spark: SparkSession, path: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                found = list(records(bytes(content)))
                for i in range(0, len(found), 500):
                    yield pd.DataFrame(found[i : i + 500], columns=[c.split()[0] for c in RECORDS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RECORDS)


def read_broken(spark: SparkSession, path: str) -> DataFrame:
    """file, at, error: records with a header whose samples cannot be read."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                broken: list[tuple[int, str]] = []
                for _ in records(bytes(content), broken):
                    pass
                yield pd.DataFrame([(file, *b) for b in broken], columns=["file", "at", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, at long, error string")


def waveforms(found: DataFrame) -> DataFrame:
    """Records merged into one row for each stretch without gaps."""
    from ..operators.triggers import merged_segments

    return merged_segments(found, ("net", "sta", "loc", "chan"))


def samples(segments: DataFrame) -> DataFrame:
    """stream_id, segment_id, idx, ts_us, value: a row for each sample."""
    name = F.concat_ws(".", "net", "sta", "loc", "chan")
    out = segments.select(name.alias("stream_id"), "segment_id", "start_us", "sample_rate", F.posexplode("samples").alias("idx", "value"))
    return out.select("stream_id", "segment_id", F.col("idx").cast("long").alias("idx"), (F.col("start_us") + (F.col("idx") * 1e6 / F.col("sample_rate")).cast("long")).alias("ts_us"), "value")


def opened(path: str):
    """The file system (local, or any that pyarrow knows by its scheme) and the place in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path)) if "://" in path else (fs.LocalFileSystem(), path)


#: No record is longer, so a part that begins so much earlier finds where records begin.
LONGEST = 1 << 20
@dataclass
class Part(InputPartition):
    """Bytes of a file: the records that begin in them."""

    path: str
    begin: int
    end: int


@dataclass
class Wanted:
    """What is asked of headers: patterns (NET, sta or chan with * and ?; any of several) and a stretch of time that the record has to touch."""

    patterns: dict[str, list[str]]
    from_us: float = -math.inf
    to_us: float = math.inf

    @staticmethod
    def of(options: dict[str, str]) -> Wanted | None:
        given = {c: [x.strip() for x in options[c].split(",")] for c in ("net", "sta", "loc", "chan") if c in options}
        times = {k: float(options[o]) for k, o in (("from_us", "fromus"), ("to_us", "tous")) if o in options}
        return Wanted(given, **times) if given or times else None

    def holds(self, head: dict) -> bool:
        last = head["start_us"] + (head["n"] / head["sample_rate"] * 1e6 if head["sample_rate"] else 0)
        return all(any(fnmatchcase(head[c], p) for p in own) for c, own in self.patterns.items()) and head["start_us"] < self.to_us and last > self.from_us


def part_records(file, part: Part, wanted: Wanted | None = None) -> Iterator[dict]:
    """The records that begin in a part of an open file.

    Records are as long as their headers say, so the places where they begin are
    those of a walk through the file; a walk from LONGEST earlier meets them.
    """
    first = max(0, part.begin - LONGEST)
    file.seek(first)
    data = file.read(part.end + LONGEST - first)
    yield from records(data, None, part.begin - first, part.end - first, wanted and wanted.holds)


def register(spark: SparkSession) -> None:
    """spark.read.format("miniseed").load(path): a partition for each splitBytes (16 MB) of each file; path may have a pattern in its last part.

    Options net, sta, loc and chan (patterns, separated by commas), fromUs and
    toUs are tested on headers: samples of other records are not decoded, and
    nothing is looked for inside of them.  (Spark's own push-down of filters keeps
    those of one query for the next one on the same frame, so it is not used.)
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader

    class Reader(DataSourceReader):
        def __init__(self, where: str, split: int, wanted: Wanted | None) -> None:
            self.where, self.split, self.wanted = where, max(64, split // 64 * 64), wanted

        def partitions(self):
            from pyarrow import fs

            system, base = opened(self.where)
            if system.get_file_info(base).type == fs.FileType.File:
                files = [system.get_file_info(base)]
            else:
                folder, _, pattern = (base, "", "*") if system.get_file_info(base).type == fs.FileType.Directory else base.rpartition("/")
                listed = system.get_file_info(fs.FileSelector(folder, recursive=True))
                files = [f for f in sorted(listed, key=lambda f: f.path) if f.type == fs.FileType.File and fnmatchcase(f.base_name, pattern)]
            return [Part(f.path, a, min(f.size, a + self.split)) for f in files for a in range(0, f.size, self.split)]

        def read(self, partition):
            # Spark asks for one part where there is none.
            if not isinstance(partition, Part):
                return
            held = []
            with opened(self.where)[0].open_input_file(partition.path) as f:
                for r in part_records(f, partition, self.wanted):
                    held.append(r)
                    if len(held) == 500:
                        yield _batch(held)
                        held = []
            if held:
                yield _batch(held)

    class MiniSeed(DataSource):
        @classmethod
        def name(cls) -> str:
            return "miniseed"

        def schema(self) -> str:
            return RECORDS

        def reader(self, schema):
            options = {k.lower(): v for k, v in self.options.items()}
            return Reader(options["path"], int(options.get("splitbytes", str(16 << 20))), Wanted.of(options))

    spark.dataSource.register(MiniSeed)


def _batch(found: list[dict]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    columns = [c.split() for c in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[name] for r in found], kinds[kind]) for name, kind in columns], names=[name for name, _ in columns])
