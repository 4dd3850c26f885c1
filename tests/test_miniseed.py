from __future__ import annotations

import socket
import threading
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tremorframe.sources import miniseed as M
from tremorframe.sources import seedlink

START = datetime(2020, 3, 1, 12, 30, 5, 250000, tzinfo=UTC)
START_US = int(START.timestamp() * 1e6)


def rec(samples, encoding, length=4096, chan="BHZ", start=START, sequence=1, rate=20):
    return M.encode_record("XX", "ABC", "00", chan, start, rate, samples, encoding, length, sequence)


@pytest.mark.parametrize("encoding", [M.INT16, M.INT24, M.INT32, M.FLOAT32, M.FLOAT64, M.STEIM1, M.STEIM2])
def test_round_trip(encoding):
    x = np.cumsum(np.random.default_rng(5).integers(-300, 300, 150))
    (got,) = M.records(rec(x, encoding))
    assert (got["net"], got["sta"], got["loc"], got["chan"], got["start_us"], got["sample_rate"]) == ("XX", "ABC", "00", "BHZ", START_US, 20.0)
    assert np.array_equal(got["samples"], x)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(1 << 28), 1 << 28), min_size=1, max_size=60), st.sampled_from([M.STEIM1, M.STEIM2]))
def test_steim_any_values(values, encoding):
    try:
        data = rec(values, encoding)
    except ValueError:
        return
    (got,) = M.records(data)
    assert got["samples"].tolist() == values


def test_small_records_corruption_and_rates():
    a, b = rec(range(50), M.INT32, 512), rec(range(50, 100), M.INT32, 512, sequence=2)
    found = list(M.records(a + b"garbage!" * 8 + b))
    assert [r["sequence"] for r in found] == [1, 2]
    assert not list(M.records(b"\0" * 600)) and not list(M.records(b""))
    assert [M.rate_of(*x) for x in ((20, 1), (-10, 1), (10, -2), (0, 1))] == [20.0, 0.1, 5.0, 0.0]
    broken = bytearray(rec(range(40), M.STEIM1, 512))
    broken[64 + 8] ^= 1
    assert not list(M.records(bytes(broken)))


def test_broken_records_are_told(spark, tmp_path):
    good, bad = rec(range(40), M.STEIM2, 512), bytearray(rec(range(40), M.STEIM1, 512, sequence=2))
    bad[64 + 8] ^= 1
    short = bytearray(rec(range(40), M.STEIM2, 512, sequence=3))
    short[30:32] = (400).to_bytes(2, "big")
    (tmp_path / "a.mseed").write_bytes(good + bytes(bad) + good + bytes(short) + b"\0" * 100)
    assert [r["n"] for r in M.read_miniseed(spark, str(tmp_path)).collect()] == [40, 40]
    got = M.read_broken(spark, str(tmp_path)).orderBy("at").collect()
    assert [r["at"] for r in got] == [512, 1536] and "stored" in got[0]["error"] and "of 400" in got[1]["error"]


def test_many_records_decode_together():
    rng = np.random.default_rng(8)
    made = [np.cumsum(rng.integers(-(1 << k), 1 << k, rng.integers(1, 90))) for k in range(3, 15) for _ in range(4)]
    data = b"".join(rec(x, M.STEIM1 if i % 2 else M.STEIM2, 1024, sequence=i % 999 + 1) for i, x in enumerate(made))
    got = list(M.records(data))
    assert len(got) == len(made) and all(np.array_equal(g["samples"], x) for g, x in zip(got, made, strict=True))


def test_files_merge_and_gaps(spark, tmp_path):
    later = datetime(2020, 3, 1, 12, 30, 7, 750000, tzinfo=UTC)
    gap = datetime(2020, 3, 1, 12, 31, tzinfo=UTC)
    data = rec(range(50, 90), M.STEIM2, 512, start=later, sequence=2) + rec(range(50), M.INT32, 512) + rec([7, 8], M.INT16, 256, start=gap, sequence=3)
    (tmp_path / "a.mseed").write_bytes(data)
    rows = M.waveforms(M.read_miniseed(spark, str(tmp_path))).orderBy("segment_id").collect()
    assert [len(r["samples"]) for r in rows] == [90, 2]
    assert rows[0]["samples"] == [float(i) for i in range(90)] and rows[0]["start_us"] == START_US
    flat = M.samples(M.waveforms(M.read_miniseed(spark, str(tmp_path))))
    assert flat.count() == 92 and flat.where("idx = 1 and segment_id = 1").first()["ts_us"] == START_US + 50_000
    M.register(spark)
    for path in (str(tmp_path), f"file://{tmp_path}", f"{tmp_path}/*.mseed", f"{tmp_path}/a.mseed"):
        assert spark.read.format("miniseed").load(path).count() == 3
    assert spark.read.format("miniseed").load(f"{tmp_path}/*.other").count() == 0


def mixed(n: int, seed: int = 3) -> bytes:
    """Records of several lengths, encodings, stations and times, with rubbish and a broken one between them."""
    r, out = np.random.default_rng(seed), []
    for k in range(n):
        x = np.cumsum(r.integers(-50, 50, int(r.integers(1, 60))))
        out.append(rec(x, int(r.choice([M.STEIM1, M.STEIM2, M.INT32])), int(r.choice([512, 1024, 4096])), str(r.choice(["BHZ", "BHN"])), START + timedelta(seconds=10 * k), k + 1))
        if k % 7 == 3:
            out.append(bytes(r.integers(0, 256, 64 * int(r.integers(1, 9)), dtype=np.uint8)))
        if k % 11 == 5:
            broken = bytearray(rec(range(30), M.STEIM2, 512))
            broken[64 + 8 : 64 + 12] = b"\x7f\x00\x00\x01"
            out.append(bytes(broken))
    return b"".join(out)


def rows_of(found):
    return [(r["chan"], r["start_us"], r["n"], r["encoding"], r["sequence"], list(r["samples"])) for r in found]


@pytest.mark.parametrize("split", [64, 640, 5000, 1 << 24])
def test_parts_of_a_file_have_all_its_records(tmp_path, split):
    """Whatever the parts, each record comes once and in order; with a filter, those that pass it."""
    data = mixed(80)
    path = tmp_path / "a.mseed"
    path.write_bytes(data)
    want = rows_of(M.records(data))
    wanted = M.Wanted.of({"chan": "XX?, *Z", "fromus": str(START_US + 200_500_000)})
    got, some = [], []
    with open(path, "rb") as f:
        for a in range(0, len(data), split):
            got += rows_of(M.part_records(f, M.Part(str(path), a, min(len(data), a + split))))
            some += rows_of(M.part_records(f, M.Part(str(path), a, min(len(data), a + split)), wanted))
    assert got == want and len(want) >= 80
    assert some == [w for w in want if w[0] == "BHZ" and w[1] + w[2] * 50_000 > START_US + 200_500_000] and len(some) < len(want)


def test_parts_far_from_the_beginning(tmp_path, monkeypatch):
    monkeypatch.setattr(M, "LONGEST", 4096)
    data = mixed(300, 5)
    path = tmp_path / "b.mseed"
    path.write_bytes(data)
    with open(path, "rb") as f:
        got = [x for a in range(0, len(data), 6400) for x in rows_of(M.part_records(f, M.Part("b", a, min(len(data), a + 6400))))]
    assert got == rows_of(M.records(data))


def test_a_filter_decodes_its_records_only(monkeypatch):
    seen = []
    plain = M.steim
    monkeypatch.setattr(M, "steim", lambda bodies, counts, version: seen.append(len(bodies)) or plain(bodies, counts, version))
    data = b"".join(rec(range(20), M.STEIM2, 512, chan=c, sequence=k + 1) for k, c in enumerate(["BHZ"] + ["BHN"] * 30))
    assert len(list(M.records(data, wanted=M.Wanted.of({"chan": "x,BHZ"}).holds))) == 1 and sum(seen) == 1


def test_one_file_is_many_tasks(spark, tmp_path):
    data = mixed(60)
    (tmp_path / "a.mseed").write_bytes(data)
    M.register(spark)
    df = spark.read.format("miniseed").option("splitBytes", "6400").load(str(tmp_path / "a.mseed"))
    assert df.rdd.getNumPartitions() == -(-len(data) // 6400)
    assert sorted(rows_of(df.collect())) == sorted(rows_of(M.records(data)))
    late = START_US + 300_000_000
    some = spark.read.format("miniseed").options(splitBytes="6400", chan="BHZ,XXX", sta="A*", fromUs=str(late)).load(str(tmp_path))
    want = sorted(w for w in rows_of(M.records(data)) if w[0] == "BHZ" and w[1] + w[2] * 50_000 > late)
    assert sorted(rows_of(some.collect())) == want and want and some.where("n > 5").count() == sum(w[2] > 5 for w in want)
    assert spark.read.format("miniseed").options(toUs=str(START_US)).load(str(tmp_path)).count() == 0
    # One frame with several filters.
    assert df.where("sta = 'none'").count() == 0 and df.where("chan = 'BHN'").count() == sum(w[0] == "BHN" for w in rows_of(M.records(data)))


def test_seedlink_recording(spark, tmp_path):
    path = tmp_path / "packets"
    path.write_bytes(b"".join(seedlink.frame(i, rec(range(10 * i, 10 * i + 10), M.INT32, 512, sequence=i + 1)) for i in range(7)))
    seedlink.register(spark)
    stream = spark.readStream.format("seedlink").option("path", str(path)).option("packetsPerTask", "3").load()
    q = stream.writeStream.format("memory").queryName("packets").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.sql("select number, n, samples from packets order by number").collect()
    assert [r["number"] for r in got] == list(range(7)) and got[3]["samples"] == [float(i) for i in range(30, 40)]


class Server:
    """A scripted SeedLink server: packets by station, HELLO, CAT, INFO STATIONS, STATION, SELECT, FETCH, END; may break connections."""

    def __init__(self):
        self.packets, self.breaks, self.asked = {}, 0, []
        self.socket = socket.create_server(("127.0.0.1", 0))
        self.port = self.socket.getsockname()[1]
        threading.Thread(target=self._accept, daemon=True).start()

    def add(self, station, numbers):
        for k in numbers:
            self.packets.setdefault(station, []).append((k % (1 << 24), rec(range(k % 1000, k % 1000 + 5), M.INT32, 512, sequence=k % 1000 + 1)))

    def _accept(self):
        while True:
            c, _ = self.socket.accept()
            threading.Thread(target=self._serve, args=(c,), daemon=True).start()

    def _serve(self, c):
        lines, own, first = c.makefile("rb"), None, 0
        with c:
            for line in lines:
                word = line.decode().split()
                if word[0] == "HELLO":
                    c.sendall(b"SeedLink v3\r\nhere\r\n")
                elif word[0] == "INFO":
                    text = "<seedlink>" + "".join(f'<station name="{s.split("_")[1]}" network="{s.split("_")[0]}" begin_seq="{p[0][0]:06X}" end_seq="{p[-1][0]:06X}"/>' for s, p in self.packets.items()) + "</seedlink>"
                    parts = [text[i : i + 100].encode() for i in range(0, len(text), 100)]
                    for i, part in enumerate(parts):
                        head = bytearray(64)
                        head[30:32], head[44:46] = len(part).to_bytes(2, "big"), (64).to_bytes(2, "big")
                        c.sendall((b"SLINFO *" if i < len(parts) - 1 else b"SLINFO  ") + (bytes(head) + part).ljust(512, b"\0"))
                elif word[0] == "STATION":
                    own = f"{word[2]}_{word[1]}"
                    c.sendall(b"OK\r\n" if own in self.packets else b"ERROR\r\n")
                elif word[0] == "SELECT":
                    c.sendall(b"OK\r\n")
                elif word[0] == "FETCH":
                    first = int(word[1], 16)
                    self.asked.append((own, first))
                    c.sendall(b"OK\r\n")
                elif word[0] == "END":
                    numbers = [k for k, _ in self.packets[own]]
                    for n, (k, body) in enumerate(self.packets[own][numbers.index(first) if first in numbers else 0 :]):
                        if n == 2 and self.breaks > 0:
                            self.breaks -= 1
                            c.sendall(seedlink.frame(k, body)[:100])
                            return
                        c.sendall(seedlink.frame(k, body))
                    c.sendall(b"END")
                    return


def test_seedlink_goes_on_after_a_restart(spark, tmp_path):
    """A stream is stopped and started again, connections break, numbers begin anew: each packet comes once."""
    server = Server()
    server.add("XX_AAA", range(0xABC0, 0xABC0 + 7))
    server.add("XX_BBB", range((1 << 24) - 3, (1 << 24) + 2))
    server.add("YY_CCC", range(5))
    seedlink.register(spark)
    server.breaks = 2

    def run():
        stream = spark.readStream.format("seedlink").options(host="127.0.0.1", port=server.port, streams="XX_*:BHZ", startingAt="earliest", packetsPerTask="3", waitSeconds="0.05").load()
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).start(str(tmp_path / "out"))
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(r["number"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    top = 1 << 24
    assert run() == sorted([*range(0xABC0, 0xABC7), top - 3, top - 2, top - 1, 0, 1]) and server.breaks == 0
    server.asked.clear()
    server.add("XX_AAA", range(0xABC7, 0xABC7 + 4))
    server.add("XX_BBB", [top + 2])
    assert run() == sorted([*range(0xABC0, 0xABCB), top - 3, top - 2, top - 1, 0, 1, 2])
    assert {("XX_AAA", 0xABC7), ("XX_BBB", 2)} <= set(server.asked) and all(s != "YY_CCC" for s, _ in server.asked)
    assert run() == sorted([*range(0xABC0, 0xABCB), top - 3, top - 2, top - 1, 0, 1, 2])


def test_seedlink_ranges():
    n = seedlink.Numbers
    assert seedlink.ranges({"A": (1 << 24) - 2}, {"A": 3}, 4) == [n("A", (1 << 24) - 2, 4), n("A", 2, 1)]
    assert seedlink.ranges({"": 5}, {"": 9}, 3) == [n("", 5, 3), n("", 8, 1)] and seedlink.ranges({"A": 7}, {"A": 7}, 3) == []
