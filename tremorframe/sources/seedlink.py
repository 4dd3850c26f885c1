"""SeedLink servers and recorded packets as a streaming source.

``spark.readStream.format("seedlink")`` reads packets (8 bytes of header, 512
of record).  The offset has for each station the server's own number of the
packet that comes next, so a restart asks for just that one.  The driver asks
the server which numbers there are; packets are fetched by tasks, one for each
station and ``packetsPerTask`` (1000) numbers, which connect by themselves and,
when a connection breaks, go on after the last packet that they got.  What a
task reads depends on its numbers alone, so it may run again.

Options: host, port, streams (NET_STA:SELECTOR, separated by commas, * for any),
startingAt (latest or earliest).  Packets that a server no longer has are left
out.  With ``path`` the packets come from a recording instead; its offset is the
number of packets.
"""

from __future__ import annotations

import re
import socket
import struct
import time
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyspark.sql import SparkSession
from pyspark.sql.datasource import InputPartition

from .miniseed import RECORDS, opened, record

HEADER, RECORD = 8, 512
PACKETS = f"number long, {RECORDS}"
#: Numbers of packets begin again after so many.
NUMBERS = 1 << 24


def packets(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(sequence, record) of packets one after the other."""
    for at in range(0, len(data) - HEADER - RECORD + 1, HEADER + RECORD):
        head = data[at : at + HEADER]
        if head[:2] == b"SL":
            yield int(head[2:8], 16), data[at + HEADER : at + HEADER + RECORD]


def frame(number: int, body: bytes) -> bytes:
    """A packet as a server sends it."""
    return f"SL{number % NUMBERS:06X}".encode() + body.ljust(RECORD, b"\0")


class Connection:
    """The client's side of the protocol, with retries."""

    def __init__(self, host: str, port: int = 18000, tries: int = 10, wait_s: float = 1.0) -> None:
        self.address, self.tries, self.wait_s = (host, port), tries, wait_s
        self.socket: socket.socket | None = None

    def open(self) -> None:
        for n in range(self.tries):
            try:
                self.socket = socket.create_connection(self.address, 10)
                self.say("HELLO", 2)
                return
            except OSError:
                if n == self.tries - 1:
                    raise
                time.sleep(self.wait_s)

    def say(self, command: str, lines: int = 1) -> list[str]:
        self.socket.sendall(command.encode() + b"\r\n")
        return [self._line() for _ in range(lines)]

    def _line(self) -> str:
        out = b""
        while not out.endswith(b"\n"):
            part = self.socket.recv(1)
            if not part:
                raise OSError("the server closed the connection")
            out += part
        return out.decode("ascii", "replace").strip()

    def catalog(self) -> list[str]:
        """Stations that the server has."""
        self.socket.sendall(b"CAT\r\n")
        out = []
        while (line := self._line()) != "END":
            out.append(line)
        return out

    def stations(self) -> dict[str, tuple[int, int]]:
        """NET_STA of all stations with the numbers of their first packet and of the one that comes next."""
        self.socket.sendall(b"INFO STATIONS\r\n")
        text, last = "", False
        while not last:
            packet = self._exactly(HEADER + RECORD)
            last = packet[7:8] != b"*"
            count, begin = struct.unpack(">H", packet[HEADER + 30 : HEADER + 32])[0], struct.unpack(">H", packet[HEADER + 44 : HEADER + 46])[0]
            text += packet[HEADER + begin : HEADER + begin + count].decode("ascii", "replace")
        out = {}
        for m in re.finditer(r"<station\b([^>]*)>", text):
            own = dict(re.findall(r"(\w+)=[\"']([^\"']*)[\"']", m[1]))
            out[f"{own['network'].strip()}_{own['name'].strip()}"] = (int(own["begin_seq"], 16), (int(own["end_seq"], 16) + 1) % NUMBERS)
        return out

    def _exactly(self, size: int) -> bytes:
        out = b""
        while len(out) < size:
            part = self.socket.recv(size - len(out))
            if not part:
                raise OSError("the server closed the connection")
            out += part
        return out

    def fetch(self, station: str, selectors: list[str], first: int) -> Iterator[tuple[int, bytes]]:
        """The packets of a station from a number on that the server has now."""
        net, _, sta = station.partition("_")
        for command in (f"STATION {sta} {net}", *(f"SELECT {x}" for x in selectors), f"FETCH {first:06X}"):
            if self.say(command)[0] != "OK":
                raise ValueError(f"the server refused {command!r}")
        self.socket.sendall(b"END\r\n")
        while (head := self._exactly(3)) != b"END":
            packet = head + self._exactly(HEADER + RECORD - 3)
            yield int(packet[2:8], 16), packet[HEADER:]

    def close(self) -> None:
        if self.socket is not None:
            self.socket.close()
            self.socket = None


def wanted(streams: str) -> list[tuple[str, str]]:
    """(NET_STA, selector) of a list of streams."""
    return [(name or "*", selector or "?????") for name, _, selector in (x.strip().partition(":") for x in streams.split(","))]


@dataclass
class Numbers(InputPartition):
    """So many numbers of a station, or packets of a recording, from the first on."""

    station: str
    first: int
    count: int


def ranges(start: dict, end: dict, most: int) -> list[Numbers]:
    """What lies between two offsets, in parts; a station that was not there yet is read from what its first offset says."""
    out = []
    for station, stop in end.items():
        first = start.get(station, stop)
        count = (stop - first) % NUMBERS if station else stop - first
        out += [Numbers(station, (first + k) % NUMBERS if station else first + k, min(most, count - k)) for k in range(0, count, most)]
    return out


def fetched(part: Numbers, streams: str, host: str, port: int, tries: int = 10, wait_s: float = 1.0) -> Iterator[tuple[int, bytes]]:
    """The packets of a part, each once and in order; a broken connection is made anew."""
    selectors = list(dict.fromkeys(sel for name, sel in wanted(streams) if fnmatchcase(part.station, name)))
    done, failed = 0, 0
    while done < part.count:
        c = Connection(host, port, tries, wait_s)
        try:
            c.open()
            for number, body in c.fetch(part.station, selectors, (part.first + done) % NUMBERS):
                at = (number - part.first) % NUMBERS
                if at >= part.count:
                    return
                if at >= done:
                    done, failed = at + 1, 0
                    yield number, body
            return
        except OSError:
            failed += 1
            if failed >= tries:
                raise
            time.sleep(wait_s)
        finally:
            c.close()


def _row(number: int, body: bytes) -> tuple:
    r, _ = record(body)
    return (number, r["net"], r["sta"], r["loc"], r["chan"], r["start_us"], r["sample_rate"], r["n"], r["encoding"], r["sequence"], r["samples"].tolist())


def register(spark: SparkSession) -> None:
    from pyspark.sql.datasource import DataSource, DataSourceStreamReader

    class Reader(DataSourceStreamReader):
        def __init__(self, options: dict) -> None:
            self.path, self.streams, self.most = options.get("path"), options.get("streams", "*"), int(options.get("packetspertask", "1000"))
            self.latest = options.get("startingat", "latest") == "latest"
            self.server = {"host": options.get("host", "localhost"), "port": int(options.get("port", "18000")), "tries": int(options.get("tries", "10")), "wait_s": float(options.get("waitseconds", "1.0"))}

        def _stations(self) -> dict[str, tuple[int, int]]:
            c = Connection(**self.server)
            c.open()
            try:
                names = [name for name, _ in wanted(self.streams)]
                return {k: v for k, v in c.stations().items() if any(fnmatchcase(k, n) for n in names)}
            finally:
                c.close()

        def _end(self) -> int:
            system, place = opened(self.path)
            return system.get_file_info(place).size // (HEADER + RECORD)

        def initialOffset(self) -> dict:
            if self.path:
                return {"": 0}
            return {k: stop if self.latest else first for k, (first, stop) in self._stations().items()}

        def latestOffset(self) -> dict:
            return {"": self._end()} if self.path else {k: stop for k, (_, stop) in self._stations().items()}

        def partitions(self, start: dict, end: dict):
            return ranges(start, end, self.most)

        def read(self, partition: Numbers):
            if not self.path:
                yield from (_row(n, b) for n, b in fetched(partition, self.streams, **self.server))
                return
            system, place = opened(self.path)
            with system.open_input_file(place) as f:
                f.seek(partition.first * (HEADER + RECORD))
                yield from (_row(n, b) for n, b in packets(f.read(partition.count * (HEADER + RECORD))))

        def commit(self, end: dict) -> None:
            pass

        def stop(self) -> None:
            pass

    class SeedLink(DataSource):
        @classmethod
        def name(cls) -> str:
            return "seedlink"

        def schema(self) -> str:
            return PACKETS

        def streamReader(self, schema):
            return Reader({k.lower(): v for k, v in self.options.items()})

    spark.dataSource.register(SeedLink)
