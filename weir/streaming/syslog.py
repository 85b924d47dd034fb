"""Streaming source of syslog messages over UDP and TCP (S12, S13, R1, R2).

One receiver listens on both protocols of one port: a datagram is a message, and so is
each line of a TCP connection. Messages are appended to a spool of segment files before
they count. An offset names a segment, a byte in it and the position of the message, so a
batch reads only its own bytes, and a restarted query reads on from its checkpoint. A
segment is deleted once every message in it is committed. The spool must be in a folder
that driver and executors share. UDP itself may lose datagrams before they arrive.
"""

from __future__ import annotations

import base64
import json
import os
import socketserver
import threading
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "source_file string, seq bigint, raw_bytes binary"
FORMAT = "weir_syslog"


SEGMENT_BYTES = 64 << 20


def segments(spool: str) -> list[int]:
    """Positions of the first messages of the segments, in order."""
    return sorted(int(n.split(".")[0]) for n in os.listdir(spool) if n.endswith(".jsonl"))


def segment_path(spool: str, first: int) -> str:
    return os.path.join(spool, f"{first:020d}.jsonl")


class Receiver:
    """Sockets, their threads, and the spool they write. A line that a crash left unfinished
    at the end of the spool is cut off: it never counted."""

    def __init__(self, host: str, port: int, spool: str, segment_bytes: int = SEGMENT_BYTES):
        os.makedirs(spool, exist_ok=True)
        self.spool, self.segment_bytes, self.lock, self.servers = spool, segment_bytes, threading.Lock(), []
        self.first = (segments(spool) or [0])[-1]
        self.count, self.bytes = self.first, 0
        with open(segment_path(spool, self.first), "a+b") as f:
            f.seek(0)
            for line in f:
                if not line.endswith(b"\n"):
                    break
                self.count, self.bytes = self.count + 1, self.bytes + len(line)
            f.truncate(self.bytes)
        receiver = self

        class Datagram(socketserver.BaseRequestHandler):
            def handle(self):
                receiver.add(self.request[0], self.client_address)

        class Stream(socketserver.StreamRequestHandler):
            def handle(self):
                for line in self.rfile:
                    receiver.add(line, self.client_address)

        class Udp(socketserver.ThreadingUDPServer):
            max_packet_size, daemon_threads = 65535, True

        class Tcp(socketserver.ThreadingTCPServer):
            allow_reuse_address, daemon_threads = True, True

        udp = Udp((host, port), Datagram)
        self.host, self.port = udp.server_address[:2]
        self.servers = [udp, Tcp((host, self.port), Stream)]
        for s in self.servers:
            threading.Thread(target=s.serve_forever, kwargs={"poll_interval": 0.05}, daemon=True).start()
        with open(os.path.join(spool, "port"), "w", encoding="ascii") as f:
            f.write(str(self.port))

    def add(self, data: bytes, sender: tuple) -> None:
        """Line ends go; a blank message is dropped."""
        data = data.rstrip(b"\r\n")
        if not data.strip():
            return
        line = json.dumps([f"{sender[0]}:{sender[1]}", base64.b64encode(data).decode()]) + "\n"
        body = line.encode()
        with self.lock:
            if self.bytes >= self.segment_bytes:
                self.first, self.bytes = self.count, 0
            with open(segment_path(self.spool, self.first), "ab") as f:
                f.write(body)
            self.count, self.bytes = self.count + 1, self.bytes + len(body)

    def offset(self) -> dict:
        """Where the spool ends."""
        with self.lock:
            return {"at": self.count, "segment": self.first, "byte": self.bytes}

    def close(self) -> None:
        for s in self.servers:
            s.shutdown()
            s.server_close()


def spooled(spool: str, start: dict, end: dict) -> Iterator[tuple[str, int, bytes]]:
    """Messages between two offsets. Reading needs no socket, so any process that sees the
    spool can do it."""
    for first in segments(spool):
        if not start["segment"] <= first <= end["segment"]:
            continue
        with open(segment_path(spool, first), "rb") as f:
            at, place = (start["at"], start["byte"]) if first == start["segment"] else (first, 0)
            f.seek(place)
            for line in f:
                place += len(line)
                if first == end["segment"] and place > end["byte"]:
                    break
                sender, data = json.loads(line)
                yield sender, at, base64.b64decode(data)
                at += 1


class Messages(Iterator):
    """Messages between two offsets, read when they are asked for. A copy made before that
    reads them again, which is how Spark serves a batch more than once."""

    def __init__(self, spool: str, start: dict, end: dict):
        self.span, self.reading = (spool, start, end), None

    def __copy__(self) -> Messages:
        return Messages(*self.span)

    def __next__(self) -> tuple[str, int, bytes]:
        if self.reading is None:
            self.reading = spooled(*self.span)
        return next(self.reading)


def trim(spool: str, end: dict) -> None:
    """Delete the segments that end before an offset."""
    for first in segments(spool):
        if first < end["segment"]:
            os.remove(segment_path(spool, first))


_RECEIVERS: dict[tuple, Receiver] = {}


class SyslogReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.key = (options.get("host", "127.0.0.1"), int(options.get("port", 5514)), options["spool"])

    def receiver(self) -> Receiver:
        """Bound on first use: the reader itself is built more than once."""
        if self.key not in _RECEIVERS:
            _RECEIVERS[self.key] = Receiver(*self.key)
        return _RECEIVERS[self.key]

    def initialOffset(self) -> dict:
        return {"at": 0, "segment": 0, "byte": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = self.receiver().offset()
        return Messages(self.key[2], start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return Messages(self.key[2], start, end)

    def commit(self, end: dict) -> None:
        trim(self.key[2], end)


class SyslogSource(DataSource):
    """Options: host, port (0 lets the system choose; see the file `port`), spool."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SyslogReader:
        return SyslogReader(self.options)
