"""A stream of datagrams from a UDP socket, as the data source "flow_udp".

Options: port, host (default: all addresses), rcvbuf (bytes of the socket's buffer), spool. The driver
takes datagrams off the socket; what it hands on goes to a file in spool, a folder that all executors
share, and stays there until its batch is committed, so a batch that fails is read again. A datagram
that the system drops, or that a lost driver had not handed on, is gone, as with any UDP collector;
where that matters, exporters send to a durable queue and Spark reads that instead.
"""

from __future__ import annotations

import datetime
import socket
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "recv_ts timestamp, src_ip string, payload binary"
COLUMNS = {"recv_ts": pa.timestamp("us", "UTC"), "src_ip": pa.string(), "payload": pa.binary()}
DATAGRAM = 65_535
_sockets: dict[tuple[str, int], "_Receiver"] = {}


class _Receiver:
    """A socket with a thread that takes datagrams off it."""

    def __init__(self, host: str, port: int, rcvbuf: int):
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        if rcvbuf:
            self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, rcvbuf)
        self.socket.bind((host, port))
        self.rows, self.lock = [], threading.Lock()
        threading.Thread(target=self._run, daemon=True).start()

    def _run(self) -> None:
        while True:
            data, (source, _) = self.socket.recvfrom(DATAGRAM)
            now = datetime.datetime.now(datetime.timezone.utc)
            with self.lock:
                self.rows.append((now, source, data))

    def take(self) -> list[tuple]:
        """What has come since the last call."""
        with self.lock:
            rows, self.rows = self.rows, []
        return rows


def receiver(host: str, port: int, rcvbuf: int = 0) -> _Receiver:
    key = (host, port)
    if key not in _sockets:
        _sockets[key] = _Receiver(host, port, rcvbuf)
    return _sockets[key]


class UdpReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.of = (options.get("host", ""), int(options["port"]), int(options.get("rcvbuf", 0)))
        uri = options["spool"]
        self.fs, self.folder = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)

    def _files(self) -> list[tuple[int, int, str]]:
        """(first, after the last, path) of the spooled files in order."""
        found = self.fs.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        return sorted((*map(int, f.base_name.split(".")[0].split("-")), f.path) for f in found if f.base_name.endswith(".arrow"))

    def initialOffset(self) -> dict:
        self.fs.create_dir(self.folder, recursive=True)
        receiver(*self.of)
        return {"n": max([0, *(end for _, end, _ in self._files())])}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        held, n = receiver(*self.of), start["n"]
        rows = held.take()
        if rows:
            table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), COLUMNS.values())], list(COLUMNS))
            with self.fs.open_output_stream(f"{self.folder}/{n:018d}-{n + len(rows):018d}.arrow") as out, pa.ipc.new_file(out, table.schema) as writer:
                writer.write_table(table)
        return iter(rows), {"n": n + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for a, b, path in self._files():
            if a >= start["n"] and b <= end["n"]:
                with self.fs.open_input_file(path) as f:
                    table = pa.ipc.open_file(f).read_all()
                yield from zip(*(c.to_pylist() for c in table.columns))

    def commit(self, end: dict) -> None:
        for _, b, path in self._files():
            if b <= end["n"]:
                self.fs.delete_file(path)


class UdpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flow_udp"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> UdpReader:
        return UdpReader(self.options)


def register(spark) -> None:
    """Makes the format "flow_udp" known to spark.readStream."""
    spark.dataSource.register(UdpSource)
