"""Datagrams of capture files: the UDP payloads of .pcap files, for the decoders of wire.decode."""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "recv_ts timestamp, src_ip string, dst_port int, payload binary"
# Magic numbers of the file header, with byte order and ticks of the fraction of a second.
MAGICS = {b"\xa1\xb2\xc3\xd4": (">", 1), b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1000)}
ETHERNET, RAW = 1, (12, 101)


def udp_payload(frame: bytes, link: int) -> tuple[str, int, bytes] | None:
    """(source address, destination port, payload) of an unfragmented UDP packet over IPv4 or IPv6; None for other frames."""
    at = 0
    if link == ETHERNET:
        if len(frame) < 14:
            return None
        kind, at = struct.unpack_from("!H", frame, 12)[0], 14
        while kind in (0x8100, 0x88A8) and len(frame) >= at + 4:
            kind, at = struct.unpack_from("!H", frame, at + 2)[0], at + 4
        if kind not in (0x0800, 0x86DD):
            return None
    if len(frame) < at + 20:
        return None
    if frame[at] >> 4 == 4:
        size, total = (frame[at] & 15) * 4, struct.unpack_from("!H", frame, at + 2)[0]
        if frame[at + 9] != 17 or struct.unpack_from("!H", frame, at + 6)[0] & 0x3FFF:
            return None
        source, end, at = frame[at + 12 : at + 16], at + total, at + size
    elif frame[at] >> 4 == 6 and len(frame) >= at + 40 and frame[at + 6] == 17:
        source, end, at = frame[at + 8 : at + 24], at + 40 + struct.unpack_from("!H", frame, at + 4)[0], at + 40
    else:
        return None
    if len(frame) < at + 8 or end < at + 8:
        return None
    return str(ipaddress.ip_address(source)), struct.unpack_from("!H", frame, at + 2)[0], frame[at + 8 : end]


def packets(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(microseconds, link type, frame) of a capture file's packets; a cut last packet is left out."""
    if len(data) < 24 or data[:4] not in MAGICS:
        return
    order, ticks = MAGICS[data[:4]]
    link, at = struct.unpack_from(f"{order}I", data, 20)[0] & 0xFFFF, 24
    while at + 16 <= len(data):
        seconds, fraction, size, _ = struct.unpack_from(f"{order}IIII", data, at)
        at += 16
        if at + size > len(data):
            return
        yield seconds * 1_000_000 + fraction // ticks, link, data[at : at + size]
        at += size


def read(spark: SparkSession, path: str, port: int | None = None) -> DataFrame:
    """The datagrams of all capture files under path, to one port if it is given; a task holds one file."""

    def task(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = [(us, *found) for us, link, frame in packets(data.as_buffer().to_pybytes()) if (found := udp_payload(frame, link)) and port in (None, found[1])]
                columns = list(zip(*rows)) or [()] * 4
                kinds = (pa.timestamp("us", "UTC"), pa.string(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["recv_ts", "src_ip", "dst_port", "payload"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(task, SCHEMA)
