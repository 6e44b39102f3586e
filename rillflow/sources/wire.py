"""Decoders of NetFlow v5, v9, IPFIX and sFlow v5 datagrams, and of DNS and TLS payloads, to flow records.

decode() maps a table of datagrams (recv_ts, src_ip, payload) to flows. Records of version 5, and of
templates without variable fields, are decoded with numpy, all of a batch that have one layout at a
time; only what has no fixed layout is taken apart record by record. Templates of v9 and IPFIX are
collected first, so data that arrives before its template is decoded too; of several templates with
one id, the latest at the datagram's time counts, else the earliest later one.

A datagram that is cut short or has a wrong length ends early or gives nothing, and never an error;
rejected() lists those that no decoder takes.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BY_ELEMENT, FLOW_SCHEMA

MOST_TEMPLATES = 200_000  # of all exporters, held by every task
NAMES = [f.name for f in FLOW_SCHEMA.fields]
# Struct layout of a version 5 record and the fields it fills.
V5 = struct.Struct("!IIIHHIIIIHHBBBBHHBBH")
V5_FIELDS = (
    "ip4_src_addr", "ip4_dst_addr", "ip4_next_hop", "input_snmp", "output_snmp", "in_pkts", "in_bytes", "first_switched", "last_switched",
    "l4_src_port", "l4_dst_port", None, "tcp_flags", "protocol", "src_tos", "src_as", "dst_as", "src_mask", "dst_mask", None
)


def value_of(element: int, data: bytes):
    """(field, value) of one information element; None for an unknown one or a wrong size."""
    field = BY_ELEMENT.get(element)
    if field is None or not field.least <= len(data) <= field.most:
        return None
    if field.kind == "INT":
        n = int.from_bytes(data, "big")
        return field.name, n - (1 << 64) if n >> 63 else n
    if field.kind == "ADDR":
        return field.name, int.from_bytes(data, "big") if field.most == 4 else data
    if field.kind == "MAC":
        return field.name, ":".join(f"{b:02x}" for b in data)
    return field.name, data.rstrip(b"\0").decode("utf-8", "replace")


def netflow5(data: bytes) -> Iterator[dict]:
    if not _is_v5(data):
        return
    count = struct.unpack_from("!H", data, 2)[0]
    for i in range(count):
        yield {k: v for k, v in zip(V5_FIELDS, V5.unpack_from(data, 24 + 48 * i)) if k}


def _is_v5(data: bytes) -> bool:
    return len(data) >= 24 and data[:2] == b"\x00\x05" and len(data) == 24 + 48 * struct.unpack_from("!H", data, 2)[0]


def _sets(data: bytes, header: int) -> Iterator[tuple[int, bytes]]:
    at = header
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("!HH", data, at)
        if size < 4 or at + size > len(data):
            return
        yield kind, data[at + 4 : at + size]
        at += size


def _version(data: bytes) -> int:
    """0 for what is too short to have a header."""
    found = struct.unpack_from("!H", data)[0] if data is not None and len(data) >= 16 else 0
    return 0 if found == 9 and len(data) < 20 else found


def _source(data: bytes) -> int:
    return struct.unpack_from("!I", data, 16 if _version(data) == 9 else 12)[0]


def templates_in(data: bytes) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(source id, template id, [(element, size)]) of all templates of a v9 or IPFIX datagram."""
    version = _version(data)
    if version not in (9, 10):
        return
    for kind, body in _sets(data, 20 if version == 9 else 16):
        if kind != (0 if version == 9 else 2):
            continue
        at = 0
        while at + 4 <= len(body):
            number, count = struct.unpack_from("!HH", body, at)
            at, fields = at + 4, []
            for _ in range(count):
                if at + 4 > len(body):
                    return
                element, size = struct.unpack_from("!HH", body, at)
                at += 4
                if version == 10 and element & 0x8000:
                    element, at = element & 0x7FFF, at + 4
                fields.append((element, size))
            if number > 255:
                yield _source(data), number, fields


def by_template(data: bytes, known: dict[tuple[int, int], list[tuple[int, int]]]) -> Iterator[dict]:
    """Whole records of the data sets whose templates are known."""
    version = _version(data)
    for kind, body in _sets(data, 20 if version == 9 else 16):
        fields = known.get((_source(data), kind)) if kind > 255 else None
        if not fields:
            continue
        at = 0
        while at < len(body):
            row, start = {}, at
            for element, size in fields:
                if size == 65535 and version == 10:
                    if at >= len(body):
                        at = len(body) + 1
                        break
                    size, at = body[at], at + 1
                    if size == 255 and at + 2 <= len(body):
                        size, at = struct.unpack_from("!H", body, at)[0], at + 2
                if got := value_of(element, body[at : at + size]):
                    row[got[0]] = got[1]
                at += size
            if at > len(body) or at == start:
                break
            yield row


def packet(frame: bytes, kind: int = 1) -> dict:
    """Fields of an Ethernet (1), IPv4 (11) or IPv6 (12) packet, and its payload under 'payload'."""
    row: dict = {}
    at, ether = 0, {11: 0x0800, 12: 0x86DD}.get(kind)
    if ether is None:
        if len(frame) < 14:
            return row
        mac = lambda b: ":".join(f"{x:02x}" for x in b)
        row |= {"dst_mac": mac(frame[:6]), "src_mac": mac(frame[6:12])}
        ether, at = struct.unpack_from("!H", frame, 12)[0], 14
        for _ in range(2):
            if ether in (0x8100, 0x88A8) and len(frame) >= at + 4:
                tag, ether = struct.unpack_from("!HH", frame, at)
                row.setdefault("src_vlan", tag & 0x0FFF)
                at += 4
    for _ in range(3):  # the packet and two tunnels
        if ether == 0x0800 and len(frame) >= at + 20:
            size, proto = (frame[at] & 15) * 4, frame[at + 9]
            row |= {
                "ip_protocol_version": 4, "src_tos": frame[at + 1], "ip_ttl": frame[at + 8], "protocol": proto,
                "ip4_src_addr": int.from_bytes(frame[at + 12 : at + 16], "big"), "ip4_dst_addr": int.from_bytes(frame[at + 16 : at + 20], "big")
            }
            fragment = struct.unpack_from("!H", frame, at + 6)[0] & 0x3FFF
            at += size
            if fragment:
                return row
        elif ether == 0x86DD and len(frame) >= at + 40:
            proto = frame[at + 6]
            row |= {"ip_protocol_version": 6, "ip_ttl": frame[at + 7], "protocol": proto, "ip6_src_addr": frame[at + 8 : at + 24], "ip6_dst_addr": frame[at + 24 : at + 40]}
            at += 40
        else:
            return row
        if proto not in (4, 41):
            break
        ether = 0x0800 if proto == 4 else 0x86DD
    if proto in (6, 17) and len(frame) >= at + 8:
        row["l4_src_port"], row["l4_dst_port"] = struct.unpack_from("!HH", frame, at)
        if proto == 6 and len(frame) >= at + 20:
            row["tcp_flags"] = frame[at + 13]
            row["payload"] = frame[at + (frame[at + 12] >> 4) * 4 :]
        elif proto == 17:
            row["payload"] = frame[at + 8 :]
    elif proto in (1, 58) and len(frame) >= at + 2:
        row["icmp_type"] = struct.unpack_from("!H", frame, at)[0]
    return row


def _is_sflow(data: bytes) -> bool:
    return len(data) >= 28 and data[:4] == b"\x00\x00\x00\x05" and (kind := struct.unpack_from("!I", data, 4)[0]) in (1, 2) and len(data) >= (28 if kind == 1 else 40)


def sflow5(data: bytes) -> Iterator[dict]:
    """Flow samples (formats 1 and 3) with raw headers or IPv4 records; other samples and records are skipped."""
    word = lambda b, i: struct.unpack_from("!I", b, i)[0]
    if not _is_sflow(data):
        return
    at = 8 + (4 if word(data, 4) == 1 else 16)
    agent = {"dev_ip": word(data, 8)} if word(data, 4) == 1 else {"dev_ip6": data[8:24]}
    n, at = word(data, at + 12), at + 16
    for _ in range(n):
        if at + 8 > len(data):
            return
        kind, size = word(data, at), word(data, at + 4)
        if at + 8 + size > len(data):
            return
        body, at = data[at + 8 : at + 8 + size], at + 8 + size
        if kind not in (1, 3) or len(body) < (32 if kind == 1 else 44):
            continue
        rate, records, p = word(body, 8 if kind == 1 else 12), word(body, 28 if kind == 1 else 40), 32 if kind == 1 else 44
        row = {"in_pkts": 1, "sampling_rate": rate} | agent
        for _ in range(records):
            if p + 8 > len(body):
                break
            tag, length = word(body, p), word(body, p + 4)
            r, p = body[p + 8 : p + 8 + length], p + 8 + length
            if tag == 1 and len(r) >= 16:
                row |= {"in_bytes": word(r, 4)} | packet(r[16 : 16 + word(r, 12)], word(r, 0))
            elif tag == 3 and len(r) >= 28:
                row |= {
                    "in_bytes": word(r, 0), "protocol": word(r, 4), "ip4_src_addr": word(r, 8), "ip4_dst_addr": word(r, 12),
                    "l4_src_port": word(r, 16), "l4_dst_port": word(r, 20), "tcp_flags": word(r, 24)
                }
        payload = row.pop("payload", b"")
        if 53 in (row.get("l4_src_port"), row.get("l4_dst_port")) and (found := dns(payload)):
            row |= {"dns_name": found[0], "dns_ips": "{" + ",".join(found[1]) + "}"}
        elif name := sni(payload):
            row["sni"] = name
        yield row


def _name(data: bytes, at: int) -> tuple[str, int]:
    out, jumps, end = "", 0, None
    while at < len(data) and jumps < 16:
        n = data[at]
        if n >= 0xC0 and at + 1 < len(data):
            end = end or at + 2
            at, jumps = struct.unpack_from("!H", data, at)[0] & 0x3FFF, jumps + 1
        elif n == 0:
            return out, end or at + 1
        else:
            out += data[at + 1 : at + 1 + n].decode("ascii", "replace") + "."
            at += 1 + n
    return "", len(data)


def dns(data: bytes) -> tuple[str, list[str]] | None:
    """(name with its final dot, addresses) of a successful DNS response."""
    import ipaddress

    if len(data) < 12:
        return None
    _, flags, questions, answers = struct.unpack_from("!HHHH", data)
    if not flags >> 15 or flags >> 11 & 15 or flags & 15 or not questions or not answers:
        return None
    name, at = _name(data, 12)
    at += 4
    for _ in range(questions - 1):
        at = _name(data, at)[1] + 4
    ips = []
    for _ in range(answers):
        at = _name(data, at)[1]
        if at + 10 > len(data):
            break
        kind, _, _, size = struct.unpack_from("!HHIH", data, at)
        body, at = data[at + 10 : at + 10 + size], at + 10 + size
        if (kind, len(body)) in ((1, 4), (28, 16)):
            ips.append(str(ipaddress.ip_address(body)))
    return name, ips


def sni(data: bytes) -> str | None:
    """The server name of a TLS ClientHello."""
    if len(data) < 44 or data[0] != 0x16 or data[1:3] not in (b"\x03\x01", b"\x03\x03") or data[5] != 1:
        return None
    try:
        at = 43
        at += 1 + data[at]
        at += 2 + struct.unpack_from("!H", data, at)[0]
        at += 1 + data[at]
        end, at = at + 2 + struct.unpack_from("!H", data, at)[0], at + 2
        while at + 4 <= min(end, len(data)):
            kind, size = struct.unpack_from("!HH", data, at)
            if kind == 0:
                n = struct.unpack_from("!H", data, at + 7)[0]
                return data[at + 9 : at + 9 + n].decode("ascii", "replace")
            at += 4 + size
    except (IndexError, struct.error):
        pass
    return None


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "timestamp": pa.timestamp("us", "UTC")}[kind.typeName()]


ARROW = {f.name: _arrow(f.dataType) for f in FLOW_SCHEMA.fields}


def _batch(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    """A batch of flows; fields without a column are null."""
    return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(n, t) for c, t in ARROW.items()], list(ARROW))


def _from_rows(rows: list[dict]) -> pa.RecordBatch:
    have = set().union(*rows) if rows else set()
    columns = {c: pa.array([r.get(c) for r in rows], ARROW[c]) for c in ARROW if c in have and c != "recv_ts"}
    return _batch(columns | {"recv_ts": _times([r["recv_ts"] for r in rows], 1)}, len(rows))


def _numbers(data: np.ndarray) -> np.ndarray:
    """Big-endian numbers of the rows of bytes, as signed 64-bit ones."""
    wide = np.zeros((len(data), 8), np.uint8)
    wide[:, 8 - data.shape[1] :] = data
    return wide.view(">i8").ravel().astype(np.int64)


def _texts(data: np.ndarray) -> pa.Array:
    return pa.array([bytes(r).rstrip(b"\0").decode("utf-8", "replace") for r in data], pa.string())


def _fixed(data: np.ndarray, fields: list[tuple[int, int]]) -> dict[str, pa.Array]:
    """Columns of records of one layout: rows of bytes, cut into fields (element, size); unknown ones and wrong sizes are left out."""
    out, at = {}, 0
    for element, size in fields:
        field, own = BY_ELEMENT.get(element), data[:, at : at + size]
        at += size
        if field is None or not field.least <= size <= field.most:
            continue
        if field.kind == "INT" or field.kind == "ADDR" and field.most == 4:
            out[field.name] = pa.array(_numbers(own))
        elif field.kind == "ADDR":
            ends = pa.py_buffer(np.arange(len(data) + 1, dtype=np.int32) * size)
            out[field.name] = pa.Array.from_buffers(pa.binary(), len(data), [None, ends, pa.py_buffer(np.ascontiguousarray(own))])
        elif field.kind == "MAC":
            out[field.name] = pa.array([":".join(f"{b:02x}" for b in r) for r in own.tolist()], pa.string())
        else:
            out[field.name] = _texts(own)
    return out


def _times(ts: list, counts: list[int] | int) -> pa.Array:
    return pa.array(np.repeat(np.array(ts, "M8[us]"), counts), pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))


# The fields of a version 5 record as (element, size); 0 is padding.
V5_LAYOUT = [
    (8, 4), (12, 4), (15, 4), (10, 2), (14, 2), (2, 4), (1, 4), (22, 4), (21, 4), (7, 2), (11, 2), (0, 1), (6, 1), (4, 1), (5, 1), (16, 2), (17, 2),
    (9, 1), (13, 1), (0, 2)
]


def _plain(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Flows of the version 5 and sFlow datagrams (recv_ts, payload) of a batch."""
    ts = batch.column(0).cast(pa.timestamp("us")).to_numpy(zero_copy_only=False)
    bodies, times, counts, rows = [], [], [], []
    for t, data in zip(ts, batch.column(1).to_pylist()):
        if data is None:
            continue
        if _is_v5(data):
            bodies.append(data[24:])
            times.append(t)
            counts.append((len(data) - 24) // 48)
        else:
            rows += [r | {"recv_ts": t} for r in sflow5(data)]
    if sum(counts):
        columns = _fixed(np.frombuffer(b"".join(bodies), np.uint8).reshape(-1, 48), V5_LAYOUT)
        yield _batch(columns | {"recv_ts": _times(times, counts)}, sum(counts))
    if rows:
        yield _from_rows(rows)


def _template_of(book: dict, key: tuple, ts) -> tuple | None:
    """The fields of a template as of ts, from (times seen, fields) sorted by time."""
    found = book.get(key)
    if not found:
        return None
    return found[1][max(0, bisect_right(found[0], ts) - 1)]


def _by_books(batch: pa.RecordBatch, book_of) -> Iterator[pa.RecordBatch]:
    """Flows of the v9 and IPFIX datagrams (recv_ts, src_ip, payload) of a batch; book_of: row to (book, prefix of its keys)."""
    ts = batch.column(0).cast(pa.timestamp("us")).to_numpy(zero_copy_only=False)
    layouts: dict[tuple, list] = {}
    rows: list[dict] = []
    for k, (t, data) in enumerate(zip(ts, batch.column(2).to_pylist())):
        version = _version(data)
        book, prefix = book_of(k)
        for kind, body in _sets(data, 20 if version == 9 else 16):
            fields = _template_of(book, (*prefix, _source(data), kind), t) if kind > 255 else None
            if not fields:
                continue
            if version == 10 and any(size == 65535 for _, size in fields):
                head = data[:20 if version == 9 else 16]
                whole = head + struct.pack("!HH", kind, len(body) + 4) + body
                rows += [r | {"recv_ts": t} for r in by_template(whole, {(_source(data), kind): fields})]
            elif size := sum(s for _, s in fields):
                bodies, times, counts = layouts.setdefault(fields, ([], [], []))
                n = len(body) // size
                bodies.append(body[: n * size])
                times.append(t)
                counts.append(n)
    for fields, (bodies, times, counts) in layouts.items():
        if sum(counts):
            data = np.frombuffer(b"".join(bodies), np.uint8).reshape(sum(counts), -1)
            yield _batch(_fixed(data, list(fields)) | {"recv_ts": _times(times, counts)}, sum(counts))
    if rows:
        yield _from_rows(rows)


def _book(templates) -> dict:
    """(key: (times, fields)) of (key, time, flat list of elements and sizes) sorted by time."""
    out: dict = {}
    for key, seen, flat in templates:
        times, fields = out.setdefault(key, ([], []))
        times.append(np.datetime64(seen.replace(tzinfo=None), "us") if not isinstance(seen, np.datetime64) else seen)
        fields.append(tuple(zip(flat[::2], flat[1::2])))
    return out


def templates_of(datagrams: DataFrame) -> DataFrame:
    """(src_ip, source, template, fields, seen): each template whenever it is new or differs from the one before."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = {(src, *t[:2], tuple(x for f in t[2] for x in f), ts) for ts, src, data in zip(b["recv_ts"], b["src_ip"], b["payload"]) for t in templates_in(data)}
            yield pd.DataFrame([(*r[:3], list(r[3]), r[4]) for r in rows], columns=["src_ip", "source", "template", "fields", "seen"])

    learnt = datagrams.mapInPandas(learn, "src_ip string, source long, template int, fields array<int>, seen timestamp")
    w = Window.partitionBy("src_ip", "source", "template").orderBy("seen", "fields")
    was = learnt.withColumn("was", F.lag("fields").over(w))
    return was.where("was IS NULL OR was <> fields").drop("was")


def decode(datagrams: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Flows of datagrams (recv_ts, src_ip, payload).

    templates, as templates_of() gives them, by default those of the datagrams themselves, are read once;
    up to MOST_TEMPLATES of them go to every task, beyond that each exporter's go with its datagrams.
    """
    version = F.conv(F.hex(F.substring("payload", 1, 2)), 16, 10).cast("int")
    dynamic = datagrams.where(version.isin(9, 10)).select(F.col("recv_ts").cast("timestamp").alias("recv_ts"), "src_ip", "payload")
    fixed = datagrams.where(~F.coalesce(version.isin(9, 10), F.lit(False))).select(F.col("recv_ts").cast("timestamp").alias("recv_ts"), "payload")
    plain = fixed.mapInArrow(lambda batches: (x for b in batches for x in _plain(b)), FLOW_SCHEMA)
    learnt = templates_of(dynamic) if templates is None else templates
    found = learnt.select("src_ip", "source", "template", F.unix_micros("seen").alias("seen"), "fields").limit(MOST_TEMPLATES + 1).collect()
    if len(found) <= MOST_TEMPLATES:
        rows = [((r["src_ip"], r["source"], r["template"]), np.datetime64(r["seen"], "us"), list(r["fields"])) for r in found]
        held = datagrams.sparkSession.sparkContext.broadcast(_book(sorted(rows, key=lambda r: (r[1], r[2]))))

        def everywhere(batches):
            for b in batches:
                source = b.column(1).to_pylist()
                yield from _by_books(b, lambda k: (held.value, (source[k],)))  # noqa: B023

        return plain.unionByName(dynamic.mapInArrow(everywhere, FLOW_SCHEMA))
    books = learnt.groupBy("src_ip").agg(F.sort_array(F.collect_list(F.struct(F.unix_micros("seen").alias("seen"), "source", "template", "fields"))).alias("book"))

    def by_exporter(batches):
        for b in batches:
            made: dict = {}

            def of(k):
                key = b.column(1)[k].as_py()  # noqa: B023
                if key not in made:  # noqa: B023
                    made[key] = _book(((t["source"], t["template"]), np.datetime64(t["seen"], "us"), t["fields"]) for t in b.column(3)[k].as_py())  # noqa: B023
                return made[key], ()  # noqa: B023

            yield from _by_books(b, of)

    return plain.unionByName(dynamic.join(books, "src_ip").select("recv_ts", "src_ip", "payload", "book").mapInArrow(by_exporter, FLOW_SCHEMA))


@F.pandas_udf(T.StructType([T.StructField("name", T.StringType()), T.StructField("ips", T.ArrayType(T.StringType()))]))
def dns_answer(payload: pd.Series) -> pd.DataFrame:
    """The name and addresses of a column of DNS payloads; null where there is no successful response."""
    found = [dns(d) if d is not None else None for d in payload]
    return pd.DataFrame({"name": [x[0] if x else None for x in found], "ips": [x[1] if x else None for x in found]}, dtype=object)


@F.pandas_udf(T.StringType())
def server_name(payload: pd.Series) -> pd.Series:
    """The server names of a column of TLS payloads; null where there is no ClientHello with one."""
    return pd.Series([sni(d) if d is not None else None for d in payload], dtype=object)


def rejected(datagrams: DataFrame) -> DataFrame:
    """The datagrams that no decoder takes: of an unknown version, or too short or too long for it."""

    @F.pandas_udf("boolean")
    def taken(payload: pd.Series) -> pd.Series:
        fits = lambda d: d is not None and (_is_v5(d) or _is_sflow(d) or _version(d) in (9, 10))
        return payload.map(fits).astype(bool)

    return datagrams.where(~taken("payload"))
