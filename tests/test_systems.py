"""Configuration, dimension files, decoders, sinks, streams: against small fixtures and the registered SQL."""

import os
import socket
import struct
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from rillflow import config, dsl
from rillflow.operators import classify, enrich, lookup, mavg, windows
from rillflow.plans import monitor
from rillflow.plans.all_queries import ORACLE_SQL, QUERIES
from rillflow.sinks import alerts, dump, sqltext
from rillflow.sources import files, pcap, udp, wire
from rillflow.streaming import flows as streams
from rillflow.streaming.store import drained, export

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["dec_ipfix", "dec_dns", "flt_mfreq", "alert_states", "str_window", "str_alert", "cfg_extended", "exp_sql"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel, df = con.sql(ORACLE_SQL[name]), QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    norm = lambda x: x if isinstance(x, str) or x is None else round(float(x), 6)
    rows = lambda got: sorted((tuple(norm(x) for x in r) for r in got), key=str)
    assert rows([r[c] for c in columns] for r in df.collect()) == rows([r[rel.columns.index(c)] for c in columns] for r in rel.fetchall())


def test_configuration(tmp_path):
    assert config.loads('{ // one\n "a": "x // y", /* two */ "b": [1, 2,],\n}') == {"a": "x // y", "b": [1, 2]}
    for path, conf in (
        ("in", '{"filter": "dst net 10.0.0.0/8", "fwm": [{"name": "w", "fields": ["octets"]}]}'),
        (
            "in/udp",
            '{"filter": "proto 17", "mavg": [{"name": "m", "time": "10", "fields": ["dst host", "packets"], "overlimit": [{"name": "l", "limits": "l.csv", "default": [5]}]}]}'
        ),
        (".hidden", "{"), ("in/empty", None)
    ):
        os.makedirs(tmp_path / path)
        if conf:
            (tmp_path / path / "mo.conf").write_text(conf)
    tree = config.load_tree(str(tmp_path))
    assert [(mo.name, parent and parent.name) for root in tree for mo, parent in root.walk()] == [("in", None), ("in_udp", "in")]
    assert tree[0].windows[0].seconds == 30 and tree[0].table("w") == "in_w"
    average = tree[0].children[0].averages[0]
    assert average.over[0].file == str(tmp_path / "in/udp/l.csv") and average.over[0].back_to_norm == 30
    assert config.reload_limits(tree) == []
    (tmp_path / "in/udp/mo.conf").write_text('{"filter": "proto 6", "mavg": [{"name": "m", "fields": ["packets"], "overlimit": [{"name": "l", "default": [9]}]}]}')
    os.utime(tmp_path / "in/udp/mo.conf", (1, 1))
    assert config.reload_limits(tree) == ["in_udp"]
    assert average.over[0].default == [9.0] and tree[0].children[0].filter == "proto 17"
    with pytest.raises(dsl.FilterError):
        config.monitoring_object({"filter": "src"}, "x")
    text = 'a\n//!tmpl "net": "${NET}"\n"net": "old"\nb\n//!tmpl ${OTHER}\nc\n'
    values = config.replacements("NET=10.0.0.0/8; X=1")
    assert config.clone_text(text, values).splitlines() == ["a", '//!tmpl "net": "${NET}"', ' "net": "10.0.0.0/8"', "b", "//!tmpl ${OTHER}", "c"]
    config.clone_tree(str(tmp_path / "in"), str(tmp_path / "copy"), values)
    assert (tmp_path / "copy/udp/mo.conf").read_text() == (tmp_path / "in/udp/mo.conf").read_text()


def test_dimension_files(spark, tmp_path):
    (tmp_path / "geo.csv").write_text(",".join(files.GEO_RANGE) + '\n4,10.0.0.0,10.0.0.5,EU,DE,Germany,"Lower, Saxony",A,1,z,1.5,2.5,9\n4,10.0.0.6,10.0.0.255,EU,FR,France,S,B,2,z,3,4,9\n6,2001:db8::,2001:db8::ffff,OC,AU,Australia,S,C,3,z,5,6,9\nx,bad,line,,,,,,,,,,\n')
    geo = files.geo_ranges(spark, str(tmp_path / "geo.csv"))
    ips = spark.createDataFrame([(167772160 + k, bytes.fromhex("20010db8" + "00" * 11) + bytes([k])) for k in (0, 5, 6, 255)] + [(1, b"\0" * 16)], "a long, b binary")
    got = lookup.longest(ips, "a", geo, {"city": "?", "country_code": "?"}).collect()
    assert sorted((r.a, r.city, r.country_code) for r in got) == [(1, "?", "?"), (167772160, "A", "de"), (167772165, "A", "de"), (167772166, "B", "fr"), (167772415, "B", "fr")]
    assert sorted(r.city for r in lookup.longest(ips, "b", geo, {"city": "?"}, 6).collect()) == ["?", "C", "C", "C", "C"]
    (tmp_path / "places.csv").write_text("geoname_id,locale_code,continent_code,continent_name,country_iso_code,country_name,subdivision_1_name,city_name\n1,en,EU,Europe,DE,Germany,S,A\n")
    (tmp_path / "blocks.csv").write_text("network,geoname_id,postal_code,latitude,longitude\n10.0.0.0/24,1,99,1,2\n10.0.1.0/24,7,1,1,1\n2001:db8::/64,1,9,1,2\n")
    blocks = files.geo_blocks(spark, str(tmp_path / "places.csv"), str(tmp_path / "blocks.csv")).collect()
    assert sorted((r.ver, r.plen, r.continent, r.city, r.zip, r.lat) for r in blocks) == [(4, 24, "eu", "A", "99", "1"), (6, 64, "eu", "A", "9", "1")]
    (tmp_path / "as.csv").write_text('10.0.0.0,10.0.0.127,65001,"one, two"\n')
    (tmp_path / "as2.csv").write_text("network,autonomous_system_number,autonomous_system_organization\n10.0.0.0/30,65002,three\n")
    both = files.as_ranges(spark, str(tmp_path / "as.csv")).unionByName(files.as_blocks(spark, str(tmp_path / "as2.csv")))
    assert sorted((r.asn, r.asd) for r in lookup.longest(ips.where("a > 1"), "a", both, {"asn": "0", "asd": "?"}).collect()) == [("0", "?"), ("65001", "one, two"), ("65001", "one, two"), ("65002", "three")]
    os.makedirs(tmp_path / "lists")
    (tmp_path / "lists/mynet").write_text("# ours\n10.0.0.0/30\n\n2001:db8::1\n10.0.0.255 # one\nbad/99")
    lists = files.ip_lists(spark, str(tmp_path / "lists"))
    assert {k: sorted(v) for k, v in files.lists_of(lists).items()} == {"mynet": ["10.0.0.0/30", "10.0.0.255/32", "2001:db8::1/128"]}
    assert sorted(r.a for r in lookup.members(ips, "a", lists).collect()) == [167772160, 167772415]
    (tmp_path / "limits.csv").write_text('# address, port, packets\n1.2.3.4,17,200000\n"1.2.3.5", 6 ,5\n')
    limits = files.limits(spark, str(tmp_path / "limits.csv"), ["src host", "dst port", "packets"])
    assert sorted(map(tuple, limits.select("src_host", "dst_port", "limit").collect())) == [(16909060, 17, 200000.0), (16909061, 6, 5.0)]
    (tmp_path / "devices.conf").write_text('[{"ip": "127.0.0.1", "sampling-rate": 100, "mark": ["port 53"]}, /* any */ {"id": 7, "skip-unmarked": true}]')
    rows, marks = files.devices(spark, str(tmp_path / "devices.conf"))
    assert [tuple(r) for r in rows.collect()] == [(0, 2130706433, None, 100, False), (1, None, 7, 1, True)] and marks == [["port 53"], []]
    classes = spark.createDataFrame(
        [(0, 53, "53", "domain", 9, 90.0), (30, 53, "53", "domain", 5, 50.0), (30, 80, "80", "http", 5, 50.0)],
        "period long, port long, class_id string, name string, s long, share double"
    )
    grown = classify.grown(classify.renamed(classify.grown(None, classes.where("period = 0")), {"53": "names"}), classes.where("period = 30"))
    assert sorted((r.class_id, r.name, r.since, r.stats) for r in grown.collect()) == [("53", "names", 0, "5 of 10, 50.0%"), ("80", "http", 30, "5 of 10, 50.0%")]
    files.write_class_names(str(tmp_path / "classes"), grown)
    (tmp_path / "classes/80/name").write_text("web\n")
    files.write_class_names(str(tmp_path / "classes"), grown)
    assert files.class_names(str(tmp_path / "classes")) == {"53": "names", "80": "web"}
    asked = spark.createDataFrame([(167772160, 53), (167772160, 99)], "t long, p long")
    assert sorted(r.class_name for r in classify.apply_grown(asked, F.lit(60), {"port": F.col("p")}, grown).collect()) == ["", "names"]


def udp_frame(payload: bytes, port: int = 2055) -> bytes:
    ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 28 + len(payload), 0, 0, 64, 17, 0, bytes([10, 9, 9, 9]), bytes([10, 0, 0, 1]))
    return b"\x02" * 12 + b"\x08\x00" + ip + struct.pack("!HHHH", 999, port, 8 + len(payload), 0) + payload


def test_captures_and_malformed_datagrams(spark, tmp_path):
    record = struct.pack("!IIIHHIIIIHHBBBBHHBBH", 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 0, 2, 17, 0, 64512, 64513, 24, 16, 0)
    good = struct.pack("!HH", 5, 2) + b"\0" * 20 + record * 2
    v6 = struct.pack("!II16sIIIIII", 5, 2, b"\x20" * 16, 0, 0, 0, 1, 1, 68) + struct.pack("!IIIIIIII", 0, 0, 7, 0, 0, 0, 0, 1) + struct.pack("!II7I", 3, 28, 100, 6, 1, 2, 3, 4, 2)
    bad = [b"", b"\x00\x05\x00", good[:-1], b"\x00\x09" + b"\xff" * 30, b"\x00\x0a" + b"\x00" * 14, v6[:30], b"\x00\x07" + b"\0" * 40, None, v6[:-9]]
    sent = spark.createDataFrame([(None, "10.9.9.9", x) for x in [good, v6, *bad]], "recv_ts timestamp, src_ip string, payload binary").withColumn("recv_ts", F.lit("2024-01-01").cast("timestamp"))
    rows = wire.decode(sent).collect()
    assert sorted((r.ip4_src_addr or 0, r.in_bytes or 0, r.dst_as or 0) for r in rows if r.ip4_src_addr) == [(1, 7, 64513), (1, 7, 64513), (1, 100, 0)]
    assert [bytes(r.dev_ip6) for r in rows if r.in_bytes == 100] == [b"\x20" * 16] and [r.sampling_rate for r in rows if r.in_bytes == 100] == [7]
    assert wire.rejected(sent).count() == 6
    frames = [udp_frame(good), b"\x02" * 14, udp_frame(good, 53)]
    for name, order in (("a.pcap", "<"), ("b.pcap", ">")):
        body = struct.pack(f"{order}IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
        for k, f in enumerate(frames):
            body += struct.pack(f"{order}IIII", 1_700_000_000 + k, 5, len(f), len(f)) + f
        (tmp_path / name).write_bytes(body + b"cut")
    found = pcap.read(spark, str(tmp_path), 2055)
    assert sorted((r.src_ip, r.recv_ts.timestamp(), bytes(r.payload)) for r in found.collect()) == [("10.9.9.9", 1_700_000_000.000005, good)] * 2
    assert wire.decode(found).count() == 4


def test_templates_as_of(spark):
    """The latest template at a datagram's time counts, else the earliest later one."""
    head = lambda seq: struct.pack("!HHIIII", 9, 1, 0, 0, seq, 5)
    template = lambda first: struct.pack("!HHHHHHHH", 0, 16, 256, 2, first, 4, 10 if first == 8 else 14, 4)
    data = struct.pack("!HHII", 256, 12, 77, 3)
    rows = [(1, data), (2, template(8)), (3, data), (4, template(12)), (5, data), (6, template(8) + data)]
    sent = spark.createDataFrame([(t, "e", head(t) + x) for t, x in rows], "t long, src_ip string, payload binary").withColumn("recv_ts", F.timestamp_seconds("t"))
    got = wire.decode(sent).select(F.unix_seconds("recv_ts").alias("t"), "ip4_src_addr", "ip4_dst_addr").collect()
    assert sorted((r.t, r.ip4_src_addr, r.ip4_dst_addr) for r in got) == [(1, 77, None), (3, 77, None), (5, None, 77), (6, 77, None)]


def test_udp_stream(spark, tmp_path):
    udp.register(spark)
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    stream = spark.readStream.format("flow_udp").option("host", "127.0.0.1").option("port", port).option("spool", str(tmp_path / "spool")).load()
    query = export(stream, f"file://{tmp_path}/rows", f"file://{tmp_path}/checkpoint", available_now=False)
    try:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            until, rows = time.time() + 60, 0
            while time.time() < until and rows < 5:
                s.sendto(b"datagram", ("127.0.0.1", port))
                time.sleep(0.5)
                rows = spark.read.parquet(f"{tmp_path}/rows").count() if os.path.isdir(tmp_path / "rows") else 0
        assert rows >= 5
        assert {bytes(r.payload) for r in spark.read.parquet(f"{tmp_path}/rows").collect()} == {b"datagram"}
        assert streams.flow_rate(query)
    finally:
        query.stop()


def test_averages_without_gaps(spark):
    """A key whose rows never leave a gap, over many chunks, with zeros and long silences, against a plain fold."""
    rows, t = [], 0
    for i in range(6000):
        t += (1, 7, 400, 3_000_000, 59_000_000)[i % 5] + (0 if i % 997 else 700_000_000)
        rows.append(("k" if i % 3 else None, t, i, float((i * 7919) % 101 if i % 11 else 0)))
    df = spark.createDataFrame(rows, "k string, t long, event_id long, v double").withColumn("ts", F.timestamp_micros("t"))
    got = {r.event_id: r.n for r in mavg.series(df, ["k"], "v", 60).collect()}
    last = {}
    for k, t, i, v in rows:
        us, n = last.get(k, (None, 0.0))
        n = v if us is None or t - us >= 60_000_000 else n * (1 - (t - us) / 60_000_000) + v
        last[k] = (t, n)
        assert abs(got[i] - n) <= 1e-9 * max(n, 1e-30), (i, got[i], n)


def test_intervals_merge(spark):
    rows = [(0, 10), (5, 20), (20, 30), (86_000, 90_000), (86_399, 100_000), (7, 7), (200_000, 200_001)]
    df = spark.createDataFrame(rows, "a long, b long").select(F.timestamp_seconds("a").alias("start"), F.timestamp_seconds("b").alias("end"))
    got = windows.merge_intervals(df).select(F.unix_seconds("start").alias("a"), F.unix_seconds("end").alias("b")).collect()
    assert sorted(map(tuple, got)) == [(0, 30), (86_000, 100_000), (200_000, 200_001)]


def test_alert_stream_by_the_clock(spark, tmp_path):
    """What time alone causes: the wait, its end, and keys that fall below a limit; the same as the batch's states."""
    base = 1_700_000_000
    rows = [(base, 1, 100), (base + 1, 1, 50), (base + 400, 1, 0), (base + 900, 1, 0), (base + 5000, 2, 1)]
    df = spark.createDataFrame([(t, k, v, i) for i, (t, k, v) in enumerate(rows)], "t long, k long, v long, event_id long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    for i in range(len(rows)):
        df.where(F.col("event_id") == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = drained(streams.alerts(stream, ["k"], "v", 10, 30, default=5.0, late="1 second"), "test").where("k = 1").collect()
    broken = mavg.over(mavg.series(df, ["k"], "v", 10).withColumn("limit", F.lit(5.0)), 10)
    want = mavg.states(broken, ["k"], 10, 30).collect()
    assert sorted((r.at_us, r.state) for r in found) == sorted((r.at_us, r.state) for r in want)
    assert [s for _, s in sorted((r.at_us, r.state) for r in want)] == ["NEW", "UPDATE", "ALMOST_GONE", "GONE"]
    below = drained(streams.alerts(stream, ["k"], "v", 10, 30, default=5.0, below=True, late="1 second"), "test").where("k = 1").collect()
    states = sorted((r.at_us, r.state) for r in below)
    assert states[0][1] == "NEW" and base * 10**6 + 10**6 < states[0][0] < (base + 11) * 10**6
    assert drained(streams.averages(stream, ["k"], "v", 10, late="1 second"), "test").count() == len(rows)


def test_notifications(spark, tmp_path):
    states = spark.createDataFrame(
        [
            (7, 10, "NEW", 5.9), (7, 1_000_000, "UPDATE", 6.0), (7, 1_500_000, "UPDATE", 7.0), (7, 4_000_000, "UPDATE", 8.2),
            (7, 5_000_000, "ALMOST_GONE", 4.0), (7, 6_000_000, "GONE", 3.0), (8, 20, "NEW", 9.0)
        ],
        "src long, at_us long, state string, value double"
    ).withColumn("limit", F.lit(5.0))
    rows = alerts.notifications(states, ["src"], "mo-m", "level1")
    assert sorted((r.at_us, r.action, r.file, r.body) for r in rows.collect()) == [
        (10, "CREATE", "mo-m-level1-7", "7 5 5"), (20, "CREATE", "mo-m-level1-8", "8 9 5"), (1_000_000, "UPDATE", "mo-m-level1-7", "7 6 5"),
        (4_000_000, "UPDATE", "mo-m-level1-7", "7 8 5"), (6_000_000, "REMOVE", "mo-m-level1-7", "7 3 5")
    ]
    ran = []
    assert alerts.deliver(rows, str(tmp_path / "n"), ("mo", "m", "level1"), "on.sh", "off.sh", ran.append) == 5
    assert os.listdir(tmp_path / "n") == ["mo-m-level1-8"] and (tmp_path / "n/mo-m-level1-8").read_text() == "8 9 5"
    assert ran == [
        ["on.sh", "mo", "m", "level1", f"{tmp_path}/n/mo-m-level1-7", "7", "5", "5"],
        ["on.sh", "mo", "m", "level1", f"{tmp_path}/n/mo-m-level1-8", "8", "9", "5"],
        ["off.sh", "mo", "m", "level1", f"{tmp_path}/n/mo-m-level1-7", "7", "3", "5"]
    ]


def test_sql_text(spark, tmp_path):
    fields = ["packets desc", "src host", "src mac", "sni"]
    table = spark.createDataFrame(
        [(0, 9, 167772161, "02:00:00:00:00:01", "it's"), (0, 5, None, None, None), (0, 12, 1, None, "a")],
        "t long, packets long, src_host long, src_mac string, sni string"
    ).select(F.timestamp_seconds("t").alias("time"), "packets", "src_host", "src_mac", "sni")
    text = {r.nth: r.sql for r in sqltext.inserts(table, "w", fields, limit=2).collect()}
    assert text[0] == "insert into \"w\" values ( to_timestamp(0), 12, '0.0.0.1', NULL, 'a'), ( to_timestamp(0), 9, '10.0.0.1', '02:00:00:00:00:01', 'it\\x27s');"
    assert text[1 << 30] == 'insert into "w" values ( to_timestamp(0), 5, NULL, NULL, NULL);'
    click = [r.sql for r in sqltext.inserts(table.where("packets = 9"), "w", fields, "clickhouse").collect()]
    assert click == ["insert into \"w\" values ( fromUnixTimestamp(0), 9, '10.0.0.1', MACStringToNum('02:00:00:00:00:01'), 'it\\x27s');"]
    assert sqltext.create("w", fields, "clickhouse", "ZSTD")[0] == 'create table if not exists "w" (time DateTime codec(ZSTD), packets UInt64 codec(ZSTD), src_host Nullable(IPv4) codec(ZSTD), src_mac Nullable(UInt64) codec(ZSTD), sni Nullable(String) codec(ZSTD)) ENGINE = MergeTree() primary key time;'
    plain = ["packets desc", "src as"]
    sqltext.write(table.select("time", "packets", F.lit(7).alias("src_as")), str(tmp_path / "sql"), "w", plain)
    con = duckdb.connect()
    assert sqltext.load(str(tmp_path / "sql"), con.execute, str(tmp_path / "failed")) == []
    assert con.sql('SELECT packets, src_as FROM "w" ORDER BY 1').fetchall() == [(5, 7), (9, 7), (12, 7)]
    (tmp_path / "sql/bad.sql").write_text("no sql")
    assert len(sqltext.load(str(tmp_path / "sql"), con.execute, str(tmp_path / "failed"))) == 1 == len(os.listdir(tmp_path / "failed"))


def test_flow_dump_and_names(spark):
    df = spark.createDataFrame([(1, 167772161, "host.", None, 5), (2, None, None, "s", 1)], "in_bytes long, ip4_src_addr long, dns_name string, sni string, sampling_rate long")
    assert sorted(r[0] for r in df.select(dump.flow_text(df)).collect()) == ["in_bytes: 1; ip4_src_addr: 10.0.0.1; dns_name: host.; *rate 5", "in_bytes: 2; sni: s; *rate 1"]
    assert windows.with_names(df, ["sni", "octets"]).count() == windows.with_names(df, ["dns-name", "octets"]).count() == 1
    missing = enrich.enrich(df, enrich.Databases(), ["city(src host) 'x' or asn(src host) 5"])
    assert missing.where(enrich.matching(["not city(src host) 'x'"])).count() == 2
    assert "city__ip4_src_addr" in missing.columns
    with pytest.raises(dsl.FilterError):
        dsl.parse_field("city(host)")
    tree = config.monitoring_object({"filter": "src host 10.0.0.1", "fwm": [{"name": "w", "fields": ["octets"]}]}, "mo")
    out = monitor.evaluate(df.withColumn("ts", F.timestamp_seconds(F.lit(0))), [tree]).tables["mo_w"].collect()
    assert [r.octets for r in out] == [5]
