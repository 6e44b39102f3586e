"""Registered queries over whole subsystems: decoders, streams, trees of monitoring objects, dimension files, exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config, dsl
from ..operators import classify, enrich, lookup, mavg, windows
from ..sinks import sqltext
from ..sources import files, wire
from ..streaming import flows as streams
from ..streaming.store import drained, shared_folder
from . import monitor, queries, reports
from .queries import _absent, _query, _report, _time, _wide
from .views import eflows, flows

# Datagrams are put together as hexadecimal text, so that no Python is needed to make them.


def _word(c, size: int) -> Column:
    """A number as so many bytes, in hexadecimal digits."""
    return F.lpad(F.hex(c), 2 * size, "0")


def _sent(df: DataFrame, text: Column, *more: str) -> DataFrame:
    return df.select(*more, F.col("ts").alias("recv_ts"), F.lit("10.9.9.9").alias("src_ip"), F.unhex(text).alias("payload"))


_DECODED = "SELECT ip4_src_addr, protocol, count(*) AS n, CAST(sum(in_bytes) AS BIGINT) AS octets, CAST(sum(in_pkts) AS BIGINT) AS packets FROM eflows GROUP BY 1, 2"


def _decoded(found: DataFrame) -> DataFrame:
    return found.groupBy("ip4_src_addr", "protocol").agg(F.count(F.lit(1)).alias("n"), F.sum("in_bytes").alias("octets"), F.sum("in_pkts").alias("packets"))


@_query("dec_nf9", _DECODED)
def _dec_nf9(spark, sf_dir):
    """One record a datagram; only every seventh brings the template, some of them after data that needs it."""
    df = eflows(spark, sf_dir)
    template = F.when(F.col("event_id") % 7 == 3, F.lit("0000001801000004" + "00080004" + "00040001" + "00020004" + "00010004")).otherwise(F.lit(""))
    data = F.concat(F.lit("01000011"), _word(F.col("ip4_src_addr"), 4), _word(F.col("protocol"), 1), _word(F.col("in_pkts"), 4), _word(F.col("in_bytes"), 4))
    return _decoded(wire.decode(_sent(df, F.concat(F.lit("00090001" + "00" * 12 + "00000005"), template, data))))


_HOST = "'h' || (event_id % 13)"


@_query("dec_ipfix", f"SELECT {_HOST} AS host, protocol, count(*) AS n, CAST(sum(in_bytes) AS BIGINT) AS octets FROM eflows GROUP BY 1, 2")
def _dec_ipfix(spark, sf_dir):
    """Records with an enterprise field of variable length, between fields of fixed ones."""
    df = eflows(spark, sf_dir)
    host = F.hex(F.concat(F.lit("h"), (F.col("event_id") % 13).cast("string")))
    template = F.lit("0002001801000003" + "00040001" + "87D1FFFF0000BEEF" + "00010008")
    fields = F.concat(_word(F.col("protocol"), 1), _word(F.length(host) / 2, 1), host, _word(F.col("in_bytes"), 8))
    data = F.concat(F.lit("0100"), _word(F.length(fields) / 2 + 4, 2), fields)
    found = wire.decode(_sent(df, F.concat(F.lit("000A0000" + "00" * 8 + "00000007"), template, data)))
    return found.groupBy(F.col("vas_http_host").alias("host"), "protocol").agg(F.count(F.lit(1)).alias("n"), F.sum("in_bytes").alias("octets"))


def _sflow(rate: Column, frame: Column, length: Column) -> Column:
    """A datagram with one flow sample of one raw Ethernet header of so many bytes."""
    size = F.length(frame) / 2
    record = F.concat(F.lit("00000001"), _word(size + 16, 4), F.lit("00000001"), _word(length, 4), F.lit("00000000"), _word(size, 4), frame)
    sample = F.concat(F.lit("00000000" + "00000000"), _word(rate, 4), F.lit("00000000" * 4 + "00000001"), record)
    return F.concat(F.lit("00000005" + "00000001" + "7F000001" + "00000000" * 3 + "00000001" + "00000001"), _word(F.length(sample) / 2, 4), sample)


def _frame(proto: Column, src: Column, l4: Column) -> Column:
    """Ethernet with one VLAN tag, IPv4 and what follows it."""
    ethernet = F.lit("020000000001" + "020000000002" + "81006005" + "0800")
    ip = F.concat(F.lit("4500"), _word(F.length(l4) / 2 + 20, 2), F.lit("00000000" + "40"), _word(proto, 1), F.lit("0000"), _word(src, 4), F.lit("C0A80001"))
    return F.concat(ethernet, ip, l4)


@_query(
    "dec_sflow",
    "SELECT ip4_src_addr, CASE WHEN protocol = 6 THEN 6 ELSE 17 END AS protocol, 443 AS port, 5 AS vlan, count(*) AS n, CAST(sum(in_bytes * (1 + event_id % 4)) AS BIGINT) AS octets FROM eflows GROUP BY 1, 2"
)
def _dec_sflow(spark, sf_dir):
    df = eflows(spark, sf_dir)
    proto = F.when(F.col("protocol") == 6, 6).otherwise(17)
    l4 = F.when(F.col("protocol") == 6, F.lit("C35001BB" + "00" * 8 + "5002" + "00" * 6)).otherwise(F.lit("C35001BB00080000"))
    found = wire.decode(_sent(df, _sflow(1 + F.col("event_id") % 4, _frame(proto, F.col("ip4_src_addr"), l4), F.col("in_bytes"))))
    return found.groupBy("ip4_src_addr", "protocol", F.col("l4_dst_port").alias("port"), F.col("src_vlan").alias("vlan")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("in_bytes") * F.col("sampling_rate")).alias("octets"))


def _dns_payload(k: Column) -> Column:
    """A response about h<k>.net with one A and one AAAA record."""
    label = F.concat(F.lit("h"), k.cast("string"))
    name = F.concat(_word(F.length(label), 1), F.hex(label), F.lit("036E657400"))
    answers = F.concat(F.lit("C00C00010001000000090004" + "0A0000"), _word(k, 1), F.lit("C00C001C0001000000090010" + "20010DB8" + "00" * 11), _word(k, 1))
    return F.concat(F.lit("000181800001000200000000"), name, F.lit("00010001"), answers)


@_query(
    "dec_dns",
    "SELECT 'h' || (event_id % 16) || '.net.' AS name, '{10.0.0.' || (event_id % 16) || ',2001:db8::' || CASE WHEN event_id % 16 = 0 THEN '' ELSE printf('%x', event_id % 16) END || '}' AS ips, count(*) AS n FROM eflows GROUP BY 1, 2"
)
def _dec_dns(spark, sf_dir):
    df = eflows(spark, sf_dir)
    payload = _dns_payload(F.col("event_id") % 16)
    udp = F.concat(F.lit("0035C350"), _word(F.length(payload) / 2 + 8, 2), F.lit("0000"), payload)
    found = wire.decode(_sent(df, _sflow(F.lit(1), _frame(F.lit(17), F.col("ip4_src_addr"), udp), F.lit(100))))
    return found.groupBy(F.col("dns_name").alias("name"), F.col("dns_ips").alias("ips")).agg(F.count(F.lit(1)).alias("n"))


@_query("dec_sni", "SELECT 's' || (event_id % 11) || '.org' AS name, count(*) AS n FROM eflows WHERE event_id % 3 <> 0 GROUP BY 1")
def _dec_sni(spark, sf_dir):
    """Every third payload isn't a handshake and has no name."""
    df = eflows(spark, sf_dir)
    host = F.hex(F.concat(F.lit("s"), (F.col("event_id") % 11).cast("string"), F.lit(".org")))
    n = F.length(host) / 2
    extension = F.concat(F.lit("0000"), _word(n + 5, 2), _word(n + 3, 2), F.lit("00"), _word(n, 2), host)
    body = F.concat(F.lit("0303" + "00" * 32 + "00" + "00021301" + "0100"), _word(F.length(extension) / 2, 2), extension)
    hello = F.concat(F.lit("01"), _word(F.length(body) / 2, 3), body)
    record = F.concat(F.when(F.col("event_id") % 3 == 0, F.lit("17")).otherwise(F.lit("16")), F.lit("0301"), _word(F.length(hello) / 2, 2), hello)
    found = df.select(wire.server_name(F.unhex(record)).alias("name"))
    return found.where("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


# Filters that ask a list, a database or the whole table.
def _databases(spark) -> enrich.Databases:
    nets = [
        ("10.0.0.0/8", "eu", "A", "65001", "as A"), ("10.0.0.0/24", "eu", "B", "65002", "as B"), ("10.0.0.0/30", "oc", "C", "65003", "as C"),
        ("2001:db8::/100", "eu", "D", "65004", "as D"), ("2001:db8::a00:0/122", "oc", "E", "65005", "as E")
    ]
    rows = lookup.prefixes(spark, nets, ["continent", "city", "asn", "asd"])
    geo = rows.select("ver", "plen", "net", "net6", "continent", "city", *[F.lit("?").alias(c) for c in dsl.GEO if c not in ("continent", "city")])
    return enrich.Databases(geo, rows.select("ver", "plen", "net", "net6", "asn", "asd"), {"mynet": ["10.0.0.16/28", "10.0.0.3/32"]})


_FILTERS = {
    "flt_list": ("src host mynet and not dst port 53", f"{queries._IN_LIST} AND l4_dst_port <> 53"),
    "flt_geo": ("city(src host) 'C' or 'A' and proto udp", f"({queries._LPM} IN ('C', 'A') AND protocol = 17)"),
    "flt_geo_miss": ("not continent(dst host) 'eu' and continent(src host) 'oc'", "ip4_src_addr BETWEEN 167772160 AND 167772163"),
    "flt_asn": ("asn(src host) 65001-65002 and dst port 443", f"{queries._LPM} IN ('A', 'B') AND l4_dst_port = 443"),
    "flt_asd": ("asd(src host) 'as C'", f"{queries._LPM} = 'C'"),
    "flt_mfreq": ("mfreq(src port, dst port) 53 or 100-200", "mf = 53 OR mf BETWEEN 100 AND 200"),
}
_MFREQ = """+ ports AS (SELECT l4_src_port AS p FROM flows UNION ALL SELECT l4_dst_port FROM flows), f AS (SELECT p, count(*) AS c FROM ports GROUP BY p),
    flows2 AS (SELECT flows.*, CASE WHEN a.c > b.c THEN a.p WHEN a.c < b.c THEN b.p ELSE least(a.p, b.p) END AS mf FROM flows JOIN f a ON a.p = l4_src_port JOIN f b ON b.p = l4_dst_port)"""
for _name, (_text, _sql) in _FILTERS.items():

    @_query(
        _name,
        f"{_MFREQ} SELECT flow_order, flow_line, in_bytes FROM flows2 WHERE {_sql}" if "mf " in _sql else f"SELECT flow_order, flow_line, in_bytes FROM flows WHERE {_sql}"
    )
    def _asked(spark, sf_dir, text=_text):
        databases = _databases(spark)
        df = enrich.enrich(_absent(flows(spark, sf_dir)), databases, [text])
        return df.where(enrich.matching([text], databases.lists)).select(*queries._KEYS, "in_bytes")


@_query(
    "asd_lpm",
    f"SELECT CASE {queries._LPM} WHEN 'C' THEN 'as C' WHEN 'B' THEN 'as B' WHEN 'A' THEN 'as A' ELSE '?' END AS asd_src_host_, CAST(sum(in_pkts) AS BIGINT) AS packets FROM flows GROUP BY 1"
)
def _asd(spark, sf_dir):
    fields = ["asd(src host)", "packets"]
    df = enrich.enrich(flows(spark, sf_dir), _databases(spark), (), fields)
    return windows.tumbling(df, fields, 10**9).groupBy("asd_src_host_").agg(F.sum("packets").cast("long").alias("packets"))


@_query(
    "geo_lpm6",
    "SELECT CASE WHEN ip4_src_addr BETWEEN 167772160 AND 167772223 THEN 'E' WHEN ip4_src_addr < 268435456 THEN 'D' ELSE '?' END AS city, count(*) AS n FROM flows GROUP BY 1"
)
def _geo6(spark, sf_dir):
    found = lookup.longest(_wide(flows(spark, sf_dir)), "ip6_src_addr", _databases(spark).geo, {"city": "?"}, 6)
    return found.groupBy("city").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "dev_by_id",
    "SELECT dev_ip, input_snmp AS dev_id, CASE WHEN dev_ip = 2130706432 AND input_snmp = 4 THEN 5 WHEN dev_ip = 2130706432 THEN 10 WHEN input_snmp = 1 THEN 20 ELSE 1 END AS rate, count(*) AS n FROM flows GROUP BY ALL"
)
def _dev_by_id(spark, sf_dir):
    """A device given by address and id, one by address, one by id; the first in order counts."""
    rows = [(0, 2130706432, 4, 5, False), (1, 2130706432, None, 10, False), (2, None, 1, 20, False), (3, 2130706433, 1, 99, False)]
    df = flows(spark, sf_dir).withColumn("dev_id", F.col("input_snmp"))
    found = lookup.device_rates(df, spark.createDataFrame(rows, lookup.DEVICE))
    return found.groupBy("dev_ip", "dev_id", F.col("sampling_rate").alias("rate")).agg(F.count(F.lit(1)).alias("n"))


@_query("win_dns_gate", "SELECT 'host' || l4_dst_port AS dns_name, CAST(sum(in_pkts) AS BIGINT) AS packets FROM flows WHERE l4_dst_port IN (53, 443) GROUP BY 1")
def _dns_gate(spark, sf_dir):
    fields = ["dns-name", "packets"]
    port = F.col("l4_dst_port")
    df = _absent(flows(spark, sf_dir)).withColumn("dns_name", F.when(port.isin(53, 443), F.concat(F.lit("host"), port.cast("string"))))
    out = windows.tumbling(windows.with_names(df, fields), fields, 10**9)
    return out.groupBy("dns_name").agg(F.sum("packets").cast("long").alias("packets"))


# Limits from a file, dumps, states of alerts.
@_query("mavg_limits_csv", f"{queries._SERIES} SELECT src, event_id, {queries._LIMIT} AS \"limit\" FROM s WHERE n / {queries.SPAN} >= {queries._LIMIT}", queries._RVIEWS)
def _mavg_csv(spark, sf_dir):
    path = shared_folder(spark, "limits")
    lines = [("# address, limit",), ("10.0.0.1, 2",), ('"10.0.0.2",1.0',)]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(path)
    limits = files.limits(spark, path, ["src host", "octets"]).withColumnRenamed("src_host", "src")
    values = lookup.with_limit(queries._mavg(spark, sf_dir), limits, ["src"], 3.0)
    return mavg.over(values, queries.SPAN).select("src", "event_id", "limit")


_LEFT = f"CASE WHEN now_us - us < {queries.SPAN}000000 THEN n * (1 - (now_us - us) / {queries.SPAN}000000.0) ELSE 0 END / {queries.SPAN}"


@_query("mavg_dump", f"""{queries._SERIES}, e AS (SELECT src, arg_max(us, rn) AS us, arg_max(n, rn) AS n FROM s GROUP BY src), now AS (SELECT max(us) AS now_us FROM s)
    SELECT src, {queries._LIMIT} AS "limit", src || '  :: ' || CAST(floor({_LEFT}) AS BIGINT) || ' (' || CAST(floor({queries._LIMIT}) AS BIGINT) || ' )' AS line FROM e, now WHERE {_LEFT} > 0""", queries._RVIEWS)
def _mavg_dump(spark, sf_dir):
    now = eflows(spark, sf_dir).agg(F.max(F.unix_micros("ts"))).first()[0]
    last = mavg.final(queries._mavg(spark, sf_dir), ["src"])
    return mavg.dump(queries._limited(spark, last), queries.SPAN, F.lit(now)).drop("value")


_STATES = f"""{queries._ALERTS.replace("alerts AS", "x AS", 1)}, t AS (SELECT a.*, lead(us) OVER (PARTITION BY src, alert ORDER BY rn) AS nxt, row_number() OVER (PARTITION BY src, alert ORDER BY rn) AS nth FROM a),
    e AS (SELECT src, us AS at_us, CASE WHEN nth = 1 THEN 'NEW' ELSE 'UPDATE' END AS state FROM t
        UNION ALL SELECT src, back - 60000000, 'ALMOST_GONE' FROM t WHERE nxt IS NULL OR back - 60000000 < nxt
        UNION ALL SELECT src, back, 'GONE' FROM t WHERE nxt IS NULL)"""


@_query("alert_states", f"{_STATES} SELECT src, state, at_us // 1000000 AS at_s, count(*) AS n FROM e GROUP BY ALL", queries._RVIEWS)
def _alert_states(spark, sf_dir):
    broken = mavg.over(queries._limited(spark, queries._mavg(spark, sf_dir)), queries.SPAN)
    found = mavg.states(broken, ["src"], queries.SPAN, 60)
    return found.groupBy("src", "state", F.floor(F.col("at_us") / 1_000_000).alias("at_s")).agg(F.count(F.lit(1)).alias("n"))


# Streams: what the same rows give when they arrive as a stream.
def _stream(spark, sf_dir) -> DataFrame:
    """The events as a stream of flows: what the file source finds under the table's path."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parque[t]")
    proto = F.when(F.col("event_type") == "click", 6).when(F.col("event_type") == "view", 17).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 47).otherwise(50)
    return rows.select(
        F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("user_id") + 167772160).alias("src"), proto.cast("long").alias("protocol"),
        F.floor(F.col("value") * 100).cast("long").alias("in_bytes")
    )


@_query("str_window", "SELECT sec - sec % 60 + 60 AS time, protocol AS proto, CAST(sum(in_bytes) AS BIGINT) AS octets FROM eflows GROUP BY 1, 2")
def _str_window(spark, sf_dir):
    table = drained(streams.windowed(_stream(spark, sf_dir), ["proto", "octets"], 60), "window", "update")
    return _time(streams.newest(table, ["time", "proto"]))


@_query("str_mavg", f"{queries._SERIES} SELECT src, us, event_id, round(n, 3) AS n FROM s", queries._RVIEWS)
def _str_mavg(spark, sf_dir):
    table = drained(streams.averages(_stream(spark, sf_dir), ["src"], "in_bytes", queries.SPAN), "mavg")
    return table.withColumn("n", F.round("n", 3))


@_query("str_alert", f"{_STATES} SELECT src, state, at_us, count(*) AS n FROM e WHERE state IN ('NEW', 'UPDATE') GROUP BY ALL", queries._RVIEWS)
def _str_alert(spark, sf_dir):
    """The states that rows cause; those that the clock causes depend on how far the stream's time has come."""
    limits = {(167772161,): 2.0, (167772162,): 1.0}
    table = drained(streams.alerts(_stream(spark, sf_dir), ["src"], "in_bytes", queries.SPAN, 60, limits, 3.0), "alert")
    return table.where("state IN ('NEW', 'UPDATE')").groupBy("src", "state", "at_us").agg(F.count(F.lit(1)).alias("n"))


# A tree of monitoring objects, and its windows as SQL text.
_TREE = {
    "filter": "dst net 192.168.0.0/16",  # as in a mo.conf
    "fwm": [
        {"name": "proto", "time": 604800, "fields": ["octets desc", "proto"]},
        {"name": "city", "time": 604800, "fields": ["packets desc", "city(src host)"], "limit": 2},
    ],
}
_CHILD = """{ // flows of the object above, of UDP
    "filter": "proto udp", /* all ports */
    "fwm": [{"time": 604800, "name": "dport", "fields": ["octets", "dst port"], "limit": 0}],
}"""


def _tree(spark) -> list[config.MonitoringObject]:
    root = config.monitoring_object(_TREE, "net")
    root.children = [config.monitoring_object(config.loads(_CHILD), "net_udp")]
    return [root]


_IN_NET = "ip4_dst_addr BETWEEN 3232235520 AND 3232301055"


@_query("cfg_tree", f"""+ city AS (SELECT {queries._T} AS time, CAST(sum(in_pkts) AS BIGINT) AS v, {queries._LPM} AS k FROM flows WHERE {_IN_NET} GROUP BY 1, 3),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY time ORDER BY v DESC, k) AS rn FROM city)
    SELECT 'net_proto' AS name, {queries._T} AS time, CAST(protocol AS VARCHAR) AS k, CAST(sum(in_bytes) AS BIGINT) AS v FROM flows WHERE {_IN_NET} GROUP BY 2, 3
    UNION ALL SELECT 'net_udp_dport', {queries._T}, CAST(l4_dst_port AS VARCHAR), CAST(sum(in_bytes) AS BIGINT) FROM flows WHERE {_IN_NET} AND protocol = 17 GROUP BY 2, 3
    UNION ALL SELECT 'net_city', time, CASE WHEN rn <= 2 THEN k END, CAST(sum(v) AS BIGINT) FROM ranked GROUP BY time, CASE WHEN rn <= 2 THEN rn ELSE 3 END, 3""")
def _cfg_tree(spark, sf_dir):
    tables = monitor.evaluate(_absent(flows(spark, sf_dir)).drop("sampling_rate"), _tree(spark), _databases(spark), "flow_order").tables
    plain = lambda name, k, v: _time(tables[name]).select(F.lit(name).alias("name"), "time", F.col(k).cast("string").alias("k"), F.col(v).alias("v"))
    out = plain("net_proto", "proto", "octets")
    for name, k, v in (("net_udp_dport", "dst_port", "octets"), ("net_city", "city_src_host_", "packets")):
        out = out.unionByName(plain(name, k, v))
    return out


@_query("cfg_extended", f"""{queries._ALERTS} SELECT e.sec - e.sec % 60 + 60 AS time, protocol AS proto, CAST(sum(in_bytes) AS BIGINT) AS octets FROM eflows e
    WHERE EXISTS (SELECT 1 FROM alerts x WHERE e.us >= x.start_us AND e.us < x.end_us) GROUP BY 1, 2""", queries._RVIEWS)
def _cfg_extended(spark, sf_dir):
    """An extended window, counted while an alert of the object's moving average lasts; its limits come from a file."""
    path = shared_folder(spark, "limits")
    spark.createDataFrame([("10.0.0.1,2",), ("10.0.0.2,1",)], "value string").coalesce(1).write.text(path)
    conf = {
        "filter": "",
        "mavg": [{"name": "src", "time": str(queries.SPAN), "fields": ["src host", "octets"], "overlimit": [{"name": "level1", "limits": path, "default": [3], "back2norm-time": 60, "ext": ["ext"]}]}],
        "fwm": [{"name": "ext", "extended": True, "time": 60, "fields": ["proto", "octets"]}],
    }
    tree = [config.monitoring_object(conf, "all")]
    return _time(monitor.evaluate(eflows(spark, sf_dir), tree).tables["all_ext"])


@_query("cfg_classes", f"""{queries._CLASSES} SELECT coalesce(n.name, '') AS class0, count(*) AS n FROM flows
    LEFT JOIN (SELECT DISTINCT period, port, protocol, coalesce({queries._PORT_NAME.format('port')}, CAST(port AS VARCHAR)) || ',' || {queries._PROTO_NAME.format('protocol')} AS name FROM k) n
    ON n.period + {queries.PERIOD} = sec - sec % {queries.PERIOD} AND n.port = l4_dst_port AND n.protocol = flows.protocol GROUP BY 1""")
def _cfg_classes(spark, sf_dir):
    """A classifier of a monitoring object, whose names a window of the object shows."""
    conf = {
        "classification": [{"fields": ["dst port", "proto"], "val": "octets desc", "top-percents": 70, "time": queries.PERIOD}],
        "fwm": [{"name": "w", "fields": ["class0", "packets"], "time": 60}]
    }
    found = monitor.evaluate(_absent(flows(spark, sf_dir)).drop("sampling_rate").withColumn("in_pkts", F.lit(1).cast("long")), [config.monitoring_object(conf, "all")]).tables["all_w"]
    return found.groupBy("class0").agg(F.sum("packets").cast("long").alias("n"))


@_query("exp_sql", f"""+ w AS (SELECT {queries._T} AS time, protocol, CAST(sum(in_bytes) AS BIGINT) AS o FROM flows GROUP BY 1, 2)
    SELECT time, 'insert into "all_proto" values ' || string_agg('( to_timestamp(' || time || '), ' || o || ', ' || protocol || ')', ', ' ORDER BY o DESC, protocol) || ';' AS sql FROM w GROUP BY time""")
def _exp_sql(spark, sf_dir):
    fields = ["octets desc", "proto"]
    return _time(sqltext.inserts(windows.tumbling(flows(spark, sf_dir), fields, queries.DAY7), "all_proto", fields).drop("nth"))


@_query(
    "clsf_grown",
    f"""{queries._CLASSES} SELECT class_id, min(period) AS since, arg_max(CAST(s AS VARCHAR) || ' of ' || CAST(round(s * 100.0 / share) AS BIGINT) || ', ', period) AS stats FROM k GROUP BY 1"""
)
def _clsf_grown(spark, sf_dir):
    """The dictionary after all periods, period by period; its stats end with the share."""
    classes = queries._classes(spark, sf_dir).withColumn("name", F.col("class_id"))
    early = classes.where("period < 800000000")
    dictionary = classify.grown(classify.grown(None, early), classes.where("period >= 800000000"))
    return dictionary.select("class_id", "since", F.regexp_extract("stats", "^(.* of .*, )", 1).alias("stats"))


# The rest of the reports.
@_report("rpt_top_dst", queries._other_sql("dst", 15, "octets", f"{{}} // {queries.DAY7} * 8"))
def _r9(t):
    return reports.top_with_other(t, "dst", "octets", 15, F.expr(f"octets div {queries.DAY7} * 8"))


@_report(
    "rpt_as_names",
    f", n AS (SELECT time, src_as || ': as' || (src_as - 64511) AS label, octets FROM t){re.sub(r'FROM t[ ]', 'FROM n ', queries._other_sql('label', 10, 'octets'))}"
)
def _r11(t):
    label = F.concat(F.col("src_as").cast("string"), F.lit(": as"), (F.col("src_as") - 64511).cast("string"))
    return reports.top_with_other(t.withColumn("label", label), "label", "octets", 10)


for _name, _key, _value in (
    ("rpt_talkers_src_octets", "src", "octets"), ("rpt_talkers_src_packets", "src", "packets"), ("rpt_talkers_dst_octets", "dst", "octets"),
    ("rpt_talkers_dst_packets", "dst", "packets")
):

    @_report(_name, queries._other_sql(_key, 10, _value))
    def _r14(t, key=_key, value=_value):
        return reports.top_with_other(t, key, value, 10)


@_query(
    "rpt_minute",
    "SELECT CAST(round(sec / 60.0) * 60 AS BIGINT) AS time, CAST(sum(in_pkts) AS BIGINT) // 60 AS pps, CAST(sum(in_bytes) AS BIGINT) // 60 * 8 AS bps FROM (SELECT DISTINCT sec, ip4_src_addr, protocol, in_pkts, in_bytes FROM eflows) GROUP BY 1"
)
def _r15(spark, sf_dir):
    rows = eflows(spark, sf_dir).select(F.timestamp_seconds(F.unix_seconds("ts")).alias("ts"), "ip4_src_addr", "protocol", "in_pkts", "in_bytes").distinct()
    out = rows.groupBy(reports.nearest(F.col("ts"), 60).alias("time")).agg(F.sum("in_pkts").alias("p"), F.sum("in_bytes").alias("o"))
    return out.select("time", F.expr("p div 60").alias("pps"), F.expr("o div 60 * 8").alias("bps"))


_PORTS = f"+ t AS (SELECT {queries._T} AS time, ip4_dst_addr AS dst, l4_src_port AS sport, l4_dst_port AS dport, CAST(sum(in_pkts) AS BIGINT) AS packets FROM flows WHERE protocol = 17 GROUP BY ALL)"
for _name, _key, _n in (("rpt_dos_dst", "dst", 20), ("rpt_dos_src_port", "sport", 20), ("rpt_dos_dst_port", "dport", 3)):

    @_query(_name, f"{_PORTS}{queries._other_sql(_key, _n, 'packets')}")
    def _r16(spark, sf_dir, key=_key, n=_n):
        t = windows.tumbling(dsl.where(_absent(flows(spark, sf_dir)), "proto udp"), ["dst host", "src port", "dst port", "packets"], queries.DAY7)
        t = _time(t.toDF("time", "dst", "sport", "dport", "packets"))
        return reports.top_with_other(t, key, "packets", n)


_TABLES = ["net_total", "net_saddr", "net_udp_total", "other_total", "net_x"]


@_query("rpt_tables", f"SELECT left(name, length(name) - 6) AS mo FROM (SELECT unnest({_TABLES!r}) AS name) WHERE name LIKE '%\\_total' ESCAPE '\\'", views="")
def _r23(spark, sf_dir):
    """Monitoring objects, told by the names of their tables."""
    names = spark.createDataFrame([(x,) for x in _TABLES], "name string")
    return names.where(F.col("name").like("%\\_total")).select(F.expr("left(name, length(name) - 6)").alias("mo"))


@_report("rpt_attacks", " SELECT DISTINCT dst FROM t WHERE packets >= 45")
def _r23b(t):
    return t.where("packets >= 45").select("dst").distinct()


@_query("fn_escape", r"""SELECT event_type, upper(event_type) || '\x27\x5c' AS text, lower(upper(event_type)) AS low, count(*) AS n FROM events GROUP BY ALL""", views="")
def _escape(spark, sf_dir):
    from ..functions import flow as fn

    raw = F.concat(F.upper("event_type"), F.lit("'\\"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type", fn.escaped(raw).alias("text"), F.lower(F.upper("event_type")).alias("low")).agg(F.count(F.lit(1)).alias("n"))
