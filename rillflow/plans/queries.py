"""Registered queries over flow tables and their SQL.

Times in results are whole seconds since 1970, so that both engines give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dsl
from ..functions import flow as fn
from ..operators import classify, lookup, mavg, windows
from . import reports
from .views import EFLOWS_SQL, FLOWS_SQL, eflows, flows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_VIEWS = f"WITH flows AS ({FLOWS_SQL}), eflows AS ({EFLOWS_SQL})"
_KEYS = ["flow_order", "flow_line"]
_PORT_NAME = "CASE {0} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in fn.PORTS.items()) + " END"
_PROTO_NAME = "CASE {0} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in fn.PROTOCOLS.items()) + " END"


def _query(name: str, sql: str | None = None, views: str = _VIEWS):
    def put(f):
        f.__name__ = name
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"{views}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}"
        return f

    return put


# Filters: the flows that match, by their keys.
_FILTERS = {
    "flt_cidr": ("dst net 192.168.0.0/18", "ip4_dst_addr BETWEEN 3232235520 AND 3232251903"),
    "flt_host_list": ("src host 10.0.0.1 or 10.0.0.7 or 10.0.0.20", "ip4_src_addr IN (167772161, 167772167, 167772180)"),
    "flt_net_both": ("net 10.0.0.0/28 or 192.168.1.0/24", "ip4_src_addr BETWEEN 167772160 AND 167772175 OR ip4_dst_addr BETWEEN 3232235776 AND 3232236031"),
    "flt_not_and_or": ("not proto 6 and (dst port 53 or 123) or src as 64512-64515", "(protocol <> 6 AND l4_dst_port IN (53, 123)) OR src_as BETWEEN 64512 AND 64515"),
    "flt_range_list": ("packets 1-5 or 40-0x32 and ifidx 3", "(in_pkts BETWEEN 1 AND 5 OR in_pkts BETWEEN 40 AND 50) AND (input_snmp = 3 OR output_snmp = 3)"),
    "flt_absent_is_zero": ("vlan 0 and proto icmp and tcp-flags 2", "protocol = 1 AND tcp_flags = 2"),
    "flt_nested_mo": ("(proto udp) and (src net 10.0.0.0/8) and (dst port domain)", "protocol = 17 AND ip4_src_addr BETWEEN 167772160 AND 184549375 AND l4_dst_port = 53"),
    "flt_div": ("div(octets, packets) 900-1100", "in_pkts <> 0 AND in_bytes // in_pkts BETWEEN 900 AND 1100"),
    "flt_div_r": ("div_r(octets, packets, 100) 1000", "in_pkts <> 0 AND in_bytes // in_pkts // 100 * 100 = 1000"),
    "flt_div_l": ("div_l(octets, packets, 10) 1000", "in_pkts <> 0 AND in_bytes // in_pkts BETWEEN 1000 AND 9999"),
    "flt_min": ("min(src port, dst port) 22-53", "least(l4_src_port, l4_dst_port) BETWEEN 22 AND 53"),
    "flt_tfstr": ("tfstr(tcp-flags) 'ack+psh'", "tcp_flags = 24"),
    "flt_portstr": ("portstr(dst port) 'HTTPS (443)'", "l4_dst_port = 443"),
    "flt_ppstr": ("ppstr(src port, dst port) '-> https(443)'", "l4_dst_port = 443 AND l4_src_port > 443 AND " + _PORT_NAME.format("l4_src_port") + " IS NULL"),
}
for _name, (_text, _sql) in _FILTERS.items():

    @_query(_name, f"SELECT flow_order, flow_line, in_bytes FROM flows WHERE {_sql}")
    def _filtered(spark, sf_dir, text=_text):
        return dsl.where(_absent(flows(spark, sf_dir)), text).select(*_KEYS, "in_bytes")


def _absent(df: DataFrame) -> DataFrame:
    """df with the wire fields that the derived flows lack, as nulls."""
    from ..schema import FLOW_SCHEMA

    have = set(df.columns)
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in FLOW_SCHEMA.fields if f.name not in have])


def _wide(df: DataFrame) -> DataFrame:
    """Derived IPv6, MAC and string columns."""
    low = F.lpad(F.hex("ip4_src_addr"), 24, "0")
    mac = F.lower(F.lpad(F.hex("input_snmp"), 2, "0"))
    return df.withColumn("ip6_src_addr", F.unhex(F.concat(F.lit("20010DB8"), low))).withColumn("src_mac", F.concat(F.lit("02:00:00:00:00:"), mac)).withColumn("sni", F.concat(F.lit("host"), (F.col("l4_dst_port")).cast("string")))


for _name, _text, _sql in (
    ("flt_v6_cidr", "src net6 2001:db8::a00:0/124", "ip4_src_addr BETWEEN 167772160 AND 167772175"),
    ("flt_mac", "src mac 02:00:00:00:00:03", "input_snmp = 3"),
    ("flt_string", "sni 'host443' or 'host53'", "l4_dst_port IN (443, 53)"),
):

    @_query(_name, f"SELECT flow_order, flow_line, in_bytes FROM flows WHERE {_sql}")
    def _filtered_wide(spark, sf_dir, text=_text):
        return dsl.where(_absent(_wide(flows(spark, sf_dir))), text).select(*_KEYS, "in_bytes")


@_query("fn_labels", f"""SELECT l4_dst_port AS port, protocol, tcp_flags, coalesce({_PORT_NAME.format("l4_dst_port")} || ' (' || l4_dst_port || ')', CAST(l4_dst_port AS VARCHAR)) AS port_label,
    CASE tcp_flags WHEN 2 THEN 'SYN' WHEN 24 THEN 'ACK+PSH' ELSE 'ACK' END AS flag_label, {_PROTO_NAME.format("protocol")} AS proto_label, count(*) AS n FROM flows GROUP BY ALL""")
def _labels(spark, sf_dir):
    df = flows(spark, sf_dir)
    return df.groupBy(
        F.col("l4_dst_port").alias("port"), "protocol", "tcp_flags", fn.portstr(F.col("l4_dst_port")).alias("port_label"),
        fn.tfstr(F.col("tcp_flags")).alias("flag_label"), fn.protocol_name(F.col("protocol")).alias("proto_label")
    ).agg(F.count(F.lit(1)).alias("n"))


@_query("fn_div", """SELECT in_bytes // greatest(in_pkts, 1) AS q, in_bytes // greatest(in_pkts, 1) // 500 * 500 AS q_r,
    CASE WHEN in_bytes // greatest(in_pkts, 1) < 1 THEN 0 ELSE CAST(pow(10, length(CAST(in_bytes // greatest(in_pkts, 1) AS VARCHAR)) - 1) AS BIGINT) END AS q_l, count(*) AS n FROM flows GROUP BY ALL""")
def _divs(spark, sf_dir):
    a, b = F.col("in_bytes"), F.greatest(F.col("in_pkts"), F.lit(1).cast("long"))
    return flows(spark, sf_dir).groupBy(fn.div(a, b).alias("q"), fn.div_r(a, b, 500).alias("q_r"), fn.div_l(a, b, 10).alias("q_l")).agg(F.count(F.lit(1)).alias("n"))


@_query(
    "fn_ipv4",
    "SELECT ip4_src_addr, (ip4_src_addr >> 24) || '.' || ((ip4_src_addr >> 16) & 255) || '.' || ((ip4_src_addr >> 8) & 255) || '.' || (ip4_src_addr & 255) AS text, count(*) AS n FROM flows GROUP BY ALL"
)
def _ipv4(spark, sf_dir):
    return flows(spark, sf_dir).groupBy("ip4_src_addr", fn.ipv4_str(F.col("ip4_src_addr")).alias("text")).agg(F.count(F.lit(1)).alias("n"))


# Lookup joins. The nested prefixes are meant.
_NETS = [("10.0.0.0/8", "A"), ("10.0.0.0/24", "B"), ("10.0.0.0/30", "C")]
_LPM = "CASE WHEN ip4_src_addr BETWEEN 167772160 AND 167772163 THEN 'C' WHEN ip4_src_addr BETWEEN 167772160 AND 167772415 THEN 'B' WHEN ip4_src_addr BETWEEN 167772160 AND 184549375 THEN 'A' ELSE '?' END"
_LIST = [("10.0.0.16/28",), ("10.0.0.3/32",)]
_IN_LIST = "(ip4_src_addr BETWEEN 167772176 AND 167772191 OR ip4_src_addr = 167772163)"
for _name, _anti in (("list_semi", False), ("list_anti", True)):

    @_query(_name, f"SELECT ip4_src_addr, count(*) AS n FROM flows WHERE {'NOT ' * _anti}{_IN_LIST} GROUP BY ALL")
    def _listed(spark, sf_dir, anti=_anti):
        return lookup.members(flows(spark, sf_dir), "ip4_src_addr", lookup.prefixes(spark, [(*x, "x") for x in _LIST], ["name"]), anti).groupBy("ip4_src_addr").agg(F.count(F.lit(1)).alias("n"))


@_query("geo_lpm", f"SELECT {_LPM} AS country, CAST(sum(in_bytes) AS BIGINT) AS octets FROM flows GROUP BY ALL")
def _geo(spark, sf_dir):
    return lookup.longest(flows(spark, sf_dir), "ip4_src_addr", lookup.prefixes(spark, _NETS, ["country"]), {"country": "?"}).groupBy("country").agg(F.sum("in_bytes").alias("octets"))


@_query(
    "asn_lpm",
    f"SELECT CASE {_LPM} WHEN 'C' THEN '65003' WHEN 'B' THEN '65002' WHEN 'A' THEN '65001' ELSE '0' END AS asn, CASE {_LPM} WHEN 'C' THEN 'as C' WHEN 'B' THEN 'as B' WHEN 'A' THEN 'as A' ELSE '?' END AS asd, count(*) AS n FROM flows GROUP BY ALL"
)
def _asn(spark, sf_dir):
    table = lookup.prefixes(spark, [(p, f"6500{1 + 'ABC'.index(x)}", f"as {x}") for p, x in _NETS], ["asn", "asd"])
    return lookup.longest(flows(spark, sf_dir), "ip4_src_addr", table, {"asn": "0", "asd": "?"}).groupBy("asn", "asd").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "geo_range_join",
    "SELECT CASE WHEN ip4_src_addr BETWEEN 167772160 AND 167772200 THEN 'x' WHEN ip4_src_addr BETWEEN 167772201 AND 167772230 THEN 'y' ELSE '?' END AS city, count(*) AS n FROM flows GROUP BY ALL"
)
def _ranges(spark, sf_dir):
    table = spark.createDataFrame([(167772160, 167772200, "x"), (167772201, 167772230, "y")], "start long, end long, city string")
    return lookup.ranges(flows(spark, sf_dir), "ip4_src_addr", table, {"city": "?"}).groupBy("city").agg(F.count(F.lit(1)).alias("n"))


_DEVICES = "ord int, ip long, rate long, skip boolean"
_DEVICE_ROWS = [(0, 2130706432, 10, False), (1, 2130706433, 100, True), (2, 2130706434, 1000, False), (3, 2130706432, 7, True)]
_RATE = "CASE dev_ip WHEN 2130706432 THEN 10 WHEN 2130706433 THEN 100 WHEN 2130706434 THEN 1000 ELSE 1 END"
_MARK = "(CAST(l4_dst_port = 53 AS INT) + CAST(ip4_src_addr BETWEEN 167772160 AND 167772191 AS INT))"
_MARKS = ["dst port 53", "src net 10.0.0.0/27"]


def _marked(spark, sf_dir):
    df = lookup.device_rates(flows(spark, sf_dir), spark.createDataFrame(_DEVICE_ROWS, _DEVICES))
    return df.withColumn("dev_mark", windows.decided([dsl.compile_filter(dsl.parse(m)) for m in _MARKS]))


@_query("dev_rate", f"SELECT dev_ip, {_RATE} AS rate, CAST(sum(in_bytes * {_RATE}) AS BIGINT) AS octets FROM flows GROUP BY ALL")
def _dev_rate(spark, sf_dir):
    return _marked(spark, sf_dir).groupBy("dev_ip", F.col("sampling_rate").alias("rate")).agg(F.sum(F.col("in_bytes") * F.col("sampling_rate")).alias("octets"))


@_query("dev_mark", f"SELECT dev_ip, CAST({_MARK} AS BIGINT) AS mark, count(*) AS n FROM flows GROUP BY ALL")
def _dev_mark(spark, sf_dir):
    return _marked(spark, sf_dir).groupBy("dev_ip", F.col("dev_mark").alias("mark")).agg(F.count(F.lit(1)).alias("n"))


@_query("dev_skip_unmarked", f"SELECT dev_ip, count(*) AS n FROM flows WHERE NOT (dev_ip = 2130706433 AND {_MARK} = 0) GROUP BY ALL")
def _dev_skip(spark, sf_dir):
    return _marked(spark, sf_dir).where(~(F.col("skip") & (F.col("dev_mark") == 0))).groupBy("dev_ip").agg(F.count(F.lit(1)).alias("n"))


# Windows.
DAY7 = 7 * 86400
_END = "sec - sec % {0} + {0}"


def _time(df: DataFrame) -> DataFrame:
    return df.withColumn("time", F.unix_seconds("time"))


def _window_query(name: str, text: str, fields: list[str], seconds: int, sql: str, limit: int = 0, rate=None):
    @_query(name, sql)
    def run(spark, sf_dir):
        df = dsl.where(_absent(flows(spark, sf_dir)), text)
        if rate is not None:
            df = lookup.device_rates(df.drop("sampling_rate"), spark.createDataFrame(_DEVICE_ROWS, _DEVICES))
        out = windows.tumbling(df, fields, seconds, rate=None if rate is None else F.col(rate))
        return _time(windows.top_with_others(out, fields, limit))


_T = _END.format(DAY7)
_window_query(
    "win_total", "", ["octets", "packets"], DAY7,
    f"SELECT {_T} AS time, CAST(sum(in_bytes) AS BIGINT) AS octets, CAST(sum(in_pkts) AS BIGINT) AS packets FROM flows GROUP BY 1"
)
_window_query("win_proto", "", ["proto", "octets desc"], DAY7, f"SELECT {_T} AS time, protocol AS proto, CAST(sum(in_bytes) AS BIGINT) AS octets FROM flows GROUP BY 1, 2")
_window_query(
    "win_multi_agg", "proto 6 or 17", ["src as", "octets", "packets", "bits"], DAY7,
    f"SELECT {_T} AS time, src_as, CAST(sum(in_bytes) AS BIGINT) AS octets, CAST(sum(in_pkts) AS BIGINT) AS packets, CAST(sum(in_bytes * 8) AS BIGINT) AS bits FROM flows WHERE protocol IN (6, 17) GROUP BY 1, 2"
)
_window_query(
    "win_bits_scale", "dst port 443", ["bits desc", "src ifidx"], DAY7,
    f"SELECT {_T} AS time, CAST(sum(in_bytes * 8) AS BIGINT) AS bits, input_snmp AS src_ifidx FROM flows WHERE l4_dst_port = 443 GROUP BY 1, 3"
)
_window_query("win_distinct_keys", "", ["src as", "proto"], DAY7, f"SELECT DISTINCT {_T} AS time, src_as, protocol AS proto FROM flows")
_window_query(
    "win_sampling", "", ["src as", "octets"], DAY7,
    f"SELECT {_T} AS time, src_as, CAST(sum(in_bytes * {_RATE}) AS BIGINT) AS octets FROM flows GROUP BY 1, 2", rate="sampling_rate"
)
_window_query("win_portpair", "", ["ppstr(src port, dst port)", "octets"], 30 * 86400, f"""SELECT {_END.format(30 * 86400)} AS time, CASE
    WHEN a IS NOT NULL AND b IS NOT NULL THEN a || '(' || l4_src_port || ') -> ' || b || '(' || l4_dst_port || ')'
    WHEN l4_src_port = l4_dst_port THEN l4_src_port || ' -> ' || l4_dst_port
    WHEN l4_src_port < l4_dst_port AND b IS NOT NULL THEN l4_src_port || ' -> ' || b || '(' || l4_dst_port || ')'
    WHEN l4_src_port < l4_dst_port AND a IS NOT NULL THEN a || '(' || l4_src_port || ') ->'
    WHEN l4_src_port < l4_dst_port THEN l4_src_port || ' ->'
    WHEN b IS NOT NULL THEN '-> ' || b || '(' || l4_dst_port || ')' WHEN a IS NOT NULL THEN a || '(' || l4_src_port || ') -> ' || l4_dst_port
    ELSE '-> ' || l4_dst_port END AS ppstr_src_port__dst_port_, CAST(sum(in_bytes) AS BIGINT) AS octets
    FROM (SELECT *, {_PORT_NAME.format("l4_src_port")} AS a, {_PORT_NAME.format("l4_dst_port")} AS b FROM flows) GROUP BY 1, 2""")


def _others_sql(where: str, group: str, seconds: int, keys: str, order: str, limit: int, names: list[str], sums: list[str]) -> str:
    k = [n for n in names if n not in sums]
    columns = ", ".join(f"CASE WHEN rn <= {limit} THEN {n} END AS {n}" for n in k)
    return f"""+ w AS (SELECT {_END.format(seconds)} AS time, {keys} FROM flows WHERE {where} GROUP BY {group}),
        r AS (SELECT *, row_number() OVER (PARTITION BY time ORDER BY {order}) AS rn FROM w),
        m AS (SELECT time, CASE WHEN rn <= {limit} THEN rn ELSE {limit} + 1 END AS slot, {columns}, {", ".join(sums)} FROM r)
        SELECT time, {", ".join(k)}, {", ".join(f"CAST(sum({s}) AS BIGINT) AS {s}" for s in sums)} FROM m GROUP BY time, slot, {", ".join(k)}"""


_window_query(
    "win_topn_others", "dst net 192.168.0.0/16", ["packets desc", "octets desc", "src host"], DAY7,
    _others_sql(
        "ip4_dst_addr BETWEEN 3232235520 AND 3232301055", "1, 4", DAY7,
        "CAST(sum(in_pkts) AS BIGINT) AS packets, CAST(sum(in_bytes) AS BIGINT) AS octets, ip4_src_addr AS src_host",
        "packets DESC, octets DESC, src_host", 20, ["packets", "octets", "src_host"], ["packets", "octets"]
    ),
    20
)
_window_query(
    "win_topn_exact_n", "", ["octets desc", "proto"], DAY7,
    _others_sql("true", "1, 3", DAY7, "CAST(sum(in_bytes) AS BIGINT) AS octets, protocol AS proto", "octets DESC, proto", 3, ["octets", "proto"], ["octets"]),
    3
)
_window_query(
    "win_multi_sort", "", ["src as desc", "proto", "packets"], 30 * 86400,
    _others_sql(
        "true", "1, 2, 3", 30 * 86400, "src_as, protocol AS proto, CAST(sum(in_pkts) AS BIGINT) AS packets", "src_as DESC, proto, packets", 10,
        ["src_as", "proto", "packets"], ["packets"]
    ),
    10
)


@_query("mfreq_port", f"""+ ports AS (SELECT l4_src_port AS p FROM flows UNION ALL SELECT l4_dst_port FROM flows), f AS (SELECT p, count(*) AS c FROM ports GROUP BY p)
    SELECT CASE WHEN a.c > b.c THEN a.p WHEN a.c < b.c THEN b.p ELSE least(a.p, b.p) END AS port, count(*) AS n FROM flows JOIN f a ON a.p = l4_src_port JOIN f b ON b.p = l4_dst_port GROUP BY 1""")
def _mfreq(spark, sf_dir):
    df = flows(spark, sf_dir).groupBy("l4_src_port", "l4_dst_port").agg(F.count(F.lit(1)).alias("n"))
    f = df.select(F.explode(F.array("l4_src_port", "l4_dst_port")).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("c"))
    a, b = f.toDF("l4_src_port", "ca"), f.toDF("l4_dst_port", "cb")
    port = F.when(F.col("ca") > F.col("cb"), F.col("l4_src_port")).when(F.col("ca") < F.col("cb"), F.col("l4_dst_port")).otherwise(F.least("l4_src_port", "l4_dst_port"))
    return df.join(a, "l4_src_port").join(lookup.small(b), "l4_dst_port").groupBy(port.alias("port")).agg(F.sum("n").alias("n"))


# Moving averages over events, T = one hour.
SPAN = 3600
_SERIES = f"""+ o AS (SELECT ip4_src_addr AS src, us, event_id, CAST(in_bytes AS DOUBLE) AS v, row_number() OVER (PARTITION BY ip4_src_addr ORDER BY us, event_id) AS rn FROM eflows),
    s AS (SELECT src, us, event_id, rn, v AS n FROM o WHERE rn = 1 UNION ALL
        SELECT o.src, o.us, o.event_id, o.rn, CASE WHEN o.us - s.us < {SPAN}000000 THEN s.n * (1 - (o.us - s.us) / {SPAN}000000.0) + o.v ELSE o.v END FROM s JOIN o ON o.src = s.src AND o.rn = s.rn + 1)"""
_RVIEWS = _VIEWS.replace("WITH", "WITH RECURSIVE", 1)
_LIMIT = "CASE src WHEN 167772161 THEN 2.0 WHEN 167772162 THEN 1.0 ELSE 3.0 END"


def _mavg(spark, sf_dir) -> DataFrame:
    return mavg.series(eflows(spark, sf_dir).withColumnRenamed("ip4_src_addr", "src"), ["src"], "in_bytes", SPAN)


def _limited(spark, values: DataFrame) -> DataFrame:
    return lookup.with_limit(values, spark.createDataFrame([(167772161, 2.0), (167772162, 1.0)], "src long, limit double"), ["src"], 3.0)


@_query("mavg_series", f"{_SERIES} SELECT src, us, event_id, round(n, 3) AS n FROM s", _RVIEWS)
def _mavg_series(spark, sf_dir):
    return _mavg(spark, sf_dir).withColumn("n", F.round("n", 3))


@_query("mavg_final", f"{_SERIES} SELECT src, arg_max(us, rn) AS us, round(arg_max(n, rn), 3) AS n FROM s GROUP BY src", _RVIEWS)
def _mavg_final(spark, sf_dir):
    return mavg.final(_mavg(spark, sf_dir), ["src"]).withColumn("n", F.round("n", 3))


@_query("mavg_overlimit", f"{_SERIES} SELECT src, event_id, {_LIMIT} AS \"limit\" FROM s WHERE n / {SPAN} >= {_LIMIT}", _RVIEWS)
def _mavg_over(spark, sf_dir):
    return mavg.over(_limited(spark, _mavg(spark, sf_dir)), SPAN).select("src", "event_id", "limit")


@_query(
    "mavg_underlimit",
    f"{_SERIES}, e AS (SELECT src, arg_max(us, rn) AS us, arg_max(n, rn) AS n FROM s GROUP BY src), now AS (SELECT max(us) AS now_us FROM s) SELECT src, round(CASE WHEN now_us - us < {SPAN}000000 THEN n * (1 - (now_us - us) / {SPAN}000000.0) ELSE 0 END / {SPAN}, 4) AS per_second FROM e, now WHERE CASE WHEN now_us - us < {SPAN}000000 THEN n * (1 - (now_us - us) / {SPAN}000000.0) ELSE 0 END / {SPAN} < {_LIMIT}",
    _RVIEWS
)
def _mavg_under(spark, sf_dir):
    values = _mavg(spark, sf_dir)
    now = eflows(spark, sf_dir).agg(F.max(F.unix_micros("ts"))).first()[0]
    return mavg.under(_limited(spark, mavg.final(values, ["src"])), SPAN, F.lit(now)).select("src", F.round("per_second", 4).alias("per_second"))


_ALERTS = f"""{_SERIES}, b AS (SELECT src, us, rn, us + CAST(floor({SPAN}000000.0 * greatest(1 - {_LIMIT} / (n / {SPAN}), 0)) AS BIGINT) + 60000000 AS back FROM s WHERE n / {SPAN} >= {_LIMIT}),
    l AS (SELECT *, lag(back) OVER (PARTITION BY src ORDER BY rn) AS was FROM b), a AS (SELECT *, sum(CASE WHEN was IS NULL OR us > was THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY rn) AS alert FROM l),
    alerts AS (SELECT src, min(us) AS start_us, arg_max(back, rn) AS end_us, count(*) AS breaches FROM a GROUP BY src, alert)"""


def _alerts(spark, sf_dir) -> DataFrame:
    return mavg.alerts(mavg.over(_limited(spark, _mavg(spark, sf_dir)), SPAN), ["src"], SPAN, 60)


@_query("alert_intervals", f"{_ALERTS} SELECT src, start_us, end_us // 1000000 AS end_s, breaches FROM alerts", _RVIEWS)
def _alert_intervals(spark, sf_dir):
    return _alerts(spark, sf_dir).select("src", "start_us", F.floor(F.col("end_us") / 1_000_000).alias("end_s"), "breaches")


@_query(
    "alert_ext_window",
    f"{_ALERTS} SELECT protocol, count(*) AS n, CAST(sum(in_bytes) AS BIGINT) AS octets FROM eflows e WHERE EXISTS (SELECT 1 FROM alerts x WHERE e.us >= x.start_us AND e.us < x.end_us // 1000000 * 1000000) GROUP BY ALL",
    _RVIEWS
)
def _alert_ext(spark, sf_dir):
    spans = _alerts(spark, sf_dir).select(F.timestamp_micros("start_us").alias("start"), F.timestamp_seconds(F.floor(F.col("end_us") / 1_000_000)).alias("end"))
    return windows.gated(eflows(spark, sf_dir), spans).groupBy("protocol").agg(F.count(F.lit(1)).alias("n"), F.sum("in_bytes").alias("octets"))


# Classification, 30-day periods.
PERIOD = 30 * 86400
_CLASSES = f"""+ g AS (SELECT sec - sec % {PERIOD} AS period, l4_dst_port AS port, protocol, CAST(sum(in_bytes) AS BIGINT) AS s FROM flows GROUP BY 1, 2, 3),
    c AS (SELECT *, sum(s) OVER (PARTITION BY period) AS total, coalesce(sum(s) OVER (PARTITION BY period ORDER BY s DESC, port, protocol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        row_number() OVER (PARTITION BY period ORDER BY s DESC, port, protocol) AS rank FROM g),
    k AS (SELECT period, port, protocol, port || '-' || protocol AS class_id, s, s * 100.0 / total AS share, rank FROM c WHERE floor(before * 100 / total) < 70)"""


def _period():
    s = F.unix_seconds("ts")
    return s - F.pmod(s, F.lit(PERIOD))


def _class_keys():
    return {"port": F.col("l4_dst_port"), "protocol": F.col("protocol")}


def _classes(spark, sf_dir) -> DataFrame:
    return classify.train(flows(spark, sf_dir), _period(), _class_keys(), F.col("in_bytes"), 70)


@_query("clsf_train", f"{_CLASSES} SELECT period, port, protocol, class_id, s, rank FROM k")
def _clsf_train(spark, sf_dir):
    return _classes(spark, sf_dir).drop("share")


@_query("clsf_share", f"{_CLASSES} SELECT period, class_id, round(share, 4) AS share FROM k")
def _clsf_share(spark, sf_dir):
    return _classes(spark, sf_dir).select("period", "class_id", F.round("share", 4).alias("share"))


@_query(
    "clsf_apply",
    f"{_CLASSES} SELECT coalesce(k.class_id, '') AS class_id, count(*) AS n, CAST(sum(in_bytes) AS BIGINT) AS octets FROM flows LEFT JOIN k ON k.period + {PERIOD} = sec - sec % {PERIOD} AND k.port = l4_dst_port AND k.protocol = flows.protocol GROUP BY 1"
)
def _clsf_apply(spark, sf_dir):
    return classify.apply(flows(spark, sf_dir), _period(), PERIOD, _class_keys(), _classes(spark, sf_dir)).groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.sum("in_bytes").alias("octets"))


@_query(
    "clsf_names",
    f"{_CLASSES} SELECT DISTINCT class_id, coalesce({_PORT_NAME.format('port')}, CAST(port AS VARCHAR)) || ',' || {_PROTO_NAME.format('protocol')} AS name FROM k"
)
def _clsf_names(spark, sf_dir):
    port = F.coalesce(fn._named(F.col("port")), F.col("port").cast("string"))
    return _classes(spark, sf_dir).select("class_id", F.concat_ws(",", port, fn.protocol_name(F.col("protocol"))).alias("name")).distinct()


# Reports over window tables.
_SRC = f"+ t AS (SELECT {_T} AS time, ip4_src_addr AS src, ip4_dst_addr AS dst, protocol AS proto, src_as, input_snmp, output_snmp, CAST(sum(in_bytes) AS BIGINT) AS octets, CAST(sum(in_pkts) AS BIGINT) AS packets FROM flows GROUP BY ALL)"


def _table(spark, sf_dir) -> DataFrame:
    t = windows.tumbling(flows(spark, sf_dir), ["src host", "dst host", "proto", "src as", "src ifidx", "dst ifidx", "octets", "packets"], DAY7)
    return t.toDF("time", "src", "dst", "proto", "src_as", "input_snmp", "output_snmp", "octets", "packets").withColumn("time", F.unix_seconds("time"))


def _report(name: str, sql: str):
    def put(f):
        return _query(name, f"{_SRC}{sql}")(lambda spark, sf_dir: f(_table(spark, sf_dir)))

    return put


AS_OF = 883612800  # the end of the reports' time, a fixed moment in place of now
_sum = lambda c: F.sum(c).cast("long").alias(c)


@_report("rpt_total", f" SELECT CAST(sum(octets) AS BIGINT) AS octets FROM t WHERE time >= {AS_OF} - 90 * 86400 AND time < {AS_OF}")
def _r1(t):
    return t.where((F.col("time") >= AS_OF - 90 * 86400) & (F.col("time") < AS_OF)).agg(_sum("octets"))


@_report("rpt_by_dst", " SELECT dst, CAST(sum(octets) AS BIGINT) AS octets FROM t GROUP BY 1 ORDER BY 2 DESC, 1")
def _r2(t):
    return t.groupBy("dst").agg(_sum("octets")).orderBy(F.col("octets").desc(), "dst")


@_report(
    "rpt_prev_month",
    f" SELECT dst, CAST(sum(octets) AS BIGINT) AS octets FROM t WHERE to_timestamp(time) >= date_trunc('month', to_timestamp({AS_OF})) - INTERVAL 1 MONTH AND to_timestamp(time) < date_trunc('month', to_timestamp({AS_OF})) GROUP BY 1"
)
def _r3(t):
    at = F.timestamp_seconds("time")
    month = F.date_trunc("month", F.timestamp_seconds(F.lit(AS_OF)))
    return t.where((at >= month - F.expr("INTERVAL 1 MONTH")) & (at < month)).groupBy("dst").agg(_sum("octets"))


@_report("rpt_scanners", " SELECT src, count(*) AS targets FROM (SELECT DISTINCT src, dst FROM t) GROUP BY 1")
def _r4(t):
    return t.select("src", "dst").distinct().groupBy("src").agg(F.count(F.lit(1)).alias("targets"))


@_report(
    "rpt_pivot",
    " SELECT time, CAST(coalesce(sum(octets) FILTER (proto = 1), 0) AS BIGINT) AS icmp, CAST(coalesce(sum(octets) FILTER (proto = 6), 0) AS BIGINT) AS tcp, CAST(coalesce(sum(octets) FILTER (proto = 17), 0) AS BIGINT) AS udp FROM t GROUP BY 1"
)
def _r5(t):
    return reports.crosstab(t.withColumn("name", fn.protocol_name(F.col("proto"))), "time", "name", ["icmp", "tcp", "udp"], "octets")


def _other_sql(key: str, n: int, value: str, scale: str = "{}") -> str:
    return f""", top AS (SELECT {key} AS k FROM t GROUP BY 1 ORDER BY sum({value}) DESC, CAST({key} AS VARCHAR) LIMIT {n})
        SELECT time, CASE WHEN {key} IN (SELECT k FROM top) THEN CAST({key} AS VARCHAR) ELSE 'Other' END AS name, {scale.format(f'CAST(sum({value}) AS BIGINT)')} AS {value} FROM t GROUP BY 1, 2"""


@_report("rpt_topn_other", _other_sql("src", 20, "octets", f"{{}} // {DAY7} * 8"))
def _r6(t):
    return reports.top_with_other(t, "src", "octets", 20, F.expr(f"octets div {DAY7} * 8"))


@_report("rpt_xe_rep", _other_sql("src_as", 15, "packets"))
def _r10(t):
    return reports.top_with_other(t, "src_as", "packets", 15)


@_report("rpt_total_bps", f" SELECT time, CAST(sum(octets) AS BIGINT) // {DAY7} * 8 AS bps FROM t GROUP BY 1")
def _r7(t):
    return t.groupBy("time").agg(_sum("octets")).select("time", F.expr(f"octets div {DAY7} * 8").alias("bps"))


@_report("rpt_proto_names", f" SELECT time, {_PROTO_NAME.format('proto')} AS name, CAST(sum(octets) AS BIGINT) AS octets FROM t GROUP BY 1, 2")
def _r8(t):
    names = t.sparkSession.createDataFrame(list(fn.PROTOCOLS.items()), "num int, name string")
    return t.join(F.broadcast(names), t["proto"] == names["num"]).groupBy("time", "name").agg(_sum("octets"))


_IN, _OUT = "input_snmp < 4", "output_snmp < 4"
for _name, _keys in (("rpt_full_outer", ["time"]), ("rpt_full_outer_proto", ["time", "proto"])):
    _k = ", ".join(_keys)

    @_report(_name, f""", i AS (SELECT {_k}, CAST(sum(octets) AS BIGINT) AS x FROM t WHERE {_IN} AND src_as < 64520 GROUP BY ALL), o AS (SELECT {_k}, CAST(sum(octets) AS BIGINT) AS y FROM t WHERE {_OUT} AND src_as >= 64520 GROUP BY ALL)
        SELECT {_k}, coalesce(x, 0) AS ingress, -coalesce(y, 0) AS egress FROM i FULL JOIN o USING ({_k})""")
    def _r12(t, keys=_keys):
        return reports.in_and_out(t.where(f"{_IN} AND src_as < 64520"), t.where(f"{_OUT} AND src_as >= 64520"), keys, "octets")


@_report("rpt_avg_pps", " SELECT src, CAST(sum(packets) AS DOUBLE) / 86400 AS pps FROM t GROUP BY 1 ORDER BY sum(packets) DESC, src LIMIT 40")
def _r17(t):
    return t.groupBy("src").agg(F.sum("packets").alias("p")).orderBy(F.col("p").desc(), "src").limit(40).select("src", (F.col("p") / 86400).alias("pps"))


@_report("rpt_p95", " SELECT src, percentile_cont(0.95) WITHIN GROUP (ORDER BY packets) AS p95 FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40")
def _r18(t):
    return t.groupBy("src").agg(F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY packets)").alias("p95")).orderBy(F.col("p95").desc(), "src").limit(40)


@_report("rpt_router_ports", " SELECT input_snmp, proto, output_snmp, CAST(sum(octets) AS BIGINT) AS octets FROM t GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 15")
def _r19(t):
    return t.groupBy("input_snmp", "proto", "output_snmp").agg(_sum("octets")).orderBy(F.col("octets").desc(), "input_snmp", "proto", "output_snmp").limit(15)


@_report("rpt_as_donut", """, a AS (SELECT src_as, CAST(sum(octets) AS BIGINT) AS octets FROM t GROUP BY 1), top AS (SELECT * FROM a ORDER BY octets DESC, src_as LIMIT 15)
    SELECT CAST(src_as AS VARCHAR) AS name, octets FROM top UNION ALL SELECT 'Others', CAST(sum(octets) AS BIGINT) FROM a WHERE src_as NOT IN (SELECT src_as FROM top)""")
def _r22(t):
    a = t.groupBy("src_as").agg(_sum("octets"))
    top = a.orderBy(F.col("octets").desc(), "src_as").limit(15)
    rest = a.join(F.broadcast(top.select("src_as")), "src_as", "left_anti").agg(_sum("octets"))
    return top.select(F.col("src_as").cast("string").alias("name"), "octets").unionByName(rest.select(F.lit("Others").alias("name"), "octets"))


@_report("rpt_union_distinct", " SELECT proto AS k, 'proto' AS kind FROM t UNION SELECT input_snmp, 'port' FROM t")
def _r21(t):
    return t.select(F.col("proto").alias("k"), F.lit("proto").alias("kind")).union(t.select("input_snmp", F.lit("port"))).distinct()


@_report("rpt_share", " SELECT src_as, round(CAST(sum(octets) AS DOUBLE) * 100 / (SELECT sum(octets) FROM t), 4) AS share FROM t GROUP BY 1")
def _r16(t):
    a = t.groupBy("src_as").agg(F.sum("octets").alias("o"))
    total = a.agg(F.sum("o").alias("all"))
    return a.crossJoin(F.broadcast(total)).select("src_as", F.round(F.col("o") * 100.0 / F.col("all"), 4).alias("share"))  # one row on the right


@_query("win_rebucket_round", "SELECT CAST(round(sec / 60.0) * 60 AS BIGINT) AS time, CAST(sum(in_bytes) AS BIGINT) AS octets FROM eflows GROUP BY 1")
def _rebucket(spark, sf_dir):
    return eflows(spark, sf_dir).groupBy(reports.nearest(F.col("ts"), 60).alias("time")).agg(_sum("in_bytes").alias("octets"))


@_query("win_rebucket_30min", "SELECT sec - sec % 1800 AS time, protocol, CAST(sum(in_bytes) AS BIGINT) AS octets FROM eflows GROUP BY 1, 2")
def _rebucket30(spark, sf_dir):
    return eflows(spark, sf_dir).groupBy(reports.floored(F.col("ts"), 1800).alias("time"), "protocol").agg(F.sum("in_bytes").alias("octets"))


@_query("win_rate_bps", "SELECT sec - sec % 60 + 60 AS time, CAST(sum(in_bytes) AS BIGINT) // 60 * 8 AS bps, CAST(sum(in_pkts) AS BIGINT) // 60 AS pps FROM eflows GROUP BY 1")
def _rate(spark, sf_dir):
    t = _time(windows.tumbling(eflows(spark, sf_dir), ["octets", "packets"], 60))
    return t.select("time", F.expr("octets div 60 * 8").alias("bps"), F.expr("packets div 60").alias("pps"))


@_query(
    "rpt_dns_unnest",
    "SELECT DISTINCT 'host' || l4_dst_port AS name, ip FROM (SELECT l4_dst_port, unnest(string_split('10.0.0.' || (l4_dst_port % 7) || ',10.0.1.' || (l4_dst_port % 5), ',')) AS ip FROM flows)"
)
def _dns(spark, sf_dir):
    port = F.col("l4_dst_port")
    ips = F.concat(F.lit("{10.0.0."), (port % 7).cast("string"), F.lit(",10.0.1."), (port % 5).cast("string"), F.lit("}"))
    t = flows(spark, sf_dir).select(F.concat(F.lit("host"), port.cast("string")).alias("name"), ips.alias("ips")).distinct()
    return t.select("name", F.explode(F.split(F.regexp_replace("ips", "[{}]", ""), ",")).alias("ip")).distinct()


# Decoders: events as version 5 datagrams of one record each.
@_query("dec_nf5", "SELECT ip4_src_addr, protocol, count(*) AS n, CAST(sum(in_bytes) AS BIGINT) AS octets, CAST(sum(in_pkts) AS BIGINT) AS packets FROM eflows GROUP BY 1, 2")
def _dec_nf5(spark, sf_dir):
    from ..sources import wire

    word = lambda c, digits: F.lpad(F.hex(c), digits, "0")
    header = F.lit("00050001" + "00" * 20)
    record = F.concat(
        header, word(F.col("ip4_src_addr"), 8), F.lit("00" * 12), word(F.col("in_pkts"), 8), word(F.col("in_bytes"), 8), F.lit("00" * 14),
        word(F.col("protocol"), 2), F.lit("00" * 9)
    )
    sent = eflows(spark, sf_dir).select(F.col("ts").alias("recv_ts"), F.lit("10.9.9.9").alias("src_ip"), F.unhex(record).alias("payload"))
    return wire.decode(sent).groupBy("ip4_src_addr", "protocol").agg(F.count(F.lit(1)).alias("n"), F.sum("in_bytes").alias("octets"), F.sum("in_pkts").alias("packets"))
