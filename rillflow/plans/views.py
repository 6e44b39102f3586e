"""Flow tables derived from the driver's tables by plain column expressions, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHARED = """
    167772160 + l_suppkey AS ip4_src_addr, 3232235520 + (l_partkey % 65536) AS ip4_dst_addr,
    cast(case l_linenumber % 3 when 0 then 1 when 1 then 6 else 17 end as bigint) AS protocol, l_orderkey % 65536 AS l4_src_port,
    cast(case l_linenumber when 1 then 443 when 2 then 80 when 3 then 53 when 4 then 22 when 5 then 25 when 6 then 123 else 0 end as bigint) AS l4_dst_port,
    cast(case l_returnflag when 'A' then 2 when 'N' then 24 else 16 end as bigint) AS tcp_flags,
    cast(floor(l_extendedprice) as bigint) AS in_bytes, cast(floor(l_quantity) as bigint) AS in_pkts, 64512 + (l_suppkey % 32) AS src_as,
    l_suppkey % 8 AS input_snmp, l_partkey % 8 AS output_snmp, 2130706432 + (l_suppkey % 4) AS dev_ip, l_orderkey AS flow_order, l_linenumber AS flow_line"""
FLOWS_SQL = f"SELECT l_shipdate AS ts, cast(floor(epoch(l_shipdate)) as bigint) AS sec, {_SHARED} FROM lineitem"
EFLOWS_SQL = """SELECT ts, event_id, epoch_us(ts) AS us, cast(floor(epoch_us(ts) / 1000000) as bigint) AS sec, 167772160 + user_id AS ip4_src_addr,
    cast(case event_type when 'click' then 6 when 'view' then 17 when 'error' then 1 when 'purchase' then 47 else 50 end as bigint) AS protocol,
    cast(floor(value * 100) as bigint) AS in_bytes, 1 + cast(props::json->>'$.k' as bigint) AS in_pkts FROM events"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("cast(l_shipdate as timestamp) AS ts", *[f"{x.strip()}" for x in _split(_SHARED)])


def eflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    proto = F.when(F.col("event_type") == "click", 6).when(F.col("event_type") == "view", 17).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 47).otherwise(50)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("user_id") + 167772160).alias("ip4_src_addr"), proto.cast("long").alias("protocol"),
        F.floor(F.col("value") * 100).cast("long").alias("in_bytes"), (k + 1).alias("in_pkts"),
    )


def _split(text: str) -> list[str]:
    """The text's items at commas outside parentheses."""
    out, depth, item = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(item)
            item = ""
        else:
            item += c
    return [*out, item]
