"""Flows and moving averages as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flow as fn
from ..schema import WIRE_FIELDS
from .sqltext import ipv6_str


def _text(name: str, kind: str, most: int) -> Column:
    c = F.col(name)
    if kind == "ADDR":
        return fn.ipv4_str(c) if most == 4 else ipv6_str(c)
    return c.cast("string")


def flow_text(flows: DataFrame) -> Column:
    """'name: value; name: value; …' of the fields that a flow has, then its device, mark and sampling rate."""
    have = set(flows.columns)
    shown = [F.when(F.col(w.name).isNotNull(), F.concat(F.lit(f"{w.name}: "), _text(w.name, w.kind, w.most))) for w in WIRE_FIELDS if w.name in have and w.name != "dev_ip"]
    own = [("dev-ip", "dev_ip", fn.ipv4_str), ("dev-ip6", "dev_ip6", ipv6_str), ("dev-id", "dev_id", None), ("dev-mark", "dev_mark", None), ("rate", "sampling_rate", None)]
    tail = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"*{label} "), f(F.col(c)) if f else F.col(c).cast("string"))) for label, c, f in own if c in have]
    return F.concat_ws("; ", *shown, *tail)


def dump_flows(flows: DataFrame, folder: str) -> None:
    """One line a flow; appends."""
    flows.select(flow_text(flows).alias("value")).write.mode("append").text(folder)


def dump_averages(dumped: DataFrame, folder: str, append: bool = False) -> None:
    """The lines of operators.mavg.dump: replaces the folder, or appends to it."""
    dumped.select("line").write.mode("append" if append else "overwrite").text(folder)
