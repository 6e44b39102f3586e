"""Columns for functions that need a database (geography, AS) or the whole table (mfreq): added before filters and windows."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dsl
from ..functions import flow as fn
from . import lookup


@dataclass
class Databases:
    """Prefix tables of geography (dsl.GEO) and of AS (asn, asd), and the lists that filters name."""

    geo: DataFrame | None = None
    asn: DataFrame | None = None
    lists: dict[str, list[str]] = field(default_factory=dict)


def most_frequent(flows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """flows with the one of two ports that more flows have on either side, the smaller of equally frequent ones.

    The counts are one row a port, aggregated before they are shuffled, and broadcast.
    """
    x, y = fn.absent_as_zero(F.col(a)), fn.absent_as_zero(F.col(b))
    pairs = flows.groupBy(x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("n"))
    counts = pairs.select(F.explode(F.array("x", "y")).alias("_p"), "n").groupBy("_p").agg(F.sum("n").alias("_c"))
    left, right = counts.toDF("_p1", "_c1"), counts.toDF("_p2", "_c2")
    own = [F.col(f"`{c}`") for c in flows.columns]
    out = flows.join(lookup.small(left), x == left["_p1"], "left").join(lookup.small(right), y == right["_p2"], "left")
    port = F.when(F.col("_c1") > F.col("_c2"), x).when(F.col("_c1") < F.col("_c2"), y).otherwise(F.least(x, y))
    return out.select(*own, port.alias(name))


def enrich(flows: DataFrame, databases: Databases, filters: Iterable[str] = (), fields: Iterable[str] = ()) -> DataFrame:
    """flows with the columns that the filters' and fields' functions ask for; without a database every lookup misses."""
    needed: dict[str, dsl.Rule] = {}
    for text in filters:
        needed |= dsl.lookups(dsl.parse(text))
    for text in fields:
        needed |= dsl.lookups(dsl.parse_field(text).rule)
    by_table: dict[tuple[str, str], dict[str, str]] = {}
    for column, rule in needed.items():
        if column in flows.columns:
            continue
        if rule.name == "mfreq":
            flows = most_frequent(flows, *[dsl._column_name(a) for a in rule.args], column)
        else:
            of = "asn" if rule.name in ("asn", "asd") else "geo"
            by_table.setdefault((of, dsl._column_name(rule.args[0])), {})[rule.name] = column
    for (of, addr), columns in by_table.items():
        table = databases.asn if of == "asn" else databases.geo
        default = {k: "0" if k == "asn" else "?" for k in columns}
        if table is None:
            flows = flows.select("*", *[F.lit(d).alias(columns[k]) for k, d in default.items()])
        else:
            flows = lookup.longest(flows, addr, table, default, 6 if addr.startswith("ip6") else 4, columns)
        if "asn" in columns:
            flows = flows.withColumn(columns["asn"], F.col(columns["asn"]).cast("long"))
    return flows


def matching(filters: Iterable[str], lists: dict[str, list[str]] | None = None) -> Column:
    """The condition that all filters hold, from a root object's down to its child's."""
    out = F.lit(True)
    for text in filters:
        out = out & dsl.compile_filter(dsl.parse(text), lists)
    return out
