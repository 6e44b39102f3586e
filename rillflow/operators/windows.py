"""Fixed windows: sums per epoch-aligned bucket, top rows by the declared order, and one row for the others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dsl import FieldSpec, parse_field
from .lookup import small as broadcast_small


PARTS = 64  # in which a window's rows are ranked first


def bucket(ts: Column, seconds: int) -> Column:
    """The end of the window that holds ts."""
    s = F.unix_seconds(ts.cast("timestamp"))
    return F.timestamp_seconds(s - F.pmod(s, F.lit(seconds)) + seconds)


def tumbling(flows: DataFrame, fields: list[str], seconds: int = 30, ts: str = "ts", rate: Column | None = None) -> DataFrame:
    """time and the fields: summed counters (times the sampling rate) for each group of the others."""
    specs = [parse_field(f) for f in fields]
    rate = F.lit(1) if rate is None else rate
    keys = [s.column.alias(s.name) for s in specs if not s.summed]
    sums = [F.sum(s.column * rate).cast("long").alias(s.name) for s in specs if s.summed]
    grouped = flows.groupBy(bucket(F.col(ts), seconds).alias("time"), *keys)
    out = grouped.agg(*sums) if sums else grouped.agg(F.lit(1).alias("_one"))
    return out.select("time", *[s.name for s in specs])


def order_of(specs: list[FieldSpec]) -> list[Column]:
    return [F.col(s.name).desc_nulls_last() if s.descending else F.col(s.name).asc_nulls_first() for s in specs]


def top_with_others(windowed: DataFrame, fields: list[str], limit: int) -> DataFrame:
    """The first `limit` rows of each window by all fields in their order; the rest in one row of null keys.

    One pass: rows are ranked within hashed parts of a window, each part's rows behind the limit become
    one sum, and only the parts' first rows and sums meet, where they are ranked and summed again.
    """
    specs = [parse_field(f) for f in fields]
    keys, sums = [s.name for s in specs if not s.summed], [s.name for s in specs if s.summed]
    if not limit or not keys:
        return windowed
    order, types = order_of(specs), dict(windowed.dtypes)
    first = Window.partitionBy("time", "_part").orderBy(*order)
    parted = windowed.withColumn("_part", F.pmod(F.xxhash64(*[s.name for s in specs]), F.lit(PARTS)))
    ranked = parted.withColumn("_n", F.row_number().over(first)).withColumn("_slot", F.when(F.col("_n") <= limit, F.col("_n")))
    few = ranked.groupBy("time", "_part", "_slot").agg(*[F.first(k).alias(k) for k in keys], *[F.sum(c).alias(c) for c in sums])
    then = Window.partitionBy("time").orderBy(F.col("_slot").isNull(), *order)
    few = few.withColumn("_n", F.row_number().over(then)).withColumn("_top", (F.col("_n") <= limit) & F.col("_slot").isNotNull())
    slot = F.when(F.col("_top"), F.col("_n")).otherwise(limit + 1).alias("_at")
    out = few.groupBy("time", slot).agg(*[F.first(F.when(F.col("_top"), F.col(k))).alias(k) for k in keys], *[F.sum(c).cast(types[c]).alias(c) for c in sums])
    return out.select(*windowed.columns)


def gated(flows: DataFrame, intervals: DataFrame, ts: str = "ts") -> DataFrame:
    """Flows within any alert interval (start, end); an extended window counts only these.

    Overlapping intervals are merged first, so that each flow meets one of an hour's intervals at most a
    few times; then they are dealt out by hour, the range join is an equi-join, and they are broadcast
    while a count shows them to be few.
    """
    merged = broadcast_small(merge_intervals(intervals))
    hour = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / 3600)
    spans = merged.select("start", "end", F.explode(F.sequence(hour(F.col("start")), hour(F.col("end")))).alias("_hour"))
    tagged = flows.withColumn("_hour", hour(F.col(ts)))
    on = (tagged["_hour"] == spans["_hour"]) & (tagged[ts] >= spans["start"]) & (tagged[ts] < spans["end"])
    return tagged.join(spans, on, "left_semi").drop("_hour")


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """(start, end): the union of the intervals as disjoint ones.

    Gaps and islands within days first, then over what is left of each day, so one task sees only a few
    intervals for each day, however many there are.
    """
    day = F.explode(F.sequence(F.date_trunc("day", "start"), F.date_trunc("day", "end"), F.expr("INTERVAL 1 DAY"))).alias("day")
    cut = intervals.where("start < end").select("start", "end", day)
    stop = F.col("day") + F.expr("INTERVAL 1 DAY")
    cut = cut.select("day", F.greatest("start", "day").alias("start"), F.least(F.col("end"), stop).alias("end")).where("start < end")
    return _islands(_islands(cut, ["day"]).drop("day"), [])


def _islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("new").over(w))
    return marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def decided(conditions: list[Column]) -> Column:
    """How many of the conditions hold: a device's mark."""
    return reduce(lambda a, b: a + b, [F.coalesce(c.cast("long"), F.lit(0)) for c in conditions], F.lit(0).cast("long"))


def with_names(flows: DataFrame, fields: list[str]) -> DataFrame:
    """The flows that a window counts: one that shows DNS names or addresses (or server names) skips flows without them."""
    names = {parse_field(f).name for f in fields}
    if names & {"dns_name", "dns_ips"}:
        flows = flows.where(F.col("dns_name").isNotNull())
    return flows.where(F.col("sni").isNotNull()) if "sni" in names else flows
