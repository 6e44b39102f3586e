"""Reports over exported window tables (time, keys, counters)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_with_other(table: DataFrame, key: str, value: str, n: int = 20, scale: Column | None = None, unknown: str = "?") -> DataFrame:
    """(time, name, value): the n keys of greatest total (ties: by name) by name, all others as Other."""
    named = table.withColumn("_name", F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit(unknown)))
    top = named.groupBy("_name").agg(F.sum(value).alias("_t")).orderBy(F.col("_t").desc(), "_name").limit(n).select(F.col("_name").alias("_k"))
    marked = named.join(F.broadcast(top), named["_name"] == top["_k"], "left")  # at most n rows
    out = marked.groupBy("time", F.when(F.col("_k").isNotNull(), F.col("_name")).otherwise("Other").alias("name")).agg(F.sum(value).cast("long").alias(value))
    return out if scale is None else out.withColumn(value, scale)


def in_and_out(ingress: DataFrame, egress: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer join of two series by keys: what is absent is 0, egress counts negative."""
    a = ingress.groupBy(*keys).agg(F.sum(value).cast("long").alias("ingress"))
    b = egress.groupBy(*keys).agg(F.sum(value).cast("long").alias("egress"))
    return a.join(b, keys, "full_outer").select(*keys, F.coalesce("ingress", F.lit(0)).alias("ingress"), (-F.coalesce("egress", F.lit(0))).alias("egress"))


def nearest(time: Column, seconds: int) -> Column:
    """The nearest multiple of so many seconds."""
    return (F.round(F.unix_seconds(time) / seconds) * seconds).cast("long")


def floored(time: Column, seconds: int) -> Column:
    s = F.unix_seconds(time)
    return s - F.pmod(s, F.lit(seconds))


def crosstab(table: DataFrame, row: str, column: str, names: list[str], value: str) -> DataFrame:
    """One column for each name, 0 where there is nothing."""
    return table.groupBy(row).pivot(column, names).agg(F.sum(value).cast("long")).fillna(0)
