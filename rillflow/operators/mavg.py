"""Decaying moving averages: N <- N (1 - dt/T) + V within T, else V; limits, alerts and dumps on top.

Times are integer microseconds; values aren't negative. A step is an affine map of N, and such maps
compose, so a key is never folded row by row: its rows are cut into chunks of a quarter of T, in which
the products of the factors stay between 3/4 and 1 and plain window sums give each row's map; a key's
chunks, one row each, are composed the same way; and each row applies its map to the value its chunk
starts from. A key that holds most rows is spread over its chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_LOG = 300.0  # of the products composed at once; what lies before them has decayed by exp(-300)


def _chunk_starts(chunks: DataFrame, keys: list[str], span: int) -> DataFrame:
    """(keys, chunk, before): what is left of the moving average at the first row of each chunk, without that row.

    chunks: (keys, chunk, first, last, log_a, b): over its rows, a chunk makes b + exp(log_a) N of the N before.
    """
    w = Window.partitionBy(*keys).orderBy("chunk")
    gap = (F.col("first") - F.lag("last").over(w)) / F.lit(float(span))
    steps = chunks.withColumn("factor", F.when(gap < 1, 1 - gap).otherwise(0.0))
    steps = steps.withColumn("run", F.sum(F.when(F.col("factor") > 0, 0).otherwise(1)).over(w))
    in_run = Window.partitionBy(*keys, "run").orderBy("chunk")
    steps = steps.withColumn("fall", F.when(F.row_number().over(in_run) == 1, F.lit(0.0)).otherwise(-F.log("factor")) - F.col("log_a"))
    steps = steps.withColumn("fallen", F.sum("fall").over(in_run))
    steps = steps.withColumn("part", F.floor(F.col("fallen") / MOST_LOG))
    in_part = Window.partitionBy(*keys, "run", "part").orderBy("chunk")
    steps = steps.withColumn("base", F.first("fallen").over(in_part))
    since = F.exp(F.col("base") - F.col("fallen"))
    steps = steps.withColumn("own", since * F.sum(F.col("b") * F.exp(F.col("fallen") - F.col("base"))).over(in_part))
    # a part's first chunk takes what the part before leaves, which decays through the rest of the part
    left = F.when(F.lag("run").over(w) == F.col("run"), F.lag("own").over(w) * F.exp(-F.col("fall")))
    steps = steps.withColumn("came", F.when(F.row_number().over(in_part) == 1, left))
    steps = steps.withColumn("came", F.coalesce(F.first("came").over(in_part) * since, F.lit(0.0)))
    steps = steps.withColumn("end", F.col("own") + F.col("came"))
    before = F.when(F.lag("run").over(w) == F.col("run"), F.lag("end").over(w) * F.col("factor"))
    return steps.select(*keys, "chunk", F.coalesce(before, F.lit(0.0)).alias("before"))


def series(rows: DataFrame, keys: list[str], value: str, seconds: int, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """(keys, us, order, n): the moving average's value after each row."""
    span = seconds * 1_000_000
    timed = rows.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), order, F.col(value).cast("double").alias("v"))
    timed = timed.withColumn("chunk", F.floor(F.col("us") / F.lit(span / 4)))
    w = Window.partitionBy(*keys, "chunk").orderBy("us", order)
    timed = timed.withColumn("dt", F.coalesce(F.col("us") - F.lag("us").over(w), F.lit(0)))
    timed = timed.withColumn("log_a", F.sum(F.log1p(-F.col("dt") / F.lit(float(span)))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    timed = timed.withColumn("b", F.sum(F.col("v") * F.exp(-F.col("log_a"))).over(w.rowsBetween(Window.unboundedPreceding, 0)) * F.exp("log_a"))
    last = F.max_by(F.struct("log_a", "b"), F.struct("us", order))
    chunks = timed.groupBy(*keys, "chunk").agg(F.min("us").alias("first"), F.max("us").alias("last"), last.alias("m")).select(*keys, "chunk", "first", "last", "m.log_a", "m.b")
    starts = _chunk_starts(chunks, keys, span)
    starts = starts.select(*[F.col(k).alias(f"_{k}") for k in [*keys, "chunk"]], "before")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "chunk"]]
    return timed.join(starts, same).select(*keys, "us", order, (F.col("b") + F.col("before") * F.exp("log_a")).alias("n"))


def final(values: DataFrame, keys: list[str], order: str = "event_id") -> DataFrame:
    """The last value of each key."""
    return values.groupBy(*keys).agg(F.max_by(F.struct("us", "n"), F.struct("us", order)).alias("last")).select(*keys, "last.us", "last.n")


def decayed(values: DataFrame, seconds: int, now_us) -> DataFrame:
    """n as it stands at a time without rows, and per second."""
    dt = (now_us - F.col("us")) / F.lit(seconds * 1e6)
    return values.withColumn("n", F.when(dt < 1, F.col("n") * (1 - dt)).otherwise(0.0)).withColumn("per_second", F.col("n") / seconds)


def over(values: DataFrame, seconds: int) -> DataFrame:
    """Rows at which the value per second reaches the limit column."""
    return values.where(F.col("n") / seconds >= F.col("limit"))


def under(values: DataFrame, seconds: int, now_us) -> DataFrame:
    """Keys once seen whose value per second has decayed below the limit column."""
    return decayed(values, seconds, now_us).where(F.col("per_second") < F.col("limit"))


def dump(finals: DataFrame, seconds: int, now_us) -> DataFrame:
    """(keys, value, limit, line) of the moving averages that haven't decayed to nothing: the value per second, decayed to now.

    line is the text of a dump: the keys, the value without its fraction, and the limit. finals holds
    us, n and limit besides the keys.
    """
    keys = [c for c in finals.columns if c not in ("us", "n", "limit")]
    rows = decayed(finals, seconds, now_us).where(F.col("per_second") > 0)
    text = F.concat_ws("  ", *[F.col(k).cast("string") for k in keys])
    whole = lambda c: F.floor(c).cast("string")
    line = F.concat(text, F.lit("  :: "), whole(F.col("per_second")), F.lit(" ("), whole(F.col("limit")), F.lit(" )"))
    return rows.select(*keys, F.col("per_second").alias("value"), "limit", line.alias("line"))


def _back(seconds: int) -> Column:
    """When a breach's value will have decayed to the limit."""
    per = F.col("n") / seconds
    return F.col("us") + F.floor(F.lit(seconds * 1e6) * F.greatest(1 - F.col("limit") / per, F.lit(0.0))).cast("long")


def _numbered(breaches: DataFrame, keys: list[str], seconds: int, back_to_norm: int, order: str) -> DataFrame:
    """breaches with calm (when the value is back at the limit), back (and so much later) and alert, counted per key."""
    w = Window.partitionBy(*keys).orderBy("us", order)
    timed = breaches.withColumn("calm", _back(seconds)).withColumn("back", F.col("calm") + back_to_norm * 1_000_000)
    was = F.lag("back").over(w)
    return timed.withColumn("alert", F.sum(F.when(was.isNull() | (F.col("us") > was), 1).otherwise(0)).over(w))


def alerts(breaches: DataFrame, keys: list[str], seconds: int, back_to_norm: int, order: str = "event_id") -> DataFrame:
    """(keys, start_us, end_us, breaches): a breach at or before the recovery of the one before extends its alert.

    An alert recovers when the last breach's value would have decayed to the limit, and back_to_norm more.
    """
    timed = _numbered(breaches, keys, seconds, back_to_norm, order)
    return timed.groupBy(*keys, "alert").agg(F.min("us").alias("start_us"), F.max_by("back", F.struct("us", order)).alias("end_us"), F.count(F.lit(1)).alias("breaches")).drop("alert")


def states(breaches: DataFrame, keys: list[str], seconds: int, back_to_norm: int, order: str = "event_id") -> DataFrame:
    """(keys, at_us, state, value): the life of each alert.

    NEW at its first breach and UPDATE at each later one; ALMOST_GONE when the value is back at the limit
    before the next breach, which ends the wait; GONE when nothing has ended it for back_to_norm.
    """
    timed = _numbered(breaches, keys, seconds, back_to_norm, order)
    w = Window.partitionBy(*keys, "alert").orderBy("us", order)
    following = F.lead("us").over(w)
    timed = timed.withColumn("nth", F.row_number().over(w)).withColumn("next", following)
    event = lambda at, name: F.struct(at.alias("at_us"), F.lit(name).alias("state"))
    seen = F.when(F.col("nth") == 1, event(F.col("us"), "NEW")).otherwise(event(F.col("us"), "UPDATE"))
    calm = F.when(F.col("next").isNull() | (F.col("calm") < F.col("next")), event(F.col("calm"), "ALMOST_GONE"))
    gone = F.when(F.col("next").isNull(), event(F.col("back"), "GONE"))
    every = F.filter(F.array(seen, calm, gone), lambda x: x.isNotNull())
    return timed.select(*keys, (F.col("n") / seconds).alias("value"), F.explode(every).alias("e")).select(*keys, "e.at_us", "e.state", "value")
