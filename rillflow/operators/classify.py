"""Traffic classes: the keys that make up the top percents of a counter, per period, applied to the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS = 64  # by order of magnitude: a period's keys are ranked within these first


def train(flows: DataFrame, period: Column, keys: dict[str, Column], value: Column, percent: int) -> DataFrame:
    """(period, keys, class_id, s, share, rank): keys by value until the running share reaches percent, that key included.

    The keys of a period are summed first. Running sums go in two levels: a table of counts and sums by
    band of the value tells what lies before each band, and only bands that the cut reaches are ranked,
    each on its own. So no task holds a period's keys, of which most are small and never ranked.
    """
    names = list(keys)
    sums = flows.groupBy(period.alias("period"), *[c.alias(k) for k, c in keys.items()]).agg(F.sum(value).cast("long").alias("s"))
    band = F.when(F.col("s") > 0, F.floor(F.log2("s"))).otherwise(-1).cast("int")
    sums = sums.withColumn("band", band)
    bands = sums.groupBy("period", "band").agg(F.sum("s").alias("bs"), F.count(F.lit(1)).alias("bn"))
    above = Window.partitionBy("period").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("period")
    bands = bands.select(
        "period", "band", F.sum("bs").over(whole).alias("total"), F.coalesce(F.sum("bs").over(above), F.lit(0)).alias("sums"),
        F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("ranks")
    )
    reached = bands.where((F.col("total") > 0) & (F.floor(F.col("sums") * 100 / F.col("total")) < percent))
    rows = sums.join(F.broadcast(reached), ["period", "band"])  # at most BANDS + 1 rows a period
    order = Window.partitionBy("period", "band").orderBy(F.col("s").desc(), *names)
    before = F.col("sums") + F.coalesce(F.sum("s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.withColumn("before", before).withColumn("rank", (F.col("ranks") + F.row_number().over(order)).cast("int"))
    kept = ranked.where(F.floor(F.col("before") * 100 / F.col("total")) < percent)
    return kept.select(
        "period", *names, F.concat_ws("-", *[F.col(n).cast("string") for n in names]).alias("class_id"), "s",
        (F.col("s") * 100.0 / F.col("total")).alias("share"), "rank"
    )


def grown(dictionary: DataFrame | None, classes: DataFrame) -> DataFrame:
    """(keys, class_id, name, since, stats): the dictionary after one more period's classes.

    Nothing is ever deleted: a class that is met again keeps its name, which users may have changed,
    and its first period; stats are those of the latest period in which it was a class. classes has
    period, keys, class_id, name, s and share.
    """
    keys = [c for c in classes.columns if c not in ("period", "class_id", "name", "s", "share", "rank")]
    stats = F.concat(
        F.col("s").cast("string"), F.lit(" of "), F.round(F.col("s") * 100.0 / F.col("share")).cast("long").cast("string"), F.lit(", "),
        F.round("share", 2).cast("string"), F.lit("%")
    )
    new = classes.select(*keys, "class_id", "name", F.col("period").alias("since"), stats.alias("stats"), F.col("period").alias("at"), F.lit(1).alias("given"))
    old = new.limit(0) if dictionary is None else dictionary.select(*keys, "class_id", "name", "since", "stats", F.lit(-1).cast("long").alias("at"), F.lit(0).alias("given"))
    first = F.struct("given", "since")
    out = old.unionByName(new).groupBy(*keys, "class_id").agg(F.min_by("name", first).alias("name"), F.min("since").alias("since"), F.max_by("stats", "at").alias("stats"))
    return out


def renamed(dictionary: DataFrame, names: dict[str, str]) -> DataFrame:
    """The dictionary with users' names for some classes; several classes may share one."""
    name = F.col("name")
    if names:
        name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("class_id")), name)
    return dictionary.withColumn("name", name)


def apply_grown(flows: DataFrame, period: Column, keys: dict[str, Column], dictionary: DataFrame) -> DataFrame:
    """flows with class_name of the dictionary's class, if that was known before the flow's period; '' else."""
    names = list(keys)
    known = dictionary.select(*[F.col(n).alias(f"_{n}") for n in names], F.col("name").alias("class_name"), F.col("since").alias("_since"))
    on = period > known["_since"]
    for n, c in keys.items():
        on = on & (c == known[f"_{n}"])
    return flows.join(known, on, "left").drop("_since", *[f"_{n}" for n in names]).withColumn("class_name", F.coalesce("class_name", F.lit("")))


def apply(flows: DataFrame, period: Column, seconds: int, keys: dict[str, Column], classes: DataFrame) -> DataFrame:
    """flows with class_id of the dictionary of the period before; '' where there is none."""
    names = list(keys)
    known = classes.select((F.col("period") + seconds).alias("_period"), *[F.col(n).alias(f"_{n}") for n in names], "class_id")
    tagged = flows.withColumn("_now", period)
    on = tagged["_now"] == known["_period"]
    for n, c in keys.items():
        on = on & (c == known[f"_{n}"])
    return tagged.join(known, on, "left").drop("_now", "_period", *[f"_{n}" for n in names]).withColumn("class_id", F.coalesce("class_id", F.lit("")))
