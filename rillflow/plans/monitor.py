"""A tree of monitoring objects as plans: its windows, moving averages, alerts, extended windows and classes over a table of flows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Average, Limit, MonitoringObject
from ..dsl import parse_field
from ..functions import flow as fn
from ..operators import classify, lookup, mavg, windows
from ..operators.enrich import Databases, enrich, matching
from ..sources import files


@dataclass
class Results:
    """tables: windows by table name; states: alert states by object, average and limit; finals: last averages; classes: by object and number."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    states: dict[tuple[str, str, str], DataFrame] = field(default_factory=dict)
    finals: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    classes: dict[tuple[str, int], DataFrame] = field(default_factory=dict)


def _averages(flows: DataFrame, average: Average, order: str) -> tuple[list[str], DataFrame]:
    """The names of an average's keys, and its series by them of its first counter."""
    specs = [parse_field(f) for f in average.fields]
    keys, counter = [s for s in specs if not s.summed], next(s for s in specs if s.summed)
    rate = F.coalesce(F.col("sampling_rate"), F.lit(1)) if "sampling_rate" in flows.columns else F.lit(1)
    rows = flows.select(*[s.column.alias(s.name) for s in keys], "ts", order, (counter.column * rate).alias("_v"))
    names = [s.name for s in keys]
    return names, mavg.series(rows, names, "_v", average.seconds, order=order)


def _with_limit(values: DataFrame, limit: Limit, average: Average, keys: list[str]) -> DataFrame:
    default = limit.default[0] if limit.default else float("inf")
    if not limit.file:
        return values.withColumn("limit", F.lit(default))
    table = files.limits(values.sparkSession, limit.file, average.fields).select(*keys, "limit")
    return lookup.with_limit(values, table, keys, default)


def _class_name(specs) -> Column:
    """Values as people know them, joined by commas: services, protocols, flags."""
    shown = []
    for s in specs:
        c = F.col(s.name)
        if s.rule.name == "proto":
            shown.append(F.coalesce(fn.protocol_name(c), c.cast("string")))
        elif s.rule.name == "tcp-flags":
            shown.append(fn.tfstr(c))
        elif s.rule.name in ("port", "min", "mfreq"):
            shown.append(F.coalesce(fn.service(c), c.cast("string")))
        else:
            shown.append(c.cast("string"))
    return F.concat_ws(",", *shown)


def evaluate(flows: DataFrame, tree: list[MonitoringObject], databases: Databases | None = None, order: str = "event_id") -> Results:
    """The plans of all objects; nothing runs until a result is read.

    A flow counts in a child only if it counts in all objects above it. Extended windows count the flows
    within alerts of the limits that name them, as window or object/window. Classes of a period are the
    classN of the next period's flows, for the object and those below it.
    """
    databases, out = databases or Databases(), Results()
    every = [(mo, parent) for root in tree for mo, parent in root.walk()]
    texts = [mo.filter for mo, _ in every]
    fields = [f for mo, _ in every for x in [*mo.windows, *mo.averages, *mo.classifiers] for f in x.fields]
    fields += [c.value for mo, _ in every for c in mo.classifiers]
    flows = enrich(flows, databases, dict.fromkeys(texts), dict.fromkeys(fields))
    of: dict[str, DataFrame] = {}
    spans: dict[str, list[DataFrame]] = {}
    for mo, parent in every:
        own = (of[parent.name] if parent else flows).where(matching([mo.filter], databases.lists))
        for c in mo.classifiers:
            own = _classified(own, mo, c, out)
        of[mo.name] = own
        for a in mo.averages:
            keys, values = _averages(own, a, order)
            out.finals[mo.name, a.name] = mavg.final(values, keys, order)
            for limit in a.over:
                broken = mavg.over(_with_limit(values, limit, a, keys), a.seconds)
                states = mavg.states(broken, keys, a.seconds, limit.back_to_norm, order)
                out.states[mo.name, a.name, limit.name] = states
                if limit.ext:
                    alerts = mavg.alerts(broken, keys, a.seconds, limit.back_to_norm, order)
                    span = alerts.select(F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("end_us").alias("end"))
                    for name in limit.ext:
                        target, _, window = name.rpartition("/")
                        spans.setdefault(f"{(target or mo.name).replace('/', '_')}_{window}", []).append(span)
    for mo, _ in every:
        for w in mo.windows:
            counted = windows.with_names(of[mo.name], w.fields)
            if w.extended:
                active = spans.get(mo.table(w.name))
                if active is None:
                    counted = counted.limit(0)
                else:
                    union = active[0]
                    for more in active[1:]:
                        union = union.unionByName(more)
                    counted = windows.gated(counted, union)
            rate = F.coalesce(F.col("sampling_rate"), F.lit(1)) if "sampling_rate" in counted.columns else None
            out.tables[mo.table(w.name)] = windows.top_with_others(windows.tumbling(counted, w.fields, w.seconds, rate=rate), w.fields, w.limit)
    return out


def _classified(flows: DataFrame, mo: MonitoringObject, c, out: Results) -> DataFrame:
    """flows with class<number> of the period before, and the classes put into out."""
    specs, value = [parse_field(f) for f in c.fields], parse_field(c.value)
    s = F.unix_seconds("ts")
    period = s - F.pmod(s, F.lit(c.seconds))
    keys = {x.name: x.column for x in specs}
    classes = classify.train(flows, period, keys, value.column, c.percent).withColumn("name", _class_name(specs))
    out.classes[mo.name, c.number] = classes
    column = f"class{c.number}"
    known = classes.select(*["period", *keys], F.col("name").alias("class_id"))
    return classify.apply(flows.drop(column), period, c.seconds, keys, known).withColumnRenamed("class_id", column)
