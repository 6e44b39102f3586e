"""Structured Streaming: windows, moving averages and alerts over streams of flows, by the definitions of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..dsl import parse_field


def windowed(stream: DataFrame, fields: list[str], seconds: int, ts: str = "ts", late: str = "1 minute") -> DataFrame:
    """The stream's tumbling windows: time (the window's end) and the fields; final once the watermark passes their end."""
    specs = [parse_field(f) for f in fields]
    keys = [s.column.alias(s.name) for s in specs if not s.summed]
    sums = [F.sum(s.column).cast("long").alias(s.name) for s in specs if s.summed] or [F.count(F.lit(1)).alias("flows")]
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, f"{seconds} seconds").alias("w"), *keys).agg(*sums)
    return w.select(F.col("w.end").alias("time"), *[c for c in w.columns if c != "w"])


def newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows that an update-mode stream gave for each key, those of its last batch."""
    values = [c for c in updates.columns if c not in keys and c != "batch"]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*keys, *[f"_last.{v}" for v in values])


STATE = "us long, n double, alert boolean, calm long, back long, worth double"
SERIES = "us long, {order} long, n double"
STATES = "at_us long, state string, value double"


def _rows(frames: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    """A key's rows of one batch in time order; state holds all that came before."""
    return pd.concat([f for f in frames if len(f)], ignore_index=True).sort_values(["us", order], kind="stable")


def _prepared(stream: DataFrame, keys: list[str], value: str, ts: str, order: str, late: str) -> DataFrame:
    rows = stream.withWatermark(ts, late)
    return rows.select(*keys, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), order, F.col(value).cast("double").alias("v"))


def _types(stream: DataFrame, keys: list[str]) -> str:
    return "".join(f"{k} {stream.schema[k].dataType.simpleString()}, " for k in keys)


def averages(stream: DataFrame, keys: list[str], value: str, seconds: int, ts: str = "ts", order: str = "event_id", late: str = "1 minute") -> DataFrame:
    """(keys, us, order, n): the decaying moving average after each row.

    A key's state is its last time and value; it is dropped once the watermark is a whole span behind it,
    when nothing is left of the value. Rows that come later than the state's time don't move it back.
    """
    span = seconds * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, n = state.get[:2] if state.exists else (None, 0.0)
        rows, out = _rows(frames, order), []
        for us, v in zip(rows["us"].tolist(), rows["v"].tolist()):
            dt = None if last is None else max(0, us - last)
            n = v if dt is None or dt >= span else n * (1 - dt / span) + v
            last = us if last is None else max(last, us)
            out.append(n)
        state.update((last, n, False, 0, 0, 0.0))
        state.setTimeoutTimestamp(max((last + span) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({**{k: [x] * len(rows) for k, x in zip(keys, key)}, "us": rows["us"].to_numpy(), order: rows[order].to_numpy(), "n": out})

    rows = _prepared(stream, keys, value, ts, order, late)
    return rows.groupBy(*keys).applyInPandasWithState(step, _types(stream, keys) + SERIES.format(order=order), STATE, "append", GroupStateTimeout.EventTimeTimeout)


def alerts(
    stream: DataFrame, keys: list[str], value: str, seconds: int, back_to_norm: int, limits: dict | None = None, default: float = float("inf"),
    below: bool = False, ts: str = "ts", order: str = "event_id", late: str = "1 minute"
) -> DataFrame:
    """(keys, at_us, state, value): NEW, UPDATE, ALMOST_GONE and GONE of each key's alerts.

    A key is in alert while its average per second reaches its limit (limits by key tuple, or the default).
    Between rows the average only falls, so the moments when it is back at the limit, and has stayed there
    for back_to_norm seconds, are known in advance: the state waits for them by event time. With `below`
    the alert is about keys once seen that have fallen below the limit: it begins when that happens, and
    its wait begins with the next row that reaches the limit.
    """
    span, wait, limits = seconds * 1_000_000, back_to_norm * 1_000_000, limits or {}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        limit, out = limits.get(tuple(key), default), []
        last, n, alert, calm, back, worth = state.get if state.exists else (None, 0.0, False, 0, 0, 0.0)

        def upto(now: int) -> None:
            """What happens by itself before `now`."""
            nonlocal alert, calm
            if below:
                if alert and calm >= 0 and calm + wait < now:
                    out.append((calm + wait, "GONE", n / seconds))
                    alert = False
                elif not alert and last is not None and n / seconds >= limit:
                    falls = last + int(span * (1 - limit * seconds / n)) + 1 if n else last
                    if falls < now:
                        out.append((falls, "NEW", limit))
                        alert, calm = True, -1
            elif alert:
                if worth and calm < now:
                    out.append((calm, "ALMOST_GONE", worth))
                if back < now:
                    out.append((back, "GONE", worth))
                    alert = False

        if state.hasTimedOut:
            upto(state.getCurrentWatermarkMs() * 1000 + 1)
            worth = 0.0
        else:
            rows = _rows(frames, order)
            for us, v in zip(rows["us"].tolist(), rows["v"].tolist()):
                dt = None if last is None else max(0, us - last)
                after = v if dt is None or dt >= span else n * (1 - dt / span) + v
                breach = after / seconds >= limit
                if below or breach or alert and back < us:
                    upto(us)
                n, last = after, us if last is None else max(last, us)
                per = n / seconds
                if below:
                    if alert and breach and calm < 0:
                        out.append((us, "ALMOST_GONE", per))
                        calm = us
                    elif alert and not breach:
                        out.append((us, "UPDATE", per))
                        calm = -1
                elif breach:
                    out.append((us, "UPDATE" if alert else "NEW", per))
                    alert, worth = True, per
                    calm = us + int(span * max(1 - limit / per, 0.0)) if per else us
                    back = calm + wait
        yield pd.DataFrame({**{k: [x] * len(out) for k, x in zip(keys, key)}, "at_us": [x[0] for x in out], "state": [x[1] for x in out], "value": [float(x[2]) for x in out]})
        now = state.getCurrentWatermarkMs()
        ends = [x for x in (last + span, back if alert and not below else 0, calm + wait if alert and below and calm >= 0 else 0) if x]
        if state.hasTimedOut and not alert and now * 1000 >= last + span:
            state.remove()
            return
        state.update((last, n, alert, calm, back, worth))
        later = [x // 1000 + 1 for x in ends if x // 1000 + 1 > now]
        state.setTimeoutTimestamp(min(later) if later else now + 1)

    rows = _prepared(stream, keys, value, ts, order, late)
    return rows.groupBy(*keys).applyInPandasWithState(step, _types(stream, keys) + STATES, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def flow_rate(query) -> list[tuple[str, float]]:
    """(time of the batch, flows a second) of a running query's recent batches."""
    return [(p["timestamp"], float(p.get("inputRowsPerSecond") or 0.0)) for p in query.recentProgress]
