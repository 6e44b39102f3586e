"""Alerts outwards: notification files, and scripts run when an alert begins and ends.

Both work on the rows of alert states, (keys, at_us, state, value, limit), of one limit of one moving average.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPDATE_SECONDS = 3
MOST_ROWS = 100_000  # of one batch, handed to the driver's files and scripts


def notifications(states: DataFrame, keys: list[str], prefix: str, limit_name: str, text: Callable[[str], Column] | None = None) -> DataFrame:
    """(at_us, action, file, body, argv of the keys): CREATE at NEW, UPDATE at most every UPDATE_SECONDS, REMOVE at GONE.

    The file is called prefix-limit-keys; the body has the keys, the value and the limit, without fractions.
    text gives a key's text, by default its plain one.
    """
    shown = [(text or (lambda k: F.col(k).cast("string")))(k) for k in keys]
    whole = lambda c: F.floor(c).cast("long").cast("string")
    file = F.concat_ws("-", F.lit(prefix), F.lit(limit_name), *shown)
    rows = states.select(
        *keys, "at_us", "state", "value", "limit", file.alias("file"),
        F.concat_ws(" ", *shown, whole(F.col("value")), whole(F.col("limit"))).alias("body"), F.array(*shown).alias("argv")
    )
    w = Window.partitionBy("file", F.floor(F.col("at_us") / (UPDATE_SECONDS * 1_000_000)), "state").orderBy("at_us")
    first = rows.withColumn("_n", F.row_number().over(w)).where("state <> 'ALMOST_GONE' AND (state <> 'UPDATE' OR _n = 1)")
    action = F.when(F.col("state") == "NEW", "CREATE").when(F.col("state") == "GONE", "REMOVE").otherwise("UPDATE")
    return first.select("at_us", action.alias("action"), "file", "body", "argv", whole(F.col("value")).alias("value"), whole(F.col("limit")).alias("limit"))


def deliver(
    batch: DataFrame, folder: str, names: tuple[str, str, str], on_start: str | None = None, on_end: str | None = None,
    run: Callable[[list[str]], None] | None = None
) -> int:
    """Writes, renews and removes files of notifications in time order and runs the scripts; returns how many rows there were.

    A script gets the object's, moving average's and limit's names, the file, the keys, the value and
    the limit. A batch holds state changes, not flows; more than MOST_ROWS of them raise an error.
    """
    rows = batch.orderBy("at_us", "file").limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} changes of alerts in one batch")
    run = run or (lambda argv: subprocess.Popen(argv, start_new_session=True) and None)
    os.makedirs(folder, exist_ok=True)
    for r in rows:
        path = os.path.join(folder, r["file"].replace(os.sep, "_"))
        if r["action"] == "REMOVE":
            if os.path.exists(path):
                os.remove(path)
        else:
            with open(path, "w") as f:
                f.write(r["body"])
        script = {"CREATE": on_start, "REMOVE": on_end}.get(r["action"])
        if script:
            run([script, *names, path, *r["argv"], r["value"], r["limit"]])
    return len(rows)
