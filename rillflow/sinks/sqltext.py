"""Windows as SQL text, in two dialects: a table, an index, rows, and the row of the others."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dsl import FieldSpec, parse_field
from ..functions import flow as fn
from ..operators.windows import order_of

ROWS = 1000  # of one statement
# Column types by kind of field, in PostgreSQL and in ClickHouse.
TYPES = {
    "postgres": {"ADDR4": "INET", "ADDR6": "INET", "MAC": "macaddr", "STRING": "TEXT", "TEXT": "TEXT", "RANGE": "BIGINT"},
    "clickhouse": {"ADDR4": "Nullable(IPv4)", "ADDR6": "Nullable(IPv6)", "MAC": "Nullable(UInt64)", "STRING": "Nullable(String)", "TEXT": "Nullable(String)", "RANGE": "UInt64"},
}
TIME = {"postgres": "to_timestamp({})", "clickhouse": "fromUnixTimestamp({})"}


def create(table: str, fields: list[str], dialect: str = "postgres", codec: str = "", index: bool = True) -> list[str]:
    """The statements that make a window's table where there is none."""
    types, packed = TYPES[dialect], f" codec({codec})" if codec and dialect == "clickhouse" else ""
    specs = [parse_field(f) for f in fields]
    columns = ["time TIMESTAMPTZ" if dialect == "postgres" else f"time DateTime{packed}", *[f"{s.name} {types[s.kind]}{packed}" for s in specs]]
    out = [f'create table if not exists "{table}" ({", ".join(columns)}){"" if dialect == "postgres" else " ENGINE = MergeTree() primary key time"};']
    if dialect == "postgres" and index:
        out.append(f'create index if not exists "{table}_idx" on "{table}"(time);')
    return out


def ipv6_str(x: Column) -> Column:
    """Eight groups of hexadecimal digits; every reader of addresses takes this form."""
    digits = F.lower(F.hex(x))
    return F.concat_ws(":", *[F.substring(digits, 1 + 4 * k, 4) for k in range(8)])


def value(spec: FieldSpec, dialect: str) -> Column:
    """A field's value as SQL text; NULL where it is absent."""
    c = F.col(spec.name)
    quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    if spec.kind == "ADDR4":
        text = quoted(fn.ipv4_str(c))
    elif spec.kind == "ADDR6":
        text = quoted(ipv6_str(c))
    elif spec.kind == "MAC":
        text = quoted(c) if dialect == "postgres" else F.concat(F.lit("MACStringToNum("), quoted(c), F.lit(")"))
    elif spec.kind in ("STRING", "TEXT"):
        text = quoted(fn.escaped(c.cast("string")))
    else:
        text = c.cast("string")
    return F.when(c.isNull(), F.lit("NULL")).otherwise(text)


def inserts(windowed: DataFrame, table: str, fields: list[str], dialect: str = "postgres", limit: int = 0) -> DataFrame:
    """(time, nth, sql): each window's rows in their order, at most ROWS in a statement; the others, if any, in one of their own."""
    specs = [parse_field(f) for f in fields]
    seconds = F.unix_seconds(F.col("time").cast("timestamp")).cast("string")
    before, after = TIME[dialect].split("{}")
    row = F.concat(F.lit("( " + before), seconds, F.lit(after + ", "), F.concat_ws(", ", *[value(s, dialect) for s in specs]), F.lit(")"))
    keys = [s.name for s in specs if not s.summed]
    others = F.lit(False)
    if limit and keys:  # the row behind the last place is that of the others
        others = F.col("_n") > limit
    unknown = [F.col(k).isNull() for k in keys]
    last = [F.when(sum((u.cast("int") for u in unknown), F.lit(0)) == len(keys), 1).otherwise(0)] if limit and keys else []
    numbered = windowed.withColumn("_n", F.row_number().over(Window.partitionBy("time").orderBy(*last, *order_of(specs))))
    numbered = numbered.withColumn("nth", F.when(others, F.lit(1 << 30)).otherwise(F.floor((F.col("_n") - 1) / ROWS)).cast("int"))
    packed = numbered.groupBy("time", "nth").agg(F.sort_array(F.collect_list(F.struct("_n", row.alias("row")))).alias("rows"))
    text = F.concat(F.lit(f'insert into "{table}" values '), F.concat_ws(", ", F.transform("rows", lambda r: r["row"])), F.lit(";"))
    return packed.select("time", "nth", text.alias("sql"))


def write(windowed: DataFrame, folder: str, table: str, fields: list[str], dialect: str = "postgres", codec: str = "", index: bool = True, limit: int = 0) -> None:
    """One folder for each window's end, with its statements in order; tables are made first."""
    spark = windowed.sparkSession
    rows = inserts(windowed, table, fields, dialect, limit)
    made = create(table, fields, dialect, codec, index)
    first = spark.createDataFrame([(k - len(made), x) for k, x in enumerate(made)], "nth int, sql string")
    times = rows.select("time").distinct()
    every = rows.unionByName(times.join(F.broadcast(first)))
    stamped = every.select(F.unix_seconds(F.col("time").cast("timestamp")).alias("at"), "nth", "sql")
    stamped.repartition("at").sortWithinPartitions("at", "nth").select("at", "sql").write.partitionBy("at").mode("append").text(f"{folder}/{table}")


def load(folder: str, execute: Callable[[str], None], failed: str) -> list[str]:
    """Runs each file's statements between BEGIN and COMMIT and removes it; a file with an error moves to `failed`. Returns those."""
    import os
    import shutil

    bad = []
    for base, _, names in sorted(os.walk(folder)):
        for name in sorted(n for n in names if re.fullmatch(r"part-.*\.txt|.*\.sql", n)):
            path = os.path.join(base, name)
            with open(path) as f:
                text = f.read()
            try:
                execute(f"BEGIN;\n{text}\nCOMMIT;")
                os.remove(path)
            except Exception:  # whatever the database says
                os.makedirs(failed, exist_ok=True)
                to = os.path.join(failed, os.path.relpath(path, folder).replace(os.sep, "_"))
                shutil.move(path, to)
                bad.append(to)
    return bad
