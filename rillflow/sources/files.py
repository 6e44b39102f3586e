"""Dimension files: geographic and AS databases, address lists, limits, devices, class names.

Every loader gives a table for the lookup joins. Ranges of addresses become the fewest prefixes that
cover them, so one longest-prefix join serves all databases, IPv4 and IPv6 alike.
"""

from __future__ import annotations

import ipaddress
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dsl

PREFIX = "ver int, plen int, net long, net6 string"
# The columns of the range form of the geographic database, and those of an AS range file.
GEO_RANGE = ["ip_version", "start_ip", "end_ip", "continent", "country_code", "country", "state", "city", "zip", "timezone", "latitude", "longitude", "accuracy"]
AS_RANGE = ["start_ip", "end_ip", "asn", "asd"]
# Geographic functions and the columns that the locations and blocks form has for them.
GEO_BLOCK = {
    "continent": "continent_code", "country_code": "country_iso_code", "country": "country_name", "state": "subdivision_1_name", "city": "city_name",
    "zip": "postal_code", "lat": "latitude", "long": "longitude"
}
GEO_COLUMNS = list(GEO_BLOCK)


def _split(first: str, last: str) -> Iterator[tuple[int, int, int | None, str | None]]:
    """The fewest prefixes of a range of addresses, as rows of a prefix table; none for what isn't a range."""
    try:
        nets = list(ipaddress.summarize_address_range(ipaddress.ip_address(first.strip()), ipaddress.ip_address(last.strip())))
    except (ValueError, TypeError, AttributeError):
        return
    for net in nets:
        at = int(net.network_address)
        yield net.version, net.prefixlen, at if net.version == 4 else None, f"{at:032x}" if net.version == 6 else None


def _one(text: str) -> tuple[int, int, int | None, str | None] | None:
    """One prefix or address as a row of a prefix table; None for other text."""
    try:
        net = ipaddress.ip_network(text.strip(), strict=False)
    except (ValueError, AttributeError):
        return None
    at = int(net.network_address)
    return net.version, net.prefixlen, at if net.version == 4 else None, f"{at:032x}" if net.version == 6 else None


def to_prefixes(ranges: DataFrame, first: str, last: str | None = None) -> DataFrame:
    """Rows of ranges with text addresses `first` to `last`, or prefixes in `first`, as rows of a prefix table with their other columns."""
    rest = [f for f in ranges.schema.fields if f.name not in (first, last)]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            others = list(zip(*(b[f.name] for f in rest))) if rest else [()] * len(b)
            for k, other in enumerate(others):
                found = _split(b[first].iloc[k], b[last].iloc[k]) if last else filter(None, [_one(b[first].iloc[k])])
                out += [(*p, *other) for p in found]
            frame = pd.DataFrame(out, columns=["ver", "plen", "net", "net6", *[f.name for f in rest]], dtype=object)
            yield frame

    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rest)
    return ranges.mapInPandas(task, PREFIX + more)


def _csv(spark: SparkSession, path: str, header: bool = True, columns: list[str] | None = None) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in columns) if columns else None
    return spark.read.csv(path, header=header, schema=schema, quote='"', escape='"')


def geo_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Prefix table with GEO_COLUMNS of a file of ranges; continent and country code in lower case."""
    rows = _csv(spark, path, columns=GEO_RANGE)
    rows = rows.select(
        "start_ip", "end_ip", F.lower("continent").alias("continent"), F.lower("country_code").alias("country_code"), "country", "state", "city",
        "zip", F.col("latitude").alias("lat"), F.col("longitude").alias("long")
    )
    return to_prefixes(rows, "start_ip", "end_ip")


def geo_blocks(spark: SparkSession, locations: str, blocks: str) -> DataFrame:
    """Prefix table with GEO_COLUMNS of a file of blocks and one of locations, joined by geoname_id; blocks without a location go."""
    places, nets = _csv(spark, locations), _csv(spark, blocks)
    have = {c: places[c] if c in places.columns else nets[c] for c in GEO_BLOCK.values()}
    joined = nets.join(places, nets["geoname_id"] == places["geoname_id"])
    lower = ("continent", "country_code")
    rows = joined.select("network", *[(F.lower(have[c]) if k in lower else have[c]).alias(k) for k, c in GEO_BLOCK.items()])
    return to_prefixes(rows, "network")


def as_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Prefix table with asn and asd of a file without a header: first and last address, number, name."""
    return to_prefixes(_csv(spark, path, header=False, columns=AS_RANGE), "start_ip", "end_ip")


def as_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Prefix table with asn and asd of a file of networks with a header."""
    rows = _csv(spark, path)
    return to_prefixes(rows.select("network", F.col("autonomous_system_number").alias("asn"), F.col("autonomous_system_organization").alias("asd")), "network")


def ip_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Prefix table with the column list (the file's name) of all files in folder: a prefix a line, # begins a comment."""
    lines = spark.read.text(folder)
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    rows = lines.select(F.trim(F.regexp_replace("value", "#.*", "")).alias("text"), name.alias("list")).where("text <> ''")
    return to_prefixes(rows, "text")


def lists_of(table: DataFrame, most: int = 100_000) -> dict[str, list[str]]:
    """The lists of a prefix table as text, for filters that name them; large ones belong in a join instead."""
    rows = table.select("list", "ver", "plen", "net", "net6").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} prefixes in lists: join with them instead of naming them in filters")
    out: dict[str, list[str]] = {}
    for r in rows:
        at = ipaddress.ip_address(r["net"]) if r["ver"] == 4 else ipaddress.IPv6Address(int(r["net6"], 16))
        out.setdefault(r["list"], []).append(f"{at}/{r['plen']}")
    return out


def _typed(text: Column, kind: str) -> Column:
    """A value of a file of limits as flows have it."""
    if kind == "ADDR4":
        parts = F.split(text, r"\.")
        return sum((parts[k].cast("long") * F.lit(256 ** (3 - k)) for k in range(4)), F.lit(0).cast("long"))
    if kind == "ADDR6":
        return F.udf(lambda t: ipaddress.IPv6Address(t).packed if t else None, "binary")(text)  # a small file
    return text if kind in ("STRING", "MAC", "TEXT") else text.cast("long")


def limits(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """(keys, limit, and limit2 and so on for further counters) of a file: the values of a moving average's fields in their order, # begins a comment."""
    specs = [dsl.parse_field(f) for f in fields]
    names = [f"c{k}" for k in range(len(specs))]
    rows = spark.read.csv(path, schema=", ".join(f"{n} string" for n in names), comment="#", quote='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    keys = [_typed(F.col(n), s.kind).alias(s.name) for n, s in zip(names, specs) if not s.summed]
    sums = [F.col(n).cast("double") for n, s in zip(names, specs) if s.summed]
    values = [c.alias("limit" if k == 0 else f"limit{k + 1}") for k, c in enumerate(sums)]
    return rows.where(F.col(names[0]).isNotNull()).select(*keys, *values)


def devices(spark: SparkSession, path: str) -> tuple[DataFrame, list[list[str]]]:
    """(ord, ip, id, rate, skip) of a JSON array of devices in its order, and the mark filters of each."""
    from ..config import loads
    from ..operators.lookup import DEVICE

    with open(path) as f:
        entries = loads(f.read())
    rows = []
    for n, e in enumerate(entries):
        ip = int(ipaddress.IPv4Address(e["ip"])) if e.get("ip") else None
        rows.append((n, ip, int(e["id"]) if e.get("id") is not None else None, int(e.get("sampling-rate") or 1), bool(e.get("skip-unmarked", False))))
    return spark.createDataFrame(rows, DEVICE), [list(e.get("mark", [])) for e in entries]


def class_names(folder: str) -> dict[str, str]:
    """class_id to name of a folder with one folder for each class, whose file `name` users may edit."""
    out = {}
    for key in sorted(os.listdir(folder)):
        path = os.path.join(folder, key, "name")
        if os.path.isfile(path):
            with open(path) as f:
                out[key] = f.read().strip()
    return out


def write_class_names(folder: str, dictionary: DataFrame, most: int = 100_000) -> None:
    """Adds each class's folder with its name once, and renews its stats; names that are there stay as they are."""
    rows = dictionary.select("class_id", "name", "stats").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} classes: keep the dictionary as a table")
    for r in rows:
        own = os.path.join(folder, r["class_id"].replace("/", "_"))
        os.makedirs(own, exist_ok=True)
        if not os.path.exists(os.path.join(own, "name")):
            with open(os.path.join(own, "name"), "w") as f:
                f.write(r["name"])
        with open(os.path.join(own, "stats"), "w") as f:
            f.write(r["stats"] or "")
