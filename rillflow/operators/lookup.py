"""Lookup joins: prefix membership, longest prefix, ranges, devices, limits.

Addresses are longs (IPv4) or 16 bytes (IPv6). Prefix tables have (ver, plen, net) and columns of their
own, where net is the 32 lower-case hexadecimal digits of the network's first address for IPv6 and its
number for IPv4; tables() of either kind are made by prefixes().
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BROADCAST, MOST_BYTES = 500_000, 48 << 20


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes."""
    strings = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    return sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in strings), F.lit(16 * len(df.columns)))


def is_small(df: DataFrame, most: int = MOST_BROADCAST) -> bool:
    """Whether a bounded count shows that the table is small, in rows and in bytes."""
    rows, size = df.limit(most + 1).agg(F.count(F.lit(1)), F.sum(_bytes(df))).first()
    return rows <= most and (size or 0) <= MOST_BYTES


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Broadcast only where the table is small."""
    return F.broadcast(df) if is_small(df, most) else df


def prefixes(spark, rows: list[tuple[str, ...]], columns: list[str]) -> DataFrame:
    """(ver, plen, net, net6, columns) of prefixes given as text first."""
    data = []
    for text, *rest in rows:
        net = ipaddress.ip_network(text, strict=False)
        first = int(net.network_address)
        data.append((net.version, net.prefixlen, first if net.version == 4 else None, f"{first:032x}" if net.version == 6 else None, *rest))
    return spark.createDataFrame(data, "ver int, plen int, net long, net6 string, " + ", ".join(f"{c} string" for c in columns))


def masked4(addr: Column, plen: int) -> Column:
    return addr.bitwiseAND((0xFFFFFFFF << (32 - plen)) & 0xFFFFFFFF)


def masked6(addr: Column, plen: int) -> Column:
    """The 32 hexadecimal digits of an address with all bits behind the prefix cleared."""
    digits = F.lower(F.hex(addr))
    whole, rest = divmod(plen, 4)
    kept = F.substring(digits, 1, whole)
    if rest:
        value = F.conv(F.substring(digits, whole + 1, 1), 16, 10).cast("int").bitwiseAND((0xF << (4 - rest)) & 0xF)
        kept = F.concat(kept, F.lower(F.hex(value.cast("long"))))
    return F.rpad(kept, 32, "0")


def _by_length(flows: DataFrame, addr: str, table: DataFrame, values: list[str], ver: int) -> tuple[DataFrame, list[str]]:
    """flows with one column `_at<n>` for each prefix length n: the values of its prefix of that length, or null.

    Equi-joins with the table's parts by length: those that a count shows to be small are broadcast, so
    flows don't move; of a prefix that is given twice, one row counts.
    """
    own, found = flows.columns, []
    net, mask = ("net", masked4) if ver == 4 else ("net6", masked6)
    sizes = table.where(F.col("ver") == ver).groupBy("plen").agg(F.count(F.lit(1)).alias("n"), F.sum(_bytes(table)).alias("b")).collect()
    few = {r["plen"]: r["n"] <= MOST_BROADCAST and r["b"] <= MOST_BYTES for r in sizes}
    for n in sorted(few):
        part = table.where((F.col("ver") == ver) & (F.col("plen") == n)).groupBy(F.col(net).alias(f"_net{n}")).agg(F.min(F.struct(*values) if values else F.lit(True)).alias(f"_at{n}"))
        flows = flows.join(F.broadcast(part) if few[n] else part, mask(F.col(addr), n) == F.col(f"_net{n}"), "left").drop(f"_net{n}")
        found.append(f"_at{n}")
    return flows.select(*[F.col(f"`{c}`") for c in own], *found), found


def members(flows: DataFrame, addr: str, table: DataFrame, anti: bool = False, ver: int = 4) -> DataFrame:
    """Flows whose address lies in any prefix of the table (or in none)."""
    own = [F.col(f"`{c}`") for c in flows.columns]
    flows, found = _by_length(flows, addr, table, [], ver)
    hit = F.coalesce(*[F.col(c) for c in found], F.lit(False)) if found else F.lit(False)
    return flows.where(~hit if anti else hit).select(*own)


def longest(flows: DataFrame, addr: str, table: DataFrame, columns: dict[str, object], ver: int = 4, names: dict[str, str] | None = None) -> DataFrame:
    """flows with the columns of the longest prefix that holds addr, or the given default; names: result names of columns."""
    own = [F.col(f"`{c}`") for c in flows.columns]
    flows, found = _by_length(flows, addr, table, list(columns), ver)
    best = F.coalesce(*[F.col(c) for c in reversed(found)]) if found else F.lit(None).cast(f"struct<{','.join(f'{c}:string' for c in columns)}>")
    tagged = flows.select(*own, best.alias("_best"))
    return tagged.select(*own, *[F.coalesce(F.col(f"_best.{c}"), F.lit(d)).alias((names or {}).get(c, c)) for c, d in columns.items()])


def ranges(keys: DataFrame, addr: str, table: DataFrame, columns: dict[str, object], bits: int = 16) -> DataFrame:
    """As longest, over disjoint ranges (start, end): cut at multiples of 2**bits, joined by block, then compared."""
    block = F.sequence(F.shiftright("start", bits), F.shiftright("end", bits))
    cut = small(table.select("start", "end", F.struct(*columns).alias("_found"), F.explode(block).alias("_b")))
    on = (F.shiftright(keys[addr], bits) == cut["_b"]) & keys[addr].between(cut["start"], cut["end"])
    out = keys.join(cut, on, "left")
    return out.select(*[keys[c] for c in keys.columns], *[F.coalesce(F.col(f"_found.{c}"), F.lit(d)).alias(c) for c, d in columns.items()])


DEVICE = "ord int, ip long, id long, rate long, skip boolean"


def device_rates(flows: DataFrame, devices: DataFrame, default: int = 1) -> DataFrame:
    """flows with sampling_rate and skip of the first device (by ord) that fits, by address and id, address alone or id alone.

    devices: (ord, ip, rate, skip) and, where devices are told apart by id, id; a null ip or id asks for
    nothing. flows: dev_ip and, if there is one, dev_id.
    """
    if "id" not in devices.columns:
        devices = devices.withColumn("id", F.lit(None).cast("long"))
    dev_id = F.col("dev_id") if "dev_id" in flows.columns else F.lit(None).cast("long")
    own = [F.col(f"`{c}`") for c in flows.columns if c not in ("sampling_rate", "skip")]
    out, found, few = flows.withColumn("_id", dev_id), [], is_small(devices)
    for n, (by_ip, by_id) in enumerate(((True, True), (True, False), (False, True))):
        some = devices.where((F.col("ip").isNotNull() if by_ip else F.col("ip").isNull()) & (F.col("id").isNotNull() if by_id else F.col("id").isNull()))
        first = some.groupBy(F.col("ip").alias(f"_ip{n}"), F.col("id").alias(f"_id{n}")).agg(F.min(F.struct("ord", "rate", "skip")).alias(f"_d{n}"))
        on = [F.col("dev_ip") == F.col(f"_ip{n}")] * by_ip + [F.col("_id") == F.col(f"_id{n}")] * by_id
        out = out.join(F.broadcast(first) if few else first, on, "left").drop(f"_ip{n}", f"_id{n}")
        found.append(F.col(f"_d{n}"))
    best = F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull()))
    out = out.withColumn("_device", best)
    return out.select(*own, F.coalesce(F.col("_device.rate"), F.lit(default)).cast("long").alias("sampling_rate"), F.coalesce(F.col("_device.skip"), F.lit(False)).alias("skip"))


def with_limit(values: DataFrame, limits: DataFrame, keys: list[str], default: float) -> DataFrame:
    """values with the limit of their key, or the default one."""
    return values.join(small(limits), keys, "left").withColumn("limit", F.coalesce(F.col("limit").cast("double"), F.lit(float(default))))
