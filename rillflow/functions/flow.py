"""Scalar functions of flows as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Services known by name.
PORTS = {
    20: "ftp-data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "domain", 80: "http", 110: "pop3", 123: "ntp", 143: "imap", 161: "snmp",
    179: "bgp", 389: "ldap", 443: "https", 445: "microsoft-ds", 993: "imaps", 1900: "ssdp", 3306: "mysql", 3389: "ms-wbt-server", 5060: "sip",
    11211: "memcache"
}
# TCP flags in the order of their labels.
TCP_FLAGS = (("CWR", 128), ("ECE", 64), ("URG", 32), ("ACK", 16), ("PSH", 8), ("RST", 4), ("SYN", 2), ("FIN", 1))
PROTOCOLS = {1: "icmp", 6: "tcp", 17: "udp", 47: "gre", 50: "esp", 58: "ipv6-icmp", 89: "ospf", 132: "sctp"}


def absent_as_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0).cast("long"))


def div(a: Column, b: Column) -> Column:
    """The integer quotient; 0 where b is 0."""
    a, b = absent_as_zero(a), absent_as_zero(b)
    return F.when(b == 0, F.lit(0).cast("long")).otherwise(F.floor((a - a % b) / b).cast("long"))


def div_r(a: Column, b: Column, k: int) -> Column:
    """The quotient rounded down to a multiple of k."""
    q = div(a, b)
    return q - q % k if k > 1 else q


def div_l(a: Column, b: Column, k: int) -> Column:
    """The greatest power of k up to the quotient, exactly; 0 for 0."""
    q, powers, p = div(a, b), [], 1
    while p < 2**31:
        powers.append(p)
        p *= max(k, 2)
    return F.when(q < 1, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), *[F.when(q >= x, F.lit(x).cast("long")) for x in powers]))


def least(a: Column, b: Column) -> Column:
    return F.least(absent_as_zero(a), absent_as_zero(b))


def _named(port: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in PORTS.items() for x in kv]), port.cast("int"))


def service(port: Column) -> Column:
    """The name of a known service; null for other ports."""
    return _named(port)


def portstr(port: Column) -> Column:
    """name (port) of a known service, else the port."""
    p = absent_as_zero(port)
    return F.coalesce(F.concat(_named(p), F.lit(" ("), p.cast("string"), F.lit(")")), p.cast("string"))


def ppstr(a: Column, b: Column) -> Column:
    """The pair's label: both sides if both are known or they are equal, else the known or the smaller side."""
    a, b = absent_as_zero(a), absent_as_zero(b)
    label = lambda x: F.concat(_named(x), F.lit("("), x.cast("string"), F.lit(")"))
    full, sa, sb = F.concat(label(a), F.lit(" -> "), label(b)), a.cast("string"), b.cast("string")
    below = F.coalesce(F.concat(sa, F.lit(" -> "), label(b)), F.concat(label(a), F.lit(" ->")), F.concat(sa, F.lit(" ->")))
    above = F.coalesce(F.concat(F.lit("-> "), label(b)), F.concat(label(a), F.lit(" -> "), sb), F.concat(F.lit("-> "), sb))
    return F.when(full.isNotNull(), full).when(a == b, F.concat(sa, F.lit(" -> "), sb)).when(a < b, below).otherwise(above)


def tfstr(flags: Column) -> Column:
    """Names of the flags that are set, joined by +; of two bytes the low one counts."""
    low = absent_as_zero(flags)
    return F.concat_ws("+", *[F.when(low.bitwiseAND(bit) != 0, F.lit(name)) for name, bit in TCP_FLAGS])


def protocol_name(proto: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in PROTOCOLS.items() for x in kv]), proto.cast("int"))


def ipv4_str(x: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(x, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def escaped(x: Column) -> Column:
    """Control characters, quotes and backslashes as hexadecimal escapes, for text exports."""
    codes = [92, *range(32), 39, 127]  # the backslash first: the escapes have one
    for code in codes:
        x = F.replace(x, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    return x
