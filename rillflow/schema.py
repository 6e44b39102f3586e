"""The flow record: wire fields, filter fields and counters, and the Spark schema made of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Name, information element id, kind, least and most bytes on the wire.
WIRE = """
in_bytes 1 INT 4 8
in_pkts 2 INT 4 8
protocol 4 INT 1 1
src_tos 5 INT 1 1
dst_tos 55 INT 1 1
tcp_flags 6 INT 1 2
l4_src_port 7 INT 2 2
ip4_src_addr 8 ADDR 4 4
src_mask 9 INT 1 1
input_snmp 10 INT 2 4
l4_dst_port 11 INT 2 2
ip4_dst_addr 12 ADDR 4 4
dst_mask 13 INT 1 1
output_snmp 14 INT 2 4
ip4_next_hop 15 ADDR 4 4
src_as 16 INT 2 4
dst_as 17 INT 2 4
bgp_next_hop 18 ADDR 4 4
last_switched 21 INT 4 4
first_switched 22 INT 4 4
ip6_src_addr 27 ADDR 16 16
ip6_dst_addr 28 ADDR 16 16
icmp_type 32 INT 2 2
sampler_id 48 INT 1 4
min_ttl 52 INT 1 1
max_ttl 53 INT 1 1
frag_id 54 INT 2 4
src_mac 56 MAC 6 6
dst_mac 57 MAC 6 6
src_vlan 58 INT 2 2
dst_vlan 59 INT 2 2
ip_protocol_version 60 INT 1 1
direction 61 INT 1 1
if_name 82 STRING 1 16
fwd_status 89 INT 1 1
flow_start_ms 152 INT 8 8
flow_end_ms 153 INT 8 8
flow_end_reason 136 INT 1 1
ip_ttl 192 INT 1 1
ioctets 231 INT 8 8
roctets 232 INT 2 8
ipackets 298 INT 8 8
rpackets 239 INT 8 8
ingrs_vrf 234 INT 4 4
egrs_vrf 235 INT 4 4
src_dot1q_vlan 243 INT 2 2
src_dot1q_cvlan 245 INT 2 2
dst_dot1q_vlan 254 INT 2 2
dst_dot1q_cvlan 255 INT 2 2
obs_time_ms 323 INT 8 8
vas_session_id 2000 INT 8 8
vas_http_host 2001 STRING 0 256
dev_ip 65500 ADDR 4 4
dns_name 65510 STRING 1 256
dns_ips 65511 STRING 1 512
sni 65512 STRING 1 256
class0 65520 STRING 1 32
class1 65521 STRING 1 32
class2 65522 STRING 1 32
class3 65523 STRING 1 32
class4 65524 STRING 1 32
pad1 65530 INT 1 1
pad2 65531 INT 2 2
"""

# Filter field, kind, source field, destination field (= where there is one only).
FILTER = """
host ADDR4 ip4_src_addr ip4_dst_addr
net ADDR4 ip4_src_addr ip4_dst_addr
host6 ADDR6 ip6_src_addr ip6_dst_addr
net6 ADDR6 ip6_src_addr ip6_dst_addr
port RANGE l4_src_port l4_dst_port
proto RANGE protocol =
tos RANGE src_tos dst_tos
tcp-flags RANGE tcp_flags =
ifidx RANGE input_snmp output_snmp
as RANGE src_as dst_as
min-ttl RANGE min_ttl =
max-ttl RANGE max_ttl =
frag-id RANGE frag_id =
mac MAC src_mac dst_mac
vlan RANGE src_vlan dst_vlan
endreason RANGE flow_end_reason =
d1qvlan RANGE src_dot1q_vlan dst_dot1q_vlan
d1qcvlan RANGE src_dot1q_cvlan dst_dot1q_cvlan
bgp-nh ADDR4 bgp_next_hop =
dir RANGE direction =
fwdst RANGE fwd_status =
smplr RANGE sampler_id =
vrf RANGE ingrs_vrf egrs_vrf
vashost STRING vas_http_host =
dev-ip ADDR4 dev_ip =
dev-ip6 ADDR6 dev_ip6 =
dev-id RANGE dev_id =
dev-mark RANGE dev_mark =
class0 STRING class0 =
class1 STRING class1 =
class2 STRING class2 =
class3 STRING class3 =
class4 STRING class4 =
dns-name STRING dns_name =
dns-ips STRING dns_ips =
sni STRING sni =
"""

# Counter, wire field, scale.
COUNTERS = {
    "octets": ("in_bytes", 1),
    "bits": ("in_bytes", 8),
    "packets": ("in_pkts", 1),
    "ioctets": ("ioctets", 1),
    "roctets": ("roctets", 1),
    "ipackets": ("ipackets", 1),
    "rpackets": ("rpackets", 1),
}


@dataclass(frozen=True)
class Wire:
    name: str
    element: int
    kind: str
    least: int
    most: int

    @property
    def spark(self) -> T.DataType:
        if self.kind == "INT" or self.kind == "ADDR" and self.most == 4:
            return T.LongType()
        return T.BinaryType() if self.kind == "ADDR" else T.StringType()


WIRE_FIELDS = [Wire(n, int(e), k, int(a), int(b)) for n, e, k, a, b in map(str.split, WIRE.split("\n")[1:-1])]
BY_ELEMENT = {w.element: w for w in WIRE_FIELDS} | {299: next(w for w in WIRE_FIELDS if w.name == "rpackets")}
FILTER_FIELDS = {n: (k, s, None if d == "=" else d) for n, k, s, d in map(str.split, FILTER.split("\n")[1:-1])}
VIRTUAL = [
    T.StructField("dev_ip6", T.BinaryType()), T.StructField("dev_id", T.LongType()), T.StructField("dev_mark", T.LongType()),
    T.StructField("sampling_rate", T.LongType()), T.StructField("recv_ts", T.TimestampType())
]
FLOW_SCHEMA = T.StructType([T.StructField(w.name, w.spark) for w in WIRE_FIELDS] + VIRTUAL)
