import struct

import duckdb
import pytest

from rillflow import dsl
from rillflow.plans.all_queries import ORACLE_SQL, QUERIES
from rillflow.sources import wire

SF = "/root/testdata/sf0.001"


def test_documented_filter_parses():
    tree = dsl.parse("Src host 1.2.3.4 and (PORT 12345 or 54321) or dst host 4.3.2.1 and div(octets, packets) 0-100")
    assert tree.op == "or" and [p.op for p in tree.parts] == ["and", "and"]
    assert "div" in dsl.describe(tree)
    for bad in ("src", "host", "port 1 and", "nofield 3", "(port 1"):
        with pytest.raises(dsl.FilterError):
            dsl.parse(bad)


def test_field_names_and_order(spark):
    f = dsl.parse_field("div_r(octets, packets, 100) desc")
    assert f.name == "div_r_octets__packets__100_" and f.descending and not f.summed
    assert dsl.parse_field("bits").summed


def test_v9_template_and_data():
    template = struct.pack("!HHHHHHHH", 0, 16, 256, 2, 8, 4, 1, 4)
    data = struct.pack("!HHII", 256, 12, 0x0A000001, 77)
    head = struct.pack("!HHIIII", 9, 2, 0, 0, 0, 5)
    known = {(s, t): f for s, t, f in wire.templates_in(head + template)}
    assert list(wire.by_template(head + data, known)) == [{"ip4_src_addr": 0x0A000001, "in_bytes": 77}]


def test_dns_and_sni():
    q = b"\x01a\x02bc\x00\x00\x01\x00\x01"
    answer = b"\xc0\x0c" + struct.pack("!HHIH", 1, 1, 9, 4) + bytes([1, 2, 3, 4])
    assert wire.dns(struct.pack("!HHHHHH", 1, 0x8180, 1, 1, 0, 0) + q + answer) == ("a.bc.", ["1.2.3.4"])
    assert wire.dns(b"") is None and wire.sni(b"\x16\x03\x01") is None


@pytest.mark.parametrize("name", ["win_topn_others", "flt_not_and_or", "geo_lpm", "alert_intervals", "clsf_apply", "rpt_topn_other", "dec_nf5"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    norm = lambda row: tuple(str(round(x, 6) if isinstance(x, float) else x) for x in row)
    assert sorted(norm(r[c] for c in columns) for r in df.collect()) == sorted(norm(r[rel.columns.index(c)] for c in columns) for r in rel.fetchall())
