"""URL allow and block lists as one trie over reversed host labels, then path segments.

The rules are a bounded list (MOST_RULES and MOST_CHARACTERS, checked); the trie is built once on the
driver and broadcast. A rule's last segment may be partial: those under one node are looked up by
length, so a url costs as much as its own length, not as there are rules. Null urls and urls without
"://" have an empty host and path and match nothing; urls of any length are judged whole; equal rows are
separate rows, and an empty table gives no rows. Other columns of the input are kept, whatever their
names; input columns named like a result column give way to it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col_of, lower_ascii, shipped, unused_prefix

MOST_RULES, MOST_CHARACTERS = 2_000_000, 64 << 20
DEFAULT_VERDICT = "allow"


@dataclass
class Node:
    """below: by host label (from the top domain down) or, under paths, by whole path segment.

    paths: the root of the path segments that rules of exactly this host begin; ends: the last,
    possibly partial segment of rules that end here, with their verdict and text; lengths: of those
    segments, the longest first.
    """

    below: dict[str, "Node"] = field(default_factory=dict)
    paths: "Node | None" = None
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)


class UrlTrie:
    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        """rules: (verdict, host, path). Of two rules with one host and path, block stands."""
        self.root = Node()
        for verdict, host, path in rules:
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
            node = self.root
            for label in reversed(host.split(".")):
                node = node.below.setdefault(label, Node())
            node.paths = at = node.paths or Node()
            *whole, last = path.split("/")
            for segment in whole:
                at = at.below.setdefault(segment, Node())
            if at.ends.get(last, ("",))[0] != "block":
                at.ends[last] = (verdict, host + path)
                if len(last) not in at.lengths:
                    at.lengths = sorted([*at.lengths, len(last)], reverse=True)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule, block before allow among equally long ones; None without one."""
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            at, k = node.paths, 0
            while at is not None:
                rest = segments[k] if k < len(segments) else None
                # of rules that end under one node, the longest that fits is the longest of all of them
                found = next((at.ends[rest[:n]] for n in at.lengths if n <= len(rest) and rest[:n] in at.ends), None) if rest is not None else None
                if found:
                    key = (len(found[1]), found[0] == "block")
                    if best is None or key > best[0]:
                        best = (key, found)
                # a segment is whole only if a slash follows it
                at = at.below.get(rest) if rest is not None and k + 1 < len(segments) else None
                k += 1
        return best[1] if best else None


def judge(df: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """df with host, path, rule and verdict of each row's url; one narrow pass, no shuffle."""
    rules = list(rules)
    if len(rules) > MOST_RULES or sum(len(h) + len(p) for _, h, p in rules) > MOST_CHARACTERS:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} rules of {MOST_CHARACTERS} characters are broadcast")
    trie = shipped(df.sparkSession, UrlTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def look_up(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        match = trie.value.match
        for hosts, paths in parts:
            found = [match(h, p) for h, p in zip(hosts, paths)]
            yield pd.DataFrame({"rule": [x[1] if x else None for x in found], "verdict": [x[0] if x else default for x in found]}, dtype=object)

    part = lambda pattern: F.coalesce(F.regexp_extract(col_of(url).cast("string"), pattern, 1), F.lit(""))
    host, path = lower_ascii(part(r"^(?:(?!://)[\s\S])*+://([^/?#]*)")), part(r"^(?:(?!://)[\s\S])*+://[^/?#]*([^?#]*)")
    found = unused_prefix(df) + "found"
    kept = [col_of(c) for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    with_parts = df.select(*kept, host.alias("host"), path.alias("path"))
    return with_parts.withColumn(found, look_up("host", "path")).select(*kept, "host", "path", f"{found}.rule", f"{found}.verdict")
