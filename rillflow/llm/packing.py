"""Best-fit packing of token sequences by linear grouping.

Lengths are integers up to `capacity`, so all planning is done on their histogram (at most `capacity`
numbers at the driver) and on ranges of ranks, whatever the number of documents:
1. lengths above capacity / SMALL, sorted down, are cut into GROUPS groups of equal cardinality, and
   rounded up to their group's greatest;
2. over these few sizes, a linear program tells how often each configuration (what fills one sequence)
   is used: configurations enter it one by one, each the best at the program's present prices, found by
   dynamic programming; whole numbers of them are taken, and the rest of the groups is filled by the
   configurations that fill a sequence best. The plan without the program is made too, and the one of
   fewer sequences is kept;
3. the documents of a group, by exact length, take its places, which leaves each sequence's true rest;
4. the small lengths go down from the largest, each to the fullest sequence that has room.
The plan is a table of ranges (length, first rank, count) -> (first sequence, offset), which each
row looks up by its length and its rank among the rows of that length.

Null texts are empty and have the end id alone. Documents longer than capacity are cut into whole
sequences behind a shorter first piece. Rows of equal doc_id, or of none, are separate documents; which
of equally long pieces goes where follows the order of the input's partitions. An empty table gives no
rows. Only doc_id and text are read, whatever other columns there are; doc_id is an integer.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if, shipped, written
from .tokenizer import encoder

GROUPS, SMALL = 256, 8
ROUNDS, CLOSE = 250, 1e-3  # of the program; it ends when it is proven to be so close to its best
TEXTS = 1024  # encoded at once
MOST_BROADCAST = 500_000  # rows (length, part)


@dataclass
class Plan:
    """rows: (length, first rank, count, first sequence, offset)."""

    capacity: int
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    rest: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))  # rest -> ranges of sequences
    mask: int = 0  # bit r: rest[r] isn't empty

    def leave(self, rest: int, first: int, count: int) -> None:
        if rest and count:
            self.rest[rest].append((first, count))
            self.mask |= 1 << rest

    def take(self, least: int, most: int) -> tuple[int, int, int] | None:
        """(rest, first, count) of up to `most` sequences with the smallest rest of at least `least`."""
        up = self.mask >> least
        if not up:
            return None
        r = least + (up & -up).bit_length() - 1
        first, count = self.rest[r].pop()
        if count > most:
            self.rest[r].append((first + most, count - most))
            count = most
        if not self.rest[r]:
            self.mask &= ~(1 << r)
        return r, first, count


def _best_configuration(sizes: list[int], left: list[int], first: int, capacity: int) -> dict[int, int]:
    """How many of each group go with one of group `first` so that the rounded sizes fill the most."""
    room = capacity - sizes[first]
    limit = (1 << (room + 1)) - 1
    reach, trail = 1, []
    for g in range(first, len(sizes)):
        have = left[g] - (g == first)
        before = reach
        for _ in range(min(have, room // sizes[g])):
            more = (reach | reach << sizes[g]) & limit
            if more == reach:
                break
            reach = more
        trail.append((g, before, min(have, room // sizes[g])))
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, defaultdict(int)
    out[first] += 1
    for g, before, most in reversed(trail):
        k = 0
        while not before >> at & 1:
            at, k = at - sizes[g], k + 1
        if k:
            out[g] += k
    return out


def _priced(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size fill a sequence at the greatest price; sizes ascend."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(int(sizes[0]), capacity + 1):
        m = upto[c]
        value = best[c - sizes[:m]] + prices[:m]
        k = value.argmax()
        best[c], taken[c] = (value[k], k) if value[k] > best[c - 1] else (best[c - 1], -1)
    out, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            out[taken[c]] += 1
            c -= int(sizes[taken[c]])
    return out


def _program(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(configuration, times) of a linear program of fewest sequences that hold the demand, times rounded down."""
    order = np.argsort(sizes, kind="stable")
    s, n = np.array(sizes)[order], np.array(demand, float)[order]
    basis = np.diag(capacity // s).astype(float)
    for _ in range(ROUNDS):
        prices = np.linalg.solve(basis.T, np.ones(len(s)))
        new = _priced(s, np.maximum(prices, 0), capacity)
        if new @ prices <= 1 + CLOSE:
            break
        times, change = np.linalg.solve(basis, np.column_stack([n, new])).T
        ratio = np.where(change > 1e-9, np.maximum(times, 0) / np.where(change > 1e-9, change, 1), np.inf)
        if not np.isfinite(ratio).any():
            break
        basis[:, int(ratio.argmin())] = new
    times = np.linalg.solve(basis, n)
    return [({int(order[g]): int(basis[g, k]) for g in np.flatnonzero(basis[:, k])}, int(times[k] + 1e-6)) for k in range(len(s)) if times[k] >= 1 - 1e-6]


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Of the plans with and without the program, the one of fewer sequences."""
    return min((_plan(histogram, capacity, by_program) for by_program in (True, False)), key=lambda p: p.sequences)


def _plan(histogram: dict[int, int], capacity: int, by_program: bool) -> Plan:
    out = Plan(capacity)
    counts = {n: c for n, c in histogram.items() if c}
    if whole := counts.pop(capacity, 0):
        out.rows.append((capacity, 0, whole, 0, 0))
        out.sequences = whole
    large = sorted((n for n in counts if n > capacity // SMALL), reverse=True)
    total = sum(counts[n] for n in large)
    each = -(-total // GROUPS) if total else 0
    groups: list[list[list[int]]] = []  # runs [length, next rank, count] of each group
    room = 0
    for n in large:
        rank, c = 0, counts[n]
        while c:
            if not room:
                groups.append([])
                room = each
            k = min(c, room)
            groups[-1].append([n, rank, k])
            rank, c, room = rank + k, c - k, room - k
    sizes, left = [g[0][0] for g in groups], [sum(r[2] for r in g) for g in groups]

    def uses():
        """Configurations and how often each is used now, until the groups are empty."""
        for used, times in _program(sizes, left, capacity) if by_program and groups else ():
            times = min(times, *(left[g] // k for g, k in used.items()))
            if times:
                yield used, times
        for first in range(len(groups)):
            while left[first]:
                used = _best_configuration(sizes, left, first, capacity)
                yield used, min(left[g] // k for g, k in used.items())

    for used, times in uses():
        start, out.sequences = out.sequences, out.sequences + times
        slots = []
        for g in sorted(used):
            for _ in range(used[g]):
                need, runs = times, []
                while need:
                    run = groups[g][0]
                    k = min(need, run[2])
                    runs.append((run[0], run[1], k))
                    run[1], run[2], need = run[1] + k, run[2] - k, need - k
                    if not run[2]:
                        groups[g].pop(0)
                slots.append(runs)
            left[g] -= times * used[g]
        edges = sorted({0, *(e for runs in slots for e in np.cumsum([r[2] for r in runs]).tolist())})
        at = [[0, 0] for _ in slots]  # run, rows used of it
        for a, b in zip(edges[:-1], edges[1:]):
            offset = 0
            for runs, place in zip(slots, at):
                n, rank, k = runs[place[0]]
                out.rows.append((n, rank + place[1], b - a, start + a, offset))
                offset += n
                place[1] += b - a
                if place[1] == k:
                    place[:] = [place[0] + 1, 0]
            out.leave(capacity - offset, start + a, b - a)
    for n in sorted((n for n in counts if n <= capacity // SMALL), reverse=True):
        rank, c = 0, counts[n]
        while c:
            got = out.take(n, c)
            if got is None:
                k = max(1, c // (capacity // n))
                got = (capacity, out.sequences, k)
                out.sequences += k
            rest, first, k = got
            out.rows.append((n, rank, k, first, capacity - rest))
            out.leave(rest - n, first, k)
            rank, c = rank + k, c - k
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, _part, _nth), written once: _nth counts the pieces of one length in a part."""

    def task(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        encode, end = encoder(tokenizer).encode_many, np.array([end_id], "<u4").tobytes()
        for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, len(b), TEXTS)):
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                a, b, piece = 0, n % capacity or min(n, capacity), 0
                while a < n:
                    out.append((doc_id, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), part, int(seen[b - a])))
                    seen[b - a] += 1
                    a, b, piece = b, b + capacity, piece + 1
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_nth"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(rows.mapInArrow(task, "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _nth long"), "pieces")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset); texts are read once and never shuffled."""
    cut = pieces(docs, tokenizer, end_id, capacity)
    made = plan({r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}, capacity)
    table = np.array(sorted(made.rows), np.int64).reshape(-1, 5)
    held = shipped(docs.sparkSession, table)

    @F.arrow_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        rows = held.value
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(rows[:, 0] << 48 | rows[:, 1], n << 48 | r, "right") - 1
        return pa.StructArray.from_arrays([pa.array(rows[at, 3] + r - rows[at, 1]), pa.array(rows[at, 4])], ["sequence_id", "offset"])

    sizes = cut.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("length", "_part", (F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).alias("_before"))
    ranked = cut.join(broadcast_if(written(before, "before"), MOST_BROADCAST), ["length", "_part"]).withColumn("_place", place("length", F.col("_nth") + F.col("_before")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset")
