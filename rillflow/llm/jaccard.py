"""Near-duplicate texts by Jaccard similarity of word shingles, with token-combination prefixes.

A text is the set of its distinct five-word shingles (of 64-bit hashes, which no structure of the words
makes equal), and equal sets count as one node, told by a 64-bit fingerprint; a second one of each row
shows whether two sets share a fingerprint, and then all is done again with another seed. Shingles are ordered rare ones first, then frequent ones, each by
hash. Of x's n shingles a partner misses at most m = n - ceil(0.8 n). x indexes a prefix such that
singles of rare shingles, plus (in each class of frequent shingles) the shingles beyond the first,
number m + 1: then any partner shares a rare shingle of both prefixes, or two frequent shingles of
one class, and both index that single or that pair. Classes are residues of the hash; their number
goes by the size of the set, so that a prefix has few shingles, and few pairs, in each.

Which shingles count as frequent is a matter of speed alone: those that tasks meet often, by exact
counts within chunks added up over all rows (a lower bound, short by less than the number of chunks).
Sets of three shingles or fewer have no partner but their equals.

Candidates are not all pairs of a key's sets. First each key compares its least set, the pivot, with
the others, and the links join components. Then only keys whose other sets still lie in different
components are taken up, for TURNS turns (by least pivot, then by key): their texts meet in groups of
bounded size, are compared across components there, and hand on a spanning forest of new links. Of the
keys that still hold several components, the pairs that no group held are then verified one by one.
So no link between components is lost, and a group of thousands of near copies costs about one star.

Null, empty and wordless texts have no shingle and link with nothing; fewer than five words are one
shingle. Equal rows are separate rows, and rows that share a doc_id, or have none, are told apart by
their sets. Null doc_ids are carried; a component's id is its least doc_id. Very long texts are one set
like others; an empty table gives no rows. doc_id is an integer. Other columns may have any names.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import U, mix, shingle_sets, text_runs
from .common import broadcast_if, col_of, drop_written, join_known, shipped, unused_prefix, written
from .components import components

WORDS, PERCENT = 5, 80
COMMON, FREQUENT, MOST_COMMON = 3, 64, 2_000_000
CHUNK_SHINGLES = 4_000_000
KEY_BITS = ~U(0xFFFF)  # of a key: equal ones only add candidates, and zero bytes beside a row's other zeros take no room when shuffled
SPLIT, SHARE, TURNS = 512, 0.3, 2
MOST_ROWS, MOST_ENDS = 1_000_000, 2_000_000
GROUP = ["key", "one", "two"]
MEMBER = [*GROUP, "part", "fp", "label", "old", "met"]


def fingerprints(h: np.ndarray, bounds: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each set; 0 for the empty set."""
    n = np.diff(bounds)
    some = np.flatnonzero(n)
    out = np.zeros(len(n), np.uint64)
    if some.size:
        at, salt = bounds[some], mix(np.array([seed], np.uint64))
        with np.errstate(over="ignore"):
            out[some] = mix(np.add.reduceat(mix(h ^ salt ^ U(0x5851F42D4C957F2D)), at) ^ mix(np.bitwise_xor.reduceat(h, at) + n[some].astype(np.uint64)))
            out[some[out[some] == 0]] = 1
    return out


def _signed(x) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))


def _batches(batches, k: int, seed: int, column: int = 0):
    """(batch, first row, row after the last, shingles, bounds, fingerprints) of runs of rows."""
    for batch in batches:
        for first, last, data, offsets in text_runs(batch.column(column)):
            h, bounds = shingle_sets(data, offsets, k)
            yield batch, first, last, h, bounds, fingerprints(h, bounds, seed)


def _sets(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """kind 0: (doc_id, fingerprint, size, second fingerprint) of each row; kind 1: (shingle, count in a chunk, 0, 0) of those met twice there."""
    kind = ["kind", "a", "b", "c", "d"]

    def task(batches):
        seen: set[int] = set()
        kept, total = [], 0

        def flush():
            values, counts = np.unique(np.concatenate(kept), return_counts=True)
            values, counts = values[counts > 1], counts[counts > 1]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ones(len(values), np.int8)), _signed(values), pa.array(counts.astype(np.int64)),
                    pa.array(np.zeros(len(values), np.int32)), pa.array(np.zeros(len(values), np.int64))
                ],
                kind
            )

        for batch, first, last, h, bounds, fp in _batches(batches, k, seed):
            n = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(len(n), np.int8)), batch.column(1).slice(first, last - first).cast(pa.int64()), _signed(fp),
                    pa.array(n.astype(np.int32)), _signed(fingerprints(h, bounds, ~seed & 0xFFFFFFFF))
                ],
                kind
            )
            new = np.zeros(len(n), bool)
            for i, f in enumerate(fp.tolist()):
                if f not in seen:
                    seen.add(f)
                    new[i] = True
            kept.append(h[np.repeat(new, n)])
            total += len(kept[-1])
            if total > CHUNK_SHINGLES:
                yield flush()
                kept, total = [], 0
        if kept:
            yield flush()

    return written(docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long")).mapInArrow(task, "kind byte, a long, b long, c int, d long"), "sets")


def _common(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles met COMMON times or more, at most MOST_COMMON of them, and whether each is frequent.

    Where there are more, the bound on the count is doubled until they fit; results don't depend on it.
    """
    counts = sets.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).where(F.col("n") >= COMMON)
    counts = written(counts.select("a", "n", F.floor(F.log2(F.col("n") / COMMON)).cast("int").alias("level")), "common")
    levels = {r["level"]: r["k"] for r in counts.groupBy("level").agg(F.count(F.lit(1)).alias("k")).collect()}
    level = 0
    while sum(k for x, k in levels.items() if x >= level) > MOST_COMMON:
        level += 1
    table = counts.where(F.col("level") >= level).select("a", (F.col("n") >= FREQUENT).alias("f")).toArrow()
    drop_written(counts)
    h, frequent = table["a"].to_numpy().view(np.uint64), table["f"].to_numpy()
    order = np.argsort(h)
    return h[order], frequent[order]


def size_class(n: int) -> int:
    return int(np.log(n) / np.log(1.26))


def prefix_keys(h: np.ndarray, level: np.ndarray, percent: int) -> list[np.ndarray]:
    """The index keys of one set: h sorted; level 0 for rare, 1 for common, 2 for frequent shingles."""
    n = len(h)
    need = n - -(-percent * n // 100) + 1
    rare = np.concatenate([h[level == 0], h[level == 1]]) if level.any() else h
    if len(rare) >= need:
        return [rare[:need]]
    out, common, need = [rare], h[level == 2], need - len(rare)
    own = size_class(n)
    for c in {own, max(own - 1, 0)}:
        classes = max(1, int(0.05 * 1.26**c))
        of = common % U(classes)
        order = np.argsort(of, kind="stable")
        place = np.empty(len(of), np.int64)  # how many of the same class come before it
        first = np.searchsorted(of[order], of[order])
        place[order] = np.arange(len(of)) - first
        upto = int(np.searchsorted(np.cumsum(place > 0), need)) + 1
        part, cls = common[:upto], of[:upto]
        for j in np.unique(cls):
            x = part[cls == j]
            a, b = np.triu_indices(len(x), 1)
            out.append(mix(x[a] * U(0x9E3779B97F4A7C15) + mix(x[b] + U(c))))
    return out


def _keys(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], k: int, percent: int, seed: int) -> DataFrame:
    held = shipped(docs.sparkSession, common)

    def task(batches):
        (often, frequent), seen = held.value, set()
        for _, _, _, h, bounds, fp in _batches(batches, k, seed):
            level = np.zeros(len(h), np.int8)
            if len(often) and len(h):
                at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                level = np.where(often[at] == h, frequent[at] + np.int8(1), 0)
            keys, owners = [], []
            for i, f in enumerate(fp.tolist()):
                a, b = int(bounds[i]), int(bounds[i + 1])
                if f in seen or 100 * (b - a) < percent * (b - a + 1):
                    continue  # not even a set of one shingle more is near: only its equal matches
                seen.add(f)
                for x in prefix_keys(h[a:b], level[a:b], percent):
                    keys.append(x)
                    owners.append(np.full(len(x), f, np.uint64))
            if keys:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(keys) & KEY_BITS), _signed(np.concatenate(owners))], ["key", "fp"])

    return docs.select(F.col("text").cast("string")).mapInArrow(task, "key long, fp long")


def _stars(keys: DataFrame) -> DataFrame:
    """(key, fp, pivot) for each set of a key but its least, the pivot; keys of one set give nothing. Streams sorted runs."""

    def task(batches):
        last_key = last_fp = pivot = None
        for batch in batches:
            key, fp = (batch.column(i).to_numpy() for i in range(2))
            if not len(key):
                continue
            new_key = np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            new_key[0] = last_key is None or key[0] != last_key
            new = new_key.copy()
            new[1:] |= fp[1:] != fp[:-1]
            new[0] |= fp[0] != last_fp
            start = np.maximum.accumulate(np.where(new_key, np.arange(len(key)), -1))
            pivots = np.where(start >= 0, fp[np.maximum(start, 0)], pivot if pivot is not None else 0)
            last_key, last_fp, pivot = key[-1], fp[-1], pivots[-1]
            out = new & ~new_key & (fp != pivots)
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(fp[out]), pa.array(pivots[out])], ["key", "fp", "pivot"])

    rows = keys.repartition("key").sortWithinPartitions("key", "fp")
    return written(rows.mapInArrow(task, "key long, fp long, pivot long"), "stars")


def _nodes(docs: DataFrame, wanted: DataFrame, k: int, seed: int) -> DataFrame:
    """(fp, n, sketch, text) of the sets of docs (text) whose fp is in wanted, written once: one row each, however often a set is met.

    The sketch has the shingles in the lowest quarter of hashes, cut to 24 bits, little-endian.
    """

    def task(batches):
        part, seen = TaskContext.get().partitionId(), set()
        for batch, first, last, h, bounds, fp in _batches(batches, k, seed):
            low = h < U(1 << 62)
            upto = np.concatenate([[0], np.cumsum(low)])[bounds] * 3
            data = (h[low] >> U(38)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
            sketch = pa.Array.from_buffers(pa.binary(), len(fp), [None, pa.py_buffer(upto.astype(np.int32).tobytes()), pa.py_buffer(data)])
            new = [f and f not in seen and not seen.add(f) for f in fp.tolist()]
            out = pa.RecordBatch.from_arrays(
                [
                    _signed(fp), pa.array(np.diff(bounds).astype(np.int32)), sketch, batch.column(0).slice(first, last - first).cast(pa.string()),
                    pa.array(np.full(len(fp), part, np.int32))
                ],
                ["fp", "n", "sketch", "text", "part"]
            )
            yield out.filter(pa.array([bool(x) for x in new], pa.bool_()))

    found = docs.select("text").mapInArrow(task, "fp long, n int, sketch binary, text string, part int")
    found = written(found.join(broadcast_if(wanted, MOST_ROWS), "fp", "left_semi"), "nodes")
    again = found.groupBy("fp").agg(F.min("part").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").select("fp", "least")
    again = written(again, "again")
    if again.isEmpty():
        return found.drop("part")
    first = found.join(broadcast_if(again, MOST_ROWS), "fp", "left").where("least IS NULL OR part = least")
    return written(first.select("fp", "n", "sketch", "text"), "nodes")


def _sketch(data) -> np.ndarray:
    """The sorted numbers of a sketch's bytes."""
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


def _only(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The nodes that are an end of a pair: others don't move."""
    ends = written(pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).distinct(), "ends")
    return nodes.join(broadcast_if(ends, MOST_ENDS), "fp", "left_semi")


def _sized(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sizes allow enough to be shared."""
    sizes = written(nodes.select("fp", "n"), "sizes")
    sizes = broadcast_if(sizes, MOST_ROWS)
    rows = pairs.join(sizes.toDF("v", "nv"), "v").join(sizes.toDF("u", "nu"), "u")
    return written(rows.where((100 + percent) * F.least("nu", "nv").cast("long") >= percent * (F.col("nu").cast("long") + F.col("nv"))).select("u", "v"), "sized")


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that may be similar enough: an upper bound on what they share, from sizes, then sketches.

    A cut hash can only make the sketches seem to share more, so no similar pair is lost.
    """

    def task(batches):
        for batch in batches:
            good = np.zeros(len(batch), bool)
            nu, nv = (batch.column(i).to_numpy() for i in (2, 3))
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                a, b = _sketch(x.as_buffer()), _sketch(y.as_buffer())
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) and len(b) else 0
                good[i] = (100 + percent) * (both + min(int(nu[i]) - len(a), int(nv[i]) - len(b))) >= percent * (int(nu[i]) + int(nv[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good))

    pairs = _sized(pairs, nodes, percent)
    slim = _only(nodes.select("fp", "n", "sketch"), pairs)
    rows = pairs.join(slim.toDF("v", "nv", "sv"), "v").join(slim.toDF("u", "nu", "su"), "u").select("u", "v", "nu", "nv", "su", "sv")
    return written(rows.mapInArrow(task, "u long, v long"), "possible")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough, by their whole texts."""

    def task(batches):
        for batch in batches:
            good = np.zeros(len(batch), bool)
            sides = []
            for column in (2, 3):
                hs, at = [], [np.zeros(1, np.int64)]
                for _, _, data, offsets in text_runs(batch.column(column)):
                    h, bounds = shingle_sets(data, offsets, k)
                    hs.append(h)
                    at.append(bounds[1:] + at[-1][-1])
                sides.append((np.concatenate(hs) if hs else np.zeros(0, np.uint64), np.concatenate(at)))
            (x, xb), (y, yb) = sides
            for i in range(len(batch)):
                a, b = x[xb[i] : xb[i + 1]], y[yb[i] : yb[i + 1]]
                small, large = (a, b) if len(a) < len(b) else (b, a)
                if len(small):
                    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                    good[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good))

    texts = _only(texts, pairs)
    left = texts.select(F.col("fp").alias("v"), F.col("text").alias("tv"))
    right = texts.select(F.col("fp").alias("u"), F.col("text").alias("tu"))
    rows = pairs.select("u", "v").join(left, "v").join(right, "u").select("u", "v", "tu", "tv")
    return written(rows.mapInArrow(task, "u long, v long"), "links")


def _open_keys(named: DataFrame, done: DataFrame | None) -> DataFrame:
    """(key, fp, label, old) of the keys that hold two labels and a pair that was never compared.

    named: (key, fp, label); done: (fp, met), met being a key whose sets were all compared. Of a key's
    sets, `old` are those of the earlier key that covers the most of them.
    """
    mixed = named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most").select("key", "n")
    if done is None:
        return written(named.join(mixed, "key").select("key", "fp", "label", F.lit(False).alias("old")), "open")
    live = written(named.join(mixed, "key"), "live")
    cover = live.join(done, "fp").groupBy("key", "met").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("met", F.struct("c", "met")).alias("met"), F.max("c").alias("c"))
    left = live.join(cover, "key", "left").where("c IS NULL OR c < n")
    old = done.withColumn("old", F.lit(True))
    return written(left.join(old, ["fp", "met"], "left").select("key", "fp", "label", F.coalesce("old", F.lit(False)).alias("old")), "open")


def _by_pivot(open_: DataFrame, stars: DataFrame) -> DataFrame:
    """The groups of the first turn: the sets of open keys by the least pivot they ever had, which near copies share."""
    least = stars.groupBy("fp").agg(F.min("pivot").alias("key"))
    rows = open_.select("fp", "label").distinct().join(least, "fp").withColumn("old", F.lit(False))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("labels")).where("labels > 1")
    return written(_dealt(rows, sizes).select("key", "one", "two", "part", "fp", "label", "old"), "groups")


def _next_groups(open_: DataFrame, turn: int) -> DataFrame:
    """(key, one, two, part, fp, label, old) of the keys to compare now: those that a good share of their sets put first.

    The order is random and new in each turn; the very first key of all is always taken. Keys of many
    sets are cut into parts, and every pair of parts is a group of its own.
    """
    first = F.struct(F.xxhash64("key", F.lit(turn)).alias("h"), F.col("key").alias("key"))
    pick = open_.groupBy("fp").agg(F.min(first).alias("first")).select("fp", F.col("first.key").alias("mine"))
    votes = open_.join(pick, "fp").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("key") == F.col("mine")).cast("int")).alias("votes"))
    chosen = votes.where(F.col("votes") >= SHARE * F.col("n")).select("key", "n")
    return written(_dealt(open_, chosen).select("key", "one", "two", "part", "fp", "label", "old"), "groups")


def _dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows of keys in parts of about SPLIT: every pair of parts (one, two) gets the rows of both; sizes: (key, n)."""
    cut = rows.join(sizes.select("key", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts")), "key").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumn("one", F.least("part", "other")).withColumn("two", F.greatest("part", "other"))


def _grouped(batches, width: int):
    """(key, rows) of each group of a stream sorted by its first three columns; rows hold the others up to width."""
    held, key = [], None
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(width))):
            if row[:3] != key:
                if len(held) > 1:
                    yield key, held
                held, key = [], row[:3]
            held.append(row[3:])
    if len(held) > 1:
        yield key, held


def _asking(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The rows of groups that have a partner left to compare by parts, labels, earlier groups and sizes: only their sketches move.

    rows: (key, one, two, part, fp, label, old, met), met being earlier groups that held the set, or null.
    """

    def task(batches):
        for key, rows in _grouped(batches, 9):
            some = np.flatnonzero(_left(key, rows, percent).any(1))
            if some.size:
                k = [pa.array([key[0]] * len(some), pa.int64()), *(pa.array([x] * len(some), pa.int32()) for x in key[1:])]
                part, fp, label, old, met = ([rows[i][j] for i in some] for j in range(5))
                own = [pa.array(part, pa.int32()), pa.array(fp, pa.int64()), pa.array(label, pa.int64()), pa.array(old, pa.bool_()), pa.array(met, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*k, *own], MEMBER)

    sizes = broadcast_if(nodes.select("fp", F.col("n").cast("long").alias("n")), MOST_ROWS)
    sent = rows.join(sizes, "fp").select(*MEMBER, "n").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return written(sent.mapInArrow(task, "key long, one int, two int, part int, fp long, label long, old boolean, met array<long>"), "asking")


def _sketched(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The rows that _asking() leaves, with their sizes and sketches, by groups."""
    left = _asking(rows, nodes, percent)
    slim = _only(nodes.select("fp", F.col("n").cast("long").alias("n"), "sketch"), left.select(F.col("fp").alias("u"), F.col("fp").alias("v")))
    return left.join(slim, "fp").select(*MEMBER, "n", "sketch").repartition(*GROUP).sortWithinPartitions(*GROUP)


def _left(key: tuple, rows: list, percent: int) -> np.ndarray:
    """Which pairs of a group are left to compare, sketches aside; rows: (part, fp, label, old, met, n, ...)."""
    part, label, old, n = (np.array([r[i] for r in rows]) for i in (0, 2, 3, 5))
    left = _asked(key, part, label, old) & _sizes_allow(n, percent)
    met = [r[4] or [] for r in rows]
    if any(met) and left.any():
        ids, inverse = np.unique(np.concatenate([np.array(x, np.int64) for x in met]), return_inverse=True)
        holds = np.zeros((len(rows), len(ids)), np.float32)
        holds[np.repeat(np.arange(len(rows)), [len(x) for x in met]), inverse] = 1
        left &= ~(holds @ holds.T > 0)
    return left


def _never_compared(open_: DataFrame, done: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(u, v): pairs of different labels in open keys that no earlier group held together and that sizes and sketches allow."""

    def task(batches):
        for key, rows in _grouped(batches, 10):
            fp, n = (np.array([r[i] for r in rows]) for i in (1, 5))
            new = _allowed(_left(key, rows, percent), n, [r[6] for r in rows], percent)
            a, b = np.nonzero(np.triu(new, 1))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(fp[a], fp[b])), pa.array(np.maximum(fp[a], fp[b]))], ["u", "v"])

    sizes = open_.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    past = done.groupBy("fp").agg(F.collect_set("met").alias("met"))
    rows = _dealt(open_.join(past, "fp", "left").withColumn("old", F.lit(False)), sizes)
    return _sketched(rows.select(*MEMBER), nodes, percent).mapInArrow(task, "u long, v long").distinct()


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How much each pair of sets has in common, by products of incidence matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    ids, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    shared = times[inverse] > 1
    column, row = place[inverse[shared]], owner[shared]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for a in range(0, int(place[-1]) + 1 if len(place) else 0, 8192):
        lo, hi = np.searchsorted(column, [a, a + 8192])
        holds = np.zeros((len(sets), 8192), np.float32)
        holds[row[lo:hi], column[lo:hi] - a] = 1
        both += holds @ holds.T
    return both


def _asked(key: tuple, part: np.ndarray, label: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Which pairs of a group are of different labels, not compared before, and of this pair of parts."""
    asked = (label[:, None] != label[None, :]) & ~(old[:, None] & old[None, :])
    return asked & (part[:, None] != part[None, :]) if key[1] != key[2] else asked


def _sizes_allow(n: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs may be similar enough by their sizes alone."""
    return (100 + percent) * np.minimum(n[:, None], n[None, :]) >= percent * (n[:, None] + n[None, :])


def _allowed(asked: np.ndarray, n: np.ndarray, sketches: list, percent: int) -> np.ndarray:
    """Those of the asked pairs of a group that may be similar enough, by sizes and sketches."""
    asked = asked & _sizes_allow(n, percent)
    some = np.flatnonzero(asked.any(1))
    if not some.size:
        return asked
    low = [np.unique(_sketch(sketches[i])) for i in some]
    m = n[some]
    rest = m - np.array([len(x) for x in low])  # equal cut hashes of one set count here
    most = _shared(low) + np.minimum(rest[:, None], rest[None, :])
    asked[np.ix_(some, some)] &= (100 + percent) * most >= percent * (m[:, None] + m[None, :])
    return asked


def _screened(groups: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The rows of groups that may have a similar partner in their group, by sizes and sketches; texts stay where they are."""
    columns = MEMBER[:-1]

    def task(batches):
        for key, rows in _grouped(batches, 10):
            part, fp, label, old, n = (np.array([r[i] for r in rows]) for i in (0, 1, 2, 3, 5))
            near = _allowed(_left(key, rows, percent), n, [r[6] for r in rows], percent)
            some = np.flatnonzero(near.any(1))
            if some.size:
                k = [pa.array([key[0]] * len(some), pa.int64()), *(pa.array([x] * len(some), pa.int32()) for x in key[1:])]
                yield pa.RecordBatch.from_arrays([*k, pa.array(part[some].astype(np.int32)), pa.array(fp[some]), pa.array(label[some]), pa.array(old[some])], columns)

    sent = _sketched(groups.withColumn("met", F.lit(None).cast("array<long>")), nodes, percent)
    return written(sent.mapInArrow(task, "key long, one int, two int, part int, fp long, label long, old boolean"), "screened")


def _compared(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """A spanning forest (u, v) of the links between different labels in each group, from whole texts."""

    def task(batches):
        held, key = [], None

        def flush():
            part, fp, label, old, sets = (list(x) for x in zip(*held))
            part, fp, label, old = np.array(part), np.array(fp), np.array(label), np.array(old)
            both, n = _shared(sets), np.array([len(x) for x in sets])
            near = _asked(key, part, label, old) & (100 * both >= percent * (n[:, None] + n[None, :] - both))
            root = np.arange(len(fp))
            while True:
                least = np.minimum(root, np.where(near, root[None, :], len(fp)).min(1))
                if (least == root).all():
                    break
                root = least
            some = root != np.arange(len(fp))
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(fp[root[some]]), pa.array(fp[some])], ["u", "v"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            plain = list(zip(*(batch.column(i).to_pylist() for i in range(3, 7))))
            for first, last, data, offsets in text_runs(batch.column(7)):
                h, bounds = shingle_sets(data, offsets, k)
                for r in range(first, last):
                    if keys[r] != key:
                        if len(held) > 1:
                            yield from flush()
                        held, key = [], keys[r]
                    held.append((*plain[r], h[bounds[r - first] : bounds[r - first + 1]].copy()))
        if len(held) > 1:
            yield from flush()

    sent = rows.select(*GROUP, "part", "fp", "label", "old", "text").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return written(sent.mapInArrow(task, "u long, v long"), "links")


def fingerprint_column(k: int = WORDS, seed: int = 0):
    @F.arrow_udf(T.LongType())
    def fingerprint(text: pa.Array) -> pa.Array:
        out = [fingerprints(*shingle_sets(data, offsets, k), seed) for _, _, data, offsets in text_runs(text)]
        return _signed(np.concatenate(out) if out else np.zeros(0, np.uint64))

    return fingerprint


def _near(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, int]:
    """What near_duplicates() returns, and the seed of its fingerprints."""
    for seed in count():
        both = _sets(docs, k, seed)
        rows = both.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("fp"), F.col("c").alias("n"), F.col("d").alias("second"))
        sets = rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("m"), (F.min("second") < F.max("second")).alias("clash"))
        sets = written(sets, "fingerprints")
        if sets.where("clash").isEmpty():
            break
    rows = rows.drop("second")
    stars = _stars(_keys(docs, _common(both), k, percent, seed))
    pairs = written(stars.select(F.col("pivot").alias("u"), F.col("fp").alias("v")).distinct(), "pairs")
    ends = pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).distinct()
    ends = written(ends.join(sets.select("fp", "doc_id"), "fp"), "ends")
    # only rows with the id of a set's first row are hashed again; which of them hold a wanted set is seen then
    ids = broadcast_if(written(ends.select(F.col("doc_id").alias("id")).distinct(), "ids"), MOST_ROWS)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nodes = _nodes(found.join(ids, found["doc_id"].eqNullSafe(ids["id"]), "left_semi"), ends.select("fp"), k, seed)
    texts = nodes.select("fp", "text")
    links = _verified(_possible(pairs, nodes, percent), texts, k, percent)
    label = components(links)
    members, done = stars.select("key", "fp"), None

    def open_keys() -> DataFrame:
        named = members.join(broadcast_if(label, MOST_ROWS), members["fp"] == label["node"], "left").select("key", "fp", F.coalesce("component", "fp").alias("label"))
        return _open_keys(named, done)

    for turn in range(TURNS):
        groups = _next_groups(open_keys(), turn) if turn else _by_pivot(open_keys(), stars)
        screened = _screened(groups, nodes, percent)
        wanted = _only(texts, screened.select(F.col("fp").alias("u"), F.col("fp").alias("v")))
        links = links.unionByName(_compared(screened.join(wanted, "fp"), k, percent))
        label = components(links)
        met = groups.select("fp", F.col("key").alias("met")).distinct()
        done = written(met if done is None else done.unionByName(met), "done")
    rest = _possible(_never_compared(open_keys(), done, nodes, percent), nodes, percent)
    if not rest.isEmpty():
        links = links.unionByName(_verified(rest, texts, k, percent))
        label = components(links)
    # components are told once for each set; its rows, however many, look them up
    linked = join_known(sets.select("fp", "doc_id"), label.select(F.col("node").alias("fp"), F.col("component").alias("label")), ["fp"], MOST_ROWS)
    linked = written(linked, "linked")
    least = linked.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = join_known(linked.select("fp", "label"), written(least, "least"), ["label"], MOST_ROWS).select("fp", "label", "component_id")
    alone = sets.where("m > 1").join(broadcast_if(linked.select("fp"), MOST_ROWS), "fp", "left_anti").select("fp", F.col("fp").alias("label"), F.col("doc_id").alias("component_id"))
    out = join_known(rows, written(linked.unionByName(alone), "labels"), ["fp"], MOST_ROWS, "left")
    component = F.when(F.col("label").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), component, F.col("fp").alias("fingerprint"),
        F.when(F.col("n") > 0, F.coalesce("label", "fp")).alias("label")
    ), seed


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, fingerprint, label) of each row of docs (doc_id, text).

    label tells components apart, also those whose component_id is equal or null; wordless rows have none.
    """
    return _near(docs, k, percent)[0]


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component of near duplicates (that of least doc_id), with its columns; wordless texts all stay."""
    found, seed = _near(docs, WORDS, PERCENT)
    found = written(found.select("doc_id", "component_id", "fingerprint", "label"), "components")
    drop = found.where("doc_id IS NULL AND component_id IS NOT NULL OR doc_id <> component_id").select(F.col("doc_id").alias("d"), F.col("fingerprint").alias("f")).distinct()
    drop = broadcast_if(written(drop, "dropped"), MOST_ROWS)
    p = unused_prefix(docs)
    fp, label = p + "fingerprint", p + "label"
    tagged = docs.withColumn(fp, fingerprint_column(WORDS, seed)(F.col("text").cast("string")))
    left = tagged.join(drop, tagged["doc_id"].cast("long").eqNullSafe(drop["d"]) & (tagged[fp] == drop["f"]), "left_anti")
    firsts = found.where("label IS NOT NULL AND doc_id <=> component_id")
    again = written(firsts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("label"), "again")
    own = list(map(col_of, docs.columns))
    if again.isEmpty():
        return left.select(*own)
    # components of which several rows have the least doc_id, or none has any: one of their rows, without sorting them
    again = join_known(firsts.select("label", "fingerprint").distinct(), again, ["label"], MOST_ROWS)
    again = written(again.select(F.col("label").alias(label), F.col("fingerprint").alias(fp)), "again")
    row = F.min_by(F.struct(*own), F.struct(col_of(fp), F.col("text"), F.hash(*_hashable(docs)))).alias(p + "row")
    once = join_known(left, again, [fp], MOST_ROWS).groupBy(label).agg(row).select(p + "row.*")
    return join_known(left, again.select(fp), [fp], MOST_ROWS, "left_anti").select(*own).unionByName(once)


def _hashable(df: DataFrame) -> list:
    return [col_of(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
