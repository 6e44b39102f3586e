"""Near-duplicate vectors of equal label by spherical-cap filters.

The filter directions are a structured random product code: a vector, randomly rotated, is cut into
BLOCKS blocks, each with its own random unit codewords, and every combination of one codeword a block
is a direction. A vector is list-decoded to all directions whose cap of angle acos(alpha) holds it (at
least LEAST of the nearest ones): of either half of the blocks the best combinations are taken, and
their sums that reach alpha; where more than these could reach it, all combinations are looked at. The
code grows with the rows of a label, so a filter's expected list stays about LIST vectors. The search is
probabilistic: a pair is missed only if none of its about EXPECTED filters is shared; all pairs found
are exact.

Vectors that share a filter meet twice. First only their bytes meet (each component rounded to 8 bits,
with a bound on the error, so no near pair is lost), and those without a possible partner stay behind.
Then the others' vectors meet and are compared by cosine in double precision. A filter of more than
SPLIT nodes is dealt into parts, and every pair of parts is a group of its own. A pair that shares
several filters counts in the least of them. Each group hands on counts and a spanning forest, never
its pairs. Equal vectors of a label are one node with a count.

Null or zero vectors, those with null or non-finite components, and null labels link with nothing.
Vectors of different length don't link. Rows of equal vec_id are separate rows. A component's id is
its least vec_id; null vec_ids are carried. An empty table gives no rows. Only vec_id, embedding and
label are read, whatever other columns there are; ids and labels are integers.
"""

from __future__ import annotations

from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, join_known, shipped, written
from .components import components

COSINE = 0.98
BLOCKS, EXPECTED, LEAST, LIST, SPLIT = 4, 10, 7, 24, 1024
BEST = 32  # combinations of half the blocks that are tried first
MOST_ROWS = 1_000_000


@lru_cache(maxsize=8)
def code(dim: int, words: int, seed: int = 7) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """A rotation, and per block its bounds and codewords (rows, of norm such that directions are unit)."""
    rng = np.random.Generator(np.random.PCG64([seed, dim, words]))
    rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    blocks = min(BLOCKS, dim)
    edges = np.linspace(0, dim, blocks + 1).astype(int)
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        w = rng.standard_normal((words, b - a))
        out.append((int(a), int(b), w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(blocks)))
    return rotation, out


def _half(scores: list[np.ndarray]) -> np.ndarray:
    """The score of every combination of one codeword of each block, for each vector; the last block varies fastest."""
    out = np.zeros((len(scores[0]), 1)) if scores else None
    for s in scores:
        out = (out[:, :, None] + s[:, None, :]).reshape(len(s), -1)
    return out


def _best(s: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` greatest scores of each row, from the greatest, and their places."""
    at = np.argpartition(-s, most - 1, axis=1)[:, :most] if s.shape[1] > most else np.broadcast_to(np.arange(s.shape[1]), s.shape)
    top = np.take_along_axis(s, at, 1)
    order = np.argsort(-top, axis=1, kind="stable")
    return np.take_along_axis(top, order, 1), np.take_along_axis(at, order, 1)


def decode(vectors: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(vector, filter) for every filter of every unit vector, sorted."""
    n, dim = vectors.shape
    rotation, blocks = code(dim, words)
    turned = vectors @ rotation
    scores = [turned[:, a:b] @ w.T for a, b, w in blocks]
    every, cut = words ** len(blocks), len(blocks) // 2
    alpha = NormalDist().inv_cdf(1 - min(0.5, EXPECTED / every)) / np.sqrt(dim)
    high = _half(scores[:cut]) if cut else np.zeros((n, 1))
    low = _half(scores[cut:])
    (s, i), (t, j) = _best(high, BEST), _best(low, BEST)
    sums = s[:, :, None] + t[:, None, :]
    flat = sums.reshape(n, -1)
    least = min(LEAST, flat.shape[1])
    reach = np.minimum(alpha, np.partition(flat, -least, axis=1)[:, -least])
    more = np.zeros(n, bool)  # combinations left out might reach it too
    if high.shape[1] > BEST:
        more |= s[:, -1] + t[:, 0] >= reach
    if low.shape[1] > BEST:
        more |= s[:, 0] + t[:, -1] >= reach
    r, a, b = np.nonzero((sums >= reach[:, None, None]) & ~more[:, None, None])
    rows, filters = [r], [i[r, a].astype(np.int64) * low.shape[1] + j[r, b]]
    for r in np.flatnonzero(more):
        a = np.flatnonzero(high[r] >= reach[r] - t[r, 0])
        b = np.flatnonzero(low[r] >= reach[r] - s[r, 0])
        x, y = np.nonzero(high[r, a][:, None] + low[r, b][None, :] >= reach[r])
        rows.append(np.full(len(x), r))
        filters.append(a[x].astype(np.int64) * low.shape[1] + b[y])
    rows, filters = np.concatenate(rows), np.concatenate(filters)
    order = np.lexsort((filters, rows))
    return rows[order], filters[order]


def _unit(flat: np.ndarray, n: int) -> np.ndarray:
    x = flat.reshape(n, -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rounded(x: np.ndarray) -> np.ndarray:
    """Unit vectors as bytes: scale and error (float32), then a signed byte for each component."""
    scale = (np.abs(x).max(1) / 127).astype(np.float32)
    q = np.rint(x / scale[:, None].astype(np.float64)).astype(np.int8)
    error = np.linalg.norm(x - q * scale[:, None].astype(np.float64), axis=1) * (1 + 1e-6) + 1e-9
    out = np.empty((len(x), 8 + x.shape[1]), np.uint8)
    out[:, :4], out[:, 4:8] = scale.view(np.uint8).reshape(-1, 4), error.astype(np.float32).view(np.uint8).reshape(-1, 4)
    out[:, 8:] = q.view(np.uint8)
    return out


def _possible(data: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of rounded vectors may be as near: their product and the bound on its error."""
    scale, error = (np.ascontiguousarray(data[:, a : a + 4]).view(np.float32).ravel() for a in (0, 4))
    x = data[:, 8:].view(np.int8).astype(np.float32) * scale[:, None]
    return x @ x.T + error[:, None] * (1 + error[None, :]) + error[None, :] + 1e-4 >= cosine


def _nodes(equal: DataFrame, words: dict[tuple[int, int], int]) -> DataFrame:
    """equal (label, dim, nid, count, v) with the filters of each vector and its rounded bytes."""
    held = shipped(equal.sparkSession, words)
    kind = equal.schema["v"].dataType.simpleString()

    def task(batches):
        for batch in (b.slice(i, 512) for b in batches for i in range(0, len(b), 512)):
            label, dim = (batch.column(i).to_numpy() for i in range(2))
            for one, d in sorted(set(zip(label.tolist(), dim.tolist()))):
                own = batch.take(pa.array(np.flatnonzero((label == one) & (dim == d))))
                x = _unit(own.column(4).flatten().to_numpy(zero_copy_only=False), len(own))
                rows, filters = decode(x, held.value[one, d])
                ends = pa.array(np.searchsorted(rows, np.arange(len(own) + 1)).astype(np.int32))
                data = _rounded(x)
                at = np.arange(len(own) + 1, dtype=np.int32) * data.shape[1]
                q = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(at), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(ends, pa.array(filters)), q], ["label", "dim", "nid", "count", "v", "filters", "q"])

    return written(
        equal.select("label", "dim", "nid", "count", "v").mapInArrow(task, f"label long, dim int, nid long, count long, v {kind}, filters array<long>, q binary"),
        "nodes"
    )


GROUP = ["label", "dim", "filter", "one", "two"]


def _groups(batches, width: int):
    """Whole groups of batches sorted by GROUP, whose columns come first: tables of more than one row."""
    held, key = [], None
    for batch in batches:
        if not len(batch):
            continue
        keys = [batch.column(i).to_numpy() for i in range(len(GROUP))]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if len(batch) > 1 else np.zeros(0, np.int64)
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(batch)]):
            now = tuple(k[a].item() for k in keys)
            if now != key:
                if sum(map(len, held)) > 1:
                    yield key, pa.Table.from_batches(held).combine_chunks()
                held, key = [], now
            held.append(batch.slice(a, b - a))
    if sum(map(len, held)) > 1:
        yield key, pa.Table.from_batches(held).combine_chunks()


def _asked(part: np.ndarray, key: tuple, near: np.ndarray) -> np.ndarray:
    """near without the pairs of a node with itself, and of two parts only the pairs across."""
    np.fill_diagonal(near, False)
    return near & (part[:, None] != part[None, :]) if key[3] != key[4] else near


def _bytes_of(column: pa.ChunkedArray, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(n, -1)


def _screened(rows: DataFrame, cosine: float) -> DataFrame:
    """(GROUP, part, nid) of the nodes that may have a near one in their group, by their rounded bytes."""

    def task(batches):
        for key, table in _groups(batches, 8):
            part, nid = (table.column(i).to_numpy() for i in (5, 6))
            some = np.flatnonzero(_asked(part, key, _possible(_bytes_of(table.column(7), len(table)), cosine)).any(1))
            if some.size:
                yield from table.select(range(7)).take(pa.array(some)).to_batches()

    sent = rows.select(*GROUP, "part", "nid", "q").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return written(sent.mapInArrow(task, "label long, dim int, filter long, one int, two int, part int, nid long"), "screened")


def _links_of(key: tuple, cosine: float, part: np.ndarray, nid: np.ndarray, count: np.ndarray, x: np.ndarray, filters: list):
    """(nid, links, least nid of the same component in here) of the nodes of one filter, or one pair of its parts."""
    near = _asked(part, key, x @ x.T >= cosine)
    rows = np.flatnonzero(near.any(1))
    if not rows.size:
        return None
    near, nid, count = near[np.ix_(rows, rows)], nid[rows], count[rows]
    earlier = [filters[r][: np.searchsorted(filters[r], key[2])] for r in rows]
    ids, inverse, times = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True)
    if (times > 1).any():
        holds = np.zeros((len(rows), len(ids)), np.float32)
        holds[np.repeat(np.arange(len(rows)), [len(e) for e in earlier]), inverse] = 1
        holds = holds[:, times > 1]
        near &= ~(holds @ holds.T > 0)
    label = nid.copy()
    while True:
        least = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(1))
        if (least == label).all():
            break
        label = least
    links = near @ count
    some = links > 0
    return nid[some], links[some], label[some]


def _compared(rows: DataFrame, cosine: float) -> DataFrame:
    """(nid, links, to) from each group; streams groups in the order of the sort."""

    def task(batches):
        for key, table in _groups(batches, 10):
            part, nid, many = (table.column(i).to_numpy() for i in (5, 6, 7))
            v, lists = (table.column(i).combine_chunks() for i in (8, 9))
            v, lists = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (v, lists))
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            x = _unit(v.flatten().to_numpy(zero_copy_only=False), len(table))
            found = _links_of(key, cosine, part, nid, many, x, [flat[a:b] for a, b in zip(ends[:-1], ends[1:])])
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["nid", "links", "to"])

    sent = rows.select(*GROUP, "part", "nid", "count", "v", "filters").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return written(sent.mapInArrow(task, "nid long, links long, to long"), "links")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id, embedding, label)."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    tagged = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("v"))
    usable = "label IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    tagged = tagged.withColumn("good", F.coalesce(F.expr(usable), F.lit(False)))
    hashes = [F.when(F.col("good"), F.xxhash64("v")).alias("h1"), F.when(F.col("good"), F.xxhash64(F.lit(1), "v")).alias("h2")]
    rows = tagged.select("vec_id", "label", *hashes)
    equal = tagged.where("good").select("*", *hashes).groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("count"), F.first("v").alias("v"))
    equal = written(equal.select(F.monotonically_increasing_id().alias("nid"), "label", "h1", "h2", "vec_id", "count", "v", F.size("v").alias("dim")), "vectors")
    sizes = {(r["label"], r["dim"]): r["n"] for r in equal.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    words = {k: max(4, int(np.ceil((EXPECTED / LIST * n) ** (1 / min(BLOCKS, k[1]))))) for k, n in sizes.items()}
    nodes = _nodes(equal, words)
    caps = nodes.select("label", "dim", F.explode("filters").alias("filter"), "nid", "q")
    large = caps.groupBy("label", "dim", "filter").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT)
    large = written(large.select("label", "dim", "filter", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts")), "large")
    cut = join_known(caps, large, ["label", "dim", "filter"], MOST_ROWS, "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int")).otherwise(0))
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = cut.withColumn("other", other).select("*", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"))
    few = _screened(dealt, cosine)
    found = _compared(few.join(nodes.select("nid", "count", "v", "filters"), "nid"), cosine)
    label = components(found.select(F.col("nid").alias("u"), F.col("to").alias("v")))
    total = found.groupBy("nid").agg(F.sum("links").alias("links"))
    linked = label.select(F.col("node").alias("nid"), "component").join(total, "nid")
    linked = written(linked.join(equal.select("nid", "vec_id"), "nid"), "linked")
    least = written(linked.groupBy("component").agg(F.min("vec_id").alias("component_id")), "least")
    linked = join_known(linked, least, ["component"], MOST_ROWS).select("nid", "links", "component_id")
    # vectors with a link, or that several rows hold; all other rows stand alone
    named = equal.select("nid", "label", "h1", "h2", "vec_id", "count").join(broadcast_if(linked, MOST_ROWS), "nid", "left").where("links IS NOT NULL OR count > 1")
    links = (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n_links")
    named = written(named.select("label", "h1", "h2", links, F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")), "named")
    out = join_known(rows, named, ["label", "h1", "h2"], MOST_ROWS, "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
