"""A uniform shuffle into shards of exact size, planned as a hypergeometric communication matrix.

Partition p has n_p rows, shard j takes c_j (at most one apart). Under a uniform random permutation
the counts A[p, j] of rows that go from p to j follow the multivariate hypergeometric law; the matrix
is drawn row by row on the driver (one number per partition and shard, no data). Each partition then
permutes its rows and cuts them by its row of the matrix, the rows are exchanged, and each shard
permutes again. No Python touches a row.

Any column may be null and of any length; equal rows are separate rows, each with its own slot; an empty
table gives no rows; columns may have any names. The outcome depends on seed and on how the input is
split into partitions. Partitions beyond MOST_PARTS are planned together, so the matrix and what is
broadcast (a row for each partition or shard) stay small, however large the input.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, col_of, unused_prefix, written

BUCKET_ROWS = 200_000
MOST_PARTS, MOST_SHARDS = 4096, 65_536


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One draw by inversion over 12 standard deviations around the mode; any size of population."""
    total = good + bad
    if not draws or not good:
        return 0
    if not bad or draws == total:
        return min(good, draws)
    low, high = max(0, draws - bad), min(good, draws)
    mean = draws * good / total
    wide = 12 * math.sqrt(max(mean * (bad / total) * ((total - draws) / max(1, total - 1)), 1)) + 12
    low, high = max(low, math.floor(mean - wide)), min(high, math.ceil(mean + wide))
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(p, rng.random() * p[-1], "right"))


def communication_matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """A[p][j]: exact row sums `rows`; column sums that differ by at most one."""
    total, rng = sum(rows), np.random.Generator(np.random.PCG64(seed))
    room = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = []
    for n in rows:
        left, pool, row = n, sum(room), []
        for j in range(shards):
            pool -= room[j]
            row.append(hypergeometric(rng, room[j], pool, left))
            left -= row[-1]
        room = [c - x for c, x in zip(room, row)]
        matrix.append(row)
    return matrix


def _ranked(df: DataFrame, key: str, order: list[str], p: str) -> DataFrame:
    """df with a column p + rank: the place from 0 of each row within key by order, of which the first is a random long.

    A key's rows are cut by the random number into ranges of about BUCKET_ROWS, ranked range by range,
    and moved up by the counts of the ranges before: no task holds a whole key, however large.
    """
    k, n, buckets, bucket, b, before, place = (p + x for x in ("k", "n", "buckets", "bucket", "b", "before", "in"))
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    cut = sizes.select(F.col(key).alias(k), F.greatest(F.ceil(F.col(n) / BUCKET_ROWS), F.lit(1)).cast("long").alias(buckets))
    rows = df.join(broadcast_if(cut, MOST_SHARDS), df[key] == cut[k]).drop(k)
    rows = rows.withColumn(bucket, F.least(F.floor((F.col(order[0]) / F.lit(2.0**63)) * F.col(buckets)), F.col(buckets) - 1))
    steps = rows.groupBy(key, bucket).agg(F.count(F.lit(1)).alias(n))
    steps = steps.select(F.col(key).alias(k), F.col(bucket).alias(b), (F.sum(n).over(Window.partitionBy(key).orderBy(bucket)) - F.col(n)).alias(before))
    rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(key, bucket).orderBy(*order)) - 1)
    rows = rows.join(steps, (rows[key] == steps[k]) & (rows[bucket] == steps[b]))
    return rows.withColumn(p + "rank", F.col(place) + F.col(before)).drop(k, b, n, place, before, bucket, buckets)


def shuffle_to_shards(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """df with shard (int) and slot (long, gapless from 0 in each shard): a uniform random order of all rows.

    df is read once: what it holds is written to the shared folder first, with the partition and the
    place that each row came from, so a lost executor repeats the same choices. Carry ids rather than
    texts where only the order is wanted. Columns named shard or slot give way to the new ones.
    """
    if not 0 < shards <= MOST_SHARDS:
        raise ValueError(f"{shards} shards; 1 to {MOST_SHARDS} can be planned")
    own = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    p = unused_prefix(df)
    part, row, random, edges = p + "part", p + "row", p + "random", p + "edges"
    kept = list(map(col_of, own))
    rows = written(df.select(*kept, F.pmod(F.spark_partition_id(), F.lit(MOST_PARTS)).alias(part), F.monotonically_increasing_id().alias(row)), "shuffle")
    positive = lambda salt: F.shiftrightunsigned(F.xxhash64(F.col(row), F.lit(seed), F.lit(salt)), 1)
    counts = {r[part]: r["n"] for r in rows.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = sorted(counts)
    plan = [(x, np.cumsum(row).tolist()) for x, row in zip(parts, communication_matrix([counts[x] for x in parts], shards, seed))]
    plan = df.sparkSession.createDataFrame(plan, f"{p}p int, {edges} array<long>")
    local = _ranked(rows.withColumn(random, positive("local")), part, [random, row], p)
    sent = local.join(broadcast_if(plan, MOST_PARTS), local[part] == plan[p + "p"])
    if shards <= 64:
        shard = reduce(lambda rest, j: F.when(F.col(p + "rank") < F.col(edges)[j], F.lit(j)).otherwise(rest), reversed(range(shards - 1)), F.lit(shards - 1))
    else:
        shard = F.size(F.filter(edges, lambda e: e <= F.col(p + "rank")))
    sent = sent.select(*kept, row, shard.cast("int").alias("shard"))
    placed = _ranked(sent.withColumn(random, positive("shard")), "shard", [random, row], p)
    return placed.select(*kept, "shard", F.col(p + "rank").cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """Writes what shuffle_to_shards made, one folder per shard, in the order of the slots within each file."""
    df.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
