"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is binned; cyclic boosting of shallow trees learns one lookup table per
feature, then one per chosen pair of features. A score is the logistic function of the sum of the
looked-up values, so scoring is vectorised bin additions.

Null and empty texts have all-zero features and are scored like any other. Features come from the
whole text alone. With no usable label the score is 1.0 for every row; with one class only, it is that
class's share, smoothed. Label rows that repeat a doc_id count as often as they occur; null labels
don't count. Training uses at most `most` labelled rows, those of least hash of doc_id, and of their
documents at most `most` rows by the same order, should ids repeat; everything else covers all rows.
Equal rows get equal scores, and an empty table gives no rows. Other columns of the input may have
any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import text_runs, word_hashes, words
from .common import bounded, col_of, shipped, unused_prefix, written

FEATURES = (
    "log_words", "mean_word", "std_word", "upper", "digit", "symbol", "punctuation", "high", "space",
    "odd_end", "long_word", "distinct", "repeat", "distinct_pairs", "words_a_line", "bar",
)
MOST_LABELS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, LEAST_HESSIAN = 32, 8, 6, 120, 60, 0.15, 2.0
THRESHOLD = 0.7

_class = lambda text: np.isin(np.arange(256), np.frombuffer(text.encode(), np.uint8))
UPPER, DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
SYMBOL, PUNCTUATION, BAR = _class("#$%&*+<=>@\\^_`{}~|"), _class("!?;:\"'()[]-/"), _class("|")
HIGH, BLANK, LINE = np.arange(256) >= 128, _class(" \t\r\n\f\v"), _class("\n")
LETTER = UPPER | _class("abcdefghijklmnopqrstuvwxyz") | HIGH


def features(text: pa.Array) -> np.ndarray:
    """A float32 row of FEATURES for each text."""
    out = np.zeros((len(text), len(FEATURES)), np.float32)
    for first, last, data, offsets in text_runs(text):
        rows = last - first
        size = np.maximum(np.diff(offsets), 1)
        share = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])[offsets]) / size
        starts, ends, row = words(data, offsets)
        n = np.bincount(row, minlength=rows)
        m = np.maximum(n, 1)
        length = (ends - starts).astype(np.float64)
        mean = np.bincount(row, length, rows) / m
        square = np.bincount(row, length**2, rows) / m
        h = word_hashes(data, starts, ends)
        pair = (h[:-1] * np.uint64(31) + h[1:])[row[:-1] == row[1:]] if len(h) else h
        pair_row = row[:-1][row[:-1] == row[1:]] if len(h) else row

        def distinct(values, owner):
            order = np.lexsort((values, owner))
            v, o = values[order], owner[order]
            new = np.ones(len(v), bool)
            new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
            return np.bincount(o[new], minlength=rows)

        same = row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])] if len(h) else row
        lines = np.round(share(LINE) * size) + 1
        out[first:last] = np.column_stack([
            np.log1p(n), mean, np.sqrt(np.maximum(square - mean**2, 0)), share(UPPER), share(DIGIT), share(SYMBOL), share(PUNCTUATION), share(HIGH), share(BLANK),
            np.bincount(row, ~LETTER[data[ends - 1]] if len(ends) else None, rows) / m, np.bincount(row, length > 15, rows) / m, distinct(h, row) / m,
            np.bincount(same, minlength=rows) / m, distinct(pair, pair_row) / m, np.log1p(n / lines), share(BAR),
        ])
    return out


@dataclass
class Gam:
    """edges[f] cut feature f into bins; tables[f] has a value for each bin; pairs have coarse edges and 2-d tables."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, f], "right")]
        for a, b, ea, eb, table in self.pairs:
            total += table[np.searchsorted(ea, x[:, a], "right"), np.searchsorted(eb, x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher")) if len(values) else np.zeros(0)


def _leaf(g, h):
    return g / (h + LEAST_HESSIAN)


def _shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values for each bin of a tree of so many levels over gradient and hessian sums."""
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl >= LEAST_HESSIAN) & (hr >= LEAST_HESSIAN), gl * _leaf(gl, hl) + gr * _leaf(gr, hr), -1)
        k = int(gain.argmax())
        if gain[k] > g.sum() * _leaf(g.sum(), h.sum()) + 1e-9:
            return np.concatenate([_shallow_tree(g[: k + 1], h[: k + 1], depth - 1), _shallow_tree(g[k + 1 :], h[k + 1 :], depth - 1)])
    return np.full(len(g), _leaf(g.sum(), h.sum()))


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a 2-d table into four by one cut on each axis: gain and values."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tl, hl = gs[:-1, :-1], hs[:-1, :-1]
    parts = [(tl, hl), (gs[:-1, -1:] - tl, hs[:-1, -1:] - hl), (gs[-1:, :-1] - tl, hs[-1:, :-1] - hl)]
    parts.append((gs[-1, -1] - sum(p[0] for p in parts), hs[-1, -1] - sum(p[1] for p in parts)))
    gain = sum(p * _leaf(p, q) for p, q in parts)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    values = np.empty_like(g)
    for (p, q), rows, cols in zip(
        parts, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)),
        (slice(0, j + 1), slice(j + 1, None), slice(0, j + 1), slice(j + 1, None))
    ):
        values[rows, cols] = _leaf(p[i, j], q[i, j])
    return float(gain[i, j]), values


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting with the logistic loss: features in turn, then the pairs of largest gain in turn."""
    if not len(y):
        return Gam(30.0, [], [], [])
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    edges = [_edges(x[:, f], BINS) for f in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), base)
    slopes = lambda: (y - (p := 1 / (1 + np.exp(-total))), np.maximum(p * (1 - p), 1e-6))
    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            g, h = slopes()
            step = RATE * _shallow_tree(np.bincount(b, g, len(tables[f])), np.bincount(b, h, len(tables[f])))
            tables[f] += step
            total += step[b]
    coarse = [_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]
    table_of = lambda a, b, v: np.bincount(cells[a] * (len(coarse[b]) + 1) + cells[b], v, (len(coarse[a]) + 1) * (len(coarse[b]) + 1)).reshape(len(coarse[a]) + 1, -1)
    g, h = slopes()
    gains = [(_quadrants(table_of(a, b, g), table_of(a, b, h))[0], a, b) for a in range(x.shape[1]) for b in range(a)]
    chosen = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    grids = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in chosen]
    for _ in range(PAIR_ROUNDS):
        for grid, (a, b) in zip(grids, chosen):
            g, h = slopes()
            step = RATE * _quadrants(table_of(a, b, g), table_of(a, b, h))[1]
            grid += step
            total += step[cells[a], cells[b]]
    return Gam(base, edges, tables, [(a, b, coarse[a], coarse[b], grid) for grid, (a, b) in zip(grids, chosen)])


@F.arrow_udf(T.ArrayType(T.FloatType()))
def feature_column(text: pa.Array) -> pa.Array:
    x = features(text)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def held_out(doc_id):
    """The rows whose labels are never learnt."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(rows: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> Gam:
    """Learns from (doc_id, features), or (doc_id, text) of which only labelled rows are looked at, and (doc_id, quality).

    At most `most` labels of rows that aren't held out, and as many rows with them, come to the driver.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", (F.col("quality") > 0).cast("int").alias("y"))
    picked = written(known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most), "labels")
    of = "features" if "features" in rows.columns else "text"
    found = rows.select("doc_id", of).join(F.broadcast(picked) if bounded(picked, most) else picked, "doc_id")
    if of == "text":
        found = found.select("doc_id", "y", feature_column(F.col("text").cast("string")).alias("features"))
    rows = found.select(F.xxhash64("doc_id").alias("_o"), "y", "features").orderBy("_o", "y", "features").limit(most).collect()
    x = np.array([r["features"] for r in rows], np.float32).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows], np.float64))


def scorer(spark, model: Gam, of: str = "features"):
    """A column function: the score of a features column, or (of="text") of the text itself."""
    held = shipped(spark, model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        if of == "text":
            x = features(column)
        else:
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))
        return pa.array(held.value.score(x))

    return score


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of every row, written once: training and scoring read it, the texts are read once."""
    return written(docs.select("doc_id", feature_column(F.col("text").cast("string")).alias("features")), "features")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with their columns; texts aren't shuffled.

    Only the labelled documents' features are computed to learn from; all texts are read once to score.
    """
    model = train(docs.select("doc_id", "text"), labels)
    score = unused_prefix(docs) + "score"
    scored = docs.withColumn(score, scorer(docs.sparkSession, model, "text")(F.col("text").cast("string")))
    return scored.where(F.col(score) >= threshold).select(*map(col_of, docs.columns))
