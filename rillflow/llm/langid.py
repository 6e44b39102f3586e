"""Language ID by Bayesian evidence fusion.

Evidence: the text's likelihood (hashed letter trigrams), the language that the markup declares, the
suffix of the address, and the host's prior. The languages are all codes that any row declares. The
classifier of texts is fitted on the SAMPLE rows of least key hash that declare a language, and for
each language on its EACH rows of least key hash besides; the conditional tables of declared language and
suffix, and the priors, are grouped sums over all rows of the text posteriors. Priors are smoothed
down the hierarchy: all rows, registered domain, host.

Defined results: a text without a letter trigram gives no text evidence, and its row isn't accepted,
nor is one that even its best language makes less likely than trigrams drawn at random (a script or
language of which no text was learnt); null or unseen declared language, suffix or host is missing
evidence, not evidence against; ties go to the language first in the alphabet; with no declared language
anywhere, every language is null and nothing is accepted; an empty table gives no rows, and equal rows
are separate rows. Columns of the input that are named like a result column give way in identify();
keep_identified() hands on the input's columns as they are, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import text_runs
from .common import broadcast_if, col_of, lower_ascii, shipped, unused_prefix, written

SAMPLE, EACH, BUCKETS = 6000, 50, 1 << 16
BLOCK = 8  # languages whose trigram tables are dense at a time
TEMPER = 1 / 3  # neighbouring trigrams share two of three letters
STRENGTH = 20.0  # rows that a parent's prior counts as
MOST_HOSTS, MOST_CELLS = 500_000, 32_000_000
LEAST_CONFIDENCE = 0.5

RESULTS = ("language", "confidence", "text_language", "accepted")

LETTERS = np.full(256, 32, np.uint8)
LETTERS[65:91] = LETTERS[97:123] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams with at most one separator, and the rows' bounds in them."""
    rows = np.arange(len(offsets) - 1)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(rows) + 1, np.int64)
    b = LETTERS[data].astype(np.uint32)
    good = ((b[:-2] == 32).astype(np.int8) + (b[1:-1] == 32) + (b[2:] == 32)) <= 1
    ends = offsets[1:]
    for back in (1, 2):  # no trigram spans two rows
        at = ends - back
        good[at[(at >= 0) & (at < len(good))]] = False
    at = np.flatnonzero(good)
    bucket = (((b[at] << 16) | (b[at + 1] << 8) | b[at + 2]) * np.uint32(2654435761)) >> np.uint32(16)
    return bucket.astype(np.int64), np.searchsorted(at, offsets)


@dataclass
class TextModel:
    languages: list[str]
    cells: np.ndarray  # language * BUCKETS + bucket of the counts, sorted
    counts: np.ndarray

    def blocks(self):
        """(first language, BUCKETS x languages log probabilities, float32) of BLOCK languages after BLOCK languages."""
        for first in range(0, len(self.languages), BLOCK):
            n = min(BLOCK, len(self.languages) - first)
            a, b = np.searchsorted(self.cells, [first * BUCKETS, (first + n) * BUCKETS])
            counts = np.zeros((n, BUCKETS))
            counts.reshape(-1)[self.cells[a:b] - first * BUCKETS] = self.counts[a:b]
            counts = counts.T + 0.5
            yield first, np.log(counts / counts.sum(0)).astype(np.float32)

    def evidence(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log likelihoods, NaN where the text has no trigram; and whether the best beats random trigrams."""
        out, fits = np.full((len(text), len(self.languages)), np.nan), np.zeros(len(text), bool)
        for first, _, data, offsets in text_runs(text):
            bucket, bounds = _trigrams(data, offsets)
            some = np.flatnonzero(np.diff(bounds))
            if some.size:
                for at, logs in self.blocks():
                    out[first + some, at : at + logs.shape[1]] = np.add.reduceat(logs[bucket], bounds[some], axis=0, dtype=np.float64) * TEMPER
                fits[first + some] = out[first + some].max(1) > -np.log(BUCKETS) * TEMPER * np.diff(bounds)[some]
        return out, fits


def fit_text(df: DataFrame, key: str, text: str, declared: str, most: int = SAMPLE, each: int = EACH) -> TextModel:
    """Trigram tables of all declared languages, from the `most` rows of least hash and the `each` of every language.

    The hash is of key and language; rows of one hash count once, so key should tell rows of different texts
    apart. It is taken before the texts are: only those of the sample are worked out here.
    """
    told = df.where(F.col(declared).isNotNull()).select(F.col(text).alias("text"), F.col(declared).alias("name"), F.xxhash64(key, declared).alias("h"))
    nth = F.row_number().over(Window.partitionBy("name").orderBy("h"))
    edges = told.select("name", "h").withColumn("nth", nth).where(F.col("nth") <= each)
    edges = written(edges.groupBy("name").agg(F.max("h").alias("edge")), "edges")
    names = sorted(r["name"] for r in edges.select("name").toLocalIterator())
    if not names:
        return TextModel([], np.zeros(0, np.int64), np.zeros(0, np.int64))
    edge = told.select("h").orderBy("h").limit(most).agg(F.max("h").alias("h")).first()["h"]
    place = shipped(df.sparkSession, {k: i for i, k in enumerate(names)})

    def count(batches):
        for batch in batches:
            of = np.array([place.value[k] for k in batch.column(1).to_pylist()], np.int64)
            for first, last, data, offsets in text_runs(batch.column(0)):
                bucket, bounds = _trigrams(data, offsets)
                cells, counts = np.unique(np.repeat(of[first:last], np.diff(bounds)) * BUCKETS + bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts.astype(np.int64))], ["cell", "n"])

    near = told.join(broadcast_if(edges, MOST_HOSTS), "name").where(F.col("h") <= F.greatest("edge", F.lit(edge)))
    sample = near.groupBy("h").agg(F.first("text").alias("text"), F.first("name").alias("name")).select("text", "name")
    table = sample.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells, counts = (table[c].to_numpy() for c in ("cell", "n"))
    order = np.argsort(cells)
    return TextModel(names, cells[order], counts[order])


def _dense(sums: pa.Array, n: int) -> np.ndarray:
    """rows x n: lists of (language, sum) as dense rows; null is all zeros."""
    sums = sums.combine_chunks() if isinstance(sums, pa.ChunkedArray) else sums
    out = np.zeros((len(sums), n))
    flat = sums.flatten()
    lengths = sums.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(sums)), lengths), flat.field("i").to_numpy()] = flat.field("p").to_numpy()
    return out


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def identify(df: DataFrame, key: str, text, declared, host=None, domain=None, suffix=None, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """df with language, confidence, text_language and accepted; the evidence is given as columns of df.

    Two narrow passes over the texts: one for the grouped sums, one to score. The sums are joined by
    host; the table of hosts is broadcast up to MOST_HOSTS rows, and joined by a shuffle beyond.
    """
    own = [c for c in df.columns if c.lower() not in RESULTS]
    found, judged = _judged(df, own, key, text, declared, host, domain, suffix, least)
    return found.select(*map(col_of, own), *[judged[c].alias(c) for c in RESULTS])


def _judged(df: DataFrame, own: list[str], key: str, text, declared, host, domain, suffix, least: float) -> tuple[DataFrame, dict]:
    """df's columns `own` beside others of unused names, and the columns of the result by name."""
    spark, p = df.sparkSession, unused_prefix(df)
    none = F.lit(None).cast("string")
    c_text, c_declared, c_host, c_domain, c_suffix, c_e, c_found = (p + x for x in ("text", "declared", "host", "domain", "suffix", "e", "found"))
    code = F.nullif(F.split(lower_ascii(F.trim(declared)), "[-_]").getItem(0), F.lit(""))
    row = F.xxhash64(*[col_of(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()])  # tells rows apart that share a key
    given = [(none if x is None else x).alias(c) for x, c in ((host, c_host), (domain, c_domain), (suffix, c_suffix))]
    tagged = df.select(*map(col_of, own), (col_of(text) if isinstance(text, str) else text).cast("string").alias(c_text), code.alias(c_declared), row.alias(p + "row"), *given)
    model = fit_text(tagged.select(F.col(p + "row").alias("key"), F.col(c_text).alias("text"), F.col(c_declared).alias("declared")), "key", "text", "declared")
    names = model.languages
    if not names:
        return tagged, {"language": none, "confidence": F.lit(0.0), "text_language": none, "accepted": F.lit(False)}
    held = shipped(spark, model)

    @F.arrow_udf("logs array<double>, fits boolean")
    def evidence(column: pa.Array) -> pa.Array:
        logs, fits = held.value.evidence(column)
        bad = np.isnan(logs[:, 0])
        logs[~bad] -= logs[~bad].max(1, keepdims=True)
        offsets = pa.array(np.arange(len(logs) + 1, dtype=np.int32) * len(held.value.languages))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(logs.ravel()), mask=pa.array(bad)), pa.array(fits)], ["logs", "fits"])

    n, value = len(names), F.struct("i", "p")
    keys = ["_host", "_domain", "_suffix", "_declared"]
    seen = tagged.select(*[F.col(c).alias(k) for c, k in zip((c_host, c_domain, c_suffix, c_declared), keys)], evidence(c_text)["logs"].alias("_e")).where("_e IS NOT NULL")
    seen = seen.select("*", F.transform("_e", F.exp).alias("_x"))
    seen = seen.select("*", F.aggregate("_x", F.lit(0.0), lambda a, x: a + x).alias("_s"))
    share = seen.select(*keys, "_s", F.posexplode("_x").alias("i", "x")).where("x > 0")
    cube = written(share.groupBy(*keys, "i").agg(F.sum(F.col("x") / F.col("_s")).alias("p")), "languages")

    def by(*columns: str) -> DataFrame:
        """Sums of the cube by columns and language, where the columns are filled."""
        rows = cube.where(" AND ".join([f"{c} IS NOT NULL" for c in columns] or ["true"]))
        return rows.groupBy(*columns, "i").agg(F.sum("p").alias("p"))

    def by_language(rows: DataFrame) -> np.ndarray:
        out = np.zeros(n)
        for r in rows.groupBy("i").agg(F.sum("p").alias("p")).toLocalIterator():
            out[r["i"]] = r["p"]
        return out

    total = by_language(by())
    overall = (total + 1) / (total.sum() + n)

    def conditional(column: str) -> DataFrame:
        """Log P(value | language), add-one smoothed, of the values that are seen."""
        rows = by(column)
        rest = by_language(rows) + rows.select(column).distinct().count() + 1

        @F.arrow_udf("array<double>")
        def logs(sums: pa.Array) -> pa.Array:
            return _lists(np.log((_dense(sums, n) + 1) / rest))

        return rows.groupBy(column).agg(F.collect_list(value).alias("_p")).select(F.col(column).alias("_v"), logs("_p").alias("_l"))

    @F.arrow_udf("array<double>")
    def smoothed(host: pa.Array, domain: pa.Array) -> pa.Array:
        own, above = _dense(host, n), _dense(domain, n)
        above = (above + STRENGTH * overall) / (above.sum(1, keepdims=True) + STRENGTH)
        return _lists(np.log((own + STRENGTH * above) / (own.sum(1, keepdims=True) + STRENGTH)))

    domains = by("_domain").groupBy(F.col("_domain").alias("_dk")).agg(F.collect_list(value).alias("_d"))
    names_of = cube.where("_host IS NOT NULL").groupBy(F.col("_host").alias("_v")).agg(F.max("_domain").alias("_domain"))
    hosts = by("_host").groupBy("_host").agg(F.collect_list(value).alias("_h")).join(names_of, F.col("_host") == F.col("_v"))
    hosts = hosts.join(domains, hosts["_domain"] == domains["_dk"], "left")
    prior = written(hosts.select("_v", smoothed("_h", "_d").alias("_prior")), "priors")
    told = written(conditional("_declared"), "declared")
    ends = written(conditional("_suffix"), "suffixes")
    out = tagged.withColumn(c_found, evidence(c_text))
    found = []
    for column, table in ((c_host, prior), (c_declared, told), (c_suffix, ends)):
        table = table.toDF(column + "_v", column + "_l")
        out = out.join(broadcast_if(table, min(MOST_HOSTS, MOST_CELLS // n)), out[column] == table[column + "_v"], "left").drop(column + "_v")
        found.append(F.col(column + "_l"))
    zero = F.array_repeat(F.lit(0.0), n)
    top = F.array(*[F.lit(float(np.log(x))) for x in overall])
    logs = F.coalesce(F.col(c_found)["logs"], zero)
    for more, missing in zip(found, (top, zero, zero)):
        logs = F.zip_with(logs, F.coalesce(more, missing), lambda a, b: a + b)
    every = p + "all"
    out = out.withColumn(every, logs).withColumn(c_e, F.col(c_found)["logs"])
    best = F.array_max(every)
    langs = F.array(*[F.lit(x) for x in names])
    name_of = lambda of: F.get(langs, F.array_position(of, F.array_max(of)).cast("int") - 1)
    out = out.withColumn(p + "sure", F.lit(1.0) / F.aggregate(every, F.lit(0.0), lambda a, x: a + F.exp(x - best)))
    fits = F.col(c_e).isNotNull() & F.coalesce(F.col(c_found)["fits"], F.lit(False))
    return out, {"language": name_of(every), "confidence": F.col(p + "sure"), "text_language": name_of(c_e), "accepted": fits & (F.col(p + "sure") >= least)}


HIDDEN = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[A-Za-z0-9#]+;"


def identify_pages(pages: DataFrame) -> DataFrame:
    """Pages with html and url: visible text, html lang attribute, top-level suffix, registered domain, host."""
    host = lower_ascii(F.nullif(F.regexp_extract("url", r"://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    labels = F.split(host, r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    declared = F.nullif(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1), F.lit(""))
    return identify(pages, "page_id", F.regexp_replace("html", HIDDEN, " "), declared, host, F.when(host.isNotNull(), domain), F.when(host.isNotNull(), F.element_at(labels, -1)))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents whose language is accepted, with their columns: lang is what is declared, source is the host."""
    found, judged = _judged(docs, docs.columns, "doc_id", "text", F.col("lang").cast("string"), F.col("source").cast("string"), None, None, LEAST_CONFIDENCE)
    return found.where(judged["accepted"]).select(*map(col_of, docs.columns))
