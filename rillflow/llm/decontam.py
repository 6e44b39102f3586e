"""Benchmark decontamination over a positional inverted index, in DataFrame operations alone.

The index holds the postings (row, place, term) of every training word, and each row's length as its
posting of the empty term; it depends on the documents alone and can be saved, loaded and asked again.
Of the postings, those of the queries' terms are picked once. A query (a window of benchmark words)
starts from the postings of its rarest term, moved back by the term's offset, and meets the lists of
its next rarest terms one after another, then all the others within the rows that are left: what stays
are exact phrase matches. proximity() asks only that all terms lie within a span, in any order.

Words are maximal stretches of letters, digits and characters beyond ASCII, A-Z as a-z. Null and empty
texts have no words; texts of any length are indexed whole; items without words have no windows; equal
rows of the corpus are separate rows, and equal windows of items count for each item once; null item ids
hit but are not counted among the items. An empty benchmark or corpus gives no hits. Other columns of
the documents may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if, col_of, join_known, lower_ascii, written

WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MOST_TERMS, MOST_ROWS = 1_000_000, 2_000_000
EARLY = 2  # next rarest terms that are met one by one


def words(text):
    return F.filter(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), lambda w: w != "")


@dataclass
class Queries:
    """windows (wid, terms); terms (wid, off, term_id); items (item_id, wid); vocabulary (term_id, term)."""

    windows: DataFrame
    terms: DataFrame
    items: DataFrame
    vocabulary: DataFrame


@dataclass
class Index:
    """postings (rid, place, term) of all words and rows (rid, doc_id, n_words); lists: (rid, place, term_id) of one set of queries."""

    postings: DataFrame
    rows: DataFrame
    lists: DataFrame | None = None

    def save(self, folder: str) -> None:
        self.postings.write.parquet(f"{folder}/postings")
        self.rows.write.parquet(f"{folder}/rows")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> "Index":
        return Index(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/rows"))

    def of(self, queries: Queries) -> "Index":
        """The index with the lists of the queries' terms: one pass over the postings, which aren't shuffled while the vocabulary is within its bounds."""
        found = join_known(self.postings, queries.vocabulary, ["term"], MOST_TERMS).select("rid", "place", "term_id")
        return Index(self.postings, self.rows, written(found, "lists"))


def queries_of(benchmark: DataFrame, width: int = WINDOW) -> Queries:
    split = benchmark.select(F.col("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    cut = split.select(
        "item_id",
        F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0))), lambda i: F.slice("w", i + 1, width))).alias("terms")
    ).distinct()
    cut = written(cut, "cut")
    windows = written(cut.select("terms").distinct().select(F.monotonically_increasing_id().alias("wid"), "terms"), "windows")
    items = written(join_known(cut, windows, ["terms"], MOST_TERMS).select("item_id", "wid"), "items")
    flat = windows.select("wid", F.posexplode("terms").alias("off", "term"))
    vocabulary = written(flat.select("term").distinct().select(F.monotonically_increasing_id().alias("term_id"), "term"), "vocabulary")
    return Queries(windows, written(join_known(flat, vocabulary, ["term"], MOST_TERMS).select("wid", "off", "term_id"), "terms"), items, vocabulary)


def index(docs: DataFrame) -> Index:
    """One narrow pass over the whole texts."""
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")  # before the rows are exploded
    exploded = numbered.select("rid", "doc_id", F.posexplode(F.concat(words(F.col("text")), F.array(F.lit("")))).alias("place", "term"))
    found = written(exploded.select("rid", F.when(F.col("term") == "", F.col("doc_id")).alias("doc_id"), "place", "term"), "postings")
    return Index(found.where("term <> ''").select("rid", "place", "term"), found.where("term = ''").select("rid", "doc_id", F.col("place").cast("long").alias("n_words")))


def ranked_terms(ix: Index, queries: Queries) -> DataFrame:
    """(wid, off, term_id, nth): the terms of each window by how few postings the corpus has, rarest first."""
    count = written(ix.lists.groupBy("term_id").agg(F.count(F.lit(1)).alias("n")), "counts")
    known = join_known(queries.terms, count, ["term_id"], MOST_TERMS, "left").select("wid", "off", "term_id", F.coalesce("n", F.lit(0)).alias("n"))
    order = Window.partitionBy("wid").orderBy("n", "off")
    return written(known.select("wid", "off", "term_id", "n", F.row_number().over(order).alias("nth")), "ranked")


def _anchors(ix: Index, ranked: DataFrame) -> DataFrame:
    """(rid, at, wid): where each window would start, by the postings of its rarest term."""
    dead = ranked.where("n = 0").select("wid").distinct()
    first = ranked.where("nth = 1").join(dead, "wid", "left_anti").select("term_id", "wid", "off")
    found = join_known(ix.lists, first, ["term_id"], MOST_TERMS)
    return found.select("rid", (F.col("place") - F.col("off")).alias("at"), "wid")


def phrases(ix: Index, queries: Queries) -> DataFrame:
    """(rid, at, wid) of every exact occurrence of every window; ix has the lists of these queries."""
    ranked = ranked_terms(ix, queries)
    found = written(_anchors(ix, ranked).where("at >= 0"), "anchors")
    for nth in range(2, EARLY + 2):
        own = ranked.where(F.col("nth") == nth).select("wid", "off", "term_id")
        lists = join_known(ix.lists, own.select("term_id").distinct(), ["term_id"], MOST_TERMS, "left_semi")
        own = broadcast_if(own, MOST_TERMS)
        short = found.join(own.select("wid"), "wid", "left_anti")
        asked = found.join(own, "wid").select("rid", "at", "wid", (F.col("at") + F.col("off")).alias("place"), "term_id")
        found = written(asked.join(lists, ["rid", "place", "term_id"], "left_semi").select("rid", "at", "wid").unionByName(short.select("rid", "at", "wid")), f"met{nth}")
    rest = ranked.where(F.col("nth") > EARLY + 1).select("wid", "off", "term_id")
    left = found.join(broadcast_if(rest.select("wid").distinct(), MOST_TERMS), "wid", "left_anti").select("rid", "at", "wid")
    rids = broadcast_if(written(found.select("rid").distinct(), "rids"), MOST_ROWS)
    lists = ix.lists.join(rids, "rid", "left_semi")
    asked = found.join(broadcast_if(rest, MOST_TERMS), "wid").select("rid", "at", "wid", (F.col("at") + F.col("off")).alias("place"), "term_id")
    met = asked.join(lists, ["rid", "place", "term_id"], "left_semi").groupBy("rid", "at", "wid").agg(F.count(F.lit(1)).alias("met"))
    need = rest.groupBy("wid").agg(F.count(F.lit(1)).alias("need"))
    whole = met.join(broadcast_if(need, MOST_TERMS), "wid").where("met = need").select("rid", "at", "wid")
    return written(whole.unionByName(left), "phrases")


def proximity(ix: Index, queries: Queries, slop: int) -> DataFrame:
    """(rid, wid): rows in which all terms of a window lie within its length plus slop places, in any order.

    Every span that holds all the terms holds the rarest one, so the spans are sought around its
    postings: for each place a span may begin, the number of different terms in it is counted.
    """
    ranked = ranked_terms(ix, queries)
    near = _anchors(ix, ranked).join(ranked.where("nth = 1").select("wid", "off"), "wid").select("rid", "wid", (F.col("at") + F.col("off")).alias("anchor"))
    size = ranked.groupBy("wid").agg(F.count(F.lit(1)).alias("span"), F.countDistinct("term_id").alias("need"))
    asked = near.join(size, "wid").join(ranked.select("wid", "term_id").distinct(), "wid")
    met = asked.join(ix.lists, ["rid", "term_id"]).where(F.abs(F.col("place") - F.col("anchor")) < F.col("span") + slop)
    first = met.groupBy("rid", "wid", "anchor", "span", "need").agg(F.collect_set(F.struct("place", "term_id")).alias("all"))
    spans = F.exists(
        "all",
        lambda a: F.size(F.array_distinct(F.transform(F.filter("all", lambda b: (b["place"] >= a["place"]) & (b["place"] < a["place"] + F.col("span") + slop)), lambda b: b["term_id"]))) == F.col("need")
    )
    return first.where(spans).select("rid", "wid").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs."""
    queries = queries_of(benchmark, width)
    ix = index(docs).of(queries)
    found = phrases(ix, queries)
    length = queries.terms.groupBy("wid").agg(F.count(F.lit(1)).cast("int").alias("len"))
    spans = found.join(broadcast_if(length, MOST_TERMS), "wid").select("rid", "at", (F.col("at") + F.col("len")).alias("end")).groupBy("rid", "at").agg(F.max("end").alias("end"))
    before = F.max("end").over(Window.partitionBy("rid").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    hit = spans.select("rid", F.greatest(F.col("end") - F.greatest("at", F.coalesce(before, F.lit(0))), F.lit(0)).alias("n")).groupBy("rid").agg(F.sum("n").alias("n_hit"))
    items = found.select("rid", "wid").distinct().join(broadcast_if(queries.items, MOST_TERMS), "wid").where("item_id IS NOT NULL").select("rid", F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy("rid").agg(F.count(F.lit(1)).alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("item"))).alias("ids"))
    out = ix.rows.join(hit, "rid", "left").join(items, "rid", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, with their columns.

    Contaminated rows are told by doc_id and the text's hash, so rows that share a doc_id are judged apart.
    """
    queries = queries_of(benchmark)
    digest = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    ix = index(docs.select(F.struct(F.col("doc_id"), digest.alias("h")).alias("doc_id"), "text")).of(queries)
    bad = ix.rows.join(phrases(ix, queries).select("rid").distinct(), "rid", "left_semi").select(F.col("doc_id.doc_id").alias("d"), F.col("doc_id.h").alias("h")).distinct()
    bad = broadcast_if(written(bad, "contaminated"), MOST_ROWS)
    same = docs["doc_id"].eqNullSafe(bad["d"]) & (digest == bad["h"])  # bad has no text
    return docs.join(bad, same, "left_anti").select(*map(col_of, docs.columns))
