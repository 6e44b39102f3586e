"""One query for each operator, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embed, jaccard, langid, packing, quality, sharding, tokens, urlfilter, warc
from .common import ship

TOKENIZER = "byte_bpe_50k.json"
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "language", F.round("confidence", 6).alias("confidence"), "text_language", "accepted")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("intact")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read(tokens.write(table(spark, sf_dir, "documents"), tokenizer_path(), 2))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"))
    return sharding.shuffle_to_shards(rows, 8).select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), 0, 2048)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality.featured(table(spark, sf_dir, "documents"))
    model = quality.train(made, table(spark, sf_dir, "labels"))
    scored = made.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), quality.scorer(spark, model)("features").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


SLOP = 5


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the benchmark whose words all lie close to one another in a document, in any order."""
    queries = decontam.queries_of(table(spark, sf_dir, "benchmark"))
    ix = decontam.index(table(spark, sf_dir, "documents")).of(queries)
    near = decontam.proximity(ix, queries, SLOP).groupBy("rid").agg(F.count(F.lit(1)).alias("n"))
    return ix.rows.join(near, "rid", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_near"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_url_filter, op3_warc, op4_ngram_jaccard, op5_embedding_near_dedup, op6_decontamination, op7_token_codes,
        op8_sharding, op9_packing, op10_quality, benchmark_proximity,
    )
}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = {
    "op2_url_filter": rf"""
        WITH parts AS (
            SELECT page_id, {LOWER.format("coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '')")} AS host,
                coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        ruled AS (
            SELECT *, CASE
                WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
            FROM parts)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled""",
    "op3_warc": """
        WITH rows AS (
            SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        firsts AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM rows)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id < first THEN first END AS refers_to
        FROM firsts""",
    "op6_decontamination": rf"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
        i AS (
            SELECT item_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, array_to_string(w[k + 1 : k + 10], ' ') AS phrase, least(len(w), 10) AS n
            FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS k FROM i WHERE len(w) > 0)),
        grams AS (
            SELECT doc_id, k, n, array_to_string(w[k + 1 : k + n], ' ') AS phrase
            FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM windows))),
        hits AS (SELECT doc_id, k, n, item_id FROM grams JOIN windows USING (phrase, n)),
        places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "benchmark_proximity": rf"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
        i AS (
            SELECT list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
        windows AS (SELECT row_number() OVER () AS wid, t FROM (
            SELECT DISTINCT w[k + 1 : k + 10] AS t FROM (SELECT w, unnest(range(0, greatest(len(w) - 9, 1))) AS k FROM i WHERE len(w) > 0))),
        terms AS (SELECT DISTINCT wid, len(t) + {SLOP} AS span, len(list_distinct(t)) AS need, unnest(t) AS term FROM windows),
        places AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS p FROM d),
        met AS (SELECT doc_id, p, wid, span, need, term FROM places JOIN terms USING (term)),
        whole AS (SELECT doc_id, wid FROM met GROUP BY doc_id, wid, need HAVING count(DISTINCT term) = need),
        close AS (SELECT m.* FROM met m JOIN whole USING (doc_id, wid)),
        spans AS (
            SELECT a.doc_id, a.wid FROM close a JOIN close b ON a.doc_id = b.doc_id AND a.wid = b.wid AND b.p >= a.p AND b.p < a.p + a.span
            GROUP BY a.doc_id, a.wid, a.p, a.need HAVING count(DISTINCT b.term) = a.need),
        counts AS (SELECT doc_id, count(DISTINCT wid) AS n FROM spans GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_near FROM d LEFT JOIN counts USING (doc_id)""",
    "op4_ngram_jaccard": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + 5], ' ') AS shingle
            FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS k FROM d WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
            FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (
            SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * common >= 80 * (a.n + b.n - common)),
        reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
        least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id
        FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of ON x = d.doc_id""",
    "op5_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        good AS (
            SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
        least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x), counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id, vec_id <= coalesce(y, vec_id) AS kept
        FROM v LEFT JOIN counts ON counts.x = vec_id LEFT JOIN least_of ON least_of.x = vec_id""",
}
