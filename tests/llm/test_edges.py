"""Edge cases of all operators and stages, and those whose result SQL can't express against plain recomputations."""

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rillflow.llm import bytetext, dac, decontam, embed, jaccard, langid, packing, quality, sharding, tokens, urlfilter, warc
from rillflow.llm.queries import QUERIES, URL_RULES, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = [
    "_text", "_host", "_declared", "_e", "_all", "_v", "_keep", "_found", "_quality_score", "_fingerprint", "_nth", "_label", "_d", "_h", "_f",
    "_row", "_part", "_random", "_rank", "_salt", "language", "confidence", "accepted", "fp", "label", "component", "rid", "place", "term", "wid",
    "features", "score", "y", "slot", "shard", "a.b", "row"
]
PROSE = [
    "the river runs along the old stone wall and the mill", "a quiet house stands near the green hill by the road",
    "every morning the baker opens the shop and sweeps the floor"
]


def clashing(df):
    """df with columns of names that an implementation might use for its own."""
    have = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES if c not in have])


def sample(spark, n=40):
    rows = [(i, " ".join(PROSE[(i + k) % 3] + f" {i * 7 + k}" for k in range(4 + i % 5)), "en", f"s{i % 3}", 0) for i in range(n)]
    rows += [(None, None, None, None, None), (None, "", "en", "s0", 0), (3, rows[3][1], "en", "s1", 0), (None, rows[5][1], "en", "s1", 0), (n, "x" * 300_000, "en", "s2", 0)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "a quiet house stands near the green hill by the road 7 every morning the baker opens"), (2, None), (3, "")], "item_id long, text string")


def test_clashing_columns(spark):
    """Columns of any name do no harm, and come back as they were where a result keeps them; the stages are tried in test_pipeline."""
    docs = clashing(sample(spark))
    shuffled = sharding.shuffle_to_shards(docs.drop("text"), 3).collect()
    assert len(shuffled) == 45 and all(r["_random"] == "own _random" for r in shuffled)
    found = urlfilter.judge(docs.withColumn("url", F.lit("http://example.net/en/")), URL_RULES).collect()
    assert all(r["_found"] == "own _found" and r["rule"] == "example.net/en/" for r in found)
    assert tokens.read(tokens.write(docs, tokenizer_path(), 2)).count() == 45
    vectors = clashing(spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in embed.near_duplicates(vectors).collect()} == {1: (1, 1), 2: (1, 1), 3: (0, 3)}
    pages = clashing(spark.createDataFrame([(1, "http://a.de/", "<html lang=de>das haus und der hund"), (2, None, None)], "page_id long, url string, html string"))
    assert warc.round_trip(pages).count() == 2
    assert langid.identify_pages(pages).where("`_text` = 'own _text' AND accepted").count() == 1


def test_empty_tables(spark, labels, benchmark):
    docs = sample(spark).where("false")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    made = quality.featured(docs)
    empty = [
        langid.identify_pages(pages), urlfilter.judge(pages, URL_RULES), warc.round_trip(pages), embed.near_duplicates(vectors), tokens.read(tokens.write(docs, tokenizer_path(), 2)), sharding.shuffle_to_shards(docs.select("doc_id"), 4),
        packing.pack(docs, tokenizer_path(), 0, 256), made.select(quality.scorer(spark, quality.train(made, labels))("features")),
        quality.keep_good(docs, labels), langid.keep_identified(docs), jaccard.keep_first(docs), decontam.keep_clean(docs, benchmark),
    ]
    assert [df.count() for df in empty] == [0] * len(empty)


def test_repeated_and_null_ids(spark):
    """Many rows of one id, or of none, are one set each; nothing grows with the square of their number."""
    rows = [(None, f"one two three four five {i % 4}") for i in range(3000)] + [(7, "six seven eight nine ten eleven")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = jaccard.near_duplicates(docs).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("component_id").alias("id")).collect()
    assert sorted((r.n, r.id) for r in got) == [(750, None)] * 4 + [(3000, 7)]


def test_words_of_equal_structure():
    """Words that a polynomial hash can't tell apart, and words of any length, have hashes of their own."""
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    words = [a, a.translate(str.maketrans("ab", "ba")), "ab", "ba", "aab", "x" * 63, "x" * 64, "x" * 65, "x" * 64 + "y", "y" + "x" * 64]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    assert len(set(bytetext.word_hashes(data, *bytetext.words(data, np.array([0, len(data)]))[:2]).tolist())) == len(words)
    upper = np.frombuffer(" ".join(words).upper().encode(), np.uint8)
    assert (bytetext.word_hashes(data, *bytetext.words(data, np.array([0, len(data)]))[:2]) == bytetext.word_hashes(upper, *bytetext.words(upper, np.array([0, len(data)]))[:2])).all()


def test_fingerprints_that_collide(spark, monkeypatch):
    """If two sets share a fingerprint, another seed tells them apart."""
    tried = []

    def sets(docs, k, seed):
        tried.append(seed)
        fp = 5 if seed == 0 else 6
        return spark.createDataFrame([(0, 1, 5, 1, 1), (0, 2, fp, 1, 2)], "kind byte, a long, b long, c int, d long")

    monkeypatch.setattr(jaccard, "_sets", sets)
    monkeypatch.setattr(jaccard, "_stars", lambda keys: (_ for _ in ()).throw(StopIteration))
    with pytest.raises((RuntimeError, StopIteration)):
        jaccard._near(sample(spark), 5, 80)
    assert tried == [0, 1]


def test_urls_as_brute_force():
    """The trie against a scan of all rules, with many rules under one host and partial last segments."""
    rng = np.random.default_rng(2)
    hosts = ["net", "a.net", "b.a.net", "org"]
    rules = [("block" if rng.random() < 0.5 else "allow", hosts[rng.integers(4)], "/" + "".join(rng.choice(list("ab/"), rng.integers(0, 5)))) for _ in range(300)]
    trie = urlfilter.UrlTrie(rules)
    for _ in range(2000):
        host = rng.choice(["x.", "", "b.", "xa."]) + hosts[rng.integers(4)]
        path = "/" + "".join(rng.choice(list("ab/"), rng.integers(0, 7)))
        fits = [(len(h) + len(p), v == "block") for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        found = trie.match(host, path)
        assert (found and (len(found[1]), found[0] == "block")) == max(fits, default=None)


def test_language_fusion(spark):
    """Posteriors recomputed row by row in plain Python from the same trigram model."""
    rng = np.random.default_rng(4)
    words = {c: ["".join(chr(97 + (x * 3 + 7 * k) % 26) for x in rng.integers(0, 12, 5)) for _ in range(12)] for k, c in enumerate(("aa", "bb", "cc"))}
    rows = []
    for i in range(240):
        c = ("aa", "bb", "cc")[i % 3]
        text = " ".join(rng.choice(words[c], 6)) if i % 17 else ("12 34" if i % 2 else None)
        rows.append((i, text, [c.upper() + "-X", None, "bb"][i % 3 if i % 5 else 1], [f"h{i % 4}.d{i % 2}.x", None][i % 11 == 0]))
    df = spark.createDataFrame(rows, "k long, t string, said string, host string")
    domain, suffix = F.element_at(F.split("host", r"\."), 2), F.lit("x")
    got = {r.k: r for r in langid.identify(df, "k", "t", F.col("said"), F.col("host"), domain, F.when(F.col("host").isNotNull(), suffix)).collect()}
    said = [re.split("[-_]", s.lower())[0] if s else None for _, _, s, _ in rows]
    model = langid.fit_text(df.select(F.col("k").alias("key"), F.col("t").alias("text"), F.lower(F.split("said", "-")[0]).alias("declared")), "key", "text", "declared")
    names = model.languages
    assert names == sorted({x for x in said if x})
    logs, fits = model.evidence(pa.array([t for _, t, _, _ in rows]))
    share = np.exp(logs - np.nanmax(logs, 1, keepdims=True, initial=-np.inf, where=~np.isnan(logs)))
    share /= share.sum(1, keepdims=True)
    sums = {}
    for (k, _, _, host), s, p in zip(rows, said, share):
        if not np.isnan(p).any():
            for key in ("all", ("host", host), ("domain", host and host.split(".")[1]), ("said", s), ("end", "x" if host else None)):
                if key == "all" or key[1] is not None:
                    sums[key] = sums.get(key, np.zeros(len(names))) + p
    top = (sums["all"] + 1) / (sums["all"].sum() + len(names))

    def conditional(kind, value):
        if (kind, value) not in sums:
            return np.zeros(len(names))
        seen = [v for k, v in sums.items() if k != "all" and k[0] == kind]
        return np.log((sums[kind, value] + 1) / (sum(seen) + len(seen) + 1))

    for n, ((k, _, _, host), s) in enumerate(zip(rows, said)):
        prior = np.log(top)
        if ("host", host) in sums and host:
            above = sums["domain", host.split(".")[1]]
            above = (above + langid.STRENGTH * top) / (above.sum() + langid.STRENGTH)
            prior = np.log((sums["host", host] + langid.STRENGTH * above) / (sums["host", host].sum() + langid.STRENGTH))
        every = (0 if np.isnan(logs[n]).any() else logs[n]) + prior + conditional("said", s) + conditional("end", "x" if host else None)
        sure = 1 / np.exp(every - every.max()).sum()
        assert got[k].language == names[int(every.argmax())] and abs(got[k].confidence - sure) < 1e-6
        assert got[k].accepted == bool(fits[n] and sure >= langid.LEAST_CONFIDENCE)


def test_language_never_learnt(spark):
    """Text of a script of which nothing was learnt isn't accepted; the input's own columns stay."""
    rows = [(i, PROSE[i % 3], "en", "s") for i in range(60)] + [(99, "это совсем другой язык и другая азбука", None, "s")]
    kept = langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("language", F.lit(1)).withColumn("accepted", F.lit("?"))).collect()
    assert sorted(r.doc_id for r in kept) == list(range(60))
    assert {(r.language, r.accepted) for r in kept} == {(1, "?")}


def test_shards(spark):
    """The query's columns against plain ones, equal chances of all shards and slots, and draws of the right law."""
    n, shards = 4000, 8
    df = spark.range(n).withColumn("text", F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.concat(F.lit("é"), F.col("id").cast("string")))).repartition(5)
    got = sharding.shuffle_to_shards(df, shards, 3).collect()
    where = {r.id: (r.shard, r.slot) for r in got}
    assert len(where) == n and {r.text for r in got if r.id % 3 == 0} == {"same"}
    counts = np.bincount([s for s, _ in where.values()], minlength=shards)
    assert counts.max() - counts.min() <= 1
    table = np.zeros((10, shards))
    for i, (s, _) in where.items():
        table[i * 10 // n, s] += 1
    expected = n / 10 / shards
    assert ((table - expected) ** 2 / expected).sum() < 120  # 79 degrees of freedom or fewer
    order = np.array([slot for _, (s, slot) in sorted(where.items()) if s == 0])
    assert abs(np.corrcoef(np.arange(len(order)), order)[0, 1]) < 0.15
    rng = np.random.default_rng(1)
    draws = [sharding.hypergeometric(rng, 6, 9, 5) for _ in range(20_000)]
    from math import comb

    want = np.array([comb(6, k) * comb(9, 5 - k) / comb(15, 5) for k in range(6)]) * len(draws)
    assert ((np.bincount(draws, minlength=6) - want) ** 2 / want).sum() < 25


def test_packing_small_cases():
    """Plans of a few pieces against the best of all partitions, and of many against the bound by their sum."""
    rng = np.random.default_rng(0)
    for _ in range(40):
        sizes = rng.integers(1, 17, int(rng.integers(1, 8))).tolist()

        def fits(bins, sizes=sizes):
            return any(all(sum(s for s, b in zip(sizes, way) if b == k) <= 16 for k in range(bins)) for way in itertools.product(range(bins), repeat=len(sizes)))

        best = next(b for b in range(1, len(sizes) + 1) if fits(b))
        histogram = {s: sizes.count(s) for s in sizes}
        made = packing.plan(histogram, 16)
        assert made.sequences <= best + (best > 2)
        room, seen = {}, {}
        for n, rank, count, first, offset in made.rows:
            seen.setdefault(n, set()).update(range(rank, rank + count))
            for k in range(count):
                room.setdefault(first + k, []).append((offset, n))
        assert {n: len(x) for n, x in seen.items()} == histogram
        for pieces in room.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at <= 16
    many = {int(n): int(c) for n, c in zip(*np.unique(rng.integers(300, 1500, 3000), return_counts=True))}
    made = packing.plan(many, 2048)
    assert made.sequences <= packing._plan(many, 2048, False).sequences
    assert made.sequences <= 1.02 * max(sum(n * c for n, c in many.items()) / 2048, sum(c for n, c in many.items() if n > 1024))


def test_program_prices():
    """The configuration of greatest price against all configurations."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes, prices = np.sort(rng.choice(np.arange(3, 20), 4, replace=False)), rng.random(4)
        best = max(float(np.dot(c, prices)) for c in itertools.product(range(8), repeat=4) if np.dot(c, sizes) <= 21)
        found = packing._priced(sizes, prices, 21)
        assert found @ sizes <= 21 and abs(found @ prices - best) < 1e-9


def test_scores_are_table_sums(spark, labels):
    """A score is the logistic function of the values that a plain walk over the bins finds; held-out labels change nothing."""
    docs = sample(spark)
    made = quality.featured(docs)
    model = quality.train(made, labels)
    score = made.select("features", quality.scorer(spark, model)("features").alias("s")).collect()
    for r in score:
        total = model.base
        for f, x in enumerate(r.features):
            total += model.tables[f][sum(e <= x for e in model.edges[f])]
        for a, b, ea, eb, table in model.pairs:
            total += table[sum(e <= r.features[a] for e in ea), sum(e <= r.features[b] for e in eb)]
        assert abs(r.s - 1 / (1 + np.exp(-total))) < 1e-9
    held = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(made, held)
    assert again.base == model.base and all((x == y).all() for x, y in zip(again.tables, model.tables))
    by_text = quality.train(docs.select("doc_id", "text"), labels)
    assert by_text.base == model.base and all((x == y).all() for x, y in zip(by_text.tables, model.tables))


def test_slices_by_rank():
    """Any stretch of ids is read through ranks alone, over block edges and levels of any number."""
    rng = np.random.default_rng(8)
    for top in (1, 200, 60_000, 2**31):
        ids = rng.integers(0, top, 3000).astype(np.uint32)
        ids[::7] = rng.integers(0, 256, len(ids[::7]))
        reader = dac.Reader(dac.encode(ids, [1], np.array([0, 3000])))
        for _ in range(200):
            a, b = sorted(rng.integers(0, 3001, 2).tolist())
            assert (reader.slice(a, b) == ids[a:b]).all()
    assert dac.Reader(dac.encode(np.zeros(0, np.uint32), [], np.array([0]))).ids().size == 0


def test_equal_ids_are_dealt_out(spark):
    """Rows of one id, or of none, whatever their texts, don't meet in one file's task; starts stay gapless."""
    docs = spark.createDataFrame([(None, None)] * 300 + [(1, "a b")] * 300, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little would be one part
    try:
        manifest = tokens.write(docs, tokenizer_path(), 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.where("n_docs > 0").select("part").distinct().count() > 2
    got = sorted(tokens.read(manifest).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert [r.doc_id for r in got] == [None] * 300 + [1] * 300
    assert got[0].ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes())


def test_index_is_asked_again(spark, benchmark):
    """One saved index answers several benchmarks; its postings are all words of the documents."""
    docs = sample(spark)
    folder = warc.fresh_path(spark, "index")
    decontam.index(docs).save(folder)
    ix = decontam.Index.load(spark, folder)
    words = sum(len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", r.text or "")) for r in docs.collect())
    assert ix.postings.count() == words == ix.rows.agg(F.sum("n_words")).first()[0]
    for b in (benchmark, spark.createDataFrame([(9, PROSE[1])], "item_id long, text string")):
        queries = decontam.queries_of(b)
        hit = decontam.phrases(ix.of(queries), queries).select("rid").distinct().count()
        windows = {" ".join(w[k : k + 10]) for r in b.collect() if (w := (r.text or "").split()) for k in range(max(1, len(w) - 9))}
        assert hit == sum(any(f" {w} " in f" {r.text} " for w in windows) for r in docs.collect()) > 0


def test_filters_hold_all_that_exceed():
    """decode() against scores of all directions, and bytes never hide a near pair."""
    rng = np.random.default_rng(3)
    x = embed._unit(rng.standard_normal((200, 16)).ravel(), 200)
    x[100:] = embed._unit((x[:100] + 0.02 * rng.standard_normal((100, 16))).ravel(), 100)
    for words in (4, 7):
        rows, filters = embed.decode(x, words)
        rotation, blocks = embed.code(16, words)
        turned = x @ rotation
        every = np.zeros((len(x), 1))
        for a, b, w in blocks:
            every = (every[:, :, None] + (turned[:, a:b] @ w.T)[:, None, :]).reshape(len(x), -1)
        from statistics import NormalDist

        alpha = NormalDist().inv_cdf(1 - min(0.5, embed.EXPECTED / words**4)) / np.sqrt(16)
        reach = np.minimum(alpha, np.sort(every, axis=1)[:, -embed.LEAST])
        want = [set(np.flatnonzero(e >= r - 1e-12).tolist()) for e, r in zip(every, reach)]
        assert [set(filters[rows == r].tolist()) for r in range(len(x))] == want
    near = x @ x.T >= 0.98
    assert not (near & ~embed._possible(embed._rounded(x), 0.98)).any()


def test_pipeline(spark, tmp_path, monkeypatch):
    """All stages on small tables, each against a plain recomputation of its decisions."""
    rng = np.random.default_rng(9)
    vocabulary = ["".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(200)]
    texts = [" ".join(rng.choice(vocabulary, 60)) for _ in range(60)]
    passage = " ".join(rng.choice(vocabulary, 14))
    texts[7] = texts[3] + " tail"
    texts[8] = texts[3]
    texts[11] = f"{texts[11]} {passage} end"
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)] + [
        (70, "$$$ ### | | | 123", "en", "s1", 3), (None, texts[20], "en", "s0", 1), (None, " ".join(rng.choice(vocabulary, 50)), "en", "s0", 1),
        (5, texts[5], "en", "s2", 1), (71, None, "en", "s1", 0), (72, "", None, None, 0)
    ]
    clashing(spark.createDataFrame(rows, DOCS)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(70, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, columns = {}, spark.read.parquet(f"{tmp_path}/documents.parquet").columns

    def recorded(name, stage):
        def run(spark, docs, sf_dir):
            out = stage(spark, docs, sf_dir)
            assert name == "packing" or out.columns == columns, name
            out.write.parquet(f"{tmp_path}/out-{name}")
            out = spark.read.parquet(f"{tmp_path}/out-{name}")
            kept[name] = [r.asDict() for r in out.collect()]
            return out

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, recorded(name, stage)) for name, stage in corpus_pipeline.STAGES])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["packing"])
    assert all(r[c] == f"own {c}" for r in kept["decontamination"] for c in CLASHES)
    of = lambda name: sorted((str(r["doc_id"]), str(r["text"])) for r in kept[name])
    assert {(r["doc_id"], r["text"]) for r in kept["quality"]} >= {(i, t) for i, t in enumerate(texts)}
    assert {r["doc_id"] for r in kept["language"] if r["doc_id"] is not None} >= set(range(60)) and not [r for r in kept["language"] if not r["text"]]
    sets, want = {}, []
    for r in sorted(kept["language"], key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)):
        words = r["text"].lower().split()
        own = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
        if not any(5 * len(own & s) >= 4 * len(own | s) for s in sets.values()):
            want.append((str(r["doc_id"]), r["text"]))
        sets[len(sets)] = own
    assert of("near_copies") == sorted(want)
    assert of("decontamination") == [x for x in of("near_copies") if passage not in x[1]] and len(of("near_copies")) - len(of("decontamination")) == 1
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    crc = lambda ids: zlib.crc32(np.array([*ids, 0], "<u4").tobytes())
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in kept["packing"]) == sorted((d, crc(t.encode(x, add_special_tokens=False).ids)) for d, x in of("decontamination"))


def test_every_query_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))
