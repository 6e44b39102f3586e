"""Every operator against brute force or an exact round trip, with nulls, empty and long texts, ties and repeats."""

import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.llm import common, dac, decontam, embed, jaccard, langid, packing, quality, sharding, tokens, urlfilter, warc
from rillflow.llm.queries import URL_RULES, tokenizer_path

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
TEXTS = [
    (1, "a b c d e f g"), (2, "A B c d e f G"), (3, None), (4, ""), (5, "only three words"), (6, "Only THREE  words\n"), (7, LONG), (7, LONG),
    (8, LONG + " tail"), (None, "x y z"), (9, "x y z")
]


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100).unionByName(own).withColumn("language", F.lit(1)).withColumn("fp", F.lit(2)).cache()


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_jaccard(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", lower(t))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    key = lambda r: tuple(str(x) for x in r)
    want = sorted((key((d, len(s), least.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets))))
    got = sorted(key((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard.near_duplicates(docs).collect())
    assert got == want
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    filled = len({find(i) for i, s in enumerate(sets) if s})
    assert kept.count() == filled + sum(not s for s in sets)


def test_jaccard_least_sets(spark):
    """Four shingles in five are 0.8 and link, also where chains or frequent shingles go through them; three in four don't."""
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(1, words("a", 8)), (2, words("a", 9)), (3, "z " + words("b", 8)), (4, words("b", 8)), (5, words("b", 8) + " y"), (6, words("c", 7)), (7, words("c", 8))]
    rows += [(10 + i, words("d", 8) + (f" e{i}" if i else "")) for i in range(100)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7} | {10 + i: 10 for i in range(100)}


def test_keep_first_repeated_ids(spark):
    """Rows of equal or null doc_id are told apart by component, not by doc_id."""
    rows = [
        (None, "a b c d e f"), (None, "g h i j k l"), (None, "g h i j k  L"), (None, ""), (None, None), (1, "m n o p q r"), (1, "s t u v w x"),
        (1, "s t u v w x"), (None, "s t u v w x"), (2, "m n o p q r"), (2, "only two"), (3, "")
    ]
    kept = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, "a b c d e f"), (None, "g h i j k l"), (None, ""), (None, None), (1, "m n o p q r"), (1, "s t u v w x"), (2, "only two"), (3, "")]
    assert sorted(str((r.doc_id, " ".join(r.text.lower().split()) if r.text else r.text)) for r in kept) == sorted(map(str, want))


def test_jaccard_prefixes_meet():
    """Any two similar sets share a key, whatever counts as common or frequent."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(4, 120))
        x = rng.choice(10**6, n, replace=False)
        y = np.concatenate([x[rng.random(n) > 0.11], rng.choice(10**6, int(rng.integers(0, n // 9 + 1))) + 10**7])
        both = len(set(x) & set(y))
        if 100 * both < 80 * (len(x) + len(y) - both) or set(x) == set(y):
            continue
        level = lambda h: (h % np.uint64(7) > 2).astype(np.int8) * 2
        keys = [set(np.concatenate(jaccard.prefix_keys(h, level(h), 80)).tolist()) for h in (np.sort(jaccard.mix(np.unique(s).astype(np.uint64))) for s in (x, y))]
        assert keys[0] & keys[1]


def test_jaccard_sketches_bound():
    """The bound of sizes and sketches is never below what two sets share, for random sets and for equal cut hashes."""
    rng = np.random.default_rng(5)
    pool = np.unique(np.concatenate([rng.integers(0, 1 << 64, 300, np.uint64), np.arange(40, dtype=np.uint64)]))
    sets = [np.sort(rng.choice(pool, int(rng.integers(0, 200)), replace=False)) for _ in range(40)]
    cut = [(x[x < 1 << 62] >> np.uint64(38)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes() for x in sets]
    sketches = [np.unique(jaccard._sketch(x)) for x in cut]
    assert all((jaccard._sketch(x)[:-1] <= jaccard._sketch(x)[1:]).all() for x in cut)
    rest = np.array([len(x) - len(s) for x, s in zip(sets, sketches)])
    most = jaccard._shared(sketches) + np.minimum(rest[:, None], rest[None, :])
    true = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    off = ~np.eye(len(sets), dtype=bool)
    assert (most >= true)[off].all()
    assert (jaccard._shared(sets) == true)[off].all()


def test_jaccard_only_asking_rows_move(spark):
    """Sketches are joined to rows with a partner left by label, size and earlier groups, and to no others; all pairs left are found."""
    sketch = lambda n: np.arange(n, dtype="<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    sizes = {1: 100, 2: 110, 3: 300, 4: 105, 5: 104}
    nodes = spark.createDataFrame([(fp, n, bytearray(sketch(n // 4)), "") for fp, n in sizes.items()], "fp long, n int, sketch binary, text string")
    kind = "key long, one int, two int, part int, fp long, label long, old boolean"
    groups = [(7, 0, 0, 0, 1, 1, True), (7, 0, 0, 0, 2, 2, False), (7, 0, 0, 0, 3, 3, False), (8, 0, 0, 0, 1, 1, True), (8, 0, 0, 0, 4, 4, True), (9, 0, 0, 0, 4, 4, False), (9, 0, 0, 0, 5, 4, False)]
    groups = spark.createDataFrame(groups, kind)
    assert sorted((r.key, r.fp) for r in jaccard._sketched(groups.withColumn("met", F.lit(None).cast("array<long>")), nodes, 80).collect()) == [(7, 1), (7, 2)]
    assert sorted((r.key, r.fp) for r in jaccard._screened(groups, nodes, 80).collect()) == [(7, 1), (7, 2)]
    open_ = spark.createDataFrame([(7, 1, 1, False), (7, 2, 2, False), (7, 4, 4, False), (7, 3, 3, False)], "key long, fp long, label long, old boolean")
    done = spark.createDataFrame([(1, 5), (2, 5), (2, 6), (4, 6)], "fp long, met long")
    assert [(r.u, r.v) for r in jaccard._never_compared(open_.drop("old"), done, nodes, 80).collect()] == [(1, 4)]


def test_jaccard_short_keys(docs):
    """Keys have 48 bits: the others are zero and cost nothing when shuffled."""
    keys = [r.key for r in jaccard._keys(docs, (np.zeros(0, np.uint64), np.zeros(0, bool)), 5, 80, 0).collect()]
    assert keys and all(x & 0xFFFF == 0 for x in keys) and len({x >> 16 for x in keys}) > 100


def test_written_leaves_no_shuffle(spark):
    """What was shuffled for a written table is removed at once, and the session's setting is as before."""
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {x.getName() for x in (lambda y: [y.apply(i) for i in range(y.size())])(folder.getAllFiles()) if x.getName().startswith("shuffle_")}
    before, setting = held(), spark.conf.get(common.CLEANUP)
    out = common.written(spark.range(1000).repartition(4, "id"), "test")
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before and out.count() == 1000 and spark.conf.get(common.CLEANUP) == setting


def test_decontamination(spark, docs):
    benchmark = spark.createDataFrame([(1, "c d e f g"), (2, None), (3, LONG[:200]), (4, "words"), (None, "x y z")], "item_id long, text string").unionByName(spark.read.parquet(f"{SF}/benchmark.parquet").withColumn("item_id", F.col("item_id") + 10))
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    windows = {}
    for r in benchmark.collect():
        w = words(r.text)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(r.item_id)
    want = []
    for r in docs.collect():
        w, hit, items = words(r.text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= found
        ids = sorted(str(x) for x in items if x is not None)
        want.append((str(r.doc_id), len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    got = [(str(r[0]), *r[1:]) for r in decontam.decontaminate(docs, benchmark).collect()]
    assert sorted(got) == sorted(want)
    assert decontam.keep_clean(docs, benchmark).count() == sum(not w[-1] for w in want)
    assert not decontam.decontaminate(docs, benchmark.where("false")).where("contaminated").count()


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "b x a y c"), (2, "a b c"), (3, "a q q q q q q b c")], "doc_id long, text string")
    queries = decontam.queries_of(spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    ix = decontam.index(docs).of(queries)
    near = decontam.proximity(ix, queries, 2).join(ix.rows, "rid")
    assert {r.doc_id for r in near.collect()} == {1, 2}


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + rng.standard_normal(16) * 0.08).tolist(), i % 2) for i in range(200)]
    rows += [
        (200, base[0].tolist(), 0), (201, base[0].tolist(), 0), (201, base[0].tolist(), 0), (202, None, 0), (203, [0.0] * 16, 0),
        (204, [float("nan")] + [1.0] * 15, 0), (205, base[0].tolist(), None), (206, [None] + [1.0] * 15, 1), (207, [1.0, 2.0], 1)
    ]
    got = embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("nid", F.lit(1))).collect()
    good = [(i, np.float32(v).astype(float) if v and None not in v else None, lab) for i, v, lab in rows]
    links = []
    for a, (i, x, p) in enumerate(good):
        n = 0
        for b, (j, y, q) in enumerate(good):
            if a != b and x is not None and y is not None and p is not None and p == q and len(x) == len(y) and np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any():
                n += x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98
        links.append((i, n))
    mine = sorted((r.vec_id, r.n_links) for r in got)
    assert sum(n for _, n in mine) >= 0.98 * sum(n for _, n in links)
    assert all(a[1] <= b[1] for a, b in zip(mine, sorted(links)))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_url_filter(spark):
    cases = {
        "http://A.Example.NET/en/x?q": ("allow", "example.net/en/"), "https://example.net/enx": ("block", "net/"),
        "http://notexample.com/de/": ("allow", None), "x://www.example.com/de/#": ("block", "example.com/de/"), "nothing": ("allow", None),
        "http://org/fr/": ("allow", "org/fr/"), "http://org": ("allow", None), "": ("allow", None)
    }
    got = urlfilter.judge(spark.createDataFrame([(u, "h") for u in [*cases, None]], "url string, host string"), URL_RULES).collect()
    assert {r.url: (r.verdict, r.rule) for r in got if r.url is not None} == cases
    assert [(r.host, r.path) for r in got if r.url is None] == [("", "")]


def test_warc(spark):
    big = "é<p>WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "x" * 3000
    rows = [
        (1, "http://a/", big), (2, "http://b c/\r\n", big), (3, None, None), (4, "http://d/", "short"), (5, "http://e/", "short"),
        (6, "http://f/", big), (6, "http://f/", big), (None, "u", big)
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = warc.write(pages, warc.fresh_path(spark, "test"))
    for block in (97, 1000, 1 << 20):
        got = warc.read(spark, folder, block).collect()
        assert len(got) == len(rows) and all(r.intact for r in got)
        assert sorted((str(r.page_id), r.type, r.refers_to) for r in got if r.payload_bytes > 999) == sorted([("1", "revisit", 6), ("2", "revisit", 6), ("6", "response", None), ("6", "response", None), ("None", "revisit", 6)], key=str)
        assert {bytes(r.payload) for r in got if r.type == "response"} == {big.encode(), b"", b"short"}


def test_warc_long_url(spark):
    """Headers of any length are read whole, wherever blocks end, and the records after them too."""
    urls = {1: "http://a/", 2: "http://b/" + " é" * 40_000, 3: "http://c/", 4: "http://d/WARC/1.1" + "d" * 300_000, 5: "http://e/"}
    pages = spark.createDataFrame([(i, u, f"page {i} WARC/1.1 " * 9_000) for i, u in urls.items()], "page_id long, url string, html string").coalesce(1)
    folder = warc.write(pages, warc.fresh_path(spark, "test"))
    for block in (50_000, 1 << 20):
        got = warc.read(spark, folder, block).collect()
        assert sorted((r.page_id, r.uri, r.intact) for r in got) == [(i, u.replace(" ", "%20"), True) for i, u in urls.items()]
        assert all(bytes(r.payload).decode() == f"page {r.page_id} WARC/1.1 " * 9_000 for r in got)


def test_tokens_and_packing(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = sorted(((r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    got = sorted(tokens.read(tokens.write(docs, tokenizer_path(), 2)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for d, _ in rows]
    assert sorted(r.ids_crc32 for r in got) == sorted(crc([*ids, 2]) for _, ids in rows)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()
    packed = packing.pack(docs, tokenizer_path(), 0, 256).collect()
    want = sorted(c for _, ids in rows for c in _crcs([*ids, 0], 256, crc))
    assert sorted(r.ids_crc32 for r in packed) == want
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 256
    assert len(bins) <= 1.08 * sum(r.length for r in packed) / 256 + 1


def _crcs(ids, size, crc):
    a, b = 0, len(ids) % size or min(len(ids), size)
    while a < len(ids):
        yield crc(ids[a:b])
        a, b = b, b + size


def test_random_access():
    ids = np.random.default_rng(1).integers(0, 2**26, 5000).astype(np.uint32)
    r = dac.Reader(dac.encode(ids, [3, None], np.array([0, 10, 5000])))
    assert (r.ids() == ids).all() and r.doc_ids == [3, None]
    assert [r.get(i) for i in range(0, 5000, 37)] == ids[::37].tolist()


def test_sharding(spark, docs):
    got = sharding.shuffle_to_shards(docs.select("doc_id", F.lit(0).alias("slot")), 8).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(s) for s in slots.values()]
    assert sum(sizes) == docs.count() and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    m = np.array(sharding.communication_matrix([10**9, 5, 10**10], 3, 1))
    assert m.sum(1).tolist() == [10**9, 5, 10**10] and max(m.sum(0)) - min(m.sum(0)) <= 1
    assert sharding.shuffle_to_shards(docs.select("doc_id").where("false"), 8).count() == 0


def test_quality(spark, docs):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    made = quality.featured(big)
    model = quality.train(made, labels)
    rows = made.select("doc_id", quality.held_out(F.col("doc_id")).alias("h"), quality.scorer(spark, model)("features").alias("s")).join(labels, "doc_id").where("h").collect()
    assert np.mean([(r.s >= 0.7) == (r.quality == 1) for r in rows]) > 0.97
    assert quality.keep_good(docs, labels.where("false")).count() == docs.count()


def test_language(spark, docs):
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {3, 4}
    pages = langid.identify_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    share = pages.select((F.col("language") == F.regexp_extract("html", 'lang="([a-z]+)"', 1)).cast("int").alias("x")).agg(F.avg("x")).first()[0]
    assert share > 0.95


def test_language_many(spark):
    """More languages than a block of tables holds, one of them in few rows of many: each row gets its own."""
    rng = np.random.default_rng(7)
    words = {f"{chr(97 + c // 26)}{chr(97 + c % 26)}": ["".join(chr(97 + x) for x in rng.integers(0, 26, 5)) for _ in range(30)] for c in range(90)}
    rows = [(c, " ".join(rng.choice(w, 30))) for c, w in words.items() for _ in range(3 if c == "dl" else 100)]
    docs = spark.createDataFrame([(i, t, c, f"s{i % 5}") for i, (c, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = langid.identify(docs, "doc_id", "text", F.col("lang"), F.col("source")).collect()
    assert len(got) == len(rows)
    assert all(r.language == r.text_language == r.lang and r.accepted for r in got)
