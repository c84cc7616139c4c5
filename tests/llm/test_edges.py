"""Nulls, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from taskloom.llm import chat, decontamination, language, licenses, minhash, mixing, neighbours, secrets, shared, suffix_dedup, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rk long, cid long, key double, a string, b string, size string, score string, window string, raw string, p string"
LONG = " ".join(f"word{i % 977} other{i % 1013}" for i in range(60_000))


def made(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, *["x" if k in (3, 4, 5, 6, 7, 8, 9) else None for k in range(10)]) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    base = " ".join(f"w{i}" for i in range(100))
    return made(spark, [(1, None, "en", "s"), (2, "", None, None), (3, "   \n\t", "en", "s"), (4, LONG, "en", "s"), (5, LONG, None, "s"), (6, base, "en", "t"), (6, base, "en", "t"), (7, base + " x", None, None), (None, base, "fr", "t"), (9, "123 456", "en", "s"), (10, "ß漢字 été", "fr", None), (11, "one", "en", "")])


@pytest.fixture(scope="module")
def empty(spark):
    return made(spark, [])


def test_near_duplicates(spark, odd, empty):
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.component_id if r.component_id is not None else -1, r.kept, r.n_shingles) for r in minhash.near_duplicates(odd, k=2).collect()))
    assert [g[:3] for g in got] == [(-1, -1, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (6, -1, False), (6, -1, False), (7, -1, False), (9, 9, True), (10, 10, True), (11, 11, True)]
    assert [g[3] for g in got if g[0] in (1, 2, 3, 9, 11)] == [0, 0, 0, 1, 1]
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_large_group(spark):
    """A group in which some reach the threshold with a hub and some only with each other: links as by brute force."""
    rng = np.random.default_rng(3)
    core = [f"c{i}" for i in range(60)]
    texts = []
    for i in range(120):
        w = list(core)
        for j in rng.choice(60, rng.integers(0, 12), replace=False):
            w[j] = f"e{i}_{j}" if i % 3 else f"e{i // 9}_{j}"
        texts.append(" ".join(w))
    from .test_queries import components

    _, want = components(texts, 2)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(d, k=2, group=4).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_near_duplicates_clusters_around_one_hub(spark):
    """10,000 documents in clusters that share passages with a common middle, some apart from it and from one another: every link between clusters is found."""
    rng = np.random.default_rng(12)
    middle = [f"m{i}" for i in range(200)]
    texts, cluster = [], []
    for c in range(5):
        own = list(middle)
        for j in range(c * 40, c * 40 + 32 * (c > 0)):  # cluster 0 is the middle; 32 words of 200 apart is under 0.8 for two-word shingles from a third cluster on
            own[j % 200] = f"c{c}_{j}"
        for _ in range(2_000):
            w = list(own)
            for j in rng.choice(200, rng.integers(0, 6), replace=False):
                w[j] = f"e{rng.integers(1 << 40)}"
            texts.append(" ".join(w))
            cluster.append(c)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(d, k=2).collect()}
    sets = [{(a, b) for a, b in zip(w, w[1:])} for w in map(str.split, texts)]

    def linked(i, j):
        both = len(sets[i] & sets[j])
        return 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)

    # A component holds what is linked: each member with some other one, and no two components with a link among 100 of each cluster.
    some = [i for c in range(5) for i in [k for k in range(len(texts)) if cluster[k] == c][:100]]
    for x, i in enumerate(some):
        for j in some[:x]:
            if linked(i, j):
                assert got[i] == got[j]
    assert 1 < len({got[i] for i in some}) < len(some)


@pytest.mark.parametrize("in_one", [0, 1000])
def test_components(spark, in_one):
    chain = [(i, i + 1) for i in range(40)] + [(100, 300), (300, 200), (500, 500), (None, 7)]
    got = {r.node: r.component for r in shared.connected_components(spark.createDataFrame(chain, "a long, b long"), in_one).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {300: 100, 200: 100}
    assert shared.connected_components(spark.createDataFrame([], "a long, b long"), in_one).count() == 0


def test_suffix_dedup(spark, odd, empty):
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(odd).collect()}
    assert len(got[4].kept) == len(got[5].kept) == 0 and got[1].n_bytes == 0 and bytes(got[11].kept) == b"one"
    assert None in got and suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("depth", [1, 2, 3, 7, 15, 16, 20, 31, 33])
def test_suffix_dedup_small_depths(spark, depth):
    rng = np.random.default_rng(depth)
    texts = ["".join(rng.choice(list("ab" if depth > 6 else "abcdefghij"), rng.integers(0, 60))) for _ in range(12)] + ["a" * 50, "xyzxyzxyz" * 6]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.a, s.b) for s in r.spans] for r in suffix_dedup.remove_repeats(d, depth=depth).collect()}
    assert [got[i] for i in range(len(texts))] == [w[0] for w in suffix_dedup.brute_force([t.encode() for t in texts], depth)]


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_random(spark, seed):
    rng = np.random.default_rng(seed)
    parts = ["".join(rng.choice(list("ab"), 120)) for _ in range(6)] + ["a" * 90, "é" * 40]
    texts = ["".join(rng.choice(parts, rng.integers(0, 6))) + str(rng.integers(0, 3)) for _ in range(25)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.a, s.b) for s in r.spans] for r in suffix_dedup.remove_repeats(d, depth=60).collect()}
    want = suffix_dedup.brute_force([t.encode() for t in texts], 60)
    assert [got[i] for i in range(len(texts))] == [w[0] for w in want]


def equal_hashes(places, size=2048):
    """For each of 128 places a byte for either text, so that both texts have the same polynomial hash: pairs of lists are joined on their lowest bits, 10 more each time."""
    rng = np.random.default_rng(5)
    factor = suffix_dedup.Rolling().table, np.cumprod(np.r_[np.uint64(1), np.full(places[-1], suffix_dedup.BASE, np.uint64)], dtype=np.uint64)
    lists = []
    for i in places:
        a, more = rng.integers(0, [[94], [93]], (2, size))
        a, b = 33 + a, 33 + (a + 1 + more) % 94
        lists.append(((factor[0][a] - factor[0][b]) * factor[1][i], np.stack([a, b], 1)[:, None]))
    bits = 0
    while len(lists) > 1:
        bits, joined = min(bits + 10, 64), []
        for (x, u), (y, v) in zip(lists[::2], lists[1::2], strict=True):
            low = np.uint64((1 << bits) - 1)
            order = np.argsort(-y & low)
            first, last = (np.searchsorted((-y & low)[order], x & low, side) for side in ("left", "right"))
            own = np.repeat(np.arange(len(x)), last - first)
            other = order[np.arange(len(own)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[own]]
            some = rng.permutation(len(own))[:size]
            joined.append((x[own[some]] + y[other[some]], np.concatenate([u[own[some]], v[other[some]]], 1)))
        lists = joined
    return lists[0][1][0].T


def test_suffix_dedup_texts_of_equal_hashes(spark):
    """Texts of one polynomial hash are no repeats, whether a run's context or a single window has that hash; real repeats beside them still go."""
    places = np.arange(230, 358)
    pair = equal_hashes(places)
    texts = []
    for seed in range(60):  # where the synchronising position falls depends on what is before; in some the hash covers all places or none
        head = np.random.default_rng(seed).integers(97, 123, 400)
        for x in (0, 1):
            head[places] = pair[x]
            texts.append(bytes(head.astype(np.uint8)).decode() + str(x) * (seed % 3))
        texts += [f"{seed} {seed} " + texts[-1][::-1]] * (seed % 2 + 1)
    roll, hashes = suffix_dedup.Rolling(), []
    for t in texts[:2]:
        roll.load(np.frombuffer(t.encode(), np.uint8))
        hashes.append(roll.of(np.array([0]), np.array([400]))[0])
    assert hashes[0] == hashes[1] and texts[0] != texts[1]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.a, s.b) for s in r.spans] for r in suffix_dedup.remove_repeats(d).collect()}
    want = suffix_dedup.brute_force([t.encode() for t in texts], 400)
    assert [got[i] for i in range(len(texts))] == [w[0] for w in want]


def test_contamination(spark, odd, empty):
    b = spark.createDataFrame([(1, "w1 W2 w3"), (2, None), (3, " ".join(f"w{i}" for i in range(20))), (3, "absent words only"), (None, "one")], "item_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in decontamination.find_contamination(odd, b).collect()}
    assert got[6, 100].n_hit == 20 and got[6, 100]["items"] == ["1", "3"] and got[7, 101].contaminated
    assert got[11, 1].n_hit == 1 and got[11, 1]["items"] == [] and not got[1, 0].contaminated
    assert decontamination.find_contamination(empty, b).count() == 0
    assert decontamination.find_contamination(odd, b.limit(0)).where("contaminated").count() == 0
    assert decontamination.find_contamination(odd, b).count() == odd.count()


def test_contamination_in_blocks(spark, odd, monkeypatch):
    b = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2}") for i in range(30)], "item_id long, text string")
    want = sorted(map(str, decontamination.find_contamination(odd, b).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 300)
    assert sorted(map(str, decontamination.find_contamination(odd, b).collect())) == want


def test_mixing(spark, odd, empty):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == odd.count() and all(r.taken <= 2 * r.size for r in got)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
    assert mixing.mix_sources(empty).count() == 0
    some = made(spark, [(i, "a b c d", "en", f"s{i % 3}") for i in range(200)])
    a, b, c = (sorted(map(tuple, mixing.mix_sources(some, rows_a_bucket=n).collect())) for n in (10, 10_000, None))
    assert a == b == c


def test_secrets(spark, odd, empty):
    t = [(1, "password: hunter22"), (2, "token:secret:longvalue123"), (3, "AKIA" + "A" * 12 + " AKIA123"), (4, "f" * 31 + " " + "0" * 32), (5, "x9Qz7LkP2mWv4TrB8nYc id sha256-9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08 user_account_id_2024_backup_table"), (6, "paſsword=12345678 toKen=12345678"), (7, None)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.find_secrets(spark.createDataFrame(t, "doc_id long, text string")).collect()}
    assert got[1] == [("assign", 0, 18)] and got[2] == [] and got[3] == [("access", 0, 16)] and got[4] == [("hex", 32, 64)] and got[6] == [] and got[7] == []
    assert ("random", 0, 20) in got[5] and sum(s[0] == "random" for s in got[5]) == 1
    r = secrets.redacted(spark.createDataFrame([(1, "a password: hunter22 b", 0), (2, None, 5)], "doc_id long, text string, n_chars long")).orderBy("doc_id").collect()
    assert [tuple(x) for x in r] == [(1, "a [secret] b", 12), (2, None, 5)]
    assert secrets.find_secrets(odd).count() == odd.count() and secrets.find_secrets(empty).count() == 0


@pytest.mark.parametrize("alphabet, size", [("abcdefghijklmnopqrstuvwxyz234567", 20), ("abcdefghijklmnopqrstuvwxyz234567", 32), ("abcdefghijklmnopqrstuvwxyz0123456789", 20), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 26), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 24), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20)])
def test_secrets_random_strings(alphabet, size):
    """Random strings of any case, with digits or without, are found wherever the ratio says so; names are not."""
    rng = np.random.default_rng(size)
    encoding = secrets.vocabulary(secrets.read_ranks(secrets.VOCABULARY))
    for _ in range(300):
        s = "".join(rng.choice(list(alphabet), size))
        want = [(0, 3, size)] if len(s) < 2 * len(encoding.encode_ordinary(s)) else []
        assert secrets.spans_of(s, 2.0, lambda: encoding) == want or secrets.base_spans(s)


def test_secrets_names():
    encoding = secrets.vocabulary(secrets.read_ranks(secrets.VOCABULARY))
    names = "EXSLT_DYNAMIC_NAMESPACE HAVE_CURSES_RESIZETERM /usr/lib/x86_64-linux-gnu/libc.so.6 ERR_CRYPTO_JWK_UNSUPPORTED_CURVE getElementsByClassName2024 2024-01-02/2025-03-04"
    assert secrets.spans_of(names, 2.0, lambda: encoding) == []


def test_language(spark, odd, empty):
    model = language.train(odd)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == got[9] == ("und", 0.0) and got[6][0] in model.langs
    none = language.train(empty)
    assert none.langs == [] and language.identify(odd, none).where("lang_pred <> 'und'").count() == 0
    assert language.identify(empty, model).count() == 0


def test_licenses(spark, odd, empty):
    d = spark.createDataFrame([(1, "x.\nReleased under the MIT License.\ny"), (2, "a license to drive"), (3, None), (4, "one.\n\nLicensed under the Apache\n License,  \nVersion 2.0.\ntwo")], "doc_id long, text string")
    got = {r.doc_id: [(p.paragraph, p.family) for p in r.paragraphs if p.confirmed] for r in licenses.scan_licenses(d).collect()}
    assert got == {1: [(1, "MIT")], 2: [], 3: [], 4: [(2, "APACHE")]}
    assert licenses.scan_licenses(odd).count() == odd.count() and licenses.scan_licenses(empty).count() == 0


def test_url_filters(spark):
    rows = [
        (1, "http://a.net/x", '<link rel="canonical" href="/y">'), (2, "http://a.net/y#f", '<meta http-equiv="refresh" content="0; url=http://b.com/de/1">'), (3, "HTTP://B.COM/de/2?q", None), (4, None, "x"), (5, "no scheme", ""),
        (6, "http://c.net/1", '<link rel=canonical href="//d.com/fr/9"><meta http-equiv=refresh content="0;url=http://b.com/de/1">'), (7, "http://xexample.org/es/", ""), (8, "http://w.example.org/es/1", ""), (1, "http://a.net/x", '<link rel="canonical" href="/y">'),
    ]
    p = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, node string, component string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(p).collect()}
    assert got[1] == ("a.net", "/x", None, "allow") and got[6][3] == "allow"  # all one class, and d.com/fr/9 in it is allowed
    assert got[3] == ("b.com", "/de/2", "com/de/", "block") and got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow")
    assert got[7][2] == "org/" and got[8][2:] == ("example.org/es/", "block")
    alone = {r.page_id: r.verdict for r in url_filters.filter_urls(p.where("page_id < 3")).collect()}
    assert alone == {1: "block", 2: "block"}
    more = spark.createDataFrame([("no scheme", "http://b.com/de/5")], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in url_filters.filter_urls(p.where("page_id = 5"), more).collect()} == {5: "block"}
    assert url_filters.filter_urls(p.limit(0)).count() == 0


def test_neighbours(spark):
    v = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [float("inf"), 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (2, [2.0, 0.0]), (40, [])]
    d = spark.createDataFrame([(i, e, "x") for i, e in v], "vec_id long, embedding array<float>, cid string")
    got = sorted(tuple(r) for r in neighbours.search(d, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 2, 2.0), (0, 2, 8, 1.0), (0, 3, 20, 1.0), (0, 4, 1, 0.5), (20, 1, 2, 2.0), (20, 2, 0, 1.0), (20, 3, 8, 1.0), (20, 4, 1, 0.5)]
    assert neighbours.search(d.limit(0), F.lit(True)).count() == 0
    twice = d.unionByName(spark.createDataFrame([(2, [3.0, 0.0], "x"), (20, [0.0, 9.0], "x")], d.schema))  # of several vectors the first in order counts
    assert sorted(tuple(r) for r in neighbours.search(twice, F.col("vec_id") % 20 == 0).collect()) == [(0, 1, 2, 2.0), (0, 2, 8, 1.0), (0, 3, 1, 0.5), (0, 4, 20, 0.0), (20, 1, 1, 4.5), (20, 2, 0, 0.0), (20, 3, 2, 0.0), (20, 4, 8, 0.0)]
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(100)], "vec_id long, embedding array<double>")
    ties = [r.vec_id for r in neighbours.search(same, F.col("vec_id") == 5).orderBy("rank").collect()]
    assert ties == [i for i in range(21) if i != 5]


def test_chat(spark):
    d = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.rendered(chat.reconstruct(chat.turn_events(d)))).count() == 0
    d = spark.createDataFrame([(None, 0, None, None), (1, 0, "assistant", LONG), (1, 0, "assistant", LONG)], d.schema)
    got = {r.conv_id: r for r in chat.read_back(chat.rendered(chat.reconstruct(chat.turn_events(d)))).collect()}
    assert got[None].n_turns == 1 and got[1].n_turns == 2 and got[1].loss_chars == 2 * len(LONG)


def test_pipeline_stages(spark, odd, empty, tmp_path):
    spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd.unionByName(made(spark, [(20, "token = abcdefgh1 is said", "en", "u")]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = shared.written(stage(spark, docs, str(tmp_path)))
        assert out.schema.simpleString() == docs.schema.simpleString()
        ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in out.select("doc_id").collect())
        if name == "language_id":
            assert not {1, 2, 3, 9} & set(ids)
        if name == "near_dedup":
            assert len(ids) == len(set(ids)) and not {5, 6, 7} & set(ids)
        if name == "decontamination":
            assert -1 not in ids and 4 in ids
        if name == "secret_scan":
            assert out.where("doc_id = 20").first().text == "[secret] is said"
        assert stage(spark, empty, str(tmp_path)).count() == 0
        docs = out
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert mixed.count() > 0 and corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0


def test_pipeline_drops_unlearned_languages(spark):
    """Texts of languages that no label names, and gibberish of letters, go; all documents of the tables with letters stay."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = np.random.default_rng(4)
    other = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. " * 5,
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem. " * 5,
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью. " * 5,
        "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。" * 5,
        " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(100)),
    ]
    first = docs.first().asDict()
    more = spark.createDataFrame([tuple((first | {"doc_id": -i - 1, "text": t, "lang": None}).values()) for i, t in enumerate(other)], docs.schema)
    left = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(more), sf).select("doc_id").collect()}
    assert left == {r.doc_id for r in docs.select("doc_id", "text").collect() if any(c.isalpha() for c in r.text or "")}


def test_pipeline_run(spark):
    """run() against its stages by brute force, on the smallest tables: every row and every number."""
    import duckdb

    from .test_queries import components

    sf = "/root/testdata/sf0.001"
    made = len(shared.MADE)
    got = corpus_pipeline.run(spark, sf)
    assert len(shared.MADE) <= made + len(corpus_pipeline.STAGES)  # tables of stages that are done are gone
    got = got.toPandas().sort_values("doc_id").reset_index(drop=True)
    d = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{sf}/documents.parquet' ORDER BY doc_id").df()
    d = d[d.text.map(lambda t: any(c.isalpha() for c in t or ""))].reset_index(drop=True)
    _, found = components(d.text, 5)
    d = d[[i == c for i, c in enumerate(found)]]
    con = duckdb.connect()
    con.register("documents", d)
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
    con.execute(f"CREATE VIEW labels AS SELECT * FROM '{sf}/labels.parquet'")
    dirty = set(con.execute(f"SELECT doc_id FROM ({decontamination.SQL}) WHERE contaminated").df().doc_id)
    left = d[~d.doc_id.isin(dirty)].reset_index(drop=True)
    encoding = secrets.vocabulary(secrets.read_ranks(secrets.VOCABULARY))
    left["text"] = [secrets.cut(t, [(a, b) for a, _, b in secrets.spans_of(t, 2.0, lambda: encoding)], "[secret]") for t in left.text]
    con.unregister("documents")
    con.register("documents", left)
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL}) WHERE taken > 0 ORDER BY doc_id").df()
    assert got.doc_id.tolist() == want.doc_id.tolist()
    for c in ("size", "source_size", "taken"):
        assert (got[c] == want[c]).all()
    assert np.allclose(got.target, want.target)


def test_language_learns_from_all_documents(spark):
    """No sample: every labelled document that is not held out trains; counts of many runs at once are those of each."""
    import numpy as np

    from taskloom.llm import language

    n = 15_000
    d = spark.range(n).selectExpr("id AS doc_id", "concat('word ', id) AS text", "if(id % 5 = 0, null, 'en') AS lang")
    assert language.training(d).count() == d.where("lang IS NOT NULL").where(~language.held_out(d.doc_id)).count() > 8_500
    names = language.pieces(language.VOCABULARY)[:9000]
    model = language.Unigrams(["a", "b"], {p: np.array([1e-5 * (i % 7 + 1), 1e-5 * (i % 11 + 1)]) for i, p in enumerate(names)})
    runs, times = ["banana", "x", "ñandú", "Ж", "abcabcabcabc" * 2], [3, 1, 2, 5, 1]
    scorer, want = language.Scorer(model), {}
    for run, k in zip(runs, times, strict=True):
        for piece, e in model.expected(run, 1).items():
            want[piece] = want.get(piece, 0) + k * e
    got = scorer.counts(runs, times, 1, False)
    assert {names[i] for i in np.flatnonzero(got)} == set(want) and all(np.isclose(got[scorer.place[p]], e) for p, e in want.items())


def test_language_words_are_looked_at_once(spark, monkeypatch):
    """Runs are looked for once in each word that a worker keeps, in training and in prediction, and are those of whole texts, also where what is kept is given up."""
    import re
    from collections import Counter

    import numpy as np
    import pandas as pd

    class Counting:
        asked = 0

        def findall(self, x):
            Counting.asked += 1
            return re.findall(r"[^\W\d_]+", x)

    text = "Ab-c d_e ab-C f1g ΣΑΣ x²y 漢字。漢 " * 40
    monkeypatch.setattr(language, "LETTERS", Counting())
    got = language.runs_of(Counter(text.lower().split()))
    assert got == Counter(re.findall(r"[^\W\d_]+", text.lower())) and Counting.asked == len(set(text.lower().split()))
    model = language.Unigrams(["x", "y"], {p: np.array(v) for p, v in {"▁ab": (0.3, 0.1), "c": (0.1, 0.2), "d": (0.2, 0.1), "漢": (0.1, 0.3)}.items()})
    batches = [pd.Series([text, None, "12 _ !", "c d"]), pd.Series(["d c", "", text[:60]])]
    judged = []
    for kept in (10**6, 3):
        monkeypatch.setattr(language, "CACHE", kept)
        Counting.asked = 0
        judged.append(pd.concat(language.predictor(spark, model).func(iter(batches)), ignore_index=True))
        if kept > 3:
            assert Counting.asked == len(set(" ".join(x or "" for b in batches for x in b).lower().split()))
    assert judged[0].equals(judged[1])
    scores = language.Scorer(model).log_probabilities([r for r in re.findall(r"[^\W\d_]+", text.lower())]).sum(axis=0)
    assert judged[0].lang_pred.tolist()[:3] == ["xy"[int(scores.argmax())], "und", "und"] and np.isclose(judged[0]["mean"][0], scores.max() / len("".join(re.findall(r"[^\W\d_]+", text.lower()))))
