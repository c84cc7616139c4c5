"""Operator 13 against its formula in plain Python, and its parts on made bits."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from taskloom.llm import ranked


def plain(docs, items, k):
    """Rows (item, rank, doc_id, score) by the formula."""
    cut = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    terms = [Counter(cut(t)) for _, t in docs]
    n_docs, length = sum(map(bool, terms)), sum(sum(c.values()) for c in terms)
    df = Counter(t for c in terms for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc_id, _), c in zip(docs, terms):
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(cut(text)) if t in c)
            if s > 0:
                found.append((-s, doc_id is not None, doc_id or 0, doc_id))
        out += [(item, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found)[:k])]
    return out


def frame(spark, rows, name):
    d = pd.DataFrame([(i, t, 1, "x", "y") for i, t in rows], columns=[name, "text", "n", "terms", "row"])
    d[name] = d[name].astype("Int64")
    return spark.createDataFrame([(None if pd.isna(a) else int(a), *b) for a, *b in d.itertuples(index=False)], f"{name} long, text string, n int, terms string, row string")


def listed(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_op13_made_texts(spark, monkeypatch, small):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns; small: many blocks of documents and of items."""
    if small:
        monkeypatch.setattr(ranked, "BLOCK_TERMS", 12)
    rng = random.Random(3)
    words = ["the", "The", "of", "ab", "ba", "été", "Été", "x1", "漢字", "zzz", "rare", "naïve", "\x80", "q" * 30]
    docs = [(i, " ".join(rng.choice(words[: rng.randint(1, len(words))]) for _ in range(rng.choice([1, 2, 5, 40])))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "... --"), (None, "rare words of"), (7, docs[7][1]), (203, "of " * 3000 + "rare"), *[(300 + i, "tie tie") for i in range(70)]]
    items = [(0, "the of THE"), (1, "été ab, ba"), (2, None), (3, "..."), (4, "tie"), (5, "rare-漢字_x1 " + "q" * 30), (None, "zzz"), (5, "nothing here"), (1, "été ab, ba")]
    for k in (3, 50):
        got = listed(ranked.search(frame(spark, docs, "doc_id").repartition(3), frame(spark, items, "item_id"), k, 7 if small else ranked.BLOCK_DOCS))
        assert got == sorted(plain(docs, items, k), key=str)


def test_op13_empty(spark):
    docs, items = frame(spark, [(1, "a b")], "doc_id"), frame(spark, [(1, "a")], "item_id")
    assert ranked.search(docs.limit(0), items).count() == 0
    assert ranked.search(docs, items.limit(0)).count() == 0
    assert ranked.search(frame(spark, [(1, None)], "doc_id"), items).count() == 0


def test_op13_postings(spark):
    """Long texts in parts, and many short ones at once, give the same counts."""
    rng = random.Random(8)
    texts = [None, "", "ab", *(" ".join(rng.choice(["ab", "AB", "é", "abé", "x" * 40, "-", "zz"]) for _ in range(n)) for n in (1, 3, 100, 2000))]
    d, terms = frame(spark, list(enumerate(texts)), "doc_id"), ["ab", "abé", "none", "x" * 40, "é"]
    want = [Counter((t or "").lower().replace("-", " ").split()) for t in texts]
    for size in (5, 60, 1 << 20):
        for r in ranked.postings(d, terms, size).collect():
            assert (r.n, dict(zip(r.terms, r.tfs))) == (sum(want[r.doc_id].values()), {i: want[r.doc_id][t] for i, t in enumerate(terms) if want[r.doc_id][t]})


def test_op13_equal_hashes(monkeypatch):
    """Terms that share a hash, asked for or not, are told apart by their bytes."""
    monkeypatch.setattr(ranked, "PRIME", np.uint64(1))  # the sum of a term's bytes
    asked = ranked.asked_of(["ab", "ba", "abc", "d"])
    starts, t = ranked.found_in(np.frombuffer(b"BA ab,cab bca d aab \xc3\xa9 ba", np.uint8), asked)
    assert starts.tolist() == [0, 3, 6, 10, 14, 16, 20, 23] and t.tolist() == [1, 0, -1, -1, 3, -1, -1, 1]


def test_op13_items_at_once(monkeypatch):
    """Sums of a few items at a time are those of all."""
    rng = np.random.default_rng(4)
    n, items, terms = 300, 9, 12
    n_terms = rng.integers(5, 50, n)
    pairs = sorted({(int(rng.integers(terms)), i) for i in range(items) for _ in range(4)})
    q = ranked.Query(list(range(items)), np.searchsorted(np.array([p[0] for p in pairs]), np.arange(terms + 1)), np.array([p[1] for p in pairs]), rng.integers(1, 9000, terms), n, int(n_terms.sum()))
    at = np.unique(rng.integers(0, n * terms, 900))
    found = [(i, sorted(zip(s.tolist(), d.tolist()))) for i, d, s in ranked.search_block(q, n_terms, at // terms, at % terms, at % 3 + 1, 10)]
    monkeypatch.setattr(ranked, "SUM_BYTES", 5000)
    assert found == [(i, sorted(zip(s.tolist(), d.tolist()))) for i, d, s in ranked.search_block(q, n_terms, at // terms, at % terms, at % 3 + 1, 10)]


def test_op13_slices():
    """Sums by bitwise carries are the sums, and descending slices gives the highest, of equal ones the first."""
    rng = np.random.default_rng(1)
    n, bits = 1000, 24
    sums, want = np.zeros((bits, 2, -(-n // 64)), np.uint64), np.zeros((2, n), np.int64)
    for _ in range(30):
        docs = np.sort(rng.choice(n, rng.integers(1, n), replace=False))
        impact = rng.integers(1, 1 << int(rng.integers(1, 18)), len(docs))
        words = np.unique(docs >> 6)
        rows = np.array([[0], [1], [0, 1]][rng.integers(3)])
        ranked.add_slices(sums, rows, words, ranked.slices_of(docs, impact, words))
        for r in rows:
            want[r, docs] += impact
    for r in (0, 1):
        for k in (1, 7, 64, 2000):
            d, s = ranked.top(sums[:, r], k)
            best = [i for i in sorted(range(n), key=lambda i: (-want[r, i], i)) if want[r, i]][:k]
            assert sorted(zip(d.tolist(), s.tolist())) == sorted((i, want[r, i]) for i in best)
