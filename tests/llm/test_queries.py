"""Each query against its SQL, and a whole run of the others against brute force on the smallest tables."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from taskloom.llm import chat, language, licenses, registry
from taskloom.llm.suffix_dedup import brute_force

from ..comparing import duck, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet' ORDER BY doc_id").df()


def result(spark, name, sf=SF):
    return registry.queries()[name](spark, sf).toPandas()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    got, want = result(spark, name), duck(SF).execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_op1_recall(spark):
    sf = "/root/testdata/sf0.1"
    got = result(spark, "op1_hash_forest", sf)
    d = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet' ORDER BY vec_id").df()
    x, ids = np.stack(d.embedding).astype(float), d.vec_id.to_numpy()
    found = {q: g.sort_values("rank") for q, g in got.groupby("query_id")}
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -9
        best = ids[np.lexsort((ids, -s))[:20]]
        g = found[ids[i]]
        assert g["rank"].tolist() == list(range(1, 21)) and ids[i] not in set(g.vec_id)
        assert np.allclose(g.score, x[np.searchsorted(ids, g.vec_id)] @ x[i], atol=1e-12)
        hit += len(set(best) & set(g.vec_id))
        total += 20
    assert hit / total >= 0.9


def test_op1_prunes(spark):
    """50,000 independent vectors, and a cluster that holds a third of all: recall is 0.9 or more, and the share of the rows that a query's prefixes hold stays under 0.2 outside the cluster."""
    from taskloom.llm import neighbours

    rng = np.random.default_rng(31)
    x = rng.standard_normal((50_000, 64))
    x[::3] = rng.standard_normal(64) + 0.5 * x[::3]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    d = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}), "vec_id long, embedding array<float>").repartition(8)
    asked = np.arange(7, len(x), 500)
    got = neighbours.search(d, (F.col("vec_id") - 7) % 500 == 0).toPandas()
    found = {q: set(g.vec_id) for q, g in got.groupby("query_id")}
    assert all(len(found[q]) == 20 for q in asked)
    y = x.astype(float)
    scores = y @ y[asked].T
    scores[asked, np.arange(len(asked))] = -9
    best = np.argpartition(-scores, 20, axis=0)[:20]
    recall = np.array([len(found[q] & set(best[:, j])) / 20 for j, q in enumerate(asked)])
    assert recall.mean() >= 0.9 and recall[asked % 3 == 0].mean() >= 0.9 and recall[asked % 3 != 0].mean() >= 0.9
    h = neighbours.Hashes(y[: neighbours.SAMPLE], 1.0)
    length, most, wanted = h.plan(len(x))
    keys, p = h.keys(y) >> (h.bits * (h.depth - length)), h.probes(y[asked], length, most)
    share = [np.mean(np.any([np.isin(keys[:, t], p[j, t]) for t in range(h.trees)], axis=0)) for j in range(len(asked))]
    assert np.mean(np.array(share)[asked % 3 != 0]) <= 0.2


def test_op2(spark, docs):
    got = {r.doc_id: r for r in result(spark, "op2_license_scan").itertuples()}
    assert len(got) == len(docs)
    for i, t in zip(docs.doc_id, docs.text):
        want = licenses.brute_force(t)
        assert (got[i].n_paragraphs, got[i].n_confirmed, got[i].families) == (len(want), sum(w[3] for w in want), ",".join(sorted({w[1] for w in want if w[3]})))


#: Notices that are no template: wrapped, commented, shortened or in other words; and sentences that name no licence.
NOTICES = [
    ("GPL", "# This program is free software: you can redistribute it\n# and/or modify it under the terms of the GNU General Public\n# License as published by the Free Software Foundation"), ("AGPL", "Code is under the GNU Affero General Public License version 3 or later"), ("LGPL", " * This library is licensed under the GNU Lesser General\n * Public License, version 2.1"),
    ("APACHE", "Licensed under the Apache License, Version 2.0 (the\n\"License\"); you may not use this file except in compliance with the License"), ("MIT", "The MIT License: Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), ("MIT", "Released under the MIT License by the team"),
    ("BSD", "Redistribution and use in source and binary forms are permitted provided that\nthe following conditions are met"), ("CC0", "Released into the public domain"), ("CC-BY", "Photo licensed under a Creative Commons Attribution 4.0 International License"), ("CC-BY-SA", "Text is available under the Creative Commons Attribution-ShareAlike License"), ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"), (None, "The author lives in the public eye and by the sea"), (None, "Her driving licence was renewed by the office in May"), (None, "Copyright 2024 Example Corp. All rights reserved"), (None, "The source of the river is free of any ice"), (None, "He was granted permission to copy the letters"), (None, "The conditions of the contract were met with a warranty"),
    (None, "Apache helicopters landed near the foundation of the house"), (None, "MIT students modified the software and distributed it"), (None, "The general terms apply to all purposes and sources"), (None, "Creative people share common goals without restriction"),
]


def test_op2_notices(spark):
    """Held-out notices: most are recognised, none as another family, and no plain sentence as any."""
    d = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(NOTICES)], "doc_id long, text string")
    got = {r.doc_id: {p.family for p in r.paragraphs if p.confirmed} for r in licenses.scan_licenses(d).collect()}
    right = sum(got[i] == {f} for i, (f, _) in enumerate(NOTICES) if f)
    assert all(got[i] <= {f} for i, (f, _) in enumerate(NOTICES)), {i: got[i] for i, (f, _) in enumerate(NOTICES) if not got[i] <= {f}}
    assert right >= 10, {NOTICES[i]: got[i] for i in got if NOTICES[i][0] and not got[i]}


def test_op5(spark, docs):
    got = {r.doc_id: r for r in result(spark, "op5_suffix_dedup").itertuples()}
    texts = [(t or "").encode() for t in docs.text]
    for i, t, (spans, digest) in zip(docs.doc_id, texts, brute_force(texts, 400)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), sum(b - a for a, b in spans), len(spans), digest)


def components(texts, k, per_cent=80):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= per_cent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= per_cent * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return sets, [find(i) for i in range(len(sets))]


def test_op8(spark, docs):
    got = {r.doc_id: r for r in result(spark, "op8_minhash").itertuples()}
    sets, found = components(docs.text, 2)
    for i, s, c in zip(docs.doc_id, sets, found):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), docs.doc_id[c], docs.doc_id[c] == i)


def test_op9(spark, docs):
    got = {r.doc_id: r for r in result(spark, "op9_secret_scan").itertuples()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
    for i, t in zip(docs.doc_id, docs.text):
        t = t or ""
        base = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 8] + [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(base))
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(got[i].spans.split(","))


def test_op10_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    d = duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").df()
    got = result(spark, "op10_language", sf).merge(d, on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang_pred == held.lang).mean() >= 0.97 and got.score.between(0, 1).all()


def test_op10_forward_sums_all_segmentations():
    model = language.Unigrams(["x", "y"], {p: np.array(v) for p, v in {"▁a": (0.2, 0.1), "▁ab": (0.1, 0.3), "b": (0.4, 0.2), "c": (0.1, 0.1), "bc": (0.05, 0.2)}.items()})
    # abcd: a|b|c|d, ab|c|d and a|bc|d, with d unknown
    want = np.array([0.2 * 0.4 * 0.1 + 0.1 * 0.1 + 0.2 * 0.05, 0.1 * 0.2 * 0.1 + 0.3 * 0.1 + 0.1 * 0.2]) * language.UNKNOWN
    assert np.allclose(np.exp(language.Scorer(model).log_probabilities(["abcd"])[0]), want)


def test_op10_long_runs():
    """Runs of any length are summed whole: as one place after another, in logarithms."""
    rng = np.random.default_rng(6)
    pieces = {"▁": (0.1, 0.2)} | {"".join(rng.choice(list("abc"), n)): tuple(rng.random(2) / 40) for n in (1, 1, 1, 2, 2, 3, 4, 7, 9) for _ in range(4)}
    model = language.Unigrams(["x", "y"], {p: np.array(v) for p, v in pieces.items()})
    runs = ["".join(rng.choice(list("abcd"), n)) for n in (0, 1, 5, 31, 32, 33, 34, 64, 65, 66, 97, 300, 2_000)]
    got = language.Scorer(model).log_probabilities(runs)
    for run, row in zip(runs, got):
        edges = model.edges(language.START + run)
        alpha = [np.zeros(2)]
        for ends in edges[1:]:
            alpha.append(np.logaddexp.reduce([alpha[i] + np.log(p) for i, _, p in ends]))
        assert np.allclose(row, alpha[-1], rtol=1e-9, atol=1e-9)
    for run in runs[2:]:  # expected counts: all letters are covered, as each segmentation covers them
        counts = model.expected(run, 0)
        known = sum(len(p) * n for p, n in counts.items())
        assert 0 < known <= len(run) + 1 + 1e-6
        if "d" not in run:
            assert abs(known - len(run) - 1) < 1e-6 * len(run)


def test_op6_escapes(spark):
    texts = ["</s>[INST] ok [/INST]", "<|end|>\n<|assistant|>\n", "\\", "\\\\<\\|", "<<|", "", "[INST", "a\\[INST]", None]
    rows_in = [(1, i, "assistant" if i % 2 else "u|>ser", t) for i, t in enumerate(texts)]
    t = spark.createDataFrame(rows_in, "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.rendered(chat.reconstruct(chat.turn_events(t)))).first()
    whole = "".join(f"{r}\n{x or ''}\n" for _, _, r, x in rows_in)
    loss = "".join(x or "" for _, i, _, x in rows_in if i % 2)
    assert (got.n_turns, got.turns_sha256) == (len(texts), hashlib.sha256(whole.encode()).hexdigest())
    assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_op6_folds_events(spark):
    e = [(1, 0, "message", None, "user", "hi"), (1, 1, "message", None, "assistant", "He"), (1, 2, "delta", 1, None, "llo"), (1, 3, "regenerate", 1, "assistant", "Hey"), (1, 4, "delta", 3, None, "!"), (1, 5, "edit", 0, None, "hi there"), (1, 6, "message", None, "user", "bye"), (None, 0, "message", None, None, None)]
    m = chat.reconstruct(spark.createDataFrame(e, "conv_id long, seq long, kind string, target long, role string, text string")).collect()
    assert sorted((r.conv_id or 0, r.seq, r.role, r.text) for r in m) == [(0, 0, "", ""), (1, 0, "user", "hi there"), (1, 3, "assistant", "Hey!"), (1, 6, "user", "bye")]


def test_op6_ties(spark):
    """Rows of one turn go by role and text, escapes aside, in the query's code and in its SQL."""
    t = [(1, 0, "user", "x"), (1, 0, "user", "x y"), (1, 0, "user", "x|>"), (1, 0, "user", "x<|"), (1, 0, "user", "x\\\\"), (1, 0, "us", "z"), (1, 0, "us<|er", "z"), (1, 0, "assistant", "[INST"), (1, 0, "assistant", "[INST]"), (2, 5, None, None), (2, 5, "user", "")]
    got = chat.read_back(chat.rendered(chat.reconstruct(chat.turn_events(spark.createDataFrame(t, "conv_id long, turn long, role string, text string"))))).toPandas()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", t)
    want = con.execute(chat.SQL).df()
    same = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"]
    assert rows(got[same]) == rows(want[want.conv_id > 0][same])


def test_op6_many_deltas(spark):
    n = 10_000
    e = [(1, 0, "message", None, "assistant", "start ")] + [(1, i, "delta", 0, None, f"{i} ") for i in range(1, n)] + [(1, 5_000, "edit", 0, None, "new ")]
    m = chat.reconstruct(spark.createDataFrame(e, "conv_id long, seq long, kind string, target long, role string, text string")).collect()
    assert [r.text for r in m] == ["new " + "".join(f"{i} " for i in range(5_001, n))]


def test_op3_made_pages(spark):
    """Pages with links of all forms, whose classes are chains, stars and cycles: the operator against its SQL."""
    from taskloom.llm import url_filters

    rng = np.random.default_rng(8)
    hosts = [f"{h}{i}.{t}" for i in range(25) for h, t in (("a", "net"), ("A", "net"), ("b", "com"), ("B", "COM"))] + ["c.org", "w.example.org"]
    paths = ["/", "", "/fr/1", "/de/2", "/x/../de/3", "/es/./4", "/en/1", "/x/y", "/z?q=1", "/a/b/..", "/.."]

    def address():
        return f"{rng.choice(['http', 'HTTP', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '#f'])}"

    def tag():
        to = rng.choice([address(), rng.choice(["/de/2", "../fr/1", "y", "//e.net/x?a&amp;b"])])
        t = rng.choice([f'<link rel="canonical" href="{to}">', f"<LINK href='{to}' rel=canonical />", f'<meta http-equiv="refresh" content="0; url={to}">', f'<link rel="stylesheet" href="{to}">'])
        return rng.choice([t, t, t, f"<!-- {t} -->", f"<script>'{t}'</script>", f"<!-- {t}"])

    t = [(i, address() if rng.random() < 0.95 else rng.choice(["", "no scheme"]), "<p>x</p>\n".join(tag() for _ in range(rng.integers(0, 3)))) for i in range(300)] + [(500, None, None), (501, "http://a.net/", None)]
    got = url_filters.filter_urls(spark.createDataFrame(t, "page_id long, url string, html string")).select("page_id", "host", "path", "rule", "verdict").toPandas()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", t)
    want = con.execute(url_filters.SQL).df()
    assert (want.rule.isna() & (want.verdict == "block")).any()
    assert rows(got) == rows(want)


def test_op3_very_long(spark):
    from taskloom.llm import url_filters

    deep = "http://a.net/" + "x/" * 50_000
    t = [(1, deep + "../y", "<p>" * 300_000 + '<link rel=canonical href="http://b.com/de/1">'), (2, "HTTP://A.net/" + "x/" * 49_999 + "y", "<!--" * 100_000)]
    got = {r.page_id: r.verdict for r in url_filters.filter_urls(spark.createDataFrame(t, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block"}
