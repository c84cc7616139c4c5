"""Operators 11 and 12 against the public libraries, whole tables and made texts."""

import hashlib
import random

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from taskloom.llm import alignment, bpe, registry

SF = "/root/testdata/sf0.001"
MADE = [
    None, "", " ", "\n", "a", "</s>", "<|endoftext|>", "'s't''re x'llabc 'll", "\x1c a\x85b\xa0c　d", "  two   spaces \n\n  x ", "▁ low", "é é", "a" * 1000, "ab" * 700, "漢字" * 900, "\U0001f600️" * 9, "0123456789" * 40, " \t" * 300,
    "tab\tand\r\nline", "\x00\x01", "x" * 256 + " " + "x" * 257, "﻿mark", "١٢٣ ४५", "ǅ ʰ ª º", "​‍", "a\u0558b \U0003fc3f1 x\u1c89y",
]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def frame(spark, texts):
    d = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "ids": "clash", "decoded": 1, "token": None})
    return spark.createDataFrame(d, "doc_id long, text string, ids string, decoded int, token string")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def documents(sf=SF):
    return pd.read_parquet(f"{sf}/documents.parquet")


def test_op11(spark, library):
    got = registry.queries()["op11_byte_bpe"](spark, SF).toPandas().set_index("doc_id")
    d = documents()
    assert len(got) == len(d)
    for i, t in zip(d.doc_id, d.text):
        ids = library.encode_ordinary(t or "")
        assert tuple(got.loc[i, ["n_tokens", "ids_sha256", "decoded_sha256"]]) == (len(ids), sha(",".join(map(str, ids))), sha(t or ""))


def test_op11_made_texts(spark, library):
    """Nulls, empty texts, repeated rows, clashing columns and an empty table."""
    d = frame(spark, MADE + MADE)
    got = bpe.encode_documents(d).toPandas()
    assert len(got) == 2 * len(MADE)
    for r in got.itertuples():
        t = (MADE + MADE)[r.doc_id] or ""
        assert list(r.ids) == library.encode_ordinary(t) and bytes(r.decoded) == t.encode()
    assert bpe.encode_documents(d.limit(0)).count() == 0


def test_op11_long(library, vocabulary, monkeypatch):
    """Texts in pieces, long words among short ones, and a memo that is emptied."""
    rng = random.Random(5)
    words = ["x", " the", "  \n", "é" * 300, "Ünder", "a1b2", "''", "…", "abc" * 200, " 12"]
    texts = ["".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 50, 3000)]
    want = [library.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(bpe, "PIECE", 500)
    monkeypatch.setattr(bpe, "MEMO", 4)
    assert [x.tolist() for x in bpe.Encoder(vocabulary).encode(texts)] == want
    assert "".join(bpe.pieces(texts[3])) == texts[3]


@pytest.mark.parametrize("library", [bpe.by_tiktoken, alignment.by_byte_level])
def test_pattern_classes(library):
    """Every code point is of the class, to the splitting pattern here, that it has in either library."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    split = bpe.Splitter(public_tokenizers.PATTERN, bpe.strangers(library))
    for before in "a1!":
        differ = [c for c, one in zip(points, library([before + c for c in points])) if one != (len(split(before + c)) == 1)]
        assert not differ


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abtheing r'", min_size=1, max_size=40), min_size=1, max_size=6))
def test_op11_words_are_merged_as_by_rescans(words):
    """The trees of short words, of long ones, and a plain scan for the least rank agree."""
    v = test_op11_words_are_merged_as_by_rescans.v = getattr(test_op11_words_are_merged_as_by_rescans, "v", None) or bpe.read_vocabulary(public_tokenizers.path(bpe.VOCABULARY))
    raw = [w.encode() for w in words if len(w) > 1] or [b"the"]
    flat, sizes = bpe.merged_together(raw, v)
    pairs = dict(zip(v.lefts_rights.tolist(), v.joined.tolist()))
    for b, ids in zip(raw, np.split(flat, np.cumsum(sizes)[:-1])):
        parts = [bytes([x]) for x in b]
        while len(parts) > 1:
            rank, i = min((v.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert ids.tolist() == bpe.merged_alone(b, v, pairs).tolist() == [v.ranks[p] for p in parts]


def by_whole_texts(texts):
    """Operator 12 by the two libraries on whole texts, and sets of ends."""
    a = Tokenizer.from_file(public_tokenizers.path(alignment.BYTE_LEVEL))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.PIECES))
    chars = {v: k for k, v in alignment.letters().items()}
    assert {chars[x]: 0 for x in range(256)}.keys() == set("".join(t for t in a.get_vocab() if t != "<|endoftext|>"))

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    per_text, counts = [], {}
    for t in texts:
        ids = [a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")] if t else [[], []]
        raw = [[bytes(alignment.letters()[c] for c in a.id_to_token(i)) for i in ids[0]], [piece(i) for i in ids[1]]]
        if not t or any(b"".join(r) != b" " + t.encode() for r in raw):
            per_text.append(None)
            continue
        ends = [dict(zip(np.cumsum([len(x) for x in r]).tolist(), range(1, len(r) + 1))) for r in raw]
        cuts = sorted(ends[0].keys() & ends[1].keys())
        groups, links, last = [], [], (0, 0)
        for c in cuts:
            now = ends[0][c], ends[1][c]
            groups.append("|".join(",".join(map(str, x[p:q])) for x, p, q in zip(ids, last, now)))
            links.append((ids[0][now[0] - 1], ids[1][now[1] - 1]))
            last = now
        for k in links:
            counts[k] = counts.get(k, 0) + 1
        per_text.append((len(ids[0]), len(ids[1]), groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for x in per_text:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n = [counts[k] for k in x[3]]
            out.append((x[0], x[1], len(x[2]), len(x[3]), sum(c == best[k[1]] for c, k in zip(n, x[3])), sum(n), sha(";".join(x[2]))))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_op12(spark):
    got, d = registry.queries()["op12_token_alignment"](spark, SF).toPandas().set_index("doc_id"), documents()
    assert len(got) == len(d)
    for i, want in zip(d.doc_id, by_whole_texts(d.text)):
        assert tuple(got.loc[i, COLUMNS]) == want


def test_op12_made_texts(spark, tmp_path, monkeypatch):
    """Nulls, empty texts, repeated rows, clashing columns, texts in pieces, several shards, and an empty table."""
    texts = [*MADE, *MADE[::2], "x ", "x  ", " x", "a b " * 300, "<s> </s> <unk> <0x41>"]
    monkeypatch.setattr(alignment, "SHARD_ROWS", 40)
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = alignment.op12_token_alignment(spark, str(tmp_path)).toPandas().sort_values("doc_id")
    assert [tuple(r) for r in got[COLUMNS].itertuples(index=False)] == by_whole_texts(texts)
    counts = alignment.pair_counts(alignment.align(frame(spark, texts)))
    assert len(counts.names) > 1 and all(alignment.Counts.shard(counts, i).shape[0] == 2 for i in range(len(counts.names)))
    frame(spark, texts).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert alignment.op12_token_alignment(spark, f"{tmp_path}/none").count() == 0


def test_op12_pieces(monkeypatch):
    monkeypatch.setattr(alignment, "PIECE", 7)
    for t in ("a b c d e f g h i j ", "a  b   c    d     e f", "x" * 30 + " y", " " * 20 + "z", "ab cd ef gh "):
        chunks = [c for part in alignment.chunked(t) for c in part]
        assert " ".join(chunks) == t and chunks == alignment.CUT.split(t)


def test_op12_memo(monkeypatch):
    """A memo that is emptied again and again changes nothing."""
    with open(public_tokenizers.path(alignment.BYTE_LEVEL), "rb") as f, open(public_tokenizers.path(alignment.PIECES), "rb") as g:
        t = alignment.Tokenizers(alignment.byte_level_vocabulary(f.read()), bpe.strangers(alignment.by_byte_level), g.read())
    texts = [*MADE, *documents().text[:40]]
    want = alignment.Aligner(t).of(texts)
    monkeypatch.setattr(alignment, "PIECE", 300)
    monkeypatch.setattr(alignment, "MEMO", 20)
    small = alignment.Aligner(t)
    for _ in range(2):
        got = small.of(texts)
        assert [g[:3] for g in got] == [w[:3] for w in want] and all((g[3] == w[3]).all() for g, w in zip(got, want))
