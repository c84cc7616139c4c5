"""Operator 9's random strings against a version of their own, diluted secrets, and long texts of many matches."""

import base64
import random
import re
import time

import pandas as pd
import pytest
import tiktoken

from taskloom.llm import registry, secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoding():
    with open(secrets.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=secrets.SPLIT, mergeable_ranks=ranks, special_tokens={})


def plain(text, encoding):
    """All spans, by the words of the docstring: every pair of spans is compared."""
    text, found = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        found += [(m.start(), "assign", m.end())] * (m.end(2) - m.start(2) >= 8)
    found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    base = list(found)
    n = lambda s: len(encoding.encode_ordinary(s))

    def odd(a, b):
        s = text[a:b]
        if any(x < b and a < y for x, _, y in base) or len(s) >= 2 * n(s):
            return False
        if re.fullmatch(r"[0-9a-f]+", s, re.I) and len(s) in (32, 40, 56, 64, 96, 128) or re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", s, re.I) or re.fullmatch(r"sha(1|256|384|512)-[a-z0-9+/]+=*", s, re.I):
            return False
        words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+", s)]
        tokens = sum(1 if w.isdigit() and len(w) < 5 else n(w) for w in words)
        return not (tokens and len("".join(words)) >= 2.25 * tokens)

    for m in re.finditer(r"[A-Za-z0-9+/_=.-]{20,}", text):
        at, parts = m.start(), []
        for p in re.split(r"([/_=.-]+)", m[0]):
            if 20 <= len(p) < len(m[0]) and p[0] not in "/_=.-" and odd(at, at + len(p)):
                parts.append((at, "random", at + len(p)))
            at += len(p)
        if not parts and not any(x < m.end() and m.start() < y for x, _, y in base):
            a, b = m.start() + len(m[0]) - len(m[0].lstrip("._=-")), m.end() - len(m[0]) + len(m[0].rstrip("._=-"))
            parts = [(a, "random", b)] if b > a and odd(a, b) else []
        found += parts
    order = {k: i for i, k in enumerate(secrets.KINDS)}
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(found, key=lambda x: (x[0], order[x[1]], x[2])))


def test_op9_all_spans(spark, encoding):
    got = registry.queries()["op9_secret_scan"](spark, SF).toPandas().set_index("doc_id").spans
    d = pd.read_parquet(f"{SF}/documents.parquet")
    assert len(got) == len(d)
    assert {i: got[i] for i in d.doc_id} == {i: plain(t, encoding) for i, t in zip(d.doc_id, d.text)}


SECRET = "x9Qz7LkP2mWv4TrB8nYcKq"


def test_op9_diluted(encoding):
    """A secret in a path, an address or an assignment is found by itself, and nothing around it."""
    for t in (f"https://example.org/downloads/archive/releases/{SECRET}/file-list.html", f"connection_string=application/database/{SECRET}", f"/home/user/projects/configuration/{SECRET}", f"key-of-the-application_{SECRET}.backup-of-yesterday", SECRET):
        a = t.index(SECRET)
        assert secrets.spans_of(t, 2.0, lambda: encoding) == [(a, 3, a + len(SECRET))], t
    for t in ("/home/user/projects/configuration/settings-of-the-application.yaml", "https://example.org/commit/0123456789abcdef0123456789abcdef01234567", "", None, "." * 50, "=" * 20):
        assert [s for s in secrets.spans_of(t, 2.0, lambda: encoding) if s[1] == 3] == []
    mixed = f"token: abcdefgh1/{SECRET} and {SECRET}/0123456789abcdef0123456789abcdef"
    assert ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in secrets.spans_of(mixed, 2.0, lambda: encoding)) == plain(mixed, encoding)


def test_op9_many_matches(encoding):
    """A hundred thousand matches in one text take seconds, and are those of its lines."""
    rng = random.Random(2)
    lines = ["".join(rng.choices("0123456789abcdef", k=33)) for _ in range(50_000)] + [f"password={i:08d}" for i in range(50_000)] + [f"a/b/{SECRET}/{i}" for i in range(1000)]
    rng.shuffle(lines)
    began = time.monotonic()
    got = secrets.spans_of("\n".join(lines), 2.0, lambda: encoding)
    assert time.monotonic() - began < 20
    want, at = [], 0
    for line in lines:
        want += [(at + a, k, at + b) for a, k, b in secrets.spans_of(line, 2.0, lambda: encoding)]
        at += len(line) + 1
    assert got == want and len(got) >= 101_000


def test_op9_made_strings(encoding):
    """Thousands of strings of random signs, names, separators and secrets, against the plain version."""
    rng = random.Random(9)
    signs = ["abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+"]
    word = lambda: rng.choice(["home", "Settings", "application", "v2", "2024", "backup", "AKIA" + "Z" * 14, "token=", "password: ", "é"])
    for _ in range(3000):
        t = rng.choice(["", " ", "/", "=", "-", "."]).join(word() if rng.random() < 0.6 else "".join(rng.choices(rng.choice(signs), k=rng.choice([8, 20, 24, 33, 64]))) for _ in range(rng.randint(1, 6)))
        assert ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in secrets.spans_of(t, 2.0, lambda: encoding)) == plain(t, encoding), t
