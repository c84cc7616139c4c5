"""Operator 9: secret scans: known forms, and random strings by a token-efficiency test."""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import give_back, small_batches, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pattern that splits text before the merges of the rank files, and the base forms.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more is what is left of all runs
KINDS = ("assign", "access", "hex", "random")
#: Strings that the token-efficiency test looks at, what it leaves out, and how far above its ratio the parts of a name are.
STRING = re.compile(r"[A-Za-z0-9+/_=.-]{20,}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|sha(?:1|256|384|512)-[a-z0-9+/]+=*)", re.IGNORECASE)
#: Part of a string between separators.
PIECE = re.compile(r"[A-Za-z0-9+]{20,}")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
NAME = 1.125
SPAN = "array<struct<kind:string,start:long,end:long>>"


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def vocabulary(ranks_file: bytes):
    """The encoding of a file of ranks, given its content."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def identifier(s: str, ratio: float, encoding) -> bool:
    """Words and numbers of a name: its parts, in lower case and without what stands between them, are long in tokens of the vocabulary, a number of up to four digits being one."""
    parts = [p.lower() for p in PART.findall(s)]
    tokens = sum(1 if p.isdigit() and len(p) <= 4 else len(encoding().encode_ordinary(p)) for p in parts)
    return sum(map(len, parts)) >= NAME * ratio * tokens > 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base forms, kinds by their place in KINDS."""
    found = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def joined(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs that touching or overlapping spans make, in order."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def improbable(s: str, ratio: float, encoding) -> bool:
    """Whether a string has fewer than `ratio` characters a token and is neither a digest nor a name."""
    return not DIGEST.fullmatch(s) and len(s) < ratio * len(encoding().encode_ordinary(s)) and not identifier(s, ratio, encoding)


def spans_of(text: str | None, ratio: float, encoding) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans of a text, sorted; encoding() gives the vocabulary."""
    text = text or ""
    found = base_spans(text)
    starts, ends = joined([(a, b) for a, _, b in found])

    def free(a: int, b: int) -> bool:
        i = bisect_right(ends, a)
        return i == len(starts) or starts[i] >= b

    for m in STRING.finditer(text):
        parts = [(p.start(), p.end()) for p in PIECE.finditer(text, m.start(), m.end()) if p.end() - p.start() < len(m[0])]
        hits = [(a, b) for a, b in parts if free(a, b) and improbable(text[a:b], ratio, encoding)]
        if not hits and free(m.start(), m.end()):
            s = m[0].strip("._=-")
            at = m.start() + m[0].index(s)
            hits = [(at, at + len(s))] if improbable(s, ratio, encoding) else []
        found += [(a, 3, b) for a, b in hits]
    return sorted(found)


def scanner(vocabulary_path: str = VOCABULARY, ratio: float = 2.0):
    """A column function from a text to its spans (kind, start, end), in code points, end exclusive, by start and kind.

    Kinds assign, access and hex are the base forms, each leftmost and without overlap.
    Kind random is a string of 20 or more of `[A-Za-z0-9+/_=.-]` that no base span touches,
    that is no digest of a known length and no UUID, and that the vocabulary cuts into so many
    tokens that a token has less than `ratio` characters: text that is written by people has
    about four. First the parts of a string between separators are tested, those of 20 or more characters, so that what surrounds a secret,
    such as a path, neither dilutes it nor is reported with it; a string without such a part is tested whole. A name is excepted: its runs of letters of one word and of digits, in lower
    case and without the signs between them, have NAME * ratio characters a token or more,
    where a number of up to four digits, such as a year, is one token.
    Case, digits and the number of parts do not matter. A null text is empty and has no spans;
    whole texts are read. The driver reads the vocabulary file, under 2 MB, and sends it to the
    executors, which need no file of their own.
    """
    ranks = SparkSession.active().sparkContext.broadcast(read_ranks(vocabulary_path))

    @F.pandas_udf(SPAN)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = cache(lambda: vocabulary(ranks.value))
        for texts in batches:
            yield pd.Series([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(t, ratio, encoding)] for t in texts])
        give_back()

    return scan


def redactor(mark: str = "[secret]", vocabulary_path: str = VOCABULARY, ratio: float = 2.0):
    """A column function from a text to the text with mark for each run of touching or overlapping spans; null stays null."""
    ranks = SparkSession.active().sparkContext.broadcast(read_ranks(vocabulary_path))

    @F.pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = cache(lambda: vocabulary(ranks.value))
        for texts in batches:
            yield pd.Series([t if t is None else cut(t, [(a, b) for a, _, b in spans_of(t, ratio, encoding)], mark) for t in texts], dtype=object)
        give_back()

    return redact


def cut(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, at = [], 0
    for a, b in spans:
        if a >= at and not (out and a == at):
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, vocabulary_path: str = VOCABULARY, ratio: float = 2.0) -> DataFrame:
    """(doc_id, spans): scanner() on docs (doc_id, text; other columns are ignored). Repeated rows each get a row; no rows give no rows."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", scanner(vocabulary_path, ratio)("text").alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]", vocabulary_path: str = VOCABULARY, ratio: float = 2.0) -> DataFrame:
    """docs with text redacted, and n_chars, where there is one, counted anew; all other columns and all rows stay."""
    small_batches(docs.sparkSession)
    out = docs.withColumn("text", redactor(mark, vocabulary_path, ratio)("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = find_secrets(table(spark, sf_dir, "documents"))

    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def counted(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    n = [counted(kind) for kind in KINDS]
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return r.select("doc_id", *n[:3], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), n[3])
