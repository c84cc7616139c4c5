"""Operator 13: ranked lexical search by a bit-sliced impact index."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import ascii_lower, give_back, small_batches, table, written

#: Terms of a text of which only A-Z are lower-cased: runs of what is not ASCII, and of 0-9a-z.
TERM = r"[0-9a-z\x80-\x{10FFFF}]+"
#: Terms that one block of items may have, all told; more items are searched in several blocks.
BLOCK_TERMS = 100_000
#: Documents in a block of the index, and bytes of the items' sums that are held at once.
BLOCK_DOCS, SUM_BYTES = 16_384, 32 << 20
#: Bytes of text that are cut into terms at once.
TEXT_BYTES = 1 << 20
#: Class of each byte: 0 stands between terms; else what the byte is in lower case.
KIND = np.array([b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 0 for b in range(256)], np.uint8)
#: An odd multiplier, for the hash of a term.
PRIME = np.uint64(0x100000001B3)


class Asked(NamedTuple):
    """The terms asked for: their bytes one after the other, where each starts, and their hashes, sorted, with the term of each."""

    raw: np.ndarray
    starts: np.ndarray
    hashes: np.ndarray
    order: np.ndarray


def powers(n: int) -> np.ndarray:
    out = np.full(max(1, n), PRIME, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hashed(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each slice of raw; equal slices have equal ones."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    ends = np.cumsum(sizes)
    offset = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    by = raw[np.repeat(starts, sizes) + offset].astype(np.uint64) * powers(int(sizes.max()))[offset]
    return np.add.reduceat(by, ends - sizes)


def asked_of(terms: list[str]) -> Asked:
    parts = [t.encode() for t in terms]
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    raw = np.frombuffer(b"".join(parts), np.uint8)
    h = hashed(raw, starts[:-1], sizes)
    order = np.argsort(h, kind="stable")
    return Asked(raw, starts, h[order], order)


def found_in(text: np.ndarray, asked: Asked) -> tuple[np.ndarray, np.ndarray]:
    """(where each term of a text starts, which term asked for it is or -1), of the bytes of a text.

    Terms are looked up by hash, and those found compared byte by byte; terms asked for that share a hash are tried in turn.
    """
    low = np.concatenate([[0], KIND[text], [0]]).astype(np.uint8)
    edge = np.flatnonzero((low[1:] > 0) != (low[:-1] > 0))
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    term = np.full(len(starts), -1, np.int64)
    if not len(starts) or not len(asked.order):
        return starts, term
    low = low[1:-1]
    h = hashed(low, starts, sizes)
    at, until = (np.searchsorted(asked.hashes, h, side=s) for s in ("left", "right"))
    open_ = np.flatnonzero(at < until)
    while len(open_):
        t = asked.order[at[open_]]
        same = np.zeros(len(open_), bool)
        fits = np.flatnonzero(sizes[open_] == asked.starts[t + 1] - asked.starts[t])
        n = sizes[open_[fits]]
        if len(n):
            ends = np.cumsum(n)
            offset = np.arange(ends[-1]) - np.repeat(ends - n, n)
            equal = low[np.repeat(starts[open_[fits]], n) + offset] == asked.raw[np.repeat(asked.starts[t[fits]], n) + offset]
            same[fits] = np.logical_and.reduceat(equal, ends - n)
        term[open_[same]] = t[same]
        at[open_] += 1
        open_ = open_[~same & (at[open_] < until[open_])]
    return starts, term


def parts_of(text: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """A text's bytes in parts of about `size` that end between terms."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and KIND[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def postings(docs: DataFrame, terms: list[str], text_bytes: int = TEXT_BYTES) -> DataFrame:
    """(doc_id, n, terms, tfs): how many terms each document has, and which of `terms`, by number, how often.

    docs (doc_id, text): whole texts, whatever their length; other columns are ignored; a null text has no terms.
    Terms are found in the bytes of all texts of a batch at once.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(asked_of(terms))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        width = np.int64(len(asked.order) + 1)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            _, offsets, data = texts.buffers()
            ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
            n, keys, counts = np.zeros(len(texts), np.int64), [], []
            for rows in split_rows(ends, text_bytes):
                size = int(ends[rows.stop] - ends[rows.start])
                # a byte that is in no term keeps texts apart; a long text goes alone, in parts
                if len(rows) == 1:
                    for part in parts_of(raw[ends[rows.start] : ends[rows.stop]], text_bytes):
                        starts, t = found_in(part, asked)
                        n[rows.start] += len(starts)
                        k, c = np.unique(rows.start * width + t[t >= 0], return_counts=True)
                        keys.append(k)
                        counts.append(c)
                    continue
                gap = np.arange(len(rows))
                joined = np.zeros(size + len(rows), np.uint8)
                joined[np.arange(size) + np.repeat(gap, np.diff(ends[rows.start : rows.stop + 1]))] = raw[ends[rows.start] : ends[rows.stop]]
                starts, t = found_in(joined, asked)
                row = rows.start + np.searchsorted(ends[rows.start : rows.stop] - ends[rows.start] + gap, starts, side="right") - 1
                n += np.bincount(row, minlength=len(n))
                k, c = np.unique((row * width + t)[t >= 0], return_counts=True)
                keys.append(k)
                counts.append(c)
            key, at = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
            tf = np.bincount(at, weights=np.concatenate([np.zeros(0), *counts]), minlength=len(key)).astype(np.int64)
            bounds = pa.array(np.searchsorted(key, np.arange(len(texts) + 1) * width).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in ((key % width).astype(np.int32), tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])
        give_back()

    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInArrow(find, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, tfs array<long>")


def split_rows(ends: np.ndarray, size: int) -> Iterator[range]:
    """Rows, by the ends of their texts, in runs of about `size` bytes; a longer text is a run of its own."""
    at, last = 0, len(ends) - 1
    while at < last:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1)
        yield range(at, min(to, last))
        at = min(to, last)


def slices_of(docs: np.ndarray, impact: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Bitmaps of the impacts' bits, least significant first: slices x words, of those words of 64 documents in which the term has any."""
    bits = int(impact.max()).bit_length()
    at = np.searchsorted(words, docs >> 6)
    out = np.zeros((bits, len(words)), np.uint64)
    bit = np.left_shift(np.uint64(1), (docs & 63).astype(np.uint64))
    for i in range(bits):
        has = (impact >> i & 1).astype(bool)
        np.bitwise_or.at(out[i], at[has], bit[has])
    return out


def add_slices(sums: np.ndarray, rows: np.ndarray, words: np.ndarray, slices: np.ndarray) -> None:
    """Adds a term's slices to the sums (slices x items x words) of some items: a full adder on bitmaps, with the carry handed up."""
    carry = np.zeros((len(rows), len(words)), np.uint64)
    at = np.ix_(rows, words)
    for i in range(len(sums)):
        if i >= len(slices) and not carry.any():
            break
        a = sums[i][at]
        if i < len(slices):
            b = slices[i]
            half = a ^ b
            sums[i][at] = half ^ carry
            carry = (a & b) | (half & carry)
        else:
            sums[i][at] = a ^ carry
            carry &= a


def top(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of one item's sums (slices x words): the k highest above 0, of equal ones the first documents.

    From the most significant slice down, documents that have the bit go before all that do not: while those with it
    and those taken before are k or fewer they are taken; else only they go on.
    """
    some = np.bitwise_or.reduce(sums, axis=0)
    taken, left = np.zeros_like(some), some
    for s in sums[::-1]:
        more = left & s
        n = int(np.bitwise_count(taken | more).sum())
        if n > k:
            left = more
        else:
            taken |= more
            left = left & ~s
    docs = np.concatenate([members(taken), members(left)[: k - int(np.bitwise_count(taken).sum())]])
    bit = (docs & 63).astype(np.uint64)
    score = np.zeros(len(docs), np.int64)
    for i, s in enumerate(sums):
        score |= (s[docs >> 6] >> bit & np.uint64(1)).astype(np.int64) << i
    return docs, score


def members(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


class Query(NamedTuple):
    """Items of a block: their ids, the items of each term (`of_term` from starts[t] to starts[t + 1]), the terms' weights, N and L."""

    items: list
    starts: np.ndarray
    of_term: np.ndarray
    weight: np.ndarray
    n_docs: int
    length: int


def search_block(q: Query, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, documents, scores) for one block of documents, numbered in the order in which equal scores stand; postings are (doc, term, tf)."""
    m = 50 + (50 * n * q.n_docs) // max(1, q.length)
    impact = q.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
    order = np.argsort(term, kind="stable")
    doc, term, impact = doc[order], term[order], impact[order]
    of = np.searchsorted(term, np.arange(len(q.weight) + 1))
    highest = int(np.maximum.reduceat(impact, of[:-1][of[:-1] < of[1:]]).sum()) if len(term) else 0
    bits, words = max(1, highest.bit_length()), -(-len(n) // 64)
    at_once = max(1, SUM_BYTES // (8 * bits * words))
    for first in range(0, len(q.items), at_once):
        sums = np.zeros((bits, min(at_once, len(q.items) - first), words), np.uint64)
        for t in np.flatnonzero(of[:-1] < of[1:]).tolist():
            rows = q.of_term[q.starts[t] : q.starts[t + 1]] - first
            rows = rows[(rows >= 0) & (rows < sums.shape[1])]
            if len(rows):
                mine = slice(of[t], of[t + 1])
                w = np.unique(doc[mine] >> 6)
                add_slices(sums, rows, w, slices_of(doc[mine], impact[mine], w))
        for i in range(sums.shape[1]):
            d, s = top(sums[:, i], k)
            if len(d):
                yield first + i, d, s


def search_postings(found: DataFrame, q: Query, k: int, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(item, doc_id, score): the k best of each block of documents; blocks are made of what a task reads, in order of doc_id."""
    sent = found.sparkSession.sparkContext.broadcast(q)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            block = pa.Table.from_batches(held)
            block = block.take(pc.sort_indices(block, sort_keys=[("doc_id", "ascending")], null_placement="at_start")).combine_chunks()
            n = block.column("n").to_numpy()
            sizes = pc.list_value_length(block.column("terms")).to_numpy()
            flat = [block.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tfs")]
            for item, d, s in search_block(sent.value, n, np.repeat(np.arange(len(n)), sizes), *flat, k):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), item)), block.column("doc_id").take(pa.array(d)).combine_chunks(), pa.array(s)], names=["item", "doc_id", "score"])

        for batch in batches:
            for at in range(0, len(batch), block_docs):
                held.append(batch.slice(at, block_docs))
                if sum(map(len, held)) >= block_docs:
                    yield from flush()
                    held.clear()
        if held:
            yield from flush()
        give_back()

    return found.mapInArrow(search, f"item long, doc_id {found.schema['doc_id'].dataType.simpleString()}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 for each item, equal scores by doc_id, nulls first.

    docs (doc_id, text) and items (item_id, text); other columns are ignored. Terms are runs of 0-9a-z and of what is not ASCII,
    of the whole text with A-Z lower-cased. N counts the documents with a term, L is all their terms, n one document's,
    df the documents with a term, tf how often a document has it. A term weighs
    w = floor(1000 ln((2 N + 2) / (2 df + 1))), and a score is the sum over an item's different terms of
    w * (10^9 tf div (1000 tf + 20 m)), m = 50 + 50 n N div L.

    Null texts and texts without terms have none: such documents are never found, such items find nothing. Each
    row of items is an item and each row of docs a document of its own, whatever the ids. No rows of either give no rows.

    The index holds, for blocks of documents, each asked term's impacts by their bits: one bitmap for each bit, of those words
    of the block that have the term. Sums are bitmaps too: terms are added to all items that have them with bitwise carries, and
    the best are found from the most significant slice down. Blocks are made of the documents that a task
    reads, so documents are not shuffled; of each block and item k rows are, and they are limited again before they meet.
    Items with more than BLOCK_TERMS terms in all are searched in several blocks.
    """
    spark = docs.sparkSession
    got = items.select("item_id", F.array_distinct(F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0))).alias("terms"))
    got = written(got.where(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id()))
    blocks = max(1, -(-(got.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS))
    hits = None
    for b in range(blocks):
        rows = got.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item").collect()
        terms = sorted({t for r in rows for t in r["terms"]})
        place = {t: i for i, t in enumerate(terms)}
        found = written(postings(docs, terms))
        n_docs, length = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(terms), np.int64)
        for r in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # one row a term of the block
            df[r["t"]] = r["df"]
        pairs = sorted((place[t], i) for i, r in enumerate(rows) for t in r["terms"])
        starts = np.searchsorted(np.array([p[0] for p in pairs], np.int64), np.arange(len(terms) + 1))
        weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        q = Query([r["item"] for r in rows], starts, np.array([p[1] for p in pairs], np.int64), weight, n_docs, length)
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], "item long, row long")
        part = search_postings(found, q, k, block_docs).join(F.broadcast(names), "item").select("row", "doc_id", "score")
        hits = part if hits is None else hits.unionByName(part)
    by = W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    best = hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return best.join(got.select(F.col("item").alias("row"), "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rk, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS rb, item_id,
  list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
tf AS (SELECT rk, term, count(*) AS tf FROM (SELECT rk, unnest(w) AS term FROM d) GROUP BY rk, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
total AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
scored AS (SELECT rb, item_id, rk, doc_id,
    sum(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(w) * n_docs) // l))))::BIGINT AS score
  FROM (SELECT rb, item_id, unnest(w) AS term FROM b) JOIN tf USING (term) JOIN df USING (term) JOIN d USING (rk), total GROUP BY rb, item_id, rk, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rb ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
