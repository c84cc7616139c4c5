"""Operator 11: byte-level BPE by a segment tree over byte positions, and its inverse."""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import repeat
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import give_back, small_batches, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: No pair of a vocabulary; above every key of a tree.
NONE = np.int64(1) << 62
#: Words of more bytes get a tree of their own; shorter ones are merged together, by the power of two that holds them.
TOGETHER = 256
#: Words that a worker keeps with their ids, and characters of a text that are split into words at once.
MEMO, PIECE = 250_000, 1 << 20
#: White space that seldom occurs, as a sign between words.
GAP = "\x0b"
#: A place in a text where a word always ends.
CUT = regex.compile(r"(?<=\S)(?=\s)")


class Vocabulary(NamedTuple):
    """ranks: id by bytes; lefts_rights: sorted pairs of ids, left << 32 | right, that may be merged, with the id that comes of it, which is their rank, in `joined`.

    whole: a word that is a token as it stands is that token, whatever merges would make of it.
    """

    ranks: dict[bytes, int]
    lefts_rights: np.ndarray
    joined: np.ndarray
    of_byte: np.ndarray
    whole: bool = True

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair is merged to, or NONE; a negative id stands for nothing."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.lefts_rights, key), len(self.joined) - 1)
        return np.where((self.lefts_rights[at] == key) & (right >= 0), self.joined[at], NONE)


def vocabulary_of(ranks: dict[bytes, int], merges: list[tuple[bytes, bytes]] | None = None) -> Vocabulary:
    """Every way to cut a token into two tokens is a pair; or only `merges` are, in the order of the ids that they make. All 256 bytes must be tokens."""
    if merges is None:
        pairs = {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
    else:
        made = [ranks[a + b] for a, b in merges]
        if made != sorted(set(made)):
            raise ValueError("merges do not stand in the order of the ids that they make")
        pairs = {ranks[a] << 32 | ranks[b]: r for (a, b), r in zip(merges, made, strict=True)}
    keys = np.array(sorted(pairs) or [-1], np.int64)
    return Vocabulary(ranks, keys, np.array([pairs.get(k, 0) for k in keys.tolist()], np.int64), np.array([ranks[bytes([b])] for b in range(256)], np.int64), merges is None)


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return vocabulary_of({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def merged_together(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words, one after the other, and how many each has.

    Each word has a segment tree: a leaf for each byte position holds rank * width + position of the
    pair that starts there, a node the least of its two. So the root names the leftmost pair of the
    least rank. A merge makes that pair one token, takes the right position out and sets three
    leaves anew: the pair's, the one of its live neighbour to the left, and the one taken out. The words of a
    call do one merge each at a time, as far as they have any.
    """
    n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
    width = 1 << max(1, int(sizes.max() - 1).bit_length())
    wide = width + 2  # a position at either end that has no token
    row = np.repeat(np.arange(n), sizes)
    at = row * wide + 1 + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    token = np.full(n * wide, -1, np.int64)
    token[at] = v.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    after, before = np.tile(np.arange(1, wide + 1, dtype=np.int32), n), np.tile(np.arange(-1, wide - 1, dtype=np.int32), n)
    tree = np.full((n, 2 * width), NONE)
    live = token.reshape(n, wide)[:, 1 : width + 1]
    rank = v.pair(live[:, :-1].ravel(), live[:, 1:].ravel()).reshape(n, width - 1)
    tree[:, width:-1] = np.where(rank < NONE, rank * width + np.arange(width - 1), NONE)
    k = width // 2
    while k:
        tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        k //= 2
    tree, rows = tree.ravel(), np.arange(n)
    while True:
        least = tree[rows * (2 * width) + 1]
        rows = rows[least < NONE]
        if not len(rows):
            break
        least = least[least < NONE]
        rank, p = least // width, least % width + 1
        base = rows * wide
        q = after[base + p]
        rest, left = after[base + q], before[base + p]
        token[base + p], token[base + q], after[base + p], before[base + rest] = rank, -1, rest, p
        right_pair, left_pair = v.pair(rank, token[base + rest]), v.pair(token[base + left], rank)
        left_leaf = np.where(left > 0, left, q)  # where nothing stands to the left, the leaf taken out is set twice
        leaf = np.concatenate([p, q, left_leaf]) - 1
        key = np.concatenate([right_pair, np.full(len(rows), NONE), np.where(left > 0, left_pair, NONE)])
        node, roots = leaf + width, np.tile(rows * (2 * width), 3)
        tree[roots + node] = np.where(key < NONE, key * width + leaf, NONE)
        for _ in range(width.bit_length() - 1):
            node >>= 1
            tree[roots + node] = np.minimum(tree[roots + 2 * node], tree[roots + 2 * node + 1])
    kept = token >= 0
    return token[kept].astype(np.int32), kept.reshape(n, wide).sum(axis=1)


def merged_alone(word: bytes, v: Vocabulary, pairs: dict[int, int]) -> np.ndarray:
    """The same for one long word; its time is that of n log n steps."""
    n, width = len(word), 1 << (len(word) - 1).bit_length()
    shift, none = width.bit_length() - 1, int(NONE)
    first = v.of_byte[np.frombuffer(word, np.uint8)]
    tree = np.full(2 * width, NONE)
    rank = v.pair(first[:-1], first[1:])
    tree[width : width + n - 1] = np.where(rank < NONE, (rank << shift) + np.arange(n - 1), NONE)
    k = width // 2
    while k:
        tree[k : 2 * k] = np.minimum(tree[2 * k : 4 * k : 2], tree[2 * k + 1 : 4 * k : 2])
        k //= 2
    tree, token = array("q", tree.tobytes()), array("q", first.tobytes())
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))

    def put(at: int, left: int, right: int) -> None:
        r = pairs.get(token[left] << 32 | token[right]) if right < n else None
        climb(at, none if r is None else (r << shift) + at)

    def climb(at: int, key: int) -> None:
        i = at + width
        tree[i] = key
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            if a > b:
                a = b
            if tree[i] == a:
                return
            tree[i] = a

    while (least := tree[1]) < none:
        p = least & (width - 1)
        q = after[p]
        rest, left = after[q], before[p]
        token[p], token[q], after[p] = least >> shift, -1, rest
        if rest < n:
            before[rest] = p
        climb(q, none)
        put(p, p, rest)
        if left >= 0:
            put(left, left, p)
    out = np.frombuffer(token, np.int64)
    return out[out >= 0].astype(np.int32)


def by_tiktoken(pairs: list[str]) -> list[bool]:
    """Whether tiktoken, by the pattern of the rank files, takes each of some texts of two signs, which begin alike, for one word."""
    ranks = {x: i for i, x in enumerate(dict.fromkeys([*(bytes([b]) for b in range(256)), *(p.encode() for p in pairs)]))}
    library = tiktoken.Encoding("kinds", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [len(library.encode_ordinary(p)) == 1 for p in pairs]


@cache
def strangers(is_word: Callable[[list[str]], list[bool]] = by_tiktoken) -> dict[int, str]:
    """Code points that are a letter, a digit or neither to one edition of Unicode and something else to another, each with a sign that stands for what a library takes it for.

    The modules here know different editions. Where two of them disagree the library is
    asked: of a letter and the code point in question it makes one word if that is a letter to it.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    known = {"b": set(regex.findall(r"\p{L}", every)), "1": set(regex.findall(r"\p{N}", every))}
    other = {k: {c for c in every if unicodedata.category(c)[0] == x} for k, x in (("b", "L"), ("1", "N"))}
    asked = sorted((known["b"] ^ other["b"]) | (known["1"] ^ other["1"]))
    kinds = {k: {c for c, one in zip(asked, is_word([k + c for c in asked]), strict=True) if one} for k in "b1"}
    return {ord(c): "b" if c in kinds["b"] else "1" if c in kinds["1"] else "!" for c in asked if any((c in kinds[k]) != (c in known[k]) for k in kinds)}


class Splitter:
    """The matches of a pattern in a text, with tiktoken's opinion on what a letter is."""

    def __init__(self, pattern: str, odd: dict[int, str]):
        self.pattern, self.odd = regex.compile(pattern), odd
        self.far = re.compile("[\U00010000-\U0010ffff" + "".join(chr(c) for c in odd if c < 0x10000) + "]")

    def __call__(self, text: str) -> list[str]:
        if text.isascii() and text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return [text]
        if text.isascii() or not self.far.search(text) or self.odd.keys().isdisjoint(map(ord, text)):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.odd))]


class Encoder:
    """Ids of texts; keeps the ids of words that it has met, up to MEMO words."""

    def __init__(self, v: Vocabulary, pattern: str = public_tokenizers.PATTERN, odd: dict[int, str] | None = None):
        self.v, self.split = v, Splitter(pattern, strangers() if odd is None else odd)
        self.pairs: dict[int, int] = {}
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, words: list[str]) -> None:
        """Words that the memo lacks, each once; those of a few bytes together, by the power of two that holds them."""
        raw = [w.encode() for w in words]
        known = [self.v.ranks.get(b, -1) if self.v.whole or len(b) == 1 else -1 for b in raw]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        kind = np.where(size > TOGETHER, 1 << 30, np.ceil(np.log2(size)).astype(np.int64))
        kind[np.array(known) >= 0] = -1
        for k in np.unique(kind).tolist():
            of = np.flatnonzero(kind == k).tolist()
            if k < 0:
                self.keep([words[i] for i in of], np.array([known[i] for i in of], np.int32), np.ones(len(of), np.int64))
            elif k == 1 << 30:
                self.pairs = self.pairs or dict(zip(self.v.lefts_rights.tolist(), self.v.joined.tolist(), strict=True))
                for i in of:
                    ids = merged_alone(raw[i], self.v, self.pairs)
                    self.keep([words[i]], ids, np.array([len(ids)]))
            else:
                step = max(1, (1 << 19) >> k)
                for at in range(0, len(of), step):
                    part = of[at : at + step]
                    self.keep([words[i] for i in part], *merged_together([raw[i] for i in part], self.v))

    def keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.memo.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has."""
        if len(self.memo) > MEMO:
            self.clear()
        at = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        lacks = np.flatnonzero(at < 0)
        if len(lacks):
            new = [words[i] for i in lacks.tolist()]
            self.learn(list(dict.fromkeys(new)))
            at[lacks] = np.fromiter(map(self.memo.__getitem__, new), np.int64, len(new))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after the other, and how many each has; of texts that are short and not too many."""
        words = [self.split(t) for t in texts]
        flat, sizes = self.of_words([w for of in words for w in of])
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, words)])]
        return flat, np.diff(ends)

    def encode_words(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """encode_flat() of a blank and each chunk, for many very short chunks: they are split as one text.

        Those with white space at either end, or the sign put between them, are split by themselves, as a run of
        white space is cut by what follows it.
        """
        plain = [c for c in chunks if c and c[0] > " " and c[-1] > " " and not c[0].isspace() and not c[-1].isspace() and GAP not in c]
        if len(plain) < len(chunks):
            own = set(plain)
            rest = [c for c in chunks if c not in own]
            at = {c: i for i, c in enumerate([*plain, *rest])}
            (x, n), (y, m) = self.encode_words(plain), self.encode_flat([" " + c for c in rest])
            order = np.fromiter(map(at.__getitem__, chunks), np.int64, len(chunks))
            sizes = np.concatenate([n, m])
            starts = np.cumsum(sizes) - sizes
            ends = np.cumsum(sizes[order])
            return np.concatenate([x, y])[np.repeat(starts[order] - ends + sizes[order], sizes[order]) + np.arange(ends[-1])], sizes[order]
        words = self.split("".join(f" {c}{GAP}" for c in chunks))
        flat, sizes = self.of_words(words)
        gaps = np.flatnonzero(np.fromiter(map(GAP.__eq__, words), bool, len(words)))
        taken = np.repeat(np.bincount(gaps, minlength=len(words)) == 0, sizes)
        sizes[gaps] = 0
        return flat[taken], np.diff(np.cumsum(sizes)[gaps], prepend=0)

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text; a null text is empty. Short texts go together to encode_flat(), long ones in pieces."""
        held: list[str] = []
        size = 0

        def flush() -> Iterator[np.ndarray]:
            flat, counts = self.encode_flat(held)
            yield from np.split(flat, np.cumsum(counts)[:-1]) if held else ()
            held.clear()

        for t in texts:
            t = t or ""
            if len(t) <= PIECE:
                held.append(t)
                size += len(t)
                if size > PIECE:
                    yield from flush()
                    size = 0
            else:
                yield from flush()
                yield np.concatenate([self.of_words(self.split(p))[0] for p in pieces(t)])
        yield from flush()


def pieces(text: str) -> Iterator[str]:
    """text in parts of PIECE characters or a little more, each ending where a word ends."""
    at = 0
    while at < len(text):
        m = CUT.search(text, at + PIECE)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def listed(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def encoder(v: Vocabulary, pattern: str = public_tokenizers.PATTERN):
    """A column function from a text to its ids, without special tokens.

    Each match of `pattern` is encoded by itself: one that is a token is that token; else its bytes are merged by
    rank, the leftmost first among equals, until no pair is a token. A null or empty text has no
    ids. The vocabulary is sent to the executors, a few MB whatever the data.
    """
    sent = SparkSession.active().sparkContext.broadcast((v, strangers()))

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = Encoder(sent.value[0], pattern, sent.value[1])
        for texts in batches:
            yield listed(list(e.encode(x.as_py() for x in texts)))
        give_back()

    return encode


def decoder(v: Vocabulary):
    """A column function from ids to bytes; null ids give null. An id that the vocabulary lacks is an error."""
    sent = SparkSession.active().sparkContext.broadcast(v)

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks = sent.value.ranks
        flat = np.frombuffer(b"".join(ranks), np.uint8)
        size_of = np.zeros(max(ranks.values()) + 1, np.int64)
        size_of[list(ranks.values())] = list(map(len, ranks))
        start_of = np.full(len(size_of), -1)
        start_of[list(ranks.values())] = np.cumsum([0, *map(len, ranks)])[:-1]
        for lists in batches:
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            counts = np.array([0 if n is None else n for n in pa.compute.list_value_length(lists).to_pylist()], np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(size_of) or start_of[ids].min() < 0):
                raise ValueError("an id that the vocabulary lacks")
            sizes = size_of[ids]
            ends = np.cumsum(sizes)
            data = flat[np.repeat(start_of[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
            offsets = np.concatenate([[0], ends])[np.cumsum([0, *counts])].astype(np.int32)
            valid = None if not lists.null_count else pa.py_buffer(np.packbits(lists.is_valid().to_numpy(zero_copy_only=False), bitorder="little").tobytes())
            yield pa.Array.from_buffers(pa.binary(), len(lists), [valid, pa.py_buffer(offsets), pa.py_buffer(data)])
        give_back()

    return decode


def encode_documents(docs: DataFrame, vocabulary_path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids, decoded): encoder() and decoder() on docs (doc_id, text).

    Whole texts are read; a null text is empty and has no ids. Repeated rows each get a row,
    other columns are ignored, no rows give no rows. The driver reads the file of ranks.
    """
    small_batches(docs.sparkSession)
    v = read_vocabulary(vocabulary_path or public_tokenizers.path(VOCABULARY))
    return docs.select("doc_id", encoder(v, pattern)("text").alias("ids")).withColumn("decoded", decoder(v)("ids"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = encode_documents(table(spark, sf_dir, "documents"))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return r.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
