"""Operator 12: tokens of two tokenizers aligned by where they end, and counts of the pairs that end together."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Encoder, Vocabulary, strangers, vocabulary_of
from .shared import give_back, new_path, small_batches, table, written

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Chunks that a worker keeps with their alignment, and characters that are cut into chunks at once.
MEMO, PIECE = 400_000, 1 << 20
#: Different pairs that a task counts before it hands them on, and rows of partial counts for which a shard is planned.
PAIRS, SHARD_ROWS = 1 << 20, 1 << 21
#: Both tokenizers have a token's end before a blank that follows what is no white space.
CUT = re.compile(r"(?<=\S) ")
ALIGNED = "n_a long, n_b long, groups string, a array<int>, b array<int>"


@cache
def letters() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones themselves, the others the signs from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Bytes(NamedTuple):
    """The bytes of each id: a slice of `flat`."""

    flat: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    def of(self, ids: np.ndarray) -> np.ndarray:
        return ragged(self.flat, self.starts[ids], self.sizes[ids])


def bytes_of(tokens: list[bytes]) -> Bytes:
    sizes = np.array([len(t) for t in tokens], np.int64)
    return Bytes(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes)


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices values[start : start + size], one after the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def by_byte_level(pairs: list[str]) -> list[bool]:
    """Whether the tokenizers library's byte-level splitting takes each text for one word."""
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    return [len(split(p)) == 1 for p in pairs]


def byte_level_vocabulary(content: bytes) -> Vocabulary:
    """The vocabulary and merges of a byte-level BPE file of the tokenizers library."""
    known = json.loads(content)
    model, by = known["model"], letters()
    split = known["pre_tokenizer"] or {}
    if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or known["normalizer"] or model.get("ignore_merges"):
        raise ValueError("no plain byte-level BPE")
    raw = lambda t: bytes(by[c] for c in t)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return vocabulary_of({raw(t): i for t, i in model["vocab"].items()}, [(raw(x), raw(y)) for x, y in merges])


class Tokenizers:
    """The two tokenizers, and the bytes of their ids. B is given the content of its file."""

    def __init__(self, v: Vocabulary, odd: dict[int, str], pieces: bytes):
        import sentencepiece

        self.a = Encoder(v, odd=odd)
        named = {i: t for t, i in v.ranks.items()}
        self.bytes_a = bytes_of([named.get(i, b"") for i in range(max(named) + 1)])
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = bytes_of([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])
        self.blank = self.b.piece_to_id("▁")
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("a piece goes on after a blank, so texts cannot be cut at blanks")
        most = max(len(self.bytes_a.sizes), len(names))
        self.written = bytes_of([b"%d " % i for i in range(most)])  # the blank stands for a separator

    def aligned(self, chunks: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """(tokens of A and of B by chunk, or -1 where a tokenizer does not give back the bytes; groups by chunk; links by chunk; A's and B's id at each common end)."""
        raw = [b" " + c.encode() for c in chunks]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        a, n_a = self.a.encode_words(chunks)
        pieces = [x or [self.blank] for x in self.b.encode(chunks, num_threads=1)]  # an empty chunk is the blank before it
        n_b = np.fromiter(map(len, pieces), np.int64, len(pieces))
        b = np.fromiter(chain.from_iterable(pieces), np.int64, int(n_b.sum()))
        right = np.ones(len(raw), bool)
        for known, ids, n in ((self.bytes_a, a, n_a), (self.bytes_b, b, n_b)):
            ends = np.concatenate([[0], np.cumsum(known.sizes[ids])])[np.cumsum(n)]
            right &= np.diff(ends, prepend=0) == size
        for known, ids, n in ((self.bytes_a, a, n_a), (self.bytes_b, b, n_b)):
            rows = np.flatnonzero(right)
            if len(rows):
                given = known.of(ids[np.repeat(right, n)]) != np.frombuffer(b"".join(raw[i] for i in rows.tolist()), np.uint8)
                right[rows] = ~np.logical_or.reduceat(given, np.cumsum(size[rows]) - size[rows])
        a, b = a[np.repeat(right, n_a)].astype(np.int64), b[np.repeat(right, n_b)]
        n_a, n_b, size = np.where(right, n_a, 0), np.where(right, n_b, 0), np.where(right, size, 0)
        ends_a, ends_b = np.cumsum(self.bytes_a.sizes[a]), np.cumsum(self.bytes_b.sizes[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
        of_a, of_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        # the groups as text: of each group A's ids, then B's, each with the sign that follows it
        at_a = np.arange(len(a)) + np.concatenate([[0], last_b + 1])[of_a]
        at_b = np.arange(len(b)) + last_a[of_b] + 1
        ids, sign = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        sign[at_a[last_a]], sign[at_b[last_b]] = ord("|"), ord(";")
        text, ends = self.written.of(ids), np.cumsum(self.written.sizes[ids])
        text[ends - 1] = sign
        text = text.tobytes().decode("ascii")
        until = np.concatenate([[0], ends])[np.cumsum(n_a + n_b)].tolist()
        groups = [text[x : y - 1] if y > x else "" for x, y in zip([0, *until], until, strict=False)]
        links = np.diff(np.searchsorted(common, np.cumsum(size), side="right"), prepend=0)
        counts = np.where(right[:, None], np.stack([n_a, n_b], axis=1), -1)
        return counts, groups, links, np.stack([a[last_a], b[last_b]], axis=1).astype(np.int32)


class Aligner:
    """Alignments of texts; keeps those of chunks that it has met, up to MEMO chunks, and of these, when they are too many, the ones met again."""

    def __init__(self, t: Tokenizers):
        self.t = t
        self.memo: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts, self.hits = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        self.starts, self.sizes, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int32)

    def shrink(self) -> None:
        kept = np.flatnonzero(self.hits > 1)
        if len(kept) > MEMO // 2:
            kept = np.sort(kept[np.argpartition(-self.hits[kept], MEMO // 2)[: MEMO // 2]])
        names = list(self.memo)
        self.memo = {names[i]: k for k, i in enumerate(kept.tolist())}
        self.groups = [self.groups[i] for i in kept.tolist()]
        self.links = ragged(self.links, self.starts[kept], self.sizes[kept])
        self.counts, self.sizes, self.hits = self.counts[kept], self.sizes[kept], np.zeros(len(kept), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def learn(self, chunks: list[str]) -> None:
        counts, groups, sizes, links = self.t.aligned(chunks)
        self.memo.update(zip(chunks, range(len(self.groups), len(self.groups) + len(chunks)), strict=True))
        self.groups += groups
        self.counts, self.hits = np.concatenate([self.counts, counts]), np.concatenate([self.hits, np.zeros(len(chunks), np.int64)])
        self.starts = np.concatenate([self.starts, len(self.links) + np.cumsum(sizes) - sizes])
        self.sizes, self.links = np.concatenate([self.sizes, sizes]), np.concatenate([self.links, links])

    def places(self, chunks: list[str]) -> np.ndarray:
        if len(self.memo) > MEMO:
            self.shrink()
        at = np.fromiter(map(self.memo.get, chunks, repeat(-1)), np.int64, len(chunks))
        lacks = np.flatnonzero(at < 0)
        if len(lacks):
            new = [chunks[i] for i in lacks.tolist()]
            self.learn(list(dict.fromkeys(new)))
            at[lacks] = np.fromiter(map(self.memo.__getitem__, new), np.int64, len(new))
        self.hits += np.bincount(at, minlength=len(self.hits))
        return at

    def of(self, texts: Iterable[str | None]) -> list[tuple[int, int, str, np.ndarray]]:
        """(tokens of A, of B, groups, pairs of ids that end together) of each text; zeros and nothing for a text without tokens."""
        nothing = np.zeros((0, 2), np.int32)
        n, groups, links, wrong = [], [], [], set()
        held: list[tuple[int, list[str]]] = []

        def flush() -> None:
            at = self.places([c for _, chunks in held for c in chunks])
            pairs = ragged(self.links, self.starts[at], self.sizes[at])
            ends = np.cumsum([0, *(len(chunks) for _, chunks in held)])
            link_ends = np.concatenate([[0], np.cumsum(self.sizes[at])])[ends].tolist()
            for k, (i, _) in enumerate(held):
                mine = at[ends[k] : ends[k + 1]]
                counts = self.counts[mine]
                if counts.min() < 0:
                    wrong.add(i)
                n[i] += counts.sum(axis=0)
                groups[i].append(";".join(map(self.groups.__getitem__, mine.tolist())))
                links[i].append(pairs[link_ends[k] : link_ends[k + 1]])
            held.clear()

        size = 0
        for i, t in enumerate(texts):
            n.append(np.zeros(2, np.int64))
            groups.append([])
            links.append([nothing])
            for chunks in chunked(t or ""):
                held.append((i, chunks))
                size += len(t)
                if size > PIECE:
                    flush()
                    size = 0
        if held:
            flush()
        return [(0, 0, "", nothing) if i in wrong else (int(x[0]), int(x[1]), ";".join(groups[i]), np.concatenate(links[i])) for i, x in enumerate(n)]


def chunked(text: str) -> Iterator[list[str]]:
    """text, without the blanks it is cut at, in lists of chunks of about PIECE characters."""
    at = 0
    while at < len(text):
        m = CUT.search(text, at + PIECE)
        end = m.start() if m else len(text)
        yield CUT.split(text[at:end])
        at = end + 1
    if text and m:  # a blank at the very end is a chunk without signs
        yield [""]


def align(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, groups, a, b): each text's tokens by both tokenizers, cut into groups where both end.

    byte_level and pieces are paths to a byte-level BPE of the tokenizers library, whose merges operator 11 makes here,
    and to a model for sentencepiece, read by the driver. Each encodes a blank and the text. groups lists the ids of each group as
    `a1,a2|b1`, joined by `;`; a and b hold, for each place where tokens of both end, the two ids.
    Texts that are null, empty or not given back byte by byte have no tokens: 0, 0, '' and empty arrays.
    Repeated rows each get a row, other columns of docs are ignored, no rows give no rows.
    Neither tokenizer has a token across a blank that follows another sign, so the chunks between such
    blanks are encoded by themselves, and those met lately are kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(byte_level or public_tokenizers.path(BYTE_LEVEL), "rb") as f, open(pieces or public_tokenizers.path(PIECES), "rb") as g:
        sent = spark.sparkContext.broadcast((byte_level_vocabulary(f.read()), strangers(by_byte_level), g.read()))  # a few MB, whatever the data

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(Tokenizers(*sent.value))
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                found = aligner.of(t.as_py() for t in part.column("text"))
                offsets = pa.array(np.cumsum([0, *(len(f[3]) for f in found)]).astype(np.int32))
                flat = np.concatenate([f[3] for f in found])
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(flat[:, i]))) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.string()), *lists], names=["doc_id", "n_a", "n_b", "groups", "a", "b"])
        give_back()

    d = docs.select("doc_id", "text")
    return d.mapInArrow(aligned, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {ALIGNED}")


def keys_of(batch: pa.RecordBatch) -> np.ndarray:
    """Packed pairs of a batch's links, B's id in the high half."""
    a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in "ab")
    return b << 32 | a


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of runs of equal keys, which are sorted."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

    for batch in batches:
        k, n = np.unique(keys_of(batch), return_counts=True)
        both = np.concatenate([keys, k])
        order = np.argsort(both, kind="stable")
        keys, counts = summed(both[order], np.concatenate([counts, n])[order])
        if len(keys) > PAIRS:
            yield out()
            keys, counts = keys[:0], counts[:0]
    yield out()
    give_back()


def store(folder: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else re.sub(r"^(\w+):/+", r"\1:///", folder))


class Counts(NamedTuple):
    """Counts of pairs in sorted shards: the folder, each shard's name and first key, and the highest count of each of B's ids."""

    folder: str
    names: list[str]
    firsts: np.ndarray
    best: np.ndarray

    def shard(self, i: int) -> np.ndarray:
        """Sorted keys and their counts; memory-mapped, or read where the store is no file system of this machine."""
        fs, path = store(self.folder)
        if isinstance(fs, LocalFileSystem):
            x = np.memmap(f"{path}/{self.names[i]}", np.int64, "r")
        else:
            with fs.open_input_file(f"{path}/{self.names[i]}") as f:
                x = np.frombuffer(f.readall(), np.int64)
        return x.reshape(2, -1)

    def lookup(self, keys: np.ndarray, shards: dict[int, np.ndarray]) -> np.ndarray:
        """Counts of sorted keys, each of which is in a shard; shards holds those opened so far."""
        out = np.zeros(len(keys), np.int64)
        of = np.searchsorted(self.firsts, keys, side="right") - 1
        for i in np.unique(of).tolist():
            k, n = shards[i] if i in shards else shards.setdefault(i, self.shard(i))
            mine = of == i
            out[mine] = n[np.searchsorted(k, keys[mine])]
        return out


def pair_counts(links: DataFrame) -> Counts:
    """How often each pair of links (a array<int>, b array<int>) occurs over all rows.

    Tasks count by sorting and give partial counts; these are sorted by ranges of keys and the runs of a key summed. Each
    range is written to the shared folder as one file, under a name of its own that a second attempt of a task does not
    share. At the driver are the first key of each shard, and one number for each id of B, which the vocabulary bounds.
    """
    spark = links.sparkSession
    partial = written(links.select("a", "b").mapInArrow(_partial, "key long, n long"))
    folder = new_path(spark)
    shards = max(1, -(-partial.count() // SHARD_ROWS))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [[b.column(i).to_numpy() for i in (0, 1)] for b in batches]
        keys, counts = summed(*(np.concatenate([np.zeros(0, np.int64), *(r[i] for r in rows)]) for i in (0, 1)))
        if len(keys):
            fs, path = store(folder)
            fs.create_dir(path, recursive=True)
            name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
            with fs.open_output_stream(f"{path}/{name}") as f:
                f.write(keys.tobytes())
                f.write(counts.tobytes())
            b = keys >> 32
            first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            n = len(first)
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.full(n, keys[0])), pa.array(b[first]), pa.array(np.maximum.reduceat(counts, first))], names=["name", "first", "b", "best"])

    done = written(partial.repartitionByRange(shards, "key").sortWithinPartitions("key").mapInArrow(shard, "name string, first long, b long, best long"))
    names = done.groupBy("name").agg(F.min("first").alias("first")).orderBy("first").collect()
    top = done.groupBy("b").agg(F.max("best").alias("best")).toPandas()
    best = np.zeros(int(top.b.max()) + 1 if len(top) else 0, np.int64)
    best[top.b.to_numpy(np.int64)] = top.best
    return Counts(folder, [r["name"] for r in names], np.array([r["first"] for r in names], np.int64), best)


def counted(links: DataFrame, counts: Counts) -> DataFrame:
    """links, with n_links, n_best (those whose count is the highest of their B id) and count_sum instead of a and b."""
    sent = links.sparkSession.sparkContext.broadcast(counts)
    kept = [c for c in links.columns if c not in ("a", "b")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, np.ndarray] = {}
        for batch in batches:
            keys, back = np.unique(keys_of(batch), return_inverse=True)
            n = sent.value.lookup(keys, shards)
            best = n == sent.value.best[keys >> 32]
            sizes = pc.list_value_length(batch.column("a")).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            sums = [np.concatenate([[0], np.cumsum(x[back])]) for x in (best.astype(np.int64), n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sizes.astype(np.int64)), *(pa.array(s[ends] - s[ends - sizes]) for s in sums)], names=[*kept, "n_links", "n_best", "count_sum"])

    fields = ", ".join(f"`{c}` {links.schema[c].dataType.simpleString()}" for c in kept)
    return links.mapInArrow(look, f"{fields}, n_links long, n_best long, count_sum long")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    links = written(r.select("doc_id", "n_a", "n_b", F.size("a").cast("long").alias("n_groups"), digest.alias("groups_sha256"), "a", "b"))
    return counted(links, pair_counts(links))
