"""Operator 10: language ID by unigrams summed over all segmentations into pieces of a public vocabulary."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import percentiles
from .shared import give_back, small_batches, table, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Letters that are summed over at a time; runs that are summed together; words, and characters of them, that a worker keeps with the scores of their runs.
RUN, TOGETHER, CACHE, CACHE_CHARS = 32, 8_000, 120_000, 8 << 20
#: Added to every piece's count; the probability of a character that no piece has.
SMOOTH, UNKNOWN = 0.05, 1e-7
#: A floor is calibrated on so many training documents at least, and lies so many times as far under the median as the 5th percentile, or so far at least;
#: a document of fewer letters than SHORT has a wider one, as its mean varies more.
CALIBRATE, SLACK, LEAST_SLACK, SHORT = 100, 5.0, 1.5, 100
LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"
#: By such steps sums over long runs are kept from vanishing.
SCALE = 1e60


def pieces(path: str) -> list[str]:
    """The lower-cased pieces of letters of a sentencepiece vocabulary, with or without the sign of a word's start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_byte(i) and not sp.is_unknown(i)}
    return sorted(p for p in found if LETTERS.fullmatch(p.removeprefix(START)))


class Unigrams:
    """Probabilities of pieces by language and what follows from them for words."""

    def __init__(self, langs: list[str], table: dict[str, np.ndarray]):
        self.langs, self.table = langs, table
        self.longest = max(map(len, table), default=1)
        self.unknown = np.full(len(langs), UNKNOWN)

    def edges(self, word: str) -> list[list[tuple[int, str | None, np.ndarray]]]:
        """For each place the pieces that end there: (where it starts, piece, probabilities)."""
        out: list = [[] for _ in range(len(word) + 1)]
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + self.longest) + 1):
                p = self.table.get(word[i:j])
                if p is not None:
                    out[j].append((i, word[i:j], p))
            if not any(a == i for a, _, _ in out[i + 1]):
                out[i + 1].append((i, None, self.unknown))
        return out

    def forward(self, edges: list) -> list[np.ndarray]:
        alpha = [np.ones(len(self.langs))]
        for ends in edges[1:]:
            a = alpha[ends[0][0]] * ends[0][2]
            for i, _, p in ends[1:]:
                a = a + alpha[i] * p
            alpha.append(a)
        return alpha

    def expected(self, run: str, lang: int) -> dict[str, float]:
        """Expected counts of pieces in a run under one language, over all its segmentations."""
        word = START + run
        edges = [[(i, piece, float(p[lang])) for i, piece, p in ends] for ends in self.edges(word)]
        n, out = len(word), {}
        # A place's sums are kept as a number of about 1 and a power of SCALE, so that runs of any length stay within floats.
        alpha, up = [1.0] + [0.0] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            top = max(up[i] for i, _, _ in edges[j])
            x = sum(alpha[i] * p * SCALE ** (up[i] - top) for i, _, p in edges[j])
            while 0 < x < 1 / SCALE:
                x, top = x * SCALE, top - 1
            alpha[j], up[j] = x, top
        beta, down = [0.0] * n + [1.0], [0] * (n + 1)
        from_here: list[list] = [[] for _ in range(n + 1)]
        for j in range(1, n + 1):
            for i, piece, p in edges[j]:
                from_here[i].append((j, piece, p))
        for i in range(n - 1, -1, -1):
            if not from_here[i]:
                continue
            top = max(down[j] for j, _, _ in from_here[i])
            x = sum(p * beta[j] * SCALE ** (down[j] - top) for j, _, p in from_here[i])
            while 0 < x < 1 / SCALE:
                x, top = x * SCALE, top - 1
            beta[i], down[i] = x, top
        whole, at = max(alpha[n], 1e-300), up[n]
        for i in range(n):
            for j, piece, p in from_here[i]:
                if piece and (share := alpha[i] * p * beta[j] / whole * SCALE ** (up[i] + down[j] - at)):
                    out[piece] = out.get(piece, 0.0) + share
        return out


class Scorer:
    """log_probabilities() of many runs of letters at once: the forward algorithm over arrays."""

    def __init__(self, model: Unigrams):
        rng = np.random.default_rng(5)
        self.base, self.salt = np.uint64(int(rng.integers(1 << 40, 1 << 62)) | 1), np.uint64(int(rng.integers(1 << 40, 1 << 62)))
        self.width, self.longest = len(model.langs), model.longest
        names = list(model.table)
        self.place = {name: i for i, name in enumerate(names)}
        self.chance = np.array([model.table[p] for p in names]).reshape(len(names), self.width)
        prefixes: dict[int, int] = {}
        base, salt, whole = int(self.base), int(self.salt), (1 << 64) - 1
        for n, name in enumerate(names):
            h = 0
            for at, c in enumerate(name):  # step() in Python's numbers: single ones of numpy's are slow
                h = ((h + ord(c) + salt) * base) & whole
                h ^= h >> 31
                if at == len(name) - 1:
                    prefixes[h] = n
                else:
                    prefixes.setdefault(h, -1)
        self.known = np.array(sorted(prefixes), np.uint64)
        self.piece = np.array([prefixes[h] for h in sorted(prefixes)], np.int64)

    def step(self, h, c):
        with np.errstate(over="ignore"):
            x = (h + c.astype(np.uint64) + self.salt) * self.base
            return x ^ (x >> np.uint64(31))

    def hits(self, texts: list[str]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """By end and size of a piece the texts in which one of that size ends there, and which; -1 is a letter that is no piece."""
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(n) - n
        word = np.repeat(np.arange(len(texts)), n)
        place = np.arange(len(flat)) - first[word]
        # by place, then by text: what ends at one place stands together
        alive = np.argsort(place.astype(np.min_scalar_type(int(n.max(initial=0)))), kind="stable")
        word, place, rest, h = word[alive], place[alive], (n[word] - place)[alive], np.zeros(len(flat), np.uint64)
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for size in range(1, self.longest + 1):
            inside = rest >= size
            alive, word, place, rest, h = alive[inside], word[inside], place[inside], rest[inside], h[inside]
            if not len(alive):
                break
            h = self.step(h, flat[alive + size - 1])
            at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
            prefix = self.known[at] == h if len(self.known) else np.zeros(len(h), bool)
            got = np.where(prefix, self.piece[at], -1) if len(self.known) else np.full(len(h), -1)
            use = got >= 0 if size > 1 else np.ones(len(got), bool)  # a single letter without a piece is unknown
            end, words, pieces_there = place[use] + size, word[use], got[use]
            cuts = [0, *(np.flatnonzero(end[1:] != end[:-1]) + 1).tolist(), len(end)] if len(end) else [0]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                found[int(end[lo]), size] = words[lo:hi], pieces_there[lo:hi]
            alive, word, place, rest, h = alive[prefix], word[prefix], place[prefix], rest[prefix], h[prefix]
        return found

    def summed(self, texts: list[str]) -> np.ndarray:
        """Log probabilities of texts, a row each: sums over all segmentations, RUN letters at a time.

        Between steps the sums at the last places, as many as a piece is long, go on, divided by
        the largest of them, whose logarithm is kept: no piece is cut and nothing vanishes.
        """
        chance = np.vstack([self.chance, np.full((1, self.width), UNKNOWN)])  # row -1
        out = np.zeros((len(texts), self.width))
        live, logs, at = np.arange(len(texts)), np.zeros((len(texts), self.width)), 0
        tail = np.ones((1, len(texts), self.width))  # the sum at place 0
        while len(live):
            lead = len(tail) - 1
            subs = [texts[i][at - lead : at + RUN + 1] for i in live.tolist()]
            n = np.fromiter(map(len, subs), np.int64, len(subs))
            hits, most = self.hits(subs), int(n.max())
            alpha = np.zeros((most + 1, len(live), self.width))
            alpha[: lead + 1] = tail
            for e in range(lead + 1, most + 1):
                for size in range(1, min(e, self.longest) + 1):
                    if (e, size) in hits:
                        w, piece = hits[e, size]
                        alpha[e, w] += alpha[e - size, w] * chance[piece]
            at += RUN + 1
            done = np.array([len(texts[i]) <= at for i in live.tolist()])
            out[live[done]] = np.log(np.maximum(alpha[n[done], np.flatnonzero(done)], 1e-300)) + logs[done]
            tail = alpha[max(0, most - self.longest + 1) :, ~done]
            largest = np.maximum(tail.max(axis=0, initial=0.0), 1e-300)
            live, logs, tail = live[~done], logs[~done] + np.log(largest), tail / largest
        return out

    def counts(self, runs: list[str], n: list[int], lang: int, first: bool) -> np.ndarray:
        """By piece its expected count in runs, each n times, under one language, over all segmentations, or, if `first`, how often it occurs; runs of RUN letters at most."""
        out = np.zeros(len(self.chance))
        chance = np.append(self.chance[:, lang], UNKNOWN)  # place -1
        order = np.argsort(np.fromiter(map(len, runs), np.int64, len(runs)), kind="stable")
        for lo in range(0, len(order), 20_000):
            part = order[lo : lo + 20_000].tolist()
            words, times = [START + runs[i] for i in part], np.array([n[i] for i in part], np.float64)
            hits, lengths = self.hits(words), np.fromiter(map(len, words), np.int64, len(words))
            most, each = int(lengths.max()), np.arange(len(words))
            alpha, beta = np.zeros((most + 1, len(words))), np.zeros((most + 1, len(words)))
            alpha[0], beta[lengths, each] = 1.0, 1.0
            steps = [(e, size, *hits[e, size]) for e in range(1, most + 1) for size in range(1, min(e, self.longest) + 1) if (e, size) in hits]
            for e, size, w, piece in steps if not first else ():
                alpha[e, w] += alpha[e - size, w] * chance[piece]
            whole = np.maximum(alpha[lengths, each], 1e-300)
            for e, size, w, piece in reversed(steps):
                known = piece >= 0
                if first:
                    share = times[w]
                else:
                    after = chance[piece] * beta[e, w]
                    beta[e - size, w] += after
                    share = alpha[e - size, w] * after / whole[w] * times[w]
                out += np.bincount(piece[known], share[known], len(out))
        return out

    def log_probabilities(self, runs: list[str]) -> np.ndarray:
        """Log probabilities of runs of letters, each with a START before it, a row each; runs of like length are summed together, so few that their sums stay in a processor's cache."""
        out = np.zeros((len(runs), self.width))
        order = np.argsort(np.fromiter(map(len, runs), np.int64, len(runs)), kind="stable")
        for lo in range(0, len(order), TOGETHER):
            part = order[lo : lo + TOGETHER]
            out[part] = self.summed([START + runs[i] for i in part.tolist()])
        return out


class Places(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def runs_of(words: Counter) -> Counter:
    """Runs of letters of counted words, counted."""
    found: Counter = Counter()
    for word, n in words.items():
        for run in LETTERS.findall(word):
            found[run] += n
    return found


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training(docs: DataFrame) -> DataFrame:
    """The labelled documents that are not held out, all of them."""
    return docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def train(docs: DataFrame, path: str = VOCABULARY, rounds: int = 1) -> Unigrams:
    """Piece probabilities by language from the labelled documents that are not held out, all of them.

    Counts start from every occurrence of every piece and are sharpened by `rounds` rounds of
    expectation over all segmentations. The driver gets one number a piece and language.
    """
    small_batches(docs.sparkSession)
    known = training(docs)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counted: dict[str, Counter] = {}  # words first: a run is looked for once in each

        def found() -> Iterator[pd.DataFrame]:
            for lang, c in counted.items():
                runs = runs_of(c)
                if runs:
                    yield pd.DataFrame({"lang": lang, "run": list(runs), "n": list(runs.values())})
            counted.clear()

        for f in batches:
            for lang, text in zip(f["lang"], f["text"], strict=True):
                counted.setdefault(lang, Counter()).update(text.lower().split())
            if sum(map(len, counted.values())) > CACHE:
                yield from found()
        yield from found()

    seen = written(known.select("lang", "text").mapInPandas(words, "lang string, run string, n long").groupBy("lang", "run").agg(F.sum("n").alias("n")))
    langs = sorted(r[0] for r in seen.select("lang").distinct().collect())
    table = dict.fromkeys(pieces(path))
    flat = {p: np.ones(len(langs)) for p in table}
    model = Unigrams(langs, flat)
    for step in range(rounds + 1):

        shared = docs.sparkSession.sparkContext.broadcast((model, Scorer(model)))

        def counts(batches: Iterator[pd.DataFrame], shared=shared, first: bool = step == 0) -> Iterator[pd.DataFrame]:
            model, scorer = shared.value
            names, sums = list(scorer.place), {}
            for f in batches:
                for lang, g in f.groupby("lang", sort=False):
                    at, got = model.langs.index(lang), sums.setdefault(lang, np.zeros(len(names)))
                    short = g["run"].str.len() <= RUN
                    if short.any():
                        got += scorer.counts(g["run"][short].tolist(), g["n"][short].tolist(), at, first)
                    for run, n in zip(g["run"][~short], g["n"][~short], strict=True):
                        if first:
                            found = Counter(piece for ends in model.edges(START + run) for _, piece, _ in ends if piece)
                        else:
                            found = model.expected(run, at)
                        for piece, e in found.items():
                            got[scorer.place[piece]] += n * e
            for lang, got in sums.items():
                some = np.flatnonzero(got)
                yield pd.DataFrame({"lang": lang, "piece": [names[i] for i in some], "n": got[some]})

        sums = seen.repartition("run").mapInPandas(counts, "lang string, piece string, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        counted = {p: np.full(len(langs), SMOOTH) for p in table}
        for lang, piece, n in sums:
            counted[piece][langs.index(lang)] += n
        whole = sum(counted.values()) if counted else 1.0
        model = Unigrams(langs, {p: c / whole for p, c in counted.items()})
    return model


def predictor(spark: SparkSession, model: Unigrams):
    """A column function from a text to a struct (lang_pred, score, mean, letters).

    A text's score is the product over its runs of letters of their probability, summed over
    all segmentations into pieces; languages have equal prior chances, and score is the
    chance of the one predicted, given that it is one of them. A text that is null or has no
    letter, or a model without languages, gives `und` and 0. Ties go to the first language
    by code point. Whole texts count; runs are scored once for all texts worked on together.
    mean is the log probability a letter under lang_pred, 0 for `und`: unlike score it falls
    with texts of none of the languages. letters is their number.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.langs, Scorer(model) if model.langs else None))

    @F.pandas_udf("lang_pred string, score double, mean double, letters long")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, scorer = shared.value
        words, runs, chars = Places(), Places(), 0
        values, sizes = np.zeros((0, len(langs))), np.zeros(0, np.int64)
        in_word, run_ids = np.zeros(0, np.int64), np.zeros(0, np.int64)  # by word its number of runs; their places, word after word
        for texts in batches:
            preds, scores, means, letters, at = [], [], [], [], 0
            while at < len(texts):
                if len(words) > CACHE or chars > CACHE_CHARS:
                    words, runs, chars = Places(), Places(), 0
                    values, sizes = np.zeros((0, len(langs))), np.zeros(0, np.int64)
                    in_word, run_ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
                said: list[int] = []
                stops: list[int] = []
                while at < len(texts) and len(said) < 300_000:
                    said += map(words.__getitem__, (texts.iat[at] or "").lower().split())
                    stops.append(len(said))
                    at += 1
                new = list(islice(words, len(in_word), None))
                chars += sum(map(len, new))
                found = [LETTERS.findall(w) for w in new]
                in_word = np.append(in_word, np.fromiter(map(len, found), np.int64, len(found)))
                run_ids = np.append(run_ids, np.fromiter((runs[r] for w in found for r in w), np.int64))
                # each word's runs in its place: all runs of the texts, in order
                which = np.array(said, np.int64)
                n_runs = in_word[which]
                upto = np.cumsum(n_runs)
                ids = run_ids[np.repeat((np.cumsum(in_word) - in_word)[which] - (upto - n_runs), n_runs) + np.arange(n_runs.sum())]
                ends = np.append(0, upto)[stops]
                if scorer is None or not len(ids):
                    preds += ["und"] * len(ends)
                    scores += [0.0] * len(ends)
                    means += [0.0] * len(ends)
                    letters += [0] * len(ends)
                    continue
                fresh = list(islice(runs, len(values), None))
                sizes = np.append(sizes, np.fromiter(map(len, fresh), np.int64, len(fresh)))
                values = np.vstack([values, scorer.log_probabilities(fresh)])
                lengths = np.diff([0, *ends])
                some = np.flatnonzero(lengths)
                totals = np.zeros((len(ends), scorer.width))
                starts = (ends - lengths)[some]
                totals[some] = np.add.reduceat(values[ids], starts, axis=0)
                n_letters = np.zeros(len(ends), np.int64)
                n_letters[some] = np.add.reduceat(sizes[ids], starts)
                best = totals.argmax(axis=1)
                chance = 1.0 / np.exp(np.minimum(totals - totals.max(axis=1, keepdims=True), 0)).sum(axis=1)
                preds += [langs[b] if n else "und" for b, n in zip(best, lengths, strict=True)]
                scores += [float(c) if n else 0.0 for c, n in zip(chance, lengths, strict=True)]
                means += (totals.max(axis=1) / np.maximum(n_letters, 1)).tolist()
                letters += n_letters.tolist()
            yield pd.DataFrame({"lang_pred": preds, "score": scores, "mean": means, "letters": letters})
        words.clear()
        runs.clear()
        give_back()

    return predict.asNondeterministic()  # else a condition on its result would be evaluated by a second run of it


def floors(judged: DataFrame) -> dict[str, tuple[float, float]]:
    """By language (median, slack) of mean of its training documents, all of them; languages with few have those of all, and with few in all none.

    judged: documents with predictor()'s struct as _taskloom_judged. A text of a language has a mean of median - slack or more, see likely().
    """
    p = F.col("_taskloom_judged")
    means = training(judged).where(p["letters"] > 0).select("lang", p["mean"].alias("mean"))
    n = {r[0]: r[1] for r in means.groupBy("lang").agg(F.count("*")).collect()}
    if sum(n.values()) < CALIBRATE:
        return {}
    at = (0.5, 0.05)
    stats = {r[0]: r[1] for r in percentiles(means, "lang", "mean", at).collect()}
    whole = percentiles(means.withColumn("lang", F.lit("")), "lang", "mean", at).first()[1]
    used = {lang: stats[lang] if n[lang] >= CALIBRATE else whole for lang in n}
    return {lang: (mid, max(LEAST_SLACK, SLACK * (mid - low))) for lang, (mid, low) in used.items()}


def likely(judged: Column, by_lang: dict[str, tuple[float, float]]) -> Column:
    """Whether a text that predictor() judged is probable, letter by letter, in the language predicted; true where no floor is known."""
    wider = F.sqrt(F.lit(float(SHORT)) / F.least(F.lit(SHORT), F.greatest(F.lit(1), judged["letters"])))
    low = F.lit(True)
    for lang, (mid, slack) in by_lang.items():
        low = F.when(judged["lang_pred"] == lang, judged["mean"] >= F.lit(mid) - F.lit(slack) * wider).otherwise(low)
    return low


def identify(docs: DataFrame, model: Unigrams) -> DataFrame:
    """(doc_id, lang_pred, score): predictor() on docs (doc_id, text; other columns are ignored). No rows give no rows."""
    p = docs.select("doc_id", predictor(docs.sparkSession, model)("text").alias("p"))
    return p.select("doc_id", "p.lang_pred", "p.score")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
