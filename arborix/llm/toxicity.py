"""Abusive, hateful or sexual content (problem 8): a score for every document and rates per source.

A linear classifier over hashed word features of passages is trained in numpy by non-negative positive-unlabelled
learning: passages of documents reviewed as abusive are the positives, the passages of all documents are unlabelled, and
the risk estimator is corrected by the class prior, which is estimated, and kept from going below zero. Passages of
documents reviewed as clean are a further, negative sample. A review says only that a document holds such a passage
somewhere, so the passages that the last model finds worst stand for their document. A document's score is that of its
worst passage.

The text is read once for the features of the reviewed documents and once for all documents: only features that are
clearly more frequent in abusive documents have a weight, so a passage comes down to its pattern of such features, most
to none. Counted patterns stand for all passages of all documents in the risk, and scores come from the written patterns.
Models of FOLDS parts of the reviews, each fitted without one part, are averaged; each has its limit set on its own part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.llm.canonical import Canonicalizer, tables
from arborix.runtime import materialize

#: Reviewed documents of each kind that are fitted on: those with the smallest hashes of ids.
MOST_REVIEWED = 20_000
#: Parts of the reviewed documents; a model is fitted without each.
FOLDS = 4
FEATURES = 1 << 20
PASSAGE_WORDS = 24
#: A feature has a weight if it is in so many documents reviewed as abusive and so many times as frequent there.
LEAST_POSITIVE, LEAST_LIFT = 2, 2.5
#: Steps and rate of the fit, and how strongly weights are held at the logarithm of the lift, over LIFT_SCALE.
STEPS, RATE, ANCHOR, LIFT_SCALE = 120, 0.02, 0.03, 4.0
ROUNDS = 2
#: Share of the risk that the passages reviewed as clean make up.
CLEAN_SHARE = 0.3
#: The class prior is the least ratio of unlabelled to positive documents above any limit that this share of the positive reaches.
LEAST_REACH = 0.3
#: Different patterns that the driver holds; the gradients of more are summed in the executors, step by step.
LOCAL_PATTERNS = 1_000_000
#: Chunks of text that a worker remembers before it begins anew.
MOST_CHUNKS = 300_000
_BINS, _SPAN = 6000, 30.0

_SENTENCE = re.compile(r"[\r\n]+|(?<=[.!?…])\s+|\x00")
_CHUNK = re.compile(r"[^\s/\\_|,;:()\[\]{}<>\"“”„«»=+`~#]+")
#: Stands for the end of a sentence or line; canonical texts hold no such character.
_BREAK = "\x00"
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][ \t]){2,}[^\W\d_](?![^\s.,;:!?])")
_DOTTED = re.compile(r"(?:[^\W_][.\-*·'’]){2,}[^\W_]")
_LEET = str.maketrans("013457@$!|", "oieastasil")
_EDGE = ".!?'’‘-–—…*&%^"
_HEX = re.compile(r"[0-9a-f]+")
_RUN = re.compile(r"(.)\1+")


def _chunks(text: str) -> list[str]:
    """Chunks of a text in lower case, spaced letters joined, with a _BREAK between sentences and lines."""
    text = text.casefold()
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: re.sub(r"\s", "", m.group()), text)
    return _CHUNK.findall(_SENTENCE.sub(f" {_BREAK} ", text))


def words_of(passage: str) -> list[str]:
    """Words in lower case with disguises undone: spaced or dotted letters, digits and signs for letters, stars.

    Numbers become "#", a word with stars inside becomes its visible ends around a star.
    """
    return [w for chunk in _chunks(passage) if chunk != _BREAK for w in _plain(chunk)]


def _plain(chunk: str) -> tuple[str, ...]:
    chunk = chunk.strip(_EDGE)
    if not chunk:
        return ()
    if _DOTTED.fullmatch(chunk) and not chunk[0].isdigit():
        chunk = re.sub(r"[.\-*·'’]", "", chunk)
    if "*" in chunk:
        return (re.sub(r"\*+", "*", chunk),)
    if chunk.isalpha():
        return (chunk,)
    letters = sum(map(str.isalpha, chunk))
    if not letters or (len(chunk) >= 8 and _HEX.fullmatch(chunk)):
        return ("#",)
    if letters * 2 >= len(chunk) and re.fullmatch(r"[^\W_](?:[\w@$!|]*[\w@$|])?", chunk) and re.search(r"[\d@$!|]", chunk):
        return (chunk.translate(_LEET),)
    return tuple(p if p.isalpha() else "#" for p in re.findall(r"[^\W\d_]+|\d+", chunk))


def passages_of(text: str, plain: Callable[[str], tuple] = _plain) -> list[list]:
    """A canonical text's passages: sentences and lines, long ones in overlapping windows. No words, no passages."""
    out: list[list] = []
    words: list = []
    for chunk in [*_chunks(text), _BREAK]:
        if chunk != _BREAK:
            words += plain(chunk)
        elif words:
            half = PASSAGE_WORDS // 2
            out += [words] if len(words) <= PASSAGE_WORDS else [words[i : i + PASSAGE_WORDS] for i in range(0, len(words) - half, half)]
            words = []
    return out


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (FEATURES - 1)


class Lexicon(dict):
    """Word numbers of chunks, with each word's hash and slots, worked out when a chunk is first met."""

    def __init__(self) -> None:
        super().__init__()
        self.number: dict[str, int] = {}
        self.codes: list[int] = []
        self.own: list[list[int]] = []

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        out = self[chunk] = tuple(map(self.word, _plain(chunk)))
        return out

    def word(self, word: str) -> int:
        """A word's slots: itself without doubled letters, with inner letters in any order, its parts of four letters."""
        n = self.number.setdefault(word, len(self.codes))
        if n == len(self.codes):
            plain = _RUN.sub(r"\1", word)
            out = {_slot("w " + plain)} if word != "#" else set()
            if len(word) > 3:
                edged = f"^{plain}$"
                out |= {_slot("s " + plain[0] + "".join(sorted(plain[1:-1])) + plain[-1]), *(_slot("c " + edged[i : i + 4]) for i in range(len(edged) - 3))}
            if "*" in word and len(word) > 1:
                out.add(_slot("masked"))
            self.codes.append(zlib.crc32(plain.encode()))
            self.own.append(list(out))
        return n


def _pair_slots(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(kind)) * np.uint64(0xBF58476D1CE4E5B9)
    return (((x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) % np.uint64(FEATURES)).astype(np.int64)


def slots_of(passages: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Passage numbers and slots of all features of passages of words, not in order and repeated."""
    words = Lexicon()
    return _slots([[words.word(w) for w in p] for p in passages], words)


def _slots(passages: list[list[int]], words: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """The same of passages of word numbers: words, neighbours, words with one between."""
    size = np.fromiter(map(len, passages), np.int64, len(passages))
    used, word = np.unique(np.fromiter(chain.from_iterable(passages), np.int64, int(size.sum())), return_inverse=True)
    own = [words.own[w] for w in used]
    code = np.array([words.codes[w] for w in used], np.uint64)[word] if len(used) else np.zeros(0, np.uint64)
    many = np.fromiter(map(len, own), np.int64, len(own))
    flat = np.fromiter(chain.from_iterable(own), np.int64, int(many.sum()))
    row = np.repeat(np.arange(len(passages)), size)
    each = many[word] if len(word) else np.zeros(0, np.int64)
    first = np.cumsum(many) - many
    at = np.repeat((first[word] if len(word) else each) - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    end = np.cumsum(size)
    some = np.flatnonzero(size)
    edge = np.full(len(some), 7, np.uint64)
    next_, skip = row[1:] == row[:-1], row[2:] == row[:-2]
    rows = [np.repeat(row, each), row[1:][next_], row[2:][skip], some, some]
    slots = [flat[at], _pair_slots(code[:-1], code[1:], 1)[next_], _pair_slots(code[:-2], code[2:], 2)[skip], _pair_slots(edge, code[(end - size)[some]], 3), _pair_slots(code[end[some] - 1], edge, 3)]
    return np.concatenate(rows), np.concatenate(slots)


class Texts:
    """Passages and slots of a batch of texts, each passage of a text once."""

    def __init__(self) -> None:
        self.make, self.words = Canonicalizer(tables()), Lexicon()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text of each passage; passage numbers and slots."""
        if len(self.words) > MOST_CHUNKS:
            self.words = Lexicon()
        own: list[int] = []
        passages: list[list[int]] = []
        for i, text in enumerate(_canonical(self.make, texts)):
            different = {tuple(p): p for p in passages_of(text, self.words.__getitem__)}
            own += [i] * len(different)
            passages += different.values()
        return np.array(own, np.int64), *_slots(passages, self.words)


def _canonical(make: Canonicalizer, texts: list[str | None]) -> list[str]:
    out = [t or "" for t in texts]
    at = [i for i, t in enumerate(out) if not t.isascii()]
    for i, t in zip(at, make([out[i] for i in at]), strict=True):
        out[i] = t
    return out


def _slices(frames: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    return (f.slice(i, rows) for f in frames for i in range(0, f.num_rows, rows))


class Vocabulary(NamedTuple):
    """Slots that have a weight, and the reviewed documents of each part, and of the clean, with each of them."""

    slots: np.ndarray
    positive: np.ndarray
    clean: np.ndarray
    positives: np.ndarray
    cleans: int

    def start(self, without: int) -> np.ndarray:
        """First weights of the model without a part: the logarithm of how many times as frequent a feature is."""
        keep = np.arange(FOLDS) != without
        expected = self.positives[keep].sum() * (self.clean + 0.5) / (self.cleans + 1)
        return np.log((self.positive[:, keep].sum(1) + 1) / (expected + 1)) / LIFT_SCALE


def vocabulary(documents: DataFrame, picked: DataFrame) -> Vocabulary:
    """Features of reviewed documents, counted where the documents are: documents of doc_id, t; picked of doc_id, kind."""
    reviewed = documents.join(F.broadcast(picked), "doc_id").select("t", "kind")

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, seen, n = Texts(), np.zeros((FOLDS + 1, FEATURES), np.int32), np.zeros(FOLDS + 1, np.int64)
        for f in _slices(frames):
            kind = f.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            own, rows, slots = read(f.column(0).to_pylist())
            pair = np.unique(own[rows] * FEATURES + slots)
            np.add.at(seen, (kind[pair // FEATURES], pair % FEATURES), 1)
            n += np.bincount(kind, minlength=FOLDS + 1)
        slots = np.flatnonzero(seen.any(0))
        columns = [np.r_[slots, -1], *(np.r_[seen[k, slots], n[k]] for k in range(FOLDS + 1))]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["slot", *kinds])

    kinds = [f"k{k}" for k in range(FOLDS + 1)]
    counted = reviewed.mapInArrow(count, "slot long, " + ", ".join(f"{k} long" for k in kinds)).groupBy("slot").agg(*[F.sum(k).alias(k) for k in kinds])
    positive = sum(F.col(k) for k in kinds[:FOLDS])
    # at most FEATURES rows
    kept = counted.filter((F.col("slot") < 0) | (positive >= LEAST_POSITIVE)).orderBy("slot").toArrow()
    table = np.array([c.to_numpy() for c in kept.columns], np.int64).T
    n = table[0, 1:] if len(table) else np.zeros(FOLDS + 1, np.int64)
    table = table[1:]
    expected = n[:FOLDS].sum() / (n[FOLDS] + 1) * (table[:, -1] + 0.5)
    table = table[table[:, 1:-1].sum(1) + 1 >= LEAST_LIFT * (expected + 1)]
    return Vocabulary(table[:, 0], table[:, 1 : FOLDS + 1], table[:, FOLDS + 1], n[:FOLDS], int(n[FOLDS]))


def passage_patterns(documents: DataFrame, slots: np.ndarray) -> DataFrame:
    """Each document's different patterns: doc_id, source, passages (their number), patterns (places of weighted features)."""
    shared = documents.sparkSession.sparkContext.broadcast(slots)

    def reduce(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, n = Texts(), max(1, len(shared.value))
        place = np.full(FEATURES, -1, np.int64)
        place[shared.value] = np.arange(len(shared.value))
        for f in _slices(frames):
            own, rows, slots = read(f.column(2).to_pylist())
            at = place[slots]
            pair = np.unique(rows[at >= 0] * n + at[at >= 0])
            rows, at = pair // n, pair % n
            ends = np.flatnonzero(np.diff(rows, append=-1)) + 1
            holder, starts = own[rows[ends - 1]] if len(ends) else np.zeros(0, np.int64), np.r_[0, ends[:-1]] if len(ends) else ends
            seen: list[dict[bytes, list[int]]] = [{} for _ in range(f.num_rows)]
            for d, a, b in zip(holder, starts, ends, strict=True):
                seen[d].setdefault(at[a:b].tobytes(), at[a:b].tolist())
            lists = pa.array([list(x.values()) for x in seen], pa.list_(pa.list_(pa.int32())))
            passages = pa.array(np.bincount(own, minlength=f.num_rows).astype(np.int32))
            yield pa.RecordBatch.from_arrays([f.column(0), f.column(1), passages, lists], names=["doc_id", "source", "passages", "patterns"])

    return materialize(documents.select("doc_id", "source", "t").mapInArrow(reduce, "doc_id long, source string, passages int, patterns array<array<int>>"), "patterns")


class Patterns(NamedTuple):
    """Patterns as rows of places of weights."""

    rows: np.ndarray
    places: np.ndarray
    n: int

    def scores(self, w: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.rows, w[self.places], self.n) + bias

    def back(self, g: np.ndarray, features: int) -> np.ndarray:
        return np.bincount(self.places, g[self.rows], features)


def patterns_of(lists: pa.Array) -> Patterns:
    """From an Arrow array of lists of places."""
    size = np.diff(np.asarray(lists.offsets))
    return Patterns(np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), len(size))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _partial(x: Patterns, weight: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    """Sum of weight * sigmoid(score), its gradient by bias, and by the weights."""
    q = _sigmoid(x.scores(w, bias))
    d = weight * q * (1 - q)
    return np.r_[weight @ q, d.sum(), x.back(d, len(w))]


class Sample(NamedTuple):
    """Counted patterns of passages; passages without a weighted feature are only in total. More than LOCAL_PATTERNS stay a table."""

    x: Patterns | None
    weight: np.ndarray
    total: float
    table: DataFrame | None = None

    def risk(self, w: np.ndarray, bias: float) -> tuple[float, np.ndarray]:
        """The mean of sigmoid(score), that is the risk of calling all negative, and its gradient by (bias, weights)."""
        if self.x is not None:
            sums, held = _partial(self.x, self.weight, w, bias), self.weight.sum()
        else:
            sums, held = self._distributed(w, bias)
        rest = max(0.0, self.total - held)
        q = float(_sigmoid(np.array(bias)))
        sums[:2] += rest * q, rest * q * (1 - q)
        return sums[0] / max(1.0, self.total), sums[1:] / max(1.0, self.total)

    def _distributed(self, w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        shared = self.table.sparkSession.sparkContext.broadcast((w, bias))

        def sums(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, bias = shared.value
            out = np.zeros(len(w) + 3)
            for f in frames:
                weight = f.column(1).to_numpy().astype(float)
                out += np.r_[_partial(patterns_of(f.column(0)), weight, w, bias), weight.sum()]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["i", "x"])

        added = self.table.select("pattern", "n").mapInArrow(sums, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(len(w) + 3)
        for r in added:
            out[r["i"]] = r["x"]
        shared.unpersist()
        return out[:-1], out[-1]


def fit(positive: Sample, unlabelled: Sample, clean: Sample, start: tuple[np.ndarray, float], prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Non-negative PU risk with the sigmoid loss, minimised by Adam over all rows from given weights.

    The risk is prior * R+(P) + max(0, R-(U) - prior * R-(P)); where the second term falls below 0, the step climbs
    against it instead. A share CLEAN_SHARE of the risk is prior * R+(P) + (1 - prior) * R-(N) over passages reviewed as
    clean. Weights are held at their start by ANCHOR, in units of the prior.
    """
    first, (w, bias) = start[0], start
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        (rp, gp), (ru, gu) = positive.risk(w, bias), unlabelled.risk(w, bias)
        # R+ = 1 - R- with the sigmoid loss
        grad = gu - 2 * prior * gp if ru - prior * rp >= 0 else prior * gp - gu
        if clean.total:
            gn = clean.risk(w, bias)[1]
            grad = (1 - CLEAN_SHARE) * grad + CLEAN_SHARE * ((1 - prior) * gn - prior * gp)
        grad = grad / prior + np.r_[0.0, ANCHOR * (w - first)]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        bias, w = bias - move[0], w - move[1:]
    return w, float(bias)


class Model(NamedTuple):
    """One row of weights per part, already less the limit and over the spread: above 0 is abusive, 1 the usual height."""

    weights: np.ndarray
    biases: np.ndarray

    def margins(self, x: Patterns) -> np.ndarray:
        return sum((x.scores(w, b) for w, b in zip(self.weights, self.biases, strict=True)), np.zeros(x.n)) / max(1, len(self.weights))


def _worst(scores: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, -np.inf)
    np.maximum.at(out, owner, scores)
    return out


def _heights(table: DataFrame, models: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """Documents above each bin of the worst passage's score, for each model, over all documents."""
    shared = table.sparkSession.sparkContext.broadcast(models)

    def bins(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(shared.value), _BINS), np.int64)
        for f in frames:
            lists = f.column(0)
            owner = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            x = patterns_of(lists.flatten())
            for k, (w, bias) in enumerate(shared.value):
                out[k] += np.bincount(_bin(_worst(x.scores(w, bias), owner, len(lists))), minlength=_BINS)
        model, at = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(model), pa.array(at), pa.array(out[model, at])], names=["model", "bin", "n"])

    out = np.zeros((len(models), _BINS))
    # at most len(models) * _BINS rows
    for r in table.select("patterns").mapInArrow(bins, "model long, bin long, n long").groupBy("model", "bin").agg(F.sum("n").alias("n")).collect():
        out[r["model"], r["bin"]] = r["n"]
    return out[:, ::-1].cumsum(1)[:, ::-1]


def _bin(scores: np.ndarray) -> np.ndarray:
    return ((np.clip(scores, -_SPAN, _SPAN - 1e-6) + _SPAN) * (_BINS / (2 * _SPAN))).astype(np.int64)


def _limit(held: np.ndarray, above: np.ndarray) -> tuple[float, float]:
    """Class prior of documents and the score with the best estimated F1, from positive documents not fitted on and all documents.

    Of all documents the share above[t] / above[0] reaches t, of the positive the share q(t); at the highest scores
    nearly all are abusive, so the prior is the least ratio of the two.
    """
    q = np.bincount(_bin(held), minlength=_BINS)[::-1].cumsum()[::-1] / len(held)
    share = above / max(1.0, above[0])
    enough = q >= LEAST_REACH
    prior = float(np.clip((share[enough] / q[enough]).min(), 1e-6, 0.5))
    f1 = 2 * prior * q / (prior + share)
    # the middle of the limits that are as good
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    at = best[len(best) // 2]
    return prior, at * (2 * _SPAN / _BINS) - _SPAN


def train(table: DataFrame, picked: DataFrame, words: Vocabulary) -> Model:
    """Fit the models on written patterns of all documents; picked of doc_id, kind (a part, or FOLDS for clean).

    Without reviews of both kinds, or with too few to give any feature a weight, the model is empty.
    """
    if not len(words.slots) or not words.cleans or np.count_nonzero(words.positives) < 2:
        return Model(np.zeros((0, len(words.slots))), np.zeros(0))
    # bounded by MOST_REVIEWED
    bags = table.join(F.broadcast(picked), "doc_id").select("kind", "passages", "patterns").toArrow().combine_chunks()
    kind = bags["kind"].to_numpy()
    lists = bags["patterns"].combine_chunks() if bags.num_rows else pa.array([], pa.list_(pa.list_(pa.int32())))
    owner = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    inner = lists.flatten()
    known = patterns_of(inner)
    passages = float(table.agg(F.sum("passages")).first()[0] or 0)
    counted = materialize(table.select(F.explode("patterns").alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "pattern-counts")
    if counted.count() <= LOCAL_PATTERNS:
        local = counted.select("pattern", "n").toArrow().combine_chunks()
        unlabelled = Sample(patterns_of(local["pattern"].combine_chunks()), local["n"].to_numpy().astype(float), passages)
    else:
        unlabelled = Sample(None, np.zeros(0), passages, counted)

    def sample(rows: np.ndarray, total: float) -> Sample:
        chosen = inner.take(pa.array(np.flatnonzero(rows)))
        return Sample(patterns_of(chosen), np.ones(len(chosen)), total)

    clean = sample(kind[owner] == FOLDS, float(bags["passages"].to_numpy()[kind == FOLDS].sum()))
    parts = [k for k in range(FOLDS) if words.positives[k]]
    models = [(words.start(k), 0.0) for k in parts]

    def held(k: int, model: tuple[np.ndarray, float]) -> np.ndarray:
        return _worst(known.scores(*model), owner, len(lists))[kind == k]

    limits = [_limit(held(k, m), a) for k, m, a in zip(parts, models, _heights(table, models), strict=True)]
    documents = float(table.count())
    fitted = []
    for k, (w, _), (prior, limit) in zip(parts, models, limits, strict=True):
        start = model = (w, -limit)
        here = (kind[owner] < FOLDS) & (kind[owner] != k)
        for _ in range(ROUNDS):
            s = known.scores(*model)
            chosen = here & (s >= _worst(s, owner, len(lists))[owner] - 1)
            model = fit(sample(chosen, float(chosen.sum())), unlabelled, clean, start, max(1e-9, prior * documents / max(1.0, passages)))
        fitted.append(model)
    out = []
    for k, (w, b), above in zip(parts, fitted, _heights(table, fitted), strict=True):
        own = held(k, (w, b))
        limit = _limit(own, above)[1]
        spread = float(np.median(own[own > limit]) - limit) if (own > limit).any() else 1.0
        out.append((w / max(spread, 1e-6), (b - limit) / max(spread, 1e-6)))
    return Model(np.array([w for w, _ in out]), np.array([b for _, b in out]))


def reviews(labels: DataFrame) -> DataFrame:
    """One verdict a document: doc_id, abusive. Repeated rows count once, null verdicts not at all; ties have none."""
    votes = labels.filter("doc_id IS NOT NULL AND abusive IS NOT NULL").select("doc_id", "reviewer", F.when(F.col("abusive") > 0, 1).otherwise(-1).alias("v")).distinct()
    return votes.groupBy("doc_id").agg(F.sum("v").alias("v")).filter("v <> 0").select("doc_id", (F.col("v") > 0).alias("abusive"))


def picked_reviews(labels: DataFrame, most: int = MOST_REVIEWED) -> DataFrame:
    """At most so many verdicts of each kind: doc_id, kind (the part of an abusive one, FOLDS for a clean one)."""
    verdicts = materialize(reviews(labels).withColumn("h", F.xxhash64("doc_id")), "verdicts")
    parts = [verdicts.filter(F.col("abusive") == F.lit(kind)).orderBy("h", "doc_id").limit(most) for kind in (True, False)]
    part = F.when(F.col("abusive"), F.pmod("h", F.lit(FOLDS))).otherwise(FOLDS).cast("int")
    return materialize(parts[0].unionByName(parts[1]).select("doc_id", part.alias("kind")), "picked")


def scored(documents: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every document with its score: doc_id, source, score (0 to 1), abusive.

    The score is the probability for the worst passage, centred so that 0.5 is the limit; null, empty and wordless texts,
    and texts without any feature of abuse, have score 0, as have all where too little is reviewed to fit a model. Each
    row is scored by itself: whole texts of any length, repeated rows, null ids and sources come out as rows of their own.
    """
    spark: SparkSession = documents.sparkSession
    docs = documents.select(F.col(doc).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("t"))
    picked = picked_reviews(labels)
    words = vocabulary(docs.select("doc_id", "t"), picked)
    table = passage_patterns(docs, words.slots)
    shared = spark.sparkContext.broadcast(train(table, picked, words))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for f in frames:
            lists = f.column(2)
            owner = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            worst = _worst(model.margins(patterns_of(lists.flatten())), owner, len(lists)) if len(model.weights) else np.full(len(lists), -np.inf)
            p = np.where(np.isinf(worst), 0.0, _sigmoid(4 * np.clip(worst, -10, 10)))
            yield pa.RecordBatch.from_arrays([f.column(0), f.column(1), pa.array(p), pa.array(p > 0.5)], names=["doc_id", "source", "score", "abusive"])

    return table.select("doc_id", "source", "patterns").mapInArrow(score, "doc_id long, source string, score double, abusive boolean")


def source_rates(scores: DataFrame) -> DataFrame:
    """Per source, null included: documents, abusive documents, their rate, and the mean score."""
    n, bad = F.count(F.lit(1)), F.count_if("abusive")
    return scores.groupBy("source").agg(n.alias("documents"), bad.alias("abusive"), (bad / n).alias("rate"), F.avg("score").alias("mean_score"))
