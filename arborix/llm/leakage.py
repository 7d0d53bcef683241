"""Passages of held-out evaluation items inside documents (problem 6).

The normalised items are indexed in a generalised suffix automaton over words. A document's words are streamed through it
while the length of the longest match that ends at each word is tracked; runs of at least a given length are reported
with all items that hold them, and their spans can be removed. Many items make several automata of bounded size, which each
batch of documents meets one after the other, so that the documents are read and split once and never shuffled.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.llm.canonical import DRAWN_FORMATS, UNDRAWN

#: Consecutive words that make a leak.
LEAST_WORDS = 20
#: Words of items in one automaton: about 60 MB a Python worker. More items are taken in blocks of this size.
BLOCK_WORDS = 100_000
#: Automata that a worker holds at once; of more, each is loaded for a batch and let go again.
RESIDENT = 4
#: Forms of raw words that a worker remembers.
MOST_FORMS = 300_000

# HTML elements that do not break a word.
_INLINE = "a|abbr|b|big|cite|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strike|strong|sub|sup|tt|u|var"
_INLINE_TAG = re.compile(rf"</?(?:{_INLINE})(?:\s[^<>]*)?/?>", re.I)
_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|(?<=\])\([^()\s]*\)")
_INVISIBLE = "".join(re.escape(chr(c)) for c in sorted({*UNDRAWN, *(c for c in range(0x80, 0xFFFF) if unicodedata.category(chr(c)) == "Cf" and c not in DRAWN_FORMATS)}))
_MARKS = "\\u0300-\\u036f\\u20d0-\\u20ff"
_WORD = re.compile(rf"[^\W_][\w{_INVISIBLE}{_MARKS}]*")
_DROP = re.compile(f"[{_INVISIBLE}]+")
_PART = re.compile(r"[^\W_]+")


class Words(NamedTuple):
    words: list[str]
    starts: list[int]
    ends: list[int]
    text: str


def _without_comments(text: str) -> str:
    """Comments of any length become a blank; the text is passed once, also where comments do not end."""
    out, at = [], 0
    while (begin := text.find("<!--", at)) >= 0 and (end := text.find("-->", begin + 4)) >= 0:
        out += [text[at:begin], " "]
        at = end + 3
    return "".join([*out, text[at:]]) if out else text


def words_of(text: str | None) -> Words:
    """Words in their compared form, and their places in the text without markup.

    Words are runs of letters and digits; case, punctuation, markup, line breaks, invisible characters and the Unicode
    form do not count. Null and empty text have no words.
    """
    text = _without_markup(text)
    words, starts, ends = [], [], []
    if text.isascii():
        for m in _PART.finditer(text.lower()):
            words.append(m.group())
            starts.append(m.start())
            ends.append(m.end())
        return Words(words, starts, ends, text)
    for m in _WORD.finditer(text):
        for p in _compared(m.group()):
            words.append(p)
            starts.append(m.start())
            ends.append(m.end())
    return Words(words, starts, ends, text)


def plain_words(text: str | None, known: dict[str, list[str]] | None = None) -> list[str]:
    """The words of words_of() without their places; known keeps the forms of words met before."""
    text = _without_markup(text)
    if text.isascii():
        return _PART.findall(text.lower())
    known = Forms() if known is None else known
    return list(chain.from_iterable(map(known.__getitem__, _WORD.findall(text))))


class Forms(dict):
    """Compared forms of raw words, worked out once; forgotten beyond MOST_FORMS."""

    def __missing__(self, raw: str) -> list[str]:
        if len(self) >= MOST_FORMS:
            self.clear()
        out = self[raw] = _compared(raw)
        return out


def _without_markup(text: str | None) -> str:
    if not text:
        return ""
    if "&" in text and ";" in text:
        text = html.unescape(text)
    if "<" in text or "](" in text:
        text = _MARKUP.sub(" ", _INLINE_TAG.sub("", _without_comments(text)))
    return text


def _compared(raw: str) -> list[str]:
    """A run of word characters as words in compared form."""
    if raw.isascii() and "_" not in raw:
        return [raw.lower()]
    return _PART.findall(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", _DROP.sub("", raw)).casefold()))


class Automaton(NamedTuple):
    """A generalised suffix automaton over word numbers, ready to be matched against."""

    vocabulary: dict[str, int]
    moves: list[dict[int, int]]
    link: list[int]
    length: list[int]
    #: For states of at least the least length: all items with the state's strings; equal tuples are one object.
    items: dict[int, tuple[int, ...]]
    least: int


def build_automaton(items: list[tuple[int, list[str]]], least: int = LEAST_WORDS) -> Automaton:
    vocabulary: dict[str, int] = {}
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    owners: list[set[int]] = [set()]

    def extend(last: int, w: int) -> int:
        if w in moves[last]:
            q = moves[last][w]
            if length[q] == length[last] + 1:
                return q
            return split(last, q, w)
        cur = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        owners.append(set())
        p = last
        while p >= 0 and w not in moves[p]:
            moves[p][w] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][w]
            link[cur] = q if length[q] == length[p] + 1 else split(p, q, w)
        return cur

    def split(p: int, q: int, w: int) -> int:
        clone = len(moves)
        moves.append(dict(moves[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        owners.append(set())
        while p >= 0 and moves[p].get(w) == q:
            moves[p][w] = clone
            p = link[p]
        link[q] = clone
        return clone

    for item, words in items:
        last = 0
        for word in words:
            last = extend(last, vocabulary.setdefault(word, len(vocabulary)))
            owners[last].add(item)
    for state in sorted(range(1, len(moves)), key=length.__getitem__, reverse=True):
        if link[state] > 0:
            owners[link[state]] |= owners[state]
    one: dict[tuple[int, ...], tuple[int, ...]] = {}
    held = {s: one.setdefault(t := tuple(sorted(o)), t) for s, o in enumerate(owners) if length[s] >= least}
    return Automaton(vocabulary, moves, link, length, held, least)


def match(a: Automaton, words: list[str]) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Longest common run with each item that shares at least a.least words; merged spans (first, end) of such runs."""
    known = np.fromiter(map(a.vocabulary.get, words, repeat(-1)), np.int64, len(words))
    best: dict[int, int] = {}
    spans: list[tuple[int, int]] = []

    def count(held: list[tuple[tuple[int, ...], int]]) -> None:
        for items, run in held:
            for item in items:
                if best.get(item, 0) < run:
                    best[item] = run

    # only stretches of known words can hold a match
    edges = np.flatnonzero(np.diff(np.r_[False, known >= 0, False].astype(np.int8)))
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if end - begin < a.least:
            continue
        state, matched = 0, 0
        # the items of the last word's state and of its suffixes, counted once a word no longer has them all in longer runs
        held: list[tuple[tuple[int, ...], int]] = []
        for place, w in enumerate(known[begin:end].tolist(), begin):
            while state and w not in a.moves[state]:
                state = a.link[state]
                matched = a.length[state]
            if w in a.moves[state]:
                state = a.moves[state][w]
                matched += 1
            if matched >= a.least:
                first = place + 1 - matched
                if spans and first <= spans[-1][1]:
                    spans[-1] = (min(first, spans[-1][0]), place + 1)
                else:
                    spans.append((first, place + 1))
                s, run, here = state, matched, []
                while s > 0 and a.length[s] >= a.least:
                    here.append((a.items[s], run))
                    s = a.link[s]
                    run = a.length[s]
                if len(here) != len(held) or any(x is not y or m > n for (x, m), (y, n) in zip(held, here, strict=True)):
                    count(held)
                held = here
        count(held)
    return best, spans


def item_blocks(items: DataFrame, item: str, text: str, block_words: int = BLOCK_WORDS, least: int = LEAST_WORDS) -> Iterator[list[tuple[int, list[str]]]]:
    """The stated items in blocks of at most block_words words; items with null id or text are left out.

    A longer item is cut into pieces that overlap by half, so no run of up to half a block is lost; of a longer run the
    longest part within a piece is reported.
    """
    most = max(block_words, 4 * least)
    block, held = [], 0
    for row in items.select(F.col(item).alias("i"), F.col(text).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").distinct().toLocalIterator():
        words = words_of(row["t"]).words
        for at in range(0, max(1, len(words) - most // 2), most // 2) if len(words) > most else (0,):
            piece = words[at : at + most]
            if block and held + len(piece) > block_words:
                yield block
                block, held = [], 0
            block.append((row["i"], piece))
            held += len(piece)
    if block:
        yield block


class Automata:
    """All items as broadcast automata of bounded size; texts are matched against one after the other."""

    def __init__(self, items: DataFrame, item: str, text: str, least: int) -> None:
        context = items.sparkSession.sparkContext
        self.least = least
        self.parts: list[Broadcast] = []
        for block in item_blocks(items, item, text):
            sizes: dict[int, int] = {}
            for i, w in block:
                sizes[i] = max(sizes.get(i, 0), len(w))
            self.parts.append(context.broadcast((build_automaton(block, least), sizes)))

    def __call__(self, words: list[list[str]]) -> list[tuple[dict[int, int], dict[int, int], list[tuple[int, int]]]]:
        """For each text: the longest run with each item, the words of these items, and the merged spans of all runs."""
        out: list[tuple[dict[int, int], dict[int, int], list[tuple[int, int]]]] = [({}, {}, []) for _ in words]
        for part in self.parts:
            automaton, sizes = part.value
            for (best, size, spans), w in zip(out, words, strict=True):
                if len(w) < self.least:
                    continue
                runs, more = match(automaton, w)
                for i, run in runs.items():
                    best[i] = max(best.get(i, 0), run)
                    size[i] = max(size.get(i, 0), sizes[i])
                spans += more
            if len(self.parts) > RESIDENT:
                part.__dict__.pop("_value", None)
        return [(best, size, merged(spans)) for best, size, spans in out]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (first, end) in order, those that meet as one."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


_FOUND = "doc_id long, item_id long, longest_run int, item_words int, leaked_words int, doc_words int"


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """One row per document and item with a common run of at least `least` words.

    Columns: doc_id, item_id, longest_run, item_words, leaked_words (words of the document inside any such run) and
    doc_words. Rows with null ids or texts, and texts shorter than `least` words, give nothing; repeated rows count once;
    other columns are ignored. The documents are read once and never shuffled.
    """
    docs = documents.select(F.col(doc).alias("d"), F.col(text).alias("t")).filter("d IS NOT NULL AND t IS NOT NULL")
    automata = Automata(items, item, item_text, least)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms = Forms()
        for frame in frames:
            words = [plain_words(t, forms) for t in frame["t"].tolist()]
            rows = [
                (d, i, run, size[i], sum(e - s for s, e in spans), len(w))
                for d, w, (best, size, spans) in zip(frame["d"].tolist(), words, automata(words), strict=True)
                for i, run in best.items()
            ]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FOUND.split(", ")])

    return docs.mapInPandas(scan, _FOUND).distinct()


_CLEAN = "doc_id long, text string, removed_words int, doc_words int, dropped boolean"


def without_leaks(
    documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST_WORDS, most_coverage: float = 0.5
) -> DataFrame:
    """Every document without the spans shared with items: doc_id, text, removed_words, doc_words, dropped.

    A document whose shared words exceed most_coverage of its words is dropped: its text is null. Null and empty texts
    come out as they are; a text without a leak comes out unchanged, one with a leak without markup. Each row is cleaned
    where it is read, so null and repeated ids do no harm.
    """
    automata = Automata(items, item, item_text, least)

    def clean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, split = [], [words_of(t) for t in frame["t"].tolist()]
            for d, t, w, (_, _, spans) in zip(frame["d"].tolist(), frame["t"].tolist(), split, automata([w.words for w in split]), strict=True):
                n = sum(e - s for s, e in spans)
                dropped = n > most_coverage * len(w.words)
                if n and not dropped:
                    kept, at = [], 0
                    for s, e in spans:
                        kept.append(w.text[at : w.starts[s]])
                        at = w.ends[e - 1]
                    t = "".join([*kept, w.text[at:]])
                rows.append((d, None if dropped else t, n, len(w.words), dropped))
            out = pd.DataFrame(rows, columns=["doc_id", "text", "removed_words", "doc_words", "dropped"], dtype=object)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return documents.select(F.col(doc).alias("d"), F.col(text).alias("t")).mapInPandas(clean, _CLEAN)
