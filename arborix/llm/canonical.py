"""One consistent form for text that looks the same but differs in its characters (problem 5).

A batch of texts is exploded to positioned code points; they are joined with broadcast tables of decompositions and
look-alikes; runs of combining marks are put in order of their class; starters and marks are recomposed; and the strings
are rebuilt from the positions. Everything works on whole numpy columns of code points, never on single characters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.runtime import materialize

# Letters drawn like one of another alphabet, written as <look-alike><letter>; the letter is ASCII if there is one.
LOOK_ALIKES = (
    # Greek
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ οo νv ϲc ϳj "
    # Cyrillic
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT ХX УY ҮY ԌG ԚQ ԜW Ѵv ҺҺ аa сc ԁd еe һh іi јj оo рp ԛq ѕs ѵv ԝw хx уy үy "
    # Cyrillic like Greek
    "ГΓ ПΠ ФΦ "
    # Armenian
    "ՍU ՏS ՕO հh օo ոn սu զq "
    # Latin letters of phonetic alphabets and small capitals drawn like a plain letter
    "ɡg ɑa ᴄc ᴏo ᴠv ᴡw ᴢz"
)
# Hyphens and dots that are drawn like the ASCII ones.
SIGNS = {0x2010: "-", 0x2011: "-", 0x2043: "-", 0x02D7: "-", 0x2212: "-", 0xFE63: "-", 0xFF0D: "-", 0x2024: ".", 0xFE52: ".", 0xFF0E: "."}
# Format characters that are drawn, and characters outside the format class that are not.
DRAWN_FORMATS = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
UNDRAWN = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: Kinds of compatibility decomposition whose result looks like the character itself.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<font>"}
LONG_S = 0x017F


class Tables(NamedTuple):
    """What is broadcast: changed code points with their replacements, mark classes, and pairs that recompose."""

    points: np.ndarray
    starts: np.ndarray
    targets: np.ndarray
    marks: np.ndarray
    classes: np.ndarray
    pairs: np.ndarray
    composed: np.ndarray


def _invisible(cp: int, category: str) -> bool:
    return cp in UNDRAWN or (category == "Cf" and cp not in DRAWN_FORMATS) or (category == "Cc" and cp != 0x85)


@lru_cache(maxsize=1)
def tables() -> Tables:
    """The mapping tables, by rule from Python's Unicode data and the fixed values above. ASCII always stays as it is."""
    alike = {ord(x[0]): x[1] for x in LOOK_ALIKES.split()}

    def expand(ch: str) -> str:
        cp, category = ord(ch), unicodedata.category(ch)
        if cp < 0x80:
            return ch
        if _invisible(cp, category):
            return ""
        if category[0] == "Z" or cp == 0x85:
            return " "
        if cp in SIGNS:
            return SIGNS[cp]
        kind, _, rest = unicodedata.decomposition(ch).rpartition("> ")
        kind = kind and kind + ">"
        if rest:
            parts = "".join(chr(int(x, 16)) for x in rest.split())
            plain = all(unicodedata.category(x)[0] in "LN" for x in parts)
            if not kind or kind in SAME_LOOK or (kind == "<compat>" and category[0] in "LN" and plain and cp != LONG_S):
                return "".join(map(expand, parts))
        return alike.get(cp, ch)

    points, starts, targets, marks, classes, pairs, composed = [], [0], [], [], [], [], []
    for cp in range(0x80, 0x110000):
        ch = chr(cp)
        category = unicodedata.category(ch)
        if category in ("Cn", "Co", "Cs") or 0xAC00 <= cp <= 0xD7A3:
            continue
        if (to := expand(ch)) != ch:
            points.append(cp)
            targets += map(ord, to)
            starts.append(len(targets))
        if c := unicodedata.combining(ch):
            marks.append(cp)
            classes.append(c)
        two = unicodedata.decomposition(ch).split()
        if len(two) == 2 and two[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
            pairs.append(int(two[0], 16) << 21 | int(two[1], 16))
            composed.append(cp)
    order = np.argsort(pairs)
    return Tables(np.array(points), np.array(starts), np.array(targets, np.uint32), np.array(marks), np.array(classes, np.uint8), np.array(pairs, np.int64)[order], np.array(composed, np.uint32)[order])


class Canonicalizer:
    def __init__(self, t: Tables) -> None:
        self.t = t
        self.slot = np.full(0x110000, -1, np.int32)
        self.slot[t.points] = np.arange(len(t.points))
        self.ccc = np.zeros(0x110000, np.uint8)
        self.ccc[t.marks] = t.classes
        # second halves of pairs that are starters themselves, such as some Indic vowel signs
        seconds = np.unique(t.pairs & 0x1FFFFF)
        self.joins = np.zeros(0x110000, bool)
        self.joins[seconds] = True
        self.joins[t.marks] = False

    def __call__(self, texts: list[str]) -> list[str]:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(len(texts)), lengths)
        cp, row = self._join(cp, row)
        cp, row = self._hangul(cp, row)
        cp, row = self._marks(cp, row)
        whole = cp.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        ends = np.cumsum(np.bincount(row, minlength=len(texts))).tolist()
        out = [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        if (late := self.joins[cp]).any():
            for i in np.unique(row[late]).tolist():
                out[i] = unicodedata.normalize("NFC", out[i])
        return out

    def _join(self, cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Join code points with their replacements; a point gives as many rows as its replacement has points."""
        slot = self.slot[cp]
        hit = np.flatnonzero(slot >= 0)
        if not len(hit):
            return cp.copy(), row
        s = slot[hit]
        n = np.ones(len(cp), np.int64)
        n[hit] = self.t.starts[s + 1] - self.t.starts[s]
        out, places = np.repeat(cp, n), np.cumsum(n) - n
        filled = n[hit]
        inner = np.arange(filled.sum()) - np.repeat(np.cumsum(filled) - filled, filled)
        out[np.repeat(places[hit], filled) + inner] = self.t.targets[np.repeat(self.t.starts[s], filled) + inner]
        return out, np.repeat(row, n)

    @staticmethod
    def _hangul(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Compose conjoining jamo: leading + vowel, then syllable + trailing."""
        vowel = np.flatnonzero((cp >= 0x1161) & (cp <= 0x1175))
        vowel = vowel[vowel > 0]
        vowel = vowel[(cp[vowel - 1] >= 0x1100) & (cp[vowel - 1] <= 0x1112) & (row[vowel - 1] == row[vowel])]
        if len(vowel):
            cp[vowel - 1] = 0xAC00 + ((cp[vowel - 1] - 0x1100) * 21 + (cp[vowel] - 0x1161)) * 28
            cp, row = np.delete(cp, vowel), np.delete(row, vowel)
        tail = np.flatnonzero((cp >= 0x11A8) & (cp <= 0x11C2))
        tail = tail[tail > 0]
        before = cp[tail - 1]
        tail = tail[(before >= 0xAC00) & (before <= 0xD7A3) & ((before - 0xAC00) % 28 == 0) & (row[tail - 1] == row[tail])]
        if len(tail):
            cp[tail - 1] += cp[tail] - 0x11A7
            cp, row = np.delete(cp, tail), np.delete(row, tail)
        return cp, row

    def _marks(self, cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order marks by class behind their starter, then compose rank by rank what is not blocked."""
        ccc = self.ccc[cp]
        at = np.flatnonzero(ccc)
        if not len(at):
            return cp, row
        # a cluster is a starter and the marks behind it in the same text; -1 where a text begins with marks
        first_of_row = np.r_[True, row[1:] != row[:-1]]
        head = np.maximum.accumulate(np.where((ccc == 0) | first_of_row, np.arange(len(cp)), 0))[at]
        order = np.lexsort((ccc[at], head))
        sorted_at = at[order]
        cp[at], ccc[at] = cp[sorted_at], ccc[sorted_at]
        head_class = self.ccc[cp[head]]
        start = np.r_[True, head[1:] != head[:-1]]
        rank = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        usable = (head_class == 0) & (head != at)
        last = np.zeros(len(cp), np.uint8)  # class of the last mark kept behind each starter
        gone = np.zeros(len(cp), bool)
        # the marks of one rank together, so that a letter with very many marks costs one short step for each
        by_rank = np.flatnonzero(usable)
        by_rank = by_rank[np.argsort(rank[by_rank], kind="stable")]
        for take in np.split(by_rank, np.flatnonzero(np.diff(rank[by_rank])) + 1) if len(by_rank) else ():
            h, m = head[take], at[take]
            pair = cp[h].astype(np.int64) << 21 | cp[m].astype(np.int64)
            place = np.minimum(np.searchsorted(self.t.pairs, pair), len(self.t.pairs) - 1)
            fits = (self.t.pairs[place] == pair) & (last[h] < ccc[m])
            cp[h[fits]] = self.t.composed[place[fits]]
            gone[m[fits]] = True
            last[h[~fits]] = ccc[m[~fits]]
        return cp[~gone], row[~gone]


def canonical_texts(texts: list[str]) -> list[str]:
    """The canonical forms of some texts, on one machine."""
    return Canonicalizer(tables())(texts)


def with_canonical(df: DataFrame, text: str, canonical: str, keep: list[str]) -> DataFrame:
    """Columns `keep` and the canonical form of column `text`; null stays null, "" stays "".

    ASCII text is its own canonical form and is passed through; other columns of df are dropped, so their names cannot
    clash. The mapping tables are broadcast: their size is that of Unicode, whatever the data.
    """
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast(tables())
    inner = [f"k{i}" for i in range(len(keep))]
    flat = df.select(*[F.col(k).alias(i) for k, i in zip(keep, inner, strict=True)], F.col(text).alias("t"))
    schema = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in flat.drop("t").schema) + ",c:string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Canonicalizer(shared.value)
        for batch in batches:
            t = batch.column(batch.schema.get_field_index("t"))
            ascii_ = pc.fill_null(pc.string_is_ascii(t), True)
            other = pc.invert(ascii_)
            texts = t.filter(other).to_pylist()
            out = pc.replace_with_mask(t, other, pa.array(make(texts), t.type)) if texts else t
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns - 1)], out], names=[*inner, "c"])

    done = flat.mapInArrow(run, schema[7:-1])
    return done.select(*[F.col(i).alias(k) for k, i in zip(keep, inner, strict=True)], F.col("c").alias(canonical))


def look_alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of rows whose texts differ in characters but have the same canonical form.

    Rows with a null id or text form no pair; equal texts form no pair; repeated rows count once. Classes of equal text
    are paired first, and ids are joined to the class pairs, so copies of one text are never compared with each other.
    """
    base = df.select(F.col(key).alias("id"), F.col(text).alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    forms = with_canonical(base, "v", "c", ["id", "v"])
    # 128 bits for the form, 64 for the spelling inside it: a false match is out of reach at any table size
    rows = materialize(forms.select("id", F.unhex(F.md5("c")).alias("form"), F.xxhash64("v").alias("spelling")), "forms")
    varied = rows.groupBy("form").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).filter("lo < hi").select("form")
    hits = rows.join(varied, "form").distinct()
    spellings = hits.select("form", "spelling").distinct()
    pairs = spellings.join(spellings.withColumnRenamed("spelling", "spelling_b"), "form").filter("spelling < spelling_b")
    a = pairs.join(hits.withColumnRenamed("id", "id_1"), ["form", "spelling"])
    b = a.join(hits.select("form", F.col("spelling").alias("spelling_b"), F.col("id").alias("id_2")), ["form", "spelling_b"])
    return b.filter("id_1 <> id_2").select(F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b")).distinct()
