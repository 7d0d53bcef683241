import unicodedata

from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from arborix.llm.canonical import Canonicalizer, canonical_texts, look_alike_pairs, tables, with_canonical

T = tables()
C = Canonicalizer(T)


def mapped(text: str) -> str:
    return "".join("".join(map(chr, T.targets[T.starts[i] : T.starts[i + 1]])) if (i := C.slot[ord(ch)]) >= 0 else ch for ch in text)


ALPHABET = st.one_of(st.characters(codec="utf-8"), st.characters(min_codepoint=0x300, max_codepoint=0x36F), st.characters(min_codepoint=0x1100, max_codepoint=0x11FF), st.sampled_from("eéaäoｅеｏ한ẹ"))


@given(st.lists(st.text(ALPHABET, max_size=12), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_rebuilt_text_is_composed_and_rows_stay_apart(texts):
    assert C(texts) == [unicodedata.normalize("NFC", mapped(t)) for t in texts]


@given(st.text(ALPHABET, max_size=12))
@settings(max_examples=200, deadline=None)
def test_a_canonical_form_is_its_own(text):
    once = C([text])[0]
    assert C([once])[0] == once


@given(st.text(st.characters(max_codepoint=127), max_size=20))
def test_ascii_is_kept(text):
    assert canonical_texts([text]) == [text]


SAME = [
    ("résumé.pdf", "résumé.pdf"), ("file name", "file name"), ("invoice", "in​vo­ice"), ("scan-1.pdf", "scan‑1․pdf"), ("office", "oﬃce"), ("operator", "ореrаtоr"),
    ("ABC123", "ＡＢＣ１２３"), ("보고서", unicodedata.normalize("NFD", "보고서")), ("Kelvin", "Kelvin"), ("ệ", "ệ"), ("ệ", "ệ"), ("Отчёт", "Oтчëт"),
]
DIFFERENT = [("a", "A"), ("e", "é"), ("a-b", "a_b"), ("O", "0"), ("l", "1"), ("x2", "x²"), ("a b", "ab"), ("straße", "strasse"), ("a.b", "a,b"), ("I", "l")]


def test_what_looks_the_same_and_what_does_not():
    for a, b in SAME:
        assert C([a]) == C([b]), (a, b)
    for a, b in DIFFERENT:
        assert C([a]) != C([b]), (a, b)


def test_long_texts_and_many_marks():
    long = "é" * 200_000
    assert C([long, "x"]) == ["é" * 200_000, "x"]
    assert C(["a" + "̖" * 100_000 + "́"]) == ["á" + "̖" * 100_000]
    zalgo = "a" + "̖́" * 500
    assert C([zalgo]) == [unicodedata.normalize("NFC", zalgo)]


def test_frames_with_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "é", 5), (2, None, 6), (3, "", None), (None, "ａ", 7)], "id long, c string, t int")
    got = with_canonical(df, "c", "canonical", ["id", "c", "t"])
    assert rows(got, "id", "canonical", "t") == [(1, "é", 5), (2, None, 6), (3, "", None), (None, "a", 7)]
    assert with_canonical(df.limit(0), "c", "canonical", ["id"]).count() == 0


def test_pairs(spark):
    data = [(1, "ab"), (1, "ab"), (2, "ａb"), (3, "ab"), (4, "a​b"), (5, "xy"), (6, None), (None, "ａb"), (7, "XY")]
    df = spark.createDataFrame(data, "id long, v string").withColumnRenamed("v", "form")
    assert rows(look_alike_pairs(df, "id", "form")) == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)]
    assert look_alike_pairs(df.limit(0), "id", "form").count() == 0
