import random

import numpy as np
import pytest
from helpers import rows

from arborix.llm import toxicity as X
from arborix.llm.canonical import canonical_texts


def test_disguises():
    forms = ["you snorkel", "you s n o r k e l", "you s.n.o.r.k.e.l", "YOU SNORKEL!", "you sn0rk3l", "you snоrk​el"]
    assert {tuple(X.words_of(t)) for t in canonical_texts(forms)} == {("you", "snorkel")}
    assert X.words_of("sn**el 12,5 /a_b/c.txt f262c6e7e017") == ["sn*el", "#", "#", "a", "b", "c", "txt", "#"]
    assert X.words_of("sn0rk3ls" * 5) == ["snorkels" * 5]

    def slots(text):
        return set(X.slots_of([[text]])[1])

    assert len(slots("walnut") & slots("wlanut")) >= 2


def test_passages():
    assert X.passages_of("One. Two!\nThree") == [["one"], ["two"], ["three"]]
    long = X.passages_of(" ".join(f"v{chr(97 + i % 26)}" for i in range(100)))
    assert all(len(p) <= X.PASSAGE_WORDS for p in long) and {w for p in long for w in p} == {f"v{chr(97 + i)}" for i in range(26)}
    assert X.passages_of("") == [] and X.passages_of(" .. ") == []


def test_slots_belong_to_their_passages():
    whole = [["a", "walnut", "rolls"], [], ["a"], ["walnut", "#", "walnut"]]
    rows, slots = X.slots_of(whole)
    for i, p in enumerate(whole):
        assert sorted(slots[rows == i]) == sorted(X.slots_of([p])[1])
    assert X.slots_of([])[0].size == 0 and X.slots_of([[]])[0].size == 0


PLAIN = ["The {} reads the {} before the {} stops.", "Please note that the {} checks the {}.", "We moved the {} to the {} on Monday."]
NOUNS = "index table share disk report queue folder counter dashboard worker scanner archive".split()
# Invented words of abuse: what is learned comes from the reviews alone.
BAD = ["You {} {}, leave this room.", "All {} are {} and smell.", "Nobody wants {} {} near the lake.", "Such a {} {} may sink in the swamp."]
CURSES = ["snorkwaffle", "grumblefrond", "plonkmuffin", "wibblefish", "muckspout", "dregnoodle"]
TECHNICAL = ["The swamp worker was replaced near the lake.", "The muckspout file format needs two passes."]


def bad(rnd):
    return rnd.choice(BAD).format(*rnd.sample(CURSES, 2))


def text(rnd, extra=None):
    out = [rnd.choice(PLAIN).format(*rnd.sample(NOUNS, 3)) for _ in range(rnd.randrange(3, 8))]
    if extra:
        out.insert(rnd.randrange(len(out)), extra)
    return "\n".join(out)


@pytest.fixture(scope="module")
def frames(spark):
    rnd = random.Random(8)
    docs = []
    for i in range(1600):
        kind = "bad" if i % 8 == 0 else "technical" if i % 8 == 1 else "plain"
        docs.append((i, text(rnd, bad(rnd) if kind == "bad" else rnd.choice(TECHNICAL) if kind == "technical" else None), f"s{i % 3}", kind))
    labels = [(i, "r", int(k == "bad")) for i, _, _, k in docs if i % 16 < 8]
    labels += [(0, "r", 1), (None, "r", 1), (1, "r", None), (9000, "q", 1)]
    extra = [(5000, None, "s0", "plain"), (5001, "", None, "plain"), (None, "You snorkwaffle plonkmuffin, leave this room.", "s1", "bad"), (5002, "fine words " * 50_000 + "\nAll wibblefish are plonkmuffin and smell.", "s2", "bad")]
    return spark.createDataFrame(docs + extra, "doc_id long, text string, source string, score string"), spark.createDataFrame(labels, "doc_id long, reviewer string, abusive int")


def quality(docs, got):
    held = {r["doc_id"]: r["score"] for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] < 5000 and r["doc_id"] % 16 >= 8}
    hits = {d for d in held if got[d]["abusive"]}
    want = {d for d, k in held.items() if k == "bad"}
    return len(hits & want) / len(want), len(hits & want) / max(1, len(hits))


def test_scores_of_documents_that_were_not_reviewed(spark, frames):
    docs, labels = frames
    scores = X.scored(docs, labels)
    got = {r["doc_id"]: r for r in scores.collect()}
    assert len(got) == 1604
    recall, precision = quality(docs, got)
    assert recall >= 0.9 and precision >= 0.9
    assert got[5000]["score"] == got[5001]["score"] == 0.0 and got[5002]["abusive"] and got[None]["abusive"]
    rates = {r["source"]: r for r in X.source_rates(scores).collect()}
    assert None in rates and rates["s0"]["documents"] == 535


def test_patterns_beyond_the_driver_give_the_same(spark, frames, monkeypatch):
    docs, labels = frames
    near = {r["doc_id"]: r["score"] for r in X.scored(docs, labels).collect()}
    monkeypatch.setattr(X, "STEPS", 4)
    monkeypatch.setattr(X.fit, "__defaults__", (4,))
    few = {r["doc_id"]: r["score"] for r in X.scored(docs, labels).collect()}
    monkeypatch.setattr(X, "LOCAL_PATTERNS", 0)
    far = {r["doc_id"]: r["score"] for r in X.scored(docs, labels).collect()}
    assert near.keys() == far.keys() and all(abs(few[d] - far[d]) < 1e-6 for d in few)


def test_non_negative_risk_and_prior(spark):
    """Held against the plain formula, and the prior against a known mixture."""
    rnd = np.random.default_rng(1)
    x = X.Patterns(np.array([0, 0, 1, 2]), np.array([0, 1, 1, 2]), 3)
    s = X.Sample(x, np.array([1.0, 2.0, 3.0]), 10.0)
    w = np.array([0.3, -0.2, 0.7])
    value, grad = s.risk(w, 0.1)
    z = np.array([0.2, -0.1, 0.8, *[0.1] * 4])
    want = lambda z: (np.array([1, 2, 3, 1, 1, 1, 1]) / (1 + np.exp(-z))).sum() / 10
    assert abs(value - want(z)) < 1e-12
    step = 1e-6
    assert abs(grad[0] - (s.risk(w, 0.1 + step)[0] - value) / step) < 1e-5
    assert abs(grad[2] - (s.risk(w + [0, step, 0], 0.1)[0] - value) / step) < 1e-5
    positive, negative = rnd.normal(5, 1, 400), rnd.normal(-5, 1, 40_000)
    everything = np.r_[negative, rnd.normal(5, 1, 1600)]
    above = np.bincount(X._bin(everything), minlength=X._BINS)[::-1].cumsum()[::-1]
    prior, limit = X._limit(positive, above.astype(float))
    assert abs(prior - 1600 / 41_600) < 0.008 and -3 < limit < 4


def test_without_labels_and_documents(spark, frames):
    docs, labels = frames
    assert X.scored(docs.limit(0), labels).count() == 0
    got = X.scored(docs, labels.limit(0)).collect()
    assert len(got) == 1604 and not any(r["abusive"] or r["score"] for r in got)
    assert not any(r["abusive"] for r in X.scored(docs, labels.filter("abusive = 1")).collect())


def test_reviews(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, "b", 0), (2, "a", 0), (3, "a", 1), (3, "b", 1), (3, "c", 0)], "doc_id long, reviewer string, abusive int")
    assert rows(X.reviews(df)) == [(2, False), (3, True)]
