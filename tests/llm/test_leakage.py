import random

from helpers import rows

from arborix.llm.leakage import build_automaton, leaks, match, plain_words, without_leaks, words_of


def run_of(a, b):
    best = 0
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if x == y:
                table[i + 1][j + 1] = table[i][j] + 1
                best = max(best, table[i + 1][j + 1])
    return best


def test_matches_brute_force():
    rnd = random.Random(4)
    for _ in range(150):
        items = [(i, [rnd.choice("abc") for _ in range(rnd.randrange(1, 25))]) for i in range(5)]
        doc = [rnd.choice("abcd") for _ in range(rnd.randrange(0, 60))]
        least = rnd.randrange(2, 6)
        best, spans = match(build_automaton(items, least), doc)
        want = {i: run_of(doc, w) for i, w in items if run_of(doc, w) >= least}
        assert best == want
        inside = {p for s, e in spans for p in range(s, e)}
        text = {i: " " + " ".join(w) + " " for i, w in items}
        assert inside == {p for s in range(len(doc) - least + 1) if any(" " + " ".join(doc[s : s + least]) + " " in t for t in text.values()) for p in range(s, s + least)}


def test_words():
    assert words_of("The <b>QU</b>ick, bro​wn\nfox_es & café ＡＢ １２").words == ["the", "quick", "brown", "fox", "es", "café", "ab", "12"]
    assert words_of("[copy](http://x.y/z) &amp; **more** <br>line").words == ["copy", "more", "line"]
    assert words_of(f"one <img src={'x' * 5000}> two <!-- {'no ' * 5000} --> three [x]({'u' * 5000}) <b class={'y' * 5000}>fo</b>ur <!-- open").words == ["one", "two", "three", "x", "four", "open"]
    for text in ("The <b>QU</b>ick, bro​wn\nfox_es & café ＡＢ １２ ㎏ ½", "plain_text 12-b", "", None, "é" * 3):
        assert plain_words(text) == words_of(text).words
    assert words_of(None).words == [] and words_of("").words == [] and words_of("?!").words == []


PASSAGE = "the records office of the old town keeps seven thousand boxes of sensor dumps and forty six drives of which five were rebuilt last year by the desk"


def frames(spark):
    docs = spark.createDataFrame(
        [(1, "Intro. " + PASSAGE.upper().replace(" ", ",\n")), (2, " ".join(PASSAGE.split()[:19])), (3, None), (4, ""), (None, PASSAGE), (5, "x " * 300_000 + PASSAGE), (1, "Intro. " + PASSAGE.upper().replace(" ", ",\n")), (6, "a b c d e f g h i j k l m n o p q r s t u v " * 3 + PASSAGE + " tail")],
        "doc_id long, text string",
    ).selectExpr("doc_id", "text", "1 AS item_id")
    items = spark.createDataFrame([(9, PASSAGE), (8, None), (None, PASSAGE), (7, "Question. " + PASSAGE[: len(PASSAGE) - 20])], "item_id long, text string")
    return docs, items


def test_leaks(spark):
    docs, items = frames(spark)
    got = {(r["doc_id"], r["item_id"]): r for r in leaks(docs, items).collect()}
    n = len(PASSAGE.split())
    assert sorted(got) == [(1, 7), (1, 9), (5, 7), (5, 9), (6, 7), (6, 9)]
    assert got[(1, 9)]["longest_run"] == n and got[(1, 9)]["leaked_words"] == n and got[(1, 9)]["doc_words"] == n + 1
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    import arborix.llm.leakage as module

    docs, items = frames(spark)
    want = rows(leaks(docs, items), "doc_id", "item_id", "longest_run")
    cleaned = rows(without_leaks(docs, items))
    monkeypatch.setattr(module.item_blocks, "__defaults__", (10, 20))
    for resident in (4, 1):
        monkeypatch.setattr(module, "RESIDENT", resident)
        assert rows(leaks(docs, items), "doc_id", "item_id", "longest_run") == want
        assert rows(without_leaks(docs, items)) == cleaned


def test_one_instruction_in_many_items():
    """Items that share a long beginning, each with an end of its own."""
    rnd = random.Random(2)
    head = [f"h{i}" for i in range(40)]
    items = [(i, head + [f"t{i}w{k}" for k in range(5)] + head[: i % 7]) for i in range(60)]
    a = build_automaton(items, 6)
    for _ in range(30):
        doc = [w for _ in range(4) for w in rnd.choice([head[rnd.randrange(20) :], rnd.choice(items)[1], ["x"], head[: rnd.randrange(40)]])]
        want = {i: run_of(doc, w) for i, w in items if run_of(doc, w) >= 6}
        assert match(a, doc)[0] == want


def test_items_longer_than_a_block(spark, monkeypatch):
    import arborix.llm.leakage as module

    w = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(1, " ".join(w[100:135])), (2, " ".join(w[270:])), (3, " ".join(w[:25]))], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(w))], "item_id long, text string")
    want = rows(leaks(docs, items), "doc_id", "item_id", "longest_run")
    monkeypatch.setattr(module.item_blocks, "__defaults__", (10, 20))
    assert rows(leaks(docs, items), "doc_id", "item_id", "longest_run") == want == [(1, 5, 35), (2, 5, 30), (3, 5, 25)]


def test_leaked_words_count_over_all_blocks(spark, monkeypatch):
    import arborix.llm.leakage as module

    w = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[:40])), (1, " ".join(w))], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(w[:30])), (6, " ".join(w[20:50])), (7, " ".join(w[70:95])), (8, " ".join(w[72:94]))], "item_id long, text string")
    want = [(1, 5, 75), (1, 6, 75), (1, 7, 75), (1, 8, 75), (2, 5, 40), (2, 6, 40)]
    assert rows(leaks(docs, items), "doc_id", "item_id", "leaked_words") == want
    columns = leaks(docs, items).columns
    whole = rows(leaks(docs, items))
    monkeypatch.setattr(module.item_blocks, "__defaults__", (10, 20))
    assert rows(leaks(docs, items), "doc_id", "item_id", "leaked_words") == want
    assert rows(leaks(docs, items)) == whole and leaks(docs, items).columns == columns


def test_removal(spark):
    docs, items = frames(spark)
    got = {r["doc_id"]: r for r in without_leaks(docs, items).collect()}
    assert got[1]["dropped"] and got[1]["text"] is None
    assert not got[6]["dropped"] and got[6]["text"].endswith("v  tail") and PASSAGE not in got[6]["text"]
    assert got[2]["text"] == " ".join(PASSAGE.split()[:19]) and got[3]["text"] is None and got[4]["text"] == "" and not got[3]["dropped"]
