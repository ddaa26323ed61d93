"""Leaks against a brute-force search; removal of spans."""

import random

import pytest

from graphlens.llm.leaks import SuffixAutomaton, leaked_items, remove_leaks
from graphlens.llm.words import words

DOC = "doc_id long, text string, item_id string"
ITEM = "item_id long, text string, suite string"


def brute(docs, items, k=13):
    grams = {}
    for i, t in items:
        w = words(t or "")
        for a in range(len(w) - k + 1):
            grams.setdefault(tuple(w[a:a + k]), set()).add(i)
    return {(d, i) for d, t in docs for w in [words(t or "")] for a in range(len(w) - k + 1) for i in grams.get(tuple(w[a:a + k]), ())}


def frames(spark, docs, items):
    return (spark.createDataFrame([(d, t, "x") for d, t in docs], DOC), spark.createDataFrame([(i, t, "s") for i, t in items], ITEM))


def pairs(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


@pytest.mark.parametrize("block_words", [200_000, 30])
def test_against_brute_force(spark, block_words):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(40)))) for i in range(30)] + [(90, None), (91, "")]
    docs = [(d, " ".join(r.choice(vocabulary) for _ in range(r.randrange(200)))) for d in range(60)] + [(900, None), (901, "")]
    for d in range(20):
        w = items[r.randrange(30)][1].split()
        docs.append((1000 + d, "intro " + ", ".join(w[: r.randrange(len(w) + 1)]).upper() + " end"))
    d, i = frames(spark, docs + docs[:5], items + items[:5])
    got = pairs(leaked_items(d, i, block_words=block_words))
    assert got == brute(docs, items)
    assert pairs(leaked_items(d.limit(0), i)) == set() and pairs(leaked_items(d, i.limit(0))) == set()


def test_disguises(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    hidden = "> “One” two,\n> th\u00adree * four* `five` six\u200b seven; EIGHT\n// nine-ten eleven_twelve (thirteen)"
    d, i = frames(spark, [(1, hidden), (2, item.replace("seven", "7")), (3, " ".join(item.split()[:12])), (4, "x " * 200_000 + item)], [(5, item)])
    assert pairs(leaked_items(d, i)) == {(1, 5), (4, 5)}
    longest = {r.doc_id: r.longest_run for r in leaked_items(d, i).collect()}
    assert longest == {1: 13, 4: 14}


def test_coverage_and_removal(spark):
    item = "a b c d e f g h i j"
    d, i = frames(spark, [(1, "start a b c d e f g h i end"), (2, "nothing here"), (3, None), (4, "a b c d")], [(5, item)])
    assert pairs(leaked_items(d, i)) == set()
    assert pairs(leaked_items(d, i, coverage=0.8)) == {(1, 5)}
    assert {r.doc_id: (r.text, r.n_removed) for r in remove_leaks(d, i, coverage=0.8).collect()} == {
        1: ("start  end", 9), 2: ("nothing here", 0), 3: (None, 0), 4: ("a b c d", 0)}


def longest(doc, items, floor):
    """{item: most words in a row that the document and the item share}, from floor on."""
    out = {}
    for i, t in items:
        w, text = t.split(), f" {doc} "
        n = max((b - a for a in range(len(w)) for b in range(a + 1, len(w) + 1) if f" {' '.join(w[a:b])} " in text), default=0)
        if n >= floor:
            out[i] = n
    return out


def test_overlapping_items(spark):
    w = [f"v{i}" for i in range(30)]
    items = [(1, " ".join(w[:13] + ["other"])), (2, " ".join(w[:20])), (3, " ".join(["first"] + w[5:19] + ["last"])), (4, " ".join(w[2:10]))]
    docs = [(10, " ".join(["so"] + w[:20] + ["end"])), (11, " ".join(w[:14])), (12, " ".join(w[4:20]))]
    d, i = frames(spark, docs, items)
    got = {(r.doc_id, r.item_id): (r.longest_run, r.n_runs) for r in leaked_items(d, i).collect()}
    assert got == {(10, 1): (13, 1), (10, 2): (20, 1), (10, 3): (14, 1), (11, 1): (13, 1), (11, 2): (14, 1), (12, 2): (16, 1), (12, 3): (14, 1)}
    assert (10, 4) in pairs(leaked_items(d, i, coverage=0.8))  # a short item within a longer run
    short = spark.createDataFrame([(4, items[3][1], "s"), (2, "q " + " ".join(w[2:12]) + " z " * 40, "s")], ITEM)
    assert {r.doc_id: r.n_removed for r in remove_leaks(d, short).collect()} == {10: 8, 11: 8, 12: 0}


@pytest.mark.parametrize("floor", [3, 6])
def test_runs_of_nested_items(floor):
    r = random.Random(11)
    text = [r.choice("abc") for _ in range(60)]
    items = []
    for i in range(25):
        a = r.randrange(50)
        items.append((i, " ".join([*text[a:a + r.randrange(3, 14)], r.choice("abcd")])))
    auto = SuffixAutomaton([(i, t.split()) for i, t in items], floor)
    for _ in range(60):
        a = r.randrange(50)
        doc = " ".join([r.choice("abcd"), *text[a:a + r.randrange(3, 25)], *(r.choice("abc") for _ in range(6))])
        assert {i: n for i, (n, _) in auto.matches(doc.split(), floor, None)[0].items()} == longest(doc, items, floor)


def test_automaton_states_stay_linear():
    auto = SuffixAutomaton([(1, ["a"] * 500), (2, ["a", "b"] * 250)], 13)
    assert len(auto.next) < 2 * 1100
    assert set(auto.matches(["a"] * 13, 13, None)[0]) == {1} and set(auto.matches(["a", "b"] * 7, 13, None)[0]) == {2}
