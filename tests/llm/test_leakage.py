"""Leaks against exact shingle containment, and whole long texts."""

import random

import pytest

from loomcat.llm import leakage

WORDS = [f"w{i}" for i in range(400)]


def _text(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    stock = "the same stock phrase stands in all of them"
    items = {i: f"{_text(rng, 60)} {stock}" for i in range(1, 21)}
    docs, want = {}, set()
    for d in range(200):
        text = _text(rng, rng.choice([20, 150, 300, 900]))
        if d % 4 == 0:
            i = rng.randrange(1, 21)
            w = items[i].split()[:60]
            if d % 8:
                part = " ".join(w[10:40]).upper().replace("W", "Ｗ", 2)
            else:
                part = " ".join(w[:14]) + " " + _text(rng, 30) + " " + ", ".join(w[30:46])
            text = f"{text[: len(text) // 2]} {part}. {text[len(text) // 2 :]}"
            want.add((d, i))
        elif d % 4 == 1:
            text += " " + stock + " " + " ".join(items[3].split()[:7])
        docs[d] = text
    far = 999
    docs[far] = _text(rng, 40_000) + " " + items[5] + " " + _text(rng, 3)
    want.add((far, 5))
    return docs, items, want


def test_planted(spark, data):
    docs, items, want = data
    rows = [(d, t, 7) for d, t in docs.items()] + [(2000, None, 7), (2001, "", 7), (2002, "short", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int").repartition(5)
    tests = spark.createDataFrame([*items.items(), (77, None), (78, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked(df, tests).collect()}
    assert got == want
    assert leakage.leaked(df.limit(0), tests).count() == 0 and leakage.leaked(df, tests.limit(0)).count() == 0


def test_blocks_give_the_same(spark, data, monkeypatch):
    docs, items, want = data
    monkeypatch.setattr(leakage, "ITEMS", 6)
    got = leakage.leaked(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want


def test_candidates_recall(data):
    docs, items, want = data
    search = leakage.Search(list(items.items()), frozenset())
    missed = [(d, i) for d, i in want if i not in search.candidates(search.hasher.shingles(leakage.words_of(docs[d])))]
    assert not missed


def test_short_items_and_repeats(spark):
    rng = random.Random(3)
    short = [f"s{i} " + " ".join(rng.sample(WORDS, 6)) for i in range(5)]
    long = [_text(rng, 80) for _ in range(3)]
    items = dict(enumerate(short + long))
    docs = [(i, _text(rng, 2000) + " " + t + " " + _text(rng, 50)) for i, t in items.items()] * 2
    found = leakage.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(i, i) for i in items]


def test_slots_follow_from_the_smallest_item(data):
    rng = random.Random(4)
    search = leakage.Search([(1, _text(rng, 300)), (2, _text(rng, 40)), (3, _text(rng, 12))], frozenset())
    assert search.short == {3} and search.lengths == [leakage.slots_for(p, 36) for p in leakage.PARTITIONS]


def _leaks(spark, docs, items):
    found = leakage.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return sorted((r["doc_id"], r["item_id"]) for r in found.collect())


def test_thin_pieces_are_not_missed():
    """A fifth of the words or more in runs of five, each run alone and far from the next: few shingles, many windows."""
    rng = random.Random(1)
    words = [f"v{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choices([f"u{i}" for i in range(4000)], k=200))) for i in range(100)]
    search = leakage.Search(items, frozenset())
    for i, text in items:
        w = text.split()
        doc = " ".join(" ".join(w[k : k + 5] + rng.choices(words, k=150)) for k in range(0, 200, 25))
        assert (i, 0.2) in search.leaks(doc)
        below = " ".join(" ".join(w[k : k + 5] + rng.choices(words, k=150)) for k in range(25, 200, 25))
        assert search.leaks(below) == []


def test_items_of_the_same_words(spark):
    rng = random.Random(5)
    a = rng.sample(WORDS, 80)
    b = [*a[:40], "other", *a[41:]]
    part = rng.sample(WORDS, 60)
    items = [(1, " ".join(a)), (2, " ".join(a).upper() + "!"), (3, " ".join(b)), (4, " ".join(part)), (5, " ".join([*rng.sample(WORDS, 300), *part]))]
    docs = [(1, _text(rng, 500) + " " + " ".join(a[5:35])), (2, " ".join(b) + " " + _text(rng, 30)), (3, _text(rng, 40) + " " + " ".join(part[:30]))]
    assert _leaks(spark, docs, items) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 4)]


def test_items_of_stock_only_must_be_held_whole(spark):
    rng = random.Random(6)
    x, y = _text(rng, 40), _text(rng, 40)
    items = [(1, f"{x} {y}"), (2, f"{x} {_text(rng, 40)}"), (3, f"{y} {_text(rng, 40)}"), (4, f"{_text(rng, 50)} {x[:100]} {y[-100:]}")]
    docs = [(1, f"{_text(rng, 20)} {x} {y} {_text(rng, 20)}"), (2, f"{_text(rng, 20)} {x} {_text(rng, 20)}"), (3, f"{y} {x}")]
    assert _leaks(spark, docs, items) == [(1, 1)]


def test_repeated_shingles_short_items_and_ids(spark):
    rng = random.Random(7)
    verse = " ".join(rng.sample(WORDS, 12))
    items = [(1, " ".join([verse] * 10)), (2, "zinc plated lag bolt"), (3, _text(rng, 60)), (3, "again " + _text(rng, 60)), (None, _text(rng, 60))]
    docs = [(1, f"{_text(rng, 30)} {items[0][1]}"), (2, f"{_text(rng, 30)} Zinc-plated lag bolt. {_text(rng, 30)}"), (3, "zinc plated bolt " + items[2][1]), (4, items[3][1]), (5, verse)]
    assert _leaks(spark, docs, items) == [(1, 1), (2, 2), (3, 3), (4, 3)]


def test_most_covered_against_all_chains():
    rng = random.Random(8)
    for _ in range(400):
        n = rng.choice([3, 5, 9, 30, 60])
        width = min(5, n)
        hits = sorted({(rng.randrange(40), rng.randrange(n - width + 1)) for _ in range(rng.randrange(1, 40))})
        best = []
        for i, (d, p) in enumerate(hits):
            best.append(max([width, *(best[j] + min(width, d - e, p - q) for j, (e, q) in enumerate(hits[:i]) if e < d and q < p)]))
        assert leakage.most_covered(hits, n) == min(n, max(best))
    # a chain of few shingles that covers more words than one of many
    hits = [(0, 20), (10, 30), (20, 40), (30, 50), *((40 + i, i) for i in range(6))]
    assert leakage.most_covered(hits, 60) == 20
