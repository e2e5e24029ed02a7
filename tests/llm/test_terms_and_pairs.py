"""Term counts and the pair table against brute force."""

import random
import unicodedata
from collections import Counter

import pytest

from loomcat.llm import pairs, terms

ROWS = [
    (1, ["Disc", "disc", " ｄｉｓｃ ", "Ball"]), (1, ["Disc", "disc", " ｄｉｓｃ ", "Ball"]), (2, ["ball", "", None, "  "]), (3, None), (4, []), (None, ["lost"]), (5, ["x" * 50_000, "ball"]), (6, ["disc"]),
]


def _normal(w):
    return unicodedata.normalize("NFKC", w).strip().lower() if w else ""


def _brute(rows):
    once = {k: ws or [] for k, ws in rows if k is not None}
    uses, records = Counter(), Counter()
    for ws in once.values():
        got = [t for w in ws if (t := _normal(w))]
        uses.update(got)
        records.update(set(got))
    return once, uses, records


def test_counts(spark):
    df = spark.createDataFrame([(k, w, "clash") for k, w in ROWS], "row_id long, words array<string>, term string")
    _, uses, records = _brute(ROWS)
    got = {r["term"]: (r["uses"], r["records"]) for r in terms.term_counts(df).collect()}
    assert got == {t: (uses[t], records[t]) for t in uses}
    marks = {(r["term"], r["mark"]) for r in terms.marked_terms(df).where("mark is not null").collect()}
    n = 6
    assert marks == {(t, "rare") for t in records if records[t] <= 2} | {(t, "common") for t in records if records[t] * 5 > n}
    assert terms.term_counts(df.limit(0)).count() == 0


def test_counts_random_and_skewed(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.randrange(300), None) for _ in range(400)]
    by = {k: [rng.choice(["hot", "Hot", *map(str, range(40))]) for _ in range(rng.randint(0, 9))] + (["hot"] if k % 3 == 0 else []) for k, _ in rows}
    rows = [(k, by[k]) for k, _ in rows]
    monkeypatch.setattr(terms, "TERMS_IN_MEMORY", 7)
    _, uses, records = _brute(rows)
    got = {r["term"]: (r["uses"], r["records"]) for r in terms.term_counts(spark.createDataFrame(rows, "row_id long, words array<string>")).collect()}
    assert got == {t: (uses[t], records[t]) for t in uses}


def _pairs(baskets, least, per, times):
    n = len(baskets)
    one, two = Counter(), Counter()
    for b in baskets.values():
        one.update(b)
        two.update((x, y) for x in b for y in b if x < y)
    return {p for p, k in two.items() if k >= least and k * per >= n and k * n >= times * one[p[0]] * one[p[1]]}, two


def test_pairs_from_nothing_and_by_changes(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefghij") + rng.choice("12")
    now = {i: sorted({word() for _ in range(rng.randint(0, 5))}) for i in range(120)}
    schema = "record long, terms array<string>"
    table = pairs.PairTable(spark, str(tmp_path / "t"), least=3, per=20)
    table.apply(spark.createDataFrame(list(now.items()), schema))
    for step in range(3):
        want, two = _pairs(now, 3, 20, 2)
        got = pairs.associated(table, 2).collect()
        assert {(r["term_a"], r["term_b"]) for r in got} == want
        assert all(r["n_ab"] == two[r["term_a"], r["term_b"]] for r in table.scores().collect())
        changed = {i: sorted({word(), word(), f"n{step}"}) for i in rng.sample(range(150), 30)} | {rng.randrange(100): []}
        now |= changed
        table.apply(spark.createDataFrame(list(changed.items()), schema))


def test_baskets(spark):
    got = {r["record"]: r["terms"] for r in pairs.baskets(spark.createDataFrame(ROWS, "row_id long, words array<string>")).collect()}
    assert got[1] == ["ball", "disc"] and got[3] == [] and got[2] == ["ball"] and None not in got


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_empty(spark, tmp_path, rows):
    table = pairs.PairTable(spark, str(tmp_path / "t"))
    table.apply(pairs.baskets(spark.createDataFrame(rows, "row_id long, words array<string>")))
    assert pairs.associated(table).count() == 0


def test_table_is_opened_again_and_rewrites_what_it_touches(spark, tmp_path):
    schema, rng = "record long, terms array<string>", random.Random(9)
    now = {i: sorted({rng.choice("abcdefg"), rng.choice("abcdefg"), "hot"}) for i in range(400)} | {i: [] for i in range(400, 420)}
    made = pairs.PairTable(spark, str(tmp_path / "t"), least=2, per=50, rows_per_bucket=40)
    made.apply(spark.createDataFrame(list(now.items()), schema))
    assert made.state["buckets"] == 11
    first = dict(made.state["at"]["baskets"])
    for step in range(3):
        table = pairs.PairTable(spark, str(tmp_path / "t"))  # another process goes on where the last one stopped
        assert (table.least, table.per, table.n) == (2, 50, len(now))
        gone = rng.sample(sorted(now), 3) + [10_000]
        changed = {i: ["hot", f"new{step}"] for i in [500 + step, 600 + step, sorted(now)[0]]}
        table.apply(spark.createDataFrame(list(changed.items()), schema), spark.createDataFrame([(i,) for i in gone], "record long"))
        now = {i: t for i, t in now.items() if i not in gone} | changed
        want, two = _pairs(now, 2, 50, 1)
        assert table.n == len(now) and {(r["term_a"], r["term_b"]) for r in pairs.associated(table, 1).collect()} == want
        assert {(r["term_a"], r["term_b"]): r["n_ab"] for r in table.scores().collect() if r["n_ab"]}.items() <= two.items()
        if not step:  # seven records at most are in seven buckets at most
            assert sum(first[b] == table.state["at"]["baskets"].get(b) for b in first) >= 4
    table.apply(spark.createDataFrame([], schema), spark.createDataFrame([(i,) for i in now], "record long"))
    assert table.n == 0 and pairs.associated(table).count() == 0
    table.drop()
    assert pairs.PairTable(spark, str(tmp_path / "t")).n == 0
