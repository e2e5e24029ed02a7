"""Counts of all pairs, rare terms too."""

import random
from collections import Counter

from loomcat.llm import pairs, queries


def test_rare_terms_have_their_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pairs, "PAIRS_IN_MEMORY", 50)
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xy") + "zed"
    rows = [(i, [word() for _ in range(rng.randint(0, 6))]) for i in range(3000)] + [(4000, ["rareone", "raretwo", "axzed"]), (4001, None)]
    spark.createDataFrame(rows, "row_id long, words array<string>").write.parquet(f"{tmp_path}/items.parquet")
    held = [sorted(r["terms"]) for r in pairs.baskets(spark.read.parquet(f"{tmp_path}/items.parquet")).collect()]
    one, two = Counter(t for b in held for t in b), Counter((x, y) for b in held for x in b for y in b if x < y)
    got = {(r["term_a"], r["term_b"]): r for r in queries.p5_pairs(spark, str(tmp_path)).collect()}
    assert {p: r["n_ab"] for p, r in got.items()} == two and any(one[a] < 3 for a, b in got)
    assert all(r["n_a"] == one[a] and r["n_b"] == one[b] and abs(r["lift"] - two[a, b] * len(held) / one[a] / one[b]) < 1e-9 for (a, b), r in got.items())
