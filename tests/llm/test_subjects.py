"""Subjects of documents: held-out accuracy, the beam against all combinations, and cases without a result."""

import itertools
import random

import numpy as np

from loomcat.llm import subjects

AREAS = {"law": ["court order", "plea bargain", "jury duty"], "sport": ["goal kick", "free throw", "relay race"], "food": ["olive oil", "rye bread", "plum jam"]}
FILL = ["Prices hold until spring.", "Please quote order 12.", "Our office is closed today."]


def _doc(rng, chosen):
    out = []
    for s in chosen:
        out += [rng.choice(["Check the {} twice.", "Store the {} dry.", "No other {} is as good."]).format(rng.choice(AREAS[s])) for _ in range(rng.randint(4, 7))]
    for s in rng.sample(sorted(AREAS), 1):
        out += [f"Check the {rng.choice(AREAS[s])} twice."] * (s not in chosen and len(out) > 6)
    return " ".join(out + rng.choices(FILL, k=3))


def _rows(n, seed, noise=0.05):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        chosen = rng.choice([["law"], ["sport"], ["food"], ["law", "food"], []])
        label = chosen if rng.random() > noise else [rng.choice(sorted(AREAS))]
        rows.append((_doc(rng, chosen), "note", frozenset(label), frozenset(chosen)))
    return rows


def test_held_out():
    names = sorted(AREAS)
    train, test = _rows(300, 1), _rows(150, 2)
    model, chain = subjects.fit([r[:3] for r in train], names)
    found = [model.counts(r[0]) for r in test]
    counts = np.array([f[0] for f in found])
    extra = np.array([subjects.structure(r[0], r[1], f[1]) for r, f in zip(test, found, strict=True)])
    got = chain.decode(subjects._columns(counts, extra)) * (counts[:, : len(names)] > 0)
    right = [{names[j] for j in np.nonzero(g)[0]} == set(r[3]) for g, r in zip(got, test, strict=True)]
    assert np.mean(right) > 0.9
    before, after = chain.calibrated  # held-out log loss: the lines make it no worse
    assert after <= before + 1e-6


def test_calibration_mends_overconfidence():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 40))
    y = (x[:, :1] + rng.normal(size=(60, 1)) > 0).astype(float)
    chain = subjects.Chain(subjects._columns(np.c_[np.ones((60, 1)), np.zeros((60, 1))], x), y)
    before, after = chain.calibrated
    assert after < before and 0 < chain.lines[0, 1] < 1


def test_long_tags_are_no_text():
    assert subjects.sentences("<a href='" + "x" * 500 + "'>Court order</a> 3 < 4") == [["court", "order"]]


def test_beam_finds_the_best(monkeypatch):
    rng = np.random.default_rng(3)
    y = (rng.random((80, 3)) > 0.5).astype(float)
    x = subjects._columns(rng.integers(0, 5, (80, 6)).astype(float), rng.random((80, subjects.FEATURES)))
    chain = subjects.Chain(x, y)
    monkeypatch.setattr(subjects, "BEAM", 8)
    got = chain.decode(x)

    def log(row, labels):
        total, before = 0.0, np.zeros((1, 0))
        for j, w in zip(chain.order, chain.weights, strict=True):
            z = float(np.clip(chain.lines[j, 0] + chain.lines[j, 1] * (subjects._for_label(row, 3, j, before) @ w), -30, 30)[0])
            total += -np.logaddexp(0, -z) if labels[j] else -np.logaddexp(0, z)
            before = np.c_[before, [[labels[j]]]]
        return total

    for i in range(20):
        best = max(itertools.product((0.0, 1.0), repeat=3), key=lambda c: log(x[i : i + 1], c))
        assert np.isclose(log(x[i : i + 1], best), log(x[i : i + 1], got[i]))


def test_table(spark):
    rows = _rows(200, 4, 0)
    docs = [(i, t, s, None, 1) for i, (t, s, _, _) in enumerate(rows)] + [(900, None, "note", None, 1), (901, "  ", None, None, 1), (902, "x " * 50_000, None, None, 1), (903, "Ã©tÃ© court order. Check the court order twice.", None, None, 1)]
    labels = [(i, s, "a") for i, r in enumerate(rows) if i < 120 for s in (r[2] or {None})]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, subject int")
    names = spark.createDataFrame([(s,) for s in AREAS], "subject string")
    told = spark.createDataFrame(labels + labels[:5], "doc_id long, subject string, annotator string")
    got = subjects.document_subjects(d, told, names).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["subject"])
    assert np.mean([by.get(i, set()) == set(rows[i][3]) for i in range(120, 200)]) > 0.9 and not {900, 901, 902} & set(by)
    assert subjects.document_subjects(d, told.limit(0), names).count() == 0 and subjects.document_subjects(d.limit(0), told, names).count() == 0
    assert subjects.repaired("fÃ¼r") == "für" and subjects.repaired("für") == "für"
