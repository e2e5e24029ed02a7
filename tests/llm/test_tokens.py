"""Ids against the reference library of the vocabulary, and the round trip."""

from pathlib import Path

import pytest
from hypothesis import given, settings, strategies as st

from loomcat.llm import tokens

pytestmark = pytest.mark.skipif(not Path(tokens.VOCABULARY).exists(), reason="no vocabulary file")
SAMPLES = ["", "hello world", "  two  blanks ", "<|endoftext|> is text", "naïve façade 東京 😀", "a" * 3000, "\x00﻿​", "don't WE'LL 12345", "x\n\n\ty", "Ġ▁<unk>", "=-" * 400]


@pytest.fixture(scope="module")
def both():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {t: i for i, t in enumerate(tokens.read_ranks())}
    return tokens.Encoder(tokens.piece_model(tokens.read_ranks())), tiktoken.Encoding("own", pat_str=tokens.PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("s", SAMPLES)
def test_samples(both, s):
    ours, theirs = both
    assert ours.ids(s) == theirs.encode_ordinary(s) and ours.text(ours.ids(s)) == s


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any(both, s):
    ours, theirs = both
    assert ours.ids(s) == theirs.encode_ordinary(s) and ours.text(ours.ids(s)) == s


def test_table(spark, both):
    rows = [(i, s, [0]) for i, s in enumerate([*SAMPLES, None])]
    got = {r["doc_id"]: r["ids"] for r in tokens.encoded(spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")).collect()}
    assert got == {i: both[0].ids(s) for i, s, _ in rows} and got[len(SAMPLES)] == [] and got[0] == []
    assert tokens.encoded(spark.createDataFrame([], "doc_id long, text string")).count() == 0
