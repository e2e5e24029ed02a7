"""Spellings of names: reading, the trie join against brute force, links, and codes."""

import random

import pytest

from loomcat.llm import names
from loomcat.llm.spelling import edits, read_brand, read_organisation


@pytest.mark.parametrize(
    "name,proper,trade",
    [
        ("Cortorsen Fastening Systems, Inc.", "cortorsen", "fastening"), ("c0rtorsen fast sys", "cortorsen", "fastening"), ("FASTENING SYSTEMS, CORTORSEN", "cortorsen", "fastening"), ("CortorsenFasteningSystems", "cortorsen", "fastening"),
        ("cortorsen-fastening-systems", "cortorsen", "fastening"), ("The Cortörsen Fastening Systems (4031)", "cortorsen", "fastening"), ("Cortorsen's Fastening Systems", "cortorsen", "fastening"), ("Cortorsen Program 7547", "cortorsen", ""),
        ("Bill Valdalbren Electric L.L.C.", "valdalbren", "electric"), ("W. Valdalbren Elec", "valdalbren", "electric"), ("Ｃｏｒｔｏｒｓｅｎ", "cortorsen", ""),
    ],
)
def test_organisations(name, proper, trade):
    assert read_organisation(name)[:2] == (proper, trade)


@pytest.mark.parametrize("name", ["Porranwen Guard", "PORRANWEN GUARD TM", "Porranwen(R)", "Porran-wen", "porran wen", "Ｐｏｒｒａｎｗｅｎ", "Porranwén®", "Guard, Porranwen", "PorranwenGuard", "P0rranwen brand"])
def test_brands(name):
    assert read_brand(name).proper == "porranwen"


def test_edits():
    assert edits("abcd", "abdc", 2) == 1 and edits("abcd", "abcd", 2) == 0 and edits("abcd", "xbcy", 2) == 2 and edits("abcd", "wxyz", 2) == 3 and edits("", "ab", 2) == 2


def test_trie_join(spark):
    rng = random.Random(8)
    keys = {"".join(rng.choices("abc", k=rng.randint(3, 9))) for _ in range(250)}
    df = spark.createDataFrame([("manuf", k, True) for k in keys] + [("brand", "aaaaaaa", True)], "kind string, key string, asks boolean")
    got = {(r["key"], r["other"]): r["distance"] for r in names.near_keys(df).where("kind = 'manuf'").collect()}
    want = {(a, b): d for a in keys for b in keys if a != b and (d := edits(a, b, names.EDITS)) <= names.allowed(a, b)}
    assert got == want


def test_trie_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(names, "BLOCK", 3)
    keys = [f"prefixsame{c}{d}" for c in "abcdef" for d in "uvw"]
    df = spark.createDataFrame([("m", k, True) for k in keys], "kind string, key string, asks boolean")
    assert {(r["key"], r["other"]) for r in names.near_keys(df).collect()} == {(a, b) for a in keys for b in keys if a != b and edits(a, b, 2) <= 2}


CELLS = [
    ("manuf", n) for n in ["Cortorsen Fastening Systems, Inc.", "cortorsen fast sys", "CORTORSEN FASTENING SYSTEMS", "Cortorsne Fastening Systems", "Cortor. Fastening Systems", "Cortorsen Direct", "Ranlormir Coatings, LLC", "Ranlormir Coatings",
                           "Coatings Ranlormir", "Ranlormir Power Tools Corporation", "Ranlormir Pwr Tools", "RANLORMIR POWER TOOLS", "nan", "", None, "  ", "N/A", "---"]
] + [("brand", "Cortorsen"), ("brand", "CORTORSEN TM"), ("brand", "Cortorsen")]


def test_links(spark):
    got = {(r["kind"], r["name_a"], r["name_b"]) for r in names.variant_pairs(spark.createDataFrame(CELLS, "kind string, name string")).collect()}
    cor = [n for _, n in CELLS[:6]]
    want = {("manuf", *sorted((a, b))) for a in cor for b in cor if a != b}
    want |= {("manuf", *sorted((a, b))) for g in (CELLS[6:9], CELLS[9:12]) for _, a in g for _, b in g if a != b} | {("brand", "CORTORSEN TM", "Cortorsen")}
    assert got == want
    assert names.variant_pairs(spark.createDataFrame([], "kind string, name string")).count() == 0


def test_codes(spark):
    listed = spark.createDataFrame([("manuf", "Cortorsen Fastening Systems, Inc.", "CORLU"), ("manuf", "Ranlormir Coatings, LLC", "RANCO"), ("manuf", "Ranlormir Power Tools Corporation", "RANPT"), ("brand", "Porranwen Guard", "PORJG")], "kind string, name string, code string")
    entered = [("part_manuf", "manuf", n) for n in ["Cortorsen Fastening Systems, Inc.", "c0rtorsen fast sys", "Cortorsne Direct", "Cortor Fast Sys Inc.", "Ranlormir Pwr Tools", "Ranlormir", "Nelzanlor Wholesale", "VARIOUS", "nan", None, ""]] + [("e1_brand", "brand", "porran wen")]
    got = {(r["field_name"], r["entered"]): r["code"] for r in names.canonical_codes(spark.createDataFrame(entered, "field_name string, kind string, name string"), listed).collect()}
    assert got == {
        ("part_manuf", "c0rtorsen fast sys"): "CORLU", ("part_manuf", "Cortorsne Direct"): "CORLU", ("part_manuf", "Cortor Fast Sys Inc."): "CORLU", ("part_manuf", "Ranlormir Pwr Tools"): "RANPT", ("part_manuf", "Ranlormir"): "NONE",
        ("part_manuf", "Nelzanlor Wholesale"): "NONE", ("part_manuf", "VARIOUS"): "NONE", ("e1_brand", "porran wen"): "PORJG",
    }
    assert {r["code"] for r in names.canonical_codes(spark.createDataFrame(entered, "field_name string, kind string, name string"), listed.limit(0)).collect()} == {"NONE"}


def test_orders_short_names_and_chains(spark):
    names_of = {"Black Decker": 9, "Decker Black": 1, "Blakc Decker": 1, "Black Diamond": 9, "Smith Brothers": 5, "Smith Sons": 5, "Moen": 9, "Mohn": 1, "Meon": 1, "Delta": 9, "3M": 4, "Hilti": 3, "Milti": 3, "Abcdefghijkl": 9, "Abcdefghijxy": 3, "Abcdefghizxy": 2, "Abcdefgwvzxy": 1}
    cells = spark.createDataFrame([("manuf", n) for n, k in names_of.items() for _ in range(k)], "kind string, name string")
    known = spark.createDataFrame([("manuf", n) for n in ("Black Decker", "Black Diamond", "Moen", "Hilti", "Milti")], "kind string, name string")
    classes = {r["name"]: r["class_id"] for r in names.linked_names(cells, known).collect()}
    groups = [["Black Decker", "Decker Black", "Blakc Decker"], ["Black Diamond"], ["Smith Brothers"], ["Smith Sons"], ["Moen", "Mohn", "Meon"], ["Delta"], ["3M"], ["Hilti"], ["Milti"], ["Abcdefghijkl", "Abcdefghijxy", "Abcdefghizxy", "Abcdefgwvzxy"]]
    assert sorted(map(sorted, groups)) == sorted(sorted(n for n in classes if classes[n] == c) for c in set(classes.values()))


def test_short_and_far_cut_names_have_codes(spark):
    listed = spark.createDataFrame([("manuf", "Moen", "MOE"), ("manuf", "Cortorsenbalgalmar Tools", "COR"), ("brand", "Moxn", "BRA")], "kind string, name string, code string")
    entered = [("part_manuf", "manuf", n) for n in ["Mohn", "Meon Inc.", "Mxyn", "Cortor. Tools", "Tools Cortorsenbalglamar"]]
    got = {r["entered"]: r["code"] for r in names.canonical_codes(spark.createDataFrame(entered, "field_name string, kind string, name string"), listed).collect()}
    assert got == {"Mohn": "MOE", "Meon Inc.": "MOE", "Mxyn": "NONE", "Cortor. Tools": "COR", "Tools Cortorsenbalglamar": "COR"}
