"""Text functions and the tokenizer against plain models."""

import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from loomcat import vocabulary as V
from loomcat.functions import text, tokens
from loomcat.functions.measures import Units, parse_measure, trade_number


def test_tokens_match_a_model(spark):
    pieces = ["5\"x.045\"x7/8\"", "4-1/2 in", "P150", "QO120CP", "16x25x1", "2.5gal", "49-94-0013", "3M™", "T&P", "[new]", "NM-B", "60A-x", "1/2''", "é½", "a_b", " ", "  ", "-", "24in.", "O'Neil", "3/4 IN"]
    import random

    random.seed(3)
    texts = [" ".join(random.sample(pieces, random.randint(1, 8))) for _ in range(300)] + ["", "   ", "x" * 20_000]
    master = re.compile("|".join(f"(?P<k{i}>{p})" for i, (_, p) in enumerate(V.TOKEN_KINDS)))

    def model(s):
        out = []
        for m in master.finditer(s):
            kind = next(V.TOKEN_KINDS[int(g[1:])][0] for g, v in m.groupdict().items() if v is not None)
            t = m[0].rstrip()
            out.append((t, m.start(), m.start() + len(t), kind))
        return out

    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    for r in df.select("i", tokens.tokens(F.col("s")).alias("t")).collect():
        assert [(t["text"], t["start"], t["end"], t["kind"]) for t in r["t"]] == model(texts[r["i"]])


def test_skeleton_and_words(spark):
    df = spark.createDataFrame([('Milw 5"x.045"x7/8" Metal Cut Off Disc P150',), (None,)], "s string").select(tokens.tokens(F.col("s")).alias("t"))
    a, b = df.select(tokens.skeleton(F.col("t")).alias("k"), tokens.content_words(F.col("t")).alias("w")).collect()
    assert a["k"] == "milw # x # x # metal cut off disc #" and a["w"] == ["milw", "metal", "cut", "off", "disc"] and (b["k"], b["w"]) == ("", [])


def test_placeholders_and_clean(spark):
    cells = [None, "", "  ", "nan", "NaT", "-- Unbranded --", "---", "N/A", "na", "None", "TBD", "...", "0", " Acme  Co ", "0.5", "-"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(text.clean(F.col("c"))).collect()]
    assert got == [""] * 13 + ["Acme Co", "0.5", "-"]
    again = [r[0] for r in spark.createDataFrame([(c,) for c in got], "c string").select(text.clean(F.col("c"))).collect()]
    assert again == got


def test_numbers(spark):
    pairs = {"0.5": "1/2", "50.25": "50-1/4", "0.045": ".045", ".045": ".045", "2.0": "2", "4/8": "4/8", "1 - 1/2": "1-1/2", "12": "12", "x": "x", "0.015625": "1/64", "3.": "3"}
    df = spark.createDataFrame([(k,) for k in pairs], "s string").select("s", text.trade_number(F.col("s")).alias("t"), text.to_decimal(F.col("s")).alias("d"))
    got = {r["s"]: r for r in df.collect()}
    assert {k: r["t"] for k, r in got.items()} == pairs
    assert got["1 - 1/2"]["d"] == 1.5 and got["4/8"]["d"] == 0.5 and got["x"]["d"] is None
    assert all(trade_number(k) == v for k, v in pairs.items() if k not in ("x", "1 - 1/2", "3."))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 5000), st.integers(1, 4))
def test_trade_number_keeps_the_value(n, places):
    s = f"{n / 10**places:.{places}f}"
    t = trade_number(s)
    whole, _, part = t.rpartition("-") if "/" in t else ("", "", t)
    value = (int(whole) if whole else 0) + (int(part.split("/")[0]) / int(part.split("/")[1]) if "/" in part else float(part))
    assert abs(value - float(s)) < 1e-9


def test_fit(spark):
    words = "Acme Grinder, heavy duty, 4-1/2 in, with guard and a very long trailing description"
    rows = [(words, n) for n in range(1, 90)]
    for n in (3, 12, 20, 40, 60, 120):
        got = spark.createDataFrame([(words,), ("",), (None,), ("x" * 500,)], "s string").select(text.fit(F.col("s"), n)).collect()
        assert all(r[0] is None or len(r[0]) <= n for r in got) and words.startswith(got[0][0])
    assert rows and got[0][0] == words


def test_locators_and_spans(spark):
    df = spark.createDataFrame([("Blue 4-1/2 IN wheel", "4-1/2 in"), ("abc", ""), ("Size 75mm", "75 mm"), ("abc", "zz")], "t string, n string")
    got = [r[0] for r in df.select(text.find_span(F.col("t"), F.col("n"))).collect()]
    assert [tuple(x) if x else None for x in got] == [(5, 13), None, (5, 7), None]
    loc = spark.createDataFrame([("doc:d1#char[3:9]",), ("row:5:description#char[1:2]",), ("bad",)], "l string").select(text.parse_locator(F.col("l"))).collect()
    assert loc[0][0]["ref"] == "d1" and loc[1][0]["ref"] == "5:description" and loc[2][0] is None


def test_title_and_invoice(spark):
    df = spark.createDataFrame([("ball valve with npt ends, 5 in 3m® PVC",)], "s string").select(text.title_case(F.col("s"), ["in"]).alias("t"), text.invoice_form(F.col("s")).alias("i"))
    r = df.first()
    assert r["t"] == "Ball Valve with NPT Ends, 5 in 3m® PVC" and r["i"].startswith("BALL VLV W/ NPT")


def test_units_of_texts():
    book = Units.of([("Length", "in", ["inch", "inches", '"']), ("Weight", "lb", ["lbs", "pound"]), ("Pressure", "psi", [])])
    assert book.normal("24inch x 0.5 pound") == "24 in x 1/2 lb" and book.canonical("#") is None
    assert book.bad_spellings("5 pound bag", []) == ["pound"] and book.bad_spellings("5 pound bag", ["5 pound"]) == []
    assert book.glued("24in and 3M", []) == ["24in"]
    assert book.normal("1 - 1/2 inches and 3 furlongs, 2lbs.") == "1-1/2 in and 3 furlongs, 2 lb." and book.normal(None) == "" and book.normal('4" x 6"') == "4 in x 6 in"
    assert book.glued("5inch 6in2 7in-lb x8in 9 in", []) == ["5inch"] and book.glued("PVC017398in", ["017398in"]) == []
    assert book.bad_spellings("5 POUND, 6 lbs, 7 inch with 8 in", [], True) == ["POUND", "inch", "lbs"]


def test_parsed_measures(spark):
    book = Units.of([("Length", "in", ["inch", "inches", '"'])])
    df = spark.createDataFrame([('5"',), ("4.5 inches",), ("5 furlongs",), ("5",), (None,), ("",), ("1 - 1/2 in",)], "s string")
    got = {r["s"]: (r["p"]["magnitude"], r["p"]["unit"]) if r["p"] else None for r in df.select("s", parse_measure(F.col("s"), book).alias("p")).collect()}
    assert got == {'5"': ("5", "in"), "4.5 inches": ("4-1/2", "in"), "5 furlongs": None, "5": ("5", None), None: None, "": None, "1 - 1/2 in": ("1-1/2", "in")}
