"""Operators against plain models on small fixtures, with nulls, empty tables, ties and repeats."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomcat import vocabulary as V
from loomcat.functions import tokens
from loomcat.operators import documents as docs, entity, extract, families, graph, induce, ingest, ledger, propagate, review, search, setjoin, verify
from loomcat.operators.numbering import numbered
from loomcat.sources import catalogue as files, sinks
from loomcat.sources.workbook import write_sheet


def test_numbering(spark):
    xs = random.Random(1).sample(range(1000), 300)
    got = numbered(spark.createDataFrame([(x,) for x in xs], "x int").repartition(7), [F.asc("x")], "n", 5).collect()
    assert {r["x"]: r["n"] for r in got} == {x: i for i, x in enumerate(sorted(xs), 5)}
    assert numbered(spark.createDataFrame([], "x int"), [F.asc("x")], "n").count() == 0


@pytest.mark.parametrize("n,m,seed", [(40, 30, 1), (60, 60, 2), (30, 29, 3)])
def test_components(spark, n, m, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 120)] + [(5, 5), (5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_set_join(spark):
    rng = random.Random(4)
    sets = {f"s{i}": sorted(set(rng.choices("abcdefghijkl", k=rng.randint(1, 7)))) for i in range(60)}
    df = spark.createDataFrame(list(sets.items()), "l string, tokens array<string>")
    got = {(r["l"], r["r"]): round(r["similarity"], 9) for r in setjoin.similar_sets(df, df.withColumnRenamed("l", "r"), 0.5).collect()}
    want = {}
    for a, x in sets.items():
        for b, y in sets.items():
            s = len(set(x) & set(y)) / len(set(x) | set(y))
            if s >= 0.5:
                want[a, b] = round(s, 9)
    assert got == want


def _items(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, description string")
    df = df.withColumn("tokens", tokens.tokens(F.col("description")))
    return df.withColumn("skeleton", tokens.skeleton(F.col("tokens"))).withColumn("words", tokens.content_words(F.col("tokens")))


def test_families(spark):
    texts = ["Stikit Film Disc P80 3 in", "Stikit Film Disc P120 3 in", "Stikit Film Disc P80 3 in", "Odd one out here", "Hex 3 in", "hex 4 in", None, "", "12 x", "5 6 7"]
    f = families.build(_items(spark, texts))
    got = {(r["family_id"], r["row_id"]) for r in f.members.collect()}
    assert got == {("fam-0001", 0), ("fam-0001", 1), ("fam-0001", 2), ("fam-0002", 4), ("fam-0002", 5)}
    assert {r[0] for r in f.singletons.collect()} == {3}
    units = spark.createDataFrame([("Length", "in", ["inch"])], "measurement_type string, canonical string, aliases array<string>")
    axes = {(r["family_id"], r["slot"]): r["label"] for r in families.axis_names(f, units).collect()}
    assert axes[("fam-0001", 3)] == "Grit" and f.blocked().first()[0] == sum(r["n_distinct"] for r in f.slots.where("is_axis").collect())
    empty = families.build(_items(spark, []))
    assert empty.members.count() == 0 and empty.slots.count() == 0


def test_scopes_and_alternatives(spark):
    base = "deck board composite"
    rows = [f"{base} {c} {s}" for c in ("slate", "teak", "cedar") for s in ("long", "short", "grooved", "square")] + ["pipe nipple black iron", "pipe nipple black steel", "lonely words only here"]
    rows += [f"unrelated{i} item{i} thing{i}" for i in range(25)] + ["", "ab cd"]
    items = spark.createDataFrame([(i, r.split()) for i, r in enumerate(rows)], "row_id long, words array<string>")
    scope = {r["row_id"]: r["scope"] for r in induce.scopes(items).collect()}
    # brute force: rows that share three words which at most 35 % of the rows have
    sets = [{w for w in r.split() if len(w) > 2} for r in rows]
    sets = [{w for w in s if sum(w in t for t in sets) <= 0.35 * len(rows)} for s in sets]
    own = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= 3:
                low, high = sorted((own[i], own[j]))
                own = [low if o == high else o for o in own]
    assert [scope[i] for i in range(len(rows))] == own and own[:14] == [0] * 12 + [12, 12]
    of = spark.createDataFrame(list(scope.items()), "row_id long, scope long")
    values = {tuple(r["values"]) for r in induce.induced(items, of).collect()}
    assert ("Cedar", "Slate", "Teak") in values


def test_entities(spark):
    makers = spark.createDataFrame(
        [("Milwaukee Tool, Inc.", "MIL", "Milwaukee", "M1", "milwaukee.example", ["milw"]), ("Ebbe Corp", "EBB", "Ebbe", "E1", "ebbe.example", None), ("Simpson Strong", "SIM", "Strong-Tie", "S1", "sim.example", [])],
        "manufacturer_name string, manufacturer_code string, brand_name string, brand_code string, domain string, aliases array<string>",
    )
    distributors = spark.createDataFrame([("Acme Industrial",)], "name string")
    items = spark.createDataFrame(
        [
            (1, "Milwaukee Tool Inc", "", "", "", "x"), (2, "MILWAUKEE ACCESSORY (4031)", None, None, None, None), (3, "Acme Industrial", "", "", "", "Ebbe drain cover"), (4, "Big Supply Co", "Ebbe", "", "", "no name"),
            (5, "Milwaukee Tol Inc", "", "", "", ""), (6, None, None, None, None, None), (7, "Simpson Strong", "Ebbe", "", "", ""), (8, "Unknown Maker", "", "", "", "plain thing"),
        ],
        "row_id long, part_manuf string, e1_brand string, unilog_brand string, dib_brand string, description string",
    )
    got = {r["row_id"]: (r["manufacturer_code"], r["brand_code"], r["method"]) for r in entity.resolve(items, makers, distributors).collect()}
    assert got[1][::2] == ("MIL", "exact") and got[2][::2] == ("MIL", "exact") and got[3][::2] == ("EBB", "unmasked-from-description") and got[4] == ("EBB", "E1", "from-brand-column")
    assert got[5][::2] == ("MIL", "token-set") and got[6][2] == "unresolved" and got[7] == ("SIM", "E1", "exact") and got[8][2] == "unresolved"
    resolved = entity.resolve(items, makers, distributors)
    assert [r["row_id"] for r in entity.contradictions(resolved, makers).collect()] == [7]
    mapped = spark.createDataFrame([("unknown maker", "Ebbe Corp")], "part_manuf string, manufacturer_name string")
    assert {r["row_id"]: r["method"] for r in entity.resolve(items, makers, distributors, mapped).collect()}[8] == "reviewer-mapped"


UNITS = [("Length", "in", ["inch", '"', "''"]), ("Pressure", "psi", []), ("Voltage", "V", []), ("Count", "pc", []), ("Weight", "lb", ["lbs"])]


def _items(spark, texts):
    cells = [(i, t, *[""] * 5) for i, t in enumerate(texts)]
    return ingest.cleaned(spark.createDataFrame(cells, "row_id long, description string, part_number string, e1_brand string, unilog_brand string, dib_brand string, part_manuf string"))


def test_extraction(spark):
    units = spark.createDataFrame(UNITS, "measurement_type string, canonical string, aliases array<string>")
    texts = ['Milw 5"x.045"x7/8" BRS Disc 120V 120V 25/bx dko', None, "", "nan", "plain words only", "16 X 25 X 1 filter 3 furlongs 2 lb", "Rod 2.5 x 7 blk wht", "9.5/8.25/1.75/4.125 in 5 psi"]
    items = _items(spark, texts)
    sequence = ["Diameter", "Thickness", "Arbor Size", "Package Quantity", "Body Material"]
    cats = items.select("row_id", F.array(*map(F.lit, sequence)).alias("sequence"))
    rows = extract.attributes(items, cats, units).collect()
    of = lambda i: {r["label"]: (r["value"], r["uom"]) for r in rows if r["row_id"] == i}
    assert of(0) == {"Diameter": ("5", "in"), "Thickness": (".045", "in"), "Arbor Size": ("7/8", "in"), "Voltage": ("120", "V"), "Package Quantity": ("25", "pc"), "Body Material": ("Brass", "")}
    assert not of(1) and not of(2) and not of(3) and not of(4)
    # only tokens that carry their unit are measures with one; two colours are one label
    assert of(5)["Nominal Size"] == ("16 x 25 x 1", "") and of(6) == {"Diameter": ("2-1/2", "in"), "Colour": ("Black", "")}
    for i in {r["row_id"] for r in rows}:
        mine = sorted((r for r in rows if r["row_id"] == i), key=lambda r: r["ord"])
        assert [r["ord"] for r in mine] == list(range(len(mine))) and len({r["locator"] for r in mine}) == len(mine) == len({r["label"] for r in mine})
        for r in mine:  # locators point at what they say, in code points
            at, end = map(int, re.search(r"#char\[(\d+):(\d+)\]$", r["locator"]).groups())
            assert 0 <= at < end <= len(texts[i])
            assert r["sequence"] == (sequence.index(r["label"]) if r["label"] in sequence else 900 + r["ord"])


def test_extraction_slots_and_alternatives(spark):
    units = spark.createDataFrame(UNITS, "measurement_type string, canonical string, aliases array<string>")
    items = _items(spark, ["Disc P80 150psi red", "Disc P120 150psi blue"])
    cats = items.select("row_id", F.array(F.lit("Grit")).alias("sequence"))
    slots = spark.createDataFrame([("f", 1, "Grit", True), ("f", 2, None, False), ("f", 9, "Length", True)], "family_id string, slot int, label string, is_axis boolean")
    members = spark.createDataFrame([("f", 0), ("f", 1)], "family_id string, row_id long")
    induced = spark.createDataFrame([(0, "Shade", ["blue", "red"]), (1, "Shade", ["blue", "red"]), (1, None, ["disc"])], "row_id long, label string, values array<string>")
    got = {(r["row_id"], r["label"]): (r["value"], r["uom"], r["kind"]) for r in extract.attributes(items, cats, units, slots, members, induced).collect()}
    assert got == {
        (0, "Grit"): ("P80", "", "derived"), (1, "Grit"): ("P120", "", "derived"), (0, "Pressure Rating"): ("150", "psi", "supplier"), (1, "Pressure Rating"): ("150", "psi", "supplier"),
        (0, "Shade"): ("red", "", "derived"), (1, "Shade"): ("blue", "", "derived"),
    }


def test_fold_against_brute_force(spark):
    rng = random.Random(4)
    labels, seq = ["A", "B", "Material", "Body Material", "Color", None, ""], ["Body Material", "B", "Colour"]
    rows = [(i, j, rng.choice(labels), rng.choice(["x", " y ", "", None]), "", "k", "r", rng.choice([None, *[f"row:{i}:d#char[{n}:{n + 1}]" for n in range(4)]])) for i in range(80) for j in range(rng.randint(0, 9))]
    want = []
    for i in range(80):
        kept = []
        for _, _, label, value, uom, kind, rule, loc in [r for r in rows if r[0] == i]:
            label = {"Material": "Body Material", "Color": "Colour"}.get(label, label)
            if label and (value or "").strip() and all(k[0] != label and (loc is None or k[2] != loc) for k in kept):
                kept.append((label, value.strip(), loc))
        want += [(i, *k, seq.index(k[0]) if k[0] in seq else 900 + n, n) for n, k in enumerate(kept)]
    df = spark.createDataFrame(rows, "row_id long, at int, label string, value string, uom string, kind string, rule string, locator string")
    got = extract.folded(df, spark.range(80).select(F.col("id").alias("row_id"), F.array(*map(F.lit, seq)).alias("sequence")))
    key = lambda r: (r[0], r[5])
    assert sorted([(r["row_id"], r["label"], r["value"], r["locator"], r["sequence"], r["ord"]) for r in got.collect()], key=key) == sorted(want, key=key)
    assert extract.folded(df.limit(0), spark.range(3).select(F.col("id").alias("row_id"), F.array(F.lit("B")).alias("sequence"))).count() == 0


def test_classify(spark):
    tree = spark.createDataFrame([(0, "P>a", "a valves", ["valve"], ["X"]), (1, "P>b", "long", ["one two three four five six seven", "Ball Valve"], ["Y"]), (2, "P>c", "c", None, ["Z"])], "ord int, classpath string, leaf string, keywords array<string>, sequence array<string>")
    items = _items(spark, ["Ball-Valve 3in", "my valve", "ballvalve", "x one two three four five six seven", "valves only", None, "gizmo", "z" * 50_000 + " valve"])
    got = {r["row_id"]: r["keyword"] for r in extract.classify(items, tree).collect()}
    assert got == {0: "Ball Valve", 1: "valve", 2: "Ball Valve", 3: "one two three four five six seven", 4: "valve", 5: None, 6: None, 7: "valve"}
    mapped = spark.createDataFrame([("Gizmo", "P>c")], "item_type string, classpath string")
    assert {r["row_id"]: r["keyword"] for r in extract.classify(items, tree, mapped).collect()}[6] == "(mapped)"
    assert extract.classify(items, tree.limit(0)).where("classified").count() == 0


def test_propagation(spark):
    a = spark.createDataFrame([(1, "Backing", "Film", "", None), (2, "Backing", "Film", "", "row:2:x#char[0:1]"), (1, "Grade", "A", "", None), (2, "Grade", "B", "", None), (4, "Backing", "Paper", "", None), (1, "Package Quantity", "25", "pc", None)], "row_id long, label string, value string, uom string, locator string")
    g = spark.createDataFrame([(1, "m", "l"), (2, "m", "l"), (3, "m", "l"), (4, "n", "l"), (5, None, "l"), (6, "m", None)], "row_id long, manufacturer_name string, leaf string")
    p = propagate.run(a, g)
    assert {(r["row_id"], r["label"], r["value"], r["uom"]) for r in p.given.collect()} == {(3, "Backing", "Film", ""), (2, "Package Quantity", "25", "pc"), (3, "Package Quantity", "25", "pc")}
    assert [(r["label"], r["n_values"], r["silent"]) for r in p.blocked.collect()] == [("Grade", 2, 1)]
    assert propagate.run(a.limit(0), g).given.count() == 0


def test_ledger(spark):
    rows = [(1, "A", "x", "inferred", "l", 0), (1, "A", "y", "sourced", "l", 1), (1, "A", "Y ", "supplier", "l", 2), (1, "A", "z", "sourced", None, 3), (1, "B", " ", "vocab", None, 4), (1, "C", "v", "vocab", None, 5), (1, "C", "w", "vocab", None, 6)]
    c = ledger.claims_of(spark.createDataFrame(rows, "row_id long, field string, value string, kind string, locator string, claim_ord long"))
    won = {r["field"]: (r["value"], r["claim_ord"]) for r in ledger.winners(c).collect()}
    assert won == {"A": ("y", 1), "C": ("v", 5)}
    assert {(r["field"], r["dropped"]) for r in ledger.conflicts(c).collect()} == {("A", "x"), ("C", "w")}
    assert ledger.unlocated(c).count() == 1 and ledger.winners(c.limit(0)).count() == 0


DOC = "Acme AB-1\nAcme wheel\n\nOverview\nGood wheel\nfor metal.\n\nFeatures\n- Fast\n- Safe\n\nApplications\n- Steel\n\nSpecifications\nDiameter: 5 in\nUPC: 123\nDiameter: 6 in\nno value:\n\nDocuments\nSpec Sheet: https://acme.example/a.pdf\nLocal: file.pdf\n\nManufacturer Part Number: AB-1"


def test_documents(spark):
    d = spark.createDataFrame([(1, DOC, "AB1"), (2, None, "x"), (3, "", None), (4, "one line", "zz"), (5, "x" * 200_000, "q")], "doc_id long, text string, part_number string")
    spec = {(r["label"]): (r["value"], DOC[r["start"] : r["end"]]) for r in docs.spec_block(d).collect()}
    assert spec == {"Diameter": ("6 in", "6 in"), "UPC": ("123", "123")}
    assert [(r["value"], DOC[r["start"] : r["end"]]) for r in docs.bullets(d, "Features").orderBy("n").collect()] == [("Fast", "Fast"), ("Safe", "Safe")]
    assert [r["value"] for r in docs.bullets(d, "Applications").collect()] == ["Steel"] and docs.title(d).first()["title"] == "Acme wheel"
    m = docs.marketing(d).first()
    assert m["body"] == "Good wheel for metal." and DOC[m["start"] : m["end"]] == "Good wheel\nfor metal."
    assert [(r["label"], r["url"]) for r in docs.links(d).collect()] == [("Spec Sheet", "https://acme.example/a.pdf")]
    said = {r["field"]: (r["value"], DOC[r["start"] : r["end"]]) for r in docs.facts(d.withColumn("domain", F.lit("acme.example"))).where("doc_id = 1").collect()}
    assert said["FEATURE_02"] == ("Safe", "Safe") and said["IMAGE_ALT_TEXT"] == ("Acme wheel", "Acme wheel") and said["SPEC_SHEET_URL"][0] == said["SPEC_SHEET_URL"][1] == "https://acme.example/a.pdf" and said["ASSET_COUNT"][0] == "1"
    assert {r["doc_id"]: r["named"] for r in docs.names_part(d).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_gate(spark):
    makers = spark.createDataFrame([("Acme Wheels", "acme.example")], "manufacturer_name string, domain string")
    urls = [("https://www.amazon.com/x", "Acme Wheels"), ("https://docs.acme.example/a", "Acme Wheels"), ("nonsense", "Acme Wheels"), ("https://toolsupply.example/a", "Acme Wheels"), ("https://acmewheels.test/", "Acme Wheels"), ("https://other.test/", None), (None, None)]
    got = {r["url"]: (r["verdict"], r["reason"]) for r in docs.gate(spark.createDataFrame(urls, "url string, manufacturer_name string"), makers).collect()}
    assert got["https://docs.acme.example/a"][0] == "admitted" and got["https://acmewheels.test/"][0] == "admitted"
    assert [got[u][0] for u in ("https://www.amazon.com/x", "nonsense", "https://toolsupply.example/a", "https://other.test/", None)] == ["rejected"] * 5


def test_search(spark):
    d = spark.createDataFrame([(1, "cut off wheel"), (2, "wheel wheel grinder"), (3, None), (4, "pipe")], "doc_id long, text string")
    idx = search.index(d)
    q = spark.createDataFrame([(1, "wheel grinder"), (2, "zzz"), (3, None), (4, "wheel wheel")], "query_id long, query string")
    hits = search.top(search.scores(idx, search.query_terms(q)), 2)
    assert [(r["query_id"], r["rank"], r["doc_id"]) for r in hits.orderBy("query_id", "rank").collect()] == [(1, 1, 2), (1, 2, 1), (4, 1, 2), (4, 2, 1)]
    rel = spark.createDataFrame([(1, 1), (2, 4)], "query_id long, doc_id long")
    m = search.quality(hits, rel, q, 2).first()
    assert (m["n_queries"], m["recall"], m["mrr"], m["zero_share"]) == (2, 0.5, 0.25, 0.5)
    assert search.top(search.scores(search.index(d.limit(0)), search.query_terms(q))).count() == 0


def test_untraced(spark):
    made = spark.createDataFrame([(1, "5 in 007 wheel")], "row_id long, INVOICE_DESC string").select("*", *[F.lit(None).cast("string").alias(c) for c in verify.GENERATED[1:]])
    claims = spark.createDataFrame([(1, "INVOICE_DESC", "5 in 007 wheel"), (1, "ATTR::D", "5 in")], "row_id long, field string, value string")
    none = claims.select("row_id", "value").limit(0)
    assert [r["number"] for r in verify.untraced_numbers(made, claims, none, none).collect()] == ["7"]
    assert verify.untraced_numbers(made, claims, none, none, strict=False).count() == 0


def test_header_names_and_profile(spark):
    df, rest = ingest.named(spark.createDataFrame([("a", "b", "c")], "`Mfg Part Num` string, Description string, colour string"))
    assert df.columns == ingest.CELLS and rest == ["colour"] and df.first()["e1_brand"] == ""
    lines = spark.createDataFrame([(0, ["x", "y"]), (1, ["Part_Desc", " MPN "]), (2, ["part_desc", "mpn"])], "line int, cells array<string>")
    assert ingest.header_row(lines).first()["line"] == 1
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in ingest.CELLS))
    assert ingest.profile(empty).first()["n_rows"] == 0


def test_review_queue(spark):
    held = spark.createDataFrame([(1, "no category; no manufacturer"), (2, "no category"), (3, "few attributes"), (4, "few attributes"), (5, "no manufacturer"), (6, "")], "row_id long, reasons string")
    cats = spark.createDataFrame([(1, None, "gizmo"), (2, None, " gizmo "), (3, "Valves", "Valve"), (4, "Valves", "Valve"), (5, "Valves", "Valve"), (6, None, None)], "row_id long, leaf string, item_type string").withColumn("sequence", F.when(F.col("leaf") == "Valves", F.array(F.lit("Size"), F.lit("Body"))).otherwise(F.array().cast("array<string>")))
    attrs = spark.createDataFrame([(3, "Size"), (4, "Size"), (3, "Size")], "row_id long, label string")
    items = spark.createDataFrame([(i, None if i == 5 else "acme", f"d{i}") for i in range(1, 7)], "row_id long, part_manuf string, description string")
    contra = spark.createDataFrame([(6, "A", "B", "C")], "row_id long, manufacturer_name string, brand_name string, owner string")
    unnamed = spark.createDataFrame([(1, "a1", ["x", "y"], 2), (2, "a1", ["x", "y"], 2), (3, "a2", ["z"], 1)], "row_id long, attr_id string, values array<string>, support int")
    q = review.queue(held, cats, attrs, items, contra, unnamed)
    got = [(r["action_id"], r["kind"], r["key"], r["records"], r["examples"]) for r in q.actions.orderBy("action_id").collect()]
    assert got == [
        ("act-0001", "no category", "Gizmo", 2, ["d1", "d2"]), ("act-0002", "unnamed attribute", "a1", 2, ["d1", "d2"]), ("act-0003", "few attributes", "Valves", 2, ["d3", "d4"]),
        ("act-0004", "contradiction", "6 / A / B / C", 1, ["d6"]), ("act-0005", "no manufacturer", "(empty)", 1, ["d5"]), ("act-0006", "no manufacturer", "acme", 1, ["d1"]),
    ]
    assert {r["kind"]: r["options"] for r in q.actions.collect()}["few attributes"] == ["Body"]
    assert {r["kind"]: (r["actions"], r["records"]) for r in q.blockers().collect()}["no manufacturer"] == (2, 2)
    assert review.queue(held.limit(0), cats, attrs, items, contra.limit(0)).actions.count() == 0


def test_decisions(spark, tmp_path):
    log = f"{tmp_path}/log"
    for d in [("manufacturer", "acme", "Old", "1"), ("item_type", "gizmo", "P>a", "2")]:
        sinks.append_decisions(review.decision(spark, *d), log)
    sinks.append_decisions(review.cleared(spark, "3"), log)
    for d in [("manufacturer", "acme", "Acme Inc.", "4"), ("contradiction", "6", "maker", "5"), ("contradiction", "7", "brand", "5"), ("contradiction", "8", "escalate", "6")]:
        sinks.append_decisions(review.decision(spark, *d), log)
    live = files.decided(spark.read.json(log))
    assert {(r["kind"], r["key"], r["value"]) for r in live.collect()} == {("manufacturer_map", "acme", "Acme Inc."), ("contradictions", "6", "maker"), ("contradictions", "7", "brand"), ("contradictions", "8", "escalate")}
    assert review.summary(live).first().asDict() == {"decisions": 4, "item_types_mapped": 0, "attributes_named": 0, "manufacturers_mapped": 1, "contradictions_resolved": 3}
    resolved = spark.createDataFrame([(6, "A", "B"), (7, "A", "B"), (8, "A", "B"), (9, "A", "B")], "row_id long, manufacturer_name string, brand_name string")
    contra = resolved.withColumn("owner", F.lit("C"))
    after, open_ = review.settled_contradictions(resolved, contra, live)
    assert {r["row_id"]: (r["manufacturer_name"], r["brand_name"]) for r in after.collect()} == {6: ("C", "B"), 7: ("A", ""), 8: ("A", "B"), 9: ("A", "B")}
    assert {r["row_id"] for r in open_.collect()} == {8, 9}
    with pytest.raises(ValueError):
        review.decision(spark, "other", "", "", "1")


def test_workbooks(spark, tmp_path):
    path = f"{tmp_path}/c.xlsx"
    df = spark.createDataFrame([("A-1", 'x & <y> "z"', None), ("", "line\nbreak", "é\x01½")], "mpn string, description string, brand string")
    assert sinks.write_workbook(df, path) == 2 and sinks.workbook_cells(path) == (2, 4)
    assert [r.asDict() for r in files.read_cells(spark, path).collect()] == [{"mpn": "A-1", "description": 'x & <y> "z"', "brand": ""}, {"mpn": "", "description": "line\nbreak", "brand": "é½"}]
    assert files.read_catalogue(spark, path).orderBy("row_id").first()["e1_brand"] == ""
    seed = spark.createDataFrame([("Acme", "ACM", "Ac", "AC1", "acme.example", "tools", ["acm"])], "manufacturer_name string, manufacturer_code string, brand_name string, brand_code string, domain string, sector string, aliases array<string>")
    units = spark.createDataFrame([("Length", "in", ["inch"])], "measurement_type string, canonical string, aliases array<string>")
    write_sheet(f"{tmp_path}/manufacturers.xlsx", ["Title"], [["", ""], ["No.", "Manufacturer Name", "Manufacturer Code", "Brand Name", "Brand Code"], ["1", "Acme", "ACM", "", "B1"], ["2", "New", "NEW", "Nw", "B2"], []])
    write_sheet(f"{tmp_path}/units.xlsx", ["Measurement Type", "Abbreviation", "Terms"], [["Length", "IN", "inch, zoll"]])
    tables, whence = files.assembled(spark, str(tmp_path), {"manufacturers": seed, "units": units})
    assert whence == {"manufacturers": "supplied", "units": "supplied over seed"}
    assert {(r["manufacturer_name"], r["brand_name"], r["domain"]) for r in tables["manufacturers"].collect()} == {("Acme", "Acme", "acme.example"), ("New", "Nw", "")}
    assert {a: r["canonical"] for r in tables["units"].collect() for a in r["aliases"]} == {"in": "IN", "ins": "IN", "inch": "IN", "zoll": "IN"}
    assert files.assembled(spark, f"{tmp_path}/none", {"manufacturers": seed, "units": units})[1] == {"manufacturers": "seed", "units": "seed"}


def test_abstentions_and_reports(spark):
    items = _items(spark, ["Brs dko DKO ftg x", "plain"])
    cats = spark.createDataFrame([(0, True, "x"), (1, False, "gizmo")], "row_id long, classified boolean, item_type string")
    res = spark.createDataFrame([(0, "exact"), (1, "unresolved")], "row_id long, method string")
    composed = spark.createDataFrame([(0, "m" * 60), (1, None)], "row_id long, MOBILE_DESC string")
    sourced = spark.createDataFrame([(0, "MARKETING_DESC")], "row_id long, field string")
    gone = spark.createDataFrame([(1, "UPC", "1")], "row_id long, field string, value string")
    told = review.abstentions(items, cats, res, composed, sourced, gone)
    assert sorted((r["row_id"], r["field"], r["detail"]) for r in told.collect()) == [(0, "ABBREVIATION", "DKO"), (0, "ABBREVIATION", "FTG"), (1, "CLASSPATH", "gizmo"), (1, "MANUFACTURER_NAME", ""), (1, "MARKETING_DESC", ""), (1, "MOBILE_DESC", ""), (1, "PRIMARY_IMAGE_URL", ""), (1, "PUBLISHING_RULE", "UPC")]
    assert {r["reason"]: r["abstentions"] for r in review.by_reason(told).collect()}["abbreviation left unexpanded"] == 2
    assert review.systematic(spark.range(1000), "id", 300).count() == 334
    df = spark.createDataFrame([(0.5,), (2.25,), (0.99,), (0.0,), (None,), (-1.0,), (1.999,)], "x double")
    assert [r[0] for r in df.select(review.nearest_fraction(F.col("x"))).collect()] == ["1/2", "1/4", "63/64", "", None, None, ""]
