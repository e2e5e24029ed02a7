"""The whole compile, files, streams and the driver contract on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomcat import vocabulary as V
from loomcat.api import Engine
from loomcat.operators import review
from loomcat.plans.compile import compile_catalogue, leaves
from loomcat.sources import catalogue as files, sinks
from loomcat.streaming import items as stream
from loomcat.vocabulary import Vocabulary


def _vocabulary(spark):
    units = spark.createDataFrame([("Length", "in", ["inch", "in."]), ("Voltage", "V", ["volt"]), ("Weight", "lb", ["lbs"])], "measurement_type string, canonical string, aliases array<string>")
    makers = spark.createDataFrame([("Acme Wheels Inc.", "ACM", "Acme", "A1", "acme.example", ["acme wheels"])], "manufacturer_name string, manufacturer_code string, brand_name string, brand_code string, domain string, aliases array<string>")
    return Vocabulary(units, makers, spark.createDataFrame([("Big Supply",)], "name string"), leaves(spark), spark.createDataFrame([("Flap Discs", "blending disc")], "leaf string, term string"))


def test_compile(spark, tmp_path):
    cells = [
        (0, "AB-1", "Acme Flap Disc 4-1/2 in x 7/8 in P80 25/bx", "Acme", "-- No Unilog Brand --", None, "Big Supply"),
        (1, "AB-2", "Acme Flap Disc 5 in x 7/8 in P120", None, None, None, "Acme Wheels, Inc."),
        (2, "AB-2", "", None, None, None, None), (3, None, None, None, None, None, "Nobody"), (0, "AB-1", "Acme Flap Disc 4-1/2 in x 7/8 in P80 25/bx", "Acme", "-- No Unilog Brand --", None, "Big Supply"),
    ]
    cat = spark.createDataFrame(cells, "row_id long, part_number string, description string, e1_brand string, unilog_brand string, dib_brand string, part_manuf string")
    text = "Acme AB-1\nAcme disc\n\nFeatures\n- Fast\n\nSpecifications\nDiameter: 6 in\nUPC: 123\n"
    documents = spark.createDataFrame([("d1", "AB-1", text, "acme.example")], "doc_id string, part_number string, text string, domain string")
    run = compile_catalogue(cat, documents, _vocabulary(spark))
    rows = {r["row_id"]: r for r in run.delivery.collect()}
    assert len(rows) == 4 and run.delivery.columns == ["row_id", *V.DELIVERY]
    a = rows[0]
    assert a["MANUFACTURER_CODE"] == "ACM" and a["UPC"] == "123" and a["FEATURE_01"] == "Fast" and a["IMAGE_ALT_TEXT"] == "Acme disc" and a["DIAMETER"] == "6 in" and a["LIST_PRICE"] == "" and a["CURRENCY"] == ""
    assert rows[1]["UPC"] == "" and rows[3]["RECORD_STATUS"] == "review required" and all(len(r["INVOICE_DESC"]) <= 40 for r in rows.values())
    assert all(v is not None for r in rows.values() for v in r)
    for kind in ("parquet", "csv"):
        sinks.write_delivery(run.delivery, f"{tmp_path}/{kind}", kind)
        back = sinks.read_back(spark, f"{tmp_path}/{kind}", kind)
        assert sinks.schema_problems(back) == [] and sinks.contents(back).first()["n_rows"] == 4
    assert sinks.write_csv_file(run.delivery.select(*V.DELIVERY), f"{tmp_path}/one.csv") == 4 and open(f"{tmp_path}/one.csv", encoding="utf-8").read().startswith(sinks.BOM)


    engine = Engine(spark, run, documents.withColumn("url", F.lit("https://acme.example/1")).withColumn("brand", F.lit("Acme")), _vocabulary(spark))
    assert engine.schema().count() == 252 and engine.records("flap").count() == 2 and engine.page(engine.records(), 2, 3).count() == 1
    spot = run.attributes.where("row_id = 0 and locator like 'row:%'").first()
    assert engine.locate(spot["locator"]).first()["quote"] and engine.locate("nonsense").count() == 0
    assert {r["column"]: r["value"] for r in engine.record(0).collect()}["UPC"] == "123" and engine.evidence(0).where("winner").count() > 5
    assert engine.gate_test("https://acme.example/x", "Acme Wheels Inc.").first()["verdict"] == "admitted" and engine.sourcing().count() == 1
    assert {(r["side"], r["rank"]) for r in engine.search("flap disc AB12345").collect()} >= {("before", 1), ("after", 1)}
    checks = {r["check"]: r["pass"] for r in engine.status().collect()}
    assert len(checks) == 14 and all(p for c, p in checks.items() if "untraceable" not in c and "MFG_PART_NUM" not in c), checks
    reasons = {r["reason"]: r["abstentions"] for r in review.by_reason(run.abstentions).collect()}
    assert reasons["no manufacturer prose retrieved"] >= 1 and engine.health().first()["records"] == 4
    asked = engine.actions().collect()
    assert [r["action_id"] for r in asked] == [f"act-{i:04d}" for i in range(1, len(asked) + 1)] and {r["kind"] for r in asked} <= set(review.KINDS)
    assert engine.document_facts("d1").count() >= 0 and engine.document_text("nothing").count() == 0 and engine.discovery().count() == 5
    assert {r["name"] for r in engine.vocabulary().collect()} == {"units", "manufacturers", "distributors", "leaves", "synonyms"}
    assert engine.download(f"{tmp_path}/d.xlsx") == 4 and sinks.workbook_cells(f"{tmp_path}/d.xlsx")[0] == 4
    back = files.read_cells(spark, f"{tmp_path}/d.xlsx")
    assert back.columns == V.DELIVERY and sinks.contents(back).first()["n_populated"] == sinks.workbook_cells(f"{tmp_path}/d.xlsx")[1]
    engine.artefacts(f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json/metrics").count() == 14
    assert [r["kind"] for r in engine.decide(f"{tmp_path}/log", "item_type", "gizmo", "P>a", "1").collect()] == ["item_type_map"] and engine.reset_decisions(f"{tmp_path}/log", "2").count() == 0
    with pytest.raises(ValueError):
        engine.uploaded(f"{tmp_path}/d.exe", spark.createDataFrame([], "kind string, key string, value string"))
    assert engine.families().count() == run.families.families.count() and engine.contradictions().count() == 0 and engine.review().count() > 0


def test_files(spark, tmp_path):
    (tmp_path / "_x.csv").write_text("a\n")
    (tmp_path / "cat.csv").write_text('MPN,Part_Desc,extra\nA1,"Disc, 5 in",x\n,,\nA2,NA,y\n')
    assert files.find_input(None, str(tmp_path)).endswith("cat.csv")
    got = files.read_catalogue(spark, str(tmp_path / "cat.csv")).orderBy("row_id").collect()
    assert [(r["row_id"], r["part_number"], r["description"]) for r in got] == [(0, "A1", "Disc, 5 in"), (1, "", ""), (2, "A2", "NA")]
    assert files.read_catalogue(spark, str(tmp_path / "cat.csv"), 1).count() == 1
    cache = tmp_path / "docs"
    cache.mkdir()
    entry = {"doc_id": "d", "part_number": "A-1", "file": "d.txt", "url": "u", "domain": "h", "brand": "b", "retrieved_at": "t", "reconstructed": True, "verdict": "admitted"}
    (cache / "index.json").write_text(json.dumps({"documents": [entry, entry | {"doc_id": "e", "file": "e.txt", "part_number": "ZZ"}, entry | {"doc_id": "f", "file": "no.txt"}]}))
    (cache / "d.txt").write_text("part a1 here")
    (cache / "e.txt").write_text("other")
    kept, dropped = files.read_documents(spark, str(cache))
    assert [r["doc_id"] for r in kept.collect()] == ["d"] and [r["doc_id"] for r in dropped.collect()] == ["e"]
    (tmp_path / "o.json").write_text("{broken")
    assert files.read_decisions(spark, str(tmp_path / "o.json")).count() == 0
    log = [{"kind": "manufacturer_map", "key": "a", "value": v, "at": t} for v, t in (("x", "1"), ("y", "3"))] + [{"kind": "clear", "at": "2"}, {"kind": "manufacturer_map", "key": "b", "value": "z", "at": "1"}]
    (tmp_path / "o.json").write_text(json.dumps({"log": log}))
    assert [tuple(r) for r in files.decided(files.read_decisions(spark, str(tmp_path / "o.json"))).collect()] == [("manufacturer_map", "a", "y")]


def test_stream(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    rows = [(1, "p", "Flap Disc Wheel 5 in", "-- Unbranded --", "f", at, at), (1, "p", "Flap Disc Wheel 5 in", "-- Unbranded --", "f", at, at), (2, "p", "Flap Disc Wheel 6 in", None, "f", at, None), (3, "p", None, None, "f", at, at)]
    spark.createDataFrame(rows, stream.SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    once = stream.once(stream.cleaned(stream.read(spark, f"{tmp_path}/in")))
    q = stream.family_sizes(once).writeStream.outputMode("complete").format("memory").queryName("sizes").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("sizes").collect()] == [("flap disc wheel # in", 2)]
    q = stream.received(stream.read(spark, f"{tmp_path}/in")).writeStream.outputMode("update").format("memory").queryName("got").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp2").start()
    q.awaitTermination(120)
    assert spark.table("got").agg(F.max("records")).first()[0] == 3


def test_contract():
    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(q) and len(sql) > 55 and "p1_found" in q
