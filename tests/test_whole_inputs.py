"""Queries that read every claim, cell, document and line."""

from loomcat.plans import queries


def test_all_claims_and_vendor_cells(spark, tmp_path):
    # events 0, 4 and 2 are claims on user 1 of which event 2 needs no locator; the cells are those of users 2 and 4
    rows = [(0, 1, "purchase", 3.0), (2, 2, "signup", 3.0), (4, 1, "signup", 3.0), (7, 2, "error", 1.0), (3, 2, "view", 1.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["row_id"], r["field"]) for r in queries.withdrawn_cells(spark, str(tmp_path)).collect()}
    assert (4, "UPC") in got and {f for _, f in got} == {"UPC"} and {r for r, _ in got} <= {2, 4}
    spark.createDataFrame([("Café Tools (4031)",), ("Acme (12)",), (None,), ("Ａｃｍｅ",)], "part_manuf string").write.parquet(f"{tmp_path}/items.parquet")
    assert {r["part_manuf"]: r["core"] for r in queries.account_strip(spark, str(tmp_path)).collect()} == {"Café Tools (4031)": "Café Tools", "Acme (12)": "Acme", "Ａｃｍｅ": "Ａｃｍｅ"}


def test_spans_of_every_document(spark, tmp_path):
    rows = [(1, "AB-1", "see AB-1"), (2, "AB-1", "ab-1 here"), (3, "AB-1", "nothing"), (4, "MISC-0000", "a MISC-0000"), (5, "MISC-0000", "MISC-0000"), (6, None, "x"), (7, "x", None), (8, "", "x")]
    spark.createDataFrame(rows, "doc_id long, part_number string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["start"] for r in queries.find_span(spark, str(tmp_path)).collect()} == {1: 4, 2: 0, 4: 2, 5: 0}
