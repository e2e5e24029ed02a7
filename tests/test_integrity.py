"""Documents that do not name their part overrule nothing and hide no other."""

from loomcat.operators import documents as docs
from loomcat.plans import queries


def test_pages_of_other_parts(spark, tmp_path):
    spec = "Specifications\nDiameter: {}\n"
    rows = [("d1", "AB-1", "Acme AB1\n" + spec.format("6 in")), ("d2", "AB-1", "Acme ZZ-9\n" + spec.format("9 in")), ("d3", "CD-2", None), ("d4", None, "Acme")]
    d = spark.createDataFrame(rows, "doc_id string, part_number string, text string")
    kept, gone = docs.integral(d)
    assert [r["doc_id"] for r in kept.collect()] == ["d1"] and {r["doc_id"] for r in gone.collect()} == {"d2", "d3", "d4"}
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "AB-1")], "row_id long, part_number string").write.parquet(f"{tmp_path}/items.parquet")
    spark.createDataFrame([(1, "Diameter", "5", "in")], "row_id long, label string, value string, uom string").write.parquet(f"{tmp_path}/attributes.parquet")
    assert [(r["value"], r["outcome"]) for r in queries.enrich_named(spark, str(tmp_path)).collect()] == [("6 in", "overruled")]
