"""Makers whose misspelt or shortened name begins a description."""

from loomcat.operators import entity


def test_first_word_of_descriptions(spark):
    makers = spark.createDataFrame([("Milwaukee Tool, Inc.", "MIL", "Milwaukee", "M1", ["milw"]), ("Ebbe Corp", "EBB", "Ebbe", "E1", None)], "manufacturer_name string, manufacturer_code string, brand_name string, brand_code string, aliases array<string>")
    rows = [
        (1, "Big Supply Co", "Ebbe", "Milwuakee saw blade"), (2, "Nobody", "", "Milwaukeee drill"), (3, "Nobody", "Ebbe", "Eb drain"), (4, "Nobody", "", "12 Milwuakee"),
        (5, "Nobody", "", "Milwuakee for Ebbe"), (6, "Ebbe Corp", "", "Milwuakee saw"), (7, None, None, None),
    ]
    items = spark.createDataFrame([(i, m, e, "", "", d) for i, m, e, d in rows], "row_id long, part_manuf string, e1_brand string, unilog_brand string, dib_brand string, description string")
    got = {r["row_id"]: (r["manufacturer_code"], r["method"], r["score"]) for r in entity.resolve(items, makers, spark.createDataFrame([("Big Supply Co",)], "name string")).collect()}
    assert got[1][:2] == ("MIL", "unmasked-from-description") and got[2][:2] == ("MIL", "recovered-from-description") and 0.86 * 0.9 <= got[2][2] < 0.9
    assert got[3][:2] == ("EBB", "from-brand-column") and got[4][1] == "unresolved" and got[5][0] == "EBB" and got[6][:2] == ("EBB", "exact") and got[7][1] == "unresolved"
