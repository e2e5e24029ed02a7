"""Measurements in common units: notations, places of the unit, and cases without a result."""

import math

import pytest

from loomcat.operators.units import UnitReader, common_units

UNITS = [
    ("Length", "in", ["inch", "inches", "in.", '"', "''"], 1.0, 0.0), ("Length", "ft", ["foot", "feet", "'"], 12.0, 0.0), ("Length", "mm", ["mm."], 0.03937007874015748, 0.0),
    ("Weight", "lb", ["lbs", "#"], 1.0, 0.0), ("Weight", "oz", ["oz."], 0.0625, 0.0), ("Weight", "g", ["gram"], 0.002204622621848776, 0.0), ("Pressure", "psi", ["#"], 1.0, 0.0),
    ("Temperature", "deg F", ["°f"], 1.0, 0.0), ("Temperature", "K", ["kelvin"], 1.8, -459.67), ("Heat", "BTUH", ["btu per hour"], 1.0, 0.0), ("Heat", "MBH", ["thousand btu per hour"], 1000.0, 0.0),
]


@pytest.fixture(scope="module")
def reader():
    return UnitReader([(a, b, c) for a, b, c, *_ in UNITS])


@pytest.mark.parametrize(
    "mt,value,uom,tail,expected",
    [
        ("Length", "24", "in", None, (24, "in", None, None, False)),
        ("Length", "4-1/2 in", None, None, (4.5, "in", None, None, False)),
        ("Length", "1½", "ft", None, (1.5, "ft", None, None, False)),
        ("Length", "914,4 mm", None, None, (914.4, "mm", None, None, False)),
        ("Length", "1,200 mm", None, None, (1200, "mm", None, None, False)),
        ("Length", "5'-6\"", "ft", None, (5, "ft", 6, "in", False)),
        ("Weight", "3 lbs. 12 oz.", None, None, (3, "lb", 12, "oz", False)),
        ("Weight", "3lb 12oz", None, None, (3, "lb", 12, "oz", False)),
        ("Weight", "9.072 x 10^3", "gram", None, (9072, "g", None, None, True)),
        ("Weight", "9k", "g", None, (9000, "g", None, None, True)),
        ("Temperature", "300 K", None, None, (300, "K", None, None, False)),
        ("Temperature", "-40 °F", None, None, (-40, "deg F", None, None, False)),
        ("Heat", "36 thousand btu per hour", None, None, (36, "MBH", None, None, False)),
        ("Pressure", "100 #", None, None, (100, "psi", None, None, False)),
        ("Weight", "100 #", None, None, (100, "lb", None, None, False)),
        ("Length", "max 6", None, " mm x 3", (6, "mm", None, None, False)),
        ("Length", "7", "", "inx2 ft", (7, "in", None, None, False)),
        ("Length", "12-24 in", None, None, None),
        ("Length", "12 to 24 in", None, None, None),
        ("Length", "5", "boxes", " in", None),
        ("Length", "5", None, "th gear", None),
        ("Length", "blue", "in", None, None),
        ("Length", "1/0 in", None, None, None),
        ("Length", "", None, None, None),
    ],
)
def test_reading(reader, mt, value, uom, tail, expected):
    got = reader.read(mt, value, uom, tail)
    assert (got is None) == (expected is None)
    if got:
        assert math.isclose(got[0], expected[0]) and got[1:] == expected[1:]


def test_whole(spark):
    attrs = spark.createDataFrame(
        [
            (1, 1, "length", "2", "ft", None, "clash"), (1, 1, "length", "2", "ft", None, "clash"), (2, 1, "Length", "24 in", None, None, "x"), (3, 1, "LENGTH", "5", None, "row:1:description#char[4:5]", "x"),
            (4, 1, "Colour", "5", "ft", None, "x"), (5, 1, "Length", None, "ft", None, "x"), (6, 2, "Length", "5", None, "row:9:description#char[0:1]", "x"), (7, None, "Length", "x" * 100_000, "ft", None, "x"), (8, 1, None, "5", "ft", None, "x"),
        ],
        "attr_id long, row_id long, label string, value string, uom string, locator string, factor string",
    )
    items = spark.createDataFrame([(1, "abc 5mm x"), (1, "abc 5mm x"), (3, None)], "row_id long, description string")
    units = spark.createDataFrame(UNITS, "measurement_type string, canonical string, aliases array<string>, factor double, shift double")
    labels = spark.createDataFrame([("Length", "Length", "in"), ("Colour", None, None)], "label string, measurement_type string, common_uom string")
    got = {tuple(r) for r in common_units(attrs, items, units, labels).collect()}
    assert got == {(1, "in", 24000), (3, "in", 197)}
    assert common_units(attrs.limit(0), items, units, labels).count() == 0
    assert common_units(attrs, items.limit(0), units, labels).count() == 1


def test_words_before_numbers_and_far_units(spark):
    values = ["maximum 5", "circa 5", "ca 5", "nom 5", "approximately 5", "up to 5", "5k", "5 to 6", "300 k", "5 x 10^2"]
    attrs = spark.createDataFrame([(i, i, "Length", v, "", f"row:{i}:description#char[0:1]") for i, v in enumerate(values)] + [(50, 50, "Length", "5", "", "row:50:description#char[0:1]"), (51, 51, "Length", "5", "", "page 3"), (52, 99, "Length", "5 mm", "", "row:99:description#char[0:1]")], "attr_id long, row_id long, label string, value string, uom string, locator string")
    items = spark.createDataFrame([(i, "5 mm and more") for i in range(len(values))] + [(50, "5" + " " * 300 + "millimetre   of   mercury")], "row_id long, description string")
    units = spark.createDataFrame([("Length", "in", ["inch"], 1.0, 0.0), ("Length", "mm", ["millimetre of mercury"], 0.1, 0.0)], "measurement_type string, canonical string, aliases array<string>, factor double, shift double")
    labels = spark.createDataFrame([("Length", "Length", "in")], "label string, measurement_type string, common_uom string")
    got = {r["attr_id"]: r["common_milli"] for r in common_units(attrs, items, units, labels).collect()}
    assert got == {**{i: 500 for i in range(6)}, 6: 500_000, 8: 30_000_000, 9: 50_000, 50: 500, 52: 500}
