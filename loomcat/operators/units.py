"""Quantities recorded in different units, brought to the common unit of their label.

A multi-pattern automaton finds unit aliases in free text. Of the aliases that start right behind a number the
longest wins, and of the meanings of an alias the one of the label's measurement type (so `#` is pounds under a
weight and psi under a pressure). Parsing yields numbers and canonical units only; the conversion factors come from
the units table by a broadcast join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from loomcat.session import fixed_rows, small

# Spellings of units met in feeds beside the aliases of the units table, by measurement type and unit.
MORE_ALIASES = {
    ("Length", "in"): ["ins", "in"],
    ("Length", "ft"): ["fts"],
    ("Length", "yd"): ["yds"],
    ("Length", "mm"): ["mms", "millimetres"],
    ("Length", "cm"): ["cms", "centimeter", "centimetre", "centimeters", "centimetres"],
    ("Length", "m"): ["mtr", "mtrs", "metres"],
    ("Weight", "oz"): ["ozs"],
    ("Weight", "g"): ["gms", "gr", "grs"],
    ("Weight", "kg"): ["kilos"],
    ("Pressure", "psi"): ["lbs/in2", "lb/sq in"],
    ("Pressure", "kPa"): ["kpas"],
    ("Flow Rate", "gph"): ["g.p.h."],
    ("Flow Rate", "lpm"): ["litres per minute", "l.p.m."],
    ("Voltage", "V"): ["vdc", "vs"],
    ("Current", "A"): ["as"],
    ("Current", "mA"): ["milliamperes"],
    ("Power", "W"): ["ws"],
    ("Temperature", "deg F"): ["f", "degf", "degree f", "degrees fahrenheit"],
    ("Temperature", "deg C"): ["c", "degc", "degree c", "degrees celsius"],
    ("Torque", "ft-lb"): ["ft-lbs", "ft lbs", "ft.lb", "ftlbs"],
    ("Torque", "in-lb"): ["in-lbs", "in lbs", "in.lb", "inlbs"],
    ("Torque", "Nm"): ["n.m", "n m", "newton metres", "newton meters"],
    ("Volume", "fl oz"): ["fl.oz", "fl.oz."],
    ("Volume", "L"): ["ltr", "ltrs"],
    ("Volume", "mL"): ["millilitres", "mls"],
    ("Heat", "BTUH"): ["btu/h", "btu", "btus"],
    ("Heat", "MBH"): ["mbtuh", "mbtu/h"],
}

_VULGAR = {"½": 1 / 2, "¼": 1 / 4, "¾": 3 / 4, "⅛": 1 / 8, "⅜": 3 / 8, "⅝": 5 / 8, "⅞": 7 / 8, "⅓": 1 / 3, "⅔": 2 / 3}
_NUMBER = re.compile(
    r"(?P<whole>\d+)\s*[- ]\s*(?P<mn>\d+)\s*/\s*(?P<md>\d+)"
    r"|(?P<n>\d+)\s*/\s*(?P<d>\d+)"
    r"|(?P<vw>\d*)\s?(?P<v>[½¼¾⅛⅜⅝⅞⅓⅔])"
    r"|(?P<grouped>\d{1,3}(?:,\d{3})+(?:\.\d+)?)(?!\d)"
    r"|(?P<plain>\d*[.,]?\d+)"
)
#: Words that may stand before a number, behind it as its scale, and between two numbers of a range; none is a unit.
LEADS = "maximum|minimum|max|min|approximately|approx|about|circa|ca|nominal|nom|up to"
SCALES = r"[x×*]\s*10\s*\^\s*[+-]?\d+|(?:k|thousand)(?![a-z])"
BETWEEN = "to|through"
_LEAD = re.compile(rf"^(?:(?:{LEADS})\b[.:]?|~|≈|±|<=?|>=?|≤|≥)\s*", re.I)
_SCALE = re.compile(r"\s*[x×*]\s*10\s*\^\s*(?P<p>[+-]?\d+)|\s*(?P<k>k|thousand)(?![a-z])")
_SIGN = re.compile(r"\s*([-−+])?\s*")
_RANGE = re.compile(rf"\s*(?:-|–|—|\.\.\.?|(?:{BETWEEN})\b)\s*(?=[-−+.]?\s*[\d½¼¾⅛⅜⅝⅞⅓⅔])")

PARSED = "attr_id long, mt string, common_uom string, n1 double, u1 string, n2 double, u2 string, scaled boolean"


class UnitReader:
    """Aliases of all units in one automaton; payloads by measurement type."""

    def __init__(self, units: list[tuple[str, str, list[str]]]):
        import ahocorasick

        meanings: dict[str, dict[str, str]] = {}
        for mt, canonical, aliases in units:
            for a in [canonical, *(aliases or []), *MORE_ALIASES.get((mt, canonical), [])]:
                a = " ".join(a.lower().split())
                for form in {a, a.rstrip(".") or a}:
                    meanings.setdefault(form, {}).setdefault(mt, canonical)
        self.meanings = meanings
        self.automaton = ahocorasick.Automaton()
        for form, by_type in meanings.items():
            self.automaton.add_word(form, (len(form), by_type))
        self.automaton.make_automaton()
        #: Characters in which the longest alias ends, a joint and a dot behind it included.
        self.reach = max(map(len, meanings), default=0) + 4
        self.memo: dict[tuple, tuple | None] = {}

    def unit_spans(self, s: str, mt: str) -> dict[int, tuple[int, str]]:
        """start -> (end, unit) of the longest alias of the measurement type at each start."""
        found: dict[int, tuple[int, str]] = {}
        for last, (n, by_type) in self.automaton.iter(s):
            unit = by_type.get(mt)
            if unit is None:
                continue
            a, b = last - n + 1, last + 1
            if s[b - 1].isalpha() and b < len(s) and s[b].isalpha():
                # a size list may follow without a space, as in "7inx2"
                if not (s[b] == "x" and re.match(r"x\s*[\d.½¼¾⅛⅜⅝⅞]", s[b:])):
                    continue
            if b < len(s) and s[b] == "." and (b + 1 == len(s) or not s[b + 1].isdigit()):
                b += 1
            if a not in found or found[a][0] < b:
                found[a] = (b, unit)
        return found

    def alias(self, text: str | None, mt: str) -> str | None:
        """The unit a whole text names, or None."""
        t = " ".join((text or "").lower().split())
        return (self.meanings.get(t) or self.meanings.get(t.rstrip("."), {})).get(mt)

    def after(self, tail: str | None, mt: str) -> str | None:
        """The unit at the start of a text, or None."""
        hit = self.unit_spans(self.near(tail), mt).get(0)
        return hit[1] if hit else None

    def near(self, tail: str | None) -> str:
        """What of the text behind a number an alias at its start can take up; how much follows from the longest alias."""
        words, n = [], 0
        for m in re.finditer(r"\S+", tail or ""):
            words.append(m[0].lower())
            n += len(m[0]) + 1
            if n > self.reach:
                break
        return " ".join(words)

    def _number(self, s: str, at: int, units: dict, mt: str) -> tuple[float, int, bool] | None:
        sign = _SIGN.match(s, at)
        m = _NUMBER.match(s, sign.end())
        if not m:
            return None
        g = m.groupdict()
        if g["whole"]:
            if not int(g["md"]):
                return None
            x = int(g["whole"]) + int(g["mn"]) / int(g["md"])
        elif g["n"]:
            if not int(g["d"]):
                return None
            x = int(g["n"]) / int(g["d"])
        elif g["v"]:
            x = int(g["vw"] or 0) + _VULGAR[g["v"]]
        elif g["grouped"]:
            x = float(g["grouped"].replace(",", ""))
        else:
            x = float(g["plain"].replace(",", "."))
        end, scaled = m.end(), False
        gap = end + len(s[end:]) - len(s[end:].lstrip())
        scale = _SCALE.match(s, end)
        if scale and (scale["p"] is not None or gap not in units):
            x *= 10.0 ** int(scale["p"]) if scale["p"] is not None else 1000
            end, scaled = scale.end(), True
        return (-x if sign[1] and sign[1] in "-−" else x), end, scaled

    def read(self, mt: str, value: str, uom: str | None, tail: str | None) -> tuple | None:
        """(n1, u1, n2, u2, scaled), or None for ranges, words and numbers without a known unit."""
        key = (mt, value, uom, self.near(tail))
        if key not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[key] = self._read(*key)
        return self.memo[key]

    def _read(self, mt: str, value: str, uom: str | None, tail: str | None) -> tuple | None:
        s = " ".join(value.lower().replace("”", '"').replace("″", '"').replace("′", "'").split())
        while m := _LEAD.match(s):
            s = s[m.end() :]
        units = self.unit_spans(s, mt)
        first = self._number(s, 0, units, mt)
        if not first:
            return None
        n1, at, scaled = first
        gap = at + len(s[at:]) - len(s[at:].lstrip())
        u1 = None
        if gap in units:
            at, u1 = units[gap]
        rest = s[at:]
        if rest.strip(" ."):
            sep = _RANGE.match(s, at)
            second = self._number(s, sep.end(), units, mt) if sep else self._number(s, at, units, mt) if u1 else None
            if second and u1 and second[0] >= 0:
                n2, at2, _ = second
                gap = at2 + len(s[at2:]) - len(s[at2:].lstrip())
                u2 = units[gap][1] if gap in units else None
                if u2 and u2 != u1:
                    return n1, u1, (-n2 if n1 < 0 else n2), u2, False
            if second or u1 is None:
                return None
        if u1 is None:
            u1 = self.alias(uom, mt) if (uom or "").strip() else self.after(tail, mt)
        return None if u1 is None else (n1, u1, None, None, scaled)


def _readings(units: list[tuple[str, str, list[str]]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = UnitReader(units)
        for pdf in batches:
            rows = []
            for attr_id, mt, common, value, uom, tail in pdf.itertuples(index=False, name=None):
                got = reader.read(mt, value, uom, tail)
                if got and (got[1] != common or got[3] or got[4]):
                    rows.append((attr_id, mt, common, *got))
            yield pd.DataFrame(rows, columns=["attr_id", "mt", "common_uom", "n1", "u1", "n2", "u2", "scaled"])

    return run


def common_units(attributes: DataFrame, items: DataFrame, units: DataFrame, label_classes: DataFrame) -> DataFrame:
    """attr_id, common_uom, common_milli of every measurement not recorded as one plain number of its common unit.

    The unit is the one in value, else in uom, else in the item's description right behind the locator's span. Null,
    empty and wordy values, ranges, unknown units and labels that measure nothing have no row; repeated rows of an
    attr_id give one row; extra columns are ignored. Only rows without a unit of their own are joined with items.
    """
    spark = attributes.sparkSession
    labels = label_classes.where("measurement_type is not null").select(
        F.lower("label").alias("_label"), F.col("measurement_type").alias("mt"), "common_uom"
    ).dropDuplicates(["_label"])
    # label_classes and units are fixed vocabularies; `small` checks that before they are broadcast
    measured = (
        attributes.select("attr_id", "row_id", F.lower(F.trim("label")).alias("_label"), "value", "uom", "locator")
        .where("value is not null and trim(value) <> ''")
        .join(small(labels), "_label")
        .drop("_label")
    )
    bare = F.regexp_replace(F.lower("value"), rf"\b(?:{LEADS}|{BETWEEN})\b|{SCALES}", "")
    span = r"^row:(\d+):description#char\[(\d+):(\d+)\]$"
    silent = (F.trim(F.coalesce("uom", F.lit(""))) == "") & ~bare.rlike(r"[a-z\"'#°″′]") & F.coalesce(F.col("locator").rlike(span), F.lit(False))
    own = measured.where(~silent).select("attr_id", "mt", "common_uom", "value", "uom", F.lit(None).cast("string").alias("tail"))
    lone = measured.where(silent).select(
        "attr_id", "mt", "common_uom", "value", "uom",
        F.regexp_extract("locator", span, 1).try_cast("long").alias("_row"), F.regexp_extract("locator", span, 3).try_cast("int").alias("_end"),
    )
    texts = items.where("description is not null").select(F.col("row_id").alias("_row"), "description")
    # a record sent twice carries the same text, so its rows meet again in the final distinct
    told = lone.join(texts, "_row", "left").select(
        "attr_id", "mt", "common_uom", "value", "uom", F.substring("description", F.col("_end") + 1, F.length("description")).alias("tail")
    )
    known = [(r[0], r[1], list(r[2] or [])) for r in fixed_rows(units.select("measurement_type", "canonical", "aliases"))]
    reader = own.unionByName(told).select("attr_id", "mt", "common_uom", "value", "uom", "tail")
    parsed = reader.mapInPandas(_readings(known), PARSED)
    factor = units.select("measurement_type", "canonical", "factor", "shift")
    one = small(factor.select(F.col("measurement_type").alias("mt"), F.col("canonical").alias("u1"), F.col("factor").alias("f1"), F.col("shift").alias("s1")))
    two = small(factor.select(F.col("measurement_type").alias("mt"), F.col("canonical").alias("u2"), F.col("factor").alias("f2")))
    value = F.col("n1") * F.col("f1") + F.col("s1") + F.coalesce(F.col("n2") * F.col("f2"), F.lit(0.0))
    return (
        parsed.join(one, ["mt", "u1"])
        .join(two, ["mt", "u2"], "left")
        .select("attr_id", "common_uom", F.floor(value * 1000 + 0.5).cast("long").alias("common_milli"))
        .dropDuplicates(["attr_id"])
    )
