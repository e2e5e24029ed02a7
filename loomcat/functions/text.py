"""Scalar functions on text as column expressions: cleaning, keys, numbers, locators, limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from loomcat import vocabulary as V

_SPACE = r"(?U)\s+"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where lambdas use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: What placeholders look like in lower case.
HOLE = "|".join([r"^\s*(?:|nan|nat)\s*$", *V.PLACEHOLDERS])


def is_placeholder(c: Column) -> Column:
    """True for null, blank, nan, nat and the placeholder patterns, whatever their case."""
    return c.isNull() | F.lower(c).rlike(HOLE)


def collapse(c: Column) -> Column:
    """Single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def clean(c: Column) -> Column:
    """The empty string for placeholders, else the text with single blanks."""
    return F.when(is_placeholder(c), "").when(c.rlike(r"^\s|\s$|\s\s|[^\x21-\x7e ]"), collapse(c)).otherwise(c)


def norm_key(c: Column) -> Column:
    """Lower case, without ® and ™, other characters than letters and digits as single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.translate(c, "®™", "")), "[^a-z0-9]+", " "))


def squash(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def populated(columns: list[str]) -> Column:
    """How many of the columns hold more than blanks."""
    return reduce(lambda a, b: a + b, [(F.trim(F.coalesce(F.col(c), F.lit(""))) != "").cast("int") for c in columns])


def strip_account(c: Column) -> Column:
    """A vendor cell without an account number at its end and words that mark accounts."""
    core = F.regexp_replace(c, r"\s*\(\d{2,6}\)\s*$", "")
    kept = F.filter(F.split(core, _SPACE), lambda w: (w != "") & ~F.lower(F.regexp_replace(w, r"^[.,]+|[.,]+$", "")).isin(V.ACCOUNT_WORDS))
    return F.regexp_replace(F.array_join(kept, " "), r"^[ .,]+|[ .,]+$", "")


# -- numbers ------------------------------------------------------------------------------------------------------

MIXED = r"^(\d+)\s*-\s*(\d+)\s*/\s*(\d+)$"
FRACTION = r"^(\d+)\s*/\s*(\d+)$"


def _part(c: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(c, pattern, i).try_cast("double")


def to_decimal(c: Column) -> Column:
    """Value of a mixed number, fraction or decimal; null for other texts and zero denominators."""
    s = F.trim(c)
    over = lambda n, d: F.try_divide(n, d)
    return (
        F.when(s.rlike(MIXED), _part(s, MIXED, 1) + over(_part(s, MIXED, 2), _part(s, MIXED, 3)))
        .when(s.rlike(FRACTION), over(_part(s, FRACTION, 1), _part(s, FRACTION, 2)))
        .otherwise(F.when(s.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$"), s.try_cast("double")))
    )


def exact_fraction(part: Column) -> Column:
    """n/d for a part of one that is an exact binary fraction down to 64ths; null for others."""
    out = F.lit(None).cast("string")
    for d in (64, 32, 16, 8, 4, 2):  # the coarsest that fits is in lowest terms
        n = F.round(part * d)
        out = F.when((n > 0) & (n < d) & (F.abs(n / d - part) <= 1e-9), F.concat(n.cast("long").cast("string"), F.lit(f"/{d}"))).otherwise(out)
    return out


def trade_number(c: Column) -> Column:
    """Decimals as fractions where they are exactly that; 0.045 becomes .045, 2.0 becomes 2."""
    s = F.trim(c)
    value = F.when(s.rlike(r"^\d*\.\d+$|^\d+\.$"), s.try_cast("double"))
    whole = F.floor(value)
    part = value - whole
    shown = exact_fraction(part)
    lead = F.when(whole > 0, F.concat(whole.cast("string"), F.lit("-"))).otherwise("")
    short = F.when(s.startswith("0.") & (F.length(s) > 2), F.substring(s, 2, 1_000)).otherwise(s)
    return (
        F.when(s.rlike(MIXED), F.regexp_replace(s, r"\s+", ""))
        .when(s.rlike(FRACTION), F.concat_ws("/", F.regexp_replace(F.regexp_extract(s, FRACTION, 1), "^0+(?=.)", ""), F.regexp_replace(F.regexp_extract(s, FRACTION, 2), "^0+(?=.)", "")))
        .when(value.isNull(), s)
        .when(part <= 1e-9, whole.cast("string"))
        .when(shown.isNull(), short)
        .otherwise(F.concat(lead, shown))
    )


def number_tokens(c: Column) -> Column:
    """Numbers of a text, without leading zeros."""
    found = F.regexp_extract_all(c, F.lit(r"\d+(?:[.\-/]\d+)*"), F.lit(0))
    return F.transform(found, lambda x: F.when(x.rlike("^0+$"), "0").otherwise(F.regexp_replace(x, "^0+", "")))


# -- locators -----------------------------------------------------------------------------------------------------

LOCATOR = r"^(row|doc):([^#]+)#char\[(\d+):(\d+)\]$"


def row_locator(row_id: Column, field: Column, start: Column, end: Column) -> Column:
    return F.format_string("row:%d:%s#char[%d:%d]", row_id, field, start, end)


def doc_locator(doc_id: Column, start: Column, end: Column) -> Column:
    return F.format_string("doc:%s#char[%d:%d]", doc_id.cast("string"), start, end)


def parse_locator(c: Column) -> Column:
    """STRUCT<kind, ref, start, end> of a locator, null for other texts."""
    g = lambda i: F.regexp_extract(c, LOCATOR, i)
    return F.when(c.rlike(LOCATOR), F.struct(g(1).alias("kind"), g(2).alias("ref"), g(3).cast("int").alias("start"), g(4).cast("int").alias("end")))


def find_span(text: Column, needle: Column) -> Column:
    """STRUCT<start, end> of a needle: as it is, else whatever its case, else by its digits; null if not found."""
    digits = F.regexp_replace(needle, r"[^\d./-]", "")
    at = lambda t, n: F.call_function("instr", t, n)
    exact, low = at(text, needle), at(F.lower(text), F.lower(needle))
    by_digit = F.when(F.length(digits) >= 2, at(text, digits)).otherwise(0)
    span = lambda i, n: F.struct((i - 1).cast("int").alias("start"), (i - 1 + F.length(n)).cast("int").alias("end"))
    return F.when(F.length(needle) == 0, None).when(exact > 0, span(exact, needle)).when(low > 0, span(low, needle)).when(by_digit > 0, span(by_digit, digits))


# -- hosts --------------------------------------------------------------------------------------------------------


def domain_of(url: Column) -> Column:
    """Host of a URL with its port, lower case, without www.; the empty string for other texts."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), r"^www\.", "")


# -- wording ------------------------------------------------------------------------------------------------------


def invoice_form(c: Column) -> Column:
    """Capitals with the short forms of invoices, longest phrases first."""
    s = F.concat(F.lit(" "), F.lower(collapse(c)), F.lit(" "))
    for phrase in sorted(V.INVOICE_FORMS, key=len, reverse=True):
        s = F.replace(s, F.lit(f" {phrase} "), F.lit(f" {V.INVOICE_FORMS[phrase]} "))
    return F.upper(collapse(s))


def title_case(c: Column, units: list[str]) -> Column:
    """First letters of words as capitals; units, words with digits, short capitals and marks stay as they are."""

    def parts(w: Column) -> Column:
        plain = w.rlike("^[A-Za-z]+$")  # most words have nothing around them
        lead = F.when(plain, "").otherwise(F.regexp_extract(w, r"^[,;:.()]*", 0))
        bare = F.when(plain, w).otherwise(F.regexp_replace(w, r"^[,;:.()]+|[,;:.()]+$", ""))
        return F.struct(w.alias("w"), lead.alias("lead"), bare.alias("bare"), F.upper(bare).alias("up"))

    def one(x: Column, i: Column) -> Column:
        w, lead, bare = x["w"], x["lead"], x["bare"]
        around = lambda v: F.concat(lead, v, F.substring(w, F.length(lead) + F.length(bare) + 1, F.length(w)))
        stays = bare.isin(units) | bare.rlike(r"[0-9®™]") | ((bare == x["up"]) & (bare != F.lower(bare)) & (F.length(bare) <= 5))
        return (
            F.when((w == "") | (bare == ""), w)
            .when(x["up"].isin(V.KEEP_CASE), around(x["up"]))
            .when(stays, w)
            .when(F.lower(bare).isin(V.LOWER_WORDS) & (i > 0), around(F.lower(bare)))
            .otherwise(around(F.concat(F.substring(x["up"], 1, 1), F.substring(bare, F.lit(2), F.length(bare)))))
        )

    return F.array_join(F.transform(F.transform(F.split(c, " "), parts), one), " ")


def fit(c: Column, most: int, separator: str = ", ") -> Column:
    """The text within a limit: whole parts dropped from its end, else whole words, else cut."""

    def longest(s: Column, sep: str, strip: str) -> Column:
        def of(parts: Column) -> Column:
            n = F.size(parts)
            # the length of the first k parts with their separators rules out most of what is too long
            lengths = F.aggregate(parts, F.array(F.lit(-len(sep))), lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + F.length(p) + len(sep)))
            fits = F.filter(F.sequence(F.lit(1), n - 1), lambda k: F.element_at(lengths, k + 1) <= most + 4)
            cut = F.transform(F.reverse(fits), lambda k: F.regexp_replace(F.trim(F.array_join(F.slice(parts, F.lit(1), k), sep)), strip, ""))
            return F.when(n > 1, F.try_element_at(F.filter(cut, lambda x: F.length(x) <= most), F.lit(1)))

        return let(F.split(s, sep.replace(".", r"\.")), of)

    def whole(s: Column) -> Column:
        hard = F.regexp_replace(F.rtrim(F.substring(s, 1, most)), "[,;-]+$", "")
        return F.when(F.length(s) <= most, s).otherwise(F.coalesce(longest(s, separator, "[,;]+$"), longest(s, " ", "[,;-]+$"), hard))

    return let(collapse(c), whole)


def band(confidence: Column) -> Column:
    """Word for a confidence."""
    out = F.lit("very low")
    for floor, name in reversed(V.BANDS):
        out = F.when(confidence >= floor, name).otherwise(out)
    return out


def signature(values: Column) -> Column:
    """Key of a set of values, whatever their order and case."""
    return F.concat(F.lit("sig:"), F.array_join(F.array_sort(F.transform(values, lambda v: F.lower(F.trim(v)))), "|"))


# -- search -------------------------------------------------------------------------------------------------------


def search_terms(c: Column) -> Column:
    """Terms of a text or query, in order, with repeats."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9][a-z0-9./\-]*"), F.lit(0))


def without_part_numbers(c: Column) -> Column:
    """Text without words of five characters or more that hold both letters and digits."""
    return collapse(F.regexp_replace(c, r"(?<![A-Za-z0-9])(?=[A-Za-z0-9./\-]*\d)(?=[A-Za-z0-9./\-]*[A-Za-z])[A-Za-z0-9][A-Za-z0-9./\-]{4,}", " "))
