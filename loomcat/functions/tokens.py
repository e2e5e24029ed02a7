"""The tokenizer of descriptions, natively: tokens with offsets, kinds and skeletons."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomcat import vocabulary as V
from loomcat.functions.text import let

ANY = "(?U)" + "|".join(f"(?:{p})" for _, p in V.TOKEN_KINDS)


def _kind(t: Column) -> Column:
    out = F.lit("punct")
    for kind, pattern in reversed(V.TOKEN_KINDS[:-1]):
        out = F.when(t.rlike(f"(?U)^(?:{pattern})$"), kind).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """ARRAY<STRUCT<text, start, end, kind, norm, skeleton, is_measure>> of a text; empty for null and empty texts.

    Only white space lies between tokens, so each stands at its first occurrence behind the one before. Every step is
    bound once: lambdas would evaluate what they refer to for each token again.
    """
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<text:string,start:int>>").alias("out"))

    def place(s: Column) -> Column:
        def step(acc: Column, t: Column) -> Column:
            return let(F.call_function("locate", t, s, acc["at"]), lambda at: F.struct((at + F.length(t)).cast("int").alias("at"), F.array_append(acc["out"], F.struct(t.alias("text"), (at - 1).cast("int").alias("start"))).alias("out")))

        found = F.regexp_extract_all(s, F.lit(ANY), F.lit(0))
        # only measures end in white space, by their optional unit
        return F.aggregate(F.transform(found, lambda t: F.rtrim(F.regexp_replace(t, r"[\t\r\n\u00a0]+$", ""))), start, step, lambda acc: acc["out"])

    def kinds(p: Column) -> Column:
        t = p["text"]
        # letters alone are words, and digits alone numbers: no pattern is tried on most tokens
        kind = F.when(t.rlike("^[A-Za-z]+$"), "word").when(t.rlike("^[0-9]+$"), "int").otherwise(_kind(t))
        return F.struct(t.alias("text"), p["start"].alias("start"), kind.alias("kind"), F.lower(F.when(t.contains(" "), F.replace(t, F.lit(" "), F.lit(""))).otherwise(t)).alias("norm"))

    def whole(p: Column) -> Column:
        t, kind, norm = p["text"], p["kind"], p["norm"]
        digits = F.length(F.regexp_replace(t, r"\D", ""))
        code = F.when(digits >= F.greatest(F.lit(2), F.floor(F.length(t) / 2)), "#").otherwise(norm)
        skeleton = F.when(kind == "word", norm).when(kind.isin(V.MEASURE_KINDS), "#").when(kind == "code", code).otherwise(t)
        return F.struct(t.alias("text"), p["start"].alias("start"), (p["start"] + F.length(t)).cast("int").alias("end"), kind.alias("kind"), norm.alias("norm"), skeleton.alias("skeleton"))

    measured = lambda t: t.withField("is_measure", t["skeleton"] == "#")
    return F.transform(F.transform(F.transform(let(F.coalesce(text, F.lit("")), place), kinds), whole), measured)


def skeleton(toks: Column) -> Column:
    """Words of a text with measures as #, without punctuation."""
    return F.array_join(F.transform(F.filter(toks, lambda t: t["kind"] != "punct"), lambda t: t["skeleton"]), " ")


def content_words(toks: Column) -> Column:
    """Words of more than one letter."""
    return F.transform(F.filter(toks, lambda t: (t["kind"] == "word") & (F.length(t["norm"]) > 1)), lambda t: t["norm"])


def measures(toks: Column) -> Column:
    """Tokens that are measures."""
    return F.filter(toks, lambda t: t["is_measure"])
