"""Makers and brands of items: exact, by words, by spelling, from the description, from brand cells."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomcat import vocabulary as V
from loomcat.functions import text, tokens
from loomcat.session import fixed_rows, settled, small

WORD_SHARE, RATIO = 0.62, 0.86
#: Letters of a first word that may stand for a maker, and what its score counts.
FIRST_LETTERS, FIRST_SHARE = 3, 0.9


def alias_table(manufacturers: DataFrame) -> DataFrame:
    """alias, entry, ord, manufacturer_name, manufacturer_code, brand_name, brand_code: normal keys of names, brands and aliases.

    Of entries with one alias the first in the order of names and brands counts.
    """
    names = F.array_union(F.array("manufacturer_name", "brand_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    told = manufacturers.select(F.explode(names).alias("a"), "manufacturer_name", "manufacturer_code", "brand_name", "brand_code")
    entry = F.struct("manufacturer_name", "brand_name", "manufacturer_code", "brand_code")
    first = told.select(text.norm_key(F.col("a")).alias("alias"), entry.alias("e")).where("alias <> ''").groupBy("alias").agg(F.min("e").alias("e"))
    return first.select("alias", "e.manufacturer_name", "e.manufacturer_code", "e.brand_name", "e.brand_code")


def is_distributor(c: Column, distributors: DataFrame) -> Column:
    """The cell holds a word that marks distributors; names of the register are joined by `resolve`."""
    low = F.lower(c)
    out = F.lit(False)
    for word in V.DISTRIBUTOR_WORDS:
        out = out | low.contains(word)
    return out


def _close(aliases: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key in pdf["key"]:
                best = difflib.get_close_matches(key, aliases, n=1, cutoff=RATIO)
                if best:
                    rows.append((key, best[0], difflib.SequenceMatcher(None, key, best[0]).ratio()))
            yield pd.DataFrame(rows, columns=["key", "alias", "score"])

    return run


def word_matches(keys: DataFrame, aliases: DataFrame) -> DataFrame:
    """key, alias, score: for each key the alias with the largest share of common words; the first by bytes of equals."""
    words = lambda c: F.array_distinct(F.split(c, " "))
    k = keys.select("key", F.size(words("key")).alias("kn"), F.explode(words("key")).alias("w"))
    a = aliases.select("alias", F.size(words("alias")).alias("an"), F.explode(words("alias")).alias("w"))
    met = k.join(small(a), "w").groupBy("key", "alias", "kn", "an").agg(F.count("*").alias("n"))
    score = F.col("n") / (F.col("kn") + F.col("an") - F.col("n"))
    best = met.withColumn("score", score).groupBy("key").agg(F.max(F.struct("score", F.struct((-F.length("alias")).alias("x")), "alias")).alias("b"))
    return best.select("key", F.col("b.alias").alias("alias"), F.col("b.score").alias("score"))


def best_alias(keys: DataFrame, aliases: DataFrame) -> DataFrame:
    """key, alias, score of each distinct key that has one: the alias itself, else by words, else by spelling.

    Each step sees what the one before left. Spelling is compared in Python, for distinct left keys only, with the
    aliases of a list whose size is checked.
    """
    exact = keys.join(small(aliases.select(F.col("alias").alias("key"))), "key").select("key", F.col("key").alias("alias"), F.lit(1.0).alias("score"))
    left = keys.join(small(aliases.select(F.col("alias").alias("key"))), "key", "left_anti")
    by_words = settled(word_matches(left, aliases).where(F.col("score") >= WORD_SHARE))
    rest = left.join(by_words.select("key"), "key", "left_anti")
    known = sorted(r[0] for r in fixed_rows(aliases.select("alias")))
    close = rest.mapInPandas(_close(known), "key string, alias string, score double")
    return exact.unionByName(by_words.select("key", "alias", "score")).unionByName(close)


def alias_in_text(items: DataFrame, aliases: DataFrame, column: str = "description") -> DataFrame:
    """row_id, alias, score: the longest alias that a text holds as whole words; the first by bytes of equals.

    Runs of as many words as the longest alias has at most of the text are joined with the aliases, so no text is tried against all of them.
    """
    longest = aliases.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    words = F.split(text.norm_key(F.col(column)), " ")
    run = lambda i, k: F.array_join(F.slice("w", i, k), " ")
    starts = F.sequence(F.lit(1), F.size("w"))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - i + 1)), lambda k: run(i, k))))
    grams = items.where(F.length(text.norm_key(F.col(column))) > 0).select("row_id", words.alias("w")).select("row_id", F.explode(F.array_distinct(runs)).alias("alias"))
    met = grams.join(small(aliases.where(F.length("alias") >= 2).select("alias")), "alias")
    best = met.groupBy("row_id").agg(F.min(F.struct((-F.length("alias")).alias("n"), "alias")).alias("b"))
    alias = F.col("b.alias")
    score = F.least(F.lit(1.0), 0.55 + 0.05 * F.size(F.split(alias, " ")) + 0.01 * F.length(alias))
    return best.select("row_id", alias.alias("alias"), score.alias("score"))


def first_words(items: DataFrame, aliases: DataFrame, column: str = "description") -> DataFrame:
    """row_id, alias, score: the best alias of a text's first token, where that is a word of three letters or more.

    Each distinct word is compared once.
    """
    first = F.try_element_at(tokens.tokens(text.clean(F.col(column))), F.lit(1))
    told = items.select("row_id", first.alias("t")).where((F.col("t.kind") == "word") & (F.length("t.norm") >= FIRST_LETTERS))
    told = settled(told.select("row_id", text.norm_key(F.col("t.norm")).alias("key")).where("key <> ''"))
    fits = best_alias(told.select("key").distinct(), aliases).where(F.col("score") >= WORD_SHARE)
    return told.join(fits, "key").select("row_id", "alias", (FIRST_SHARE * F.col("score")).alias("score"))


def contradictions(resolved: DataFrame, manufacturers: DataFrame) -> DataFrame:
    """row_id, manufacturer_name, brand_name, owner: the brand belongs to another maker, and the maker was not unmasked."""
    owners = manufacturers.groupBy("brand_name").agg(F.min("manufacturer_name").alias("owner"))
    met = resolved.where(F.coalesce("unmasked_from", F.lit("")) == "").join(small(owners), "brand_name")
    return met.where("owner <> manufacturer_name").select("row_id", "manufacturer_name", "brand_name", "owner")


def resolve(items: DataFrame, manufacturers: DataFrame, distributors: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """row_id, manufacturer_name, manufacturer_code, brand_name, brand_code, method, score, unmasked_from of every item.

    mapped(part_manuf, manufacturer_name) are decisions on vendor cells and come first. Then, unless the cell names a
    distributor: its own core, an alias in the description, the description's first word, the brand cells in order; else `unresolved`. A brand cell wins for the
    brand. Null and empty cells name nothing.
    """
    aliases = settled(alias_table(manufacturers))
    cell = lambda c: F.coalesce(F.col(c), F.lit(""))
    base = items.select("row_id", *[cell(c).alias(c) for c in ("part_manuf", "e1_brand", "unilog_brand", "dib_brand", "description")])
    core = text.norm_key(text.strip_account(F.col("part_manuf")))
    keyed = base.withColumn("core", core).withColumn("whole", text.norm_key(F.col("part_manuf")))
    register = small(distributors.select(text.norm_key(F.col("name")).alias("whole"), F.lit(True).alias("listed")).distinct())
    keyed = keyed.join(register, "whole", "left").withColumn("masked", F.coalesce("listed", F.lit(False)) | is_distributor(F.col("part_manuf"), distributors))
    cells = keyed.select(F.explode(F.array("core", *[text.norm_key(F.col(b)) for b in ("e1_brand", "unilog_brand", "dib_brand")])).alias("key")).where("key <> ''").distinct()
    fits = settled(best_alias(settled(cells), aliases))
    fit = lambda name: fits.select(F.col("key").alias(f"{name}_key"), F.col("alias").alias(f"{name}_alias"), F.col("score").alias(f"{name}_score"))
    out = keyed.withColumn("m_key", F.when(~F.col("masked"), F.col("core"))).join(fit("m"), "m_key", "left")
    for i, b in enumerate(("e1_brand", "unilog_brand", "dib_brand")):
        out = out.withColumn(f"b{i}_key", text.norm_key(F.col(b))).join(fit(f"b{i}"), f"b{i}_key", "left")
    told = settled(alias_in_text(base, aliases))
    silent = out.where("m_alias is null").select("row_id", "description").join(told, "row_id", "left_anti")
    told = told.unionByName(first_words(silent, aliases)).select("row_id", F.col("alias").alias("d_alias"), F.col("score").alias("d_score"))
    out = out.join(told, "row_id", "left")
    brand = F.coalesce("b0_alias", "b1_alias", "b2_alias")
    method = (
        F.when(F.col("m_alias").isNotNull(), F.when(F.col("m_score") >= 0.999, "exact").otherwise("token-set"))
        .when(F.col("d_alias").isNotNull(), F.when(F.col("masked") | (F.col("core") == ""), "unmasked-from-description").otherwise("recovered-from-description"))
        .when(brand.isNotNull(), "from-brand-column")
        .otherwise("unresolved")
    )
    out = out.select("row_id", "part_manuf", "masked", "core", F.coalesce("m_alias", "d_alias", brand).alias("alias"), brand.alias("brand_alias"), method.alias("method"),
                     F.when(F.col("m_alias").isNotNull(), F.col("m_score")).when(F.col("d_alias").isNotNull(), F.col("d_score")).when(brand.isNotNull(), 0.8).alias("score"))
    maker = small(aliases.select("alias", "manufacturer_name", "manufacturer_code", F.col("brand_name").alias("own_brand"), F.col("brand_code").alias("own_code")))
    brands = small(aliases.select(F.col("alias").alias("brand_alias"), F.col("brand_name").alias("cell_brand"), F.col("brand_code").alias("cell_code")))
    out = out.join(maker, "alias", "left").join(brands, "brand_alias", "left")
    if mapped is not None:
        entry = manufacturers.groupBy("manufacturer_name").agg(F.min(F.struct("brand_name", "brand_code", "manufacturer_code")).alias("e"))
        chosen = mapped.select(text.norm_key(F.col("part_manuf")).alias("map_key"), F.col("manufacturer_name").alias("map_name")).dropDuplicates(["map_key"])
        chosen = chosen.join(entry.withColumnRenamed("manufacturer_name", "map_name"), "map_name")
        out = out.withColumn("map_key", text.norm_key(F.col("part_manuf"))).join(small(chosen), "map_key", "left")
        by_map = F.col("map_name").isNotNull()
        pick = lambda a, b: F.when(by_map, a).otherwise(b)
        out = out.select("row_id", "part_manuf", "masked", "core", pick(F.col("map_name"), F.col("manufacturer_name")).alias("manufacturer_name"), pick(F.col("e.manufacturer_code"), F.col("manufacturer_code")).alias("manufacturer_code"),
                         pick(F.col("e.brand_name"), F.col("own_brand")).alias("own_brand"), pick(F.col("e.brand_code"), F.col("own_code")).alias("own_code"),
                         pick(F.lit(None), F.col("cell_brand")).alias("cell_brand"), pick(F.lit(None), F.col("cell_code")).alias("cell_code"), pick(F.lit("reviewer-mapped"), F.col("method")).alias("method"), pick(F.lit(1.0), F.col("score")).alias("score"))
    from_text = F.col("method").isin("unmasked-from-description", "recovered-from-description")
    other = F.col("masked") | ((F.col("core") != "") & (F.col("core") != text.norm_key(F.col("manufacturer_name"))))
    return out.select(
        "row_id", "manufacturer_name", "manufacturer_code", F.coalesce("cell_brand", "own_brand", "manufacturer_name").alias("brand_name"), F.coalesce("cell_code", "own_code").alias("brand_code"),
        "method", F.round("score", 6).alias("score"), F.when(from_text & other, F.col("part_manuf")).otherwise("").alias("unmasked_from"),
    )


def method_counts(resolved: DataFrame) -> DataFrame:
    """method, items."""
    return resolved.groupBy("method").agg(F.count("*").alias("items"))


def first_per(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
