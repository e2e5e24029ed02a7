"""Sections of cached documents, the gate for sources, and facts that documents add to items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomcat import vocabulary as V
from loomcat.functions import text
from loomcat.session import small


def lines(documents: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, n, line, start, section: the lines of each text with their offsets and the header above them.

    One row of a text becomes its lines within the row, so nothing is shuffled. Null and empty texts have no lines.
    """
    parts = F.split(F.col(column), "\n")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("section"), F.array().cast("array<struct<line:string,start:int,section:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        header = F.trim(x).isin(V.SECTIONS)
        section = F.when(header, F.trim(x)).otherwise(acc["section"])
        row = F.struct(x.alias("line"), acc["at"].alias("start"), F.when(header, F.lit("")).otherwise(section).alias("section"))
        return F.struct((acc["at"] + F.length(x) + 1).cast("int").alias("at"), section.alias("section"), F.array_append(acc["out"], row).alias("out"))

    told = documents.where(F.length(column) > 0).select(F.col(key), F.posexplode(F.aggregate(parts, start, step, lambda a: a["out"])).alias("n", "l"))
    return told.select(key, "n", "l.line", "l.start", "l.section")


def spec_block(documents: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, label, value, start, end: `Label: Value` lines of the specifications; the last of a label counts."""
    pattern = r"^\s*([^:]+?)\s*:\s*(.*?)\s*$"
    rows = lines(documents, key, column).where("section = 'Specifications'").where(F.col("line").rlike(r"^[^:]+:\s*\S"))
    value = F.regexp_extract("line", pattern, 2)
    at = F.col("start") + F.call_function("locate", value, F.col("line"), F.call_function("instr", F.col("line"), F.lit(":"))) - 1
    found = rows.select(key, "n", F.regexp_extract("line", pattern, 1).alias("label"), value.alias("value"), at.cast("int").alias("start"))
    last = found.groupBy(key, "label").agg(F.max_by(F.struct("value", "start"), "n").alias("v"))
    return last.select(key, "label", F.col("v.value").alias("value"), F.col("v.start").alias("start"), (F.col("v.start") + F.length("v.value")).alias("end"))


def bullets(documents: DataFrame, section: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, n, value, start, end: lines that begin with `- ` in a section."""
    rows = lines(documents, key, column).where((F.col("section") == section) & F.col("line").startswith("- "))
    return rows.select(key, "n", F.trim(F.substring("line", 3, 1_000_000)).alias("value"), (F.col("start") + 2).alias("start"), (F.col("start") + F.length(F.rtrim("line"))).alias("end"))


def title(documents: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, title: the second line, where it is not blank."""
    second = F.trim(F.try_element_at(F.split(F.col(column), "\n"), F.lit(2)))
    return documents.select(key, second.alias("title")).where("title <> ''")


def marketing(documents: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, body, start, end: the paragraph behind `Overview` up to a blank line, with single blanks."""
    body = F.regexp_extract(column, r"(?m)^Overview[ \t]*\n((?:[^\n]*\S[^\n]*(?:\n|\z))+)", 1)
    at = F.call_function("instr", F.col(column), body) - 1
    found = documents.select(key, body.alias("raw"), at.alias("start")).where("raw <> ''")
    return found.select(key, text.collapse(F.col("raw")).alias("body"), "start", (F.col("start") + F.length(F.regexp_replace("raw", r"\s+$", ""))).alias("end"))


def links(documents: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, label, url, start, end: `Label: http...` lines of the section Documents."""
    pattern = r"^\s*([^:]+?)\s*:\s*(https?://\S+)"
    rows = lines(documents, key, column).where("section = 'Documents'").where(F.col("line").rlike(pattern))
    url = F.regexp_extract("line", pattern, 2)
    at = F.col("start") + F.call_function("instr", F.col("line"), url) - 1
    return rows.select(key, F.regexp_extract("line", pattern, 1).alias("label"), url.alias("url"), at.alias("start"), (at + F.length(url)).alias("end"))


def facts(documents: DataFrame, key: str = "doc_id", column: str = "text", domain: str = "domain") -> DataFrame:
    """key, field, value, start, end: what documents say for delivery columns besides specifications.

    Features and applications in order, the overview as marketing text, the title as alternative text of images, links by
    what their label names (first match of the list), and the host, state and number of links.
    """
    place = lambda df, name, most: (
        df.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("n"))).where(F.col("k") <= most).select(key, F.format_string(f"{name}_%02d", "k").alias("field"), "value", "start", "end")
    )
    told = place(bullets(documents, "Features", key, column), "FEATURE", 12).unionByName(place(bullets(documents, "Applications", key, column), "APPLICATION", 4))
    told = told.unionByName(marketing(documents, key, column).select(key, F.lit("MARKETING_DESC").alias("field"), F.col("body").alias("value"), "start", "end"))
    first = F.length(F.split(F.col(column), "\n")[0]) + 1
    names = documents.join(title(documents, key, column), key).select(key, F.lit("IMAGE_ALT_TEXT").alias("field"), F.col("title").alias("value"), first.alias("start"), (first + F.length("title")).alias("end"))
    refs = links(documents, key, column)
    field = F.coalesce(*[F.when(F.lower("label").contains(word), c) for word, c in V.LINK_COLUMNS])
    host = text.domain_of(F.col("url"))
    linked = refs.withColumn("field", field).where(F.col("field").isNotNull() & (host != "") & ~host.isin(V.EXCLUDED_HOSTS)).select(key, "field", F.col("url").alias("value"), "start", "end")
    per = refs.groupBy(key).agg(F.count("*").cast("string").alias("n"), F.min(F.struct("start", "end")).alias("at")).join(documents.select(key, F.col(domain).alias("d")), key)
    cells = F.array(F.struct(F.lit("ASSET_SOURCE_DOMAIN").alias("field"), F.coalesce("d", F.lit("")).alias("value")), F.struct(F.lit("ASSET_STATUS").alias("field"), F.lit("documents sourced; images not retrieved").alias("value")), F.struct(F.lit("ASSET_COUNT").alias("field"), F.col("n").alias("value")))
    assets = per.select(key, F.explode(cells).alias("c"), "at").select(key, "c.field", "c.value", F.col("at.start").alias("start"), F.col("at.end").alias("end"))
    return told.unionByName(names).unionByName(linked).unionByName(assets)


def names_part(documents: DataFrame, key: str = "doc_id", column: str = "text", part: str = "part_number") -> DataFrame:
    """key, named: whether a text names its part, whatever the punctuation; null parts are not named."""
    p = text.squash(F.coalesce(F.col(part), F.lit("")))
    return documents.select(key, ((p != "") & F.contains(text.squash(F.coalesce(F.col(column), F.lit(""))), p)).alias("named"))


def integral(documents: DataFrame, key: str = "doc_id", column: str = "text", part: str = "part_number") -> tuple[DataFrame, DataFrame]:
    """Documents that name the part they are filed under, and those discarded because they do not."""
    told = documents.join(names_part(documents, key, column, part).distinct(), key)
    return told.where("named").drop("named"), told.where("not named").drop("named")


def gate(urls: DataFrame, manufacturers: DataFrame, url: str = "url", maker: str = "manufacturer_name") -> DataFrame:
    """urls with domain, verdict and reason, decided before any request.

    In order: no host, an excluded host, a host whose name marks resellers, a host the maker owns or one above or
    below it, a host that carries the maker's name; everything else is rejected.
    """
    owned = manufacturers.where(F.col("domain") != "").groupBy("manufacturer_name").agg(F.collect_set(F.lower("domain")).alias("_owned")).withColumnRenamed("manufacturer_name", maker)
    told = urls.withColumn("domain", text.domain_of(F.col(url))).join(small(owned), maker, "left")
    dom = F.col("domain")
    base = F.element_at(F.split(F.concat(F.lit("."), F.regexp_replace(dom, r"\.[^.]*$", "")), r"\."), -1)
    marked = F.lit(False)
    for word in V.EXCLUDED_HOST_WORDS:
        marked = marked | base.contains(word)
    near = F.exists(F.coalesce("_owned", F.array().cast("array<string>")), lambda o: (o == dom) | dom.endswith(F.concat(F.lit("."), o)) | o.endswith(F.concat(F.lit("."), dom)))
    name = F.substring(F.regexp_replace(F.lower(F.coalesce(F.col(maker), F.lit(""))), "[^a-z0-9]", ""), 1, 6)
    carries = (name != "") & F.contains(F.regexp_replace(dom, "[^a-z0-9]", ""), name)
    steps = [
        (dom == "", "rejected", "unparseable URL"),
        (dom.isin(V.EXCLUDED_HOSTS), "rejected", "excluded host"),
        (marked, "rejected", "host name of a reseller"),
        (near, "admitted", "host of the maker"),
        (carries, "admitted", "host carries the maker's name"),
    ]
    verdict, reason = F.lit("rejected"), F.lit("not established as a source")
    for met, v, r in reversed(steps):
        verdict, reason = F.when(met, v).otherwise(verdict), F.when(met, r).otherwise(reason)
    return told.withColumn("verdict", verdict).withColumn("reason", reason).drop("_owned")


def gate_summary(gated: DataFrame, order: str) -> DataFrame:
    """domain, reason, decisions, first_url: decisions by host and reason, with the first as an example."""
    return gated.groupBy("domain", "reason").agg(F.count("*").alias("decisions"), F.min_by("url", order).alias("first_url"))


def document_of(items: DataFrame, documents: DataFrame, order: str = "doc_id", catch_all: tuple[str, ...] = ("MISC-0000",)) -> DataFrame:
    """row_id, doc_id: the last document of each item's part number; the numbers of `catch_all` stand for no product and have none.

    Documents are reduced to one per part before the join, so a part number that many items share meets one row.
    """
    named = F.coalesce(F.col("part_number"), F.lit("")) != ""
    real = named & ~F.col("part_number").isin(*catch_all)
    last = documents.where(real).groupBy("part_number").agg(F.max(order).alias("doc_id"))
    return items.where(real).select("row_id", "part_number").join(last, "part_number").select("row_id", "doc_id")


def overruled(attributes: DataFrame, specs: DataFrame) -> DataFrame:
    """row_id, label, value, uom, kind, locator, outcome of items with a document: its specifications against what was known.

    attributes: row_id, label, value, uom, kind, locator; specs: row_id, doc_id, label, value, start, end. A value that
    differs supersedes (`overruled`), one that agrees leaves things as they are (`kept`), a new label is `added`.
    """
    told = specs.where(~F.col("label").isin(list(V.SPEC_COLUMNS))).select("row_id", "label", F.col("value").alias("d_value"), text.doc_locator(F.col("doc_id"), F.col("start"), F.col("end")).alias("d_loc"))
    both = attributes.join(told, ["row_id", "label"], "full_outer")
    prior = F.trim(F.concat_ws(" ", "value", F.nullif(F.coalesce("uom", F.lit("")), F.lit(""))))
    new = F.col("value").isNull()
    change = F.col("d_value").isNotNull() & (new | (F.lower("d_value") != F.lower(prior)))
    pick = lambda a, b: F.when(change, a).otherwise(b)
    outcome = F.when(new, "added").when(change, "overruled").otherwise("kept")
    return both.select("row_id", "label", pick(F.col("d_value"), F.col("value")).alias("value"), pick(F.lit(""), F.col("uom")).alias("uom"), pick(F.lit("sourced"), F.col("kind")).alias("kind"), pick(F.col("d_loc"), F.col("locator")).alias("locator"), outcome.alias("outcome"))
