"""Catalogues, document caches, decisions and vocabularies from files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from loomcat.operators import ingest
from loomcat.operators.numbering import numbered
from loomcat.sources.workbook import read_sheets

DOCUMENT = "doc_id string, part_number string, text string, url string, domain string, brand string, retrieved_at string, reconstructed boolean, verdict string"
DECISION = "kind string, key string, value string, actor string, note string, at string"
KINDS = ["item_type_map", "attribute_names", "manufacturer_map", "contradictions"]


def find_input(given: str | None, folder: str, preferred: list[str] = ()) -> str:
    """The given path, else the first preferred name in a folder, else its first workbook, else its first csv file."""
    if given:
        return given
    here = Path(folder)
    for name in preferred:
        if (here / name).exists():
            return str(here / name)
    for pattern in ("*.xlsx", "*.csv"):
        for p in sorted(here.glob(pattern)):
            if not p.name.startswith("_"):
                return str(p)
    raise FileNotFoundError(f"no catalogue in {folder}")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """All cells of a csv file or workbook as strings, absent ones empty. Of a workbook the first sheet counts."""
    if path.lower().endswith((".xlsx", ".xls")):
        rows = next(iter(read_sheets(path).values()), [])
        lines = spark.createDataFrame([(i, r) for i, r in enumerate(rows[:15])], "line int, cells array<string>")
        at = ingest.header_row(lines).first()["line"] if rows else 0
        return _table(spark, rows[at] if rows else [], rows[at + 1 :])
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"').fillna("")


def _table(spark: SparkSession, header: list[str], rows: list[list[str]]) -> DataFrame:
    """Rows of a sheet under its header; empty and repeated headers get a number, short rows empty cells."""
    names: list[str] = []
    for i, h in enumerate(header):
        names.append(h if h and h not in names else f"{h}_{i}")
    body = [[*r, *[""] * len(names)][: len(names)] for r in rows if any(c.strip() for c in r)]
    return spark.createDataFrame(body, T.StructType([T.StructField(n, T.StringType()) for n in names]))


#: Rows among which the header of a vocabulary's sheet is looked for.
HEADER_ROWS = 12


def read_vocabulary(spark: SparkSession, path: str, wanted: dict[str, list[str]]) -> DataFrame | None:
    """A vocabulary from any sheet of a workbook: one column for each wanted name, under a header that holds one of its words.

    The first sheet with a row among its first HEADER_ROWS that has all wanted names counts, header cells are compared in
    lower case by what they contain. None if the file is missing or has no such sheet.
    """
    if not Path(path).exists():
        return None
    for rows in read_sheets(path).values():
        for at, header in enumerate(rows[:HEADER_ROWS]):
            found = {name: next((i for i, h in enumerate(header) if any(w in h.strip().lower() for w in words)), None) for name, words in wanted.items()}
            if None not in found.values():
                body = [[(r[i] if i < len(r) else "").strip() for i in found.values()] for r in rows[at + 1 :]]
                return _table(spark, list(found), body)
    return None


def read_manufacturers(spark: SparkSession, path: str, seed: DataFrame) -> DataFrame:
    """Makers and brands of a supplied workbook, an empty brand being the maker's; host, sector and aliases from the seed by name.

    Without a readable workbook the seed itself.
    """
    told = read_vocabulary(spark, path, {"manufacturer_name": ["manufacturer name", "mfr name", "manufacturer"], "manufacturer_code": ["manufacturer code", "mfr code"], "brand_name": ["brand name"], "brand_code": ["brand code"]})
    if told is None:
        return seed
    told = told.where("manufacturer_name <> ''").withColumn("brand_name", F.when(F.col("brand_name") == "", F.col("manufacturer_name")).otherwise(F.col("brand_name"))).distinct()
    facts = seed.groupBy("manufacturer_name").agg(F.min("domain").alias("domain"), F.min("sector").alias("sector"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))))).alias("aliases"))
    return told.join(facts, "manufacturer_name", "left").select("manufacturer_name", "manufacturer_code", "brand_name", "brand_code", F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("sector", F.lit("")).alias("sector"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def assembled(spark: SparkSession, folder: str, seeds: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Vocabularies by name, supplied ones before those of the seed, and where each comes from.

    In the folder manufacturers.xlsx and units.xlsx are looked for; seeds: manufacturers, units and any others.
    """
    out, whence = dict(seeds), {name: "seed" for name in seeds}
    if Path(f"{folder}/manufacturers.xlsx").exists():
        supplied = read_manufacturers(spark, f"{folder}/manufacturers.xlsx", seeds["manufacturers"])
        if supplied is not seeds["manufacturers"]:
            out["manufacturers"], whence["manufacturers"] = supplied, "supplied"
    units = read_vocabulary(spark, f"{folder}/units.xlsx", {"measurement_type": ["measurement type", "type"], "canonical": ["abbreviation", "canonical"], "aliases": ["alias", "term"]})
    if units is not None:
        split = F.filter(F.split("aliases", r"\s*[,;|]\s*"), lambda a: a != "")
        layered = unit_layers(units.where("canonical <> ''").select("measurement_type", "canonical", split.alias("aliases")), seeds["units"])
        out["units"] = layered.groupBy("measurement_type", "canonical").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
        whence["units"] = "supplied over seed"
    return out, whence


def read_catalogue(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """row_id and the six cells of a catalogue, in the order of the file; a limit keeps the first rows."""
    cells, _ = ingest.named(read_cells(spark, path))
    placed = numbered(cells.withColumn("_n", F.monotonically_increasing_id()), [F.asc("_n")], "row_id").drop("_n")
    return placed if limit is None else placed.where(F.col("row_id") < limit)


def read_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents of a cache that name their part, and those that do not. Entries without a file are left out."""
    index = spark.read.json(f"{folder}/index.json", multiLine=True)
    entries = index.select(F.explode("documents").alias("d")).select("d.*")
    texts = spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("text"))
    docs = entries.join(texts, "file")
    names = [f.split()[0] for f in DOCUMENT.split(", ")]
    docs = docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).alias(c) for c in names])
    from loomcat.functions.text import squash

    named = F.contains(squash(F.col("text")), squash(F.col("part_number"))) & (squash(F.col("part_number")) != "")
    return docs.where(named), docs.where(~F.coalesce(named, F.lit(False)))


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """The log of decisions; empty if the file is missing or broken."""
    try:
        told = json.loads(Path(path).read_text())
        rows = [tuple(str(e.get(c, "")) for c in ("kind", "key", "value", "actor", "note", "at")) for e in told.get("log", [])]
    except (OSError, ValueError, AttributeError):
        rows = []
    return spark.createDataFrame(rows, DECISION)


def decided(log: DataFrame) -> DataFrame:
    """kind, key, value: the latest decision of each kind and key since the last `clear`."""
    clear = log.where("kind = 'clear'").agg(F.max("at").alias("cleared")).first()[0]
    live = log.where(F.col("kind").isin(KINDS)) if clear is None else log.where(F.col("kind").isin(KINDS) & (F.col("at") > clear))
    return live.groupBy("kind", "key").agg(F.max_by("value", "at").alias("value"))


def unit_layers(supplied: DataFrame | None, seed: DataFrame) -> DataFrame:
    """measurement_type, canonical, alias, provenance: supplied aliases over those of the seed, the first of an alias counts."""
    def spread(df: DataFrame, name: str, rank: int) -> DataFrame:
        forms = F.array_union(F.array("canonical", F.concat("canonical", F.lit("s"))), F.coalesce("aliases", F.array().cast("array<string>")))
        return df.select("measurement_type", "canonical", F.explode(F.transform(forms, lambda a: F.lower(F.trim(a)))).alias("alias"), F.lit(name).alias("provenance"), F.lit(rank).alias("rank"))

    both = spread(seed, "seed", 1)
    if supplied is not None:
        both = spread(supplied, "supplied", 0).unionByName(both)
    first = both.where("alias <> ''").groupBy("alias").agg(F.min_by(F.struct("measurement_type", "canonical", "provenance"), F.struct("rank", "measurement_type", "canonical")).alias("u"))
    return first.select("u.measurement_type", "u.canonical", "alias", "u.provenance")


def ordered_labels(rows: DataFrame, group: str = "classpath", label: str = "label", order: str = "pos") -> DataFrame:
    """classpath, sequence: the distinct labels of each category in order of first appearance."""
    first = rows.groupBy(group, label).agg(F.min(order).alias("at"))
    return first.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("at", label))).alias("s")).select(group, F.col(f"s.{label}").alias("sequence"))


def fraction_table(rows: DataFrame) -> DataFrame:
    """text, value of the fractions n/d with 0 < n < d in a column `cell`; the first of a value counts."""
    p = r"^\s*(\d+)\s*/\s*(\d+)\s*$"
    n, d = F.regexp_extract("cell", p, 1).try_cast("int"), F.regexp_extract("cell", p, 2).try_cast("int")
    told = rows.select(F.trim("cell").alias("text"), "pos", n.alias("n"), d.alias("d")).where("n > 0 and n < d").withColumn("value", F.col("n") / F.col("d"))
    return told.withColumn("k", F.row_number().over(Window.partitionBy("value").orderBy("pos"))).where("k = 1").select("text", "value")
