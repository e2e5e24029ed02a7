"""Queries of the compiler's operators over the test tables, each with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomcat import vocabulary as V
from loomcat.functions import measures, text, tokens
from loomcat.operators import documents as docs, entity, extract, families, graph, induce, ingest, ledger, propagate, search, setjoin, verify
from loomcat.operators.numbering import numbered
from loomcat.plans.compile import compile_catalogue, leaves, vocabulary
from loomcat.session import keyed, settled, small, stored, table
from loomcat.sources import catalogue as files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# -- inputs -------------------------------------------------------------------------------------------------------

DISTRIBUTOR = "Northern Supply Company"
_HOLES = {"e1_brand": "-- Unbranded --", "unilog_brand": "-- No Unilog Brand --", "dib_brand": "-- No DIB Brand --"}


def part_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue over `part`: row_id and the six cells."""
    part, line, supp = (table(spark, sf_dir, t) for t in ("part", "lineitem", "supplier"))
    first = line.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("s_suppkey"))
    named = part.join(first, "p_partkey", "left").join(supp.select("s_suppkey", "s_name"), "s_suppkey", "left")
    cells = numbered(named, [F.asc("p_partkey")], "row_id")
    brand = lambda n, c: F.when(F.col("p_partkey") % n == 0, F.col("p_brand")).otherwise(_HOLES[c]).alias(c)
    return cells.select(
        "row_id", F.concat(F.lit("PN-"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("part_number"),
        F.concat("p_type", F.lit(" "), F.col("p_size").cast("string"), F.lit("in "), "p_name").alias("description"),
        brand(8, "e1_brand"), brand(11, "unilog_brand"), brand(15, "dib_brand"), F.when(F.col("row_id") % 5 == 0, DISTRIBUTOR).otherwise(F.coalesce("s_name", F.lit(""))).alias("part_manuf"),
    )


CAT = f"""cat AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_id, 'PN-' || lpad(p_partkey::VARCHAR, 6, '0') AS part_number,
 p_type || ' ' || p_size || 'in ' || p_name AS description, p_type, p_size, p_name, p_brand,
 CASE WHEN p_partkey % 8 = 0 THEN p_brand ELSE '-- Unbranded --' END AS e1_brand, CASE WHEN p_partkey % 11 = 0 THEN p_brand ELSE '-- No Unilog Brand --' END AS unilog_brand,
 CASE WHEN p_partkey % 15 = 0 THEN p_brand ELSE '-- No DIB Brand --' END AS dib_brand,
 CASE WHEN (row_number() OVER (ORDER BY p_partkey) - 1) % 5 = 0 THEN '{DISTRIBUTOR}' ELSE coalesce(s_name, '') END AS part_manuf
 FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS sk FROM lineitem GROUP BY 1) ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = sk)"""
REC = "rec AS (SELECT row_id, any_value(part_number) AS part_number, any_value(description) AS description, any_value(e1_brand) AS e1_brand, any_value(unilog_brand) AS unilog_brand, any_value(dib_brand) AS dib_brand, any_value(part_manuf) AS part_manuf, any_value(feed) AS feed FROM items GROUP BY row_id)"
_PLAIN = r"--\s*unbranded\s*--|--\s*no\s+(?:(?:unilog|dib)\s+)?brand\s*--|--+|n/?a|none|null|unknown|tbd|\.+|0"
HOLE = lambda c: f"({c} IS NULL OR regexp_full_match(lower({c}), '\\s*(?:|nan|nat|{_PLAIN})\\s*'))"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, each record once."""
    return keyed(table(spark, sf_dir, "items"), "row_id").dropDuplicates(["row_id"])


# -- ingest and scalar functions ----------------------------------------------------------------------------------


@query(f"""WITH {REC}, c AS (SELECT *, CASE WHEN {HOLE('description')} THEN 0 ELSE length(trim(regexp_replace(description, '\\s+', ' ', 'g'))) END AS n FROM rec),
d AS (SELECT count(*) AS k FROM (SELECT coalesce(part_number, '') FROM rec GROUP BY 1 HAVING count(*) > 1))
SELECT count(*) AS n_rows, round(100.0 * sum({HOLE('e1_brand')}::INT + {HOLE('unilog_brand')}::INT + {HOLE('dib_brand')}::INT) / (3 * count(*)), 4) AS placeholder_pct,
 round(avg(n), 4) AS mean_length, min(n) AS min_length, max(n) AS max_length, median(n) AS median_length,
 count(DISTINCT CASE WHEN {HOLE('part_manuf')} THEN NULL ELSE trim(regexp_replace(part_manuf, '\\s+', ' ', 'g')) END) AS n_makers, (SELECT k FROM d)::BIGINT AS repeated_part_numbers FROM c""")  # fmt: skip
def ingest_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: one row about the whole input."""
    return ingest.profile(records(spark, sf_dir))


@query(f"SELECT brand, CASE WHEN {HOLE('brand')} THEN '' ELSE trim(regexp_replace(brand, '\\s+', ' ', 'g')) END AS clean, count(*) AS cells FROM (SELECT e1_brand AS brand FROM items UNION ALL SELECT unilog_brand FROM items UNION ALL SELECT dib_brand FROM items) GROUP BY 1, 2")
def placeholder_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand cells as they are and clean."""
    items = table(spark, sf_dir, "items")
    cells = items.select(F.explode(F.array("e1_brand", "unilog_brand", "dib_brand")).alias("brand")).groupBy("brand").agg(F.count("*").alias("cells"))
    return cells.select("brand", text.clean(F.col("brand")).alias("clean"), "cells")


@query("SELECT coalesce(part_number, '') AS key, count(*) AS copies FROM items GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: part numbers that more than one row has."""
    return ingest.duplicate_keys(table(spark, sf_dir, "items"), "part_number")


_CELLS = ["part_number", "description", "e1_brand", "unilog_brand", "dib_brand", "part_manuf"]


@query("SELECT cells, count(*) AS n FROM (SELECT " + " + ".join(f"(trim(coalesce({c}, '')) <> '')::INT" for c in _CELLS) + " AS cells FROM items) GROUP BY 1")
def populated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the number of cells they fill."""
    return table(spark, sf_dir, "items").groupBy(text.populated(_CELLS).alias("cells")).agg(F.count("*").alias("n"))


@query(f"WITH {CAT} SELECT row_id, len([x FOR x IN [e1_brand, unilog_brand, dib_brand] IF x NOT LIKE '-- %'])::INT AS n, coalesce([x FOR x IN [e1_brand, unilog_brand, dib_brand] IF x NOT LIKE '-- %'][1], '') AS first FROM cat")
def brand_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand cells that name something, in order."""
    c = F.filter(F.array(*[text.clean(F.col(b)) for b in _HOLES]), lambda x: x != "")
    return part_catalogue(spark, sf_dir).select("row_id", F.size(c).alias("n"), F.coalesce(F.try_element_at(c, F.lit(1)), F.lit("")).alias("first"))


_TOK = lambda spark, sf_dir: part_catalogue(spark, sf_dir).withColumn("tokens", tokens.tokens(F.col("description")))


@query(f"""WITH {CAT} SELECT row_id, unnest(['word', 'glued', 'word', 'word']) AS kind, unnest([p_type, p_size || 'in', split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]) AS text,
 unnest([0, length(p_type) + 1, length(p_type || p_size) + 4, length(p_type || p_size || split_part(p_name, ' ', 1)) + 5])::INT AS start FROM cat""")
def tokenize_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tokens of descriptions with their kinds and places."""
    return _TOK(spark, sf_dir).select("row_id", F.explode("tokens").alias("t")).select("row_id", "t.kind", "t.text", "t.start")


@query(f"WITH {CAT} SELECT lower(p_type) || ' # ' || lower(p_name) AS skeleton, count(*) AS n, max(3)::INT AS words, max(1)::INT AS measures FROM cat GROUP BY 1")
def skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skeletons with their rows, content words and measures."""
    t = _TOK(spark, sf_dir).select(tokens.skeleton(F.col("tokens")).alias("skeleton"), F.size(tokens.content_words(F.col("tokens"))).alias("w"), F.size(tokens.measures(F.col("tokens"))).alias("m"))
    return t.groupBy("skeleton").agg(F.count("*").alias("n"), F.max("w").alias("words"), F.max("m").alias("measures"))


@query()
def item_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 over the descriptions of all items: tokens by kind."""
    t = keyed(table(spark, sf_dir, "items").select("row_id", "description"), "row_id").select(F.explode(tokens.tokens(text.clean(F.col("description")))).alias("t"))
    return t.groupBy("t.kind").agg(F.count("*").alias("tokens"), F.countDistinct("t.norm").alias("norms"))


@query("SELECT part_manuf, trim(regexp_replace(replace(replace(lower(part_manuf), '®', ''), '™', ''), '[^a-z0-9]+', ' ', 'g')) AS key FROM items WHERE part_manuf IS NOT NULL GROUP BY 1")
def norm_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: keys of vendor cells."""
    return table(spark, sf_dir, "items").where("part_manuf is not null").select("part_manuf").distinct().withColumn("key", text.norm_key(F.col("part_manuf")))


_ACC = "'accessory', 'accessories', 'acct', 'account', 'vendor', 'div', 'division', 'dist', 'direct', 'program', 'line'"


@query(f"""SELECT part_manuf, regexp_replace(array_to_string([w FOR w IN string_split_regex(regexp_replace(part_manuf, '\\s*\\(\\d{{2,6}}\\)\\s*$', ''), '\\s+')
 IF w <> '' AND lower(regexp_replace(w, '^[.,]+|[.,]+$', '', 'g')) NOT IN ({_ACC})], ' '), '^[ .,]+|[ .,]+$', '', 'g') AS core FROM items WHERE part_manuf IS NOT NULL GROUP BY 1""")
def account_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vendor cells without what marks an account."""
    return table(spark, sf_dir, "items").where("part_manuf is not null").select("part_manuf").distinct().withColumn("core", text.strip_account(F.col("part_manuf")))


@query("""WITH v AS (SELECT DISTINCT value FROM attributes WHERE regexp_full_match(value, '\\d+|\\d*\\.\\d+|\\d+/[1-9]\\d*|\\d+-\\d+/[1-9]\\d*')),
p AS (SELECT value, CASE WHEN value LIKE '%-%' THEN split_part(value, '-', 1)::DOUBLE + split_part(split_part(value, '-', 2), '/', 1)::DOUBLE / split_part(value, '/', 2)::DOUBLE
 WHEN value LIKE '%/%' THEN split_part(value, '/', 1)::DOUBLE / split_part(value, '/', 2)::DOUBLE ELSE value::DOUBLE END AS x FROM v),
f AS (SELECT *, x - floor(x) AS r, (SELECT min(d) FROM unnest([2, 4, 8, 16, 32, 64]) u(d) WHERE abs(round(r * d) / d - r) <= 1e-9 AND round(r * d) > 0 AND round(r * d) < d) AS d FROM p)
SELECT value, round(x, 6) AS decimal, CASE WHEN value LIKE '%/%' OR value NOT LIKE '%.%' THEN value WHEN r <= 1e-9 THEN floor(x)::BIGINT::VARCHAR
 WHEN d IS NULL THEN CASE WHEN value LIKE '0.%' THEN substr(value, 2) ELSE value END
 ELSE CASE WHEN x >= 1 THEN floor(x)::BIGINT || '-' ELSE '' END || round(r * d)::BIGINT || '/' || d END AS trade FROM f""")
def trade_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of attribute values as doubles and in trade form."""
    v = table(spark, sf_dir, "attributes").select("value").where(F.col("value").rlike(r"^(?:\d+|\d*\.\d+|\d+/[1-9]\d*|\d+-\d+/[1-9]\d*)$")).distinct()
    return v.select("value", F.round(text.to_decimal(F.col("value")), 6).alias("decimal"), text.trade_number(F.col("value")).alias("trade"))


_ALIAS = "al AS (SELECT alias, min(canonical) AS unit, count(DISTINCT canonical) AS k FROM (SELECT canonical, unnest(list_append(aliases, canonical)) AS a FROM units), LATERAL (SELECT trim(lower(a), '.') AS alias) GROUP BY alias)"


@query(f"""WITH {_ALIAS}, u AS (SELECT DISTINCT uom, trim(lower(trim(uom)), '.') AS key FROM attributes WHERE uom IS NOT NULL AND trim(uom) NOT IN ('#', '"', '''''', '''')),
h AS (SELECT uom, key, (SELECT unit FROM al WHERE alias = key AND k = 1) AS a, (SELECT unit FROM al WHERE alias = rtrim(key, 's') AND k = 1) AS b, (SELECT unit FROM al WHERE alias = key || 's' AND k = 1) AS c,
 (SELECT unit FROM al WHERE alias = replace(key, '.', '') AND k = 1) AS d FROM u)
SELECT uom, CASE WHEN key = '' THEN NULL WHEN key IN ('in', 'inch', 'inches') THEN 'in' ELSE coalesce(a, b, c, d) END AS unit FROM h""")
def unit_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of attributes in their canonical spelling."""
    u = table(spark, sf_dir, "attributes").select("uom").where("uom is not null and trim(uom) not in ('#', '\"', '''''', '''')").distinct()
    return u.withColumn("unit", measures.canonical_unit(F.col("uom"), measures.Units.read(table(spark, sf_dir, "units"))))


@query("""SELECT l_quantity::INT || ' in' AS measure, (l_quantity::INT)::VARCHAR AS magnitude, 'in' AS unit, l_quantity AS decimal, count(*) AS n FROM lineitem GROUP BY ALL""")
def parse_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """measures as magnitude, unit and value."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" in")).alias("measure")).agg(F.count("*").alias("n"))
    p = measures.parse_measure(F.col("measure"), measures.Units.read(table(spark, sf_dir, "units")))
    return m.withColumn("p", p).select("measure", "p.magnitude", "p.unit", "p.decimal", "n")


@query()
def normal_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of attributes in normal form."""
    v = table(spark, sf_dir, "attributes").where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    return measures.with_normal_values(v, "value", measures.Units.read(table(spark, sf_dir, "units")))


@query("""SELECT p_name, p_type, array_to_string([upper(left(w, 1)) || substr(w, 2) FOR w IN string_split(p_name, ' ')], ' ') AS title, upper(p_name) || ' COMM' AS invoice,
 CASE WHEN length(p_name) <= 8 THEN p_name ELSE CASE WHEN length(split_part(p_name, ' ', 1)) <= 8 THEN split_part(p_name, ' ', 1) ELSE left(p_name, 8) END END AS short FROM part GROUP BY ALL""")
def wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """title case, invoice form and fit to a limit."""
    p = table(spark, sf_dir, "part").select("p_name", "p_type").distinct()
    return p.select("p_name", "p_type", text.title_case(F.col("p_name"), ["in", "lb"]).alias("title"), text.invoice_form(F.concat("p_name", F.lit(" commercial"))).alias("invoice"), text.fit(F.col("p_name"), 8).alias("short"))


@query("""SELECT locator, regexp_extract(locator, '^row:(\\d+):', 1)::BIGINT AS row_id, regexp_extract(locator, '\\[(\\d+):', 1)::INT AS start, regexp_extract(locator, ':(\\d+)\\]$', 1)::INT AS "end",
 count(*) AS n FROM attributes WHERE locator IS NOT NULL GROUP BY ALL""")
def locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parsed locators, written again from their parts."""
    a = table(spark, sf_dir, "attributes").where("locator is not null").groupBy("locator").agg(F.count("*").alias("n")).withColumn("p", text.parse_locator(F.col("locator")))
    row = F.element_at(F.split("p.ref", ":"), 1).cast("long")
    again = a.select(text.row_locator(row, F.element_at(F.split("p.ref", ":"), 2), F.col("p.start"), F.col("p.end")).alias("locator"), row.alias("row_id"), "p.start", "p.end", "n")
    return again


@query("""SELECT doc_id, CASE WHEN instr(text, part_number) > 0 THEN instr(text, part_number) ELSE instr(lower(text), lower(part_number)) END::INT - 1 AS start FROM documents WHERE instr(lower(text), lower(part_number)) > 0 AND part_number <> ''""")
def find_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """where each document with a text and a part number names its part."""
    d = table(spark, sf_dir, "documents").where("part_number <> '' and instr(lower(text), lower(part_number)) > 0")
    return d.select("doc_id", text.find_span(F.col("text"), F.col("part_number"))["start"].alias("start"))


@query("""SELECT url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS host, count(*) AS n FROM documents WHERE url IS NOT NULL GROUP BY 1, 2""")
def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hosts of documents."""
    d = table(spark, sf_dir, "documents").where("url is not null").groupBy("url").agg(F.count("*").alias("n"))
    return d.select("url", text.domain_of(F.col("url")).alias("host"), "n")


# -- families and induction ---------------------------------------------------------------------------------------

_FAM = f"{CAT}, fam AS (SELECT p_type, p_name, count(*) AS size, min(row_id) AS exemplar_id, count(DISTINCT p_size) AS sizes, row_number() OVER (ORDER BY count(*) DESC, lower(p_type) || ' # ' || lower(p_name)) AS n FROM cat GROUP BY 1, 2 HAVING count(*) > 1)"
_ID = "format('fam-{:04d}', n)"


def _families(spark: SparkSession, sf_dir: str) -> families.Families:
    c = _TOK(spark, sf_dir)
    return families.build(c.select("row_id", "tokens", tokens.skeleton(F.col("tokens")).alias("skeleton")))


@query(f"WITH {_FAM} SELECT {_ID} AS family_id, lower(p_type) || ' # ' || lower(p_name) AS key, size, exemplar_id FROM fam")
def family_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families in order."""
    return _families(spark, sf_dir).families


@query(f"WITH {_FAM} SELECT row_id, coalesce({_ID}, '') AS family_id FROM cat LEFT JOIN fam USING (p_type, p_name)")
def family_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family of each row; singletons have none."""
    f = _families(spark, sf_dir)
    return f.members.select("row_id", "family_id").unionByName(f.singletons.withColumn("family_id", F.lit("")))


@query(f"""WITH {_FAM} SELECT {_ID} AS family_id, s AS slot, CASE WHEN s = 1 THEN sizes ELSE 1 END AS n_distinct, s = 1 AND sizes > 1 AS is_axis,
 CASE s WHEN 0 THEN p_type WHEN 1 THEN CASE WHEN sizes = 1 THEN e.p_size || 'in' END WHEN 2 THEN split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 2) END AS value,
 CASE s WHEN 0 THEN '' WHEN 1 THEN p_type WHEN 2 THEN e.p_size || 'in' ELSE split_part(p_name, ' ', 1) END AS "left",
 CASE s WHEN 0 THEN e.p_size || 'in' WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN split_part(p_name, ' ', 2) ELSE '' END AS "right"
FROM fam JOIN (SELECT row_id, p_size FROM cat) e ON e.row_id = exemplar_id, range(4) r(s)""")
def family_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of families, which vary and which do not, with what stands around them."""
    s = _families(spark, sf_dir).slots
    return s.select("family_id", F.col("slot").cast("long").alias("slot"), "n_distinct", "is_axis", "value", "left", "right")


@query(f"WITH {_FAM} SELECT {_ID} AS family_id, 1::BIGINT AS slot, 'Nominal Size' AS label, 'pattern' AS source FROM fam WHERE sizes > 1")
def axis_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the slots that vary."""
    names = families.axis_names(_families(spark, sf_dir), table(spark, sf_dir, "units"))
    return names.select("family_id", F.col("slot").cast("long").alias("slot"), "label", "source")


@query(f"WITH {_FAM} SELECT coalesce(sum(sizes), 0)::BIGINT AS blocked FROM fam WHERE sizes > 1")
def blocked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values may not be borrowed."""
    return _families(spark, sf_dir).blocked()


_WORDS = "w AS (SELECT DISTINCT p_partkey AS row_id, lower(x) AS word FROM (SELECT p_partkey, unnest(string_split(p_type || ' ' || p_name, ' ')) AS x FROM part) WHERE length(x) > 2)"


def _part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("row_id"), F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), " ").alias("words"), (F.col("p_size") % 10).cast("long").alias("scope"))


@query(f"WITH {_WORDS} SELECT word, count(*) AS rows, count(*) > 0.1 * (SELECT count(*) FROM part) AS stop FROM w GROUP BY 1")
def word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: rows of each word, and which are too common to link rows."""
    items = _part_words(spark, sf_dir)
    n = items.count()
    return induce.word_rows(items).groupBy("word").agg(F.count("*").alias("rows")).withColumn("stop", F.col("rows") > 0.1 * n)


@query("""WITH RECURSIVE n AS (SELECT DISTINCT p_name AS x FROM part), w AS (SELECT x, unnest(string_split(x, ' ')) AS y FROM n),
r(a, b) AS (SELECT x, x FROM n UNION SELECT r.a, w2.x FROM r JOIN w w1 ON w1.x = r.b JOIN w w2 ON w2.y = w1.y)
SELECT a AS node, min(b) AS component FROM r GROUP BY 1""")
def name_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of part names linked by words."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    edges = names.select("p_name", F.explode(F.split("p_name", " ")).alias("w"))
    found = graph.components(edges.select(F.concat(F.lit("1"), "p_name").alias("a"), F.concat(F.lit("2"), "w").alias("b"))).where("node like '1%'")
    return found.select(F.expr("substring(node, 2)").alias("node"), F.expr("substring(component, 2)").alias("component"))


def _item_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = records(spark, sf_dir)
    return stored(items.select("row_id", tokens.content_words(tokens.tokens(text.clean(F.col("description")))).alias("words")))


@query()
def item_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes of items that share three words, with their rows."""
    return induce.scopes(_item_words(spark, sf_dir)).groupBy("scope").agg(F.count("*").alias("rows"))


_CAND = f"{_WORDS}, s AS (SELECT p_partkey AS row_id, p_size % 10 AS scope FROM part), z AS (SELECT scope, count(*) AS size FROM s GROUP BY 1 HAVING count(*) >= 6), c AS (SELECT scope, word, count(*) AS support FROM w JOIN s USING (row_id) JOIN z USING (scope) GROUP BY scope, word, size HAVING count(*) >= 3 AND count(*) <= 0.8 * size)"


@query(f"WITH {_CAND} SELECT scope::BIGINT AS scope, word, support FROM c")
def word_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: words that may be values, by scope."""
    items = _part_words(spark, sf_dir)
    return induce.candidates(items, items.select("row_id", "scope"))


@query(f"""WITH {_CAND}, h AS (SELECT row_id, scope, word FROM w JOIN s USING (row_id) JOIN c USING (scope, word)), k AS (SELECT DISTINCT h.scope, h.word, o.word AS other FROM h JOIN w o USING (row_id) WHERE o.word <> h.word),
l AS (SELECT scope, word, list(DISTINCT other) AS o FROM k GROUP BY 1, 2), m AS (SELECT DISTINCT x.scope, x.word AS a, y.word AS b FROM h x JOIN h y USING (row_id) WHERE x.word < y.word)
SELECT x.scope::BIGINT AS scope, x.word AS a, y.word AS b FROM l x JOIN l y ON x.scope = y.scope AND x.word < y.word
WHERE len(list_intersect(x.o, y.o)) >= 0.45 * len(list_distinct(x.o || y.o)) AND NOT EXISTS (SELECT 1 FROM m WHERE m.scope = x.scope AND m.a = x.word AND m.b = y.word)""")
def word_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of one scope that keep the same company but never meet."""
    items = _part_words(spark, sf_dir)
    return induce.alternatives(items, items.select("row_id", "scope"))


@query()
def induced_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Induced attributes of items with their values, by the scopes of items."""
    items = _item_words(spark, sf_dir)
    return induce.induced(items, settled(induce.scopes(items))).select("scope", F.array_join("values", "|").alias("values"), "support", "signature")


@query("""WITH x AS (SELECT p_partkey, lower(w) AS w, i FROM (SELECT p_partkey, unnest(string_split(p_type || ' ' || p_name, ' ')) AS w, generate_subscripts(string_split(p_type || ' ' || p_name, ' '), 1) AS i FROM part) WHERE length(w) > 2),
p AS (SELECT w AS a, lead(w) OVER (PARTITION BY p_partkey ORDER BY i) AS b FROM x) SELECT a, b, count(*) AS times FROM p WHERE b IS NOT NULL GROUP BY 1, 2""")
def adjacent_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often words stand next to each other."""
    return induce.adjacent_pairs(_part_words(spark, sf_dir))


@query("""WITH s AS (SELECT p_name, list(DISTINCT p_size) AS t FROM part GROUP BY 1) SELECT a.p_name AS l, b.p_name AS r, round(len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)), 6) AS similarity
FROM s a JOIN s b ON a.p_name < b.p_name WHERE len(list_intersect(a.t, b.t)) >= 0.3 * len(list_distinct(a.t || b.t))""")
def similar_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names whose sets of sizes overlap."""
    s = table(spark, sf_dir, "part").groupBy("p_name").agg(F.collect_set(F.col("p_size").cast("string")).alias("tokens"))
    return setjoin.similar_sets(s.withColumnRenamed("p_name", "l"), s.withColumnRenamed("p_name", "r"), 0.3).where("l < r").withColumn("similarity", F.round("similarity", 6))


# -- entities and categories --------------------------------------------------------------------------------------

_NK = lambda c: f"trim(regexp_replace(replace(replace(lower({c}), '®', ''), '™', ''), '[^a-z0-9]+', ' ', 'g'))"
_ENT = f"ent AS (SELECT alias, min({{'m': manufacturer_name, 'b': brand_name, 'c': manufacturer_code, 'k': brand_code}}) AS e FROM (SELECT *, {_NK('a')} AS alias FROM (SELECT *, unnest(list_distinct([manufacturer_name, brand_name] || coalesce(aliases, []))) AS a FROM manufacturers)) WHERE alias <> '' GROUP BY 1)"


@query(f"WITH {_ENT}, k AS (SELECT DISTINCT {_NK('part_manuf')} AS key FROM items WHERE part_manuf IS NOT NULL) SELECT key, e.m AS manufacturer_name, e.c AS manufacturer_code FROM k JOIN ent ON alias = key")
def entity_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor cells that are an alias."""
    a = entity.alias_table(table(spark, sf_dir, "manufacturers"))
    k = table(spark, sf_dir, "items").where("part_manuf is not null").select(text.norm_key(F.col("part_manuf")).alias("alias")).distinct()
    return k.join(F.broadcast(a), "alias").select(F.col("alias").alias("key"), "manufacturer_name", "manufacturer_code")


@query(f"""WITH {_ENT}, k AS (SELECT key, list_distinct(string_split(key, ' ')) AS kw FROM (SELECT DISTINCT {_NK('part_manuf')} AS key FROM items WHERE part_manuf IS NOT NULL) WHERE key <> ''), kt AS (SELECT key, len(kw) AS kn, unnest(kw) AS w FROM k),
a AS (SELECT alias, list_distinct(string_split(alias, ' ')) AS aw FROM ent), aw AS (SELECT alias, len(aw) AS an, unnest(aw) AS w FROM a), m AS (SELECT key, alias, count(*) / (kn + an - count(*)) AS score FROM kt JOIN aw USING (w) GROUP BY key, alias, kn, an)
SELECT key, round(max(score), 6) AS score FROM m GROUP BY 1""")
def entity_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best share of words of vendor cells with any alias."""
    a = entity.alias_table(table(spark, sf_dir, "manufacturers"))
    k = table(spark, sf_dir, "items").where("part_manuf is not null").select(text.norm_key(F.col("part_manuf")).alias("key")).where("key <> ''").distinct()
    return entity.word_matches(k, a).select("key", F.round("score", 6).alias("score"))


@query(f"""WITH {_ENT}, {REC}, t AS (SELECT row_id, ' ' || {_NK('description')} || ' ' AS d FROM rec WHERE description IS NOT NULL), m AS (SELECT row_id, alias FROM t JOIN ent ON length(alias) >= 2 AND contains(d, ' ' || alias || ' ')),
b AS (SELECT row_id, min({{'n': -length(alias), 'a': alias}}) AS b FROM m GROUP BY 1) SELECT row_id, b.a AS alias, round(least(1.0::DOUBLE, 0.55::DOUBLE + 0.05::DOUBLE * len(string_split(b.a, ' ')) + 0.01::DOUBLE * length(b.a)), 6) AS score FROM b""")
def entity_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest alias in each description."""
    a = entity.alias_table(table(spark, sf_dir, "manufacturers"))
    return entity.alias_in_text(records(spark, sf_dir), a).withColumn("score", F.round("score", 6))


@query()
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maker and brand of every item."""
    return entity.resolve(records(spark, sf_dir), table(spark, sf_dir, "manufacturers"), table(spark, sf_dir, "distributors"))


@query("SELECT method, count(*) AS items FROM resolutions GROUP BY 1")
def method_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How makers were decided."""
    return entity.method_counts(table(spark, sf_dir, "resolutions"))


@query("SELECT row_id, r.manufacturer_name, brand_name, owner FROM resolutions r JOIN (SELECT brand_name, min(manufacturer_name) AS owner FROM manufacturers GROUP BY 1) USING (brand_name) WHERE owner <> r.manufacturer_name AND coalesce(unmasked_from, '') = ''")
def brand_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of another maker."""
    return entity.contradictions(table(spark, sf_dir, "resolutions"), table(spark, sf_dir, "manufacturers"))


@query("""SELECT part_manuf, regexp_matches(lower(part_manuf), 'industrial supply|supply (?:co|partners)|cooperative|co-op|buying group|distribut(?:ors|ing|ion)|wholesale|warehouse|trading co|sourcing|mro|alliance|affiliated|group inc|imports|winsupply|supplyforce|netplus') OR part_manuf IN (SELECT name FROM distributors) AS distributor FROM items WHERE part_manuf IS NOT NULL GROUP BY 1""")
def distributor_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: vendor cells that name a distributor."""
    d = table(spark, sf_dir, "distributors")
    c = table(spark, sf_dir, "items").where("part_manuf is not null").select("part_manuf").distinct().join(F.broadcast(d.select(F.col("name").alias("part_manuf"), F.lit(True).alias("listed"))), "part_manuf", "left")
    return c.select("part_manuf", (entity.is_distributor(F.col("part_manuf"), d) | F.coalesce("listed", F.lit(False))).alias("distributor"))


_NAMES = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "widget"]


@query(f"WITH {CAT} SELECT row_id, CASE WHEN p_name LIKE 'red %' OR p_name LIKE 'blue %' THEN 'colour ' ELSE '' END || split_part(p_name, ' ', 2) AS leaf FROM cat WHERE split_part(p_name, ' ', 2) IN ({', '.join(map(repr, _NAMES))})")
def classify_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category with the longest keyword."""
    rows = [(i, f"P>{n}", n, [n], ["Nominal Size"]) for i, n in enumerate(_NAMES)] + [(50 + i, f"P>colour {n}", f"colour {n}", [f"red {n}", f"blue {n}"], ["Nominal Size"]) for i, n in enumerate(_NAMES)]
    tree = spark.createDataFrame(rows, "ord int, classpath string, leaf string, keywords array<string>, sequence array<string>")
    return extract.classify(_TOK(spark, sf_dir), tree).where("classified").select("row_id", "leaf")


@query()
def item_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by category."""
    items = ingest.cleaned(records(spark, sf_dir))
    return extract.classify(items, leaves(spark)).groupBy("classpath", "item_type").agg(F.count("*").alias("items"))


@query("""SELECT attr_id, coalesce(m.c, a.label) AS label FROM (SELECT DISTINCT attr_id, label FROM attributes) a LEFT JOIN (VALUES ('Material', 'Material Construction'), ('Color', 'Colour'), ('Voltage Rating', 'Voltage'), ('Current Rating', 'Amperage'), ('Length', 'Overall Length'))
 m(k, c) ON lower(m.k) = lower(a.label)""")
def label_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels moved onto a category's own words, by a map of the distinct labels."""
    own = ["Material Construction", "Colour", "Voltage", "Amperage", "Overall Length"]
    a = table(spark, sf_dir, "attributes").select("attr_id", "label").distinct()
    labels = a.select("label").distinct().select("label", extract.align_label(F.col("label"), F.array(*map(F.lit, own))).alias("aligned"))
    return a.join(small(labels), "label", "left").select("attr_id", F.coalesce("aligned", "label").alias("label"))


@query()
def item_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes folded from the descriptions of all items."""
    items = stored(ingest.cleaned(records(spark, sf_dir)).select("row_id", "description", "tokens"))
    return extract.attributes(items, extract.classify(items, leaves(spark)), table(spark, sf_dir, "units"))


_SEQ = ["Body Material", "Colour", "Voltage", "Overall Length", "Amperage"]


@query(f"""WITH RECURSIVE a AS (SELECT DISTINCT attr_id, row_id, ord, label, value, locator, uom FROM attributes),
b AS (SELECT *, CASE lower(label) WHEN 'material' THEN 'Body Material' WHEN 'color' THEN 'Colour' WHEN 'length' THEN 'Overall Length' WHEN 'voltage rating' THEN 'Voltage' WHEN 'current rating' THEN 'Amperage'
 WHEN 'colour' THEN 'Colour' WHEN 'voltage' THEN 'Voltage' WHEN 'amperage' THEN 'Amperage' WHEN 'overall length' THEN 'Overall Length' ELSE label END AS l FROM a WHERE label <> '' AND trim(value) <> ''),
c AS (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY ord, label, value, uom, attr_id) AS i, l, coalesce(locator, 'none' || attr_id) AS loc, value FROM b),
r(row_id, i, ls, locs, vals) AS (SELECT DISTINCT row_id, 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[] FROM c UNION ALL
 SELECT r.row_id, r.i + 1, CASE WHEN k THEN list_append(ls, l) ELSE ls END, CASE WHEN k THEN list_append(locs, loc) ELSE locs END, CASE WHEN k THEN list_append(vals, trim(value)) ELSE vals END
 FROM r JOIN (SELECT * FROM c) c ON c.row_id = r.row_id AND c.i = r.i + 1, LATERAL (SELECT NOT list_contains(ls, l) AND NOT list_contains(locs, loc) AS k)),
f AS (SELECT row_id, max_by(ls, i) AS ls, max_by(vals, i) AS vals FROM r GROUP BY 1)
SELECT row_id, unnest(ls) AS label, unnest(vals) AS value, (unnest(range(len(ls))))::INT AS ord FROM f""")
def attribute_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of items folded in their order: each label, aligned with a category's words, and each span once."""
    a = table(spark, sf_dir, "attributes").select("attr_id", "row_id", "ord", "label", "value", "uom", "kind", "rule", "locator").distinct()
    w = Window.partitionBy("row_id").orderBy("ord", "label", "value", "uom", "attr_id")
    seq = a.select("row_id").distinct().withColumn("sequence", F.array(*map(F.lit, _SEQ)))
    return extract.folded(a.withColumn("at", F.row_number().over(w)), seq).select("row_id", "label", "value", "ord")


# -- propagation ---------------------------------------------------------------------------------------------------

_PROP = """g AS (SELECT r.row_id, manufacturer_name, feed AS leaf FROM resolutions r JOIN (SELECT row_id, any_value(feed) AS feed FROM items GROUP BY 1) USING (row_id) WHERE manufacturer_name <> ''),
z AS (SELECT manufacturer_name, leaf, count(*) AS size FROM g GROUP BY 1, 2 HAVING count(*) > 1), st AS (SELECT DISTINCT row_id, label, trim(concat_ws(' ', value, nullif(coalesce(uom, ''), ''))) AS v, manufacturer_name, leaf, size FROM attributes JOIN g USING (row_id) JOIN z USING (manufacturer_name, leaf)
 WHERE label IN ('Material', 'Color', 'Standard', 'Country of Origin')), o AS (SELECT manufacturer_name, leaf, label, size, count(DISTINCT v) AS n_values, min(v) AS v, count(DISTINCT row_id) AS rows, count(*) AS pairs FROM st GROUP BY 1, 2, 3, 4)"""


def _propagation(spark: SparkSession, sf_dir: str) -> propagate.Propagation:
    feeds = records(spark, sf_dir).select("row_id", F.col("feed").alias("leaf"))
    groups = table(spark, sf_dir, "resolutions").select("row_id", "manufacturer_name").join(feeds, "row_id")
    return propagate.run(table(spark, sf_dir, "attributes").dropDuplicates(["attr_id"]), groups, ["Material", "Color", "Standard", "Country of Origin"])


@query(f"WITH {_PROP} SELECT g.row_id, o.label, o.v AS value FROM g JOIN o USING (manufacturer_name, leaf) WHERE n_values = 1 AND rows < size AND NOT EXISTS (SELECT 1 FROM st WHERE st.row_id = g.row_id AND st.label = o.label)")
def sibling_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values given to silent siblings."""
    return _propagation(spark, sf_dir).given.select("row_id", "label", F.trim(F.concat_ws(" ", "value", F.nullif("uom", F.lit("")))).alias("value"))


@query(f"WITH {_PROP} SELECT manufacturer_name, leaf, label, n_values, greatest(size - pairs, 0)::BIGINT AS silent FROM o WHERE n_values > 1")
def sibling_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that vary between siblings."""
    return _propagation(spark, sf_dir).blocked


# -- evidence ------------------------------------------------------------------------------------------------------

_KIND = {"purchase": "sourced", "signup": "supplier", "click": "vocab", "view": "derived", "error": "inferred"}
_CLAIM = f"""cl AS (SELECT user_id AS row_id, CASE event_id % 3 WHEN 0 THEN 'BRAND_NAME' WHEN 1 THEN 'UPC' ELSE 'ITEM_TYPE' END AS field, (floor(value)::BIGINT % 7)::VARCHAR AS value,
 CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _KIND.items())} END AS kind, CASE WHEN event_id % 4 > 0 THEN 'row:' || user_id || ':x#char[0:1]' END AS locator, round(0.5 + (event_id % 50) / 100.0, 2) AS confidence, event_id AS claim_ord FROM events),
rk AS (SELECT *, CASE kind WHEN 'sourced' THEN 4 WHEN 'supplier' THEN 3 WHEN 'vocab' THEN 2 WHEN 'derived' THEN 1 ELSE 0 END AS r FROM cl WHERE kind IN ('derived', 'vocab') OR locator IS NOT NULL),
win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id, field ORDER BY r DESC, confidence DESC, claim_ord) AS n FROM rk) WHERE n = 1)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims made of events: a kind by type, a confidence by number."""
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _KIND.items() for x in kv]), F.col("event_type"))
    field = F.when(F.col("event_id") % 3 == 0, "BRAND_NAME").when(F.col("event_id") % 3 == 1, "UPC").otherwise("ITEM_TYPE")
    return ledger.claims_of(e.select(F.col("user_id").alias("row_id"), field.alias("field"), (F.floor("value") % 7).cast("string").alias("value"), kind.alias("kind"),
                                     F.when(F.col("event_id") % 4 > 0, F.format_string("row:%d:x#char[0:1]", "user_id")).alias("locator"), F.round(0.5 + (F.col("event_id") % 50) / 100, 2).alias("confidence"), F.col("event_id").alias("claim_ord")))


@query(f"WITH {_CLAIM} SELECT row_id, field, value, kind, confidence, claim_ord FROM win")
def ledger_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winning claim of each record and field."""
    return ledger.winners(claims(spark, sf_dir)).select("row_id", "field", "value", "kind", "confidence", "claim_ord")


@query(f"WITH {_CLAIM} SELECT row_id, field, w.value AS kept, w.kind AS kept_kind, k.value AS dropped, k.kind AS dropped_kind, CASE WHEN w.kind <> k.kind THEN w.kind || ' outranks ' || k.kind ELSE 'higher confidence' END AS reason FROM rk k JOIN win w USING (row_id, field) WHERE k.claim_ord <> w.claim_ord AND k.value <> w.value")
def ledger_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that lost against another value."""
    return ledger.conflicts(claims(spark, sf_dir))


@query(f"WITH {_CLAIM} SELECT kind, count(*) AS fields FROM win GROUP BY 1")
def ledger_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields by the kind of their winner."""
    return ledger.kind_totals(claims(spark, sf_dir))


@query(f"WITH {_CLAIM} SELECT row_id, round(sum(w * confidence) / sum(w), 4) AS confidence FROM (SELECT *, CASE field WHEN 'BRAND_NAME' THEN 3.0 WHEN 'ITEM_TYPE' THEN 2.5 ELSE 0.6 END::DOUBLE AS w FROM win) GROUP BY 1")
def ledger_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted confidence of records."""
    return ledger.confidence(claims(spark, sf_dir))


@query(f"WITH {_CLAIM} SELECT kind, count(*) AS n FROM cl WHERE kind IN ('sourced', 'supplier', 'inferred') AND locator IS NULL GROUP BY 1")
def ledger_unlocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims without the locator they need."""
    return ledger.unlocated(claims(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {_CLAIM} SELECT row_id, max(CASE WHEN field = 'BRAND_NAME' THEN value END) AS \"BRAND_NAME\", max(CASE WHEN field = 'UPC' THEN value END) AS \"UPC\", max(CASE WHEN field = 'ITEM_TYPE' THEN value END) AS \"ITEM_TYPE\" FROM win GROUP BY 1")
def delivery_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: winners as columns."""
    return ledger.pivoted(claims(spark, sf_dir), ["BRAND_NAME", "UPC", "ITEM_TYPE"])


@query(f"WITH {_CLAIM}, v AS (SELECT DISTINCT user_id * 2 AS row_id, 'UPC' AS field, (user_id % 9)::VARCHAR AS value FROM events) SELECT row_id, field, value FROM v WHERE NOT EXISTS (SELECT 1 FROM rk WHERE rk.row_id = v.row_id AND rk.field = 'UPC')")
def withdrawn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells without a publishable claim."""
    v = table(spark, sf_dir, "events").select((F.col("user_id") * 2).alias("row_id"), (F.col("user_id") % 9).cast("string").alias("UPC")).distinct()
    return ledger.withdrawn(claims(spark, sf_dir), v, ["UPC"])


@query("SELECT event_id, CASE WHEN v >= 0.85 THEN 'high' WHEN v >= 0.72 THEN 'medium' WHEN v >= 0.5 THEN 'low' ELSE 'very low' END AS band FROM (SELECT event_id, (event_id % 100) / 100.0::DOUBLE AS v FROM events)")
def confidence_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F32: words for confidences."""
    return table(spark, sf_dir, "events").select("event_id", text.band((F.col("event_id") % 100) / 100).alias("band"))


# -- documents -----------------------------------------------------------------------------------------------------

_LINE = """ln AS (SELECT doc_id, i, l, CASE WHEN trim(l) IN ('Overview', 'Features', 'Applications', 'Specifications', 'Documents') THEN trim(l) END AS h FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE length(text) > 0)),
sec AS (SELECT *, CASE WHEN h IS NULL THEN coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), '') ELSE '' END AS section FROM ln)"""


@query(f"""WITH {_LINE}, p AS (SELECT doc_id, i, regexp_extract(l, '^\\s*([^:]+?)\\s*:\\s*(.*?)\\s*$', 1) AS label, regexp_extract(l, '^\\s*([^:]+?)\\s*:\\s*(.*?)\\s*$', 2) AS value FROM sec WHERE section = 'Specifications' AND regexp_matches(l, '^[^:]+:\\s*\\S'))
SELECT doc_id, label, arg_max(value, i) AS value FROM p GROUP BY 1, 2""")
def doc_specifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications of documents."""
    return docs.spec_block(table(spark, sf_dir, "documents")).select("doc_id", "label", "value")


@query(f"WITH {_LINE} SELECT doc_id, section, count(*) AS n, min(trim(substr(l, 3))) AS first FROM sec WHERE section IN ('Features', 'Applications') AND l LIKE '- %' GROUP BY 1, 2")
def doc_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and applications of documents."""
    d = table(spark, sf_dir, "documents")
    both = [docs.bullets(d, s).withColumn("section", F.lit(s)) for s in ("Features", "Applications")]
    return both[0].unionByName(both[1]).groupBy("doc_id", "section").agg(F.count("*").alias("n"), F.min("value").alias("first"))


@query("SELECT doc_id, trim(split_part(text, chr(10), 2)) AS title FROM documents WHERE trim(split_part(text, chr(10), 2)) <> ''")
def doc_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second lines."""
    return docs.title(table(spark, sf_dir, "documents"))


@query(f"WITH {_LINE} SELECT doc_id, regexp_extract(l, '^\\s*([^:]+?)\\s*:\\s*(https?://\\S+)', 1) AS label, regexp_extract(l, '^\\s*([^:]+?)\\s*:\\s*(https?://\\S+)', 2) AS url FROM sec WHERE section = 'Documents' AND regexp_matches(l, '^\\s*([^:]+?)\\s*:\\s*(https?://\\S+)')")
def doc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of documents."""
    return docs.links(table(spark, sf_dir, "documents")).select("doc_id", "label", "url")


@query()
def doc_marketing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overview paragraph of documents."""
    return docs.marketing(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, s <> '' AND contains(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', '', 'g'), s) AS named FROM (SELECT *, regexp_replace(lower(coalesce(part_number, '')), '[^a-z0-9]', '', 'g') AS s FROM documents)")
def doc_names_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name their part."""
    return docs.names_part(table(spark, sf_dir, "documents"))


_HOST = "regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"
_GATE = f"""u AS (SELECT DISTINCT url, brand AS maker, {_HOST} AS dom FROM documents), b AS (SELECT *, list_last(string_split('.' || regexp_replace(dom, '\\.[^.]*$', ''), '.')) AS base, left(regexp_replace(lower(coalesce(maker, '')), '[^a-z0-9]', '', 'g'), 6) AS mk FROM u),
ow AS (SELECT brand_name AS maker, list(DISTINCT lower(domain)) AS o FROM manufacturers GROUP BY 1), g AS (SELECT url, b.maker, dom AS domain, CASE WHEN dom = '' THEN 'unparseable URL' WHEN regexp_matches(base, 'suppl(?:y|ies)|depot|warehouse|wholesale|distribut|marketplace|shop|store|buy|deals|surplus|liquidat') THEN 'host name of a reseller'
 WHEN len([x FOR x IN coalesce(o, []) IF x = dom OR ends_with(dom, '.' || x) OR ends_with(x, '.' || dom)]) > 0 THEN 'host of the maker' WHEN mk <> '' AND contains(regexp_replace(dom, '[^a-z0-9]', '', 'g'), mk) THEN 'host carries the maker''s name' ELSE 'not established as a source' END AS reason FROM b LEFT JOIN ow USING (maker))"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "documents").select("url", F.col("brand").alias("maker")).distinct()
    owners = table(spark, sf_dir, "manufacturers").select(F.col("brand_name").alias("manufacturer_name"), "domain")
    return docs.gate(urls, owners, maker="maker")


@query(f"WITH {_GATE} SELECT url, maker, domain, CASE WHEN reason LIKE 'host % maker%' THEN 'admitted' ELSE 'rejected' END AS verdict, reason FROM g")
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which hosts are sources."""
    return _gated(spark, sf_dir)


@query(f"WITH {_GATE} SELECT domain, reason, count(*) AS decisions, min(url) AS first_url FROM g GROUP BY 1, 2")
def gate_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by host."""
    return docs.gate_summary(_gated(spark, sf_dir), "url")


@query(f"""WITH {_LINE}, sp0 AS (SELECT doc_id, i, regexp_extract(l, '^\\s*([^:]+?)\\s*:\\s*(.*?)\\s*$', 1) AS label, regexp_extract(l, '^\\s*([^:]+?)\\s*:\\s*(.*?)\\s*$', 2) AS value FROM sec WHERE section = 'Specifications' AND regexp_matches(l, '^[^:]+:\\s*\\S')),
sp AS (SELECT doc_id, label, arg_max(value, i) AS value FROM sp0 GROUP BY 1, 2), last AS (SELECT part_number, max(doc_id) AS doc_id FROM documents WHERE part_number IS NOT NULL AND part_number NOT IN ('', 'MISC-0000') GROUP BY 1),
rd AS (SELECT DISTINCT row_id, doc_id FROM items JOIN last USING (part_number)), s AS (SELECT row_id, label, value FROM rd JOIN sp USING (doc_id) WHERE label NOT IN ({', '.join(repr(x) for x in V.SPEC_COLUMNS)})),
a AS (SELECT row_id, label, min(trim(concat_ws(' ', value, nullif(coalesce(uom, ''), '')))) AS v FROM attributes WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT row_id, label, coalesce(CASE WHEN a.v IS NULL OR lower(s.value) <> lower(a.v) THEN s.value END, a.v) AS value, CASE WHEN a.v IS NULL THEN 'added' WHEN s.value IS NOT NULL AND lower(s.value) <> lower(a.v) THEN 'overruled' ELSE 'kept' END AS outcome FROM a FULL JOIN s USING (row_id, label)""")
def enrich_overrule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against what was known."""
    return _enriched(spark, sf_dir, table(spark, sf_dir, "documents"))


@query()
def enrich_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As enrich_overrule, of documents that name their part only."""
    return _enriched(spark, sf_dir, docs.integral(table(spark, sf_dir, "documents"))[0])


def _enriched(spark: SparkSession, sf_dir: str, documents: DataFrame) -> DataFrame:
    d = documents.where("part_number <> '' and part_number <> 'MISC-0000'")
    of = docs.document_of(table(spark, sf_dir, "items").select("row_id", "part_number").distinct(), d)
    specs = docs.spec_block(d).join(of, "doc_id")
    whole = F.trim(F.concat_ws(" ", "value", F.nullif(F.coalesce("uom", F.lit("")), F.lit(""))))
    a = table(spark, sf_dir, "attributes").where("value is not null").groupBy("row_id", "label").agg(F.min(whole).alias("value"), F.lit("").alias("uom"), F.lit("supplier").alias("kind"), F.lit("").alias("locator"))
    return docs.overruled(a, specs).select("row_id", "label", "value", "outcome")


@query("""WITH d AS (SELECT doc_id AS row_id, unnest([x FOR x IN regexp_extract_all(coalesce(text, ''), '\\d+(?:[.\\-/]\\d+)*')]) AS n FROM documents), t AS (SELECT doc_id AS row_id, unnest(regexp_extract_all(coalesce(part_number, ''), '\\d+(?:[.\\-/]\\d+)*')) AS n FROM documents),
z AS (SELECT row_id, CASE WHEN regexp_full_match(n, '0+') THEN '0' ELSE ltrim(n, '0') END AS number FROM d), y AS (SELECT row_id, CASE WHEN regexp_full_match(n, '0+') THEN '0' ELSE ltrim(n, '0') END AS number FROM t)
SELECT DISTINCT row_id, 'INVOICE_DESC' AS field, number FROM z WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.row_id = z.row_id AND y.number = z.number)""")
def untraced_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of documents that the part number does not hold."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.coalesce("text", F.lit("")).alias("INVOICE_DESC"), F.coalesce("part_number", F.lit("")).alias("value"))
    made = d.select("row_id", "INVOICE_DESC", *[F.lit("").alias(c) for c in verify.GENERATED[1:]])
    none = d.select("row_id", F.lit("x").alias("field"), "value").limit(0)
    return verify.untraced_numbers(made, none, d.select("row_id", "value"), none.select("row_id", "value"))


_LIMITS = {"INVOICE_DESC": 40, "MOBILE_DESC": 80, "SHORT_DESC": 120, "PRODUCT_TITLE": 150, "LONG_DESC": 1000}


@query("WITH t AS (SELECT doc_id AS row_id, coalesce(text, '') AS t FROM documents), l(field, most) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in _LIMITS.items()) + """),
x AS (SELECT row_id, field, t, CASE WHEN length(t) > most THEN 'over the limit' WHEN field = 'INVOICE_DESC' AND t <> upper(t) THEN 'not in capitals' END AS problem FROM t, l) SELECT row_id, field, length(t)::INT AS length, problem FROM x WHERE problem IS NOT NULL""")
def limit_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: whole texts of documents over the limit of each field, or not in capitals."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), *[F.coalesce("text", F.lit("")).alias(c) for c in verify.CHECKED])
    return verify.limit_failures(d)


@query()
def unit_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions with units spelt otherwise than approved."""
    i = records(spark, sf_dir).select("row_id", F.coalesce("description", F.lit("")).alias("LONG_DESC"), "part_number", *[F.lit("").alias(c) for c in verify.CHECKED if c != "LONG_DESC"])
    return verify.unit_failures(i, table(spark, sf_dir, "units"), ["part_number"]).groupBy("problem").agg(F.count("*").alias("rows"))


_J = ["event_id % 2 = 0", "event_id % 3 > 0", "event_id % 5 = 0", "event_id % 7 > 0", "event_id % 11 = 0", "event_id % 13 = 0", "event_id % 17 = 0", "event_id % 19 = 0"]


@query(f"""WITH f AS (SELECT event_id AS row_id, round((event_id % 100) / 100.0, 2)::DOUBLE AS c, {', '.join(f'{e} AS x{i}' for i, e in enumerate(_J))}, event_id % 4 AS s FROM events),
g AS (SELECT *, CASE WHEN NOT x0 THEN least(c, 0.45) ELSE c END AS a0 FROM f), h AS (SELECT *, CASE WHEN NOT x1 THEN least(a0, 0.55) ELSE a0 END AS a1 FROM g), i AS (SELECT *, CASE WHEN x2 AND s < 3 THEN least(a1, 0.7) ELSE a1 END AS a2 FROM h), j AS (SELECT *, CASE WHEN x1 AND NOT x3 THEN least(a2, 0.71) ELSE a2 END AS a3 FROM i),
k AS (SELECT *, CASE WHEN x4 THEN 0.34 ELSE a3 END AS a4 FROM j), l AS (SELECT *, CASE WHEN x5 THEN least(a4, 0.5) ELSE a4 END AS a5 FROM k), m AS (SELECT *, CASE WHEN x6 THEN least(a5, 0.6) ELSE a5 END AS a6 FROM l), n AS (SELECT *, round(CASE WHEN x7 THEN least(a6, 0.4) ELSE a6 END, 4)::DOUBLE AS conf FROM m)
SELECT row_id, conf AS confidence, CASE WHEN conf >= 0.85 THEN 'high' WHEN conf >= 0.72 THEN 'medium' WHEN conf >= 0.5 THEN 'low' ELSE 'very low' END AS band, x0 AND x1 AND NOT (x2 AND s < 3) AND x3 AND NOT x4 AND NOT x5 AND NOT x6 AND NOT x7 AND conf >= 0.72 AS publish FROM n""")
def judged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: confidence of records after what is against them."""
    names = ["resolved", "classified", "leaning", "meets_floor", "contradicted", "limit_failed", "unit_failed", "untraced"]
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.round((F.col("event_id") % 100) / 100, 2).alias("confidence"), *[F.expr(x).alias(n) for n, x in zip(names, _J, strict=True)], (F.col("event_id") % 4).alias("in_sequence"))
    return verify.judged(e).drop("reasons")


# -- search --------------------------------------------------------------------------------------------------------

_BM = """q AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9./\\-]*') AS t FROM eval_items), qt AS (SELECT query_id, term, count(*) AS times, min(pos) - 1 AS pos FROM (SELECT query_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM q) GROUP BY 1, 2),
dd AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9./\\-]*') AS t FROM documents), ln AS (SELECT doc_id, len(t) AS n FROM dd), po AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM dd) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
st AS (SELECT count(*)::DOUBLE AS nn, avg(n) AS mean FROM ln), sc AS (SELECT query_id, doc_id, sum(times * ln(1 + (nn - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))) AS score, min(pos) AS fp FROM qt JOIN df USING (term) JOIN po USING (term) JOIN ln USING (doc_id), st GROUP BY 1, 2)"""


@query(_BM.replace("q AS (SELECT item_id", "WITH q AS (SELECT item_id") + " SELECT term, df FROM df")
def bm25_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each term."""
    return search.index(table(spark, sf_dir, "documents")).terms


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = search.index(table(spark, sf_dir, "documents"))
    return search.top(search.scores(idx, search.query_terms(table(spark, sf_dir, "eval_items"), "item_id", "text")), 10)


@query("WITH " + _BM + " SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, fp, doc_id) AS rank FROM sc) WHERE rank <= 10")
def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of each query, a top ten."""
    return _hits(spark, sf_dir).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


_ASKED = "i AS (SELECT row_id, any_value(part_number) AS part_number, any_value(description) AS text FROM items WHERE row_id % 50 = 0 AND part_number <> 'MISC-0000' AND trim(description) <> '' GROUP BY 1)"


@query(f"WITH {_ASKED}, " + _BM.replace("q AS (SELECT item_id AS query_id", "q AS (SELECT row_id AS query_id", 1).replace("FROM eval_items)", "FROM i)", 1) + """, hit AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, fp, doc_id) AS rank FROM sc) WHERE rank <= 10),
rel AS (SELECT row_id AS query_id, doc_id FROM i JOIN documents USING (part_number)), per AS (SELECT query_id, n, (SELECT count(*) FROM hit JOIN rel r USING (query_id, doc_id) WHERE query_id = z.query_id) AS found,
 (SELECT min(rank) FROM hit JOIN rel r USING (query_id, doc_id) WHERE query_id = z.query_id) AS best, (SELECT count(*) FROM hit WHERE query_id = z.query_id) AS hits FROM (SELECT query_id, count(*) AS n FROM rel GROUP BY 1) z)
SELECT count(*) AS n_queries, round(avg(found / least(n, 10)), 4) AS recall, round(avg(coalesce(1 / best, 0)), 4) AS mrr, round(avg((hits = 0)::INT::DOUBLE), 4) AS zero_share FROM per""")
def ir_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, reciprocal rank and empty results of descriptions as queries against the documents of their parts.

    The queries are the items whose id is divisible by 50, searched in all documents.
    """
    asked = records(spark, sf_dir).where("row_id % 50 = 0 and part_number <> 'MISC-0000' and trim(description) <> ''").select(F.col("row_id").alias("query_id"), "part_number", F.col("description").alias("text"))
    d = table(spark, sf_dir, "documents")
    hits = search.top(search.scores(search.index(d), search.query_terms(asked, "query_id", "text")), 10)
    return search.quality(hits, asked.join(d.select("doc_id", "part_number"), "part_number").select("query_id", "doc_id"), asked.select("query_id"))


@query(f"""WITH {REC}, s(leaf, term) AS (VALUES ('harbor_edi', 'ball valve'), ('harbor_edi', 'shutoff valve'), ('kestrel_csv', 'pop rivet'), ('kestrel_csv', 'blind rivet'), ('oldmill_xls', 'furnace filter')), w AS (SELECT leaf, term, unnest([x FOR x IN string_split(term, ' ') IF length(x) > 2]) AS w FROM s),
m AS (SELECT leaf, term, w, max(contains(lower(coalesce(description, '')), w)::INT) AS seen FROM rec JOIN w ON feed = leaf GROUP BY 1, 2, 3) SELECT leaf, term FROM m GROUP BY 1, 2 HAVING min(seen) = 0""")
def gap_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: trade words that a feed never writes."""
    s = [("harbor_edi", "ball valve"), ("harbor_edi", "shutoff valve"), ("kestrel_csv", "pop rivet"), ("kestrel_csv", "blind rivet"), ("oldmill_xls", "furnace filter")]
    items = records(spark, sf_dir).select("row_id", F.col("feed").alias("leaf"), F.coalesce("description", F.lit("")).alias("text"))
    return search.gap_queries(items, spark.createDataFrame(s, "leaf string, term string"))


@query("SELECT row_id, trim(regexp_replace(regexp_replace(' ' || regexp_replace(d, ' +', '  ', 'g') || ' ', ' [a-zA-Z]+[0-9]+ ', ' ', 'g'), '\\s+', ' ', 'g')) AS q FROM (SELECT row_id, 'order ' || p || ' now' AS d FROM (SELECT DISTINCT row_id, 'AB' || lpad(row_id::VARCHAR, 6, '0') AS p FROM items))")
def without_part_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """queries without part numbers."""
    i = table(spark, sf_dir, "items").select("row_id").distinct()
    q = F.concat(F.lit("order AB"), F.lpad(F.col("row_id").cast("string"), 6, "0"), F.lit(" now"))
    return i.select("row_id", text.without_part_numbers(q).alias("q"))


# -- reports and decisions -----------------------------------------------------------------------------------------


@query(f"WITH {REC} SELECT row_id, part_number, description FROM rec WHERE contains(lower(coalesce(description, '')), 'valve') ORDER BY row_id LIMIT 25 OFFSET 25")
def records_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of matching records."""
    hit = records(spark, sf_dir).where(F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit("valve")))
    return hit.select("row_id", "part_number", "description").orderBy("row_id").offset(25).limit(25)


@query("SELECT coalesce(nullif(trim(manufacturer_name), ''), '(empty)') AS key, count(*) AS records, min(row_id) AS first FROM resolutions WHERE method = 'override' OR manufacturer_name = '' GROUP BY 1")
def review_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that one decision would settle, by what has to be decided."""
    r = table(spark, sf_dir, "resolutions").where("method = 'override' or manufacturer_name = ''")
    return r.groupBy(F.coalesce(F.nullif(F.trim("manufacturer_name"), F.lit("")), F.lit("(empty)")).alias("key")).agg(F.count("*").alias("records"), F.min("row_id").alias("first"))


@query("SELECT 'manufacturer_map' AS kind, user_id::VARCHAR AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY 2")
def decisions_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest decision of each key."""
    e = table(spark, sf_dir, "events")
    log = e.select(F.lit("manufacturer_map").alias("kind"), F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("at"))
    return files.decided(log)


@query("SELECT DISTINCT ON (alias) measurement_type, canonical, alias, 'seed' AS provenance FROM (SELECT *, lower(trim(a)) AS alias FROM (SELECT measurement_type, canonical, unnest([canonical, canonical || 's'] || coalesce(aliases, [])) AS a FROM units)) WHERE alias <> '' ORDER BY alias, measurement_type, canonical")
def unit_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of units, the first of each."""
    return files.unit_layers(None, table(spark, sf_dir, "units"))


@query("SELECT row_id, string_agg(label, '|' ORDER BY pos, label) AS labels FROM (SELECT row_id, label, min(ord) AS pos FROM attributes GROUP BY 1, 2) GROUP BY 1")
def label_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each item in order of first appearance."""
    s = files.ordered_labels(table(spark, sf_dir, "attributes"), "row_id", "label", "ord")
    return s.select("row_id", F.array_join("sequence", "|").alias("labels"))


@query("""SELECT text, value FROM (SELECT trim(value) AS text, n / d AS value, row_number() OVER (PARTITION BY n / d ORDER BY attr_id) AS k FROM (SELECT *, try_cast(regexp_extract(value, '^\\s*(\\d+)\\s*/\\s*(\\d+)\\s*$', 1) AS INT) AS n, try_cast(regexp_extract(value, '^\\s*(\\d+)\\s*/\\s*(\\d+)\\s*$', 2) AS INT) AS d
 FROM (SELECT DISTINCT attr_id, value FROM attributes) WHERE regexp_full_match(value, '\\s*\\d+\\s*/\\s*\\d+\\s*')) WHERE n > 0 AND n < d) WHERE k = 1""")
def fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions found in a column, each value once."""
    a = table(spark, sf_dir, "attributes").select(F.col("attr_id").alias("pos"), F.col("value").alias("cell")).distinct()
    return files.fraction_table(a)


@query()
def compile_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: the delivery of the whole compile over all items and documents."""
    return compiled(spark, sf_dir).delivery


@query()
def compile_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and self checks of the whole compile, one row each."""
    run = compiled(spark, sf_dir)
    wide, of = run.delivery, F.col
    cells = sum(((of(c) != "").cast("long") for c in V.DELIVERY), F.lit(0))
    figures = wide.agg(
        F.count("*").alias("records"), F.sum(cells).alias("populated_cells"), F.sum((of("RECORD_STATUS") == "publish").cast("long")).alias("published"),
        F.sum((of("SKU") == "").cast("long")).alias("without_key"), F.max(F.length("INVOICE_DESC")).alias("longest_invoice"), F.max(F.length("MOBILE_DESC")).alias("longest_mobile"),
    )
    parts = figures.unpivot([], figures.columns, "figure", "value")
    more = [(run.families.families, "families"), (run.propagation.given, "values_propagated"), (ledger.unlocated(run.claims), "unlocated_claims"), (ledger.conflicts(run.claims), "conflicts"), (run.attributes, "attributes")]
    for df, name in more:
        parts = parts.unionByName(df.agg(F.count("*").alias("value")).select(F.lit(name).alias("figure"), "value"))
    return parts


def compiled(spark: SparkSession, sf_dir: str):
    """The whole compile over the test tables."""
    read = lambda t: table(spark, sf_dir, t)
    documents = read("documents").where("part_number <> 'MISC-0000' and text is not null")
    return compile_catalogue(read("items"), documents, vocabulary(spark, read))
