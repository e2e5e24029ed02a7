"""Queries of the operators in this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomcat.llm import leakage, names, pairs, subjects, terms, tokens, truncation
from loomcat.session import table


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term, uses, records and mark of every term of items.words."""
    return terms.marked_terms(table(spark, sf_dir, "items"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms too rare or too common to describe a product."""
    return p2_terms(spark, sf_dir).where("mark is not null").select("term", "mark")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose description lost its end."""
    return truncation.cut_records(table(spark, sf_dir, "items")).select("row_id")


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each feed cuts descriptions."""
    return truncation.cut_shares(table(spark, sf_dir, "items"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "items")
    kinds = {"part_manuf": "manuf", "unilog_brand": "brand", "dib_brand": "brand"}
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for c, k in kinds.items())))
    return items.select(cells.alias("c")).select("c.kind", "c.name")


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    makers, distributors = table(spark, sf_dir, "manufacturers"), table(spark, sf_dir, "distributors")
    manuf = makers.select("manufacturer_name").union(distributors.select("name")).toDF("name").withColumn("kind", F.lit("manuf"))
    return manuf.unionByName(makers.select(F.lit("brand").alias("kind"), F.col("brand_name").alias("name")))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with the organisation or brand it stands for."""
    return names.linked_names(_names(spark, sf_dir), _known(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of one organisation or brand."""
    return names.variant_pairs(_names(spark, sf_dir), _known(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entered names with the code of the manufacturer or brand they mean."""
    items, decided, makers = (table(spark, sf_dir, t) for t in ("items", "resolutions", "manufacturers"))
    fields = [(items, "part_manuf", "manuf"), (items, "e1_brand", "brand"), (decided, "manufacturer_name", "manuf")]
    cells = [t.select(F.lit(f).alias("field_name"), F.lit(k).alias("kind"), F.col(f).alias("name")) for t, f, k in fields]
    entered = cells[0].unionByName(cells[1]).unionByName(cells[2])
    maker = makers.select(F.lit("manuf").alias("kind"), F.col("manufacturer_name").alias("name"), F.col("manufacturer_code").alias("code"))
    brand = makers.select(F.lit("brand").alias("kind"), F.col("brand_name").alias("name"), F.col("brand_code").alias("code"))
    return names.canonical_codes(entered, maker.unionByName(brand).distinct())


def _pair_table(spark: SparkSession, sf_dir: str) -> pairs.PairTable:
    """The items as they came: nine tenths by their time of receipt first, then the later deliveries as changes.

    Records sent again are changes of the baskets already held, so both signs occur. Rows without a time come first.
    """
    items = table(spark, sf_dir, "items").select("row_id", "words", "received_at")
    late = items.agg(F.percentile_approx(F.unix_micros(F.col("received_at").cast("timestamp")), 0.9)).first()[0]
    at = F.unix_micros(F.col("received_at").cast("timestamp"))
    is_late = F.coalesce(at > F.lit(late), F.lit(False)) if late is not None else F.lit(False)
    kept = pairs.PairTable(spark)
    kept.apply(pairs.baskets(items.where(~is_late)))
    kept.apply(pairs.baskets(items.where(is_late)))
    return kept


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and lift of every pair of terms that some record holds."""
    return pairs.all_pairs(pairs.baskets(table(spark, sf_dir, "items")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of terms met far more often than chance."""
    return pairs.associated(_pair_table(spark, sf_dir)).select("term_a", "term_b")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document."""
    return tokens.encoded(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold evaluation items."""
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items with the number of documents that hold them, and the largest share covered."""
    found = leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.max("covered"), 6).alias("covered"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of every document."""
    return subjects.document_subjects(*(table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subjects")))


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by subject."""
    return p9_found(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("documents"))


QUERIES = {f.__name__: f for f in (p2_terms, p2_found, p3_found, p3_shares, p4_classes, p4_found, p6_found, p5_pairs, p5_found, p7_ids, p8_found, p8_items, p9_found, p9_composition)}

# Of compatibility forms the words have full-width ones only; these are the printable ASCII characters, 65,248 places on.
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)), "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
_TERM = f"lower(trim(translate(nfc_normalize(w), '{_WIDE[0]}', '{_WIDE[1]}')))"
_HELD = f"""rec AS (SELECT row_id, any_value(words) AS words FROM items WHERE row_id IS NOT NULL GROUP BY 1), n AS (SELECT count(*) AS n FROM rec),
use AS (SELECT row_id, {_TERM} AS term FROM (SELECT row_id, unnest(words) AS w FROM rec) WHERE w IS NOT NULL), hold AS (SELECT row_id, term, count(*) AS k FROM use WHERE term <> '' GROUP BY 1, 2),
t AS (SELECT term, sum(k)::BIGINT AS uses, count(*) AS records FROM hold GROUP BY 1)"""
_MARK = "CASE WHEN records <= 2 THEN 'rare' WHEN records * 5 > n THEN 'common' END AS mark"
_PAIRS = f"""{_HELD}, ab AS (SELECT a.term AS term_a, b.term AS term_b, count(*) AS n_ab FROM hold a JOIN hold b ON a.row_id = b.row_id AND a.term < b.term GROUP BY 1, 2),
p AS (SELECT term_a, term_b, n_ab, a.records AS n_a, b.records AS n_b, n FROM ab JOIN t a ON a.term = term_a JOIN t b ON b.term = term_b, n)"""
ORACLES: dict[str, str] = {
    "p2_terms": f"WITH {_HELD} SELECT term, uses, records, {_MARK} FROM t, n",
    "p2_found": f"WITH {_HELD} SELECT term, mark FROM (SELECT term, {_MARK} FROM t, n) WHERE mark IS NOT NULL",
    "p5_pairs": f"WITH {_PAIRS} SELECT term_a, term_b, n_ab, n_a, n_b, n_ab * n::DOUBLE / n_a / n_b AS lift FROM p",
    "p5_found": f"WITH {_PAIRS} SELECT term_a, term_b FROM p WHERE n_ab >= 3 AND n_ab * 1000 >= n AND n_ab * n >= 10 * n_a * n_b",
}
