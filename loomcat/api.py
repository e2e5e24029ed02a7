"""Questions to a finished compile. Every method returns a DataFrame; nothing is gathered."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomcat import vocabulary as V
from loomcat.functions import text
from loomcat.operators import documents as docs, ledger, review, search
from loomcat.plans.compile import Compiled, compile_catalogue
from loomcat.sources import catalogue as files, sinks

UPLOAD_BYTES = 25 * 1024 * 1024


class Engine:
    """A run with its documents and vocabularies."""

    def __init__(self, spark: SparkSession, run: Compiled, documents: DataFrame, vocab: V.Vocabulary):
        self.spark, self.run, self.docs, self.vocab = spark, run, documents, vocab
        self._index: dict[str, search.Index] = {}

    def schema(self) -> DataFrame:
        """ord, column, source_required, limit of the delivery."""
        rows = [(i, c, c in V.SOURCE_REQUIRED, V.LIMITS.get(c)) for i, c in enumerate(V.DELIVERY)]
        return self.spark.createDataFrame(rows, "ord int, column string, source_required boolean, limit int")

    def health(self) -> DataFrame:
        """One row: whether a run stands, its records and documents."""
        return self.run.delivery.agg(F.lit(True).alias("ready"), F.count("*").alias("records")).crossJoin(self.docs.agg(F.count("*").alias("documents")))

    def status(self) -> DataFrame:
        """check, pass, detail of the run's self checks."""
        return self.run.checks

    def vocabulary(self) -> DataFrame:
        """name, provenance, entries of the vocabularies."""
        tables = {"units": self.vocab.units, "manufacturers": self.vocab.manufacturers, "distributors": self.vocab.distributors, "leaves": self.vocab.leaves, "synonyms": self.vocab.synonyms}
        rows = [(name, self.vocab.provenance.get(name, "supplied"), df.count()) for name, df in sorted(tables.items())]
        return self.spark.createDataFrame(rows, "name string, provenance string, entries long")

    def records(self, words: str = "", status: str | None = None) -> DataFrame:
        """Records whose part number, names or descriptions hold some words, by status; in order of row_id."""
        cells = ["MFG_PART_NUM", "MANUFACTURER_NAME", "BRAND_NAME", "PRODUCT_TITLE", "ITEM_TYPE", "CLASSPATH"]
        rows = self.run.delivery.select("row_id", "SKU", *cells, "RECORD_STATUS", "CONFIDENCE_SCORE")
        if words:
            rows = rows.where(F.contains(F.lower(F.concat_ws(" ", *cells)), F.lit(words.lower())))
        return (rows if status is None else rows.where(F.col("RECORD_STATUS") == status)).orderBy("row_id")

    def page(self, rows: DataFrame, number: int, size: int = 50) -> DataFrame:
        """One page of ordered rows, from 1 on."""
        return rows.offset((number - 1) * size).limit(size)

    def status_counts(self) -> DataFrame:
        """Records by status."""
        return self.run.delivery.groupBy("RECORD_STATUS").agg(F.count("*").alias("records"))

    def record(self, row_id: int) -> DataFrame:
        """ord, column, value, source_required of one record's delivery."""
        one = self.run.delivery.where(F.col("row_id") == row_id).select(F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column"), F.col(c).alias("value"), F.lit(c in V.SOURCE_REQUIRED).alias("source_required")) for i, c in enumerate(V.DELIVERY)])).alias("c"))
        return one.select("c.*")

    def evidence(self, row_id: int) -> DataFrame:
        """All claims about one record, the winner of each field first."""
        won = ledger.winners(self.run.claims).select("row_id", "field", F.col("claim_ord").alias("won"))
        mine = self.run.claims.where(F.col("row_id") == row_id).join(won, ["row_id", "field"], "left")
        return mine.withColumn("winner", F.col("claim_ord") == F.col("won")).drop("won").orderBy("field", F.desc("winner"))

    def conflicts(self) -> DataFrame:
        """Claims that lost against another value."""
        return ledger.conflicts(self.run.claims)

    def locate(self, locator: str, around: int = 260) -> DataFrame:
        """quote, context of a locator, from the item's clean cell or the document."""
        at = self.spark.createDataFrame([(locator,)], "l string").select(text.parse_locator(F.col("l")).alias("p")).first()["p"]
        if at is None:
            return self.spark.createDataFrame([], "quote string, context string")
        if at["kind"] == "doc":
            source = self.docs.where(F.col("doc_id").cast("string") == at["ref"]).select(F.col("text").alias("t"))
        else:
            row, _, field = at["ref"].partition(":")
            source = self.run.items.where(F.col("row_id") == int(row)).select(F.col(field if field in self.run.items.columns else "description").alias("t"))
        start, n = at["start"], at["end"] - at["start"]
        low = max(0, start - around)
        return source.select(F.substring("t", start + 1, n).alias("quote"), F.substring("t", low + 1, start - low + n + around).alias("context"))

    def document(self, doc_id) -> DataFrame:
        """label, value of a document's specifications."""
        return docs.spec_block(self.docs.where(F.col("doc_id") == doc_id)).select("label", "value")

    def document_text(self, doc_id) -> DataFrame:
        """The document's row, its whole text included."""
        return self.docs.where(F.col("doc_id") == doc_id)

    def document_facts(self, doc_id) -> DataFrame:
        """field, value, start, end of everything a document states: features, applications, prose, links."""
        return docs.facts(self.document_text(doc_id).select("doc_id", "text", "domain")).select("field", "value", "start", "end")

    def discovery(self) -> DataFrame:
        """kind, n: families, axes, induced attributes, and how many wait for a name."""
        found = self.run.induction.attributes
        parts = [("families", self.run.families.families), ("axes", self.run.axis_names), ("axes without a name", self.run.axis_names.where("label is null")), ("induced attributes", found), ("attributes without a name", found.where("label is null"))]
        return self.spark.createDataFrame([(k, df.count()) for k, df in parts], "kind string, n long")

    def actions(self) -> DataFrame:
        """The questions of the review queue in their order."""
        return self.run.queue.actions.orderBy("action_id")

    def decide(self, log: str, kind: str, key: str, value: str, at: str, actor: str = "reviewer") -> DataFrame:
        """Add a decision to the log in a folder; gives what is then in force. `recompiled` applies it."""
        sinks.append_decisions(review.decision(self.spark, kind, key, value, at, actor), log)
        return files.decided(self.spark.read.schema(files.DECISION).json(log))

    def reset_decisions(self, log: str, at: str) -> DataFrame:
        """Take all decisions back; the log keeps them."""
        return self.decide(log, "clear", "", "", at)

    def recompiled(self, catalogue: DataFrame, live: DataFrame, compiled_at: str = "1970-01-01T00:00:00Z") -> Engine:
        """A run over a catalogue with the decisions in force (kind, key, value), of all four kinds; also for an uploaded file."""
        of = lambda kind, key, value: live.where(F.col("kind") == kind).select(F.col("key").alias(key), F.col("value").alias(value))
        run = compile_catalogue(catalogue, self.docs, self.vocab, compiled_at, of("manufacturer_map", "part_manuf", "manufacturer_name"), of("item_type_map", "item_type", "classpath"), of("attribute_names", "key", "label"), live)
        return Engine(self.spark, run, self.docs, self.vocab)

    def uploaded(self, path: str, live: DataFrame) -> Engine:
        """A run over a file of UPLOAD_BYTES at most, a workbook or csv; the present run stays as it is, to go back to."""
        if not path.lower().endswith((".xlsx", ".xls", ".csv")):
            raise ValueError("not a workbook or csv file")
        if Path(path).stat().st_size > UPLOAD_BYTES:
            raise ValueError(f"more than {UPLOAD_BYTES} bytes; read the catalogue as a table")
        return self.recompiled(files.read_catalogue(self.spark, path), live)

    def download(self, path: str) -> int:
        """The delivery as one csv file or workbook, by the path's ending; gives the number of rows."""
        rows = self.run.delivery.select(*V.DELIVERY)
        return sinks.write_workbook(rows, path) if path.lower().endswith(".xlsx") else sinks.write_csv_file(rows, path)

    def artefacts(self, folder: str, records: int = 120) -> None:
        """The run's reports as JSON: checks, evidence of the first records, questions, discovery, abstentions by reason."""
        first = self.run.items.select("row_id").orderBy("row_id").limit(records)
        parts = {"metrics": self.status(), "evidence": self.run.claims.join(first, "row_id", "left_semi"), "review_queue": self.run.queue.actions, "discovery": self.discovery(), "abstentions": review.by_reason(self.run.abstentions)}
        for name, df in parts.items():
            sinks.write_json(df, f"{folder}/{name}")

    def gate_test(self, url: str, maker: str = "") -> DataFrame:
        """verdict, reason for one URL."""
        one = self.spark.createDataFrame([(url, maker)], "url string, manufacturer_name string")
        return docs.gate(one, self.vocab.manufacturers).select("verdict", "reason")

    def sourcing(self) -> DataFrame:
        """Decisions on the documents' URLs by host."""
        urls = self.docs.select("url", F.col("brand").alias("manufacturer_name")).distinct()
        owners = self.vocab.manufacturers.select(F.col("brand_name").alias("manufacturer_name"), "domain")
        return docs.gate_summary(docs.gate(urls, owners), "url").orderBy(F.desc("decisions"), "domain")

    def families(self, most: int = 120) -> DataFrame:
        """The largest families, a report."""
        return self.run.families.families.orderBy(F.desc("size"), "key").limit(most)

    def family(self, family_id: str) -> DataFrame:
        """row_id, description of a family's members."""
        return self.run.families.members.where(F.col("family_id") == family_id).join(self.run.items.select("row_id", "description"), "row_id").orderBy("row_id")

    def contradictions(self) -> DataFrame:
        """Records whose brand belongs to another maker."""
        return self.run.contradictions

    def review(self) -> DataFrame:
        """reason, records: how many records each reason holds back."""
        return self.run.judged.select(F.explode(F.split("reasons", "; ")).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("records")).orderBy(F.desc("records"))

    def search(self, query: str, k: int = 10) -> DataFrame:
        """side, rank, row_id, score: the best records of a query before and after the compile. Indexes are made once."""
        if not self._index:
            i, c = self.run.items, self.run.composed
            e = lambda x: F.coalesce(F.col(x), F.lit(""))
            before = i.select("row_id", text.without_part_numbers(search.weighted([(F.col("description"), 3), (F.concat_ws(" ", "e1_brand", "unilog_brand", "dib_brand", "part_manuf"), 2)])).alias("t"))
            after = c.select("row_id", text.without_part_numbers(search.weighted([(e("PRODUCT_TITLE"), 3), (e("item_type"), 3), (F.concat_ws(" ", e("manufacturer_name"), e("brand_name")), 2), (e("SEARCH_KEYWORDS"), 1), (e("LONG_DESC"), 1)])).alias("t"))
            self._index = {"before": search.index(before, "row_id", "t"), "after": search.index(after, "row_id", "t")}
        asked = self.spark.createDataFrame([(1, query)], "query_id int, query string").select("query_id", text.without_part_numbers(F.col("query")).alias("query"))
        terms = search.query_terms(asked)
        sides = [search.top(search.scores(x, terms), k).select(F.lit(side).alias("side"), "rank", F.col("doc_id").alias("row_id"), "score") for side, x in self._index.items()]
        return sides[0].unionByName(sides[1])
