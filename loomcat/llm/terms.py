"""Terms of records: one normal form, and how often each occurs in the whole collection."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

COUNTERS = "term string, uses long, records long"
#: Terms held in one task before its counters are handed on; a bound on memory, counts stay exact.
TERMS_IN_MEMORY = 400_000


def normal_term(raw: str | None) -> str:
    """NFKC, without surrounding white space, lower case; null and blank give the empty string."""
    return unicodedata.normalize("NFKC", raw).strip().lower() if raw else ""


class TermReader:
    """normal_term with a bounded memo, as feeds repeat few forms very often."""

    def __init__(self, room: int = TERMS_IN_MEMORY):
        self.memo: dict[str | None, str] = {}
        self.room = room

    def __call__(self, raw: str | None) -> str:
        term = self.memo.get(raw)
        if term is None:
            if len(self.memo) >= self.room:
                self.memo.clear()
            term = self.memo[raw] = normal_term(raw)
        return term


def _emit(counters: dict[str, list[int]], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(counters), pa.string()),
            pa.array([c[0] for c in counters.values()], pa.int64()),
            pa.array([c[1] for c in counters.values()], pa.int64()),
        ],
        schema=schema,
    )


def _last_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters over rows ordered by record: uses, records and the record met last, for each term."""
    schema = pa.schema([("term", pa.string()), ("uses", pa.int64()), ("records", pa.int64())])
    counters: dict[str, list[int]] = {}
    read, before = TermReader(), object()
    for batch in batches:
        for record, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if record == before:  # the record was sent again
                continue
            before = record
            for raw in words:
                term = read(raw)
                if not term:
                    continue
                c = counters.get(term)
                if c is None:
                    counters[term] = [1, 1, record]
                else:
                    c[0] += 1
                    if c[2] != record:
                        c[1] += 1
                        c[2] = record
            if len(counters) >= TERMS_IN_MEMORY:
                yield _emit(counters, schema)
                counters.clear()
    yield _emit(counters, schema)


def term_counts(records: DataFrame, key: str = "row_id", words: str = "words") -> DataFrame:
    """term, uses, records for every distinct term of a collection.

    Records are hash-partitioned by their key and ordered by it, so that each partition counts with last-seen
    counters: a term stores its uses, its records and the last record it was seen in, never a set of records, and a
    record sent again is skipped as it follows its first copy. The counters of a partition, not its tokens, are then
    shuffled; a term held by a third of all records is one row per partition there.

    Null word lists, null words and words that are blank after normalisation count for nothing; a null key is no record.
    """
    ordered = (
        records.select(F.col(key).cast("long").alias("record"), F.col(words).alias("words"))
        .where("record is not null and size(words) > 0")
        .repartition("record")
        .sortWithinPartitions("record")
    )
    return ordered.mapInArrow(_last_seen, COUNTERS).groupBy("term").agg(F.sum("uses").alias("uses"), F.sum("records").alias("records"))


def marked_terms(records: DataFrame, key: str = "row_id", words: str = "words", rare: int = 2, common_share: int = 5) -> DataFrame:
    """term, uses, records, mark: `rare` up to `rare` records, `common` above N / common_share, else null.

    N is the number of distinct keys, records without words included. In a collection so small that both hold, a term
    has a row for either mark. An empty table gives no rows.
    """
    n = records.select(key).where(F.col(key).isNotNull()).distinct().count()
    marks = F.array(F.when(F.col("records") <= rare, "rare"), F.when(F.col("records") * common_share > n, "common"))
    kept = F.filter(marks, lambda m: m.isNotNull())
    return term_counts(records, key, words).withColumn("mark", F.explode_outer(kept))
