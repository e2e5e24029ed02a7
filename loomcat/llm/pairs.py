"""Items that appear together: a persistent pair table kept up to date by signed deltas."""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomcat.llm.terms import TermReader
from loomcat.session import checkpoint_dir, settled, small, stored

BASKET = "record long, terms array<string>, sign int"
#: Pairs counted in one task before they are handed on; a bound on memory, counts stay exact.
PAIRS_IN_MEMORY = 2_000_000


def _baskets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = TermReader()
    for batch in batches:
        terms = [sorted({t for w in ws or () if (t := read(w))}) for ws in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string()))], names=["record", "terms"])


def baskets(records: DataFrame, key: str = "row_id", words: str = "words") -> DataFrame:
    """record, terms: the distinct normal terms of each record, sorted; a record sent twice is one basket."""
    once = records.select(F.col(key).cast("long").alias("record"), F.col(words).alias("words")).where("record is not null")
    return once.dropDuplicates(["record"]).mapInArrow(_baskets, "record long, terms array<string>")


def _pair_counter(known: list[str] | None):
    """Pairs of known terms of signed baskets, summed per task; terms become numbers, pairs one number each.

    Without a list all terms count, and each task numbers those it meets between two hand-overs.
    """
    schema = pa.schema([("term_a", pa.string()), ("term_b", pa.string()), ("n", pa.int64())])

    width = 1 << 31 if known is None else len(known)

    def emit(keys: list[np.ndarray], signs: list[np.ndarray], words: list[str]) -> pa.RecordBatch:
        pairs, where = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(where, weights=np.concatenate(signs), minlength=len(pairs)).astype(np.int64)
        pairs, n = pairs[n != 0], n[n != 0]
        names = pa.array(words, pa.string())
        a, b = pa.array(pairs // width), pa.array(pairs % width)
        return pa.RecordBatch.from_arrays([names.take(a), names.take(b), pa.array(n)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(known or ())}
        keys, signs, held = [], [], 0
        for batch in batches:
            by_size: dict[int, tuple[list, list]] = {}
            for terms, sign in zip(batch.column("terms").to_pylist(), batch.column("sign").to_pylist(), strict=True):
                ids = [number.setdefault(t, len(number)) for t in terms] if known is None else [i for t in terms if (i := number.get(t)) is not None]
                if len(ids) > 1:
                    rows, s = by_size.setdefault(len(ids), ([], []))
                    rows.append(ids)
                    s.append(sign)
            for k, (rows, s) in by_size.items():
                m, (i, j) = np.array(rows, dtype=np.int64), np.triu_indices(k, 1)
                step = max(1, PAIRS_IN_MEMORY // len(i))
                for at in range(0, len(m), step):
                    part = m[at : at + step]
                    keys.append((part[:, i] * width + part[:, j]).ravel())
                    signs.append(np.repeat(np.array(s[at : at + step], dtype=np.float64), len(i)))
                    held += len(keys[-1])
                    if held >= PAIRS_IN_MEMORY:
                        yield emit(keys, signs, list(number))
                        keys, signs, held = [], [], 0
            if known is None and held == 0:
                number = {}
        if held:
            yield emit(keys, signs, list(number))

    return run


class PairTable:
    """Baskets, marginals and pair counts in a shared folder, hash-bucketed; a change rewrites the buckets it touches.

    `apply` takes changed baskets, reads the old form of just these, and turns old and new form into signed deltas of
    marginals and pairs, which are merged into the persistent counts. Pairs are kept for the terms that reach the least
    support any later question may ask for (`least` records and one in `per` of all); a term that reaches it for the
    first time has its pairs filled in from the stored baskets, and one that falls to half of it is dropped, so the
    counts of all kept pairs are exact. There are at most 2 * `per` times the mean basket size of kept terms, whatever
    the number of records, which bounds what is broadcast and the pair table.

    A bucket is a folder of one version; a manifest, written last, names the version of every bucket, so a lost job
    changes nothing and a table is opened again where it was left. Old versions go once the next manifest stands.
    """

    TABLES = {"baskets": "record long, terms array<string>", "terms": "term string, n long", "pairs": "term_a string, term_b string, n long"}
    KEYS = {"baskets": ["record"], "terms": ["term"], "pairs": ["term_a", "term_b"]}

    def __init__(self, spark: SparkSession, path: str | None = None, least: int = 3, per: int = 1000, rows_per_bucket: int = 250_000):
        self.spark = spark
        self.path = path or f"{checkpoint_dir(spark)}/pairs-{uuid.uuid4().hex}"
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.state = self._opened() or {
            "version": -1, "n": 0, "least": least, "per": per, "rows_per_bucket": rows_per_bucket, "buckets": 0, "at": {t: {} for t in self.TABLES},
        }

    n = property(lambda self: self.state["n"])
    least = property(lambda self: self.state["least"])
    per = property(lambda self: self.state["per"])

    # -- the folder --

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._p(folder))] if self._fs.exists(self._p(folder)) else []

    def _opened(self) -> dict | None:
        """The state of the last manifest."""
        names = sorted(n for n in self._names("manifests") if n.endswith(".json"))
        if not names:
            return None
        text = self.spark.read.text(f"{self.path}/manifests/{names[-1]}", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, state: dict) -> None:
        """The manifest of a state, put in place by one rename; then folders that it no longer names are removed."""
        name = f"manifests/{state['version']:08d}.json"
        out = self._fs.create(self._p(f"{name}.part"), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self._fs.rename(self._p(f"{name}.part"), self._p(name))
        self.state = state
        for table, at in state["at"].items():
            used = {(v, int(b)) for b, v in at.items()}
            for folder in self._names(table):
                live = {b for v, b in used if f"v{v}" == folder}
                if not live:
                    self._fs.delete(self._p(f"{table}/{folder}"), True)
                for bucket in self._names(f"{table}/{folder}") if live else []:
                    if bucket.startswith("bucket=") and int(bucket[7:]) not in live:
                        self._fs.delete(self._p(f"{table}/{folder}/{bucket}"), True)

    def read(self, name: str, buckets: list[int] | None = None, state: dict | None = None) -> DataFrame:
        """The present version of `baskets`, `terms` or `pairs`, or some of its buckets."""
        at = (state or self.state)["at"][name]
        paths = [f"{self.path}/{name}/v{v}/bucket={b}" for b, v in at.items() if buckets is None or int(b) in buckets]
        reader = self.spark.read.schema(self.TABLES[name])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.TABLES[name])

    def _bucket(self, name: str, n: int):
        return F.pmod(F.xxhash64(*self.KEYS[name]), F.lit(n)).cast("int")

    def _write(self, df: DataFrame, name: str, state: dict, touched: list[int]) -> None:
        """Some buckets, as a new version; a bucket without rows has no folder."""
        bucket = self._bucket(name, state["buckets"])
        folder = f"{name}/v{state['version']}"
        rows = df.withColumn("bucket", bucket).repartition(max(1, min(len(touched), state["buckets"])), "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        held = {int(b[7:]) for b in self._names(folder) if b.startswith("bucket=")}
        for b in touched:
            state["at"][name].pop(str(b), None)
            if b in held:
                state["at"][name][str(b)] = state["version"]

    def _touched(self, df: DataFrame, name: str, n: int) -> list[int]:
        return sorted(r[0] for r in df.select(self._bucket(name, n).alias("b")).distinct().collect())

    # -- changes --

    def _pairs(self, signed: DataFrame, known: list[str]) -> DataFrame:
        counted = signed.mapInArrow(_pair_counter(known), "term_a string, term_b string, n long")
        return counted.groupBy("term_a", "term_b").agg(F.sum("n").alias("n")).where("n <> 0")

    def _kept_terms(self, state: dict, share: int = 1) -> DataFrame:
        """Terms with the least support, or `share` times less."""
        return self.read("terms", state=state).where((F.col("n") * share >= self.least) & (F.col("n") * self.per * share >= state["n"]))

    def _merge(self, delta: DataFrame, name: str, state: dict) -> None:
        """Signed counts added to those of the buckets they touch."""
        delta = settled(delta)
        touched = self._touched(delta, name, state["buckets"])
        if touched:
            sums = self.read(name, touched).unionByName(delta).groupBy(*self.KEYS[name]).agg(F.sum("n").alias("n")).where("n <> 0")
            self._write(sums, name, state, touched)

    def apply(self, changed: DataFrame, removed: DataFrame | None = None) -> None:
        """changed: record, terms, one row per record, new or in place of the old; removed: record of those taken out.

        Terms may be null or empty: the record then counts, but holds nothing. Removing an unknown record does nothing.
        """
        state = copy.deepcopy(self.state)
        state["version"] += 1
        new = changed.select("record", "terms").where("record is not null")
        out = None if removed is None else removed.select("record").where("record is not null").distinct().join(new.select("record"), "record", "left_anti")
        if not state["buckets"]:  # the first load: nothing is there to be taken back
            new = stored(new)
            rows = new.count()
            if not rows:
                return
            state["buckets"] = max(8, -(-rows // state["rows_per_bucket"]))
            state["n"] = rows
            self._write(new, "baskets", state, list(range(state["buckets"])))
            signed = self.read("baskets", state=state).withColumn("sign", F.lit(1))
        else:
            new = stored(new)
            gone_keys = new.select("record") if out is None else stored(new.select("record").unionByName(out))
            touched = self._touched(gone_keys, "baskets", state["buckets"])
            if not touched:
                return
            old = self.read("baskets", touched)
            gone = stored(old.join(gone_keys, "record", "left_semi"))
            state["n"] += new.count() - gone.count()
            signed = new.withColumn("sign", F.lit(1)).unionByName(gone.withColumn("sign", F.lit(-1)))
            self._write(old.join(gone_keys, "record", "left_anti").unionByName(new), "baskets", state, touched)
        before = set(self.state.get("known", []))
        self._merge(signed.select(F.explode("terms").alias("term"), "sign").groupBy("term").agg(F.sum("sign").cast("long").alias("n")).where("n <> 0"), "terms", state)
        # at most 2 * `per` times the mean basket size of terms: bounded, whatever the number of records
        reached = {r[0] for r in self._kept_terms(state).select("term").collect()}
        held = {r[0] for r in self._kept_terms(state, 2).select("term").collect()}
        stay, fresh, dropped = sorted(before & held), sorted(reached - before), sorted(before - held)
        state["known"] = sorted({*stay, *fresh})
        parts = [self._pairs(signed, stay)] if stay and self.state["buckets"] else []
        if fresh:  # pairs that hold a newly kept term, from the baskets that hold it
            told = self.read("baskets", state=state)
            if stay:
                new_terms = small(self.spark.createDataFrame([(t,) for t in fresh], "term string"))
                having = told.select("record", F.explode("terms").alias("term")).join(new_terms, "term", "left_semi").select("record").distinct()
                told = told.join(having, "record", "left_semi")
            filled = self._pairs(told.withColumn("sign", F.lit(1)), state["known"])
            if stay:
                a, b = new_terms.withColumnRenamed("term", "term_a"), new_terms.withColumnRenamed("term", "term_b")
                filled = filled.join(a, "term_a", "left_semi").unionByName(filled.join(a, "term_a", "left_anti").join(b, "term_b", "left_semi"))
            parts.append(filled)
        if dropped:
            lost = small(self.spark.createDataFrame([(t,) for t in dropped], "term string"))
            away = self.read("pairs").join(lost.withColumnRenamed("term", "term_a"), "term_a", "left_semi")
            away = away.unionByName(self.read("pairs").join(lost.withColumnRenamed("term", "term_a"), "term_a", "left_anti").join(lost.withColumnRenamed("term", "term_b"), "term_b", "left_semi"))
            parts.append(away.withColumn("n", -F.col("n")))
        if parts:
            self._merge(reduce(DataFrame.unionByName, parts).groupBy("term_a", "term_b").agg(F.sum("n").alias("n")).where("n <> 0"), "pairs", state)
        self._commit(state)

    def drop(self) -> None:
        """Remove the folder."""
        self._fs.delete(self._p(""), True)

    def scores(self) -> DataFrame:
        """term_a, term_b, n_ab, n_a, n_b, lift of every pair of terms with the least support, from the present counts; term_a < term_b."""
        terms = self._kept_terms(self.state)
        a = small(terms.select(F.col("term").alias("term_a"), F.col("n").alias("n_a")))
        b = small(terms.select(F.col("term").alias("term_b"), F.col("n").alias("n_b")))
        joined = self.read("pairs").withColumnRenamed("n", "n_ab").join(a, "term_a").join(b, "term_b")
        lift = F.col("n_ab") * F.lit(float(self.n)) / F.col("n_a") / F.col("n_b")
        return joined.select("term_a", "term_b", "n_ab", "n_a", "n_b", lift.alias("lift"))


def associated(table: PairTable, times: int = 10) -> DataFrame:
    """Pairs met at least `times` as often as chance, in whole numbers; support as the table's least and per."""
    big = lambda c: F.col(c).cast("decimal(18,0)")
    often = (F.col("n_ab") >= table.least) & (F.col("n_ab") * table.per >= table.n)
    met = big("n_ab") * F.lit(table.n).cast("decimal(18,0)") >= big("n_a") * big("n_b") * F.lit(times).cast("decimal(2,0)")
    return table.scores().where(often & met)


def all_pairs(held: DataFrame) -> DataFrame:
    """term_a, term_b, n_ab, n_a, n_b, lift of every pair of terms that some basket holds, however rare; term_a < term_b.

    held: record, terms, as `baskets` makes them. Pairs are summed per task and then by pair; no list of terms is broadcast.
    """
    kept = stored(held.where(F.size("terms") > 0).withColumn("sign", F.lit(1)))
    n = held.count()
    terms = stored(kept.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")))
    met = kept.mapInArrow(_pair_counter(None), "term_a string, term_b string, n long").groupBy("term_a", "term_b").agg(F.sum("n").alias("n_ab"))
    side = lambda x: terms.select(F.col("term").alias(f"term_{x}"), F.col("n").alias(f"n_{x}"))
    lift = F.col("n_ab") * F.lit(float(n)) / F.col("n_a") / F.col("n_b")
    return met.join(side("a"), "term_a").join(side("b"), "term_b").select("term_a", "term_b", "n_ab", "n_a", "n_b", lift.alias("lift"))
