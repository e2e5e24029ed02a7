"""Evaluation texts inside corpus documents: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomcat.session import fixed_rows, settled

#: Words of a shingle.
WORDS = 5
#: Share of an item's words that a document must hold; true leaks hold about a third, of which edits leave some less.
COVERED = 0.2
#: Share of an item's shingles in one window from which signatures must propose it, and the probability that they do not.
CONTAINED, MISSED = 0.15, 1e-4
#: Share of an item's shingles from which what it shares with the very same items is one text, and no stock phrase.
SAME = 0.8
#: Upper sizes of the partitions, in shingles; longer documents are cut into windows of the largest, half overlapping.
PARTITIONS = (32, 64, 96, 128, 160, 192, 224, 256)
#: Items that one task holds; more are searched for in blocks.
ITEMS = 20_000

#: Shingles of an item up to which any of its shingles makes it a candidate; signatures are for longer ones.
SHORT_ITEM = 32

_WORD = re.compile(r"[^\W_]+")


class _Letters(dict):
    """A table for str.translate that drops accents and invisible characters; filled as characters are met."""

    def __missing__(self, code: int) -> int | None:
        c = chr(code)
        self[code] = None if unicodedata.combining(c) or unicodedata.category(c) == "Cf" else code
        return self[code]


_LETTERS = _Letters()


def words_of(text: str | None) -> list[str]:
    """Words in compatibility form, lower case, without accents and invisible characters."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_LETTERS)
    return _WORD.findall(text.lower())


class Hasher:
    """64-bit shingle hashes from word hashes; words repeat, so their hashes are kept (bounded)."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def word(self, w: str) -> int:
        import xxhash

        h = self.memo.get(w)
        if h is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            h = self.memo[w] = xxhash.xxh64_intdigest(w)
        return h

    def shingles(self, words: list[str], width: int = WORDS) -> np.ndarray:
        """One hash per position; a text shorter than a shingle is one shingle, an empty one has none."""
        if not words:
            return np.array([], np.uint64)
        h = np.array([self.word(w) for w in words], np.uint64)
        n = max(1, len(h) - width + 1)
        out = np.zeros(n, np.uint64)
        for i in range(min(width, len(h))):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
            out ^= out >> np.uint64(29)
        return out


def slots_for(size: int, item_size: int) -> int:
    """MinHash slots so that a window of `size` shingles holding CONTAINED of an item is missed with at most MISSED."""
    shared = CONTAINED * item_size
    similarity = shared / (size + item_size - shared)
    return math.ceil(math.log(MISSED) / math.log(1 - similarity))


class Slots:
    """MinHash signatures of any length, one odd multiplier a slot, over the upper halves of the mixed hashes.

    Halves that fall together only make a candidate, which the whole hashes then decide.
    """

    def __init__(self, most: int):
        self.a = np.random.default_rng(20240229).integers(0, 1 << 32, most, dtype=np.uint32) | np.uint32(1)

    def signature(self, shingles: np.ndarray, n: int) -> np.ndarray:
        """Lowest product of each slot."""
        return ((shingles >> np.uint64(32)).astype(np.uint32)[:, None] * self.a[None, :n]).min(axis=0)


def most_covered(hits: list[tuple[int, int]], n_words: int) -> int:
    """Most words of an item that shingles found in a document cover, taken in the order of both.

    `hits` are places (in the document, in the item), sorted. A shingle adds the words by which it lies behind the one
    before it, in the document and in the item, and no more than its own.
    """
    width = min(WORDS, n_words)
    tree = [0] * (n_words + 1)  # most words of chains that end at a place or before it, as a Fenwick tree
    ends: dict[int, int] = {}  # most words of chains by their last place
    near: deque = deque()  # the same of the document's last places, by place and as running maxima
    most = 0
    for d, group in groupby(hits, key=lambda hit: hit[0]):
        while near and d - near[0][0] >= width:
            for p, v in near.popleft()[1].items():
                if v > ends.get(p, 0):
                    ends[p] = v
                    k = p + 1
                    while k <= n_words:
                        tree[k] = max(tree[k], v)
                        k += k & -k
        now: dict[int, int] = {}
        for _, p in group:
            v, k = 0, p - width + 1
            while k > 0:
                v = max(v, tree[k])
                k -= k & -k
            v += width
            for step in range(1, width):
                if (e := ends.get(p - step)) is not None:
                    v = max(v, e + step)
            for at, own, places, tops in near:
                ahead = d - at
                if k := bisect_right(places, p - ahead):
                    v = max(v, tops[k - 1] + ahead)
                for step in range(1, ahead):
                    if (e := own.get(p - step)) is not None:
                        v = max(v, e + step)
            now[p] = v
        tops, top = [], 0
        for v in now.values():
            top = max(top, v)
            tops.append(top)
        near.append((d, now, list(now), tops))
        most = max(most, top)
        if most >= n_words:
            break
    return most


class Search:
    """Items of a block: signatures by slot, and every place of every shingle for the exact check.

    The slots of a partition follow from the smallest item that signatures are for, so MISSED holds for all of them.
    `stock` are shingles that several items share, `same` those (item, shingle) of them that count for an item all the same.
    """

    def __init__(self, items: list[tuple[int, str]], stock: frozenset[int], same: frozenset[tuple[int, int]] = frozenset()):
        self.hasher = Hasher()
        self.sizes: dict[int, int] = {}
        self.least: dict[int, float] = {}  # share of its words that must be held
        self.short: set[int] = set()
        hashes: dict[int, np.ndarray] = {}
        keys, shingles, at = [], [], []
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            all_h = self.hasher.shingles(words)
            places = [i for i, x in enumerate(all_h.tolist()) if x not in stock or (item, x) in same]
            own_words = len({w for i in places for w in range(i, min(i + WORDS, len(words)))})
            # what its own words cannot tell must be held whole, stock and all
            told = len(words) >= WORDS and own_words / len(words) >= COVERED
            if not told:
                places = list(range(len(all_h)))
            self.sizes[item], self.least[item] = len(words), COVERED if told else 1.0
            keys.append(item)
            shingles.append(all_h[places])
            at.append(np.array(places, np.int64))
            hashes[item] = np.unique(all_h[places])
            if len(hashes[item]) <= SHORT_ITEM:
                self.short.add(item)
        self.keys = keys
        self.narrow = sorted({n for n in self.sizes.values() if n < WORDS})
        self.n_words, self.needed = np.array([self.sizes[i] for i in keys], np.int64), np.array([self.least[i] for i in keys])
        # places by shingle, then item and place
        flat = np.concatenate(shingles) if shingles else np.array([], np.uint64)
        by_shingle = np.argsort(flat, kind="stable")
        self.known, self.starts = np.unique(flat[by_shingle], return_index=True)
        self.ends = np.append(self.starts[1:], len(flat))
        self.owners = np.repeat(np.arange(len(keys)), np.array([len(a) for a in at], np.int64))[by_shingle]
        self.places = (np.concatenate(at) if at else np.array([], np.int64))[by_shingle]
        signed = {i: h for i, h in hashes.items() if i not in self.short}
        least = min(map(len, signed.values()), default=SHORT_ITEM)
        self.lengths = [slots_for(p, least) for p in PARTITIONS] if signed else [0] * len(PARTITIONS)
        self.slots = Slots(max(self.lengths))
        self.index: list[dict[int, list[int]]] = [{} for _ in range(max(self.lengths))]
        for item, h in signed.items():
            for slot, low in zip(self.index, self.slots.signature(h, len(self.index)).tolist(), strict=True):
                slot.setdefault(low, []).append(item)

    def candidates(self, shingles: np.ndarray) -> set[int]:
        """Items that share a slot of their signature with a window of the document."""
        found = set(self.short)
        if not self.index:
            return found
        size = PARTITIONS[-1]
        starts = range(0, max(1, len(shingles) - size // 2), size // 2) if len(shingles) > size else (0,)
        for at in starts:
            window = np.unique(shingles[at : at + size])
            n = next(k for p, k in zip(PARTITIONS, self.lengths, strict=True) if len(window) <= p)
            for i, low in enumerate(self.slots.signature(window, n).tolist()):
                if (hit := self.index[i].get(low)) is not None:
                    found.update(hit)
        return found

    def hits(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, place in the document and place in the item of every shingle that both hold, by place in the document."""
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        held = np.flatnonzero(self.known[at] == shingles)
        first, counts = self.starts[at[held]], self.ends[at[held]] - self.starts[at[held]]
        flat = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return self.owners[flat], np.repeat(held, counts), self.places[flat]

    def leaks(self, text: str | None) -> list[tuple[int, float]]:
        """Items that a text holds, with their covered share."""
        words = words_of(text)
        if not words or not self.sizes:
            return []
        shingles = self.hasher.shingles(words)
        sets = [shingles, *(self.hasher.shingles(words, n) for n in self.narrow)]
        owners, there, here = (np.concatenate(x) for x in zip(*map(self.hits, sets), strict=True))
        # no more than WORDS words a shingle: items below their share by that count cannot be held
        met, counts = np.unique(owners, return_counts=True)
        enough = met[counts * WORDS / self.n_words[met] >= self.needed[met]]
        if not len(enough):
            return []
        # signatures propose; pieces too thin or too far apart for them are proposed by the count
        found = self.candidates(shingles) | {self.keys[k] for k in enough.tolist()}
        out = []
        for k in met.tolist():
            if (item := self.keys[k]) in found:
                mine = owners == k
                c = most_covered(sorted(zip(there[mine].tolist(), here[mine].tolist(), strict=True)), self.sizes[item]) / self.sizes[item]
                if c >= self.least[item]:
                    out.append((item, c))
        return sorted(out)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = pa.array([" ".join(words_of(t)) for t in batch.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), words], names=["item_id", "t"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        keys = batch.column(0).to_pylist()
        sets = [np.unique(hasher.shingles(words_of(t))).view(np.int64) for t in batch.column(1).to_pylist()]
        sizes = [len(s) for s in sets]
        flat = np.concatenate(sets) if sets else np.array([], np.int64)
        columns = [np.repeat(np.array(keys, np.int64), sizes), flat, np.repeat(np.array(sizes, np.int64), sizes)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "h", "size"])


def leaked(documents: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, covered of every document that holds an item, in part or whole.

    Texts are compared by shingles of five words; shingles that several items share are stock phrases and count for
    none. Items of the same words are one text, whose shingles are its own; so are those that an item shares with the
    very same items, if they are SAME of it. An item whose own shingles cannot cover COVERED of its words, and one of
    fewer than five words, must be held whole.

    Documents are partitioned by size, each size with MinHash slots that propose items held in CONTAINED of their
    shingles; long documents are searched in half-overlapping windows, whole. Items that the slots do not propose are
    proposed by the count of their shingles in the document, so nothing is missed. Candidates are verified exactly: an
    item's own shingles, in its order, must cover COVERED of its words. Null and empty texts hold nothing; repeated
    documents and items give one row by ids, with the largest share. One pass over the documents; only what is found is
    shuffled. More than ITEMS texts are searched for in blocks, a pass each.
    """
    spark = documents.sparkSession
    told = items.where(F.col(text).isNotNull()).select(F.col(item_key).cast("long").alias("item_id"), F.col(text).alias("t"))
    told = settled(told.mapInArrow(_texts, "item_id long, t string").where("t <> ''").withColumn("key", F.xxhash64("t")).distinct())
    texts = told.select("key", "t").dropDuplicates(["key"])
    held = settled(texts.mapInArrow(_hashes, "key long, h long, size long"))
    # holders of a shingle as a set: their number and two sums of hashes without carry
    shared = held.groupBy("h").agg(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"x{i}") for i in (1, 2))).where("n > 1")
    together = shared.groupBy("n", "x1", "x2").agg(F.count("*").alias("together"))
    stocked = settled(held.join(shared.join(together, ["n", "x1", "x2"]), "h").select("key", "h", (F.col("together") >= SAME * F.col("size")).alias("same")))
    blocks = max(1, math.ceil(texts.count() / ITEMS))
    out = None
    for b in range(blocks):
        mine = F.pmod("key", F.lit(blocks)) == b
        # both are bounded by a block of items: its texts, and those of its shingles that are stock
        part = fixed_rows(texts.where(mine), 2 * ITEMS)
        mask = 0xFFFFFFFFFFFFFFFF
        stock = frozenset(r[0] & mask for r in stocked.where(mine).select("h").distinct().toLocalIterator())
        same = frozenset((r[0], r[1] & mask) for r in stocked.where(mine).where("same").select("key", "h").toLocalIterator())
        sent = spark.sparkContext.broadcast(([(r["key"], r["t"]) for r in part], stock, same))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            search = Search(*sent.value)
            for batch in batches:
                rows = [(d, i, c) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, c in search.leaks(t)]
                cols = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["doc_id", "key", "covered"])

        found = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id long, key long, covered double")
        out = found if out is None else out.unionByName(found)
    return out.join(told.select("key", "item_id").distinct(), "key").groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"))
