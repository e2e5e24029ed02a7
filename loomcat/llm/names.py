"""Variant spellings of names: linked to each other, and mapped to the entries of a canonical list."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomcat.functions.text import is_placeholder
from loomcat.llm.spelling import edits, next_row, read_brand, read_organisation, word_edits
from loomcat.operators.graph import components
from loomcat.operators.setjoin import similar_sets
from loomcat.session import keyed, settled, small

#: Edits within which two proper names may be one, a swap of neighbours being one edit.
EDITS = 2
#: Segments of a name, of which EDITS edits leave one whole: a swap may touch two.
SEGMENTS = 2 * EDITS + 1
#: Letters of words up to which one edit counts only, and the least.
SHORT, LEAST = 6, 3
#: How many times as many spellings as a misspelling the right name has; FEW are never too many.
RIGHT, FEW = 5, 2
#: Keys of a shard that are compared in one block; larger shards are split into more blocks.
BLOCK = 20_000


def is_name(c: Column) -> Column:
    """False for null, blank and placeholder cells."""
    return ~is_placeholder(c)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        read = [(read_brand if kind == "brand" else read_organisation)(name) for kind, name in zip(pdf["kind"], pdf["name"], strict=True)]
        yield pdf.assign(key=[r.proper for r in read], trade=[r.trade for r in read], cut=[r.cut for r in read])


def read_names(cells: DataFrame) -> DataFrame:
    """kind, name, rows, key, trade, cut of every distinct name of cells(kind, name); only distinct names reach Python."""
    distinct = cells.where(is_name(F.col("name"))).groupBy("kind", "name").agg(F.count("*").alias("rows"))
    return distinct.mapInPandas(_read, "kind string, name string, rows long, key string, trade string, cut boolean")


# -- trie join ------------------------------------------------------------------------------------------------------


def _cuts(n: int) -> list[tuple[int, int]]:
    """Start and length of even segments of a word of n letters."""
    parts = SEGMENTS
    sizes = [n // parts + (i >= parts - n % parts) for i in range(parts)]
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shards of words: of SEGMENTS segments one is left whole by EDITS edits, shifted by EDITS letters at most.

    Words near SHORT letters, of which one edit may part them, meet by what is left when one letter goes.
    """
    for pdf in batches:
        rows = set()
        for kind, key, asks in pdf[["kind", "key", "asks"]].itertuples(index=False, name=None):
            if len(key) <= SHORT + 1:
                for rest in {key, *(key[:i] + key[i + 1 :] for i in range(len(key)))}:
                    rows.add((f"{kind}|-|{rest}", 0, key))
                    if asks:
                        rows.add((f"{kind}|-|{rest}", 1, key))
            if len(key) <= SHORT:
                continue
            for i, (at, n) in enumerate(_cuts(len(key))):
                rows.add((f"{kind}|{len(key)}|{i}|{key[at : at + n]}", 0, key))
            if asks:
                for size in range(max(SHORT + 1, len(key) - EDITS), len(key) + EDITS + 1):
                    for i, (at, n) in enumerate(_cuts(size)):
                        for shift in range(max(0, at - EDITS), min(len(key) - n, at + EDITS) + 1):
                            rows.add((f"{kind}|{size}|{i}|{key[shift : shift + n]}", 1, key))
        yield pd.DataFrame(list(rows), columns=["shard", "side", "key"])


def allowed(a: str, b: str) -> int:
    """Edits within which two words may be one: fewer for short ones."""
    return 1 if min(len(a), len(b)) <= SHORT else EDITS


def _neighbours(trie: dict, word: str, most: int) -> Iterator[tuple[str, int]]:
    """Words of a trie within some edits: depth-first, with the automaton's states as a row of distances."""
    stack = [(trie, list(range(len(word) + 1)), [], "")]
    while stack:
        node, row, before, last = stack.pop()
        for letter, child in node.items():
            if letter == "":
                if row[-1] <= most:
                    yield child, row[-1]
                continue
            nxt = next_row(word, row, before, letter, last)
            if min(nxt) <= most:
                stack.append((child, nxt, row, letter))


def _trie_join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by shard, keys that are looked up before keys that ask: one trie at a time is held."""
    shard, trie = None, {}
    for pdf in batches:
        found = []
        for block, side, key in pdf[["block", "side", "key"]].itertuples(index=False, name=None):
            if block != shard:
                shard, trie = block, {}
            if side == 0:
                node = trie
                for letter in key:
                    node = node.setdefault(letter, {})
                node[""] = key
            elif trie:
                kind = block.split("|", 1)[0]
                found += [(kind, key, other, d) for other, d in _neighbours(trie, key, EDITS) if other != key and d <= allowed(key, other)]
        yield pd.DataFrame(found, columns=["kind", "key", "other", "distance"])


def near_keys(keys: DataFrame) -> DataFrame:
    """kind, key, other, distance: for each word that asks, all other words of its kind within EDITS edits, of short ones within one.

    keys: kind, key, asks; one row per word. Words are sharded by segments, each shard's keys stand in a trie that the
    asking keys of the shard traverse. A shard with more than BLOCK keys on a side is split into blocks, each pair of
    blocks being one task's work, so a segment that a third of the keys hold does not meet in one task.
    """
    spread = settled(keys.where(F.length("key") >= LEAST).mapInPandas(_shards, "shard string, side int, key string"))
    size = spread.groupBy("shard").pivot("side", [0, 1]).count().where("`0` is not null and `1` is not null")
    blocks = size.select("shard", F.ceil(F.col("0") / BLOCK).cast("int").alias("own"), F.ceil(F.col("1") / BLOCK).cast("int").alias("asking"))
    placed = spread.join(blocks, "shard")
    mine = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = placed.where("side = 0").select("shard", "side", "key", mine("own").alias("a"), F.explode(every("asking")).alias("b"))
    ask = placed.where("side = 1").select("shard", "side", "key", F.explode(every("own")).alias("a"), mine("asking").alias("b"))
    work = own.unionByName(ask).select(F.concat_ws("|", "shard", "a", "b").alias("block"), "side", "key")
    met = keyed(work, "block").sortWithinPartitions("block", "side").mapInPandas(_trie_join, "kind string, key string, other string, distance int")
    return met.dropDuplicates(["kind", "key", "other"])


# -- variants of one name -------------------------------------------------------------------------------------------


def _share_trade(a: str, b: str) -> Column:
    """Trades do not tell two keys apart: one has none, or they have one in common."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def _by_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(distance=[word_edits(a, b, EDITS) for a, b in zip(pdf["key"], pdf["other"], strict=True)])


def near_names(keys: DataFrame) -> DataFrame:
    """kind, key, other, distance: for each name that asks, others of as many words within EDITS edits, whatever the order of the words.

    keys: kind, key, asks; a key is one or more words with blanks. Neighbours are enumerated for single words by the trie
    join; names that have a pair of equal or near words are then compared in every order of their words.
    """
    words = keys.select("kind", "key", "asks", F.explode(F.split("key", " ")).alias("word"), F.size(F.split("key", " ")).alias("n"))
    words = settled(words.where("word <> ''"))
    single = words.groupBy("kind", "word").agg(F.max("asks").alias("asks")).withColumnRenamed("word", "key")
    near = settled(near_keys(single).select("kind", F.col("key").alias("word"), F.col("other").alias("o_word")))
    mine = words.where("asks").select("kind", "key", "word", "n")
    theirs = words.select("kind", F.col("key").alias("other"), F.col("word").alias("o_word"), "n")
    # one word each: the trie join has the answer; of more, a pair of near words makes a candidate
    by_near = mine.join(near, ["kind", "word"]).join(theirs, ["kind", "o_word", "n"]).select("kind", "key", "other")
    by_same = mine.where("n > 1").join(theirs.where("n > 1").withColumnRenamed("o_word", "word"), ["kind", "word", "n"]).select("kind", "key", "other")
    met = by_near.unionByName(by_same).where("key <> other").distinct()
    return met.mapInPandas(_by_order, "kind string, key string, other string, distance int").where(F.col("distance") <= EDITS)


def _beginnings(keys: DataFrame) -> DataFrame:
    """kind, key, other, shorter: names cut short within their last word, or with words left out, and the whole names they begin.

    Words count as cut only with a dot behind, or a trade of organisations; what is left has LEAST letters with a dot and
    five without. A name that begins two others by whole words begins none.
    """
    sure = F.col("cut") | ((F.col("kind") == "manuf") & (F.size("trades") > 0))
    cut = keys.select("kind", "key", F.when(F.col("cut"), LEAST).otherwise(5).alias("least"), sure.alias("sure"))
    whole = keys.select("kind", F.col("key").alias("other"), F.explode(F.sequence(F.lit(LEAST), F.length("key") - 1)).alias("n")).where("length(other) > n")
    heads = whole.select("kind", F.trim(F.substring(F.col("other"), F.lit(1), F.col("n"))).alias("key"), "other", (F.length("other") - F.col("n")).alias("shorter")).distinct()
    met = heads.join(cut, ["kind", "key"]).where(F.length("key") >= F.col("least"))
    by_words = F.substring(F.col("other"), F.length("key") + 1, F.lit(1)) == " "
    told = met.withColumn("by_words", by_words).where("by_words or sure").groupBy("kind", "key", "other", "by_words").agg(F.min("shorter").alias("shorter"))
    only = told.where("by_words").groupBy("kind", "key").agg(F.count("*").alias("n_whole"))
    return told.join(only, ["kind", "key"], "left").where("not by_words or n_whole = 1").select("kind", "key", "other", "shorter")


def linked_names(cells: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """kind, name, class_id: every distinct name with the organisation or brand it spells.

    cells: kind (`manuf` or `brand`), name; known: names of the same kind that are right as they are; null, blank and
    placeholder cells are left out, names are taken byte for byte. A spelling is read into the words of its proper name
    and a trade, whatever the case, joints and short forms of its words. A proper name that is not known is linked to one
    that is, or that has RIGHT times its spellings, if it is within EDITS edits in some order of the words (trie join, then
    orders), or begins it; trades must agree. Links of links are followed to their end. Names that are only turned are one. A name without a trade joins the only trade of its proper
    name, so makers that share a surname in different trades stay apart. An empty table gives no rows.
    """
    names = settled(read_names(cells))
    right = cells.select("kind", "name").limit(0) if known is None else known.select("kind", "name")
    right = read_names(right).select("kind", "key").distinct().withColumn("right", F.lit(True))
    keys = (
        names.groupBy("kind", "key").agg(
            F.count("*").alias("support"), F.sum("rows").alias("rows"), F.collect_set(F.when(F.col("trade") != "", F.col("trade"))).alias("trades"), F.max("cut").alias("cut")
        )
    )
    keys = settled(keys.join(right, ["kind", "key"], "left").withColumn("right", F.coalesce("right", F.lit(False))))
    typed = near_names(keys.select("kind", "key", (~F.col("right")).alias("asks")))
    links = typed.select("*", F.lit(0).alias("shorter")).unionByName(_beginnings(keys).select("kind", "key", "other", F.lit(0).alias("distance"), "shorter"))
    facts = ("support", "rows", "trades", "right", "cut")
    one = keys.select("kind", "key", *[F.col(c).alias(f"k_{c}") for c in facts])
    two = keys.select("kind", F.col("key").alias("other"), *[F.col(c).alias(f"o_{c}") for c in facts])
    links = links.join(one, ["kind", "key"]).join(two, ["kind", "other"])
    more = F.struct("o_right", "o_support", "o_rows", "other") > F.struct("k_right", "k_support", "k_rows", "key")
    turned = (F.col("distance") == 0) & (F.col("shorter") == 0)
    rarely = F.col("k_support") <= F.greatest(F.lit(FEW), F.col("o_support") / RIGHT)
    fits = ((F.col("shorter") > 0) & ~F.col("o_cut")) | (more & (turned | rarely))
    links = links.where(~F.col("k_right") & fits & _share_trade("k_trades", "o_trades"))
    begun = F.col("k_cut") & (F.col("shorter") > 0)  # a dot says that the word goes on
    names_of = {"begun": begun, "near": -F.col("distance"), "right": F.col("o_right"), "whole": -F.col("shorter"), "support": F.col("o_support"), "rows": F.col("o_rows"), "other": F.col("other")}
    better = F.struct(*[c.alias(n) for n, c in names_of.items()])
    parent = links.groupBy("kind", "key").agg(F.max_by("other", better).alias("up"))
    tagged = lambda c: F.concat_ws("|", "kind", c)
    classes = components(parent.select(tagged("key").alias("a"), tagged("up").alias("b")))
    parent = classes.select(F.substring_index("node", "|", 1).alias("kind"), F.expr("substring(node, instr(node, '|') + 1)").alias("key"), F.expr("substring(component, instr(component, '|') + 1)").alias("up"))
    rooted = names.join(parent, ["kind", "key"], "left").select("kind", "name", F.coalesce("up", "key").alias("root"), "trade")
    trades = rooted.where("trade <> ''").groupBy("kind", "root").agg(F.collect_set("trade").alias("of_root"))
    placed = rooted.join(trades, ["kind", "root"], "left")
    only = F.when((F.col("trade") == "") & (F.size("of_root") == 1), F.element_at("of_root", 1)).otherwise(F.col("trade"))
    return placed.select("kind", "name", F.concat_ws("|", "root", only).alias("class_id"))


def variant_pairs(cells: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """kind, name_a, name_b: two different spellings of one organisation or brand, name_a < name_b by bytes.

    The spellings of one name meet by their class; what is asked for is their pairs.
    """
    classes = settled(linked_names(cells, known))
    a = classes.select("kind", "class_id", F.col("name").alias("name_a"))
    b = classes.select("kind", "class_id", F.col("name").alias("name_b"))
    return a.join(b, ["kind", "class_id"]).where("name_a < name_b").select("kind", "name_a", "name_b")


# -- mapping to a canonical list ------------------------------------------------------------------------------------


def _grams(kind: Column, key: Column) -> Column:
    """Distinct pairs of neighbouring letters, with the ends marked, of words in any order; tagged by kind, so that kinds never meet."""
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat_ws("|", kind, F.substring(F.concat(F.lit("^"), w, F.lit("$")), i, F.lit(2))))
    return F.array_distinct(F.flatten(F.transform(F.filter(F.split(key, " "), lambda w: w != ""), pairs)))


def _with_edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(distance=[edits(a, b, EDITS) if " " not in a + b else word_edits(a, b, EDITS) for a, b in zip(pdf["key"], pdf["entry"], strict=True)])


def canonical_codes(entered: DataFrame, canonical: DataFrame, least: float = 0.25) -> DataFrame:
    """field_name, entered, code: each distinct name of entered(field_name, kind, name) with the code of the entry it means.

    canonical: kind, name, code. Names that are exactly an entry are left out, as are null, blank and placeholder
    cells; a name that means no entry, or equally well two, has the code NONE. Entries and names are compared by the
    letter pairs of their proper names (prefix-filtered set-similarity join), and the most similar one is kept that an
    exact check passes: the proper names are within two edits, short ones within one, or the entered one is cut short,
    and the trades agree. An empty list gives NONE throughout.
    """
    cells = settled(entered.where(is_name(F.col("name"))).groupBy("field_name", "kind", "name").agg(F.count("*").alias("rows")))
    cells = cells.join(canonical.select("kind", "name").distinct(), ["kind", "name"], "left_anti")
    read = settled(read_names(cells.select("kind", "name")))
    told = read_names(canonical.select("kind", "name"))
    # one partner may stand for all of them
    told = told.select("kind", "name", F.explode(F.array_distinct(F.concat(F.array("key"), F.split("key", " ")))).alias("key"), "trade")
    entries = told.join(canonical.distinct(), ["kind", "name"])
    entries = settled(entries.select("kind", "key", "trade", "code").distinct())
    asked = read.select("kind", "key").distinct().select(F.concat_ws("|", "kind", "key").alias("l"), _grams(F.col("kind"), F.col("key")).alias("tokens"))
    listed = entries.select("kind", "key").distinct().select(F.concat_ws("|", "kind", "key").alias("r"), _grams(F.col("kind"), F.col("key")).alias("tokens"))
    kind_of = lambda c: F.substring_index(c, "|", 1)
    key_of = lambda c: F.element_at(F.split(c, r"\|", 2), 2)
    similar = similar_sets(asked, listed, least)
    near = similar.select(kind_of("l").alias("kind"), key_of("l").alias("key"), key_of("r").alias("entry"), "similarity")
    near = near.mapInPandas(_with_edits, "kind string, key string, entry string, similarity double, distance int")
    shorter = F.length("entry") - F.length("key")
    begins = F.col("entry").startswith(F.col("key")) & (shorter > 0) & (F.length("key") >= LEAST)
    short = F.least(F.length("key"), F.length("entry")) <= SHORT
    near = near.where((F.col("distance") <= F.when(short, 1).otherwise(EDITS)) | begins).withColumn("typed", F.col("distance") <= F.when(short, 1).otherwise(EDITS))
    hits = read.join(near, ["kind", "key"]).join(entries.select("kind", F.col("key").alias("entry"), F.col("trade").alias("entry_trade"), "code"), ["kind", "entry"])
    agree = (F.col("trade") == "") | (F.col("entry_trade") == "") | (F.col("trade") == F.col("entry_trade"))
    abbreviated = F.col("typed") | F.col("cut") | ((F.col("kind") == "manuf") & (F.col("trade") != ""))
    hits = hits.where(agree & abbreviated)
    # the most similar entry counts, misspelt names before cut ones; equally similar entries of two codes are none
    rank = F.struct((~F.col("typed")).alias("a"), (-F.col("similarity")).alias("b"), F.when(F.col("typed"), F.col("distance")).otherwise(0).alias("c"))
    best = hits.withColumn("rank", rank).withColumn("first", F.min("rank").over(Window.partitionBy("kind", "name"))).where("rank = first")
    code = best.groupBy("kind", "name").agg(F.collect_set("code").alias("codes")).select("kind", "name", F.when(F.size("codes") == 1, F.element_at("codes", 1)).alias("code"))
    return cells.join(code, ["kind", "name"], "left").select("field_name", F.col("name").alias("entered"), F.coalesce("code", F.lit("NONE")).alias("code"))
