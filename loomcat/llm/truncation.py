"""Texts cut off by field limits or mid-transfer, found by a backward character n-gram model.

For the last characters of a text the model compares how often texts end behind them with how often they go on. Counts
of the contexts come from all texts: words with the word before them are counted first, and only the distinct pairs
are spread into their prefixes. The log-odds against the end, corrected by how usual the end is in its feed, must pass
a threshold that is set per feed and length: at a field limit, in characters or bytes, the share of texts that its
neighbours do not explain, elsewhere a share learned by expectation-maximisation, in which cut texts do not count as ends.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomcat.session import settled, small, stored

#: Lengths of the contexts in characters, shortest first; each backs off to the one before.
ORDERS = (2, 4, 7, 12)
#: What a shorter context weighs against the counts of a longer one.
BACK_OFF = 25.0
#: Rows by which a length's share of cut texts is drawn to the feed's.
SHRINK = 30.0
ROUNDS, INNER = 2, 20
#: Least share of cut texts taken for a length: with it, a text counts as cut where ends are rarer than about one in a hundred.
LEAST_SHARE = 0.15
#: Rows from which on a length can be a field limit.
LEAST_PILE = 12
#: The place in ORDERS[1:] at which the ends of a feed are compared with those of all, and what is added to both counts.
OF_FEED, FEED_ENDS = 1, 3.0
#: Distinct ends of texts in one group of contexts, and groups at least.
IN_GROUP, GROUPS = 20_000, 48
#: What a cut may leave: dots, a replacement character, a broken character entity.
MARKS = r"\s*(?:\.\.+|…|�+|&[#a-zA-Z0-9]{0,6})\s*$"


def _spelled(text: Column) -> Column:
    """Lower case, digits and vulgar fractions as 0, single blanks, no cut mark."""
    whole = F.trim(F.when(_marked(text), F.regexp_replace(text, MARKS, "")).otherwise(text))
    single = F.when(whole.rlike(r"\s\s|[\t\r\n]"), F.regexp_replace(whole, r"\s+", " ")).otherwise(whole)
    return F.translate(F.lower(single), "123456789½¼¾", "000000000000")


def _marked(text: Column) -> Column:
    """Whether a cut mark ends the text; only its end is looked at."""
    return F.substring(text, -12, 12).rlike(MARKS)


def _tail(text: Column, n: int) -> Column:
    return F.substring(text, -n, n)


def prepared(records: DataFrame, key: str = "row_id", text: str = "description", feed: str = "feed") -> DataFrame:
    """key, feed, ending, chars, bytes, spelled and context of every text that is neither null nor blank.

    ending is `mark` for a cut mark, `s` for blanks behind the last word, else empty; chars and bytes are the length
    without these blanks. The context is the end of the last two words, with ^ for the start of the text.
    """
    t = F.col(text)
    bare = F.rtrim(t)
    told = records.where(F.trim(t) != "").select(
        F.col(key).alias("key"), F.coalesce(F.col(feed), F.lit("")).alias("feed"),
        F.when(_marked(t), "mark").when(F.length(t) > F.length(bare), "s").otherwise("").alias("ending"),
        F.length(bare).alias("chars"), F.octet_length(bare).alias("bytes"), _spelled(t).alias("spelled"),
    )
    context = _tail(F.substring_index(F.concat(F.lit("^ "), F.col("spelled")), " ", -2), ORDERS[-1])
    return told.where("spelled <> ''").withColumn("context", context)


def _positions(texts: DataFrame) -> DataFrame:
    """context, inside, at_word_end: how often each context occurs within words and at the end of words."""
    words = F.split("spelled", " ")
    shifted = F.arrays_zip(F.concat(F.array(F.lit("^")), words).alias("before"), words.alias("word"))
    pairs = texts.select(F.explode(shifted).alias("p")).select("p.before", "p.word").where("word is not null").groupBy("before", "word").count()
    size = F.length("word")
    spread = pairs.select("before", "word", "count", F.explode(F.sequence(F.lit(1), size)).alias("n"))
    text = F.concat("before", F.lit(" "), F.substring(F.col("word"), F.lit(1), F.col("n")))
    at_end = F.col("n") == size
    return spread.groupBy(_tail(text, ORDERS[-1]).alias("context")).agg(
        F.sum(F.when(~at_end, F.col("count")).otherwise(0)).alias("inside"), F.sum(F.when(at_end, F.col("count")).otherwise(0)).alias("at_word_end")
    )


def _lengths(texts: DataFrame) -> DataFrame:
    """feed, measure, ending, at, rows, piled, excess: how many texts have a length, and how many more than its neighbours let expect.

    What is expected at a length goes on from the six lengths before it. A length is piled if it holds more than twice
    that, and more than twice the lengths behind it.
    """
    counted = settled(texts.groupBy("feed", "ending", "chars", "bytes").agg(F.count("*").alias("n")))
    both = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("at")) for m in ("chars", "bytes"))))
    at = F.when(F.col("ending") == "mark", 0).otherwise(F.col("m.at")).alias("at")
    lengths = counted.select("feed", "ending", "n", both.alias("m")).select("feed", "m.measure", "ending", at, "n").groupBy("feed", "measure", "ending", "at").agg(F.sum("n").alias("rows"))
    w = Window.partitionBy("feed", "measure", "ending").orderBy("at")
    mean = lambda a, b: F.coalesce(F.sum("rows").over(w.rangeBetween(a, b)), F.lit(0)) / (b - a + 1)
    near, far, behind = mean(-3, -1), mean(-6, -4), mean(1, 2)
    trend = F.pow(F.least(F.greatest((near + 1) / (far + 1), F.lit(0.4)), F.lit(1.6)), 2 / 3)
    expected = near * trend
    piled = (F.col("ending") != "mark") & (F.col("rows") >= LEAST_PILE) & (F.col("rows") > 2 * expected) & (F.col("rows") > 2 * near) & (F.col("rows") > 2 * behind)
    told = lengths.select("feed", "measure", "ending", "at", "rows", piled.alias("piled"), expected.alias("expected"))
    return told.withColumn("excess", F.when(F.col("piled"), F.col("rows") - F.col("expected")).otherwise(0.0)).drop("expected")


def _measured(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts with their length as the feed's field measures it, and feed, length, piled, share, feed_ends of every length.

    A feed counts in bytes if more texts pile up so than in characters. share is a length's prior share of cut texts: at
    a field limit what exceeds the expected ones. feed_ends are the texts of the feed at other lengths.
    """
    lengths = settled(_lengths(texts))
    piles = lengths.groupBy("feed").agg(*(F.sum(F.when(F.col("measure") == m, F.col("excess"))).alias(m) for m in ("chars", "bytes")))
    measure = piles.select("feed", F.when(F.col("bytes") > F.col("chars"), "bytes").otherwise("chars").alias("measure"))
    key = lambda at: F.when(F.col("ending") == "mark", "mark").otherwise(F.concat(at.cast("string"), F.col("ending")))
    told = texts.join(small(measure), "feed").withColumn("length", key(F.when(F.col("measure") == "bytes", F.col("bytes")).otherwise(F.col("chars"))))
    own = lengths.join(measure, ["feed", "measure"])
    sure = F.least(F.greatest(F.col("excess") / F.col("rows"), F.lit(LEAST_SHARE)), F.col("rows") / (F.col("rows") + 1))
    ends = F.sum(F.when(F.col("piled") | (F.col("ending") == "mark"), 0).otherwise(F.col("rows"))).over(Window.partitionBy("feed"))
    shares = own.select("feed", key(F.col("at")).alias("length"), "piled", F.when(F.col("piled"), sure).otherwise(LEAST_SHARE).alias("share"), ends.alias("feed_ends"))
    return told.select("key", "feed", "length", "spelled", "context"), settled(shares)


def _codes(contexts: pd.Series, k: int, among: pd.Index | None = None) -> tuple[np.ndarray, pd.Index]:
    tails = contexts.str[-k:]
    if among is None:
        codes, names = pd.factorize(tails)
        return codes, pd.Index(names)
    return among.get_indexer(tails), among


def _go_on(ends: pd.DataFrame, positions: pd.DataFrame) -> pd.DataFrame:
    """How often the contexts of ends go on elsewhere, by order but the shortest; all contexts of a group share their last letters."""
    out = ends[["feed", "length", "context", "n"]].copy()
    blank = ends["length"].str.endswith("s").to_numpy()
    for k in ORDERS[1:]:
        own, names = _codes(ends["context"], k)
        there, _ = _codes(positions["context"], k, names)
        met = there >= 0
        # positions within words count once; word ends that end no text twice, as a cut falls before or behind the blank
        inside = np.bincount(there[met], positions["inside"].to_numpy()[met], len(names))
        whole = np.bincount(there[met], positions["at_word_end"].to_numpy()[met], len(names))
        stop = np.bincount(own, ends["n"], len(names))
        further = np.maximum(whole - stop, 0)
        # a text with blanks behind its last word was cut behind a word, if at all
        out[f"on{k}"] = np.where(blank, further[own], (inside + 2.0 * further)[own])
    return out


def _shortest(ends: DataFrame, positions: DataFrame, shares: DataFrame) -> DataFrame:
    """last, stop, inside, further: ends and continuations of the shortest contexts. Ends at field limits and cut marks are none."""
    last = _tail(F.col("context"), ORDERS[0]).alias("last")
    known = ends.join(small(shares), ["feed", "length"])
    stops = known.groupBy(last).agg(F.sum("n").alias("all"), F.sum(F.when(F.col("piled") | (F.col("length") == "mark"), 0).otherwise(F.col("n"))).alias("stop"))
    on = positions.groupBy(last).agg(F.sum("inside").alias("inside"), F.sum("at_word_end").alias("whole"))
    further = F.greatest(F.coalesce("whole", F.lit(0)) - F.col("all"), F.lit(0))
    return stops.join(on, "last", "left").select("last", F.col("stop").cast("double").alias("stop"), F.coalesce("inside", F.lit(0)).cast("double").alias("inside"), further.cast("double").alias("further"))


def _judge(rates: tuple[float, float], all_ends: float):
    """Expectation-maximisation within a group of contexts, for given shares of the lengths.

    rates: texts by letters, and by words. all_ends: texts that do not end at a field limit.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        codes = [_codes(group["context"], k)[0] for k in ORDERS[1:]]
        on = [group[f"on{k}"].to_numpy(float) for k in ORDERS[1:]]
        n = group["n"].to_numpy(float)
        marked = (group["length"] == "mark").to_numpy()
        prior = np.log(group["share"].to_numpy(float) / (1 - group["share"].to_numpy(float)))
        piled = group["piled"].to_numpy(bool)
        blank = group["length"].str.endswith("s").to_numpy()
        start = np.where(blank, rates[1], rates[0])
        stop, inside, further = (group[c].to_numpy(float) for c in ("stop", "inside", "further"))
        short = (stop + BACK_OFF * start) / (stop + np.where(blank, further, inside + 2.0 * further) + BACK_OFF)
        usual = group["feed_ends"].to_numpy(float) / max(all_ends, 1.0)
        near = codes[OF_FEED]
        own = pd.factorize(pd.MultiIndex.from_arrays([group["feed"], near]))[0]
        cut = np.where(piled | marked, 1.0, 0.0)
        for _ in range(INNER):
            # a text is judged by the ends of other texts; at a field limit none is sure to be an end
            whole = np.where(piled | marked, 0.0, 1 - cut)
            p = short
            for c, go in zip(codes, on, strict=True):
                stop = np.maximum(np.bincount(c, n * whole)[c] - whole, 0)
                p = (stop + BACK_OFF * p) / (stop + go + BACK_OFF)
            p = np.clip(p, 1e-6, 1 - 1e-6)
            # how much rarer or more usual these ends are in the feed than elsewhere
            here = np.maximum(np.bincount(own, n * whole)[own] - whole, 0)
            usually = np.maximum(np.bincount(near, n * whole)[near] - whole, 0) * usual
            against = np.log((1 - p) / p) - np.log((1 - start) / start) - np.log((here + FEED_ENDS) / (usually + FEED_ENDS))
            cut = np.where(marked, 1.0, 1 / (1 + np.exp(-np.clip(against + prior, -40, 40))))
        return group[["feed", "length", "context", "n"]].assign(cut=cut)

    return run


def cut_ends(texts: DataFrame, shares: DataFrame) -> DataFrame:
    """feed, length, context, n, cut: the probability that a text with these lost its end.

    The shortest contexts, few, are counted over all. The longer ones are worked on in groups by their last letters, so
    that the counts of all their orders meet in one group; a group holds distinct contexts by feed and length, not texts,
    and the number of groups follows from theirs.
    """
    ends = settled(texts.groupBy("feed", "length", "context").agg(F.count("*").alias("n")))
    positions = settled(_positions(texts))
    groups = max(GROUPS, ends.count() // IN_GROUP)
    bucket = F.pmod(F.xxhash64(_tail(F.col("context"), ORDERS[1])), F.lit(groups)).alias("bucket")
    columns = "feed string, length string, context string, n long"
    met = ends.select("*", bucket).groupBy("bucket").cogroup(positions.select("*", bucket).groupBy("bucket"))
    told = met.applyInPandas(_go_on, f"{columns}, " + ", ".join(f"on{k} double" for k in ORDERS[1:]))
    known = settled(told.withColumn("last", _tail(F.col("context"), ORDERS[0])).join(small(settled(_shortest(ends, positions, shares))), "last").drop("last"))
    letters = texts.agg(F.sum(F.length("spelled") + 1), F.count("*"), F.sum(F.size(F.split("spelled", " ")))).first()
    rates = tuple((letters[1] or 0) / max((of or 0) + (letters[1] or 0), 1) for of in (letters[0], letters[2]))
    all_ends = shares.dropDuplicates(["feed"]).agg(F.sum("feed_ends")).first()[0] or 0
    first, judged = shares, None
    for _ in range(ROUNDS):
        told = known.join(small(shares), ["feed", "length"])
        judged = settled(told.select("*", bucket).groupBy("bucket").applyInPandas(_judge(rates, all_ends), f"{columns}, cut double"))
        met = judged.groupBy("feed", "length").agg(F.sum(F.col("n") * F.col("cut")).alias("cuts"), F.sum("n").alias("rows"))
        met = met.join(first, ["feed", "length"]).withColumn("plain", ~F.col("piled"))
        w = Window.partitionBy("feed")
        base = F.sum(F.when(F.col("plain"), F.col("cuts"))).over(w) / F.sum(F.when(F.col("plain"), F.col("rows"))).over(w)
        drawn = (F.col("cuts") + SHRINK * F.coalesce(base, F.lit(0.03))) / (F.col("rows") + SHRINK)
        learned = F.least(F.greatest(drawn, F.lit(LEAST_SHARE)), F.lit(0.98))
        shares = met.select("feed", "length", "piled", F.when(F.col("piled"), F.col("share")).otherwise(learned).alias("share"), "feed_ends")
    return judged


def cut_records(records: DataFrame, key: str = "row_id", text: str = "description", feed: str = "feed", above: float = 0.5) -> DataFrame:
    """One row per record whose text lost its end: key, feed. Null, empty and blank texts are no cases.

    A record sent again is one case; an empty table gives no rows; extra columns are ignored.
    """
    texts, shares = _measured(stored(prepared(records, key, text, feed)))
    hits = cut_ends(texts, shares).where(F.col("cut") > above).select("feed", "length", "context")
    found = texts.select("key", "feed", "length", "context").join(small(hits), ["feed", "length", "context"], "left_semi")
    return found.select(F.col("key").alias(key), "feed").dropDuplicates([key])


def cut_shares(records: DataFrame, key: str = "row_id", text: str = "description", feed: str = "feed") -> DataFrame:
    """feed, records, cut, share: how often each feed cuts, of the records that have a text."""
    all_of = records.where(F.trim(F.col(text)) != "").groupBy(F.coalesce(F.col(feed), F.lit("")).alias("feed")).agg(F.countDistinct(key).alias("records"))
    cut = cut_records(records, key, text, feed).groupBy("feed").agg(F.count("*").alias("cut"))
    joined = all_of.join(cut, "feed", "left").fillna(0, ["cut"])
    return joined.select("feed", "records", "cut", F.round(F.col("cut") / F.col("records"), 6).alias("share"))
