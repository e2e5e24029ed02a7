"""Set-similarity join with prefix, length and positional filters, verified exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomcat.session import settled


def similar_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """l, r, similarity: pairs of sets of two tables (l, tokens) and (r, tokens) with a Jaccard similarity of at least `least`.

    Tokens are ordered by their rarity over both tables; only the rare prefixes that a similar pair must share are
    joined. Sizes that rule the similarity out are left out before, and positions that do are right behind the join;
    what remains is verified exactly. Null and empty sets are similar to none.
    """
    both = left.select("tokens").unionByName(right.select("tokens"))
    rarity = settled(both.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("often")))

    def prefixes(df: DataFrame, key: str) -> DataFrame:
        ranked = df.select(key, F.explode("tokens").alias("token")).distinct().join(rarity, "token")
        ordered = ranked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("o"))
        ordered = ordered.select(key, F.col("o.token").alias("tokens")).withColumn("size", F.size("tokens"))
        n = F.col("size") - F.ceil(F.lit(least) * F.col("size")) + 1
        return ordered.select(key, "tokens", "size", F.posexplode(F.slice("tokens", F.lit(1), n.cast("int"))).alias("at", "token"))

    a, b = prefixes(left, "l"), prefixes(right, "r")
    a = a.select("l", F.col("tokens").alias("lt"), F.col("size").alias("ls"), F.col("at").alias("la"), "token")
    b = b.select("r", F.col("tokens").alias("rt"), F.col("size").alias("rs"), F.col("at").alias("ra"), "token")
    met = a.join(b, "token").where((F.col("ls") * least <= F.col("rs")) & (F.col("rs") * least <= F.col("ls")))
    most = 1 + F.least(F.col("ls") - F.col("la") - 1, F.col("rs") - F.col("ra") - 1)
    met = met.where(most >= F.lit(least / (1 + least)) * (F.col("ls") + F.col("rs")) - 1e-9).dropDuplicates(["l", "r"])
    shared = F.size(F.array_intersect("lt", "rt"))
    return met.select("l", "r", (shared / (F.col("ls") + F.col("rs") - shared)).alias("similarity")).where(F.col("similarity") >= least)
