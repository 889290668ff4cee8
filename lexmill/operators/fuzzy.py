"""Tiered fuzzy lookup (T05): for each query the keys at the smallest edit distance from 0 to 3.

The distance join becomes equi-joins. Short keys meet by their deletion neighbourhood: two strings within distance t
share a string that each becomes by at most t deletions. Keys with two characters or more for each of t + 1 segments
are cut into these instead, as their neighbourhood would grow with the power t of their length: within distance t, one segment stands
unchanged in the query, at most t places off. Tiers are taken in turn and only queries without a hit go on, so the
costly steps are for few. Distances are on decomposed code points. No pair of all queries and all keys is ever formed.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.normalize import text_column
from lexmill.sources.tables import cut


def decomposed(text: str) -> str:
    return unicodedata.normalize("NFD", text)


def neighbours(text: Column, t: int) -> Column:
    """Distinct strings that a text becomes by at most ``t`` deletions."""
    found = F.array(text)
    for _ in range(t):
        shorter = F.flatten(F.transform(found, lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))).otherwise(F.array(F.lit("")))))
        found = F.array_distinct(F.concat(found, shorter))
    return found


def short_length(t: int) -> int:
    """Up to here keys have too few characters for segments of two."""
    return 2 * (t + 1) - 1


def segments(text: Column, t: int) -> Column:
    """The t + 1 segments of a key: length of the key, place, segment."""
    n = F.length(text)
    return F.transform(F.sequence(F.lit(0), F.lit(t)), lambda i: F.struct(n.alias("n"), i.alias("i"), F.substring(text, F.floor(i * n / (t + 1)).cast("int") + 1, (F.floor((i + 1) * n / (t + 1)) - F.floor(i * n / (t + 1))).cast("int")).alias("s")))


def probes(text: Column, t: int) -> Column:
    """What ``segments`` of a key over ``short_length`` within distance t of the text may be."""
    own = F.length(text)

    def of(n, i):
        start, size = F.floor(i * n / (t + 1)).cast("int"), (F.floor((i + 1) * n / (t + 1)) - F.floor(i * n / (t + 1))).cast("int")
        return F.transform(F.sequence(F.greatest(F.lit(0), start - t), F.greatest(F.lit(0), start + t)), lambda at: F.struct(n.alias("n"), i.alias("i"), F.substring(text, at + 1, size).alias("s")))

    lengths = F.filter(F.sequence(own - t, own + t), lambda n: n > short_length(t))
    return F.array_distinct(F.flatten(F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(0), F.lit(t)), lambda i: of(n, i))))))


def tiered(queries: DataFrame, keys: DataFrame, most: int = 3) -> DataFrame:
    """query, tier, key: all keys of the first tier that has any. Both frames have a column ``key``."""
    asked = queries.where("key <> ''").select(F.col("key").alias("query")).distinct().withColumn("q", text_column(decomposed, F.col("query")))
    held = cut(keys.where("key <> ''").select("key").distinct().withColumn("k", text_column(decomposed, F.col("key"))))
    open_, parts = cut(asked), []
    for t in range(most + 1):
        least = short_length(t)
        short = held.where(F.length("k") <= least).select("key", "k", F.explode(neighbours(F.col("k"), t)).alias("n"))
        long_ = held.where(F.length("k") > least).select("key", "k", F.explode(segments(F.col("k"), t)).alias("n"))
        by_short = open_.where(F.length("q") <= least + t).select("query", "q", F.explode(neighbours(F.col("q"), t)).alias("n")).join(short, "n")
        by_long = open_.where(F.length("q") > least - t).select("query", "q", F.explode(probes(F.col("q"), t)).alias("n")).join(long_, "n")
        met = by_short.drop("n").unionByName(by_long.drop("n"))
        near = met.where((F.abs(F.length("q") - F.length("k")) <= t) & (F.levenshtein("q", "k", t) == t))
        hits = cut(near.select("query", F.lit(t).alias("tier"), "key").distinct())
        parts.append(hits)
        open_ = cut(open_.join(hits.select("query").distinct(), "query", "left_anti"))
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, parts)
