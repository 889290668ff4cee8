"""References to keys that are missing, deleted or loaded later (problem 4).

References of all tables and the parents' validity intervals are co-partitioned on (space, key, salt),
sorted and merged linearly: a left sort-merge join of two sorted streams. Keys that hold more than
``1 / hot_parts`` of all references are salted: their references spread over as many partitions as they hold
shares of that size, so none keeps more than about one share however large a key is, and their parent interval is
repeated for each. There can't be more than ``hot_parts`` such keys, nor more than twice as many salts, so the list
that is broadcast has at most that many rows.

Cases: a null key is no reference, 0 is one; a row or parent without a time is never late; a key that was
deleted and created again is present; repeated rows and repeated log entries change nothing; empty tables
give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intervals(parents: dict[str, DataFrame], deletions: DataFrame | None) -> DataFrame:
    """Validity of each parent key: space, key, valid_from, valid_to, ended.

    A key in its table is valid from its loading on, without end; one that is only in the log of deletions has ended at the last of
    them (``ended`` tells so even where the log has no time). ``parents`` maps the name of a key space to a frame (key, valid_from).
    """
    none = F.lit(None).cast("timestamp_ntz")
    parts = [df.where("key is not null").select(F.lit(space).alias("space"), F.col("key").cast("bigint").alias("key"), F.lit(True).alias("present"), F.col("valid_from"), none.alias("valid_to")) for space, df in parents.items()]
    if deletions is not None:
        gone = deletions.where(F.col("row_id").isNotNull() & F.col("tab").isin(*parents))
        parts.append(gone.select(F.col("tab").alias("space"), F.col("row_id").cast("bigint").alias("key"), F.lit(False).alias("present"), none.alias("valid_from"), F.col("deleted_at").cast("timestamp_ntz").alias("valid_to")))
    merged = reduce(DataFrame.unionByName, parts).groupBy("space", "key").agg(F.max("present").alias("present"), F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to"))
    return merged.select("space", "key", "valid_from", F.when(~F.col("present"), F.col("valid_to")).alias("valid_to"), (~F.col("present")).alias("ended"))


def orphans(references: list[tuple[str, str, DataFrame]], parents: dict[str, DataFrame], deletions: DataFrame | None, hot_parts: int = 200) -> DataFrame:
    """Orphan references: tab, row_id, kind (deleted, missing, late), at.

    ``references`` has (table, key space, frame (row_id, key, at)).
    """
    refs = reduce(DataFrame.unionByName, [df.where("key is not null").select(F.lit(tab).alias("tab"), F.lit(space).alias("space"), F.col("row_id").cast("bigint").alias("row_id"), F.col("key").cast("bigint").alias("key"), F.col("at")) for tab, space, df in references])
    counted = refs.groupBy("space", "key").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n")).scalar()
    share = F.col("n") * hot_parts / total
    hot = F.broadcast(counted.where(share > 1).select("space", "key", F.ceil(share).cast("int").alias("salts")))
    salted = refs.join(hot, ["space", "key"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("tab", "row_id"), "salts"), F.lit(0)).cast("int")).drop("salts")
    spans = intervals(parents, deletions).join(hot, ["space", "key"], "left")
    spans = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    merged = salted.join(spans.hint("merge"), ["space", "key", "salt"], "left")
    kind = F.when(F.col("ended").isNull(), F.lit("missing")).when(F.col("ended"), F.lit("deleted")).when(F.col("valid_from") > F.col("at"), F.lit("late"))
    return merged.select("tab", "row_id", kind.alias("kind"), "at").where("kind is not null")


def report(orphan_rows: DataFrame) -> DataFrame:
    """Orphans per table, month of the referring row and kind; rows without a time under a null month."""
    return orphan_rows.groupBy("tab", F.date_format("at", "yyyy-MM").alias("month"), "kind").agg(F.count(F.lit(1)).alias("orphans"))
