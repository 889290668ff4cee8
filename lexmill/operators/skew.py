"""Per-key results over keys that hold most of the rows (problem 5).

Value-frequency compression: rows are first counted by (key, value), which spreads a hot key over as
many tasks as it has values and shrinks it before the shuffle, and only these weighted values are
grouped by key. Every result is exact: rows, distinct values, the mode (ties to the smallest value) and
percentiles from weighted values.

Cases: null keys are left out of results but count in the total; a null value counts as a row but not as
a distinct value; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compress(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Weighted values: key, value, n."""
    return rows.groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def profile(weighted: DataFrame, measure=None) -> DataFrame:
    """Per key: n_rows, n_values, mode_value, mode_rows and, with ``measure``, exact p50 and p90 of it.

    ``measure`` turns the value column into a number of small range (such as a length).
    """
    parts = [F.sum("n").alias("n_rows"), F.count("value").alias("n_values"), F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("w"), F.col("value").alias("v")))).alias("top")]
    if measure is not None:
        m = measure(F.col("value"))
        parts += [F.percentile(m, F.lit(0.5), F.col("n")).alias("p50"), F.percentile(m, F.lit(0.9), F.col("n")).alias("p90")]
    out = weighted.where("key is not null").groupBy("key").agg(*parts)
    return out.select("key", "n_rows", "n_values", F.col("top.v").alias("mode_value"), (-F.col("top.w")).alias("mode_rows"), *(["p50", "p90"] if measure is not None else []))


def heavy(rows: DataFrame, first: str, second: str, share: float = 0.02) -> DataFrame:
    """Key values of either column with more than ``share`` of all rows: field, key_value.

    Both columns are read from one compressed table, each the other's value. The result has fewer than
    ``2 / share`` rows.
    """
    pairs = rows.groupBy(first, second).agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(F.struct(F.lit(first).alias("field"), F.col(first).cast("string").alias("key_value")), F.struct(F.lit(second).alias("field"), F.col(second).cast("string").alias("key_value")))
    by_key = pairs.select(F.explode(sides).alias("s"), "n").groupBy("s.field", "s.key_value").agg(F.sum("n").alias("n"))
    total = by_key.where(F.col("field") == first).agg(F.sum("n")).scalar()
    return by_key.where("key_value is not null").where(F.col("n") > F.lit(share) * total).select("field", "key_value")
