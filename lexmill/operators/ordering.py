"""Exact global ranks and running sums without one task that holds everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.sources.tables import cut


def global_rank(df: DataFrame, order: Column, name: str = "rank", tie: str | None = None) -> DataFrame:
    """``df`` with the 1-based rank by ``order``, ties by column ``tie``."""
    return ranked(df.withColumn("_h", order), [], [F.asc("_h"), *([F.asc(tie)] if tie else [])], name).drop("_h")


def top_per_group(df: DataFrame, group: list[str], order: list, k: int, name: str = "place") -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps only ``k`` rows per group and task before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def ranked(df: DataFrame, group: list[str], order: list, name: str = "place", parts: int | None = None) -> DataFrame:
    """Every row with its 1-based place in its group; ``order`` has no ties."""
    return running(df.withColumn("_one", F.lit(1).cast("bigint")), group, order, "_one", name, parts).drop("_one")


def running(df: DataFrame, group: list[str], order: list, value: str, name: str, parts: int | None = None) -> DataFrame:
    """Every row with the sum of ``value`` up to it and with it in its group; ``order`` has no ties.

    Rows fall into ranges of (group, order), so a large group lies in many of them; only the counts of ranges are
    summed in one place, as many as there are shuffle partitions. The ranges are written first, as both passes must see the same ones.
    """
    by = [*group, *order]
    ranges = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    held = cut(ranges.withColumn("_p", F.spark_partition_id()))
    sizes = held.groupBy(*group, "_p").agg(F.sum(value).alias("_n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    before = F.sum("_n").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*(F.col(g).alias(f"_{g}") for g in group), F.col("_p").alias("_q"), F.coalesce(before, F.lit(0)).alias("_o"))
    inside = F.sum(value).over(Window.partitionBy(*group, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = [held["_p"] == offsets["_q"], *(held[g].eqNullSafe(offsets[f"_{g}"]) for g in group)]
    return held.join(offsets, same).withColumn(name, (F.col("_o") + inside).cast("bigint")).select(*df.columns, name)
