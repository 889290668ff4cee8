"""Audit aggregates over the lexical store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.ordering import top_per_group


def high_fanout(forms: DataFrame, least: int) -> DataFrame:
    """Surfaces of at least ``least`` entries: db, form_text, n_entries, n_rows.

    Counted by (surface, entry) first, so a hot surface is reduced before it meets in one task.
    """
    pairs = forms.where("form_text <> ''").groupBy("db", "form_text", "entry_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("db", "form_text").agg(F.count("entry_id").alias("n_entries"), F.sum("n").alias("n_rows")).where(F.col("n_entries") >= least)


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of more than one row with equal keys and how many are extra."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1").withColumn("extra", F.col("n") - 1)


def sampled_values(df: DataFrame, group: list[str], value: str, k: int) -> DataFrame:
    """Up to ``k`` lowest distinct values per group, joined by |; never more than ``k`` are held per group."""
    picked = top_per_group(df.where(F.col(value).isNotNull()).select(*group, value).distinct(), group, [value], k)
    return picked.groupBy(*group).agg(F.concat_ws("|", F.array_sort(F.collect_list(value))).alias("samples"))


def tag_combinations(forms: DataFrame, tags: Column) -> DataFrame:
    """Sorted tag sets with their frequency."""
    key = F.concat_ws(";", F.array_sort(F.array_distinct(tags)))
    return forms.select("db", key.alias("combination")).where("combination <> ''").groupBy("db", "combination").agg(F.count(F.lit(1)).alias("n"))


def tag_master(audit: DataFrame) -> DataFrame:
    """Tags over all dictionaries: total, per-dictionary counts, and the spelling to show."""
    folded = audit.where("form_tag <> ''").select("db", F.lower(F.trim("form_tag")).alias("tag"), "form_tag", F.coalesce("occurrence_count", F.lit(0)).alias("n"))
    shown = folded.groupBy("tag", "form_tag").agg(F.sum("n").alias("w")).groupBy("tag").agg(F.max_by("form_tag", F.struct("w", -F.length("form_tag"), "form_tag")).alias("display"))
    per_db = folded.groupBy("tag", "db").agg(F.sum("n").alias("n"))
    counts = F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("db", "n"))), lambda x: F.concat_ws("=", x["db"], x["n"])))
    return per_db.groupBy("tag").agg(F.sum("n").alias("total"), counts.alias("db_counts")).join(shown, "tag")


def round_robin(examples: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """``k`` examples per key, taken from the dictionaries in turn."""
    ranked = top_per_group(examples.select(key, "db", value).distinct(), [key, "db"], [value], k, "turn")
    return top_per_group(ranked, [key], ["turn", "db"], k).select(key, "place", "db", value)


def script_majority(c: Column) -> Column:
    """The script of most letters: CJK as soon as there is one, Mixed on a tie, None without letters."""
    counts = {"Latin": "\\p{IsLatin}", "Greek": "\\p{IsGreek}", "Cyrillic": "\\p{IsCyrillic}", "Arabic": "\\p{IsArabic}", "Devanagari": "\\p{IsDevanagari}", "Hangul": "\\p{IsHangul}"}
    n = {name: F.length(F.regexp_replace(c, f"[^{p}]", "")) for name, p in counts.items()}
    most = F.greatest(*n.values())
    tied = sum(((x == most).cast("int") for x in n.values()), F.lit(0))
    out = F.when(c.rlike("[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}]"), "CJK").when(most == 0, "None").when(tied > 1, "Mixed")
    for name, x in n.items():
        out = out.when(x == most, name)
    return out


def modal_offset(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Offsets between two id spaces by how often they occur, over keys that are unique on both sides."""
    a = left.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a")).where("n = 1")
    b = right.groupBy(*on).agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("b")).where("m = 1")
    return a.join(b, on).groupBy((F.col("b") - F.col("a")).alias("offset")).agg(F.count(F.lit(1)).alias("n"))


def ngrams(words: Column, least: int, most: int) -> Column:
    """All word n-grams of a token array."""
    sizes = F.sequence(F.lit(least), F.lit(most))
    return F.flatten(F.transform(sizes, lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))))


def ranked_share(counts: DataFrame, group: str, n: str) -> DataFrame:
    """Percent of each row within its group."""
    return counts.withColumn("percent", F.round(100 * F.col(n) / F.sum(n).over(Window.partitionBy(group)), 6))
