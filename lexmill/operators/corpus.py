"""Corpus shaping: tokens, labels, spans, splits and packing."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.ordering import global_rank, ranked, top_per_group

TOKEN = re.compile(r"\w+|[^\w\s]", re.UNICODE)
# Sentence ends per language and what may follow them.
STOPS = {"": ".!?…", "hi": "।॥.!?", "sa": "।॥.!?", "zh": "。！？…", "ja": "。！？…", "ar": ".!؟", "fa": ".!؟", "ur": "۔.!؟", "el": ".!;…", "grc": ".;·"}
MOST_PHRASES = 1000
CLOSERS = "\"'”’»)]」』）"


def sentence_spans(text: str | None, lang: str | None = "") -> list[tuple[int, int]]:
    """[start, end) of the sentences of a text, without the white space between them."""
    if not text:
        return []
    stops = STOPS.get((lang or "").strip().lower().split("-")[0], STOPS[""])
    out = []
    for m in re.finditer(rf"[^{re.escape(stops)}]*(?:[{re.escape(stops)}]+[{re.escape(CLOSERS)}]*|$)", text):
        piece = m[0]
        if piece.strip():
            out.append((m.start() + len(piece) - len(piece.lstrip()), m.start() + len(piece.rstrip())))
    return out


def spans_of(text: Column, lang: Column) -> Column:
    """``sentence_spans`` as a vectorised column."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(texts: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in sentence_spans(t, g)] for t, g in zip(texts, langs)], dtype=object)

    return run(text, lang)


def tokens_of(text: Column) -> Column:
    """Tokens with their offsets."""

    @F.pandas_udf("array<struct<token:string,start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"token": m[0], "start": m.start(), "end": m.end()} for m in TOKEN.finditer(t or "")] for t in texts], dtype=object)

    return run(text)


#: Label -> what it covers.
QUOTES = {"QUOTE": "“[^”]*”|„[^“]*“|«[^»]*»", "BRACKET": r"\([^)]*\)"}


def matches_of(text: Column, patterns: dict[str, str]) -> Column:
    """Spans (start, end, label) of labelled patterns, each match at its own place, none inside another."""

    @F.pandas_udf("array<struct<start:int,end:int,label:string>>")
    def run(texts: pd.Series) -> pd.Series:
        either = re.compile("|".join(f"(?P<{k}>{p})" for k, p in patterns.items()))
        return pd.Series([[{"start": m.start(), "end": m.end(), "label": m.lastgroup} for m in either.finditer(t or "")] for t in texts], dtype=object)

    return run(text)


def occurrences(df: DataFrame, column: str, phrases: DataFrame) -> DataFrame:
    """``df`` with ``phrase`` and its number ``n`` of non-overlapping, case-folded occurrences, where there are any.

    The phrases are a query set; they are sent to all rows as one array, whose size is checked.
    """
    wanted = [r.phrase for r in phrases.where("phrase <> ''").select("phrase").distinct().limit(MOST_PHRASES + 1).collect()]
    if len(wanted) > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} phrases; search in blocks")
    folded = F.lower(column)
    found = F.transform(F.array(*map(F.lit, wanted)), lambda p: F.struct(p.alias("phrase"), ((F.length(folded) - F.length(F.replace(folded, F.lower(p), F.lit("")))) / F.length(p)).cast("bigint").alias("n")))
    return df.withColumn("_f", F.explode(F.filter(found, lambda x: x.n > 0))).select(*df.columns, "_f.phrase", "_f.n")


def overlap_labels(tokens: Column, spans: Column) -> Column:
    """For each token the label of the span that covers most of it, the first of equals.

    Both are arrays of one row, so the interval join needs no shuffle.
    """

    def best(t):
        shared = F.transform(spans, lambda s: F.struct(F.greatest(F.lit(0), F.least(t["end"], s["end"]) - F.greatest(t["start"], s["start"])).alias("n"), s["label"].alias("label")))
        most = F.array_max(F.transform(shared, lambda x: x["n"]))
        return F.when(most > 0, F.element_at(F.filter(shared, lambda x: x["n"] == most), 1)["label"])

    return F.transform(tokens, best)


def bio(labels: Column) -> Column:
    """Labels (null for none) with B and I prefixes by the label before."""
    return F.transform(labels, lambda x, i: F.when(x.isNull(), F.lit("O")).when((i > 0) & (F.try_element_at(labels, i) == x), F.concat(F.lit("I-"), x)).otherwise(F.concat(F.lit("B-"), x)))


def repaired(tags: Column) -> Column:
    """I- tags that follow another bucket or O become B-."""

    def fix(t, i):
        before = F.regexp_replace(F.coalesce(F.when(i > 0, F.try_element_at(tags, i)), F.lit("O")), "^[BIES]-", "")
        return F.when(t.startswith("I-") & (before != F.substring(t, 3, 1000)), F.concat(F.lit("B-"), F.substring(t, 3, 1000))).otherwise(t)

    return F.transform(tags, fix)


def entity_spans(tags: Column) -> Column:
    """(type, start, end) runs of BIO or BIOES tags (W11, W12); an I- of another type starts a new run."""
    kind = lambda t: F.when(t != "O", F.substring(t, 3, 1000))
    begins = F.filter(F.transform(tags, lambda t, i: F.when((t != "O") & (t.rlike("^[BS]-") | (i == 0) | (F.coalesce(kind(F.try_element_at(tags, F.greatest(i, F.lit(1)))), F.lit("")) != kind(t)) | F.coalesce(F.try_element_at(tags, F.greatest(i, F.lit(1))), F.lit("O")).rlike("^[ES]-")), i)), lambda i: i.isNotNull())
    outside = F.concat(F.filter(F.transform(tags, lambda t, i: F.when(t == "O", i)), lambda i: i.isNotNull()), begins, F.array(F.size(tags)))
    return F.transform(begins, lambda b: F.struct(F.substring(F.element_at(tags, b + 1), 3, 1000).alias("type"), b.alias("start"), F.array_min(F.filter(outside, lambda o: o > b)).alias("end")))


def packed(sizes: Column, budget: int) -> Column:
    """Group numbers of consecutive pieces filled up to a budget; a larger piece stands alone."""
    start = F.struct(F.lit(-1).alias("g"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(a, n):
        fits = (a["g"] >= 0) & (a["used"] + n <= budget)
        g = F.when(fits, a["g"]).otherwise(a["g"] + 1)
        return F.struct(g.alias("g"), F.when(fits, a["used"] + n).otherwise(n).alias("used"), F.concat(a["out"], F.array(g)).alias("out"))

    return F.aggregate(sizes, start, step)["out"]


def label_map(labels: DataFrame, maps: list[tuple[DataFrame, Column]]) -> DataFrame:
    """Labels mapped by the first of several maps that knows them, else dropped.

    Each map has (label, target) and comes with the key that is looked up in it: the label itself, its folded form, a coarse
    part of it. Spark broadcasts maps while they are small.
    """
    out, targets = labels, []
    for k, (known, key) in enumerate(maps):
        out = out.withColumn(f"_k{k}", key).join(known.select(F.col("label").alias(f"_k{k}"), F.col("target").alias(f"_t{k}")), f"_k{k}", "left")
        targets.append(f"_t{k}")
    return out.withColumn("target", F.coalesce(*targets)).where("target is not null").select(*labels.columns, "target")


def allocation(sizes: DataFrame, group: str, n: str, total: int) -> DataFrame:
    """``total`` shared over groups in proportion to ``n``, one each at least, by largest remainder.

    Only the two sums are taken in one place; the remainders are ranked over ranges.
    """
    ideal = F.lit(total) * F.col(n) / sizes.agg(F.sum(n)).scalar()
    based = sizes.withColumns({"base": F.greatest(F.lit(1), F.floor(ideal)).cast("bigint"), "rest": ideal - F.floor(ideal)})
    placed = ranked(based, [], [F.desc("rest"), F.asc(group)])
    spare = F.lit(total) - placed.agg(F.sum("base")).scalar()
    return placed.withColumn("quota", F.col("base") + F.when(F.col("place") <= spare, 1).otherwise(0)).select(group, n, "quota")


def hash_split(df: DataFrame, key: str, train: float, dev: float, seed: int = 7) -> DataFrame:
    """A split in exact proportions by the rank of a seeded hash."""
    drawn = global_rank(df, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), tie=key)
    total = df.agg(F.count(F.lit(1))).scalar()
    part = F.when(F.col("rank") <= F.floor(total * train), "train").when(F.col("rank") <= F.floor(total * train) + F.floor(total * dev), "dev").otherwise("test")
    return drawn.withColumn("part", part).drop("rank")


def crc_split(key: Column, parts: int = 10) -> Column:
    """A split by number modulo ``parts``, or by CRC-32 where the key is no number."""
    return F.when(key.rlike("^\\d{1,18}$"), key.cast("decimal(20,0)").cast("bigint") % parts).otherwise(F.crc32(key) % parts).cast("int")


def group_split(df: DataFrame, key: str, ratio: float) -> DataFrame:
    """Whole groups drawn for development by the rank of SHA-1 of their key, one at least."""
    groups = df.where(F.col(key).isNotNull()).select(key).distinct()
    drawn = global_rank(groups, F.sha1(F.col(key)), tie=key)
    most = F.greatest(F.lit(1), F.bround(groups.agg(F.count(F.lit(1))).scalar() * ratio, 0))
    return drawn.select(key, F.when(F.col("rank") <= most, "dev").otherwise("train").alias("part"))


def diverse(df: DataFrame, label: str, lang: str, order: str, k: int) -> DataFrame:
    """``k`` examples per label, each language once before any comes again."""
    turns = top_per_group(df, [label, lang], [order], k, "turn")
    return top_per_group(turns, [label], ["turn", lang, order], k)


def frequency_score(tags: Column) -> Column:
    """A 0 to 100 score from the best nfNN band among tags."""
    bands = F.transform(F.filter(tags, lambda t: t.rlike("^nf\\d{2}$")), lambda t: F.substring(t, 3, 2).cast("int"))
    return F.when(F.size(bands) > 0, (F.lit(49) - F.array_min(bands)) / 48 * 100)


def span_scores(gold: DataFrame, pred: DataFrame, on: list[str], label: str) -> DataFrame:
    """label, n_gold, precision, recall, f1 in percent of predicted spans; a span is right when all of ``on`` and the label agree."""
    g, p = gold.select(*on, label).distinct(), pred.select(*on, label).distinct()
    told = g.groupBy(label).agg(F.count(F.lit(1)).alias("n_gold")).join(p.groupBy(label).agg(F.count(F.lit(1)).alias("n_pred")), label, "full")
    right = g.join(p, [*on, label], "left_semi").groupBy(label).agg(F.count(F.lit(1)).alias("n_right"))
    counts = told.join(right, label, "left").na.fill(0, ["n_gold", "n_pred", "n_right"])
    precision = F.when(F.col("n_pred") > 0, 100 * F.col("n_right") / F.col("n_pred")).otherwise(0.0)
    recall = F.when(F.col("n_gold") > 0, 100 * F.col("n_right") / F.col("n_gold")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return counts.select(F.col(label).alias("label"), "n_gold", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1")).orderBy(F.desc("n_gold"), "label")


def split_by_place(df: DataFrame, order: str, train: float, dev: float, total: int | None = None) -> DataFrame:
    """A split by place in the order (O09): the first share trains, the next is held out; ``total`` is a recorded number of rows."""
    placed = ranked(df, [], [F.asc(order)])
    n = F.lit(total) if total is not None else df.agg(F.count(F.lit(1))).scalar()
    part = F.when(F.col("place") <= F.floor(n * train), "train").when(F.col("place") <= F.floor(n * train) + F.floor(n * dev), "dev").otherwise("test")
    return placed.withColumn("part", part).drop("place")


def feats_list(feats: Column, order: list[str]) -> Column:
    """A CoNLL feature string as lower-case values in a fixed key order; of a repeated key the last counts."""
    return feats_values(F.split(F.coalesce(feats, F.lit("")), "\\|"), order)


def feats_values(parts: Column, order: list[str]) -> Column:
    """``feats_list`` of features that are split already."""

    def of(key):
        return F.try_element_at(F.filter(parts, lambda p: p.startswith(key + "=")), F.lit(-1))

    last = [of(k) for k in order]
    return F.concat_ws(";", F.array_compact(F.array(*(F.lower(x.substr(F.lit(len(k) + 2), F.length(x))) for k, x in zip(order, last)))))


def ordered_glosses(items: Column) -> Column:
    """Glosses without repeats: compared without case, width and extra white space, the first spelling kept."""
    key = lambda x: F.lower(F.trim(F.regexp_replace(x, "(?U)\\s+", " ")))
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)
