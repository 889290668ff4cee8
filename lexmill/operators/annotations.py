"""Annotated documents as token tables and nested spans.

A token table has one row per token: doc_id, sent, id (from 1 in its sentence), word, start, stop (in the document). What
belongs to a sentence or document is found by windows over it, so a document is the largest thing a task holds.

Cases: null texts have no tokens; a head that isn't in the sentence gives no edge; spans beyond a map's ends are clamped
to the document; empty tables give empty results.
"""

from __future__ import annotations

import difflib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

#: Fixed value: marks that the Arabic model isn't given.
ARABIC_MARKS = "[\u0610-\u061a\u0640\u064b-\u065f\u0670\u06d6-\u06dc\u06df-\u06e4\u06e7-\u06e8\u06ea-\u06ed\u08ca-\u08e1\u08e3-\u08ff]"
_ARABIC_MARK = re.compile(ARABIC_MARKS)


def tokens(documents: DataFrame) -> DataFrame:
    """Blank-divided tokens with their offsets; a sentence ends after a token with a full stop, question or exclamation mark."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    parts = documents.where("text is not null").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\n", " "), " ")).alias("pos", "word"))
    placed = parts.withColumns({"start": F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0)), "sent": F.coalesce(F.sum(F.col("word").rlike("[.!?]$").cast("int")).over(before), F.lit(0))}).where("word <> ''")
    own = Window.partitionBy("doc_id", "sent").orderBy("start")
    return placed.select("doc_id", "sent", F.row_number().over(own).alias("id"), "word", "start", (F.col("start") + F.length("word")).alias("stop"))


def flattened(rows: DataFrame, parts: Column) -> DataFrame:
    """Tokens with multi-word ones replaced by their parts, with absolute spans and new numbers.

    ``parts`` gives consecutive pieces of the token; one piece means a plain token. Adds parent (the number of the
    token it comes from) and part.
    """
    ends = F.transform(F.sequence(F.lit(1), F.size("_p")), lambda k: F.aggregate(F.slice("_p", F.lit(1), k), F.lit(0), lambda a, x: a + F.length(x)))
    flat = rows.withColumn("_p", parts).select("doc_id", "sent", F.col("id").alias("parent"), "start", F.posexplode(F.arrays_zip(F.col("_p").alias("word"), ends.alias("end"))).alias("part", "x"))
    w = Window.partitionBy("doc_id", "sent").orderBy("parent", "part")
    return flat.select("doc_id", "sent", F.row_number().over(w).alias("id"), "parent", "part", F.col("x.word").alias("word"), (F.col("start") + F.col("x.end") - F.length("x.word")).alias("start"), (F.col("start") + F.col("x.end")).alias("stop"))


def collapsed(flat: DataFrame) -> DataFrame:
    """The other way (E04): parts joined to their surface, numbered anew, each headed by the one before it."""
    whole = flat.groupBy("doc_id", "sent", "parent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "word"))), lambda x: x.word), "").alias("word"), F.count(F.lit(1)).alias("n_parts"))
    k = F.row_number().over(Window.partitionBy("doc_id", "sent").orderBy("parent"))
    return whole.select("doc_id", "sent", k.alias("id"), "word", (k - 1).alias("head"), F.when(F.col("n_parts") > 1, "MWT=Yes").otherwise("_").alias("misc"))


def overlay(rows: DataFrame) -> DataFrame:
    """Tokens of a document with their global numbers and those of their heads (T11): token, head_token, is_root.

    ``rows`` has a column head, the number in the sentence, 0 for a root. A head out of range gives neither.
    """
    k = (F.row_number().over(Window.partitionBy("doc_id").orderBy("sent", "id")) - 1).alias("token")
    numbered = rows.select("doc_id", "sent", "id", "head", k)
    heads = numbered.select("doc_id", "sent", F.col("id").alias("head"), F.col("token").alias("head_token"))
    return numbered.join(heads, ["doc_id", "sent", "head"], "left").select("doc_id", "token", "head_token", (F.col("head") == 0).alias("is_root"))


def audited(rows: DataFrame, group: str) -> DataFrame:
    """Per ``group`` (A19): sentences, tokens, heads on themselves and out of range, sentences without one root, multi-word tokens, tags, spans that don't give the word."""
    size = rows.groupBy(group, "doc_id", "sent").agg(F.max("id").alias("_n"), F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.col("head") == 0).alias("roots"), F.count_if(F.col("head") == F.col("id")).alias("selves"), F.count_if("is_mwt").alias("mwt"), F.count_if(F.col("stop") - F.col("start") != F.length("word")).alias("misplaced"), F.max("head").alias("most"), F.collect_set("upos").alias("tags"))
    beyond = rows.join(size.select("doc_id", "sent", "_n"), ["doc_id", "sent"]).where("head > _n or head < 0").groupBy(group).agg(F.count(F.lit(1)).alias("n_beyond"))
    by = size.groupBy(group).agg(F.count(F.lit(1)).alias("n_sentences"), F.sum("n_tokens").alias("n_tokens"), F.sum("selves").alias("n_selves"), F.count_if(F.col("roots") != 1).alias("n_unrooted"), F.sum("mwt").alias("n_mwt"), F.sum("misplaced").alias("n_misplaced"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))), ",").alias("tags"))
    return by.join(beyond, group, "left").withColumn("n_beyond", F.coalesce("n_beyond", F.lit(0)))


def counted(rows: DataFrame) -> DataFrame:
    """Sentences, tokens, entities and edges of each document (A17); ``rows`` has ner (BIO) and head."""
    return rows.groupBy("doc_id").agg(F.countDistinct("sent").alias("n_sentences"), F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.col("ner").startswith("B-")).alias("n_entities"), F.count_if(F.col("head") > 0).alias("n_edges"))


def bioes(rows: DataFrame, group: list[str], order: str, tag: str) -> DataFrame:
    """BIO tags told apart by the tag after them (E04): the last of a run becomes E-, a run of one S-."""
    after = F.coalesce(F.lead(tag).over(Window.partitionBy(*group).orderBy(order)), F.lit("O"))
    goes_on = after == F.concat(F.lit("I-"), F.substring(tag, 3, 1000))
    new = F.when(F.col(tag) == "O", F.col(tag)).when(goes_on, F.col(tag)).otherwise(F.concat(F.when(F.col(tag).startswith("B-"), "S-").otherwise("E-"), F.substring(tag, 3, 1000)))
    return rows.withColumn(tag, new)


def zipped(left: DataFrame, right: DataFrame, chunk: str, row: str, text: str) -> DataFrame:
    """Two row-wise annotations of chunks held against each other by position.

    Per chunk: rows of both, equal rows, and the first row that differs or is missing; null where they agree.
    """
    a, b = (df.select(chunk, row, F.col(text).alias(n), F.lit(True).alias(f"has_{n}")) for df, n in ((left, "a"), (right, "b")))
    both = a.join(b, [chunk, row], "full")
    same = F.coalesce(F.col("has_a") & F.col("has_b") & F.col("a").eqNullSafe(F.col("b")), F.lit(False))
    return both.groupBy(chunk).agg(F.count("has_a").alias("n_left"), F.count("has_b").alias("n_right"), F.count_if(same).alias("n_equal"), F.min(F.when(~same, F.col(row))).alias("first_difference"))


def best_runs(runs: DataFrame, chunk: str, valid: str, size: str, retry: str) -> DataFrame:
    """The run of each chunk to keep (W07): of those that aren't empty the valid ones before others, then the largest, then the latest."""
    rank = F.struct(F.col(valid).cast("int"), F.col(size), F.col(retry))
    return runs.where(F.col(size) > 0).groupBy(chunk).agg(F.max_by(F.struct(*runs.columns), rank).alias("b")).select("b.*")


def agreement_kinds(rows: DataFrame, left: Column, right: Column) -> Column:
    """How two segmentations of a word agree."""
    return F.when(left.isNull() & right.isNull(), "none").when(left.isNull(), "right_only").when(right.isNull(), "left_only").when((F.size(left) <= 1) & (F.size(right) <= 1), "both_unsplit").when(left == right, "same").otherwise("different")


def _moved(c: Column, kind: DataType, named: set[str], move) -> Column:
    if isinstance(kind, StructType):
        fields = []
        for f in kind.fields:
            own = c.getField(f.name)
            fields.append((move(own) if f.name in named else _moved(own, f.dataType, named, move)).alias(f.name))
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _moved(x, kind.elementType, named, move))
    return c


def shifted(df: DataFrame, column: str, offset: Column, names: tuple[str, ...] = ("span", "dspan")) -> DataFrame:
    """Every [start, end] under one of ``names``, however deep in the column's structure, moved by ``offset``."""
    return df.withColumn(column, _moved(F.col(column), df.schema[column].dataType, set(names), lambda s: F.transform(s, lambda x: x + offset)))


def remapped(df: DataFrame, column: str, places: Column, length: Column, names: tuple[str, ...] = ("span", "dspan")) -> DataFrame:
    """Such spans over a shortened text carried back to the original (M07): ``places`` has the original place of every character kept."""
    n = F.size(places)

    def move(s):
        start = F.least(F.greatest(s[0], F.lit(0)), n)
        end = F.least(F.greatest(s[1], start), n)
        first = F.when(start >= n, length).otherwise(F.try_element_at(places, start + 1))
        last = F.when(end <= 0, first).otherwise(F.try_element_at(places, end) + 1)
        return F.when(n == 0, F.array(F.lit(0), F.lit(0))).otherwise(F.array(first, F.greatest(first, last)))

    return df.withColumn(column, _moved(F.col(column), df.schema[column].dataType, set(names), move))


def kept_places(text: str | None, strip_marks: bool, strip_punctuation: bool) -> tuple[str, list[int]]:
    """A text as a language's model is given it, with the place of every character kept (X11): no character beyond the basic plane, and
    without Arabic marks or without anything but letters, marks, numbers and white space."""
    text = text or ""
    out, places = [], []
    for k, c in enumerate(text):
        if ord(c) > 0xFFFF or (strip_marks and _ARABIC_MARK.match(c)) or (strip_punctuation and not (c.isspace() or unicodedata.category(c)[0] in "LMN")):
            continue
        out.append(c)
        places.append(k)
    return "".join(out), places


def model_text(text: Column, lang: Column, strip_punctuation: Column) -> Column:
    """``kept_places`` as a vectorised column: text, places."""

    @F.pandas_udf("struct<text:string,places:array<int>>")
    def run(texts: pd.Series, langs: pd.Series, strips: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kept_places(t, g == "ar", bool(s)) for t, g, s in zip(texts, langs, strips)], columns=["text", "places"])

    return run(text, lang, strip_punctuation)


def merged_sentences(rows: DataFrame) -> DataFrame:
    """Sentences of the chunks of a document as one list, numbered anew (T19): ``rows`` has doc_id, chunk, sent."""
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk", "sent"))
    return rows.withColumn("sent_id", k)


def repaired_labels(given: list[str], out: list[tuple[str, str]]) -> tuple[list[str], list[dict]]:
    """Labels of annotated rows carried to the given tokens, with a log of what was mended."""
    labels, log = ["O"] * len(given), []
    matcher = difflib.SequenceMatcher(None, given, [t for t, _ in out], autojunk=False)
    for op, a, b, c, d in matcher.get_opcodes():
        told = [label or "O" for _, label in out[c:d]]
        if op == "insert":
            kind = "extra_rows_dropped"
        elif op == "delete":
            kind = "missing_rows_are_O"
        else:
            one = len(told) == 1 and b - a > 1
            for k in range(b - a):
                labels[a + k] = told[0] if one else told[k] if k < len(told) else "O"
            kind = "one_row_for_several" if one else "other_spelling" if b - a == d - c else "by_position"
        if op != "equal":
            log.append({"fix": kind, "first": a + 1, "last": b, "out_first": c + 1, "out_last": d, "tokens": json.dumps([t for t, _ in out[c:d]], ensure_ascii=False)})
    return labels, log


REPAIR = "struct<labels:array<string>,log:array<struct<fix:string,first:int,last:int,out_first:int,out_last:int,tokens:string>>>"


def repaired_column(given: Column, words: Column, labels: Column) -> Column:
    """``repaired_labels`` as a vectorised column."""

    @F.pandas_udf(REPAIR)
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([repaired_labels(list(x), list(zip(y, z))) for x, y, z in zip(a, b, c)], columns=["labels", "log"])

    return run(given, words, labels)
