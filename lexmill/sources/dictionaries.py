"""Readers of published dictionary formats (S10, S11): every one gives source_id, headword, romanization, pos, glosses, forms.

XML comes through Spark's own reader, one row per entry, with a schema of the members used; line formats are read as
blocks of text. All is expressions, so large files split over tasks.

Cases: entries without a headword or gloss are left out; missing members are empty; repeated entries stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import scripts

FEAT = "array<struct<_att:string,_val:string>>"


def _feat(feats, name: str) -> Column:
    """The value of the first feature of a name, or an empty string."""
    return F.coalesce(F.try_element_at(F.filter(feats, lambda f: f["_att"] == name), F.lit(1))["_val"], F.lit(""))


def _texts(items) -> Column:
    """Non-blank texts of an array."""
    return F.coalesce(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def _entries(df: DataFrame) -> DataFrame:
    named = df.withColumn("headword", F.trim(F.coalesce("headword", F.lit("")))).where((F.col("headword") != "") & (F.size("glosses") > 0))
    return named.select("source_id", "headword", F.coalesce("romanization", F.lit("")).alias("romanization"), F.coalesce("pos", F.lit("")).alias("pos"), "glosses", "forms")


def read_jmdict(spark: SparkSession, path: str) -> DataFrame:
    """JMdict: the first spelling, else the first reading; the other spellings and readings are forms."""
    schema = "ent_seq string, k_ele array<struct<keb:string>>, r_ele array<struct<reb:string>>, sense array<struct<pos:array<string>,gloss:array<string>>>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    kanji, kana = (_texts(F.transform(c, lambda x: x[m])) for c, m in ((F.col("k_ele"), "keb"), (F.col("r_ele"), "reb")))
    both = rows.withColumns({"_k": kanji, "_r": kana})
    spelled = F.concat("_k", "_r")
    first = F.try_element_at(spelled, F.lit(1))
    return _entries(
        both.select(
            F.col("ent_seq").alias("source_id"),
            first.alias("headword"),
            F.when(F.size("_k") > 0, F.try_element_at("_r", F.lit(1))).alias("romanization"),
            F.array_join(F.array_distinct(_texts(F.flatten(F.transform("sense", lambda s: F.coalesce(s["pos"], F.array().cast("array<string>")))))), ";").alias("pos"),
            _texts(F.flatten(F.transform("sense", lambda s: F.coalesce(s["gloss"], F.array().cast("array<string>"))))).alias("glosses"),
            F.filter(F.array_distinct(spelled), lambda x: x != first).alias("forms"),
        )
    )


def read_krdict(spark: SparkSession, path: str) -> DataFrame:
    """KRDict in LMF: features by name; the English equivalents are the glosses, conjugated word forms the forms."""
    schema = f"_val string, feat {FEAT}, Lemma struct<feat:{FEAT}>, WordForm array<struct<feat:{FEAT}>>, Sense array<struct<_val:string,feat:{FEAT},Equivalent:array<struct<feat:{FEAT}>>>>"
    rows = spark.read.format("xml").option("rowTag", "LexicalEntry").schema(schema).load(path)
    forms = F.coalesce("WordForm", F.array().cast(f"array<struct<feat:{FEAT}>>"))
    english = lambda s: F.filter(F.coalesce(s["Equivalent"], F.array().cast(f"array<struct<feat:{FEAT}>>")), lambda e: _feat(e["feat"], "language") == "영어")
    gloss = lambda e: F.concat_ws("; ", F.nullif(F.trim(_feat(e["feat"], "lemma")), F.lit("")), F.nullif(F.trim(_feat(e["feat"], "definition")), F.lit("")))
    spoken = F.filter(forms, lambda w: _feat(w["feat"], "type") == "발음")
    return _entries(
        rows.select(
            F.col("_val").alias("source_id"),
            _feat(F.col("Lemma.feat"), "writtenForm").alias("headword"),
            F.try_element_at(F.transform(spoken, lambda w: _feat(w["feat"], "pronunciation")), F.lit(1)).alias("romanization"),
            _feat(F.col("feat"), "partOfSpeech").alias("pos"),
            _texts(F.transform(F.coalesce("Sense", F.array().cast(f"array<struct<_val:string,feat:{FEAT},Equivalent:array<struct<feat:{FEAT}>>>>")), lambda s: F.coalesce(gloss(F.try_element_at(english(s), F.lit(1))), F.lit("")))).alias("glosses"),
            _texts(F.transform(F.filter(forms, lambda w: _feat(w["feat"], "type") == "활용"), lambda w: _feat(w["feat"], "writtenForm"))).alias("forms"),
        )
    )


def read_lsj(spark: SparkSession, path: str) -> DataFrame:
    """LSJ in TEI: beta-code spellings as Greek, translations as glosses; mere cross-references are left out."""
    schema = "_id string, _key string, _type string, orth array<string>, pos array<string>, gen array<string>, sense array<struct<_id:string,tr:array<string>>>, tr array<string>"
    rows = spark.read.format("xml").option("rowTag", "entryFree").schema(schema).load(path)
    found = _texts(F.concat(F.coalesce("tr", F.array().cast("array<string>")), F.coalesce(F.flatten(F.transform("sense", lambda s: F.coalesce(s["tr"], F.array().cast("array<string>")))), F.array().cast("array<string>"))))
    spelled = F.coalesce(F.try_element_at("orth", F.lit(1)), F.col("_key"))
    greek = lambda c: scripts.over(scripts.beta_greek, F.regexp_replace(F.trim(c), ",$", ""))
    told = rows.withColumns({"_head": spelled, "_rest": F.coalesce(F.array_join(F.slice("orth", 2, 1000), "\n"), F.lit(""))})
    return _entries(
        told.select(
            F.col("_id").alias("source_id"),
            greek(F.col("_head")).alias("headword"),
            F.lit("").alias("romanization"),
            F.lower(F.coalesce(F.try_element_at("pos", F.lit(1)), F.when(F.size("gen") > 0, "noun"))).alias("pos"),
            found.alias("glosses"),
            _texts(F.split(greek(F.col("_rest")), "\n")).alias("forms"),
        )
    )


def read_treebank(spark: SparkSession, path: str) -> DataFrame:
    """Treebank sentences as tokens: sent_id, id, form, lemma, xpos, head, deprel; the relation without its suffix."""
    schema = "_id string, word array<struct<_id:string,_form:string,_lemma:string,_postag:string,_head:string,_relation:string>>"
    words = spark.read.format("xml").option("rowTag", "sentence").schema(schema).load(path).select(F.col("_id").alias("sent_id"), F.inline("word"))
    relation = F.split_part(F.coalesce("_relation", F.lit("")), F.lit("_"), F.lit(1))
    return words.select("sent_id", F.col("_id").cast("int").alias("id"), F.col("_form").alias("form"), F.col("_lemma").alias("lemma"), F.col("_postag").alias("xpos"), F.col("_head").cast("int").alias("head"), relation.alias("deprel"))


#: Abbreviations of parts of speech at the head of an entry, the first that is found counts.
ABBREVIATED = {"v\\.": "verb", "adj\\.": "adj", "adv\\.": "adv", "prep\\.": "prep", "pron\\.": "pron", "conj\\.": "conj", "interj\\.": "intj", "num\\.": "num", "(?:m|f|n)\\.": "noun"}


def read_bold_entries(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs that open with a bold headword (as in printed Old English dictionaries): ``<B>head</B>, <I>m.</I> gloss``."""
    blocks = spark.read.text(path, lineSep="\n\n").where("ltrim(value) like '<B>%'")
    bare = F.regexp_replace(F.regexp_replace("value", "<PAGE[^>]*>", ""), "\\s+", " ")
    mark = F.regexp_extract(bare, "<I>(.*?)</I>", 1)
    pos = F.coalesce(*(F.when(mark.rlike("(?<![a-z])" + p), name) for p, name in ABBREVIATED.items()))
    gloss = F.trim(F.regexp_replace(F.regexp_replace(bare, "^\\s*<B>.*?</B>[,;]?\\s*(<I>.*?</I>)?", ""), "<[^>]*>", ""))
    return _entries(blocks.select(F.lit("").alias("source_id"), F.regexp_replace(F.regexp_extract(bare, "<B>(.*?)</B>", 1), "[,;.]+$", "").alias("headword"), F.lit("").alias("romanization"), pos.alias("pos"), _texts(F.split(gloss, ";")).alias("glosses"), F.array().cast("array<string>").alias("forms")))


def read_marked_records(spark: SparkSession, path: str) -> DataFrame:
    """Records between ``<L>`` and ``<LEND>`` with key fields in their first line (as in digitised Sanskrit dictionaries).

    Entries of one key and homonym are one: their glosses follow each other by record number. Records that only refer to another are left out.
    """
    blocks = spark.read.text(path, lineSep="<LEND>").where("value like '%<L>%' and not value rlike '\\\\{\\\\{Lbody='")
    field = lambda n: F.trim(F.regexp_extract("value", f"<{n}>([^<\\n]*)", 1))
    body = F.regexp_replace("value", "^\\s*<L>[^\\n]*\\n?", "")
    head = F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract(body, "<s>([^<]+)</s>", 1), F.lit("")), field("k2")), "[/¦]", "")
    gloss = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(body, "<s>[^<]*</s>|<ls>[^<]*</ls>|<[^>]*>|¦", " "), "\\s+", " ")), "^[ ,;.]+|[ ,;.]+$", "")
    rows = blocks.select(field("L").cast("double").alias("no"), field("k1").alias("key"), field("h").alias("hom"), F.translate(head, "—", "-").alias("head"), F.regexp_extract(body, "<lex>([^<]*)</lex>", 1).alias("lex"), gloss.alias("gloss")).where("key <> '' and gloss <> ''")
    grouped = rows.groupBy("key", "hom").agg(F.min(F.struct("no", "head", "lex")).alias("f"), F.array_sort(F.collect_list(F.struct("no", "gloss"))).alias("g"))
    return _entries(grouped.select(F.col("f.no").cast("string").alias("source_id"), F.col("f.head").alias("headword"), F.col("key").alias("romanization"), F.col("f.lex").alias("pos"), F.transform("g", lambda x: x["gloss"]).alias("glosses"), F.array().cast("array<string>").alias("forms")))


def read_note_table(spark: SparkSession, path: str) -> DataFrame:
    """A TSV of notes with a header (character, pinyin, pos, english and more): senses of one character and reading are one entry."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="", escape="")
    cell = lambda n: F.trim(F.coalesce(F.col(n), F.lit(""))) if n in rows.columns else F.lit("")
    senses = rows.select(cell("traditional").alias("headword"), cell("pinyin").alias("romanization"), F.lower(cell("grammar")).alias("pos"), cell("english").alias("gloss"), F.monotonically_increasing_id().alias("o")).where("headword <> '' and gloss <> ''")
    grouped = senses.groupBy("headword", "romanization", "pos").agg(F.array_sort(F.collect_list(F.struct("o", "gloss"))).alias("g"))
    return _entries(grouped.select(F.lit("").alias("source_id"), "headword", "romanization", "pos", F.array_distinct(F.transform("g", lambda x: x["gloss"])).alias("glosses"), F.array().cast("array<string>").alias("forms")))
