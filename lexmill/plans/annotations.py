"""Queries over annotated documents, and their SQL.

The annotation is made from the documents by rule: blank-divided tokens, a head per token by arithmetic (some out of
range, as an audit needs them), tags by shape. The operators take any such tables.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.exprs import lang_of
from lexmill.operators import alignment, annotations, inflection
from lexmill.plans import sqltext
from lexmill.sources import load, spread


def _docs(spark, d) -> DataFrame:
    return load(spark, d, "documents").where("text is not null")


def _annotated(spark, d) -> DataFrame:
    own = Window.partitionBy("doc_id", "sent")
    rows = annotations.tokens(_docs(spark, d)).withColumn("n", F.count(F.lit(1)).over(own))
    word = F.col("word")
    upos = F.when(~word.rlike("[\\p{L}\\p{N}]"), "PUNCT").when(word.rlike("^[0-9]+[.,]?$"), "NUM").when((F.col("id") > 1) & word.rlike("^[A-Z][a-z]+"), "PROPN").otherwise("X")
    rows = rows.withColumns({"upos": upos, "head": F.when(F.col("id") == 1, 0).otherwise((F.length("word") * 7 + F.col("id")) % (F.col("n") + 2)).cast("int"), "is_mwt": word.rlike("\\p{L}-\\p{L}")})
    before = F.lag("upos", 1, "").over(own.orderBy("id"))
    return rows.withColumn("ner", F.when(F.col("upos") != "PROPN", "O").when(before == "PROPN", "I-NAME").otherwise("B-NAME"))


def _lines(spark, d) -> DataFrame:
    """The lines of the documents as chunks: doc_id, chunk, text, offset."""
    w = Window.partitionBy("doc_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk", "text"))
    return rows.withColumn("offset", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("int"))


def _chunk_tokens(spark, d) -> DataFrame:
    lines = _lines(spark, d)
    rows = annotations.tokens(lines.select(F.struct("doc_id", "chunk", "offset").alias("doc_id"), "text"))
    return rows.select("doc_id.doc_id", "doc_id.chunk", "doc_id.offset", "sent", "id", "word", "start", "stop")


def _parts(word):
    return F.regexp_extract_all(word, F.lit("([^-]*-+|[^-]+)"), F.lit(1))


def t10_flat_tokens(spark, d):
    """Tokens of hyphened words taken apart, with absolute spans."""
    return annotations.flattened(annotations.tokens(_docs(spark, d)), _parts(F.col("word")))


def e04_collapsed(spark, d):
    """The same put together again, numbered anew."""
    return annotations.collapsed(t10_flat_tokens(spark, d))


def t11_overlay(spark, d):
    return annotations.overlay(_annotated(spark, d))


def a17_counts(spark, d):
    return annotations.counted(_annotated(spark, d))


def a18_labels(spark, d):
    """Label histogram of the tags."""
    return _annotated(spark, d).groupBy(F.col("ner").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def a19_corpus_audit(spark, d):
    """The annotation audited by language."""
    langs = load(spark, d, "documents").select("doc_id", F.coalesce(F.lower(F.trim("lang")), F.lit("")).alias("lang"))
    return annotations.audited(_annotated(spark, d).join(langs, "doc_id"), "lang")


def e04_bioes(spark, d):
    return annotations.bioes(_annotated(spark, d).select("doc_id", "sent", "id", "ner"), ["doc_id", "sent"], "id", "ner")


def m06_shifted(spark, d):
    """Token spans of chunks moved to their place in the document."""
    nested = _chunk_tokens(spark, d).groupBy("doc_id", "chunk", "offset").agg(F.array_sort(F.collect_list(F.struct("start", F.array(F.col("start").cast("int"), F.col("stop").cast("int")).alias("span"), "word"))).alias("tokens"))
    moved = annotations.shifted(nested.select("doc_id", "chunk", "offset", F.array(F.struct(F.lit(1).alias("id"), "tokens")).alias("sentences")), "sentences", F.col("offset"))
    return moved.select("doc_id", "chunk", F.explode(F.flatten("sentences.tokens")).alias("t")).select("doc_id", "chunk", "t.word", F.col("t.span")[0].alias("start"), F.col("t.span")[1].alias("stop"))


def m07_remapped(spark, d):
    """Words of the documents without punctuation, with their spans in the whole text."""
    model = spread(_docs(spark, d).select("doc_id", "text")).select("doc_id", F.length("text").alias("n"), annotations.model_text(F.col("text"), F.lit(""), F.lit(True)).alias("m")).select("doc_id", "n", "m.text", "m.places")
    spans = annotations.tokens(model.select("doc_id", "text")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.array(F.col("start").cast("int"), F.col("stop").cast("int")).alias("span"), "word"))).alias("tokens"))
    back = annotations.remapped(spans.join(model.select("doc_id", "n", "places"), "doc_id"), "tokens", F.col("places"), F.col("n"))
    return back.select("doc_id", F.explode("tokens").alias("t")).select("doc_id", "t.word", F.col("t.span")[0].alias("start"), F.col("t.span")[1].alias("stop"))


def x11_model_texts(spark, d):
    """Headwords as the models of their languages are given them; Sanskrit and Literary Chinese without punctuation."""
    lang = lang_of(F.col("db"))
    rows = spread(load(spark, d, "entries").where("headword is not null").select("id", "db", "headword"))
    return rows.select("id", annotations.model_text(F.col("headword"), lang, lang.isin("sa", "lzh")).alias("m")).select("id", "m.text", F.size("m.places").alias("n_kept"))


def t12_normalised(spark, d):
    """Headwords in compatibility form with the place of every character."""
    rows = spread(load(spark, d, "entries").where("headword is not null").select("id", "headword"))
    return rows.select("id", alignment.normalised_column(F.col("headword")).alias("m")).select("id", "m.text", F.array_join(F.transform("m.places", lambda x: x.cast("string")), ",").alias("places"))


def t13_repaired(spark, d):
    """Labels of tokens without their full stops carried to the tokens of the documents, and what was mended."""
    rows = _annotated(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "word", "ner"))).alias("t"))
    given = F.transform("t", lambda x: x.word)
    out = F.transform("t", lambda x: F.regexp_replace(x.word, "[.!?]+$", ""))
    fixed = rows.select("doc_id", annotations.repaired_column(given, out, F.transform("t", lambda x: x.ner)).alias("r"))
    return fixed.select("doc_id", F.size(F.filter("r.labels", lambda x: x != "O")).alias("n_labelled"), F.size("r.log").alias("n_fixes"))


def t14_slots(spark, d):
    """The words of the held-out items put back to their places: a slot per word, its places in the item as candidates."""
    rows = load(spark, d, "heldout_items").where("text is not null").select("item_id", F.filter(F.split("text", "\\s+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)

    def run(batches):
        for batch in batches:
            slots = [[[(str(p), p) for p, x in enumerate(own) if x == w] for w in own] for own in map(list, batch["w"])]
            filled = [sum(map(bool, alignment.beam(s))) for s in slots]
            yield pd.DataFrame({"item_id": batch["item_id"], "n_slots": [len(s) for s in slots], "n_filled": filled})

    return rows.mapInPandas(run, "item_id bigint, n_slots int, n_filled int")


def t15_drift(spark, d):
    """How many tokens two tokenisations share in order, looking three ahead."""
    rows = _docs(spark, d).select("doc_id", F.split("text", "\\s+").alias("a"), F.split(F.regexp_replace("text", "([.,;:!?])", " $1"), "\\s+").alias("b"))
    return spread(rows).select("doc_id", F.size(alignment.drift_column(F.col("a"), F.col("b"))).alias("n_pairs"))


def t16_batches(spark, d):
    """Documents' sentence lengths in batches of least padded cost."""
    sizes = annotations.tokens(_docs(spark, d)).groupBy("doc_id", "sent").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.col("n").cast("int"))).alias("l"))
    return sizes.select("doc_id", F.posexplode(alignment.batches_column(F.col("l"), 4, 8)).alias("batch", "b")).select("doc_id", "batch", "b.start", "b.end")


def t17_surface_parts(spark, d):
    """Hyphened or divided headwords against the parts of their lemma or of themselves."""
    rows = load(spark, d, "entries").where("headword rlike '[^ -][ -]+[^ -]'").select("id", F.regexp_replace("headword", "[ -]+", "").alias("s"), F.filter(F.split("headword", "[ -]+"), lambda p: p != "").alias("p"))
    got = spread(rows).select("id", alignment.surface_parts_column(F.col("s"), F.col("p")).alias("a"))
    return got.select("id", "a.basis", F.posexplode("a.groups").alias("k", "g")).select("id", "basis", "k", "g.start", "g.end", F.array_join(F.transform("g.parts", lambda x: x.cast("string")), ",").alias("parts"))


def t18_forms(spark, d):
    """Inflected forms of the Japanese headwords that look like verbs and adjectives, and which of them stand among the surfaces."""
    heads = load(spark, d, "entries").where("db like 'ja%' and headword rlike '[うくぐすつぬぶむるい]$'").select(F.col("headword").alias("lemma"), F.when(F.col("headword").endswith("い"), "i-adj").otherwise("verb").alias("pos")).distinct()
    table = inflection.inflected(heads)
    seen = load(spark, d, "forms").where("db like 'ja%'").select(F.col("form_text").alias("form")).distinct().withColumn("seen", F.lit(1))
    return table.join(seen, "form", "left").groupBy("pos", "tags").agg(F.count(F.lit(1)).alias("n"), F.count("seen").alias("n_seen"))


def t19_merged(spark, d):
    """Sentences of the lines of a document numbered anew."""
    sentences = _chunk_tokens(spark, d).groupBy("doc_id", "chunk", "sent").agg(F.count(F.lit(1)).alias("n_tokens"))
    return annotations.merged_sentences(sentences)


def j11_zipped(spark, d):
    """The tokens of the documents against themselves without full stops, row by row."""
    rows = annotations.tokens(_docs(spark, d)).select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("start")).alias("row_no"), "word")
    return annotations.zipped(rows, rows.withColumn("word", F.regexp_replace("word", "[.!?]+$", "")).where("word <> ''"), "doc_id", "row_no", "word")


def w07_best_runs(spark, d):
    """Of the documents of a work the best one: right in length before others, then with most names, then the latest."""
    names = F.size(F.regexp_extract_all("text", F.lit("\\b([A-Z][a-z]+)"), F.lit(1)))
    runs = _docs(spark, d).where("work_id is not null").select("work_id", "doc_id", (F.coalesce(F.col("n_chars") == F.length("text"), F.lit(False))).alias("valid"), names.alias("n_names"))
    return annotations.best_runs(runs, "work_id", "valid", "n_names", "doc_id")


def e03_agreement(spark, d):
    """How headwords and their keys agree in their parts, by dictionary."""
    rows = load(spark, d, "entries").select("db", F.split("headword", "[ -]+").alias("a"), F.split("headword_key", "[ -]+").alias("b"))
    return rows.groupBy("db", annotations.agreement_kinds(rows, F.col("a"), F.col("b")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (t10_flat_tokens, e04_collapsed, t11_overlay, a17_counts, a18_labels, a19_corpus_audit, e04_bioes, m06_shifted, m07_remapped, x11_model_texts, t12_normalised, t13_repaired, t14_slots, t15_drift, t16_batches, t17_surface_parts, t18_forms, t19_merged, j11_zipped, w07_best_runs, e03_agreement)
}


def _tokens(source: str, key: str) -> str:
    """Blank-divided tokens of ``source`` (key columns, text) as ``tk``."""
    before = f"over (partition by {key} order by pos rows between unbounded preceding and 1 preceding)"
    return rf"""
        sp as (select {key}, string_split(replace(text, chr(10), ' '), ' ') as l from {source} where text is not null),
        u as (select {key}, unnest(l) as word, unnest(range(len(l))) as pos from sp),
        p as (select *, cast(coalesce(sum(length(word) + 1) {before}, 0) as bigint) as start, cast(coalesce(sum(case when regexp_matches(word, '[.!?]$') then 1 else 0 end) {before}, 0) as bigint) as sent from u),
        tk as (select {key}, sent, row_number() over (partition by {key}, sent order by start) as id, word, start, start + length(word) as stop from p where word <> '')"""


_TK = "with " + _tokens("documents", "doc_id")
_AN = _TK + r""",
        an0 as (select *, count(*) over (partition by doc_id, sent) as n, case when not regexp_matches(word, '[\p{L}\p{N}]') then 'PUNCT' when regexp_matches(word, '^[0-9]+[.,]?$') then 'NUM' when id > 1 and regexp_matches(word, '^[A-Z][a-z]+') then 'PROPN' else 'X' end as upos from tk),
        an as (select *, case when id = 1 then 0 else (length(word) * 7 + id) % (n + 2) end as head, regexp_matches(word, '\p{L}-\p{L}') as is_mwt,
          case when upos <> 'PROPN' then 'O' when lag(upos, 1, '') over (partition by doc_id, sent order by id) = 'PROPN' then 'I-NAME' else 'B-NAME' end as ner from an0)"""
_CHUNKS = """with ln as (select doc_id, unnest(l) as text, unnest(range(len(l))) as chunk from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)),
        lo as (select *, cast(coalesce(sum(length(text) + 1) over (partition by doc_id order by chunk rows between unbounded preceding and 1 preceding), 0) as bigint) as offs from ln),""" + _tokens("lo", "doc_id, chunk, offs")
_FLAT = _TK + r""",
        fp as (select *, regexp_extract_all(word, '[^-]*-+|[^-]+') as l from tk),
        fq as (select doc_id, sent, id as parent, start, unnest(l) as w, unnest(range(len(l))) as part from fp),
        fr as (select doc_id, sent, parent, part, w, cast(start + coalesce(sum(length(w)) over (partition by doc_id, sent, parent order by part rows between unbounded preceding and 1 preceding), 0) as bigint) as start from fq),
        flat as (select doc_id, sent, row_number() over (partition by doc_id, sent order by parent, part) as id, parent, part, w as word, start, start + length(w) as stop from fr)"""
_PLAIN = f"[^\\p{{L}}\\p{{M}}\\p{{N}}{sqltext.WS}]"

SQL = {
    "t14_slots": r"with w as (select item_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as n from heldout_items where text is not null) select item_id, n as n_slots, n as n_filled from w where n > 0",
    "t17_surface_parts": """
        with s as (select id, list_filter(regexp_split_to_array(headword, '[ -]+'), lambda p: p <> '') as l from entries where regexp_matches(headword, '[^ -][ -]+[^ -]')),
        u as (select id, unnest(range(len(l))) as k, unnest(l) as p from s), e as (select id, k, p, sum(length(p)) over (partition by id order by k) as stop from u)
        select id, 'exact' as basis, k, cast(stop - length(p) as bigint) as start, cast(stop as bigint) as "end", cast(k as varchar) as parts from e""",
    "t10_flat_tokens": _FLAT + " select * from flat",
    "e04_collapsed": _FLAT + """, g as (select doc_id, sent, parent, string_agg(word, '' order by part) as word, count(*) as k from flat group by 1, 2, 3), r as (select *, row_number() over (partition by doc_id, sent order by parent) as id from g)
        select doc_id, sent, id, word, id - 1 as head, case when k > 1 then 'MWT=Yes' else '_' end as misc from r""",
    "t11_overlay": _AN + """, g as (select *, row_number() over (partition by doc_id order by sent, id) - 1 as token from an)
        select a.doc_id, a.token, h.token as head_token, a.head = 0 as is_root from g a left join g h on h.doc_id = a.doc_id and h.sent = a.sent and h.id = a.head""",
    "a17_counts": _AN + " select doc_id, count(distinct sent) as n_sentences, count(*) as n_tokens, count(*) filter (where ner like 'B-%') as n_entities, count(*) filter (where head > 0) as n_edges from an group by 1",
    "a18_labels": _AN + " select ner as label, count(*) as n from an group by 1",
    "a19_corpus_audit": _AN + """, l as (select an.*, coalesce(lower(trim(d.lang)), '') as lang from an join documents d using (doc_id)),
        s as (select lang, doc_id, sent, count(*) as k, count(*) filter (where head = 0) as roots, count(*) filter (where head = id) as selves, count(*) filter (where is_mwt) as mwt, count(*) filter (where head > n or head < 0) as beyond from l group by 1, 2, 3)
        select lang, count(*) as n_sentences, cast(sum(k) as bigint) as n_tokens, cast(sum(selves) as bigint) as n_selves, count(*) filter (where roots <> 1) as n_unrooted, cast(sum(mwt) as bigint) as n_mwt, 0 as n_misplaced,
          (select string_agg(distinct upos, ',' order by upos) from l where l.lang = s.lang) as tags, cast(sum(beyond) as bigint) as n_beyond from s group by 1""",
    "e04_bioes": _AN + """, b as (select doc_id, sent, id, ner, lead(ner, 1, 'O') over (partition by doc_id, sent order by id) as nx from an)
        select doc_id, sent, id, case when ner = 'O' or nx = 'I-' || substr(ner, 3) then ner when ner like 'B-%' then 'S-' || substr(ner, 3) else 'E-' || substr(ner, 3) end as ner from b""",
    "m06_shifted": _CHUNKS + " select doc_id, chunk, word, offs + start as start, offs + stop as stop from tk",
    "m07_remapped": f"""with ch as (select doc_id, string_split(text, '') as c from documents where text is not null and text <> ''),
        pl as (select doc_id, c, list_filter(range(len(c)), lambda i: not regexp_matches(c[i + 1], '{_PLAIN}') and ord(c[i + 1]) <= 65535) as k from ch),
        mt as (select doc_id, k, array_to_string(list_transform(k, lambda i: c[i + 1]), '') as text from pl),{_tokens('mt', 'doc_id')}
        select tk.doc_id, word, k[start + 1] as start, k[stop] + 1 as stop from tk join mt using (doc_id)""",
    "x11_model_texts": f"""with t as (select id, case when {sqltext.strip('db')} similar to 'ar(-.*)?' then regexp_replace(headword, '[\\x{{610}}-\\x{{61A}}\\x{{640}}\\x{{64B}}-\\x{{65F}}\\x{{670}}\\x{{6D6}}-\\x{{6DC}}\\x{{6DF}}-\\x{{6E4}}\\x{{6E7}}-\\x{{6E8}}\\x{{6EA}}-\\x{{6ED}}\\x{{8CA}}-\\x{{8E1}}\\x{{8E3}}-\\x{{8FF}}]', '', 'g')
          when {sqltext.strip('db')} similar to '(sa|lzh)(-.*)?' then regexp_replace(headword, '{_PLAIN}', '', 'g') else headword end as text from entries where headword is not null),
        b as (select id, regexp_replace(text, '[\\x{{10000}}-\\x{{10FFFF}}]', '', 'g') as text from t) select id, text, length(text) as n_kept from b""",
    "t19_merged": _CHUNKS + ", s as (select doc_id, chunk, sent, count(*) as n_tokens from tk group by 1, 2, 3) select *, row_number() over (partition by doc_id order by chunk, sent) as sent_id from s",
    "j11_zipped": _TK + r""", a as (select doc_id, row_number() over (partition by doc_id order by start) as k, word as a from tk), b as (select doc_id, k, regexp_replace(a, '[.!?]+$', '') as b from a where regexp_replace(a, '[.!?]+$', '') <> '')
        select doc_id, count(a) as n_left, count(b) as n_right, count(*) filter (where a = b) as n_equal, min(case when a is distinct from b then k end) as first_difference from a full join b using (doc_id, k) group by 1""",
    "w07_best_runs": r"""with r as (select work_id, doc_id, coalesce(n_chars = length(text), false) as valid, len(regexp_extract_all(text, '\b([A-Z][a-z]+)')) as n_names from documents where text is not null and work_id is not null)
        select * exclude (k) from (select *, row_number() over (partition by work_id order by valid desc, n_names desc, doc_id desc) as k from r where n_names > 0) where k = 1""",
    "e03_agreement": """with s as (select db, regexp_split_to_array(headword, '[ -]+') as a, regexp_split_to_array(headword_key, '[ -]+') as b from entries)
        select db, case when a is null and b is null then 'none' when a is null then 'right_only' when b is null then 'left_only' when len(a) <= 1 and len(b) <= 1 then 'both_unsplit' when a = b then 'same' else 'different' end as kind, count(*) as n from s group by 1, 2""",
}
