"""Source, sink and stream queries, and their SQL. Files go to the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators import annotations, corpus
from lexmill.plans import analytics
from lexmill.sources import dictionaries, files, load
from lexmill.sources.tables import ensure_checkpoint_dir
from lexmill.streaming import events


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}/{name}"


def s01_tsv_round_trip(spark, d):
    path = _folder(spark, "entries.tsv")
    files.write_tsv(load(spark, d, "entries").select("id", "headword", "pos", "etymology_number"), path)
    back = files.read_tsv(spark, path)
    return back.select(F.col("id").cast("bigint").alias("id"), F.coalesce("headword", F.lit("")).alias("headword"), F.coalesce("pos", F.lit("")).alias("pos"))


def s02_unified(spark, d):
    custom = load(spark, d, "custom_dict_entries").select("id", F.col("headword").alias("word"), F.col("romanization").alias("reading"), "pos", F.col("glosses_json").alias("definitions"), F.col("commentary").alias("notes"))
    return files.unified(custom).groupBy("pos").agg(F.count("headword").alias("n_headwords"), F.count("romanization").alias("n_romanized"), F.count("lemma").alias("n_lemmas"))


def s05_sources(spark, d):
    return files.by_source(load(spark, d, "entries"), "ja", ["ja-none"]).groupBy("db").agg(F.count(F.lit(1)).alias("n"))


def s07_refs(spark, d):
    bags = load(spark, d, "custom_dict_forms").where("entry_pk is not null").select(F.col("id"), F.to_json(F.array(F.struct(F.lit("custom").alias("kind"), F.lower("language").alias("db"), F.col("entry_pk").alias("entry_id"), F.col("id").alias("form_id")))).alias("refs"))
    return files.read_json_refs(bags, "refs")


def s08_dump(spark, d):
    """Dump entries with glosses: their first gloss, and how many senses and forms they keep."""
    rows = files.read_dump(load(spark, d, "kaikki_raw")).where("status = 'ok'")
    return rows.select("rec_id", "word", "pos", "romanization", F.array_join(F.flatten("glosses"), " | ").alias("glosses"), F.size("glosses").alias("n_senses"), F.size("forms").alias("n_forms"), "form_of")


def s08_lines(spark, d):
    """Dump lines by what became of them."""
    return files.read_dump(load(spark, d, "kaikki_raw")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def s08_forms(spark, d):
    """Forms of the dump entries."""
    rows = files.read_dump(load(spark, d, "kaikki_raw")).where("word is not null").select("rec_id", F.posexplode("forms").alias("k", "f"))
    return rows.select("rec_id", "k", "f.form", "f.tags", "f.roman")


def s09_first_lines(spark, d):
    """The first ten dump lines by their number."""
    return files.first_lines(load(spark, d, "kaikki_raw").select("rec_id", "lang_code"), "rec_id", 10)


def s10_jmdict(spark, d):
    """Japanese entries written as JMdict XML and read again."""
    path = _folder(spark, "jmdict")
    rows = load(spark, d, "entries").where("db like 'ja%' and headword <> '' and pos <> ''")
    some = F.struct(F.array(F.col("pos")).alias("pos"), F.array(F.concat(F.lit("gloss "), "id"), F.lit("second")).alias("gloss"))
    xml = rows.select(F.col("id").cast("string").alias("ent_seq"), F.array(F.struct(F.col("headword").alias("keb"))).alias("k_ele"), F.array(F.struct(F.concat("headword", F.lit("x")).alias("reb"))).alias("r_ele"), F.array(some).alias("sense"))
    xml.write.format("xml").option("rowTag", "entry").option("rootTag", "JMdict").save(path)
    return dictionaries.read_jmdict(spark, path).select(F.col("source_id").cast("bigint").alias("id"), "headword", "romanization", "pos", F.array_join("glosses", "|").alias("glosses"), F.array_join("forms", "|").alias("forms"))


def s11_cedict(spark, d):
    """Chinese entries as CEDICT lines, read again."""
    path = _folder(spark, "cedict")
    rows = load(spark, d, "entries").where("db like 'zh%' and headword rlike '^\\\\S+$'")
    rows.select(F.concat("headword", F.lit(" "), "headword", F.lit(" [pin1 yin1] /gloss "), "id", F.lit("/other/"))).write.text(path)
    return files.read_cedict(spark, path).select("traditional", "simplified", "pinyin", F.array_join("glosses", "|").alias("glosses"))


def s12_conllu_round_trip(spark, d):
    w = Window.partitionBy("doc_id").orderBy("pos")
    words = load(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\\s+", " "), " ")).alias("pos", "form")).where("form <> '' and form <> '_'")
    tokens = words.select(F.col("doc_id").cast("string").alias("sent_id"), F.row_number().over(w).alias("id"), "form")
    path = _folder(spark, "docs.conllu")
    files.write_conllu(tokens, path)
    back = files.read_conllu(spark, path)
    return back.groupBy(F.col("sent_id").cast("bigint").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("id").cast("bigint")).alias("last"))


def s14_pruned_scan(spark, d):
    return load(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity")


def s19_sanitized(spark, d):
    """Pages made of the documents, with allowed and other elements, sanitised."""
    page = F.concat(F.lit("<div onclick=x><p lang=en>"), "text", F.lit("</p><script>x < 1</script><!-- y --><font>z</font>"))
    return load(spark, d, "documents").where("text is not null").select("doc_id", files.sanitized(page).alias("html"))


def s19_texts(spark, d):
    """The plain text of such pages."""
    page = F.concat(F.lit("<p>"), "text", F.lit("</p><script>x < 1</script><!-- y -->"))
    return load(spark, d, "documents").where("text is not null").select("doc_id", files.plain_text(page).alias("text"))


def _annotated(spark, d) -> DataFrame:
    rows = annotations.tokens(load(spark, d, "documents")).where("word <> '_'")
    label = F.when(F.col("word").rlike("^[0-9]+[.,]?$"), "B-NUM").otherwise("O")
    return rows.select(F.concat_ws("-", "doc_id", "sent").alias("sent_id"), "id", F.col("word").alias("form"), F.when(F.col("id") == 1, 0).otherwise(F.col("id") - 1).alias("head"), label.alias("label"))


def s13_bio_round_trip(spark, d):
    """Labelled tokens written as blocks and read again: label histogram of the valid sentences."""
    path = _folder(spark, "docs.bio")
    files.write_bio(_annotated(spark, d), path)
    return files.read_bio(spark, path).where("valid").select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def s15_parquet_conllu(spark, d):
    """A token table in Parquet written as CoNLL-U and read again."""
    table, path = _folder(spark, "tokens"), _folder(spark, "tokens.conllu")
    _annotated(spark, d).write.parquet(table)
    files.write_conllu(spark.read.parquet(table), path)
    return files.read_conllu(spark, path).select("sent_id", F.col("id").cast("bigint").alias("id"), "form", F.col("head").cast("bigint").alias("head"))


def s16_vectors(spark, d):
    """Vectors written as text and read for the words of two labels."""
    rows = load(spark, d, "embeddings").where("embedding is not null")
    path = _folder(spark, "words.vec")
    rows.select(F.concat_ws(" ", F.col("vec_id").cast("string"), F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " "))).write.text(path)
    back = files.read_vec(spark, path, rows.where("label in (1, 2)").select(F.col("vec_id").cast("string").alias("word")))
    return back.select(F.col("word").cast("bigint").alias("vec_id"), F.posexplode("v").alias("k", "x")).select("vec_id", "k", F.round("x", 5).alias("x"))


def s17_gzip_tsv(spark, d):
    """A gzip TSV dictionary read again."""
    path = _folder(spark, "dictionary.tsv")
    files.write_tsv(load(spark, d, "entries").select("headword", "pos"), path, compression="gzip")
    return files.read_tsv(spark, path).select(F.coalesce("headword", F.lit("")).alias("headword"), F.coalesce("pos", F.lit("")).alias("pos")).groupBy("headword", "pos").agg(F.count(F.lit(1)).alias("n"))


def k05_report(spark, d):
    """A report with a fixed header, written and read."""
    path = _folder(spark, "report.tsv")
    files.write_tsv(load(spark, d, "entries").groupBy("db", "pos").agg(F.count(F.lit(1)).alias("n")), path)
    return files.read_tsv(spark, path, ["db", "pos", "n"]).select("db", F.coalesce("pos", F.lit("")).alias("pos"), F.col("n").cast("bigint").alias("n")).groupBy("db", "pos").agg(F.sum("n").alias("n"))


def k06_spans(spark, d):
    """Documents with the spans of their quotes as JSON lines, written and read."""
    path = _folder(spark, "spans")
    docs = load(spark, d, "documents").where("text is not null")
    files.write_spans(docs.select("doc_id", "text", corpus.matches_of(F.col("text"), corpus.QUOTES).alias("spans")), path)
    return files.read_spans(spark, path).select("doc_id", F.length("text").alias("n_chars"), F.size("spans").alias("n_spans"))


def k07_exported(spark, d):
    """Custom entries of one source as TSV, read again."""
    path = _folder(spark, "assistant.tsv")
    files.exported(load(spark, d, "custom_dict_entries"), "assistant", path)
    return files.read_tsv(spark, path).select(F.col("id").cast("bigint").alias("id"), "key", F.coalesce("headword", F.lit("")).alias("headword"))


def k01_store(spark, d):
    path = _folder(spark, "store")
    files.write_store(load(spark, d, "entries").select("id", "db", "headword"), path)
    return spark.read.parquet(path).where("db = 'es'").select("id", "headword")


def k02_meta(spark, d):
    """Counts kept per dictionary, those of the forms replaced by those of the entries where there are any."""
    old, new = (load(spark, d, t).where("db is not null").groupBy("db").agg(F.count(F.lit(1)).alias("n")).withColumn("of", F.lit(t)) for t in ("forms", "entries"))
    return files.replaced(old, new, "db")


def k03_inserted(spark, d):
    """The even half of the staged forms, with the rest inserted; ``k03_inserted_forms`` runs on whole tables."""
    stage = load(spark, d, "forms_stage").where("entry_id is not null").select("entry_id", "form_text", "morph_tags")
    half = stage.where("entry_id % 2 = 0").distinct()
    return files.inserted(half, stage, ["entry_id", "form_text", "morph_tags"]).select("entry_id", "form_text", "morph_tags")


def k03_inserted_forms(spark, d):
    """All forms, with the staged forms that they lack."""
    keys = ["entry_id", "form_text", "morph_tags"]
    return files.inserted(load(spark, d, "forms").select(*keys), load(spark, d, "forms_stage").select(*keys), keys)


def k04_index(spark, d):
    index = load(spark, d, "forms").where("form_key <> ''").select(F.lit("form").alias("kind"), F.col("form_key").alias("key"), "db", F.coalesce("entry_id", F.lit(0)).alias("entry_id"), F.col("id").alias("form_id"))
    path = _folder(spark, "index")
    files.write_index(index, path)
    return spark.read.json(path, schema="kind string, key string, postings string").select("key", F.size(F.from_json("postings", "array<struct<db:string>>")).cast("bigint").alias("n"))


def k08_replaced(spark, d):
    """Forms of each seventh custom entry replaced by its headword; ``k08_replaced_all`` replaces those of all entries."""
    have = load(spark, d, "custom_dict_forms").where("entry_pk is not null").select("entry_pk", "form_text")
    new = load(spark, d, "custom_dict_entries").where("id % 7 = 0").select(F.col("id").alias("entry_pk"), F.col("headword").alias("form_text"))
    return files.replaced(have, new, "entry_pk")


def k08_replaced_all(spark, d):
    """Forms of every custom entry replaced by its headword; forms without an entry stay."""
    have = load(spark, d, "custom_dict_forms").select("entry_pk", "form_text")
    new = load(spark, d, "custom_dict_entries").select(F.col("id").alias("entry_pk"), F.col("headword").alias("form_text"))
    return files.replaced(have, new, "entry_pk")


def b05_newest(spark, d):
    """Last write wins per language and headword."""
    return load(spark, d, "custom_dict_entries").where("headword is not null").groupBy(F.lower("language").alias("language"), "headword").agg(F.max_by("id", F.struct("updated_at", "id")).alias("id"))


def _stream(spark, d) -> DataFrame:
    return events.stream(spark, d, load(spark, d, "events").schema)


def str_windows(spark, d):
    got = events.drained_complete(events.windowed(_stream(spark, d)))
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def str_sessions(spark, d):
    got = events.drained_complete(events.sessions(_stream(spark, d)))
    return got.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n").alias("n_events"))


def str_limited(spark, d):
    return events.drained(events.limited(_stream(spark, d), 2, 3600.0))


QUERIES = {f.__name__: f for f in (s01_tsv_round_trip, s02_unified, s05_sources, s07_refs, s08_dump, s08_lines, s08_forms, s09_first_lines, s10_jmdict, s11_cedict, s12_conllu_round_trip, s13_bio_round_trip, s15_parquet_conllu, s16_vectors, s17_gzip_tsv, k05_report, k06_spans, k07_exported, s14_pruned_scan, s19_sanitized, s19_texts, k01_store, k02_meta, k03_inserted, k03_inserted_forms, k04_index, k08_replaced, k08_replaced_all, b05_newest, str_windows, str_sessions, str_limited)}

_DUMP = r"""        with o as (select rec_id, cast(raw as json) as j from (select * from kaikki_raw where json_valid(raw) and trim(raw) <> '') where json_type(raw) = 'OBJECT'),
        w as (select rec_id, j, trim(j->>'$.word') as word from o where json_type(j, '$.word') = 'VARCHAR' and trim(j->>'$.word') <> '')"""
_SENSES = r""",
        s as (select rec_id, unnest(range(len(l))) as k, unnest(l) as s from (select rec_id, case json_type(j, '$.senses') when 'ARRAY' then json_extract(j, '$.senses[*]') when 'OBJECT' then [json_extract(j, '$.senses')] else [] end as l from w)),
        so as (select * from s where json_type(s) = 'OBJECT'),
        g as (select rec_id, k, s, list_filter(list_transform(case when json_type(s, '$.glosses') = 'ARRAY' then json_extract_string(s, '$.glosses[*]') else [] end, lambda x: trim(x)), lambda x: x <> '') as a,
          list_filter(list_transform(case when json_type(s, '$.raw_glosses') = 'ARRAY' then json_extract_string(s, '$.raw_glosses[*]') else [] end, lambda x: trim(x)), lambda x: x <> '') as b from so),
        u as (select rec_id, k, case when len(b) > 0 and (len(a) = 0 or list_sum(list_transform(b, lambda x: length(x))) < list_sum(list_transform(a, lambda x: length(x)))) then b else a end as u from g),
        e as (select rec_id, string_agg(array_to_string(u, ' | '), ' | ' order by k) as glosses, count(*) as n_senses from u where len(u) > 0 group by 1),
        r as (select rec_id, bool_and(coalesce(len(json_extract(s, '$.form_of[*]')) > 0, false) or coalesce(len(json_extract(s, '$.alt_of[*]')) > 0, false) or coalesce(list_has_any(json_extract_string(s, '$.tags[*]'), ['form-of', 'alt-of']), false)) as form_of from so group by 1)"""
_FORMS = r""",
        f as (select rec_id, unnest(range(len(l))) as k, unnest(l) as f from (select rec_id, case json_type(j, '$.forms') when 'ARRAY' then json_extract(j, '$.forms[*]') when 'OBJECT' then [json_extract(j, '$.forms')] else [] end as l from w)),
        fo as (select rec_id, k, trim(coalesce(f->>'$.form', '')) as form, json_type(f, '$.tags') as t, list_filter(coalesce(json_extract_string(f, '$.tags[*]'), []), lambda x: x is not null) as tags, len(coalesce(json_extract(f, '$.tags[*]'), [])) as m, coalesce(f->>'$.roman', '') as roman from f where json_type(f) = 'OBJECT'),
        fk as (select * from fo where form <> '' and coalesce(t, 'NULL') in ('ARRAY', 'NULL') and not (m = 1 and tags = ['romanization']) and not list_has_any(tags, ['table-tags', 'inflection-template']))"""

_TK = r"""
        with sp as (select doc_id, string_split(replace(text, chr(10), ' '), ' ') as l from documents where text is not null), u as (select doc_id, unnest(l) as word, unnest(range(len(l))) as pos from sp),
        p as (select *, cast(coalesce(sum(case when regexp_matches(word, '[.!?]$') then 1 else 0 end) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as sent from u),
        t as (select doc_id || '-' || sent as sent_id, row_number() over (partition by doc_id, sent order by pos) as id, word from p where word <> '')"""

SQL = {
    "k02_meta": "select db, count(*) as n, 'entries' as of from entries where db is not null group by 1 union all select db, count(*), 'forms' from forms where db is not null and db not in (select db from entries where db is not null) group by 1",
    "s10_jmdict": "select id, trim(headword) as headword, trim(headword || 'x') as romanization, trim(pos) as pos, 'gloss ' || id || '|second' as glosses, trim(headword || 'x') as forms from entries where db like 'ja%' and headword <> '' and pos <> ''",
    "s11_cedict": r"select headword as traditional, headword as simplified, 'pin1 yin1' as pinyin, 'gloss ' || id || '|other' as glosses from entries where db like 'zh%' and regexp_matches(headword, '^\S+$')",
    "s13_bio_round_trip": _TK + " select case when regexp_matches(word, '^[0-9]+[.,]?$') then 'B-NUM' else 'O' end as label, count(*) as n from t where word <> '_' group by 1",
    "s15_parquet_conllu": _TK + " select sent_id, id, word as form, case when id = 1 then 0 else id - 1 end as head from t where word <> '_'",
    "s16_vectors": """with u as (select vec_id, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: cast(y as double) * y)))) as v from embeddings where label in (1, 2) and embedding is not null)
        select vec_id, unnest(range(len(v))) as k, round(unnest(v), 5) + 0 as x from u""",
    "s17_gzip_tsv": r"select regexp_replace(coalesce(headword, ''), '[\t\r\n]', ' ', 'g') as headword, regexp_replace(coalesce(pos, ''), '[\t\r\n]', ' ', 'g') as pos, count(*) as n from entries group by 1, 2",
    "k05_report": "select db, coalesce(pos, '') as pos, count(*) as n from entries group by 1, 2",
    "k06_spans": r"select doc_id, length(text) as n_chars, len(regexp_extract_all(text, '“[^”]*”|„[^“]*“|«[^»]*»|\([^)]*\)')) as n_spans from documents where text is not null",
    "k07_exported": "select id, entry_id as key, coalesce(headword, '') as headword from custom_dict_entries where lower(trim(source)) = 'assistant'",
    "s01_tsv_round_trip": r"select id, regexp_replace(coalesce(headword, ''), '[\t\r\n]', ' ', 'g') as headword, regexp_replace(coalesce(pos, ''), '[\t\r\n]', ' ', 'g') as pos from entries",
    "s02_unified": "select pos, count(headword) as n_headwords, count(romanization) as n_romanized, cast(0 as bigint) as n_lemmas from custom_dict_entries group by pos",
    "s05_sources": "select db, count(*) as n from entries where db = 'ja' or db like 'ja-%' group by db",
    "s07_refs": "select 'custom' as kind, lower(language) as db, entry_pk as entry_id, id as form_id from custom_dict_forms where entry_pk is not null",
    "s12_conllu_round_trip": r"""
        with u as (select doc_id, unnest(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ')) as w from documents where text is not null)
        select doc_id, count(*) as n, count(*) as last from u where w <> '' and w <> '_' group by doc_id""",
    "s14_pruned_scan": "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 45",
    "k01_store": "select id, headword from entries where db = 'es'",
    "k03_inserted": "select distinct entry_id, form_text, morph_tags from forms_stage where entry_id is not null",
    "k03_inserted_forms": """
        select entry_id, form_text, morph_tags from forms union all
        select distinct entry_id, form_text, morph_tags from forms_stage s
        where not exists (select 1 from forms f where f.entry_id is not distinct from s.entry_id and f.form_text is not distinct from s.form_text and f.morph_tags is not distinct from s.morph_tags)""",
    "k04_index": "select form_key as key, count(*) as n from forms where form_key <> '' group by 1",
    "k08_replaced": """
        select entry_pk, form_text from custom_dict_forms where entry_pk is not null and entry_pk not in (select id from custom_dict_entries where id % 7 = 0)
        union all select id, headword from custom_dict_entries where id % 7 = 0""",
    "k08_replaced_all": """
        select entry_pk, form_text from custom_dict_forms f where not exists (select 1 from custom_dict_entries e where e.id = f.entry_pk)
        union all select id, headword from custom_dict_entries""",
    "b05_newest": """
        select language, headword, id from (select lower(language) as language, headword, id, row_number() over (partition by lower(language), headword order by updated_at desc nulls last, id desc) as r
        from custom_dict_entries where headword is not null) where r = 1""",
    "str_windows": "select strftime(cast(ts as date), '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "str_sessions": """
        with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as b from events)
        select user_id, cast(sum(b) as bigint) as n_sessions, count(*) as n_events from e group by 1""",
    "s08_dump": _DUMP + _SENSES + _FORMS + r"""
        select w.rec_id, w.word, coalesce(w.j->>'$.pos', '') as pos, coalesce((select arg_min(f.f->>'$.form', f.k) from f where f.rec_id = w.rec_id and json_extract_string(f.f, '$.tags[*]') = ['romanization']), '') as romanization, e.glosses, e.n_senses,
          (select count(*) from fk where fk.rec_id = w.rec_id) as n_forms, coalesce(r.form_of, false) as form_of from w join e using (rec_id) left join r using (rec_id)""",
    "s08_lines": _DUMP + _SENSES + r"""
        select case when k.rec_id in (select rec_id from e) then 'ok' when k.rec_id in (select rec_id from w) then 'no_gloss' when k.rec_id in (select rec_id from o) then 'no_word' when trim(coalesce(raw, '')) = '' then 'blank' else 'unreadable' end as status, count(*) as n from kaikki_raw k group by 1""",
    "s08_forms": _DUMP + _FORMS + r"""
        select rec_id, row_number() over (partition by rec_id order by k) - 1 as k, form, array_to_string(list_sort(tags), ';') as tags, roman from fk""",
    "s09_first_lines": r"""select rec_id, lang_code from kaikki_raw order by rec_id limit 10""",
    "s19_texts": r"""select doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) as text from documents where text is not null""",
    "s19_sanitized": r"""select doc_id, '<div><p lang="en">' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>z</div>' as html from documents where text is not null""",
    "str_limited": f"select event_id, admitted from ({analytics.SQL['b03_limited']})",
}
