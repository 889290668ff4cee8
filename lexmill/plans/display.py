"""Queries over what a reader sees of a lookup, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import display, prune
from lexmill.plans import sqltext
from lexmill.sources import load


def _refs(spark, d) -> DataFrame:
    """The staged surfaces and the lemmas of the entries looked up in the whole store."""
    words = load(spark, d, "forms_stage").select(F.col("form_text").alias("word")).unionByName(load(spark, d, "entries").select(F.col("lemma").alias("word")))
    return display.surface_refs(words, load(spark, d, "entries"), load(spark, d, "forms"))


def _shown(spark, d) -> DataFrame:
    return display.payload(_refs(spark, d), load(spark, d, "entries"), load(spark, d, "forms"))


def _sides(spark, d, tags: dict[str, list[str]], dbs: str | None = None, **kinds) -> DataFrame:
    rows = load(spark, d, "entries").where("headword <> ''" + (f" and {dbs}" if dbs else "")).select("id", "db", "headword", "pos", "tags")
    return reduce(DataFrame.unionByName, [display.sides(rows, ["db", "headword"], names, **kinds).select("id", F.lit(tag).alias("tag"), "side") for tag, names in tags.items()])


def f17_upos_sides(spark, d):
    """Entries of each headword split by universal parts of speech."""
    return _sides(spark, d, {t: display.UPOS.get(t, []) for t in ("VERB", "NOUN", "ADP", "none")})


def f18_korean_sides(spark, d):
    return _sides(spark, d, {t: display.KOREAN.get(t, []) for t in ("pvg", "ncn", "jca")}, "db like 'ko%'")


def f18_vietnamese_sides(spark, d):
    return _sides(spark, d, {t: display.VIETNAMESE.get(t, []) for t in ("V", "N")}, "db like 'vi%'", exempt=display.VIETNAMESE_EXEMPT, hide=display.VIETNAMESE_HIDDEN)


def f27_imported_forms(spark, d):
    """Stored forms that an import keeps: none like its headword that is tagged as an alternative, in Korean none like it at all."""
    return display.imported_forms(load(spark, d, "entries"))


def f16_split_pages(spark, d):
    """Headwords of each dictionary that only name a part of a split page."""
    return load(spark, d, "entries").groupBy("db").agg(F.count_if(F.coalesce(F.trim("headword").rlike(prune.SPLIT_PAGE), F.lit(False))).alias("n_pages"), F.count(F.lit(1)).alias("n"))


def f20_pos_names(spark, d):
    """Parts of speech after reclassification, and whether entries are hidden beside others."""
    rows = load(spark, d, "entries").select(display.pos_name(F.col("pos"), F.col("tags")).alias("name"), display.hidden(F.col("pos"), F.col("db")).alias("hidden"))
    return rows.groupBy("name", "hidden").agg(F.count(F.lit(1)).alias("n"))


def m02_matched_forms(spark, d):
    return display.matched_forms(_refs(spark, d), load(spark, d, "forms"))


def m02_special_forms(spark, d):
    return display.special_forms(_refs(spark, d), load(spark, d, "entries"), load(spark, d, "forms"))


def m03_form_rows(spark, d):
    """Form rows of every entry: stored ones of any shape, and special ones."""
    entries = load(spark, d, "entries")
    refs = entries.select(F.col("id").alias("entry_id"))
    return display.display_rows(entries, display.special_forms(refs, entries, load(spark, d, "forms")))


def m04_payload(spark, d):
    return _shown(spark, d).drop("pos", "entry_tags")


def j20_merged(spark, d):
    return display.merged(_shown(spark, d), "VERB").select("word", "ref_key", "match_kind", "side")


QUERIES = {f.__name__: f for f in (f17_upos_sides, f18_korean_sides, f18_vietnamese_sides, f27_imported_forms, f16_split_pages, f20_pos_names, m02_matched_forms, m02_special_forms, m03_form_rows, m04_payload, j20_merged)}

S = sqltext.strip
_LANG = f"lower(split_part({S('db')}, '-', 1))"
_NAME = f"case when regexp_matches(lower(coalesce(tags, '')), '\\bnoun\\b.{{0,10}}\\bverb\\b') then 'noun' else lower({S('pos')}) end"
_HIDDEN = f"(lower({S('pos')}) in ({sqltext.quoted(display.HIDDEN)}) and not (lower({S('pos')}) = 'character' and {_LANG} in ({sqltext.quoted(display.CHARACTER_LANGS)})))"
_VI_HIDDEN = f"(lower({S('pos')}) in ({sqltext.quoted(display.VIETNAMESE_HIDDEN)}))"


def _split(source: str, group: str, allowed: list[str], exempt: list[str], hidden: str, keep: str) -> str:
    fits = f"name in ({sqltext.quoted([*allowed, *exempt])})" if allowed else "true"
    return f"""(
        with t as (select *, {hidden} as hid, {_NAME} as name from {source}),
        f as (select *, {fits} as fits, count(*) filter (where not hid) over (partition by {group}) as n_open from t),
        b as (select *, count(*) filter (where n_open = 0 or not hid) over (partition by {group}) as n, count(*) filter (where (n_open = 0 or not hid) and fits) over (partition by {group}) as n_fit from f)
        select {keep}, case when hid and n_open > 0 then 'other' when n <= 1 or n_fit = 0 or fits then 'primary' else 'other' end as side from b)"""


def _tag_sides(tags: dict[str, list[str]], where: str, exempt=display.EXEMPT, hidden: str = _HIDDEN) -> str:
    return " union all ".join(f"select * from {_split(f'(select * from entries where {where})', 'db, headword', names, exempt, hidden, chr(39) + tag + chr(39) + ' as tag, id')}" for tag, names in tags.items())


_REFS = f"""with a as (select form_text as word from forms_stage where form_text <> '' union select lemma from entries where lemma <> ''),
        m as (select a.word, e.db, e.id as entry_id, 0 as form_id from a join entries e on e.headword = a.word
          union all select a.word, e.db, e.id, f.id from a join forms f on f.form_text = a.word join entries e on e.id = f.entry_id),
        refs as (select word, db, entry_id, min(form_id) as form_id, case when min(form_id) = 0 then 'headword' else 'form' end as match_kind from m group by 1, 2, 3)"""
_SHOWN = f"""{_REFS}, shown as (select r.word, r.db, r.entry_id, r.form_id, concat_ws('|', 'sqlite', r.db, r.entry_id, case when r.form_id > 0 then r.form_id end) as ref_key, r.match_kind,
          case when r.match_kind = 'form' and {S('f.form_text')} <> '' then {S('f.form_text')} else {S('e.headword')} end as display_headword, {S('e.headword')} as lemma_headword,
          case when r.match_kind = 'form' then {S('f.romanization')} else {S('e.romanization')} end as display_reading, case when r.match_kind = 'form' then nullif({S('f.morph_tags')}, '') end as morph_info,
          case when r.match_kind = 'form' then nullif({S('e.headword')}, '') end as morph_base,
          r.match_kind = 'form' and list_has_any(regexp_split_to_array(lower({S('f.morph_tags')}), '[;|,\\s]+'), [{sqltext.quoted(display.ALTERNATE)}]) as is_alternate, e.pos, e.tags
        from refs r join entries e on e.id = r.entry_id left join forms f on f.id = r.form_id)"""
_SPECIAL = f"""select distinct f.entry_id, {S('f.form_text')} as form_text, {S('f.morph_tags')} as tags, {S('f.romanization')} as roman from forms f join entries e on e.id = f.entry_id
          where (regexp_matches(lower(f.morph_tags), '{'|'.join(display.SPECIAL)}') or lower(f.form_text) = lower(e.headword))"""


def _first(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(x->>'$.{n}', '')" for n in names) + ", '')"


SQL = {
    "f17_upos_sides": _tag_sides({t: display.UPOS.get(t, []) for t in ("VERB", "NOUN", "ADP", "none")}, "headword <> ''"),
    "f18_korean_sides": _tag_sides({t: display.KOREAN[t] for t in ("pvg", "ncn", "jca")}, "headword <> '' and db like 'ko%'"),
    "f18_vietnamese_sides": _tag_sides({t: display.VIETNAMESE[t] for t in ("V", "N")}, "headword <> '' and db like 'vi%'", display.VIETNAMESE_EXEMPT, _VI_HIDDEN),
    "f20_pos_names": f"select {_NAME} as name, {_HIDDEN} as hidden, count(*) as n from entries group by 1, 2",
    "m02_matched_forms": f"""{_REFS} select r.word, r.entry_id, {S('f.form_text')} as form_text, {S('f.morph_tags')} as tags, {S('f.romanization')} as roman, min(f.id) as form_id
        from refs r join forms f on f.entry_id = r.entry_id and f.form_text = r.word group by 1, 2, 3, 4, 5""",
    "m02_special_forms": f"{_REFS} select * from ({_SPECIAL}) where entry_id in (select entry_id from refs)",
    "f16_split_pages": f"select db, count(*) filter (where regexp_matches(trim(headword), '{prune.SPLIT_PAGE}')) as n_pages, count(*) as n from entries group by 1",
    "f27_imported_forms": f"""with v as (select id, trim(coalesce(headword, '')) as h, {_LANG} as lang, unnest(json_extract(cast(forms as json), '$[*]')) as x from (select * from entries where json_valid(forms) and forms <> '') where json_type(cast(forms as json)) = 'ARRAY'),
        r as (select distinct id, h, lang, trim(case json_type(x) when 'OBJECT' then {_first('word', 'form', 'headword', 'form_text', 'display_text')} when 'ARRAY' then coalesce(x->>'$[0]', '') else coalesce(x->>'$', '') end) as word,
          trim(case json_type(x) when 'OBJECT' then {_first('commentary', 'tags')} when 'ARRAY' then coalesce(x->>'$[1]', '') else '' end) as tags, trim(case json_type(x) when 'OBJECT' then {_first('romanization', 'reading', 'form_roman')} when 'ARRAY' then coalesce(x->>'$[2]', '') else '' end) as roman from v)
        select id as entry_id, word, tags, roman from r where word <> '' and not (word = h and (lang = 'ko' or list_contains(list_transform(string_split(lower(tags), ';'), lambda t: trim(t)), 'alternative')))""",
    "m03_form_rows": f"""with v as (select id as entry_id, unnest(json_extract(cast(forms as json), '$[*]')) as x from (select * from entries where json_valid(forms) and forms <> '') where json_type(cast(forms as json)) = 'ARRAY'),
        r as (select entry_id, case json_type(x) when 'OBJECT' then {_first('word', 'form', 'headword', 'form_text', 'display_text')} when 'ARRAY' then coalesce(x->>'$[0]', '') else coalesce(x->>'$', '') end as word,
          case json_type(x) when 'OBJECT' then {_first('commentary', 'tags')} when 'ARRAY' then coalesce(x->>'$[1]', '') else '' end as commentary,
          case json_type(x) when 'OBJECT' then {_first('romanization', 'reading', 'form_roman')} when 'ARRAY' then coalesce(x->>'$[2]', '') else '' end as roman from v)
        select entry_id, word, commentary, roman from r union select entry_id, form_text, tags, roman from ({_SPECIAL})""",
    "m04_payload": f"{_SHOWN} select * exclude (pos, tags) from shown",
    "j20_merged": f"""{_SHOWN}, s as (select * from {_split('(select * from shown where not is_alternate)', 'word', display.UPOS['VERB'], display.EXEMPT, _HIDDEN, 'word, ref_key, match_kind')})
        select * from s union all select word, ref_key, match_kind, case when exists (select 1 from shown p where p.word = shown.word and not p.is_alternate) then 'other' else 'primary' end from shown where is_alternate""",
}
