"""Queries over nested values and small scalar functions, and their SQL."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from lexmill.functions import exprs, scripts
from lexmill.operators import corpus, prune, unpack
from lexmill.operators.ordering import top_per_group
from lexmill.plans import sqltext
from lexmill.sources import load, spread


def _form_triples(raw: str | None) -> list[dict]:
    """Form, tags and romanization of list or object elements, each triple once; nothing where unreadable."""
    try:
        got = json.loads(raw) if raw else []
    except (ValueError, RecursionError):
        return []
    out = []
    for x in got if isinstance(got, list) else [got]:
        if isinstance(x, dict):
            triple = (x.get("form") or x.get("form_text"), x.get("tags"), x.get("romanization") or x.get("roman"))
        elif isinstance(x, list) and x:
            triple = tuple((list(x) + [None, None])[:3])
        else:
            triple = (x, None, None)
        triple = tuple(";".join(map(str, v)) if isinstance(v, list) else "" if v is None else str(v).strip() for v in triple)
        if triple[0] and triple not in out:
            out.append(triple)
    return [dict(zip(("form", "tags", "roman"), t)) for t in out]


def _triples(column):
    @F.pandas_udf("array<struct<form:string,tags:string,roman:string>>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([_form_triples(v) for v in values], dtype=object)

    return run(column)


def m01_custom_forms(spark, d):
    """Forms in the JSON of custom entries and of the store, one row per triple."""
    rows = spread(load(spark, d, "custom_dict_entries").select(F.lit("custom").alias("store"), "id", F.col("forms_json").alias("raw")).unionByName(load(spark, d, "entries").select(F.lit("entries").alias("store"), "id", F.col("forms").alias("raw"))))
    return rows.select("store", "id", F.inline(_triples(F.col("raw"))))


def m05_form_spellings(spark, d):
    """Every spelling of an entry's forms with the number of rows: one row per pair, as a hot entry has too many for a string."""
    return load(spark, d, "forms").where("entry_id is not null and romanization <> ''").groupBy("entry_id", "romanization").agg(F.count(F.lit(1)).alias("n"))


def m05_form_maps(spark, d):
    """The head of ``m05_form_spellings``: the first 50 spellings of each entry as one sorted string."""
    top = top_per_group(m05_form_spellings(spark, d), ["entry_id"], ["romanization"], 50)
    return top.groupBy("entry_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("romanization", "n"))), lambda x: F.concat_ws("=", x["romanization"], x["n"])), ";").alias("spellings"))


def x13_glosses(spark, d):
    """Number of glosses of an entry before and after repeats are dropped."""
    rows = spread(load(spark, d, "entries").select("id", "glosses")).withColumn("g", prune.glosses(F.col("glosses")))
    return rows.select("id", F.size("g").alias("n"), F.size(corpus.ordered_glosses(F.col("g"))).alias("n_distinct"))


def x19_feats(spark, d):
    """Feature tags (Key=Value) of forms as lower-case values in a fixed key order."""
    rows = unpack.parsed(load(spark, d, "forms").where("morph_tags like '%=%'"), "id", "morph_tags", unpack.TAGS)
    feats = F.filter(F.col("items.val"), lambda t: t.contains("="))
    return rows.select(F.col("row_id").alias("id"), corpus.feats_values(feats, ["Case", "Number", "Tense", "Gender"]).alias("feats")).where("feats <> ''")


def x21_frequency(spark, d):
    """Frequency bands nfNN made from audit counts, as scores."""
    band = F.greatest(F.lit(1), F.lit(48) - F.floor(F.log2(F.coalesce("occurrence_count", F.lit(0)) + 1)))
    tags = F.array(F.concat(F.lit("nf"), F.lpad(band.cast("string"), 2, "0")), F.lit("x"))
    return load(spark, d, "form_tags_flat").where("form_tag is not null").groupBy("form_tag").agg(F.round(F.max(corpus.frequency_score(tags)), 4).alias("score"))


def j06_batch(spark, d):
    """Entries of the store asked for by (language, surface) of the custom entries."""
    asked = load(spark, d, "custom_dict_entries").select(F.lower(F.trim("language")).alias("lang"), "headword").distinct()
    return load(spark, d, "entries").withColumn("lang", exprs.lang_of(F.col("db"))).join(asked, ["lang", "headword"], "left_semi").select("id", "lang", "headword")


def f16_promotable(spark, d):
    tags = F.lower(F.coalesce("morph_tags", F.lit("")))
    usable = (F.trim("form_text") != "") & (F.trim("form_text") != "-") & ~tags.contains("table-tags") & ~tags.contains("inflection-template")
    return load(spark, d, "forms").where("form_text is not null").groupBy("db").agg(F.count_if(usable).alias("n_usable"), F.count(F.lit(1)).alias("n"))


def f20_reclassified(spark, d):
    """Parts of speech after morphological tags have their say: participles count as adjectives."""
    pos = F.when(F.lower("tags").contains("participle"), "adj").otherwise(F.lower(F.trim("pos")))
    return load(spark, d, "entries").groupBy(F.coalesce(pos, F.lit("")).alias("pos")).agg(F.count(F.lit(1)).alias("n"))


def x14_romanised(spark, d):
    """Kana headwords in Latin letters."""
    kana = load(spark, d, "entries").where("headword rlike '[\u3041-\u30ff]'").select("id", "headword")
    return spread(kana).select("id", "headword", scripts.over(scripts.romaji, F.col("headword")).alias("romaji"))


def x15_label_tokens(spark, d):
    """Plain tokens and phrases of the audit tags."""
    rows = load(spark, d, "form_tags_flat").where("form_tag is not null").select("form_tag").distinct()
    return rows.select("form_tag", F.array_join(scripts.plain_tokens(F.col("form_tag")), " ").alias("tokens"), F.array_join(scripts.phrases(F.col("form_tag")), "|").alias("phrases"))


def x20_feats(spark, d):
    """Properties and tags as feature strings."""
    rows = load(spark, d, "events").select(F.col("props").alias("raw")).unionByName(load(spark, d, "custom_dict_entries").select(F.col("glosses_json").alias("raw")))
    return rows.where("raw is not null").select("raw", scripts.over(scripts.feats_text, F.col("raw")).alias("feats")).groupBy("feats").agg(F.count(F.lit(1)).alias("n"))


def x23_fingerprints(spark, d):
    """Fingerprints of the dump records, and how many have each."""
    return spread(load(spark, d, "kaikki_raw").select("raw")).select(scripts.fingerprint(F.col("raw")).alias("fingerprint")).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))


def x23_props(spark, d):
    return load(spark, d, "events").select("event_id", scripts.fingerprint(F.col("props")).alias("fingerprint"))


def x24_clean_glosses(spark, d):
    """Plain glosses with their lead set off."""
    return load(spark, d, "entries").where("glosses <> '' and not glosses rlike '^\\\\s*[\\\\[{]'").select("id", scripts.clean_gloss(F.col("glosses")).alias("gloss"))


QUERIES = {f.__name__: f for f in (x14_romanised, x15_label_tokens, x20_feats, x23_fingerprints, x23_props, x24_clean_glosses, m01_custom_forms, m05_form_maps, m05_form_spellings, x13_glosses, x19_feats, x21_frequency, j06_batch, f16_promotable, f20_reclassified)}

_LATIN = "".join(chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1)
_FOLDED = "lower(translate(regexp_replace(coalesce({0}, ''), '\\p{{M}}+', '', 'g'), '" + _LATIN + "', '" + "".join(unicodedata.normalize("NFD", c)[0] for c in _LATIN) + "'))"


def _plain_tokens(x: str) -> str:
    stem = "case when length(t) > 5 and t like '%ies' then t[:-4] || 'y' when length(t) > 4 and t like '%ses' then t[:-3] when length(t) > 4 and t like '%s' then t[:-2] else t end"
    words = f"list_transform(regexp_extract_all({_FOLDED.format(x)}, '[\\p{{L}}\\p{{N}}_]+'), lambda t: {stem})"
    return f"list_filter({words}, lambda t: length(t) >= 2 and t not in ({sqltext.quoted(scripts.STOPWORDS)}) and not regexp_matches(t, '^\\p{{Nd}}+$'))"


_PHRASES = f"list_filter(list_transform(regexp_split_to_array(form_tag, '[/,;:|(){{}}\\[\\]<>_-]+'), lambda p: array_to_string({_plain_tokens('p')}, ' ')), lambda p: p <> '' and p not in ({sqltext.quoted(scripts.STOPWORDS)}))"

SQL = {
    "x15_label_tokens": f"select distinct form_tag, array_to_string({_plain_tokens('form_tag')}, ' ') as tokens, array_to_string({_PHRASES}, '|') as phrases from form_tags_flat where form_tag is not null",
    "x20_feats": """
        with r as (select props as raw from events union all select glosses_json from custom_dict_entries), t as (select raw, trim(raw) as t from r where raw is not null),
        f as (select case when not (t[1] in ('{', '[') and json_valid(t)) then t when t[1] = '{' then array_to_string(list_transform(json_keys(t), lambda k: k || '=' || (t->>('$."' || k || '"'))), '|')
          else array_to_string(list_filter(list_transform(json_extract_string(t, '$[*]'), lambda x: trim(x)), lambda x: x <> ''), '|') end as feats from t)
        select feats, count(*) as n from f group by 1""",
    "x23_props": """select event_id, case when json_valid(props) then sha256('{' || array_to_string(list_transform(list_sort(json_keys(props)), lambda k: '"' || k || '":' || cast(json_extract(props, '$."' || k || '"') as varchar)), ',') || '}') end as fingerprint from events""",
    "x24_clean_glosses": r"""
        with g as (select id, trim(regexp_replace(glosses, '[""" + sqltext.WS + r"""]+', ' ', 'g')) as raw from entries where glosses <> '' and not regexp_matches(glosses, '^\s*[\[{]')),
        s as (select *, trim(regexp_extract(raw, '^(.*);([^;]*)$', 1)) as a, trim(regexp_extract(raw, '^(.*);([^;]*)$', 2)) as b from g)
        select id, case when not contains(raw, ';') or a = '' or b = '' or contains(b, ' - ') then raw else regexp_extract(a, '^[^\p{L}]*') || upper(regexp_extract(a, '^[^\p{L}]*(\p{L}?)', 1)) || regexp_extract(a, '^[^\p{L}]*\p{L}?(.*)$', 1) || ' - '
          || regexp_extract(b, '^[^\p{L}]*') || lower(regexp_extract(b, '^[^\p{L}]*(\p{L}?)', 1)) || regexp_extract(b, '^[^\p{L}]*\p{L}?(.*)$', 1) end as gloss from s""",
    "x13_glosses": f"with {sqltext.GLOSSES}, n as (select id, count(*) as n, count(distinct lower(trim(regexp_replace(gloss, '[{sqltext.WS}]+', ' ', 'g')))) as m from gl group by 1) select e.id, coalesce(n, 0) as n, coalesce(m, 0) as n_distinct from entries e left join n using (id)",
    "m01_custom_forms": r"""
        with s as (select 'custom' as store, id, forms_json as raw from custom_dict_entries union all select 'entries', id, forms from entries),
        j as (select store, id, cast(raw as json) as j from (select * from s where json_valid(raw) and trim(raw) <> '')),
        v as (select store, id, unnest(case when json_type(j) = 'ARRAY' then json_extract(j, '$[*]') else [j] end) as x from j),
        t as (select store, id, case json_type(x) when 'OBJECT' then coalesce(nullif(x->>'$.form', ''), x->>'$.form_text', '') when 'ARRAY' then coalesce(x->>'$[0]', '') else coalesce(x->>'$', '') end as form,
          case json_type(x) when 'OBJECT' then case when json_type(x, '$.tags') = 'ARRAY' then array_to_string(json_extract_string(x, '$.tags[*]'), ';') else coalesce(x->>'$.tags', '') end when 'ARRAY' then case when json_type(x, '$[1]') = 'ARRAY' then array_to_string(json_extract_string(x, '$[1][*]'), ';') else coalesce(x->>'$[1]', '') end else '' end as tags,
          case json_type(x) when 'OBJECT' then coalesce(nullif(x->>'$.romanization', ''), x->>'$.roman', '') when 'ARRAY' then coalesce(x->>'$[2]', '') else '' end as roman from v)
        select distinct store, id, trim(form) as form, trim(tags) as tags, trim(roman) as roman from t where trim(form) <> ''""",
    "m05_form_spellings": "select entry_id, romanization, count(*) as n from forms where entry_id is not null and romanization <> '' group by 1, 2",
    "m05_form_maps": """
        with c as (select entry_id, romanization, count(*) as n from forms where entry_id is not null and romanization <> '' group by 1, 2),
        r as (select *, row_number() over (partition by entry_id order by romanization) as k from c)
        select entry_id, string_agg(romanization || '=' || n, ';' order by romanization) as spellings from r where k <= 50 group by 1""",
    "x21_frequency": """
        select form_tag, round(max((49 - greatest(1, 48 - floor(log2(coalesce(occurrence_count, 0) + 1)))) / 48 * 100), 4) as score from form_tags_flat where form_tag is not null group by 1""",
    "j06_batch": f"with f as (select id, lower(split_part({sqltext.strip('db')}, '-', 1)) as lang, headword from entries) select id, lang, headword from f where exists (select 1 from custom_dict_entries c where lower(trim(c.language)) = f.lang and c.headword = f.headword)",
    "f16_promotable": """
        select db, count(*) filter (where trim(form_text) <> '' and trim(form_text) <> '-' and lower(coalesce(morph_tags, '')) not like '%table-tags%' and lower(coalesce(morph_tags, '')) not like '%inflection-template%') as n_usable, count(*) as n
        from forms where form_text is not null group by db""",
    "f20_reclassified": "select coalesce(case when lower(tags) like '%participle%' then 'adj' else lower(trim(pos)) end, '') as pos, count(*) as n from entries group by 1",
}
