"""Queries of the general data-quality problems 3 to 6, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import nested, references, skew, unpack
from lexmill.sources import load


def _orphans(spark, d) -> DataFrame:
    forms, stage, custom = load(spark, d, "forms"), load(spark, d, "forms_stage"), load(spark, d, "custom_dict_forms")
    refs = [
        ("forms", "entries", forms.select(F.col("id").alias("row_id"), F.col("entry_id").alias("key"), F.col("loaded_at").alias("at"))),
        ("forms_stage", "entries", stage.select(F.col("stage_id").alias("row_id"), F.col("entry_id").alias("key"), F.col("staged_at").alias("at"))),
        ("custom_dict_forms", "custom_dict_entries", custom.select(F.col("id").alias("row_id"), F.col("entry_pk").alias("key"), F.col("created_at").alias("at"))),
    ]
    parents = {
        "entries": load(spark, d, "entries").select(F.col("id").alias("key"), F.col("loaded_at").alias("valid_from")),
        "custom_dict_entries": load(spark, d, "custom_dict_entries").select(F.col("id").alias("key"), F.col("created_at").alias("valid_from")),
    }
    return references.orphans(refs, parents, load(spark, d, "deleted_entries"))


PACKED = [("forms", "morph_tags", unpack.TAGS), ("entries", "tags", unpack.TAGS), ("entries", "glosses", unpack.GLOSSES)]


def _unpacked(spark, d, least: int) -> DataFrame:
    parts = [unpack.unpack(load(spark, d, tab), "id", field, grammar, least).select(F.lit(tab).alias("tab"), "row_id", F.lit(field).alias("field"), "pos", "val", "kind", "flag") for tab, field, grammar in PACKED]
    return reduce(DataFrame.unionByName, parts)


def p3_found(spark, d):
    return nested.found(load(spark, d, "kaikki_raw"))


def p3_forms(spark, d):
    return nested.child_table(load(spark, d, "kaikki_raw"), "forms")


def p3_senses(spark, d):
    return nested.child_table(load(spark, d, "kaikki_raw"), "sense_examples")


def p3_columns(spark, d):
    """The tables that were discovered in the records, with their members."""
    return nested.columns(load(spark, d, "kaikki_raw"))


def p4_found(spark, d):
    return _orphans(spark, d).select("tab", "row_id", "kind")


def p4_report(spark, d):
    return references.report(_orphans(spark, d))


def p5_found(spark, d):
    return skew.heavy(load(spark, d, "forms").select("entry_id", "form_text"), "entry_id", "form_text")


def p5_by_entry(spark, d):
    weighted = skew.compress(load(spark, d, "forms"), "entry_id", "form_text")
    return skew.profile(weighted, F.length).withColumn("mode_rows", F.coalesce("mode_rows", F.lit(0)))


def p5_by_surface(spark, d):
    found = skew.profile(skew.compress(load(spark, d, "forms"), "form_text", "entry_id"))
    return found.withColumns({"mode_value": F.col("mode_value").cast("string"), "mode_rows": F.coalesce("mode_rows", F.lit(0))})


def p6_found(spark, d):
    return _unpacked(spark, d, 2).select("tab", "row_id", "field", "pos", "val")


def p6_errors(spark, d):
    return _unpacked(spark, d, 1).where("flag <> ''").groupBy("tab", "field", "flag").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (p3_found, p3_forms, p3_senses, p3_columns, p4_found, p4_report, p5_found, p5_by_entry, p5_by_surface, p6_found, p6_errors)}

_ORPHANS = """
with refs as (
  select 'forms' as tab, 'entries' as space, id as row_id, entry_id as k, loaded_at as t from forms
  union all select 'forms_stage', 'entries', stage_id, entry_id, staged_at from forms_stage
  union all select 'custom_dict_forms', 'custom_dict_entries', id, entry_pk, created_at from custom_dict_forms
), parents as (
  select 'entries' as space, id as k, loaded_at as t from entries
  union all select 'custom_dict_entries', id, created_at from custom_dict_entries
), gone as (select distinct tab as space, row_id as k from deleted_entries),
orphans as (
  select r.tab, r.row_id, r.t,
    case when p.k is not null and p.t > r.t then 'late'
         when p.k is not null then null
         when g.k is not null then 'deleted' else 'missing' end as kind
  from refs r left join parents p on p.space = r.space and p.k = r.k
              left join gone g on g.space = r.space and g.k = r.k
  where r.k is not null)
"""



def _listed(x: str) -> str:
    """A member as a list: a single object or string stands for a list of one."""
    return f"case json_type({x}) when 'ARRAY' then json_extract({x}, '$[*]') when 'OBJECT' then [{x}] when 'VARCHAR' then [{x}] else [] end"


def _children(name: str, source: str, member: str, parent: str) -> str:
    """A relation of the elements of a member: rec_id, parent_pos, pos, e."""
    return f"""{name} as (select rec_id, parent_pos, cast(pos as bigint) as pos, e from (select rec_id, {parent} as parent_pos, unnest(l) as e, unnest(range(len(l))) as pos
          from (select *, {_listed(f"json_extract(e, '$.{member}')")} as l from {source} where json_type(e) = 'OBJECT')) where json_type(e) <> 'NULL')"""


_NESTED = "with o as (select rec_id, 0 as pos, cast(raw as json) as e from (select * from kaikki_raw where json_valid(raw) and trim(raw) <> '')), " + ", ".join(
    _children(*x) for x in (("senses", "o", "senses", "-1"), ("sounds", "o", "sounds", "-1"), ("forms_", "o", "forms", "-1"), ("sense_glosses", "senses", "glosses", "pos"), ("sense_examples", "senses", "examples", "pos"), ("sense_tags", "senses", "tags", "pos"), ("sound_tags", "sounds", "tags", "pos"), ("form_tags", "forms_", "tags", "pos"))
)


def _string(member: str) -> str:
    return f"case when json_type(e, '$.{member}') in ('OBJECT', 'ARRAY') then null else e->>'$.{member}' end as {member}"


SQL = {
    "p3_found": _NESTED + " " + " union all ".join(f"select rec_id, '{t}' as tab, parent_pos, pos from {r}" for t, r in (("senses", "senses"), ("sounds", "sounds"), ("forms", "forms_"), ("sense_glosses", "sense_glosses"), ("sense_examples", "sense_examples"), ("sense_tags", "sense_tags"), ("sound_tags", "sound_tags"), ("form_tags", "form_tags"))),
    "p3_forms": f"{_NESTED} select rec_id, parent_pos, pos, {_string('form')}, {_string('roman')}, {_string('source')} from forms_",
    "p3_senses": f"{_NESTED} select rec_id, parent_pos, pos, case when json_type(e) = 'VARCHAR' then e->>'$' end as val, {_string('text')}, {_string('english')} from sense_examples",
    "p3_columns": """
        with v as (select rec_id, raw from kaikki_raw where json_valid(raw) and trim(raw) <> '' and json_type(raw) = 'OBJECT'),
        t as (select v.rec_id, x.fullkey, x.type, x.key from v, lateral (select * from json_tree(v.raw)) x where x.type <> 'NULL'),
        p as (select rec_id, fullkey, type, key, regexp_matches(fullkey, '\\]$') as listed, regexp_replace(regexp_replace(regexp_replace(fullkey, '\\]\\[', '].[].[', 'g'), '\\[[0-9]+\\]', '', 'g'), '^\\$\\.?', '') as path from t),
        a as (select rec_id, path, null as member from p where listed or type = 'OBJECT'
          union all select rec_id, path, null from p where not listed and type = 'VARCHAR' and path in ('senses', 'senses.glosses', 'senses.examples', 'senses.tags', 'sounds', 'sounds.tags', 'forms', 'forms.tags')
          union all select rec_id, case when position('.' in path) > 0 then regexp_replace(path, '\\.[^.]*$', '') else '' end, key from p
            where not listed and type not in ('OBJECT', 'ARRAY') and not (type = 'VARCHAR' and path in ('senses', 'senses.glosses', 'senses.examples', 'senses.tags', 'sounds', 'sounds.tags', 'forms', 'forms.tags')))
        select path, member, count(*) as n_rows, count(distinct rec_id) as n_records from a group by 1, 2""",
    "p6_errors": "select 'entries' as tab, 'glosses' as field, 'malformed_bracket' as flag, count(*) as n from entries where ltrim(glosses)[1] in ('[', '{') and not json_valid(glosses) having count(*) > 0",
    "p4_found": _ORPHANS + "select tab, row_id, kind from orphans where kind is not null",
    "p4_report": _ORPHANS + "select tab, strftime(t, '%Y-%m') as month, kind, count(*) as orphans from orphans where kind is not null group by 1, 2, 3",
    "p5_found": """
        select 'entry_id' as field, cast(entry_id as varchar) as key_value from forms where entry_id is not null
        group by entry_id having count(*) > 0.02 * (select count(*) from forms)
        union all select 'form_text', form_text from forms where form_text is not null
        group by form_text having count(*) > 0.02 * (select count(*) from forms)""",
    "p5_by_entry": """
        with w as (select entry_id as key, form_text as v, count(*) as n from forms where entry_id is not null group by all),
        m as (select key, v, n, row_number() over (partition by key order by n desc, v) as r from w where v is not null)
        select f.entry_id as key, count(*) as n_rows, count(distinct f.form_text) as n_values, any_value(m.v) as mode_value, coalesce(any_value(m.n), 0) as mode_rows,
          quantile_cont(length(f.form_text), 0.5) as p50, quantile_cont(length(f.form_text), 0.9) as p90
        from forms f left join m on m.key = f.entry_id and m.r = 1 where f.entry_id is not null group by f.entry_id""",
    "p5_by_surface": """
        with w as (select form_text as key, entry_id as v, count(*) as n from forms where form_text is not null group by all),
        m as (select key, v, n, row_number() over (partition by key order by n desc, v) as r from w where v is not null)
        select w.key, cast(sum(w.n) as bigint) as n_rows, count(w.v) as n_values, cast(any_value(m.v) as varchar) as mode_value, coalesce(any_value(m.n), 0) as mode_rows
        from w left join m on m.key = w.key and m.r = 1 group by w.key""",
}
