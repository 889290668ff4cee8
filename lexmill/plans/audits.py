"""Audit queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import exprs
from lexmill.operators import audit, lexicon, prune
from lexmill.operators.ordering import ranked, top_per_group
from lexmill.plans import sqltext
from lexmill.sources import load


def a06_high_fanout(spark, d):
    return audit.high_fanout(load(spark, d, "forms"), 5)


def a07_duplicates(spark, d):
    groups = audit.duplicate_groups(load(spark, d, "forms"), ["entry_id", "form_text", "morph_tags", "romanization"])
    return groups.withColumn("entry_id", F.col("entry_id").cast("string"))


def a08_deduped_fanout(spark, d):
    """Fan-out after entries of equal content count once, with up to ten headwords."""
    entries, forms = load(spark, d, "entries"), load(spark, d, "forms")
    keys = ["db", "headword", "romanization", "pos", "glosses"]
    content = F.sha2(F.concat_ws("\x01", *(F.coalesce(k, F.lit("")) for k in keys)), 256)
    first = entries.groupBy(content.alias("content")).agg(F.min("id").alias("owner"))
    owned = entries.select(F.col("id").alias("entry_id"), "headword", content.alias("content")).join(first, "content")
    pairs = forms.where("form_text <> ''").select("db", "form_text", "entry_id").distinct().join(owned, "entry_id").select("db", "form_text", "owner", "headword").distinct()
    fan = pairs.select("db", "form_text", "owner").distinct().groupBy("db", "form_text").agg(F.count(F.lit(1)).alias("n_entries")).where("n_entries >= 5")
    return fan.join(audit.sampled_values(pairs, ["db", "form_text"], "headword", 10), ["db", "form_text"], "left")


def a09_tag_combinations(spark, d):
    return audit.tag_combinations(load(spark, d, "forms"), F.filter(F.split("morph_tags", ";"), lambda t: t != ""))


def a09_tag_samples(spark, d):
    """Tags by dictionary with their frequency and up to five surfaces."""
    tags = load(spark, d, "forms").select("db", "form_text", F.explode(F.filter(F.split("morph_tags", ";"), lambda t: t != "")).alias("tag"))
    counts = tags.groupBy("db", "tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(audit.sampled_values(tags, ["db", "tag"], "form_text", 5), ["db", "tag"], "left")


def a10_pos(spark, d):
    return load(spark, d, "entries").groupBy("pos").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pos")


def a11_ngrams(spark, d):
    """Word n-grams of two to three words in the glosses that occur at least five times."""
    words = F.filter(F.split(F.lower(F.regexp_replace("glosses", "[^A-Za-z ]", " ")), " "), lambda w: w != "")
    grams = load(spark, d, "entries").where("glosses is not null").select(F.explode(audit.ngrams(words, 2, 3)).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


def a12_tag_master(spark, d):
    return audit.tag_master(load(spark, d, "form_tags_flat"))


def a13_examples(spark, d):
    rows = load(spark, d, "form_tags_flat").where("form_tag <> '' and db is not null and sample_examples is not null").select("db", "form_tag", F.explode(F.split("sample_examples", " \\| ")).alias("example"))
    return audit.round_robin(rows, "form_tag", "example", 10)


def a14_collapsed(spark, d):
    """Surfaces over all dictionaries: most rows and entries in one, dictionaries, and up to five entries."""
    forms = load(spark, d, "forms").where("form_text <> ''")
    pairs = forms.groupBy("form_text", "db").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entry_id").alias("n_entries"))
    whole = pairs.groupBy("form_text").agg(F.max("n").alias("most_rows"), F.max("n_entries").alias("most_entries"), F.count(F.lit(1)).alias("n_dbs"), F.array_join(F.array_sort(F.collect_set("db")), "|").alias("dbs")).where("n_dbs > 1 or most_rows > 5")
    return whole.join(audit.sampled_values(forms.select("form_text", "entry_id"), ["form_text"], "entry_id", 5), "form_text", "left")


def a15_tag_shares(spark, d):
    """Percentages of the tags of each language."""
    tags = load(spark, d, "forms").select(exprs.lang_of(F.col("db")).alias("lang"), F.explode(F.split("morph_tags", ";")).alias("t")).select("lang", F.lower(F.trim("t")).alias("tag")).where("tag <> ''")
    return audit.ranked_share(tags.groupBy("lang", "tag").agg(F.count(F.lit(1)).alias("n")), "lang", "n")


def a16_review(spark, d):
    """Per (token, tag, lemma): rows, entries, the twelve most used entries, and how often each part of speech stands there."""
    known = load(spark, d, "entries").select(F.col("id").alias("entry_id"), F.coalesce("lemma", F.lit("")).alias("lemma"), F.lower(F.trim("pos")).alias("upos"))
    tagged = load(spark, d, "forms_stage").where("form_text is not null and morph_tags <> ''").select("form_text", F.explode(F.split("morph_tags", ";")).alias("tag"), "entry_id")
    key = ["form_text", "tag", "lemma"]
    by_entry = tagged.groupBy("form_text", "tag", "entry_id").agg(F.count(F.lit(1)).alias("n")).join(known, "entry_id", "left").na.fill({"lemma": ""})
    top = top_per_group(by_entry.where("entry_id is not null"), key, [F.desc("n"), "entry_id"], 12)
    shown = top.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "entry_id"))).alias("t")).select(*key, F.array_join(F.transform("t", lambda x: x["entry_id"].cast("string")), ",").alias("top"))
    kinds = by_entry.where("upos is not null").groupBy(*key, "upos").agg(F.sum("n").alias("n")).groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("upos", "n"))), lambda x: F.concat_ws("=", x.upos, x.n)), ";").alias("kinds"))
    return by_entry.groupBy(*key).agg(F.sum("n").alias("n"), F.count("entry_id").alias("n_entries")).join(shown, key, "left").join(kinds, key, "left")


def a23_top_unigrams(spark, d):
    """Words of the audit tags by tags, mentions and spelling."""
    words = load(spark, d, "form_tags_flat").where("form_tag <> ''").select("form_tag", F.coalesce("occurrence_count", F.lit(0)).alias("c"), F.explode(F.array_distinct(F.split(F.lower(F.trim("form_tag")), "[^a-z]+"))).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.countDistinct("form_tag").alias("n_tags"), F.sum("c").alias("mentions")).orderBy(F.desc("n_tags"), F.desc("mentions"), F.desc("word")).limit(50)


def a25_scripts(spark, d):
    return load(spark, d, "entries").where("headword is not null").groupBy("db", audit.script_majority(F.col("headword")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


def a26_offsets(spark, d):
    custom = load(spark, d, "custom_dict_entries").select("id", F.lower("language").alias("lang"), "headword")
    return audit.modal_offset(custom, load(spark, d, "entries").select("id", exprs.lang_of(F.col("db")).alias("lang"), "headword"), ["lang", "headword"])


def _signs(spark, d, pattern: str):
    """Signs in the headwords of each dictionary, with their number and up to three headwords."""
    marks = load(spark, d, "entries").where("headword is not null").select("db", "headword", F.explode(F.regexp_extract_all("headword", F.lit(f"({pattern})"), F.lit(1))).alias("mark"))
    counts = marks.groupBy("db", "mark").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(audit.sampled_values(marks, ["db", "mark"], "headword", 3), ["db", "mark"])


def a27_marks(spark, d):
    return _signs(spark, d, "\\p{M}")


def a27_other_signs(spark, d):
    """What stands in headwords beside letters, marks, numbers, spaces and hyphens."""
    return _signs(spark, d, "[^\\p{L}\\p{M}\\p{N} -]")


def a27_scripts(spark, d):
    """Letters of each dictionary's headwords by script."""
    letters = load(spark, d, "entries").where("headword is not null").select("db", *(F.length(F.regexp_replace("headword", f"[^{members}]|\\P{{L}}", "")).alias(name) for name, members in prune.SCRIPTS.items()))
    return letters.groupBy("db").agg(*(F.sum(n).alias(n.lower()) for n in prune.SCRIPTS))


def o04_sample(spark, d):
    """Five entries per dictionary, drawn by a seeded hash."""
    drawn = F.md5(F.concat(F.lit("7:"), F.col("id").cast("string")))
    return top_per_group(load(spark, d, "entries").select("db", "id", drawn.alias("h")), ["db"], ["h", "id"], 5).select("db", "id", "place")


def w03_kept(spark, d):
    hits = lexicon.form_hits(load(spark, d, "entries"), load(spark, d, "forms"))
    return hits.groupBy("db", "kept_as").agg(F.count(F.lit(1)).alias("n"))


def _fanout(spark, d):
    """Surfaces of two or more entries, and their order in a dictionary."""
    fan = audit.high_fanout(load(spark, d, "forms").where("db is not null"), 2)
    return fan, ["db"], [F.desc("n_entries"), F.desc("n_rows"), F.asc("form_text")]


def w13_fanout_places(spark, d):
    """Every surface of two or more entries with its place in the dictionary by fan-out, rows and spelling."""
    return ranked(*_fanout(spark, d))


def w13_fanout_order(spark, d):
    """The head of ``w13_fanout_places``: the first 20 surfaces of each dictionary."""
    return top_per_group(*_fanout(spark, d), 20)


def f04_scripts(spark, d):
    rows = load(spark, d, "entries").select("db", F.array_compact(F.array(*(F.when(F.col("headword").rlike(p), F.lit(n)) for n, p in prune.LETTER_OF.items()))).alias("s"))
    return rows.select("db", F.explode("s").alias("script")).groupBy("db", "script").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (a06_high_fanout, a07_duplicates, a08_deduped_fanout, a09_tag_combinations, a09_tag_samples, a10_pos, a11_ngrams, a12_tag_master, a13_examples, a14_collapsed, a15_tag_shares, a16_review, a23_top_unigrams, a25_scripts, a26_offsets, a27_marks, a27_other_signs, a27_scripts, o04_sample, w03_kept, w13_fanout_order, w13_fanout_places, f04_scripts)}

SQL = {
    "a06_high_fanout": "select db, form_text, count(distinct entry_id) as n_entries, count(*) as n_rows from forms where form_text <> '' group by 1, 2 having count(distinct entry_id) >= 5",
    "a07_duplicates": "select cast(entry_id as varchar) as entry_id, form_text, morph_tags, romanization, count(*) as n, min(id) as first_id, count(*) - 1 as extra from forms group by 1, 2, 3, 4 having count(*) > 1",
    "a08_deduped_fanout": """
        with o as (select id, headword, min(id) over (partition by coalesce(db, ''), coalesce(headword, ''), coalesce(romanization, ''), coalesce(pos, ''), coalesce(glosses, '')) as owner from entries),
        p as (select distinct f.db, f.form_text, o.owner, o.headword from forms f join o on o.id = f.entry_id where f.form_text <> ''),
        h as (select db, form_text, headword, row_number() over (partition by db, form_text order by headword) as r from (select distinct db, form_text, headword from p where headword is not null)),
        s as (select db, form_text, string_agg(headword, '|' order by headword) as samples from h where r <= 10 group by 1, 2)
        select p.db, p.form_text, count(distinct owner) as n_entries, any_value(s.samples) as samples from p left join s using (db, form_text) group by 1, 2 having count(distinct owner) >= 5""",
    "a09_tag_combinations": """
        select db, combination, count(*) as n from (
          select db, list_aggregate(list_sort(list_distinct(list_filter(string_split(morph_tags, ';'), lambda x: x <> ''))), 'string_agg', ';') as combination from forms)
        where combination <> '' group by 1, 2""",
    "a10_pos": "select pos, count(*) as n from entries group by 1",
    "a12_tag_master": """
        with f as (select db, lower(trim(form_tag)) as tag, form_tag, coalesce(occurrence_count, 0) as n from form_tags_flat where form_tag <> ''),
        s as (select tag, form_tag, sum(n) as w from f group by 1, 2),
        x as (select tag, form_tag as display from (select *, row_number() over (partition by tag order by w desc, length(form_tag), form_tag desc) as r from s) where r = 1),
        p as (select tag, db, sum(n) as n from f group by 1, 2)
        select p.tag, cast(sum(n) as bigint) as total, string_agg(concat_ws('=', db, cast(n as bigint)), ';' order by db) as db_counts, any_value(display) as display from p join x using (tag) group by p.tag""",
    "a13_examples": """
        with e as (select distinct form_tag, db, unnest(string_split(sample_examples, ' | ')) as example from form_tags_flat where form_tag <> '' and db is not null and sample_examples is not null),
        t as (select *, row_number() over (partition by form_tag, db order by example) as turn from e),
        p as (select *, row_number() over (partition by form_tag order by turn, db) as place from t where turn <= 10)
        select form_tag, cast(place as integer) as place, db, example from p where place <= 10""",
    "a09_tag_samples": """
        with t as (select db, form_text, unnest(list_filter(string_split(morph_tags, ';'), lambda x: x <> '')) as tag from forms),
        h as (select db, tag, form_text, row_number() over (partition by db, tag order by form_text) as r from (select distinct db, tag, form_text from t where form_text is not null)),
        s as (select db, tag, string_agg(form_text, '|' order by form_text) as samples from h where r <= 5 group by 1, 2)
        select t.db, t.tag, count(*) as n, any_value(s.samples) as samples from t left join s using (db, tag) group by 1, 2""",
    "a14_collapsed": """
        with p as (select form_text, db, count(*) as n, count(distinct entry_id) as m from forms where form_text <> '' group by 1, 2),
        h as (select form_text, entry_id, row_number() over (partition by form_text order by entry_id) as r from (select distinct form_text, entry_id from forms where entry_id is not null)),
        s as (select form_text, array_to_string(list_transform(list_sort(list(entry_id)), lambda x: cast(x as varchar)), '|') as samples from h where r <= 5 group by 1)
        select form_text, max(n) as most_rows, max(m) as most_entries, count(*) as n_dbs, string_agg(db, '|' order by db) as dbs, any_value(samples) as samples from p left join s using (form_text) group by 1 having count(*) > 1 or max(n) > 5""",
    "a15_tag_shares": f"""
        with t as (select lower(split_part({sqltext.strip('db')}, '-', 1)) as lang, lower(trim(unnest(string_split(morph_tags, ';')))) as tag from forms),
        c as (select lang, tag, count(*) as n from t where tag <> '' group by 1, 2) select lang, tag, n, round(100 * n / sum(n) over (partition by lang), 6) as percent from c""",
    "a16_review": """
        with t as (select form_text, unnest(string_split(morph_tags, ';')) as tag, entry_id from forms_stage where form_text is not null and morph_tags <> ''),
        b as (select form_text, tag, coalesce(e.lemma, '') as lemma, t.entry_id, lower(trim(e.pos)) as upos, count(*) as n from t left join entries e on e.id = t.entry_id group by 1, 2, 3, 4, 5),
        r as (select *, row_number() over (partition by form_text, tag, lemma order by n desc, entry_id) as place from b where entry_id is not null),
        s as (select form_text, tag, lemma, string_agg(cast(entry_id as varchar), ',' order by place) as top from r where place <= 12 group by 1, 2, 3),
        k as (select form_text, tag, lemma, string_agg(upos || '=' || cast(n as bigint), ';' order by upos) as kinds from (select form_text, tag, lemma, upos, sum(n) as n from b where upos is not null group by 1, 2, 3, 4) group by 1, 2, 3)
        select b.form_text, b.tag, b.lemma, cast(sum(n) as bigint) as n, count(entry_id) as n_entries, any_value(top) as top, any_value(kinds) as kinds from b left join s using (form_text, tag, lemma) left join k using (form_text, tag, lemma) group by 1, 2, 3""",
    "a26_offsets": """
        with a as (select lower(language) as lang, headword, min(id) as a from custom_dict_entries group by 1, 2 having count(*) = 1),
        b as (select lower(split_part(trim(db), '-', 1)) as lang, headword, min(id) as b from entries group by 1, 2 having count(*) = 1)
        select b - a as "offset", count(*) as n from a join b using (lang, headword) group by 1""",
    "o04_sample": """
        select db, id, cast(r as integer) as place from (select db, id, row_number() over (partition by db order by md5('7:' || cast(id as varchar)), id) as r from entries) where r <= 5""",
    "w13_fanout_order": """
        with f as (select db, form_text, count(distinct entry_id) as n_entries, count(*) as n_rows from forms where form_text <> '' and db is not null group by 1, 2 having count(distinct entry_id) >= 2)
        select * from (select *, cast(row_number() over (partition by db order by n_entries desc, n_rows desc, form_text) as integer) as place from f) where place <= 20""",
    "w13_fanout_places": """
        with f as (select db, form_text, count(distinct entry_id) as n_entries, count(*) as n_rows from forms where form_text <> '' and db is not null group by 1, 2 having count(distinct entry_id) >= 2)
        select *, row_number() over (partition by db order by n_entries desc, n_rows desc, form_text) as place from f""",
} | sqltext.AUDITS
