"""Queries over the lexical store, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import exprs, normalize
from lexmill.operators import display, fuzzy, lexicon, prune, segmentation
from lexmill.plans import sqltext
from lexmill.sources import cut, load, spread


def _store(spark, d) -> tuple[DataFrame, DataFrame]:
    return load(spark, d, "entries"), load(spark, d, "forms")


def _occurrences(spark, d) -> DataFrame:
    """Forms beside their headword, with folded tags."""
    entries, forms = _store(spark, d)
    heads = entries.select(F.col("id").alias("entry_id"), "headword")
    tagged = spread(forms.select("id", "entry_id", "db", "form_text", "morph_tags")).withColumn("tags", prune.folded_tags(F.col("morph_tags")))
    return tagged.join(heads, "entry_id")


def f02_gloss_buckets(spark, d):
    return lexicon.cut_entries(load(spark, d, "entries")).groupBy("db", "reason").agg(F.count(F.lit(1)).alias("n"))


def f01_glosses(spark, d):
    """The glosses of every entry, of any stored shape."""
    return spread(load(spark, d, "entries").select("id", "glosses")).select("id", F.explode(prune.glosses(F.col("glosses"))).alias("gloss"))


def f03_entry_cuts(spark, d):
    return lexicon.cut_entries(load(spark, d, "entries")).select("id", "reason")


def f06_always_kept(spark, d):
    return _occurrences(spark, d).where(prune.always_kept(F.col("tags"))).select("id")


def u03_disjoint(spark, d):
    """Forms that share no script with their headword."""
    return _occurrences(spark, d).where(prune.disjoint_scripts(F.coalesce("form_text", F.lit("")), F.coalesce("headword", F.lit("")))).select("id")


def x08_stems(spark, d):
    """Stems of Korean verbs and adjectives."""
    rows = load(spark, d, "entries").where(exprs.lang_of(F.col("db")) == "ko").select("id", "headword", "pos")
    return rows.select("id", "headword", "pos", normalize.korean_stems(F.col("headword"), F.col("pos")).alias("stem")).where("stem <> ''").select("id", "stem")


def x03_letter_folds(spark, d):
    """Headwords with the letters of their language folded."""
    folded = normalize.letter_folds(F.col("headword"), exprs.lang_of(F.col("db")))
    return load(spark, d, "entries").where("headword is not null").select("id", folded.alias("folded"))


def x04_without_marks(spark, d):
    """Headwords without the marks of their script."""
    bare = normalize.mark_strips(F.col("headword"), exprs.lang_of(F.col("db")))
    return load(spark, d, "entries").where("headword is not null").select("id", bare.alias("bare"))


def x02_without_rules(spark, d):
    """How many keys change when rules are switched off."""
    texts = load(spark, d, "entries").where("headword <> ''").select("headword", exprs.lang_of(F.col("db")).alias("lang")).distinct()
    keys = [normalize.key_column(F.col("headword"), F.col("lang"), off) for off in ((), ("turkish_case", "arabic_letters", "ancient_greek", "persian_letters"))]
    return spread(texts).select("lang", keys[0].alias("a"), keys[1].alias("b")).groupBy("lang").agg(F.count_if(F.col("a") != F.col("b")).alias("n_changed"))


def j02_hydrated(spark, d):
    """Surface references with the columns of their entry and matched form."""
    entries, forms = _store(spark, d)
    words = load(spark, d, "forms_stage").select(F.col("form_text").alias("word")).unionByName(entries.select(F.col("lemma").alias("word")))
    return lexicon.hydrate(display.surface_refs(words, entries, forms), entries, forms).select("word", "ref_key", "headword", "pos", "lemma", "matched_form", "matched_tags")


def u01_stores(spark, d):
    """Headwords found in both stores, the entries and the custom ones, in one list."""
    own = load(spark, d, "entries").where("headword <> ''").select(F.lit("entries").alias("store"), exprs.lang_of(F.col("db")).alias("lang"), "headword", "id", "pos")
    custom = load(spark, d, "custom_dict_entries").where("headword <> ''").select(F.lit("custom").alias("store"), F.lower(F.trim("language")).alias("lang"), "headword", "id", "pos")
    return own.unionByName(custom)


def t02_bounded(spark, d):
    """Headwords with hyphens or spaces, cut into keys that may not cross them; the lemma is a hint."""
    entries, _ = _store(spark, d)
    lang = exprs.lang_of(F.col("db"))
    places = F.flatten(F.transform(F.filter(F.sequence(F.lit(1), F.length("headword")), lambda i: F.substring("headword", i, 1).rlike("[ -]")), lambda i: F.array(i - 1, i))).cast("array<int>")
    words = entries.where("headword rlike '[^ -][ -]+[^ -]'").select(lang.alias("lang"), F.col("headword").alias("word"), places.alias("bounds"), F.array_compact(F.array("lemma")).alias("hints"))
    return segmentation.segmented(words, entries.where("headword_key <> ''").select(lang.alias("lang"), F.col("headword_key").alias("key")))


def f05_folded_tags(spark, d):
    folded = load(spark, d, "entries").select("id", F.posexplode(prune.folded_tags(F.col("tags"))).alias("k", "tag"))
    return folded.select("id", (F.col("k") + 1).alias("place"), "tag")


def f07_tag_cuts(spark, d):
    cuts = _occurrences(spark, d).select(prune.tag_cut(F.col("tags")).alias("reason"), prune.always_kept(F.col("tags")).alias("kept"))
    return cuts.groupBy("reason", "kept").agg(F.count(F.lit(1)).alias("n"))


def f08_text_cuts(spark, d):
    return load(spark, d, "forms").select(prune.text_cut(F.col("db"), exprs.strip(F.col("form_text"))).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def f09_word_counts(spark, d):
    both = _occurrences(spark, d).select("db", (exprs.word_count(F.col("form_text")) == exprs.word_count(F.col("headword"))).alias("same_words"))
    return both.groupBy("db", "same_words").agg(F.count(F.lit(1)).alias("n"))


def f10_edge_hyphens(spark, d):
    return _occurrences(spark, d).where(prune.edge_hyphen_mismatch(F.col("form_text"), F.col("headword"))).select("id", "form_text", "headword")


def f11_zero_overlap(spark, d):
    return _occurrences(spark, d).where(prune.zero_overlap(F.coalesce("form_text", F.lit("")), F.coalesce("headword", F.lit("")))).select("id", "form_text", "headword")


def f12_occurrence_cuts(spark, d):
    occ = _occurrences(spark, d).withColumn("keep", prune.always_kept(F.col("tags")))
    return occ.select("db", prune.occurrence_cut(F.col("db"), F.col("form_text"), F.col("headword"), F.col("tags"), kept=F.col("keep")).alias("reason")).groupBy("db", "reason").agg(F.count(F.lit(1)).alias("n"))


def f13_fanout(spark, d):
    fan = load(spark, d, "forms").where("entry_id is not null and form_text <> ''").select("db", "form_text", "entry_id").distinct().groupBy("db", "form_text").agg(F.count(F.lit(1)).alias("n_entries"))
    return fan.where(prune.fanout_cut(F.col("db"), F.col("n_entries")))


def f14_bucket_reason(spark, d):
    occ = _occurrences(spark, d).select("db", "form_text", prune.occurrence_cut(F.col("db"), F.col("form_text"), F.col("headword"), F.col("tags")).alias("reason")).where("reason <> ''")
    return occ.groupBy("db", "form_text").agg(F.array_sort(F.collect_set("reason")).alias("r")).select("db", "form_text", prune.chosen_reason(F.col("r")).alias("reason"))


def f15_exact_lists(spark, d):
    forms = load(spark, d, "forms").select("id", "db", "form_text")
    listed = forms.groupBy("db", "form_text").agg(F.count(F.lit(1)).alias("n")).where("n >= 50 and form_text is not null")
    return prune.exact_list(forms, listed, "listed").where("listed").groupBy("db").agg(F.count(F.lit(1)).alias("n"))


def f17_pos_groups(spark, d):
    """Entries of a headword split into those of a wanted part of speech, with their etymology group, and others."""
    own = load(spark, d, "entries").select("id", "db", "headword", "etymology_number", prune.pos_bucket(F.col("pos")).alias("bucket"))
    wanted = (F.col("bucket") == "verbal").cast("int")
    group = own.groupBy("db", "headword", "etymology_number").agg(F.max(wanted).alias("lifted"))
    word = own.groupBy("db", "headword").agg(F.max(wanted).alias("any_wanted"))
    joined = own.join(group, ["db", "headword", "etymology_number"]).join(word, ["db", "headword"])
    return joined.select("id", F.when((F.col("any_wanted") == 0) | (F.col("lifted") == 1), "primary").otherwise("other").alias("side"))


def f19_preferred_pos(spark, d):
    """Of each headword the entries with the first listed part of speech that any of them has."""
    order = F.array(*map(F.lit, ["noun", "verb", "adj", "adv"]))
    own = load(spark, d, "entries").where("headword <> ''").select("id", "db", "headword", F.array_position(order, F.lower(F.trim("pos"))).alias("rank")).where("rank > 0")
    best = own.groupBy("db", "headword").agg(F.min("rank").alias("best"))
    return own.join(best, ["db", "headword"]).where("rank = best").select("id", "db", "headword")


def f21_tag_contains(spark, d):
    return load(spark, d, "forms").where(F.lower("morph_tags").contains("canonical")).groupBy("db").agg(F.count(F.lit(1)).alias("n"))


def f22_unshared_chars(spark, d):
    occ = _occurrences(spark, d).where("form_text <> '' and headword <> ''")
    chars = lambda c: F.array_distinct(F.split(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]", ""), ""))
    return occ.where(F.size(F.array_intersect(chars(F.col("form_text")), chars(F.col("headword")))) == 0).groupBy("db").agg(F.count(F.lit(1)).alias("n"))


def f23_extra_rules(spark, d):
    rules = _occurrences(spark, d).select("db", F.explode(prune.extra_rules(F.col("db"), F.coalesce("form_text", F.lit("")), F.coalesce("headword", F.lit("")), F.col("tags"))).alias("rule"))
    return rules.groupBy("db", "rule").agg(F.count(F.lit(1)).alias("n"))


def f24_of_targets(spark, d):
    """Words that glosses name after "of", and whether the dictionary has them as a headword."""
    entries = load(spark, d, "entries")
    named = entries.select("id", "db", F.explode(prune.of_targets(prune.glosses(F.col("glosses")))).alias("target"))
    heads = entries.where("headword <> ''").select("db", F.col("headword").alias("target"), F.lit(True).alias("known")).distinct()
    return named.join(heads, ["db", "target"], "left").select("id", "db", "target", F.coalesce("known", F.lit(False)).alias("is_headword"))


def f25_relation_only(spark, d):
    return load(spark, d, "entries").where(prune.relation_only(prune.glosses(F.col("glosses")))).select("id", "db")


def f26_pos_buckets(spark, d):
    return load(spark, d, "entries").groupBy(prune.pos_bucket(F.col("pos")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def f27_importable(spark, d):
    """Entries with a headword and a gloss that are no placeholders, by dictionary."""
    entries = spread(load(spark, d, "entries").select("db", "headword", "pos", "glosses")).withColumn("told", prune.glosses(F.col("glosses")))
    empty = prune.placeholder(F.col("db"), F.col("pos"), F.col("told"))
    return entries.where((exprs.strip(F.col("headword")) != "") & (exprs.strip(F.col("glosses")) != "") & ~empty).groupBy("db").agg(F.count(F.lit(1)).alias("n"))


def w01_survivors(spark, d):
    return lexicon.survivors(load(spark, d, "entries")).select("id", "survivor_id")


def w02_form_hits(spark, d):
    return lexicon.form_hits(*_store(spark, d)).select("db", "form_text", "entry_id", "form_id", "kept_as")


def w04_canonical_first(spark, d):
    tags = F.lower(F.coalesce("morph_tags", F.lit("")))
    rank = F.struct((~tags.contains("canonical")).cast("int"), tags.contains("uppercase").cast("int"), F.col("id"))
    best = load(spark, d, "forms").where("entry_id is not null and trim(form_text) <> ''").groupBy("entry_id").agg(F.min_by(F.struct("id", "form_text"), rank).alias("b"))
    return best.select("entry_id", F.col("b.id").alias("form_id"), F.col("b.form_text").alias("form_text"))


def w05_keeper(spark, d):
    """Of entries with one headword the keeper: most filled fields, then the lowest id."""
    filled = sum(((F.coalesce(c, F.lit("")) != "").cast("int") for c in ("glosses", "etymology", "commentary", "lemma")), F.lit(0))
    own = load(spark, d, "entries").where("headword <> ''")
    return own.groupBy("db", "headword").agg(F.min_by("id", F.struct(-filled, "id")).alias("keeper_id"), F.count(F.lit(1)).alias("n"))


def j01_forms_entries(spark, d):
    entries, forms = _store(spark, d)
    joined = forms.select("entry_id").join(entries.select(F.col("id").alias("entry_id"), "db", "pos"), "entry_id")
    return joined.groupBy("db", "pos").agg(F.count(F.lit(1)).alias("n"))


def j04_tag_or_headword(spark, d):
    entries, forms = _store(spark, d)
    heads = entries.select(F.col("id").alias("entry_id"), "headword")
    return forms.select("id", "entry_id", "form_text", "morph_tags").join(heads, "entry_id").where((F.col("form_text") == F.col("headword")) | F.lower("morph_tags").contains("romanization")).select("id", "entry_id", "form_text")


def j05_notes(spark, d):
    """Entries with the newest custom commentary of their language and headword."""
    note = load(spark, d, "custom_dict_entries").where("commentary <> ''").groupBy(F.lower("language").alias("lang"), "headword").agg(F.max_by("commentary", F.struct("updated_at", "id")).alias("note"))
    own = load(spark, d, "entries").select("id", "headword", exprs.lang_of(F.col("db")).alias("lang"))
    return own.join(note, ["lang", "headword"], "left").select("id", "note")


def j07_suffixed_twins(spark, d):
    """Staged rows that have no twin without their last tag."""
    stage = load(spark, d, "forms_stage").where("entry_id is not null and morph_tags is not null and form_text is not null")
    twins = stage.select("entry_id", "form_text", F.col("morph_tags").alias("base")).distinct()
    based = stage.withColumn("base", F.when(F.col("morph_tags").contains(";"), F.regexp_replace("morph_tags", ";[^;]*$", "")).otherwise(F.lit("\0")))
    return based.join(twins, ["entry_id", "form_text", "base"], "left_anti").select("stage_id", "entry_id", "form_text", "morph_tags")


def j08_missing_heads(spark, d):
    stage, entries = load(spark, d, "forms_stage"), load(spark, d, "entries").select(F.col("id").alias("entry_id"), F.lit(1).alias("hit"))
    return stage.join(entries, "entry_id", "left").agg(F.count(F.lit(1)).alias("n_rows"), F.count("hit").alias("n_met"), F.count_if(F.col("hit").isNull()).alias("n_skipped"))


def j09_stage_insert(spark, d):
    """Staged forms of known entries, each once, that the store doesn't hold yet."""
    entries, forms = _store(spark, d)
    key = ["entry_id", "form_text", "morph_tags"]
    new = load(spark, d, "forms_stage").groupBy(*key).agg(F.min("stage_id").alias("stage_id"))
    known = new.join(entries.select(F.col("id").alias("entry_id")), "entry_id", "left_semi")
    held = forms.select(*key).distinct()
    return known.join(held, [known[k].eqNullSafe(held[k]) for k in key], "left_anti").select("stage_id", *key)


def j10_lemma_agreement(spark, d):
    entries = load(spark, d, "entries").select(F.col("id").alias("entry_id"), "lemma")
    joined = load(spark, d, "forms_stage").select("entry_id", "form_text").join(entries.withColumn("hit", F.lit(1)), "entry_id", "left")
    state = F.when(F.col("hit").isNull(), "missing").when(F.coalesce("lemma", F.lit("")) == "", "empty").when(F.substring("lemma", 1, 2) == F.substring("form_text", 1, 2), "match").otherwise("mismatch")
    return joined.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def j12_redirects(spark, d):
    """Entries that name another as their lemma, or in a gloss as a variant, resolved to the entry of that headword; self-redirects are skipped."""
    entries = load(spark, d, "entries")
    told = F.array(F.regexp_extract("glosses", "variant of ([^\\s\";|,.]+)", 1), F.trim("lemma"))
    variants = entries.select("id", "db", F.explode(F.array_distinct(F.array_compact(told))).alias("target")).where("target <> ''")
    heads = entries.where("headword <> ''").groupBy("db", F.col("headword").alias("target")).agg(F.min("id").alias("target_id"))
    return variants.join(heads, ["db", "target"]).where("id <> target_id").select("id", "db", "target", "target_id")


def x01_keys(spark, d):
    texts = load(spark, d, "entries").where("headword <> ''").select("headword", exprs.lang_of(F.col("db")).alias("lang")).distinct()
    return texts.select("lang", "headword", normalize.key_column(F.col("headword"), F.col("lang")).alias("key"))


def x06_sanskrit(spark, d):
    words = load(spark, d, "entries").where("db = 'sa' and headword <> ''").select("headword").distinct()
    roman = words.select("headword", normalize.text_column(normalize.devanagari_to_iast, F.col("headword")).alias("iast"))
    return roman.select("headword", "iast", normalize.text_column(normalize.iast_to_slp1, F.col("iast")).alias("slp1"), normalize.text_column(normalize.anusvara, F.col("iast")).alias("anusvara"))


def t05_fuzzy(spark, d):
    """Fuzzy hits of the headwords whose entry id is divisible by 50 among all form keys."""
    entries, forms = _store(spark, d)
    asked = entries.where("id % 50 = 0").select(F.col("headword_key").alias("key"))
    return fuzzy.tiered(asked, forms.select(F.col("form_key").alias("key")))


def o03_fuzzy_capped(spark, d):
    """The first 50 fuzzy hits of each query in key order: the report that a reader sees."""
    order = Window.partitionBy("query").orderBy("key")
    return t05_fuzzy(spark, d).withColumn("place", F.row_number().over(order)).where("place <= 50")


def t01_segments(spark, d):
    """Surfaces of forms whose id is divisible by 50, cut into headword keys of their language."""
    entries, forms = _store(spark, d)
    words = forms.where("id % 50 = 0 and form_text <> ''").select(exprs.lang_of(F.col("db")).alias("lang"), F.col("form_text").alias("word"))
    return segmentation.segmented(words, entries.where("headword_key <> ''").select(exprs.lang_of(F.col("db")).alias("lang"), F.col("headword_key").alias("key")))


def t06_lookup(spark, d):
    """Words of the documents found in the dictionaries, as hydrated references: the flagship path."""
    entries, forms = _store(spark, d)
    words = load(spark, d, "documents").where("text is not null").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([\\p{L}\\p{M}\\p{N}-]+)"), F.lit(1)))).alias("word")).distinct()
    refs = lexicon.lookup_everywhere(words, lexicon.key_index(entries, forms))
    return lexicon.hydrate(refs, entries, forms).select("word", "lang", "match_kind", "match_key", "ref_key", "headword", "pos", "matched_form")


def t06_index(spark, d):
    return lexicon.key_index(*_store(spark, d))


def j19_hits(spark, d):
    """Postings per key and kind, forms of an entry that its headword key already finds left out."""
    index = cut(lexicon.key_index(*_store(spark, d)))
    heads = index.where("kind = 'headword'").select("db", "key", "entry_id")
    rest = index.where("kind = 'form'").join(heads, ["db", "key", "entry_id"], "left_anti")
    keys = index.where("kind = 'headword'").unionByName(rest).groupBy("db", "kind", "key").agg(F.count(F.lit(1)).alias("n"))
    return keys.groupBy("db", "kind").agg(F.sum("n").alias("n_postings"), F.count("key").alias("n_keys"))


QUERIES = {
    f.__name__: f
    for f in (
        f01_glosses, f02_gloss_buckets, f03_entry_cuts, f06_always_kept, u03_disjoint, x08_stems, x03_letter_folds, x04_without_marks, x02_without_rules, j02_hydrated, u01_stores, t02_bounded, f05_folded_tags, f07_tag_cuts, f08_text_cuts, f09_word_counts, f10_edge_hyphens, f11_zero_overlap, f12_occurrence_cuts,
        f13_fanout, f14_bucket_reason, f15_exact_lists, f17_pos_groups, f19_preferred_pos, f21_tag_contains, f22_unshared_chars, f23_extra_rules,
        f24_of_targets, f25_relation_only, f26_pos_buckets, f27_importable, w01_survivors, w02_form_hits, w04_canonical_first, w05_keeper,
        j01_forms_entries, j04_tag_or_headword, j05_notes, j07_suffixed_twins, j08_missing_heads, j09_stage_insert, j10_lemma_agreement, j12_redirects,
        x01_keys, x06_sanskrit, t05_fuzzy, o03_fuzzy_capped, t01_segments, t06_lookup, t06_index, j19_hits,
    )
}

SQL = {
    "f09_word_counts": """
        select f.db, len(list_filter(regexp_split_to_array(trim(coalesce(f.form_text, '')), '\\s+'), lambda x: x <> '')) = len(list_filter(regexp_split_to_array(trim(coalesce(e.headword, '')), '\\s+'), lambda x: x <> '')) as same_words, count(*) as n
        from (select db, entry_id, regexp_replace(form_text, '[\\x{A0}\\x{2007}\\x{2009}\\x{202F}\\x{3000}]', ' ', 'g') as form_text from forms) f
        join (select id, regexp_replace(headword, '[\\x{A0}\\x{2007}\\x{2009}\\x{202F}\\x{3000}]', ' ', 'g') as headword from entries) e on e.id = f.entry_id group by 1, 2""",
    "f10_edge_hyphens": """
        select f.id, f.form_text, e.headword from forms f join entries e on e.id = f.entry_id
        where (f.form_text like '-%' or f.form_text like '%-') and not (coalesce(e.headword, '') like '-%' or coalesce(e.headword, '') like '%-')""",
    "f13_fanout": """
        select db, form_text, count(distinct entry_id) as n_entries from forms where entry_id is not null and form_text <> ''
        and db not in ('ja', 'ja-jmdict', 'ko', 'ko-krdict', 'grc', 'lzh', 'lzh-wiktionary', 'zh', 'zh-cc-cedict', 'zh-hant', 'zh-hant-cc-cedict')
        group by 1, 2 having count(distinct entry_id) > 10""",
    "f15_exact_lists": """
        select db, count(*) as n from forms join (select db, trim(form_text) as t from forms where form_text is not null group by 1, form_text having count(*) >= 50) using (db)
        where trim(form_text) = t group by db""",
    "f17_pos_groups": """
        with w as (select id, db, headword, etymology_number, case when regexp_matches(lower(trim(coalesce(pos, ''))), '^verb') then 1 else 0 end as v from entries),
        g as (select *, max(v) over (partition by db, headword, etymology_number) as lifted, max(v) over (partition by db, headword) as anyv from w where db is not null and headword is not null and etymology_number is not null)
        select id, case when anyv = 0 or lifted = 1 then 'primary' else 'other' end as side from g""",
    "f19_preferred_pos": """
        with r as (select id, db, headword, case lower(trim(pos)) when 'noun' then 1 when 'verb' then 2 when 'adj' then 3 when 'adv' then 4 end as k from entries where headword <> '')
        select id, db, headword from (select *, min(k) over (partition by db, headword) as b from r where k is not null) where k = b""",
    "f21_tag_contains": "select db, count(*) as n from forms where lower(morph_tags) like '%canonical%' group by db",
    "f26_pos_buckets": """
        select case when p = '' then 'blank' when regexp_matches(p, '^(proper )?noun|^name|^proper') then 'nominal' when regexp_matches(p, '^verb') then 'verbal'
          when regexp_matches(p, '^adj|^adv|^det|^num') then 'modifier' when regexp_matches(p, 'fix$|^particle|^prep|^conj|^root|^counter|^character') then 'functional' else 'other' end as bucket, count(*) as n
        from (select lower(trim(coalesce(pos, ''))) as p from entries) group by 1""",
    "w04_canonical_first": """
        select entry_id, id as form_id, form_text from (
          select entry_id, id, form_text, row_number() over (partition by entry_id order by
            case when lower(coalesce(morph_tags, '')) like '%canonical%' then 0 else 1 end,
            case when lower(coalesce(morph_tags, '')) like '%uppercase%' then 1 else 0 end, id) as r
          from forms where entry_id is not null and trim(form_text) <> '') where r = 1""",
    "w05_keeper": """
        select db, headword, arg_min(id, row(-(case when coalesce(glosses, '') <> '' then 1 else 0 end + case when coalesce(etymology, '') <> '' then 1 else 0 end
          + case when coalesce(commentary, '') <> '' then 1 else 0 end + case when coalesce(lemma, '') <> '' then 1 else 0 end), id)) as keeper_id, count(*) as n
        from entries where headword <> '' group by db, headword""",
    "j01_forms_entries": "select e.db, e.pos, count(*) as n from forms f join entries e on e.id = f.entry_id group by 1, 2",
    "j04_tag_or_headword": """
        select f.id, f.entry_id, f.form_text from forms f join entries e on e.id = f.entry_id where f.form_text = e.headword or lower(f.morph_tags) like '%romanization%'""",
    "j05_notes": """
        with n as (select lower(language) as lang, headword, commentary, row_number() over (partition by lower(language), headword order by updated_at desc, id desc) as r from custom_dict_entries where commentary <> '')
        select e.id, n.commentary as note from entries e left join n on n.lang = lower(split_part(trim(e.db), '-', 1)) and n.headword = e.headword and n.r = 1""",
    "j07_suffixed_twins": """
        with s as (select * from forms_stage where entry_id is not null and morph_tags is not null and form_text is not null)
        select stage_id, entry_id, form_text, morph_tags from s where not exists (
          select 1 from s t where s.morph_tags like '%;%' and t.entry_id = s.entry_id and t.form_text = s.form_text and t.morph_tags = regexp_replace(s.morph_tags, ';[^;]*$', ''))""",
    "j08_missing_heads": "select count(*) as n_rows, count(e.id) as n_met, count(*) - count(e.id) as n_skipped from forms_stage s left join entries e on e.id = s.entry_id",
    "j09_stage_insert": """
        select min(stage_id) as stage_id, entry_id, form_text, morph_tags from forms_stage s where entry_id in (select id from entries)
        and not exists (select 1 from forms f where f.entry_id = s.entry_id and f.form_text is not distinct from s.form_text and f.morph_tags is not distinct from s.morph_tags)
        group by entry_id, form_text, morph_tags""",
    "j10_lemma_agreement": """
        select case when e.id is null then 'missing' when coalesce(e.lemma, '') = '' then 'empty' when substr(e.lemma, 1, 2) = substr(s.form_text, 1, 2) then 'match' else 'mismatch' end as state, count(*) as n
        from forms_stage s left join entries e on e.id = s.entry_id group by 1""",
} | sqltext.LEXICAL
