"""The lexical store: survivors, pruned form hits, key index, lookup and hydration.

Joins are narrow: ids and keys are matched first and wide columns are fetched for the winners only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.exprs import lang_of, strip
from lexmill.functions.normalize import SAME_EVERYWHERE, anusvara, key_column, rule_set, rule_sets, text_column
from lexmill.operators import prune
from lexmill.sources.tables import cut, spread


def cut_entries(entries: DataFrame) -> DataFrame:
    """Entries with the reason of their cut: id, db, headword, romanization, pos, glosses, reason."""
    own = spread(entries.select("id", "db", "headword", "romanization", "pos", "glosses")).select("id", "db", *(strip(F.col(c)).alias(c) for c in ("headword", "romanization", "pos", "glosses")))
    return own.withColumn("reason", prune.entry_cut(prune.gloss_bucket(prune.glosses(F.col("glosses")))))


def survivors(entries: DataFrame) -> DataFrame:
    """id -> survivor: the lowest id of equal entries of a dictionary, among those that aren't cut.

    Counting by content first keeps a much repeated entry from filling one task; the join back goes over a
    hash of the content.
    """
    keys = ["db", "headword", "romanization", "pos", "glosses"]
    live = cut_entries(entries).where("reason = '' and id > 0").withColumn("content", F.sha2(F.concat_ws("\0", *(F.coalesce(F.col(k), F.lit("")) for k in keys)), 256))
    first = live.groupBy("content").agg(F.min("id").alias("survivor_id"))
    return live.join(first, "content").select("id", "survivor_id", "db", "headword", "pos")


def form_hits(entries: DataFrame, forms: DataFrame, white: DataFrame | None = None, black: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Kept form occurrences: db, form_text, entry_id (survivor), form_id, morph_tags, romanization, kept_as.

    Variants are reduced to their first row (W02). Occurrences with an always-keep tag stay; the others stay
    unless cut for themselves or because too many live entries share the surface (W03).
    """
    heads = (known if known is not None else survivors(entries)).select(F.col("id").alias("entry_id"), "survivor_id", "headword")
    own = forms.select(F.col("id").alias("form_id"), "entry_id", "db", strip(F.col("form_text")).alias("form_text"), strip(F.col("morph_tags")).alias("morph_tags"), strip(F.col("romanization")).alias("romanization")).where("form_text <> ''")
    joined = own.join(heads, "entry_id")
    variant = ["db", "form_text", "survivor_id", "morph_tags", "romanization"]
    first = joined.groupBy(*variant).agg(F.min(F.struct("entry_id", "form_id", "headword")).alias("v")).select(*variant, "v.form_id", "v.headword")
    flagged = prune.exact_list(prune.exact_list(first, white, "white"), black, "black").withColumn("tags", prune.folded_tags(F.col("morph_tags")))
    told = flagged.withColumn("keep", prune.always_kept(F.col("tags")))
    judged = cut(told.withColumn("reason", prune.occurrence_cut(F.col("db"), F.col("form_text"), F.col("headword"), F.col("tags"), F.col("white"), F.col("black"), F.col("keep"))).drop("tags"))
    candidates = judged.where("not keep and reason = ''")
    fan = candidates.select("db", "form_text", "survivor_id").distinct().groupBy("db", "form_text").agg(F.count(F.lit(1)).alias("n"))
    crowded = fan.where(prune.fanout_cut(F.col("db"), F.col("n"))).select("db", "form_text")
    kept = judged.where("keep").withColumn("kept_as", F.lit("always")).unionByName(candidates.where("not white").join(crowded, ["db", "form_text"], "left_anti").unionByName(candidates.where("white")).withColumn("kept_as", F.lit("candidate")))
    return kept.select("db", "form_text", F.col("survivor_id").alias("entry_id"), "form_id", "morph_tags", "romanization", "kept_as")


def promoted(hits: DataFrame, heads: DataFrame) -> DataFrame:
    """The first usable form of entries whose headword only names a split page, canonical forms first."""
    pages = heads.where(F.col("headword").rlike(prune.SPLIT_PAGE)).select(F.col("survivor_id").alias("entry_id")).distinct()
    tags = F.lower("morph_tags")
    usable = hits.join(pages, "entry_id").where((F.col("form_text") != "-") & ~tags.rlike("table-tags|inflection-template"))
    rank = F.struct((~tags.contains("canonical")).cast("int").alias("a"), tags.contains("uppercase").cast("int").alias("b"), F.col("form_id").alias("c"), F.col("form_text").alias("t"))
    return usable.groupBy("entry_id").agg(F.min(rank).alias("r")).select("entry_id", F.col("r.t").alias("form_text"))


def key_index(entries: DataFrame, forms: DataFrame) -> DataFrame:
    """kind (headword, form), db, key, entry_id, form_id; keys are computed once per distinct text and language."""
    known = cut(survivors(entries))
    heads, hits = known.where("id = survivor_id"), cut(form_hits(entries, forms, known=known))
    pages = promoted(hits, heads).select(F.col("entry_id").alias("survivor_id"), F.col("form_text").alias("page_form"))
    named = heads.join(pages, "survivor_id", "left").select("db", F.col("survivor_id").alias("entry_id"), F.coalesce("page_form", "headword").alias("text"), "pos")
    stem = F.when(F.lower("pos").isin("verb", "adj") & F.col("text").endswith("다") & (F.length("text") > 1) & (lang_of(F.col("db")) == "ko"), F.expr("left(text, length(text) - 1)"))
    nasal = F.when(lang_of(F.col("db")) == "sa", text_column(anusvara, F.col("text")))
    texts = named.select(F.lit("headword").alias("kind"), "db", "entry_id", F.lit(0).cast("bigint").alias("form_id"), F.explode(F.array_distinct(F.array_compact(F.array("text", stem, nasal)))).alias("text"))
    every = texts.unionByName(hits.select(F.lit("form").alias("kind"), "db", "entry_id", "form_id", F.col("form_text").alias("text")))
    distinct = every.select("text", lang_of(F.col("db")).alias("lang")).distinct()
    keys = distinct.withColumn("key", key_column(F.col("text"), F.col("lang"))).where("key <> ''")
    return every.withColumn("lang", lang_of(F.col("db"))).join(keys, ["text", "lang"]).select("kind", "db", "key", "entry_id", "form_id").distinct()


def lookup(words: DataFrame, index: DataFrame) -> DataFrame:
    """Winner references of words (word, lang): exact key matches, headwords before forms, one per entry."""
    asked = words.where("word is not null").select("word", F.lower("lang").alias("lang")).distinct().withColumn("key", key_column(F.col("word"), F.col("lang"))).where("key <> ''")
    return _best(asked.join(index.withColumn("lang", lang_of(F.col("db"))), ["lang", "key"]))


def lookup_everywhere(words: DataFrame, index: DataFrame) -> DataFrame:
    """``lookup`` of words in the dictionaries of every language.

    Words that no language's rules change have one key, which meets the keys of all languages. The key of another word is
    computed once per set of rules, whose number is fixed by the code, not once per language.
    """
    sets = sorted({"", *rule_sets().values()})
    asked = words.where("word <> ''").select("word").distinct()
    plain = asked.where(F.col("word").rlike(SAME_EVERYWHERE)).withColumn("key", F.lower(F.replace("word", F.lit("-"), F.lit("")))).where("key <> ''")
    other = asked.where(~F.col("word").rlike(SAME_EVERYWHERE)).select("word", F.explode(F.array(*map(F.lit, sets))).alias("rules")).withColumn("key", key_column(F.col("word"), F.col("rules"))).where("key <> ''")
    known = cut(index.withColumn("lang", lang_of(F.col("db"))).where("lang <> ''").withColumn("rules", rule_set(F.col("lang"))))
    return _best(plain.join(known, "key").drop("rules").unionByName(other.join(known, ["rules", "key"]).drop("rules")))


def _best(hits: DataFrame) -> DataFrame:
    best = F.min(F.struct((F.col("kind") == "form").cast("int").alias("k"), F.col("form_id").alias("f"), F.col("kind").alias("kind"))).alias("b")
    return hits.groupBy("word", "lang", "db", "entry_id", "key").agg(best).select("word", "lang", "db", "entry_id", F.col("key").alias("match_key"), F.col("b.kind").alias("match_kind"), F.col("b.f").alias("form_id"))


def hydrate(refs: DataFrame, entries: DataFrame, forms: DataFrame) -> DataFrame:
    """References with the columns of their entry and of the matched form."""
    wide = entries.select(F.col("id").alias("entry_id"), "headword", "romanization", "pos", "glosses", "lemma", "etymology", "tags")
    shapes = forms.select(F.col("id").alias("form_id"), F.col("form_text").alias("matched_form"), F.col("morph_tags").alias("matched_tags"))
    ref_key = F.concat_ws("|", F.lit("sqlite"), "db", "entry_id", F.when(F.col("form_id") > 0, F.col("form_id")))
    return refs.join(wide, "entry_id").join(shapes, "form_id", "left").withColumn("ref_key", ref_key)
