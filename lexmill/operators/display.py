"""From references to what a reader sees: matched and special forms, form rows, payload fields, the split into primary
and other entries (F17, F18, F20, J20, M02 to M04).

Everything is joins and expressions on narrow rows; a list of forms stays rows, as an entry may have very many.

Cases: null keys meet nothing; empty texts are no matches; repeated rows of a form count once; ties go to the lowest id.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.exprs import lang_of, strip
from lexmill.sources.tables import spread

# Universal parts of speech and the dictionary's own names for them.
NOUN_AFFIXES = ["affix", "prefix", "suffix", "infix", "interfix", "circumfix", "combining_form"]
UPOS = {
    "NOUN": ["noun", "classifier", "name", "contraction", "counter", *NOUN_AFFIXES],
    "VERB": ["verb"],
    "ADJ": ["adj", "adnominal"],
    "ADV": ["adv"],
    "PROPN": ["name", "noun", *NOUN_AFFIXES],
    "ADP": ["prep", "postp", "prep_phrase", "particle", "circumpos"],
    "AUX": ["verb"],
    "CCONJ": ["conj"],
    "SCONJ": ["conj"],
    "DET": ["det", "article", "adnominal"],
    "PRON": ["pron"],
    "NUM": ["num", "counter"],
    "PART": ["particle"],
    "INTJ": ["intj"],
    "PUNCT": ["punct", "symbol"],
    "SYM": ["symbol", "punct"],
    "X": ["syllable", "[]"],
}
# Korean and Vietnamese tag sets.
CASE_PARTICLE = ["particle", "postp", "circumpos"]
FOREIGN = ["syllable", "[]", "contraction"]
KOREAN = {
    "ncn": ["noun", "name", "suffix", "counter", *NOUN_AFFIXES], "ncpa": ["noun", "verb"], "ncps": ["noun", "adj", "adv"], "nbn": ["noun"], "nbu": ["noun", "counter"],
    "nnc": ["num", "counter"], "nno": ["num", "counter"], "npd": ["pron"], "npp": ["pron"], "nq": ["name", "noun"], "pvg": ["verb"], "pvd": ["verb"], "paa": ["adj"],
    "pad": ["det", "adnominal"], "px": ["verb", "adj"], "ecc": ["suffix", "particle", "conj"], **{t: ["suffix", "particle"] for t in ("ecs", "ecx", "ef", "ep", "etm", "etn")},
    **{t: CASE_PARTICLE for t in ("jca", "jcc", "jcm", "jco", "jcr", "jcs", "jct", "jp", "jcv", "jxc", "jxf", "jxt")}, "jcj": [*CASE_PARTICLE, "conj"],
    "mad": ["adv"], "mag": ["adv"], "maj": ["adv", "conj"], "mma": ["det", "adnominal"], "mmd": ["det", "adnominal"], "xp": ["prefix", "suffix", "affix"],
    "xsa": ["suffix", "adj", "affix"], "xsm": ["suffix", "adv", "affix"], "xsn": ["suffix", "particle", "affix"], "xsv": ["suffix", "verb", "affix"], "ii": ["intj"],
    **{t: FOREIGN for t in ("sf", "sl", "sp", "sr", "su", "f", "_")},
}
VIETNAMESE = {
    "N": ["noun"], "Np": ["name"], "Nc": ["classifier"], "Nu": ["classifier", "noun"], "Nb": ["noun"], "Ny": ["name", "noun"], "V": ["verb"], "A": ["adj"], "P": ["pron"],
    "R": ["adv"], "L": ["det"], "M": ["num"], "E": ["prep"], "C": ["conj"], "CC": ["conj"], "I": ["intj"], "T": ["particle"], "S": ["affix", "prefix", "suffix", "combining_form"],
    "Y": ["name", "noun"], "CH": ["punct", "symbol"],
}
EXEMPT = ["proverb", "phrase", "prep_phrase"]
VIETNAMESE_EXEMPT = ["proverb", "phrase", "punct", "symbol"]
HIDDEN = ["character", "romanization", "root", "syllable", "punct", "symbol"]
VIETNAMESE_HIDDEN = ["character", "romanization"]
CHARACTER_LANGS = ["zh", "zh-hant", "ja", "ko", "yue", "wuu", "lzh"]
# Tags of forms that are shown apart, and of forms that only point elsewhere.
SPECIAL = {"hanja": "hanja", "hangeul": "hangeul", "cjk": "cjk", "sinitic": "cjk", "hán-nôm": "cjk", "han-nom": "cjk", "hannom": "cjk"}
ALTERNATE = ["alternative", "redirect", "eumhun", "syllable"]
ROW = "array<struct<word:string,commentary:string,roman:string>>"


def pos_name(pos: Column, tags: Column) -> Column:
    """The part of speech, after a tag that tells a noun made from a verb has its say."""
    return F.when(F.lower(F.coalesce(tags, F.lit(""))).rlike("\\bnoun\\b.{0,10}\\bverb\\b"), F.lit("noun")).otherwise(F.lower(strip(pos)))


def hidden(pos: Column, db: Column, names: list[str] = HIDDEN) -> Column:
    """Entries that are shown only where there is nothing else (F20); single characters count where words are written with them."""
    plain = F.lower(strip(pos)).isin(names)
    return plain & ~(F.lower(strip(pos)).eqNullSafe("character") & (lang_of(db).isin(CHARACTER_LANGS))) if names is HIDDEN else plain


def sides(rows: DataFrame, group: list[str], allowed: list[str], exempt: list[str] = EXEMPT, hide: list[str] = HIDDEN) -> DataFrame:
    """``rows`` (with db, pos, tags) with ``side``: primary or other, within each group.

    Hidden entries are other as long as there are any more. Of the rest those are primary whose part of speech is allowed
    or exempt; where there is one entry only, no such entry, or nothing is allowed at all, all of them are.
    """
    told = rows.withColumns({"_hidden": hidden(F.col("pos"), F.col("db"), hide), "_name": pos_name(F.col("pos"), F.col("tags"))})
    fits = F.col("_name").isin([*allowed, *exempt]) if allowed else F.lit(True)
    told = told.withColumn("_fits", fits)
    own = told.groupBy(*group).agg(F.count_if(~F.col("_hidden")).alias("_open"), F.count(F.lit(1)).alias("_all"), F.count_if(~F.col("_hidden") & F.col("_fits")).alias("_open_fit"), F.count_if("_fits").alias("_all_fit"))
    joined = told.join(own.select(*(F.col(g).alias(f"_{g}") for g in group), "_open", "_all", "_open_fit", "_all_fit"), [told[g].eqNullSafe(F.col(f"_{g}")) for g in group])
    n, n_fit = (F.when(F.col("_open") > 0, F.col(f"_open{x}")).otherwise(F.col(f"_all{x}")) for x in ("", "_fit"))
    aside = F.col("_hidden") & (F.col("_open") > 0)
    side = F.when(aside, "other").when((n <= 1) | (n_fit == 0) | F.col("_fits"), "primary").otherwise("other")
    return joined.withColumn("side", side).select(*rows.columns, "side")


def surface_refs(words: DataFrame, entries: DataFrame, forms: DataFrame) -> DataFrame:
    """References of words by exact surface: word, db, entry_id, match_kind, form_id (0 for a headword).

    An entry whose headword is the word is a headword match; else its first such form triggers the match.
    """
    asked = words.where("word <> ''").select("word").distinct()
    heads = asked.join(entries.select(F.col("headword").alias("word"), "db", F.col("id").alias("entry_id")), "word").withColumn("form_id", F.lit(0).cast("bigint"))
    known = entries.select(F.col("id").alias("entry_id"), "db")
    by_form = asked.join(forms.select(F.col("form_text").alias("word"), "entry_id", F.col("id").alias("form_id")), "word").groupBy("word", "entry_id").agg(F.min("form_id").alias("form_id")).join(known, "entry_id")
    every = heads.unionByName(by_form.select(heads.columns))
    return every.groupBy("word", "db", "entry_id").agg(F.min("form_id").alias("form_id")).withColumn("match_kind", F.when(F.col("form_id") == 0, "headword").otherwise("form"))


def matched_forms(refs: DataFrame, forms: DataFrame) -> DataFrame:
    """The forms of each reference's entry that are its word, each once (M02): word, entry_id, form_text, tags, roman, form_id."""
    own = forms.select("entry_id", F.col("form_text").alias("word"), F.col("id").alias("form_id"), strip(F.col("form_text")).alias("form_text"), strip(F.col("morph_tags")).alias("tags"), strip(F.col("romanization")).alias("roman"))
    return refs.select("word", "entry_id").distinct().join(own, ["word", "entry_id"]).groupBy("word", "entry_id", "form_text", "tags", "roman").agg(F.min("form_id").alias("form_id"))


def special_forms(refs: DataFrame, entries: DataFrame, forms: DataFrame) -> DataFrame:
    """Forms that are shown with an entry whatever was asked (M02): those with a special tag, and those like the headword."""
    heads = entries.select(F.col("id").alias("entry_id"), F.lower("headword").alias("h")).join(refs.select("entry_id").distinct(), "entry_id", "left_semi")
    tagged = F.coalesce(F.lower("morph_tags").rlike("|".join(SPECIAL)), F.lit(False))
    rows = forms.join(heads, "entry_id").where(tagged | F.coalesce(F.lower("form_text") == F.col("h"), F.lit(False)))
    return rows.select("entry_id", strip(F.col("form_text")).alias("form_text"), strip(F.col("morph_tags")).alias("tags"), strip(F.col("romanization")).alias("roman")).distinct()


def _text(x) -> str:
    return "" if x is None or x is False else str(x)


def form_rows_of(raw: str | None) -> list[dict]:
    """Stored forms of any shape as (word, commentary, roman), each triple once."""
    try:
        got = json.loads(raw) if raw else []
    except (ValueError, RecursionError):
        return []
    out: dict[tuple, None] = {}
    for x in got if isinstance(got, list) else []:
        if isinstance(x, dict):
            first = lambda *names: next((_text(x[n]) for n in names if x.get(n)), "")
            row = first("word", "form", "headword", "form_text", "display_text"), first("commentary", "tags"), first("romanization", "reading", "form_roman")
        elif isinstance(x, list):
            row = tuple(_text(y) for y in [*x, None, None, None][:3])
        else:
            row = _text(x), "", ""
        out[row] = None
    return [dict(zip(("word", "commentary", "roman"), row)) for row in out]


def form_rows(raw: Column) -> Column:
    """``form_rows_of`` as a vectorised column."""

    @F.pandas_udf(ROW)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([form_rows_of(v) for v in values], dtype=object)

    return run(raw)


def buckets(tags: Column) -> Column:
    """The kinds of special forms that tags name, with or without accents."""
    parts = F.split(F.lower(strip(tags)), "[;|,\\s]+")
    named = F.create_map(*(F.lit(x) for pair in SPECIAL.items() for x in pair))
    return F.array_distinct(F.array_compact(F.transform(parts, lambda t: F.coalesce(F.element_at(named, t), F.element_at(named, F.regexp_replace(t, "\\p{M}+", ""))))))


def display_rows(entries: DataFrame, special: DataFrame) -> DataFrame:
    """Form rows to show with an entry (M03): entry_id, word, commentary, roman; special kinds are added to the commentary."""
    stored = spread(entries.select(F.col("id").alias("entry_id"), "forms")).select("entry_id", F.inline(form_rows(F.col("forms"))))
    every = stored.unionByName(special.select("entry_id", F.col("form_text").alias("word"), F.col("tags").alias("commentary"), "roman"))
    added = F.array_except(buckets(F.col("commentary")), F.split(F.lower(F.trim("commentary")), "[;|,\\s]+"))
    whole = F.when(F.size(added) > 0, F.concat_ws(";", F.nullif("commentary", F.lit("")), F.array_join(added, ";"))).otherwise(F.col("commentary"))
    return every.select("entry_id", "word", whole.alias("commentary"), "roman").distinct()


def imported_forms(entries: DataFrame) -> DataFrame:
    """entry_id, word, tags, roman of the stored forms that add a surface."""
    rows = spread(entries.select(F.col("id").alias("entry_id"), "db", F.trim(F.coalesce("headword", F.lit(""))).alias("h"), "forms")).select("entry_id", "h", lang_of(F.col("db")).alias("lang"), F.inline(form_rows(F.col("forms"))))
    named = rows.select("entry_id", "h", "lang", F.trim("word").alias("word"), F.trim("commentary").alias("tags"), F.trim("roman").alias("roman"))
    itself = (F.col("word") == F.col("h")) & ((F.col("lang") == "ko") | F.array_contains(F.transform(F.split(F.lower("tags"), ";"), lambda t: F.trim(t)), "alternative"))
    return named.where((F.col("word") != "") & ~itself).select("entry_id", "word", "tags", "roman").distinct()


def alternate(tags: Column) -> Column:
    """Whether tags say that a form only stands for another."""
    return F.arrays_overlap(F.split(F.lower(strip(tags)), "[;|,\\s]+"), F.array(*map(F.lit, ALTERNATE)))


def payload(refs: DataFrame, entries: DataFrame, forms: DataFrame) -> DataFrame:
    """What is shown of each reference."""
    wide = entries.select(F.col("id").alias("entry_id"), strip(F.col("headword")).alias("lemma_headword"), strip(F.col("romanization")).alias("entry_reading"), "pos", "tags", "source", F.col("entry_id").alias("source_id"))
    own = forms.select(F.col("id").alias("form_id"), strip(F.col("form_text")).alias("form_text"), strip(F.col("romanization")).alias("form_reading"), strip(F.col("morph_tags")).alias("form_tags"))
    by_form = F.col("match_kind") == "form"
    return refs.join(wide, "entry_id").join(own, "form_id", "left").select(
        "word",
        "db",
        "entry_id",
        F.concat_ws("|", F.lit("sqlite"), "db", "entry_id", F.when(F.col("form_id") > 0, F.col("form_id"))).alias("ref_key"),
        "match_kind",
        F.when(by_form & (F.col("form_text") != ""), F.col("form_text")).otherwise(F.col("lemma_headword")).alias("display_headword"),
        "lemma_headword",
        F.when(by_form, F.col("form_reading")).otherwise(F.col("entry_reading")).alias("display_reading"),
        F.when(by_form & (F.col("form_tags") != ""), F.col("form_tags")).alias("morph_info"),
        F.when(by_form & (F.col("lemma_headword") != ""), F.col("lemma_headword")).alias("morph_base"),
        F.coalesce(by_form & alternate(F.col("form_tags")), F.lit(False)).alias("is_alternate"),
        "pos",
        F.col("tags").alias("entry_tags"),
        "form_id",
    )


def merged(shown: DataFrame, upos: str) -> DataFrame:
    """Headword and form matches of a word as one list (J20): word, ref_key, match_kind, side.

    Alternates are other while the word has any more entries; those are split by their part of speech.
    """
    rows = shown.withColumnRenamed("entry_tags", "tags")
    own = rows.groupBy("word").agg(F.count_if(~F.col("is_alternate")).alias("_plain"))
    split = sides(rows.where("not is_alternate"), ["word"], UPOS.get(upos, [])).select("word", "ref_key", "match_kind", "entry_id", "form_id", "side")
    rest = rows.where("is_alternate").join(own, "word").select("word", "ref_key", "match_kind", "entry_id", "form_id", F.when(F.col("_plain") > 0, "other").otherwise("primary").alias("side"))
    return split.unionByName(rest)
