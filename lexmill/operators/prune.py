"""Prune policy as expressions: why a gloss, a tag set or a form is cut.

Tag folding and gloss flattening run as vectorised functions over the distinct strings of a batch; everything
else is built-in expressions. Lists of exact forms per dictionary are tables given by the caller, joined
on (db, form_text).
"""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.exprs import strip, word_count

# Fixed values of the policy.
HARD_DROP_TAGS = "auxiliary class classifier counter includes-article inflection-template multiword-construction table-tags".split()
ALWAYS_KEEP_TAGS = "baybayin bopomofo cjk han-nom hangeul hangul hanja hannom hiragana hán-nôm jyutping kana katakana pinyin reading revised romaji romanisation romanization transliteration".split()
ALWAYS_KEEP_PARTS = ["bopomofo", "jyutping", "mccune", "pinyin", "reading", "revised romanization", "romaji", "romanisation", "romanization", "transliteration", "yale"]
SCRIPT_TAGS = "baybayin cjk han-nom hangeul hanja hannom hán-nôm".split()
EAST_ASIAN_DBS = "ja ja-jmdict ko ko-krdict lzh lzh-wiktionary zh zh-cc-cedict zh-hant zh-hant-cc-cedict".split()
CODELIKE_EXEMPT_DBS = [*EAST_ASIAN_DBS, "vi"]
WORD_COUNT_EXEMPT_DBS = [*EAST_ASIAN_DBS, "grc", "vi"]
FANOUT_EXEMPT_DBS = [*EAST_ASIAN_DBS, "grc"]
FANOUT_MOST = 10
SCRIPTS = {
    "Latin": "\\u0041-\\u024F\\u1E00-\\u1EFF\\u2C60-\\u2C7F\\uA720-\\uA7FF",
    "Greek": "\\u0370-\\u03FF\\u1F00-\\u1FFF",
    "Cyrillic": "\\u0400-\\u052F\\u2DE0-\\u2DFF\\uA640-\\uA69F\\u1C80-\\u1C8F",
    "Hebrew": "\\u0590-\\u05FF\\uFB1D-\\uFB4F",
    "Arabic": "\\u0600-\\u06FF\\u0750-\\u077F\\u0870-\\u08FF\\uFB50-\\uFDFF\\uFE70-\\uFEFF",
    "Han": "\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2EBEF}\\x{30000}-\\x{3134F}",
}
_KNOWN = "".join(SCRIPTS.values())
LETTER_OF = {name: f"[\\p{{L}}&&[{members}]]" for name, members in SCRIPTS.items()} | {"Other": f"[\\p{{L}}&&[^{_KNOWN}]]"}
PROSE_HINT = "(?i)\\b(?:form|forms|formed|using|present|past|future|perfect|imperfect|simple|particle|appendix|information|note|marks|case|instead|other|desiderative|imperative|indicative|subjunctive|conditional|participle|voice|aspect|declension|conjugation|dialect|modern|standard|swahili|absent|table)\\b"
ALTERNATION_LABEL = "(?i)^[a-z][a-z-]*-[a-z][a-z-]*\\s+alternation$"
ROMAN_NUMERAL = "^(?=.)M{0,4}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})\\.?$"
#: Inflection classes that stand where a form should: each names what it matches.
CLASS_CODES = {
    "numbered class, perhaps with a letter or a plus": "\\d+(?:[a-z]|\\+[1-9])?(?:\\s+Anglian)?",
    "strong or weak class": "\\d+\\s+(?:strong|weak)",
    "Roman class with a letter": "[IVXLCDM]+\\s+[a-z]\\.?",
    "Roman class": "[IVXLCDM]+\\.?",
    "letter with a stop": "[A-Za-z]\\.",
    "starred a class": "a\\*\\d?",
    "starred a class in brackets": "a\\*\\[[^\\]]+\\]",
    "starred b class": "b\\*\\d?",
    "starred c class": "c(?:ʹ)?\\*",
    "class with an aspect": "[1-9]\\d*[a-z]?\\s+(?:perfective|imperfective).+",
    "accent class": "accent-[a-z]",
    "stem label": ".+-stem",
}
BROKEN_TEMPLATE = "\\{\\{\\{.+\\}\\}\\}|[{}]|[()]?.+\\([^-)]*$"
HEBREW_PLACEHOLDER = "^[\\u0590-\\u05FF\\uFB1D-\\uFB4F]+$"
PLAIN_WORD = "^(?![IVXLCDM]+$)[\\p{L}\\p{M}&&[^\\u0590-\\u05FF\\uFB1D-\\uFB4F]]+$"
SPLIT_PAGE = "(?i)/languages [A-Z] to [A-Z]$"
RELATION_GLOSS = "(?i)^(?:alternative|obsolete|archaic|dated|rare|nonstandard|plural|feminine|masculine|past|present|inflection|variant|synonym|form|spelling|misspelling|abbreviation|initialism|romanization)\\b.*\\bof\\s+\\S+"


def _flatten(node, out: list[str]) -> None:
    if isinstance(node, str):
        if node.strip():
            out.append(node.strip())
    elif isinstance(node, list):
        for x in node:
            _flatten(x, out)
    elif isinstance(node, dict):
        if isinstance(node.get("glosses"), list):
            _flatten(node["glosses"], out)
        for member in ("gloss", "text", "definition", "def"):
            if isinstance(node.get(member), str):
                _flatten(node[member], out)


def gloss_list(raw: str | None) -> tuple[list[str], bool]:
    """The glosses of a stored value of any shape, and whether JSON in it was unreadable."""
    text, broken = (raw or "").strip(), False
    node: object = text
    if text[:1] in ("[", "{"):
        try:
            node = json.loads(text)
        except (ValueError, RecursionError):
            broken = True
    out: list[str] = []
    if isinstance(node, str):
        out = [node] if node else []
    else:
        _flatten(node, out)
    return out, broken


def fold_tags(raw: str | None) -> list[str]:
    """Folded tags of a ``;`` list in order, each once."""
    return list(dict.fromkeys(t for x in (raw or "").split(";") if (t := unicodedata.normalize("NFKC", x.strip()).casefold())))


def _over_distinct(series: pd.Series, f) -> pd.Series:
    codes, values = pd.factorize(series, use_na_sentinel=False)
    got = [f(None if pd.isna(v) else v) for v in values]
    return pd.Series([got[c] for c in codes], dtype=object)


def folded_tags(raw: Column) -> Column:
    """``fold_tags`` as a vectorised column."""

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return _over_distinct(values, fold_tags)

    return run(raw)


def glosses(raw: Column) -> Column:
    """``gloss_list`` without its flag as a vectorised column."""

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return _over_distinct(values, lambda v: gloss_list(v)[0])

    return run(raw)


def gloss_bucket(items: Column) -> Column:
    """missing, symbol_only, non_latin_only or ok."""
    letter = F.exists(items, lambda x: x.rlike("\\p{L}"))
    latin = F.exists(items, lambda x: x.rlike(LETTER_OF["Latin"]))
    return F.when(F.size(items) < 1, "missing").when(~letter, "symbol_only").when(~latin, "non_latin_only").otherwise("ok")


def entry_cut(bucket: Column) -> Column:
    """Why an entry is cut, empty for kept."""
    return F.when(bucket == "ok", F.lit("")).otherwise(F.concat(F.lit("gloss_"), bucket))


def always_kept(tags: Column) -> Column:
    """Tags that keep a form whatever else holds."""
    parts = "|".join(ALWAYS_KEEP_PARTS)
    return F.arrays_overlap(tags, F.array(*map(F.lit, ALWAYS_KEEP_TAGS))) | F.exists(tags, lambda t: t.rlike(parts))


def tag_cut(tags: Column) -> Column:
    """The first hard-drop tag in sorted order."""
    hit = F.array_min(F.array_intersect(tags, F.array(*map(F.lit, HARD_DROP_TAGS))))
    return F.when(hit.isNotNull(), F.concat(F.lit("hard_tag:"), hit)).otherwise(F.lit(""))


def text_cut(db: Column, form: Column) -> Column:
    """Why the text of a stripped form is cut, empty for kept (F08). Plain words are passed by one test."""
    s, code = form, ~F.lower(db).isin(CODELIKE_EXEMPT_DBS)
    unbalanced = F.length(F.regexp_replace(s, "[^(]", "")) != F.length(F.regexp_replace(s, "[^)]", ""))
    prose = (word_count(s) >= 4) & s.rlike("[A-Za-z]") & (s.rlike(PROSE_HINT) | s.rlike("[.:]"))
    hebrew = s.rlike(HEBREW_PLACEHOLDER) & F.regexp_replace(s, "[\\p{M}\\p{P}]", "").rlike("קטל|קטר")
    rules = [
        (s == "", "blank"),
        (s.rlike(ALTERNATION_LABEL), "alternation_label"),
        (code & s.rlike(ROMAN_NUMERAL), "roman_numeral"),
        (code & s.rlike("^(?:" + "|".join(CLASS_CODES.values()) + ")$"), "class_code"),
        (s.rlike(BROKEN_TEMPLATE) | unbalanced, "template_leak"),
        (prose, "english_prose"),
        (hebrew, "hebrew_placeholder"),
    ]
    found = F.coalesce(*(F.when(test, F.lit(f"hard_text:{name}")) for test, name in rules), F.lit(""))
    return F.when(s.rlike(PLAIN_WORD), F.lit("")).otherwise(found)


def edge_hyphen_mismatch(form: Column, head: Column) -> Column:
    """An affix hyphen at the form but not at the headword."""
    return F.coalesce(form, F.lit("")).rlike("^-|-$") & ~F.coalesce(head, F.lit("")).rlike("^-|-$")


def disjoint_scripts(form: Column, head: Column) -> Column:
    """Both hold letters, of no common script."""
    f = F.array_compact(F.array(*(F.when(form.rlike(p), F.lit(n)) for n, p in LETTER_OF.items())))
    h = F.array_compact(F.array(*(F.when(head.rlike(p), F.lit(n)) for n, p in LETTER_OF.items())))
    return (F.size(f) > 0) & (F.size(h) > 0) & ~F.arrays_overlap(f, h)


def zero_overlap(form: Column, head: Column) -> Column:
    """No common script and no common character."""
    return (F.substring(form, 1, 1) != F.substring(head, 1, 1)) & ~F.arrays_overlap(F.split(form, ""), F.split(head, "")) & disjoint_scripts(form, head)


def word_count_cut(db: Column, form: Column, head: Column, tags: Column, kept: Column | None = None) -> Column:
    """Another number of words than the headword."""
    exempt = F.lower(db).isin(WORD_COUNT_EXEMPT_DBS) | (always_kept(tags) if kept is None else kept) | F.arrays_overlap(tags, F.array(*map(F.lit, SCRIPT_TAGS)))
    single = ~form.rlike("(?U)\\s") & ~head.rlike("(?U)\\s") & (form != "") & (head != "")
    return F.when(~exempt & ~single & (word_count(form) != word_count(head)), "rule_a_word_count").otherwise(F.lit(""))


def occurrence_cut(db: Column, form: Column, head: Column, tags: Column, white: Column | None = None, black: Column | None = None, kept: Column | None = None) -> Column:
    """Why an occurrence (stripped texts) is cut, by fixed precedence; empty for kept.

    ``white`` and ``black`` tell whether the form is on an exact list (F15), ``kept`` is ``always_kept(tags)`` where that is known.
    """
    always = always_kept(tags) if kept is None else kept
    white, black = (F.coalesce(c, F.lit(False)) if c is not None else F.lit(False) for c in (white, black))
    f, h = F.coalesce(form, F.lit("")), F.coalesce(head, F.lit(""))
    code = ~F.lower(db).isin(CODELIKE_EXEMPT_DBS)

    def named(c: Column) -> Column:
        return F.when(c != "", c)

    passed = white | always
    later = F.coalesce(F.when(black, F.lit("exact_blacklist")), named(tag_cut(tags)), named(text_cut(db, f)), F.when(code & zero_overlap(f, h), F.lit("hard_text:zero_overlap_cross_script")), named(word_count_cut(db, f, h, tags, always)), F.lit(""))
    return F.when((f == h) & (f != ""), F.lit("hard_text:identical_to_headword")).when(edge_hyphen_mismatch(f, h), F.lit("hard_text:hyphen_affix_mismatch")).when(passed, F.lit("")).otherwise(later)


def fanout_cut(db: Column, entries: Column, most: int = FANOUT_MOST) -> Column:
    """A surface of too many entries."""
    return ~F.lower(strip(db)).isin(FANOUT_EXEMPT_DBS) & (entries > most)


def chosen_reason(reasons: Column) -> Column:
    """The one reason shown for a bucket of them."""
    order = ["exact_blacklist", "hard_tag:", "hard_text:", "rule_a_word_count", "fanout_gt_10"]

    def first(prefix):
        return F.try_element_at(F.filter(reasons, lambda r: r.startswith(prefix)), F.lit(1))

    return F.coalesce(*map(first, order), F.try_element_at(reasons, F.lit(1)), F.lit(""))


def extra_rules(db: Column, form: Column, head: Column, tags: Column) -> Column:
    """All of five further rules that match an occurrence."""
    romanised = F.exists(tags, lambda t: t.rlike("romani[sz]ation|transliteration"))
    rules = [
        (F.arrays_overlap(tags, F.array(F.lit("auxiliary"), F.lit("auxilliary"))), "auxiliary_tag"),
        (F.arrays_overlap(tags, F.array(F.lit("used-in-the-form"), F.lit("used in the form"))), "used_in_the_form_tag"),
        (form == head, "exact_headword"),
        (edge_hyphen_mismatch(form, head), "edge_hyphen_form_only"),
        (~F.lower(strip(db)).isin(EAST_ASIAN_DBS) & ~romanised & disjoint_scripts(form, head), "cross_script_non_romanization"),
    ]
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in rules)))


def relation_only(items: Column) -> Column:
    """Glosses that only point to another word."""
    told = F.filter(items, lambda x: F.trim(x) != "")
    return (F.size(told) > 0) & F.forall(told, lambda x: x.rlike(RELATION_GLOSS))


def of_targets(items: Column) -> Column:
    """The word after "of" in each gloss."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.regexp_extract(x, "\\bof\\s+(\\S+?)[\\s.,;:!?)\\]}\"'`]*$", 1)), lambda x: x != ""))


def placeholder(db: Column, pos: Column, items: Column) -> Column:
    """Entries of the Korean learners' dictionary without a known part of speech and without any gloss in Latin letters."""
    unknown = F.lower(strip(pos)).isin("", "[]", "unk", "unknown")
    return (F.lower(strip(db)) == "ko-krdict") & unknown & ~F.exists(items, lambda x: x.rlike("[A-Za-z]"))


def pos_bucket(pos: Column) -> Column:
    """Part of speech by the first matching pattern."""
    p = F.lower(strip(pos))
    patterns = [("^(proper )?noun|^name|^proper", "nominal"), ("^verb", "verbal"), ("^adj|^adv|^det|^num", "modifier"), ("fix$|^particle|^prep|^conj|^root|^counter|^character", "functional")]
    out = F.when(p == "", "blank")
    for pattern, name in patterns:
        out = out.when(p.rlike(pattern), name)
    return out.otherwise("other")


def exact_list(forms: DataFrame, listed: DataFrame | None, name: str) -> DataFrame:
    """``forms`` with a flag whether (db, form_text) is on a list."""
    if listed is None:
        return forms.withColumn(name, F.lit(False))
    keys = listed.select(F.lower(strip(F.col("db"))).alias("_db"), strip(F.col("form_text")).alias("_form"), F.lit(True).alias(name)).distinct()
    on = (F.lower(strip(forms["db"])) == keys["_db"]) & (strip(forms["form_text"]) == keys["_form"])
    return forms.join(keys, on, "left").drop("_db", "_form").fillna({name: False})
