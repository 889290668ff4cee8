"""SQL for the queries over the lexical store, put together from parts that mirror the policy's expressions.

It is the other side of the comparison: written from the policy's fixed values in the dialect of the checking engine,
not from the plans.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from lexmill.functions import normalize
from lexmill.operators import prune

WS = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^[{WS}]+|[{WS}]+$', '', 'g')"


def word_count(x: str) -> str:
    return f"(case when {strip(x)} = '' then 0 else len(regexp_split_to_array({strip(x)}, '[{WS}]+')) end)"


def quoted(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


def _ranges(points: list[int]) -> str:
    out, start, last = [], None, None
    for p in [*points, None]:
        if start is not None and (p is None or p != last + 1):
            out.append(f"\\x{{{start:X}}}-\\x{{{last:X}}}")
            start = None
        if start is None:
            start = p
        last = p
    return "".join(out)


@lru_cache(1)
def _letters() -> dict[str, str]:
    """Script -> members of a class of its letters."""
    out = {}
    for name, members in prune.SCRIPTS.items():
        points: list[int] = []
        at = members.replace("\\u", "|").replace("\\x{", "|").replace("}", "").split("|")[1:]
        bounds = [int(x.rstrip("-"), 16) for x in at]
        for a, b in zip(bounds[::2], bounds[1::2]):
            points += [p for p in range(a, min(b, sys.maxunicode) + 1) if unicodedata.category(chr(p))[0] == "L"]
        out[name] = _ranges(sorted(set(points)))
    return out


def has_letters(x: str, name: str) -> str:
    known = _letters()
    if name == "Other":
        return f"regexp_matches(regexp_replace({x}, '[{''.join(known.values())}]', '', 'g'), '\\p{{L}}')"
    return f"regexp_matches({x}, '[{known[name]}]')"


NAMES = [*prune.SCRIPTS, "Other"]


def scripts(x: str) -> str:
    return "list_filter([" + ", ".join(f"case when {has_letters(x, n)} then '{n}' end" for n in NAMES) + "], lambda s: s is not null)"


def no_common_script(f: str, h: str) -> str:
    return f"(len({f}) > 0 and len({h}) > 0 and not list_has_any({f}, {h}))"


#: Glosses of every entry: gl(id, db, gloss).
GLOSSES = rf"""
js as (select id, db, {strip('glosses')} as t from entries),
jv as (select *, t[1] in ('[', '{{') and json_valid(t) as is_json from js),
gl as (
  select id, db, t as gloss from jv where not is_json and t <> ''
  union all
  select v.id, v.db, {strip("x.atom->>'$'")} as gloss from (select * from jv where is_json) v, lateral (select * from json_tree(v.t)) x
  where x.type = 'VARCHAR' and regexp_matches(x.fullkey, '^\$(\[\d+\]|\.glosses\[\d+\])*(\.(gloss|text|definition|def))?$') and {strip("x.atom->>'$'")} <> ''
)"""
_LATIN = _letters()["Latin"]
#: Why entries are cut: cuts(id, db, headword, romanization, pos, glosses, reason).
CUTS = GLOSSES + rf""",
gb as (select id, count(*) as n, bool_or(regexp_matches(gloss, '\p{{L}}')) as letter, bool_or(regexp_matches(gloss, '[{_LATIN}]')) as latin from gl group by id),
cuts as (select e.id, e.db, {strip('e.headword')} as headword, {strip('e.romanization')} as romanization, {strip('e.pos')} as pos, {strip('e.glosses')} as glosses,
  case when gb.n is null then 'gloss_missing' when not letter then 'gloss_symbol_only' when not latin then 'gloss_non_latin_only' else '' end as reason
  from entries e left join gb on gb.id = e.id)"""
#: Survivors of equal entries: sv(id, survivor_id, db, headword).
SURVIVORS = CUTS + """,
sv as (select id, min(id) over (partition by coalesce(db, ''), headword, romanization, pos, glosses) as survivor_id, db, headword from cuts where reason = '' and id > 0)"""
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_PLAIN = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")


def folded(x: str) -> str:
    """A tag without width and case."""
    return f"lower(translate({x}, '{_WIDE}\u3000', '{_PLAIN} '))"


def folded_tags(x: str) -> str:
    """Tags of a list divided by semicolons, in order, each once."""
    every = f"list_filter(list_transform(string_split(coalesce({x}, ''), ';'), lambda t: {folded(strip('t'))}), lambda t: t <> '')"
    return f"list_filter({every}, lambda t, i: list_position({every}, t) = i)"


def always_kept(tags: str) -> str:
    return f"(len(list_filter({tags}, lambda t: t in ({quoted(prune.ALWAYS_KEEP_TAGS)}) or regexp_matches(t, '{'|'.join(prune.ALWAYS_KEEP_PARTS)}'))) > 0)"


def tag_cut(tags: str) -> str:
    return f"coalesce('hard_tag:' || list_min(list_filter({tags}, lambda t: t in ({quoted(prune.HARD_DROP_TAGS)}))), '')"


def _re(pattern: str) -> str:
    """A pattern of the policy in the checking engine's dialect."""
    return pattern.replace("^(?=.)", "^").replace("\\u", "\\x").replace("'", "''")


def _hex(pattern: str) -> str:
    import re

    return re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", pattern)


def text_cut(db: str, s: str) -> str:
    code = f"lower({db}) not in ({quoted(prune.CODELIKE_EXEMPT_DBS)})"
    unbalanced = f"length(regexp_replace({s}, '[^(]', '', 'g')) <> length(regexp_replace({s}, '[^)]', '', 'g'))"
    hebrew = f"(regexp_matches({s}, '{_hex(prune.HEBREW_PLACEHOLDER)}') and regexp_matches(regexp_replace({s}, '[\\p{{M}}\\p{{P}}]', '', 'g'), 'קטל|קטר'))"
    rules = [
        (f"{s} = ''", "blank"),
        (f"regexp_matches({s}, '{prune.ALTERNATION_LABEL}')", "alternation_label"),
        (f"{code} and {s} <> '' and regexp_matches({s}, '{_re(prune.ROMAN_NUMERAL)}')", "roman_numeral"),
        (f"{code} and regexp_matches({s}, '^(?:{'|'.join(prune.CLASS_CODES.values())})$')", "class_code"),
        (f"regexp_matches({s}, '{prune.BROKEN_TEMPLATE}') or {unbalanced}", "template_leak"),
        (f"{word_count(s)} >= 4 and regexp_matches({s}, '[A-Za-z]') and (regexp_matches({s}, '{prune.PROSE_HINT}') or regexp_matches({s}, '[.:]'))", "english_prose"),
        (hebrew, "hebrew_placeholder"),
    ]
    return "(case " + " ".join(f"when {test} then 'hard_text:{name}'" for test, name in rules) + " else '' end)"


def occurrence_cut(db: str, f: str, h: str, tags: str, fs: str, hs: str) -> str:
    """``f`` and ``h`` aren't null; ``fs`` and ``hs`` are their scripts."""
    edge = f"(regexp_matches({f}, '^-|-$') and not regexp_matches({h}, '^-|-$'))"
    code = f"lower({db}) not in ({quoted(prune.CODELIKE_EXEMPT_DBS)})"
    apart = f"({code} and {f}[1] <> {h}[1] and not list_has_any(string_split({f}, ''), string_split({h}, '')) and {no_common_script(fs, hs)})"
    exempt = f"(lower({db}) in ({quoted(prune.WORD_COUNT_EXEMPT_DBS)}) or {always_kept(tags)} or list_has_any({tags}, [{quoted(prune.SCRIPT_TAGS)}]))"
    return f"""(case when {f} = {h} and {f} <> '' then 'hard_text:identical_to_headword' when {edge} then 'hard_text:hyphen_affix_mismatch' when {always_kept(tags)} then ''
      when {tag_cut(tags)} <> '' then {tag_cut(tags)} when {text_cut(db, f)} <> '' then {text_cut(db, f)}
      when {apart} then 'hard_text:zero_overlap_cross_script' when not {exempt} and {word_count(f)} <> {word_count(h)} then 'rule_a_word_count' else '' end)"""


#: Forms beside their headword: occ(id, db, form_text, headword, tags, f, h).
OCCURRENCES = f"""
occ as (select f.id, f.db, f.form_text, e.headword, {folded_tags('f.morph_tags')} as tags, coalesce(f.form_text, '') as f, coalesce(e.headword, '') as h
  from forms f join entries e on e.id = f.entry_id),
ocs as (select *, {scripts('f')} as fs, {scripts('h')} as hs from occ)"""
_REASONED = f"with {OCCURRENCES}, r as (select db, form_text, {occurrence_cut('db', 'f', 'h', 'tags', 'fs', 'hs')} as reason from ocs)"

_HITS = f"""with {SURVIVORS},
jo as (select f.db, {strip('f.form_text')} as form_text, s.survivor_id, {strip('f.morph_tags')} as morph_tags, {strip('f.romanization')} as romanization, f.entry_id, f.id as form_id, s.headword
  from forms f join sv s on s.id = f.entry_id where {strip('f.form_text')} <> ''),
fi as (select * from (select *, row_number() over (partition by db, form_text, survivor_id, morph_tags, romanization order by entry_id, form_id, headword) as k from jo) where k = 1),
ft as (select *, {folded_tags('morph_tags')} as tags, {scripts('form_text')} as fs, {scripts('headword')} as hs from fi),
ju as (select *, {always_kept('tags')} as keep, {occurrence_cut('db', 'form_text', 'headword', 'tags', 'fs', 'hs')} as reason from ft),
ca as (select * from ju where not keep and reason = ''),
cr as (select db, form_text from ca group by 1, 2 having count(distinct survivor_id) > {prune.FANOUT_MOST} and lower({strip('db')}) not in ({quoted(prune.FANOUT_EXEMPT_DBS)})),
hits as (select db, form_text, survivor_id as entry_id, form_id, 'always' as kept_as from ju where keep
  union all select db, form_text, survivor_id, form_id, 'candidate' from ca where not exists (select 1 from cr where cr.db is not distinct from ca.db and cr.form_text = ca.form_text))"""

LANG = f"lower(split_part({strip('db')}, '-', 1))"


def _replaced(x: str, letters: dict[str, str]) -> str:
    for a, b in letters.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


_CHARS = "list_distinct(string_split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g'), ''))"
_ROMANISED = "len(list_filter(tags, lambda t: regexp_matches(t, 'romani[sz]ation|transliteration'))) > 0"
_EDGE = "(regexp_matches(f, '^-|-$') and not regexp_matches(h, '^-|-$'))"

LEXICAL = {
    "f02_gloss_buckets": f"with {CUTS} select db, reason, count(*) as n from cuts group by 1, 2",
    "f05_folded_tags": f"with t as (select id, {folded_tags('tags')} as l from entries) select id, unnest(range(1, len(l) + 1)) as place, unnest(l) as tag from t where len(l) > 0",
    "f07_tag_cuts": f"with {OCCURRENCES} select {tag_cut('tags')} as reason, {always_kept('tags')} as kept, count(*) as n from occ group by 1, 2",
    "f08_text_cuts": f"with s as (select db, {strip('form_text')} as s from forms) select {text_cut('db', 's')} as reason, count(*) as n from s group by 1",
    "f11_zero_overlap": f"with {OCCURRENCES} select id, form_text, headword from ocs where f[1] <> h[1] and not list_has_any(string_split(f, ''), string_split(h, '')) and {no_common_script('fs', 'hs')}",
    "f12_occurrence_cuts": f"{_REASONED} select db, reason, count(*) as n from r group by 1, 2",
    "f14_bucket_reason": f"""{_REASONED}, b as (select db, form_text, list_sort(list_distinct(list(reason))) as l from r where reason <> '' group by 1, 2)
        select db, form_text, coalesce(list_filter(l, lambda x: starts_with(x, 'exact_blacklist'))[1], list_filter(l, lambda x: starts_with(x, 'hard_tag:'))[1], list_filter(l, lambda x: starts_with(x, 'hard_text:'))[1],
          list_filter(l, lambda x: starts_with(x, 'rule_a_word_count'))[1], l[1], '') as reason from b""",
    "f22_unshared_chars": f"with {OCCURRENCES} select db, count(*) as n from occ where f <> '' and h <> '' and not list_has_any({_CHARS.format('f')}, {_CHARS.format('h')}) group by 1",
    "f23_extra_rules": f"""with {OCCURRENCES}, x as (select db, unnest([
        case when list_has_any(tags, ['auxiliary', 'auxilliary']) then 'auxiliary_tag' end, case when list_has_any(tags, ['used-in-the-form', 'used in the form']) then 'used_in_the_form_tag' end,
        case when f = h then 'exact_headword' end, case when {_EDGE} then 'edge_hyphen_form_only' end,
        case when lower({strip('db')}) not in ({quoted(prune.EAST_ASIAN_DBS)}) and not {_ROMANISED} and {no_common_script('fs', 'hs')} then 'cross_script_non_romanization' end]) as rule from ocs)
        select db, rule, count(*) as n from x where rule is not null group by 1, 2""",
    "f24_of_targets": rf"""with {GLOSSES}, t as (select distinct id, db, regexp_extract(gloss, '\bof\s+(\S+?)[\s.,;:!?)\]}}"''`]*$', 1) as target from gl)
        select id, db, target, exists (select 1 from entries e where e.db = t.db and e.headword = t.target) as is_headword from t where target <> ''""",
    "f25_relation_only": rf"with {GLOSSES} select id, db from gl group by 1, 2 having bool_and(regexp_matches(gloss, '{prune.RELATION_GLOSS}'))",
    "w01_survivors": f"with {SURVIVORS} select id, survivor_id from sv",
    "w02_form_hits": f"{_HITS} select * from hits",
    "j12_redirects": r"""with v as (select distinct id, db, unnest([regexp_extract(glosses, 'variant of ([^\s";|,.]+)', 1), trim(lemma)]) as target from entries), h as (select db, headword as target, min(id) as target_id from entries where headword <> '' group by 1, 2)
        select v.id, v.db, v.target, target_id from v join h on h.db = v.db and h.target = v.target where v.target <> '' and v.id <> target_id""",
    "f27_importable": f"""with {GLOSSES} select db, count(*) as n from entries e where trim(coalesce(headword, '')) <> '' and trim(coalesce(glosses, '')) <> ''
        and not (lower({strip('db')}) = 'ko-krdict' and lower({strip('pos')}) in ('', '[]', 'unk', 'unknown') and not exists (select 1 from gl where gl.id = e.id and regexp_matches(gloss, '[A-Za-z]'))) group by db""",
    "f01_glosses": f"with {GLOSSES} select id, gloss from gl",
    "f03_entry_cuts": f"with {CUTS} select id, reason from cuts",
    "f06_always_kept": f"with {OCCURRENCES} select id from occ where {always_kept('tags')}",
    "u03_disjoint": f"with {OCCURRENCES} select id from ocs where {no_common_script('fs', 'hs')}",
    "x08_stems": "select id, trim(substr(trim(headword), 1, length(trim(headword)) - 1)) as stem from entries where (db = 'ko' or db like 'ko-%') and lower(trim(pos)) in ('verb', 'adj') and trim(headword) like '%다' and length(trim(headword)) > 1",
    "x03_letter_folds": f"select id, case {LANG} " + " ".join(f"when '{g}' then {_replaced('headword', letters)}" for g, letters in normalize.FOLDS.items()) + " else headword end as folded from entries where headword is not null",
    "x04_without_marks": f"select id, case {LANG} " + " ".join(f"when '{g}' then regexp_replace(headword, '[{marks}]', '', 'g')" for g, marks in normalize.MARKS.items()) + " else headword end as bare from entries where headword is not null",
    "u01_stores": f"select 'entries' as store, {LANG} as lang, headword, id, pos from entries where headword <> '' union all select 'custom', lower(trim(language)), headword, id, pos from custom_dict_entries where headword <> ''",
    "j02_hydrated": """with a as (select form_text as word from forms_stage where form_text <> '' union select lemma from entries where lemma <> ''),
        m as (select a.word, e.db, e.id as entry_id, 0 as form_id from a join entries e on e.headword = a.word union all select a.word, e.db, e.id, f.id from a join forms f on f.form_text = a.word join entries e on e.id = f.entry_id),
        r as (select word, db, entry_id, min(form_id) as form_id from m group by 1, 2, 3)
        select r.word, concat_ws('|', 'sqlite', r.db, r.entry_id, case when r.form_id > 0 then r.form_id end) as ref_key, e.headword, e.pos, e.lemma, f.form_text as matched_form, f.morph_tags as matched_tags from r join entries e on e.id = r.entry_id left join forms f on f.id = r.form_id""",
}


def _signs(pattern: str) -> str:
    return f"""with m as (select db, headword, unnest(regexp_extract_all(headword, '{pattern}')) as mark from entries where headword is not null), c as (select db, mark, count(*) as n from m group by 1, 2),
        h as (select db, mark, headword, row_number() over (partition by db, mark order by headword) as k from (select distinct db, mark, headword from m))
        select c.db, c.mark, c.n, string_agg(h.headword, '|' order by h.headword) as samples from c join h on h.db = c.db and h.mark = c.mark and k <= 3 group by 1, 2, 3"""


AUDITS = {
    "a11_ngrams": r"""with w as (select id, list_filter(string_split(lower(regexp_replace(glosses, '[^A-Za-z ]', ' ', 'g')), ' '), lambda x: x <> '') as l from entries where glosses is not null),
        u as (select id, unnest(l) as a, unnest(range(len(l))) as k from w), g as (select a, lead(a) over (partition by id order by k) as b, lead(a, 2) over (partition by id order by k) as c from u),
        x as (select a || ' ' || b as gram from g where b is not null union all select a || ' ' || b || ' ' || c from g where c is not null) select gram, count(*) as n from x group by 1 having count(*) >= 5""",
    "a23_top_unigrams": r"""with w as (select form_tag, coalesce(occurrence_count, 0) as c, unnest(list_distinct(regexp_split_to_array(lower(trim(form_tag)), '[^a-z]+'))) as word from form_tags_flat where form_tag <> '')
        select word, count(distinct form_tag) as n_tags, cast(sum(c) as bigint) as mentions from w where word <> '' group by 1 order by 2 desc, 3 desc, 1 desc limit 50""",
    "a25_scripts": r"""with n as (select db, headword as c, length(regexp_replace(headword, '[^\p{Latin}]', '', 'g')) as "Latin", length(regexp_replace(headword, '[^\p{Greek}]', '', 'g')) as "Greek", length(regexp_replace(headword, '[^\p{Cyrillic}]', '', 'g')) as "Cyrillic",
          length(regexp_replace(headword, '[^\p{Arabic}]', '', 'g')) as "Arabic", length(regexp_replace(headword, '[^\p{Devanagari}]', '', 'g')) as "Devanagari", length(regexp_replace(headword, '[^\p{Hangul}]', '', 'g')) as "Hangul" from entries where headword is not null),
        m as (select *, ["Latin", "Greek", "Cyrillic", "Arabic", "Devanagari", "Hangul"] as l from n), s as (select db, case when regexp_matches(c, '[\p{Han}\p{Hiragana}\p{Katakana}]') then 'CJK' when list_max(l) = 0 then 'None'
          when len(list_filter(l, lambda x: x = list_max(l))) > 1 then 'Mixed' else ['Latin', 'Greek', 'Cyrillic', 'Arabic', 'Devanagari', 'Hangul'][list_position(l, list_max(l))] end as script from m)
        select db, script, count(*) as n from s group by 1, 2""",
    "a27_marks": _signs(r"\p{M}"),
    "a27_other_signs": _signs(r"[^\p{L}\p{M}\p{N} -]"),
    "a27_scripts": "select db, " + ", ".join(f"cast(sum(length(regexp_replace(headword, '[^{members}]', '', 'g'))) as bigint) as {name.lower()}" for name, members in _letters().items()) + " from entries where headword is not null group by 1",
    "w03_kept": f"{_HITS} select db, kept_as, count(*) as n from hits group by 1, 2",
    "f04_scripts": f"with s as (select db, unnest({scripts('headword')}) as script from entries where headword is not null) select db, script, count(*) as n from s group by 1, 2",
}
