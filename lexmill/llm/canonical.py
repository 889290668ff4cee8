"""One consistent form for text that looks the same (problem 2).

A longest-match transducer, compiled once per language family, rewrites a string in a pass over its
code points, those that belong together matched together: full- and half-width letters, presentation forms and compatibility letters to ordinary
ones, base letters with combining accents to composed letters, odd spaces and hyphens to the plain ones,
look-alike letters of other scripts to the family's own letters; invisible characters are deleted. Its table
is made from the Unicode properties by rule and from the short look-alike lists below, and is checked before
use: a source has one target, and every target is a fixed point in NFC.

A cheap test in the JVM passes strings made only of letters that start no rule, so only the others reach
the transducer. There is no shuffle.

Cases: null and empty values are consistent; an unknown or null language gets the rules that hold for all
(widths, accents, spaces, invisible characters) but no look-alikes; case is kept.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.sources.tables import spread

# Language codes by family.
LANGUAGES = {
    "latin": "ang de en es et fi fr it la nl pl pt sv tr vi",
    "cyrillic": "bg ru uk",
    "greek": "el grc",
    "arabic": "ar",
    "persian": "fa ur",
    "devanagari": "hi sa",
    "hangul": "ko",
    "japanese": "ja",
    "han": "lzh zh",
}
# Ordinary letters of each family, as code point ranges.
HOME = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x17F), (0x1A0, 0x1A1), (0x1AF, 0x1B0), (0x218, 0x21B), (0x232, 0x233), (0x1E00, 0x1EF9)],
    "cyrillic": [(0x400, 0x4FF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "arabic": [(0x620, 0x6D3)],
    "persian": [(0x620, 0x6D3), (0x200C, 0x200C)],
    "devanagari": [(0x900, 0x97F)],
    "hangul": [(0xAC00, 0xD7A3)],
    "japanese": [(0x3041, 0x3096), (0x30A1, 0x30FC), (0x3005, 0x3007), (0x4E00, 0x9FFF)],
    "han": [(0x4E00, 0x9FFF)],
    "common": [],
}
# Look-alike letters, source and target side by side.
CYRILLIC_AS_LATIN = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX Ԁd ԚQ ԜW аa вb еe ѕs іi јj кk мm нh оo рp сc тt уy хx һh ӏl ԁd ԛq ԝw ѵv"
GREEK_AS_LATIN = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa ιi κk μm νv οo ρp τt υu χx ϲc ϳj Ϲc"
LETTERS_AS_LATIN = "ɑa ɡg ɩi ʋv"
LATIN_AS_GREEK = "AΑ BΒ EΕ ZΖ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ YΥ XΧ aα iι kκ nη oο pρ tτ uυ vν wω xχ yγ ɑα ɩι ʋυ ɣγ"
CYRILLIC_AS_GREEK = "АΑ ВΒ ЕΕ НΗ ІΙ КΚ МΜ ОΟ РΡ ТΤ УΥ ХΧ аα кκ оο рρ тτ хχ іι"
LATIN_AS_CYRILLIC = "AА BВ CС EЕ HН KК MМ OО PР TТ XХ YУ aа bв cс eе hн kк mм oо pр tт xх yу"
GREEK_AS_CYRILLIC = "ΑА ΒВ ΕЕ ΗН ΚК ΜМ ΟО ΡР ΤТ ΧХ αа κк οо ρр τт χх ϲс"
PERSIAN_AS_ARABIC = "یي کك ہه ھه"
ARABIC_AS_PERSIAN = "يی ىی كک ہه ھه"
DEVANAGARI_SEQUENCES = "अा आ", "अो ओ", "अौ औ", "ाे ो", "ाै ौ"
#: Ideographs that look like katakana; they are katakana where they stand beside one.
HAN_AS_KATAKANA = "力カ 口ロ 工エ 二ニ 八ハ 夕タ 卜ト"
LOOK_ALIKES = {
    "latin": [CYRILLIC_AS_LATIN, GREEK_AS_LATIN, LETTERS_AS_LATIN],
    "cyrillic": [LATIN_AS_CYRILLIC, GREEK_AS_CYRILLIC],
    "greek": [LATIN_AS_GREEK, CYRILLIC_AS_GREEK],
    "arabic": [PERSIAN_AS_ARABIC],
    "persian": [ARABIC_AS_PERSIAN],
}
# Spaces, hyphens and invisible characters.
SPACES = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
HYPHENS = [0x2010, 0x2011, 0x2012, 0x2013, 0x2212, 0xFE63, 0xFF0D]
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), *range(0xFE00, 0xFE10), 0xFEFF]
WIDTHS = {"<wide>", "<narrow>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}
SEQUENCES = {"devanagari": dict(x.split() for x in DEVANAGARI_SEQUENCES)}
_HAN = {x[0]: x[1] for x in HAN_AS_KATAKANA.split()}
_KANA = "\u30a1-\u30fa\uff66-\uff9d"
_MIXED = re.compile(f"[{_KANA}\u30fc\uff70\uff9e\uff9f\u3099\u309a{''.join(_HAN)}]{{2,}}")
#: What besides single characters may start a rule.
CONTEXT = {"devanagari": "|".join(SEQUENCES["devanagari"]), "japanese": f"[{''.join(_HAN)}][{_KANA}]|[{_KANA}][{''.join(_HAN)}]"}
PLAIN = [(0x20, 0x40), (0x5B, 0x60), (0x7B, 0x7E)]


def _points():
    yield from range(0x80, 0xD800)
    yield from range(0xF900, 0x10000)
    yield from range(0x1D400, 0x1D800)
    yield from range(0x2F800, 0x2FA20)


@lru_cache(1)
def _rules() -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Single-character rules that hold for every family, and (decomposed, composed) letters."""
    singles: dict[str, str] = {}
    composed: list[tuple[str, str]] = []
    for cp in _points():
        c = chr(cp)
        decomposition = unicodedata.decomposition(c)
        if not decomposition:
            continue
        nfc = unicodedata.normalize("NFC", c)
        if nfc != c:
            singles[c] = nfc
        elif not decomposition.startswith("<"):
            composed.append((unicodedata.normalize("NFD", c), c))
        elif decomposition.split()[0] in WIDTHS and not 0x3131 <= cp <= 0x318E:
            target = unicodedata.normalize("NFKC", c)
            if target and all(unicodedata.category(t)[0] in "LMN" or (t.isascii() and t != " ") for t in target):
                singles[c] = target
    for group, target in ((SPACES, " "), (HYPHENS, "-"), (INVISIBLE, "")):
        singles |= {chr(cp): target for cp in group}
    return singles, composed


class Transducer:
    """Longest-match rewriting for one family."""

    def __init__(self, family: str):
        self.family = family
        singles, composed = _rules()
        rules = dict(singles)
        for pairs in LOOK_ALIKES.get(family, []):
            own = {}
            for source, target in pairs.split():
                if own.setdefault(source, target) != target:
                    raise ValueError(f"{source} has two targets in {family}")
            rules |= own
        if family == "persian":
            rules.pop("‌", None)
        for _ in range(3):
            rules = {s: "".join(rules.get(t, t) for t in target) for s, target in rules.items()}
        rules = {s: t for s, t in rules.items() if s != t}
        images: dict[str, list[str]] = {}
        for s, t in rules.items():
            if len(t) == 1:
                images.setdefault(t, []).append(s)
        self.table = dict(rules)
        for parts, whole in composed:
            target = "".join(rules.get(t, t) for t in whole)
            base, marks = parts[0], parts[1:]
            orders = [marks] if len(marks) == 1 else [marks, marks[::-1]]
            for first in [base, *images.get(base, [])]:
                for order in orders:
                    self.table.setdefault(first + order, target)
            for k in range(1, len(marks)):
                partly = unicodedata.normalize("NFC", base + marks[:k])
                if len(partly) == 1:
                    self.table.setdefault(partly + marks[k:], target)
                rest = unicodedata.normalize("NFC", base + marks[k:])
                if len(rest) == 1:
                    self.table.setdefault(rest + marks[:k], target)
        if family in ("hangul", "common"):
            for lead in range(19):
                for vowel in range(21):
                    for tail in range(28):
                        source = chr(0x1100 + lead) + chr(0x1161 + vowel) + (chr(0x11A7 + tail) if tail else "")
                        self.table[source] = chr(0xAC00 + (lead * 21 + vowel) * 28 + tail)
        self.triggers = {s for s in rules} | {m for s in self.table if len(s) > 1 for m in s[1:]}
        self.table |= SEQUENCES.get(family, {})
        self.context = re.compile(CONTEXT[family]) if family in CONTEXT else None
        self.longest = max(map(len, self.table))
        self._check()

    def _check(self) -> None:
        for source, target in self.table.items():
            if self._pass(target) != target or unicodedata.normalize("NFC", target) != target:
                raise ValueError(f"{source!a} -> {target!a} is no fixed point in {self.family}")

    def _pass(self, text: str) -> str:
        out, at, end, get = [], 0, len(text), self.table.get
        while at < end:
            for n in range(min(self.longest, end - at), 0, -1):
                target = get(text[at : at + n])
                if target is not None:
                    out.append(target)
                    at += n
                    break
            else:
                out.append(text[at])
                at += 1
        return "".join(out)

    def __call__(self, text: str) -> str:
        """The consistent form; what a deletion brings together is composed as well."""
        if self.triggers.isdisjoint(text) and not (self.context and self.context.search(text)):
            return text
        done = self._pass(text)
        if not unicodedata.is_normalized("NFC", done) or (self.context and self.context.search(done)):
            done = self._pass(unicodedata.normalize("NFC", done))
        if self.family == "japanese":
            done = _MIXED.sub(lambda m: "".join(_HAN.get(c, c) for c in m[0]) if re.search(f"[{_KANA}]", m[0]) else m[0], done)
        return done

    def passing(self) -> str:
        """A regular expression that only strings without any rule's start match."""
        points = [cp for a, b in [*PLAIN, *HOME[self.family]] for cp in range(a, b + 1) if chr(cp) not in self.triggers]
        spans: list[list[int]] = []
        for cp in sorted(set(points)):
            if spans and cp == spans[-1][1] + 1:
                spans[-1][1] = cp
            else:
                spans.append([cp, cp])
        return "^[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]*$"


@lru_cache(16)
def transducer(family: str) -> Transducer:
    """The compiled transducer of a family, once per process."""
    return Transducer(family)


def family_of(db: Column) -> Column:
    """Family of a dictionary's language: the part of its name before a hyphen."""
    lang = F.lower(F.trim(F.split_part(db, F.lit("-"), F.lit(1))))
    named = F.create_map(*(F.lit(x) for family, codes in LANGUAGES.items() for code in codes.split() for x in (code, family)))
    return F.coalesce(F.element_at(named, lang), F.lit("common"))


def suspect(family: Column, value: Column) -> Column:
    """Whether a value may hold something to rewrite."""
    out = None
    for name in HOME:
        test = ~value.rlike(transducer(name).passing())
        if name in CONTEXT:
            test = test | value.rlike(CONTEXT[name])
        out = F.when(family == name, test) if out is None else out.when(family == name, test)
    return F.coalesce(out, F.lit(True))


def rewritten(df: DataFrame, db_col: str, fields: list[str], id_col: str = "id") -> DataFrame:
    """row_id, field, value, canonical of the values whose consistent form differs."""
    # the family is a column below the explode, so that it is told once per row and not again in every test of it
    told = df.select(F.col(id_col).cast("bigint").alias("row_id"), family_of(F.col(db_col)).alias("family"), *(F.col(f).cast("string").alias(f"_{f}") for f in fields))
    stacked = told.select("row_id", "family", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("value")) for f in fields))).alias("s"))
    asked = stacked.select("row_id", "family", "s.field", "s.value").where("value is not null and value <> ''").where(suspect(F.col("family"), F.col("value")))

    def run(batches):
        for batch in batches:
            got = [transducer(f)(v) for f, v in zip(batch["family"], batch["value"])]
            out = batch[["row_id", "field", "value"]].assign(canonical=got)
            yield out[out["value"] != out["canonical"]]

    return spread(asked).mapInPandas(run, "row_id bigint, field string, value string, canonical string")


def consistent(df: DataFrame, db_col: str, fields: list[str]) -> DataFrame:
    """``df`` with each field brought to its consistent form; other columns and nulls stay as they are."""

    @F.pandas_udf("string")
    def rewrite(family: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else transducer(f)(v) for f, v in zip(family, value)], dtype=object)

    family = family_of(F.col(db_col))
    return df.withColumns({f: rewrite(family, F.col(f)) for f in fields})


FIELDS = {"entries": ["headword", "headword_key"], "forms": ["form_text", "form_key"]}


def found(tables: dict[str, DataFrame]) -> DataFrame:
    """tab, row_id, field of every stored value that isn't in its consistent form."""
    parts = [rewritten(df, "db", FIELDS[tab]).select(F.lit(tab).alias("tab"), "row_id", "field") for tab, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def lookups(tables: dict[str, DataFrame]) -> DataFrame:
    """Per dictionary: distinct form keys, and those met by a headword key before and after rewriting."""
    def met(forms, entries):
        keys = forms.where("form_key <> ''").select("db", F.col("form_key").alias("k")).distinct()
        heads = entries.where("headword_key <> ''").select("db", F.col("headword_key").alias("k"), F.lit(1).alias("hit")).distinct()
        return keys.join(heads, ["db", "k"], "left").groupBy("db").agg(F.count(F.lit(1)).alias("n_keys"), F.count("hit").alias("n_met"))

    raw = met(tables["forms"], tables["entries"])
    new = met(consistent(tables["forms"], "db", ["form_key"]), consistent(tables["entries"], "db", ["headword_key"]))
    return raw.select("db", F.col("n_keys").alias("n_keys_raw"), F.col("n_met").alias("n_met_raw")).join(new, "db")
