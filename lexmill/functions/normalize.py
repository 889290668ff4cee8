"""Lookup keys: an ordered list of per-language rules, applied as one fused function."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as an affix marker, and marks that are stripped per script.
AFFIX_MARKERS = "﻿؜‎‏‌‪‫‬‭‮⁦⁧⁨⁩־׳‒◌'.^㌠⠐⠘⠰℞∅&(),©〰"
FORMAT_CONTROLS = "؜‎‏‪-‮⁦-⁩﻿"
COMPARISON_INVISIBLES = "؜​-‏‪-‮⁦-⁩︀-️﻿\U000e0100-\U000e01ef"
VARIATION_SELECTORS = "︀-️\U000e0100-\U000e01ef"
ARABIC_MARKS = "ؐ-ؚـً-ٰٟۖ-ۜ۟-ۤۧ-۪ۨ-ۭ࣊-ࣣ࣡-ࣿ"
HEBREW_MARKS = "֑-ׇֽֿׁׂׅׄ"
GREEK_ACCENTS = "̀́̓̔͂"
GREEK_EDITORIAL = "̄̆"
ARABIC_LETTERS = {"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ة": "ه"}
PERSIAN_LETTERS = {"ی": "ي", "ے": "ي", "ک": "ك", "ۀ": "ه", "ہ": "ه", "ۂ": "ه"}
URDU_LETTERS = {"ی": "ي", "ک": "ك"}
TURKISH_CASE = {"İ": "i", "I": "ı"}
OLD_ENGLISH = {"ā": "a", "ē": "e", "ī": "i", "ō": "o", "ū": "u", "ȳ": "y", "ǣ": "æ", "ð": "þ", "ċ": "c", "ġ": "g", "ƿ": "w", "ᵹ": "g", "Ᵹ": "g", "ꝿ": "g"}
GREEK_WORDS = {"ἐξ": "ἐκ", "οὐκ": "οὐ", "οὐχ": "οὐ"}
#: Elided words and their full forms.
GREEK_ELISIONS = {
    "ἀλλ'": "ἀλλά", "ἀνθ'": "ἀντί", "ἀπ'": "ἀπό", "ἀφ'": "ἀπό", "γ'": "γε", "γένοιτ'": "γένοιτο", "δ'": "δέ", "δεῦρ'": "δεῦρο", "δι'": "διά", "δύναιτ'": "δύναιτο",
    "εἶτ'": "εἶτα", "ἐπ'": "ἐπί", "ἔτ'": "ἔτι", "ἐφ'": "ἐπί", "ἡγοῖντ'": "ἡγοῖντο", "ἵν'": "ἵνα", "καθ'": "κατά", "κατ'": "κατά", "μ'": "με", "μεθ'": "μετά",
    "μετ'": "μετά", "μηδ'": "μηδέ", "μήδ'": "μηδέ", "ὅτ'": "ὅτε", "οὐδ'": "οὐδέ", "πάνθ'": "πάντα", "πάντ'": "πάντα", "παρ'": "παρά", "ποτ'": "ποτε", "σ'": "σε",
    "τ'": "τε", "ταῦθ'": "ταῦτα", "ταῦτ'": "ταῦτα", "τοῦτ'": "τοῦτο", "ὑπ'": "ὑπό", "ὑφ'": "ὑπό",
}
SANSKRIT_PAIRS = [("r̥̄", "ṝ"), ("r̥", "ṛ"), ("l̥̄", "ḹ"), ("l̥", "ḷ"), ("m̐", "ṃ"), ("aí", "ai"), ("aú", "au"), ("aì", "ai"), ("aù", "au")]
SANSKRIT_LETTERS = {"ṁ": "ṃ", "ē": "e", "ō": "o", "ḗ": "e", "ṓ": "o", "ẖ": "ḥ", "ᳵ": "ḥ", "ᳶ": "ḥ", "á": "a", "é": "e", "í": "i", "ó": "o", "ú": "u", "à": "a", "è": "e", "ì": "i", "ò": "o", "ù": "u", "`": "'", "‘": "'", "’": "'", "ʼ": "'"}
SANSKRIT_SUPERSCRIPTS = "²³¹⁰-⁹ᴬ-ᵪᶛ-ᶿ"
ANUSVARA = [("ṅ", "kg"), ("ñ", "cj"), ("ṇ", "ṭḍ"), ("n", "td"), ("m", "pb")]
LETTERS_SLP1 = {"ā": "A", "ī": "I", "ū": "U", "ṛ": "f", "ṝ": "F", "ḷ": "x", "ḹ": "X", "ṃ": "M", "ṁ": "M", "ḥ": "H", "ṅ": "N", "ñ": "Y", "ṭ": "w", "ḍ": "q", "ṇ": "R", "ś": "S", "ṣ": "z", "’": "'"}
PAIRS_SLP1 = {"ai": "E", "au": "O", "kh": "K", "gh": "G", "ch": "C", "jh": "J", "ṭh": "W", "ḍh": "Q", "th": "T", "dh": "D", "ph": "P", "bh": "B", "m̐": "~"}
#: Independent vowels.
DEVANAGARI_VOWELS = {
    "अ": "a", "आ": "ā", "इ": "i", "ई": "ī", "उ": "u", "ऊ": "ū", "ऋ": "ṛ", "ॠ": "ṝ", "ऌ": "ḷ", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au",
}
#: Vowel signs.
DEVANAGARI_SIGNS = {
    "ा": "ā", "ि": "i", "ी": "ī", "ु": "u", "ू": "ū", "ृ": "ṛ", "ॄ": "ṝ", "ॢ": "ḷ", "े": "e", "ै": "ai", "ो": "o", "ौ": "au",
}
#: Consonants.
DEVANAGARI_CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ṅ", "च": "c", "छ": "ch", "ज": "j", "झ": "jh", "ञ": "ñ", "ट": "ṭ", "ठ": "ṭh", "ड": "ḍ", "ढ": "ḍh", "ण": "ṇ", "त": "t",
    "थ": "th", "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v", "श": "ś", "ष": "ṣ", "स": "s",
    "ह": "h", "ळ": "ḷ",
}
#: Other signs.
DEVANAGARI_MARKS = {
    "ं": "ṃ", "ः": "ḥ", "ँ": "m̐", "ऽ": "'",
}


_CACHE: dict[str, re.Pattern] = {}


def _without(text: str, members: str) -> str:
    pattern = _CACHE.get(members) or _CACHE.setdefault(members, re.compile(f"[{members}]"))
    return pattern.sub("", text)


def _folded(text: str, letters: dict[str, str]) -> str:
    return text.translate(str.maketrans(letters))


def decomposed_without(text: str, members: str) -> str:
    return unicodedata.normalize("NFC", _without(unicodedata.normalize("NFD", text), members))


def sigma(text: str) -> str:
    """One small sigma for its final and lunate forms."""
    return _folded(text, {"ς": "σ", "ϲ": "σ", "Ϲ": "σ"})


def ancient_greek(text: str) -> str:
    """Without breathings, accents and quantity marks; iota subscript written out."""
    bare = unicodedata.normalize("NFD", text)
    bare = _without(bare, GREEK_ACCENTS + GREEK_EDITORIAL).replace("ͅ", "ι")
    return sigma(unicodedata.normalize("NFC", bare))


def sanskrit_roman(text: str) -> str:
    """Romanised Sanskrit in its academic spelling."""
    text = unicodedata.normalize("NFC", text)
    for source, target in SANSKRIT_PAIRS:
        text = text.replace(source, target)
    return _without(_without(_folded(text, SANSKRIT_LETTERS), SANSKRIT_SUPERSCRIPTS), "̀-ͯ")


def anusvara(text: str) -> str:
    """Nasals before a stop of their own class as anusvāra."""
    for nasal, stops in ANUSVARA:
        text = re.sub(f"{nasal}(?=[{stops}])", "ṃ", text)
    return text


def iast_to_slp1(text: str) -> str:
    """Longest match over digraphs, then letters."""
    text = unicodedata.normalize("NFC", text)
    out, at = [], 0
    while at < len(text):
        two = text[at : at + 2].lower()
        if two in PAIRS_SLP1:
            out.append(PAIRS_SLP1[two])
            at += 2
            continue
        c = text[at]
        out.append(LETTERS_SLP1.get(c.lower(), c.lower() if c.lower() in "aiueokgcjtdnpbmyrlvsh'" else c))
        at += 1
    return "".join(out)


_FROM_SLP1 = {v: k for k, v in {**LETTERS_SLP1, **PAIRS_SLP1}.items() if k not in ("ṁ", "’")}


def slp1_to_iast(text: str) -> str:
    return unicodedata.normalize("NFC", "".join(_FROM_SLP1.get(c, c) for c in text))


def devanagari_to_iast(text: str) -> str:
    """Transliteration with the inherent vowel."""
    out, at = [], 0
    while at < len(text):
        c = text[at]
        after = text[at + 1 : at + 2]
        if c in DEVANAGARI_CONSONANTS:
            out.append(DEVANAGARI_CONSONANTS[c])
            if after == "्":
                at += 1
            elif after not in DEVANAGARI_SIGNS:
                out.append("a")
        else:
            out.append(DEVANAGARI_VOWELS.get(c) or DEVANAGARI_SIGNS.get(c) or DEVANAGARI_MARKS.get(c) or c)
        at += 1
    return "".join(out)


def korean_stem(text: str, pos: str | None) -> str:
    """The stem of a verb or adjective in its dictionary form."""
    text = (text or "").strip()
    return text[:-1].strip() if (pos or "").strip().lower() in ("verb", "adj") and len(text) > 1 and text.endswith("다") else ""


def visible(text: str) -> str:
    """Text as it is compared by eye."""
    return _without(unicodedata.normalize("NFKC", text), COMPARISON_INVISIBLES).strip()


def casefold_key(text: str | None) -> str:
    """NFKC and case folding."""
    return unicodedata.normalize("NFKC", text or "").casefold()


@dataclass(frozen=True)
class Rule:
    """One step of the key pipeline; ``langs`` empty means every language."""

    name: str
    langs: frozenset[str]
    apply: Callable[[str], str]


def _rule(name: str, langs: str, apply: Callable[[str], str]) -> Rule:
    return Rule(name, frozenset(langs.split()), apply)


RULES: list[Rule] = [
    _rule("format_controls", "", lambda s: _without(s, FORMAT_CONTROLS)),
    _rule("ancient_greek", "grc", ancient_greek),
    _rule("modern_greek", "el", lambda s: sigma(decomposed_without(s, "́"))),
    _rule("variation_selectors", "zh lzh ja", lambda s: _without(s, VARIATION_SELECTORS)),
    _rule("arabic_marks", "ar fa ur", lambda s: _without(s, ARABIC_MARKS)),
    _rule("arabic_letters", "ar", lambda s: _folded(s, ARABIC_LETTERS)),
    _rule("persian_letters", "fa", lambda s: _folded(s, PERSIAN_LETTERS)),
    _rule("urdu_joiners", "ur", lambda s: _without(s, "‌‍")),
    _rule("urdu_letters", "ur", lambda s: _folded(s, URDU_LETTERS)),
    _rule("hebrew_marks", "he", lambda s: _without(s, HEBREW_MARKS)),
    _rule("indic_joiners", "hi sa bn ta te mr", lambda s: _without(s, "​‌‍")),
    _rule("sanskrit_roman", "sa", sanskrit_roman),
    _rule("turkish_case", "tr", lambda s: _folded(s, TURKISH_CASE)),
    _rule("thai_spaces", "th", lambda s: s.replace("​", "")),
    _rule("old_english", "ang", lambda s: _folded(unicodedata.normalize("NFC", s), OLD_ENGLISH)),
]


def lookup_key(text: str | None, lang: str | None, disabled: Iterable[str] = ()) -> str:
    """The key under which a text is found in a language's index; empty for nothing."""
    value, lang = text or "", (lang or "").strip().lower().split("-")[0]
    if lang == "grc":
        value = re.sub("[‘’ʼʽ᾽᾿＇]", "'", value)
        value = GREEK_ELISIONS.get(value) or GREEK_WORDS.get(value) or value
    value = unicodedata.normalize("NFKC", value).strip()
    keep = "'" if lang == "sa" else ""
    value = "".join("-" if c in AFFIX_MARKERS and c != keep else c for c in value)
    for rule in RULES:
        if rule.name not in disabled and (not rule.langs or lang in rule.langs):
            value = rule.apply(value)
    return value.strip().replace("-", "").lower()


#: Letters that a language's keys don't tell apart, and the marks they leave out.
FOLDS = {"ar": ARABIC_LETTERS, "fa": PERSIAN_LETTERS, "ur": URDU_LETTERS, "tr": TURKISH_CASE, "ang": OLD_ENGLISH}
MARKS = {"ar": ARABIC_MARKS, "fa": ARABIC_MARKS, "ur": ARABIC_MARKS, "he": HEBREW_MARKS}


def letter_folds(text: Column, lang: Column) -> Column:
    """The letters of each language folded (X03); all stays in the JVM."""
    out = text
    for g, letters in FOLDS.items():
        out = F.when(lang == g, F.translate(text, "".join(letters), "".join(letters.values()))).otherwise(out)
    return out


def mark_strips(text: Column, lang: Column) -> Column:
    """Texts without the marks of their script."""
    out = text
    for g, marks in MARKS.items():
        out = F.when(lang == g, F.regexp_replace(text, f"[{marks}]", "")).otherwise(out)
    return out


def korean_stems(text: Column, pos: Column) -> Column:
    """``korean_stem`` as an expression."""
    t = F.trim(F.coalesce(text, F.lit("")))
    verbal = F.lower(F.trim(F.coalesce(pos, F.lit("")))).isin("verb", "adj") & (F.length(t) > 1) & t.endswith("다")
    return F.when(verbal, F.trim(t.substr(F.lit(1), F.length(t) - 1))).otherwise(F.lit(""))


#: Words whose key is the same in every language, and is the word in lower case without hyphens.
SAME_EVERYWHERE = "^[a-zA-HJ-Z0-9-]+$"


def rule_set(lang: Column) -> Column:
    """A name for the rules of a language: the same for languages whose keys are the same for any text."""
    named = rule_sets()
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in named.items() for x in pair)), lang), F.lit(""))


def rule_sets() -> dict[str, str]:
    """Language -> the first language with the same rules; languages without rules of their own aren't listed."""
    own = {g: frozenset(r.name for r in RULES if g in r.langs) for r in RULES for g in sorted(r.langs)}
    first: dict[frozenset[str], str] = {}
    for g in sorted(own):
        first.setdefault(own[g], g)
    return {g: first[own[g]] for g in sorted(own)}


def memoised(f: Callable[..., str]) -> Callable[..., str]:
    """``f`` with a bounded memo per task."""
    held: dict = {}

    def g(*args):
        got = held.get(args)
        if got is None:
            got = f(*args)
            if len(held) < 200_000:
                held[args] = got
        return got

    return g


def key_column(text: Column, lang: Column, disabled: tuple[str, ...] = ()) -> Column:
    """``lookup_key`` as a vectorised column."""

    @F.pandas_udf("string")
    def keys(texts: pd.Series, langs: pd.Series) -> pd.Series:
        f = memoised(lambda t, g: lookup_key(t, g, disabled))
        return pd.Series([f(t, g) for t, g in zip(texts, langs)], dtype=object)

    return keys(text, lang)


def text_column(f: Callable[[str], str], text: Column) -> Column:
    """A text function as a vectorised column; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        g = memoised(f)
        return pd.Series([None if t is None else g(t) for t in texts], dtype=object)

    return run(text)
