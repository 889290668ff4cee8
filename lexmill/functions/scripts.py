"""Text functions of the dictionary importers: transliteration, plain tokens, feature strings, fingerprints, gloss clean-up."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TONES = {1: "̄", 2: "́", 3: "̌", 4: "̀"}
_SYLLABLE = re.compile("([a-züvA-ZÜV]+)([1-5])")


def pinyin(text: str) -> str:
    """Numbered pinyin with tone marks: on a or e, else on o, else on the last of i, u and ü; v stands for ü."""

    def marked(m: re.Match) -> str:
        syllable, tone = m[1], int(m[2])
        if tone == 5:
            return syllable
        low = syllable.lower()
        at = next((i for i, c in enumerate(low) if c in "ae"), -1)
        at = at if at >= 0 else low.rfind("o") if "o" in low else max(low.rfind(c) for c in "iuüv")
        if at < 0:
            return syllable
        vowel = {"v": "ü", "V": "Ü"}.get(syllable[at], syllable[at])
        return syllable[:at] + unicodedata.normalize("NFC", vowel + TONES[tone]) + syllable[at + 1 :]

    return _SYLLABLE.sub(marked, text)


#: Rows of the kana table: consonant -> the kana of a, i, u, e, o; a dot stands for none.
KANA_ROWS = {"": "あいうえお", "k": "かきくけこ", "g": "がぎぐげご", "s": "さしすせそ", "z": "ざじずぜぞ", "t": "たちつてと", "d": "だぢづでど", "n": "なにぬねの", "h": "はひふへほ", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ", "m": "まみむめも", "y": "や.ゆ.よ", "r": "らりるれろ", "w": "わゐ.ゑを"}
IRREGULAR = {"し": "shi", "じ": "ji", "ち": "chi", "ぢ": "ji", "つ": "tsu", "づ": "zu", "ふ": "fu", "ゐ": "i", "ゑ": "e", "を": "o", "ん": "n"}
SMALL = {"ゃ": "ya", "ゅ": "yu", "ょ": "yo", "ぁ": "a", "ぃ": "i", "ぅ": "u", "ぇ": "e", "ぉ": "o"}
KANA = {c: r + v for r, row in KANA_ROWS.items() for c, v in zip(row, "aiueo") if c != "."} | IRREGULAR


def romaji(text: str) -> str:
    """Kana in Hepburn spelling; long marks repeat the vowel, other characters stay."""
    out: list[str] = []
    double = False
    for c in unicodedata.normalize("NFKC", text):
        h = chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c
        if h == "っ":
            double = True
            continue
        if h in SMALL and out and out[-1][-1:] in "iue" and out[-1].isascii():
            stem, tail = out[-1][:-1], SMALL[h]
            if tail[0] == "y":
                tail = tail[1:] if stem in ("sh", "j", "ch") else tail
            out[-1] = stem + tail
            continue
        got = out[-1][-1] if c == "ー" and out and out[-1].isascii() else KANA.get(h, SMALL.get(h, c))
        if double and got.isascii() and got[:1].isalpha():
            got = ("t" if got.startswith("ch") else got[0]) + got
        double = False
        out.append(got)
    return "".join(out)


#: The letters of beta code, and its marks.
BETA = dict(zip("abgdezhqiklmncoprstufxyw", "αβγδεζηθικλμνξοπρστυφχψω"))
BETA_MARKS = {")": "̓", "(": "̔", "/": "́", "\\": "̀", "=": "͂", "|": "ͅ", "+": "̈"}
_CAPITAL = re.compile(r"\*([)(/\\=|+]*)([a-z])")


def beta_greek(text: str) -> str:
    """Beta code as Greek, composed; sigma at the end of a word has its final form."""
    text = _CAPITAL.sub(lambda m: "*" + m[2] + m[1], text.lower())
    out, upper = [], False
    for c in text:
        if c == "*":
            upper = True
        elif c in BETA:
            out.append(BETA[c].upper() if upper else BETA[c])
            upper = False
        else:
            out.append(BETA_MARKS.get(c, c))
    return re.sub("σ(?![\\ẁ-ͯ])", "ς", unicodedata.normalize("NFC", "".join(out)))


# Words that tell nothing about a label.
STOPWORDS = "a an and as at by for from in into is of on or the to with type kind category name term label entity misc other general specific related".split()


def folded(text: Column) -> Column:
    """Lower-case text without accents, by a fixed table for composed Latin letters."""
    latin = [chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    plain = [unicodedata.normalize("NFD", c)[0] for c in latin]
    return F.lower(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "\\p{M}+", ""), "".join(latin), "".join(plain)))


def stem(t: Column) -> Column:
    """A light stem: plural endings off."""
    n = F.length(t)
    return F.when((n > 5) & t.endswith("ies"), F.concat(t.substr(F.lit(1), n - 3), F.lit("y"))).when((n > 4) & t.endswith("ses"), t.substr(F.lit(1), n - 2)).when((n > 4) & t.endswith("s"), t.substr(F.lit(1), n - 1)).otherwise(t)


def plain_tokens(text: Column) -> Column:
    """Folded, stemmed words without stopwords, numbers and single characters."""
    words = F.transform(F.regexp_extract_all(folded(text), F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1)), stem)
    return F.filter(words, lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS) & ~t.rlike("^\\p{Nd}+$"))


def phrases(text: Column) -> Column:
    """The parts of a label between its dividers, as plain tokens."""
    parts = F.split(F.coalesce(text, F.lit("")), "[/,;:|(){}\\[\\]<>_\\-]+")
    return F.filter(F.transform(parts, lambda p: F.array_join(plain_tokens(p), " ")), lambda p: (p != "") & ~p.isin(STOPWORDS))


def feats_text(raw: str | None) -> str:
    """Features given as text, as an object or as a list, as one string."""
    text = (raw or "").strip()
    try:
        got = json.loads(text) if text[:1] in ("{", "[") else text
    except (ValueError, RecursionError):
        got = text
    if isinstance(got, dict):
        pairs = ((str(k).strip(), str(v).strip()) for k, v in got.items())
        return "|".join(f"{k}={v}" if k else v for k, v in pairs if k or v)
    if isinstance(got, list):
        return "|".join(t for x in got if (t := str(x).strip()))
    return got


def canonical_json(raw: str | None) -> str | None:
    """JSON with sorted members and no blanks, or None where it can't be read."""
    try:
        return json.dumps(json.loads(raw or ""), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


def over(f, text: Column) -> Column:
    """A text function as a vectorised column, once per distinct string of a batch; null stays null."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        codes, kinds = pd.factorize(values, use_na_sentinel=True)
        got = [f(v) for v in kinds]
        return pd.Series([got[c] if c >= 0 else None for c in codes], dtype=object)

    return run(text)


def fingerprint(raw: Column) -> Column:
    """SHA-256 of canonical JSON (X23); null where it can't be read."""
    return F.sha2(over(canonical_json, raw), 256)


def clean_gloss(text: Column) -> Column:
    """A gloss with its lead before a dash (X24): the part after the last semicolon in lower case, the one before capitalised."""
    raw = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)\\s+", " "))
    lead, rest = (F.trim(F.regexp_extract(raw, "^(.*);([^;]*)$", k)) for k in (1, 2))
    first = lambda x, f: F.concat(F.regexp_extract(x, "^([^\\p{L}]*)", 1), f(F.regexp_extract(x, "^[^\\p{L}]*(\\p{L}?)", 1)), F.regexp_extract(x, "^[^\\p{L}]*\\p{L}?(.*)$", 1))
    done = (lead == "") | (rest == "") | rest.contains(" - ")
    return F.when(~raw.contains(";") | done, raw).otherwise(F.concat(first(lead, F.upper), F.lit(" - "), first(rest, F.lower)))
