"""Japanese inflection as a table of forms, and its use backwards.

A lemma of a class gives its stems by rule; endings and auxiliaries on these stems give (form, tags). A chain goes
one derivation deep: passive, causative, potential and desiderative forms inflect in turn, and so do verbs
after the te-form. ``inflected`` explodes the forms of a table of lemmas; an analysis of surfaces is an equi-join with that table, which a
store may keep.

Cases: a lemma without a known ending gives no forms; the lemma itself is no form; equal forms with other tags stay.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kana rows that godan verbs move along: dictionary ending -> a, i, e and o row, and the te and ta endings.
GODAN = {"う": "わいえお って った", "く": "かきけこ いて いた", "ぐ": "がぎげご いで いだ", "す": "さしせそ して した", "つ": "たちてと って った", "ぬ": "なにねの んで んだ", "ぶ": "ばびべぼ んで んだ", "む": "まみめも んで んだ", "る": "らりれろ って った"}
POLITE = {"ます": ("Polite", "Dictionary"), "ません": ("Polite", "Negative"), "ました": ("Polite", "Past"), "ませんでした": ("Polite", "Negative", "Past"), "ましょう": ("Polite", "Volitional"), "まして": ("Polite", "Te")}
ADJECTIVE = {"くない": ("Negative",), "かった": ("Past",), "くなかった": ("Negative", "Past"), "くて": ("Te",), "く": ("Adverbial",), "ければ": ("Conditional",), "くなければ": ("Negative", "Conditional"), "かろう": ("Volitional",)}
NEGATIVE = {"ない": ("Negative",), "なかった": ("Negative", "Past"), "なくて": ("Negative", "Te"), "なければ": ("Negative", "Conditional"), "ず": ("Zu",), "ぬ": ("Nu",)}
COPULA = {"だった": ("Past",), "で": ("Te",), "なら": ("Conditional",), "な": ("Attributive",), "に": ("Adverbial",), "じゃない": ("Negative",), "ではない": ("Negative",), "です": ("Polite",), "でした": ("Polite", "Past")}
AFTER_TE = {"いる": "TeIru", "おる": "TeOru", "ある": "TeAru", "しまう": "Shimau", "おく": "Oku", "みる": "Miru", "いく": "Iku", "くる": "Kuru"}
E_ROW_I_ROW = set("いきぎしじちぢにひびぴみりえけげせぜてでねへべぺめれ")


def verb_class(lemma: str) -> str:
    """godan, ichidan, suru, kuru, or nothing: by the ending, る after an i or e sound being ichidan."""
    if lemma.endswith("する"):
        return "suru"
    if lemma in ("くる", "来る") or lemma.endswith("てくる"):
        return "kuru"
    if lemma.endswith("る") and len(lemma) > 1 and lemma[-2] in E_ROW_I_ROW:
        return "ichidan"
    return "godan" if lemma[-1:] in GODAN and len(lemma) > 1 else ""


def _stems(lemma: str, kind: str) -> dict[str, str] | None:
    """Stems by use: negative, polite, te, ta, conditional, imperative, volitional, passive, causative, potential."""
    base, end = lemma[:-1], lemma[-1:]
    if kind == "godan" and end in GODAN:
        rows, te, ta = GODAN[end].split()
        a, i, e, o = rows
        if lemma.endswith("行く") or lemma.endswith("いく"):
            te, ta = "って", "った"
        return {"negative": base + a, "polite": base + i, "te": base + te, "ta": base + ta, "conditional": base + e + "ば", "imperative": base + e, "volitional": base + o + "う", "passive": base + a + "れる", "causative": base + a + "せる", "potential": base + e + "る"}
    if kind == "ichidan" and end == "る":
        return {"negative": base, "polite": base, "te": base + "て", "ta": base + "た", "conditional": base + "れば", "imperative": base + "ろ", "volitional": base + "よう", "passive": base + "られる", "causative": base + "させる", "potential": base + "られる"}
    if kind == "suru" and lemma.endswith("する"):
        b = lemma[:-2]
        return {"negative": b + "し", "polite": b + "し", "te": b + "して", "ta": b + "した", "conditional": b + "すれば", "imperative": b + "しろ", "volitional": b + "しよう", "passive": b + "される", "causative": b + "させる", "potential": b + "できる"}
    if kind == "kuru" and end == "る":
        b = lemma[:-2]
        k = ("来", "来", "来") if lemma[-2] == "来" else ("こ", "き", "く")
        return {"negative": b + k[0], "polite": b + k[1], "te": b + k[1] + "て", "ta": b + k[1] + "た", "conditional": b + k[2] + "れば", "imperative": b + k[0] + "い", "volitional": b + k[0] + "よう", "passive": b + k[0] + "られる", "causative": b + k[0] + "させる", "potential": b + k[0] + "られる"}
    return None


def _base_forms(lemma: str, kind: str) -> list[tuple[str, tuple[str, ...]]]:
    stems = _stems(lemma, kind)
    if stems is None:
        return []
    out = [(stems["negative"] + e, tags) for e, tags in NEGATIVE.items() if not (kind == "suru" and e in ("ず", "ぬ"))]
    out += [(stems["polite"] + e, tags) for e, tags in POLITE.items()]
    if kind == "suru":
        out += [(lemma[:-2] + "せず", ("Zu",)), (lemma[:-2] + "せぬ", ("Nu",))]
    out += [(stems["te"], ("Te",)), (stems["ta"], ("Past",)), (stems["ta"] + "ら", ("Tara",)), (stems["ta"] + "り", ("Tari",))]
    return [*out, (stems["conditional"], ("Conditional",)), (stems["imperative"], ("Imperative",)), (stems["volitional"], ("Volitional",)), (stems["polite"], ("Conjunctive",))]


def forms(lemma: str, pos: str = "verb", kind: str = "") -> list[tuple[str, tuple[str, ...]]]:
    """(form, tags) of a verb, i-adjective or na-adjective."""
    lemma = (lemma or "").strip()
    if pos == "i-adj":
        out = [(lemma[:-1] + e, tags) for e, tags in ADJECTIVE.items()] if lemma.endswith("い") and len(lemma) > 1 else []
    elif pos == "na-adj":
        out = [(lemma + e, tags) for e, tags in COPULA.items()] if lemma else []
    else:
        kind = kind or verb_class(lemma)
        out, stems = _base_forms(lemma, kind), _stems(lemma, kind)
        if stems:
            for name in ("passive", "causative", "potential"):
                derived, tag = stems[name], name.capitalize()
                out += [(derived, (tag, "Dictionary")), *((f, (tag, *tags)) for f, tags in _base_forms(derived, "ichidan"))]
            wish = stems["polite"] + "たい"
            out += [(wish, ("Desiderative", "Dictionary")), *((f, ("Desiderative", *tags)) for f, tags in forms(wish, "i-adj"))]
            for verb, tag in AFTER_TE.items():
                joined = stems["te"] + verb
                out += [(joined, (tag, "Dictionary")), *((f, (tag, *tags)) for f, tags in _base_forms(joined, "ichidan" if verb in ("いる", "みる") else "kuru" if verb == "くる" else "godan"))]
    return [x for x in dict.fromkeys(out) if x[0] != lemma]


def forms_column(lemma: Column, pos: Column) -> Column:
    """``forms`` as a vectorised column."""

    @F.pandas_udf("array<struct<form:string,tags:string>>")
    def run(lemmas: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([[{"form": f, "tags": ";".join(t)} for f, t in forms(x, p or "verb")] for x, p in zip(lemmas, kinds)], dtype=object)

    return run(lemma, pos)


def inflected(lemmas: DataFrame) -> DataFrame:
    """lemma, pos, form, tags of every inflected form of a table (lemma, pos)."""
    return lemmas.where("lemma is not null").select("lemma", "pos", F.inline(forms_column(F.col("lemma"), F.col("pos"))))


def deconjugated(surfaces: DataFrame, table: DataFrame) -> DataFrame:
    """surface, lemma, pos, tags: what each surface may be a form of."""
    return surfaces.where("surface <> ''").select("surface").distinct().join(table.withColumnRenamed("form", "surface"), "surface").select("surface", "lemma", "pos", "tags")
