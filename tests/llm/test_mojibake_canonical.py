"""Problems 1 and 2: wrong encodings and look-alike text."""

import json
import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexmill.llm import canonical, mojibake

WORDS = ["café", "naïve", "façade", "über", "señor", "vis-à-vis", "smörgåsbord", "“quoted”", "dash —", "NÃO, IRMÃ", "ÂGE D’OR", "«ÇA VA»", "þæs wæron", "±5 °C", "£3 €4", "книга слово", "ёлка ещё", "λόγος", "كتاب", "山水", "文字", "言語", "한국", "사람 나라"]


def damaged(text, rng):
    """Text read with a wrong encoding, with the chain's name."""
    chains = {
        "cp1252": lambda t: t.encode().decode("cp1252"),
        "latin": lambda t: t.encode().decode("latin-1"),
        "cp437": lambda t: t.encode().decode("cp437"),
        "koi8": lambda t: t.encode().decode("koi8_r"),
        "twice": lambda t: t.encode().decode("latin-1").encode().decode("latin-1"),
    }
    for name in rng.sample(sorted(chains), len(chains)):
        try:
            got = chains[name](text)
        except UnicodeDecodeError:
            continue
        if got != text:
            return got
    return None


def table(spark):
    rng, rows, bad = random.Random(5), [], {}
    for i in range(1500):
        clean = "gloss " + " ".join(rng.sample(WORDS, 3)) + " end"
        gloss = clean
        if i % 12 == 0:
            got = damaged(clean, rng)
            if got:
                gloss, bad[i] = got, clean
        rows.append((i, "de" if i % 2 else "fr", "a" if i % 3 else None, json.dumps([gloss], ensure_ascii=bool(i % 4)), "plain ascii" if i % 5 else None, ""))
    rows.append((5000, None, None, "broken � here", "x\x93y", None))
    return spark.createDataFrame(rows, "id bigint, db string, source string, glosses string, etymology string, commentary string"), bad


def test_damaged_values_are_found_and_restored(spark):
    df, bad = table(spark)
    got = {(r.entry_pk, r.field): r for r in mojibake.repaired(df.withColumnRenamed("source", "source")).collect()}
    found = {i for i, f in got if f == "glosses" and i < 5000}
    assert (5000, "glosses") in got and not got[5000, "glosses"].restorable
    assert (5000, "etymology") in got
    assert len(found & set(bad)) >= 0.97 * len(bad) and len(found - set(bad)) <= 0.002 * 1500
    right = sum(json.loads(got[i, "glosses"].repaired)[0] == bad[i] for i in found & set(bad))
    assert right >= 0.9 * len(bad)


def test_no_rows_and_extra_columns(spark):
    df, _ = table(spark)
    assert mojibake.found(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, "de", "s", "x" * 100_000 + " café", None, "", "value")], "id bigint, db string, source string, glosses string, etymology string, commentary string, value string")
    assert mojibake.found(odd).count() == 0


def test_undoing_single_chains():
    for codec in ("cp1252", "cp437", "koi8_r", "mac_roman", "cp1250"):
        assert mojibake.undo_single("é—".encode().decode(codec), codec) == "é—"
    assert mojibake.undo_single("café", "cp1252") is None
    assert mojibake.undo_lowered("ã©", False) == "é"
    assert ("cp1251 read as cp1252", "слово") in mojibake.legacy_candidates("ñëîâî")
    assert ("cp1251 read as koi8_r", "слово") in mojibake.swapped_candidates("слово".encode("cp1251").decode("koi8_r"))
    assert mojibake.opened("&eacute; &amp; \\u00e9 \\u0022") == "é &amp; é \\u0022"


def test_rates_follow_the_evidence():
    rates = mojibake.fit({"": 90, "cp1252=20": 10})
    assert abs(rates["cp1252"] - 0.1) < 0.01 and abs(rates[mojibake.WHOLE] - 0.9) < 0.02


def test_evidence_of_a_source_decides_weak_tokens(spark):
    strong, weak = [("cp1252", 20.0, "é")], [("cp1252", 2.5, "è")]
    rows = [("a", "de", "glosses", f"t{i}", 1, strong if i % 5 < 3 else []) for i in range(500)] + [("b", "de", "glosses", f"t{i}", 1, []) for i in range(500)]
    rows += [(s, "de", "glosses", "weak", 1, weak) for s in "ab"] + [("b", "de", "glosses", "strong", 1, strong)]
    scored = spark.createDataFrame(rows, "source string, db string, field string, token string, n bigint, scored array<struct<chain string, score double, text string>>")
    pooled, rates = mojibake.chain_rates(scored)
    got = {(r.source, r.token) for r in mojibake.decisions(scored, rates).where("not token like 't%'").collect()}
    assert got == {("a", "weak"), ("b", "strong")} and 0.2 < pooled["cp1252"] < 0.4
    constant = rates.withColumn("rates", F.create_map(F.lit(mojibake.WHOLE), F.lit(0.97), F.lit("cp1252"), F.lit(0.001)))
    assert {(r.source, r.token) for r in mojibake.decisions(scored, constant).where("not token like 't%'").collect()} == {("b", "strong")}


def test_many_kinds_of_evidence_are_counted_in_coarser_steps(spark, monkeypatch):
    monkeypatch.setattr(mojibake, "MOST_SIGNATURES", 5)
    rows = [("a", "de", "glosses", f"t{i}", 1, [("cp1252", i / 4, "é")] if i % 2 else []) for i in range(200)]
    scored = spark.createDataFrame(rows, "source string, db string, field string, token string, n bigint, scored array<struct<chain string, score double, text string>>")
    pooled, _ = mojibake.chain_rates(scored)
    assert 0.3 < pooled["cp1252"] < 0.7


def test_rates_are_the_same_for_any_number_of_kinds(spark, monkeypatch):
    rng, chains = random.Random(7), ["cp1252", "latin-1", "koi8_r"]
    rows = [("ab"[i % 2], "de", "glosses", f"t{i}", 1 + i % 3, [(c, rng.uniform(-11, 15), "é") for c in rng.sample(chains, rng.randrange(4))]) for i in range(400)]
    scored = spark.createDataFrame(rows, "source string, db string, field string, token string, n bigint, scored array<struct<chain string, score double, text string>>")
    got = []
    for most in (50_000, 5):
        monkeypatch.setattr(mojibake, "MOST_SIGNATURES", most)
        pooled, rates = mojibake.chain_rates(scored)
        got.append((pooled, {r.source: r.rates for r in rates.collect()}))
    assert got[0] == got[1]
    # as by plain expectation-maximization over the stepped scores
    stepped = [(n, {c: math.exp(-2 * math.floor(-x / 2 + 0.5)) for c, x, _ in own}) for *_, n, own in rows]
    want = {"whole": 0.97} | {c: 0.0075 for c in (*chains, "lost")}
    for _ in range(mojibake.ROUNDS):
        sums = dict.fromkeys(want, 0.0)
        for n, own in stepped:
            weights = {"whole": want["whole"], **{c: want[c] * x for c, x in own.items()}}
            for c, w in weights.items():
                sums[c] += n * w / sum(weights.values())
        want = {c: max(1e-7, v / sum(sums.values())) for c, v in sums.items()}
    assert all(abs(got[0][0][c] - p) < 1e-6 for c, p in want.items())


CASES = [
    ("de", "ｈａｕｓ", "haus"), ("de", "schön", "schön"), ("de", "Kаße", "Kaße"), ("es", "niño", "niño"), ("fr", "a b", "a b"),
    ("fr", "ﬁn", "fin"), ("en", "co‑op", "co-op"), ("tr", "ﬁş", "fiş"), ("vi", "đợi", "đợi"), ("ru", "cлoво", "слово"), ("ru", "ёж", "ёж"),
    ("grc-lsj", "λoγος", "λογος"), ("grc", "ώ", "ώ"), ("ar", "كتاﺏ", "كتاب"), ("ar", "کتاب", "كتاب"), ("fa", "كتاب", "کتاب"), ("fa", "می‌رود", "می‌رود"),
    ("sa", "न‍ी", "नी"), ("sa", "दाेष", "दोष"), ("ko", "한", "한"), ("ja-jmdict", "ｶﾞﾑ", "ガム"), ("ja", "か゚", "か゚"), ("ja", "ク夕", "クタ"), ("ja", "夕方", "夕方"),
    ("zh", "⾔", "言"), ("zh", "里", "里"), ("xx", "аа", "аа"), (None, "a​b", "ab"), ("de", "", ""), ("de", "ȳ̄", unicodedata.normalize("NFC", "ȳ̄")),
]


@pytest.mark.parametrize("db, text, expected", CASES)
def test_consistent_form(spark, db, text, expected):
    codes = {c: f for f, cs in canonical.LANGUAGES.items() for c in cs.split()}
    got = canonical.transducer(codes.get((db or "").split("-")[0], "common"))(text)
    assert got == expected
    assert canonical.transducer(codes.get((db or "").split("-")[0], "common"))(got) == got


def test_ordinary_letters_pass_and_gate_agrees(spark):
    rows = [(i, db, text, text) for i, (db, text, _) in enumerate(CASES)] + [(900, "de", None, "Straße"), (901, "de", "x" * 50_000, "ok")]
    df = spark.createDataFrame(rows, "id bigint, db string, form_text string, form_key string")
    got = {(r.row_id, r.field) for r in canonical.found({"forms": df}).collect()}
    want = {(i, f) for i, (_, text, expected) in enumerate(CASES) if text != expected for f in ("form_text", "form_key")}
    assert got == want
    assert canonical.found({"forms": df.limit(0)}).count() == 0
    whole = {r.id: r.form_text for r in canonical.consistent(df, "db", ["form_text"]).collect()}
    assert whole[900] is None and all(whole[i] == expected for i, (_, _, expected) in enumerate(CASES))


def test_conflicts_are_refused(monkeypatch):
    monkeypatch.setitem(canonical.LOOK_ALIKES, "cyrillic", ["aб aа"])
    with pytest.raises(ValueError):
        canonical.Transducer("cyrillic")
