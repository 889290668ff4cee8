"""Keys, prune policy, fuzzy lookup and segmentation against fixed cases and brute force."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import normalize
from lexmill.operators import fuzzy, lexicon, prune, segmentation


@pytest.mark.parametrize("text, lang, key", [("Λόγος", "grc", "λογοσ"), ("ἀλλ’", "grc", "αλλα"), ("أُسْتاذ", "ar", "استاذ"), ("İIX", "tr", "iıx"), ("Þēod-cyning", "ang", "þeodcyning"), ("  Don't ", "en", "dont"), ("", "en", ""), (None, None, ""), ("ｗｉｄｅ", "xx", "wide")])
def test_lookup_keys(text, lang, key):
    assert normalize.lookup_key(text, lang) == key


def test_rules_can_be_disabled_and_transliteration():
    assert normalize.lookup_key("ē", "ang", disabled=("old_english",)) == "ē"
    assert normalize.devanagari_to_iast("संस्कृतम्") == "saṃskṛtam"
    assert normalize.slp1_to_iast(normalize.iast_to_slp1("saṃskṛtam")) == "saṃskṛtam"
    assert normalize.anusvara("saṅgha sandhi") == "saṃgha saṃdhi"
    assert normalize.korean_stem("먹다", "verb") == "먹" and normalize.korean_stem("먹다", "noun") == ""


REASONS = [
    ("en", "run", "run", "", "hard_text:identical_to_headword"),
    ("en", "-ing", "go", "", "hard_text:hyphen_affix_mismatch"),
    ("en", "xiv", "go", "romanization", ""),
    ("en", "goes", "go", "class;auxiliary", "hard_tag:auxiliary"),
    ("en", "XIV", "go", "", "hard_text:roman_numeral"),
    ("ja", "XIV", "XX", "", ""),
    ("en", "i-j alternation", "go away", "", "hard_text:alternation_label"),
    ("en", "foo (bar", "go", "", "hard_text:template_leak"),
    ("en", "see the appendix for more", "a b c d e", "", "hard_text:english_prose"),
    ("en", "идти", "go", "", "hard_text:zero_overlap_cross_script"),
    ("en", "go away", "go", "", "rule_a_word_count"),
    ("en", "goes", "go", "plural", ""),
]


def test_occurrence_reasons(spark):
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(REASONS)], "i int, db string, form string, head string, raw string")
    got = df.withColumn("tags", prune.folded_tags(F.col("raw"))).select("i", prune.occurrence_cut(F.col("db"), F.col("form"), F.col("head"), F.col("tags")).alias("r")).collect()
    assert {r.i: r.r for r in got} == {i: r[4] for i, r in enumerate(REASONS)}


def test_gloss_buckets_and_tags(spark):
    values = [(1, None), (2, "[]"), (3, '["—"]'), (4, '["слово"]'), (5, '{"glosses":[{"gloss":"word"}]}'), (6, '["x"'), (7, "plain")]
    got = spark.createDataFrame(values, "i int, g string").select("i", prune.gloss_bucket(prune.glosses(F.col("g"))).alias("b")).collect()
    assert {r.i: r.b for r in got} == {1: "missing", 2: "missing", 3: "symbol_only", 4: "non_latin_only", 5: "ok", 6: "ok", 7: "ok"}
    assert prune.fold_tags("Plural; ｐｌｕｒａｌ;;x") == ["plural", "x"]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(itertools.accumulate(enumerate(b, 1), lambda left, jb, row=row, x=x: min(left + 1, row[jb[0]] + 1, row[jb[0] - 1] + (x != jb[1])), initial=i))
    return row[-1]


def test_fuzzy_equals_brute_force(spark):
    keys = ["haus", "maus", "hause", "schön", "schon", "x", "baum", "bäume", ""]
    asked = ["haus", "hauss", "schön", "zzzzzzzz", "schn", "", "bxume"]
    got = {(r.query, r.tier, r.key) for r in fuzzy.tiered(spark.createDataFrame([(a,) for a in asked], "key string"), spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    want = set()
    for q in filter(None, asked):
        near = {k: edit(fuzzy.decomposed(q), fuzzy.decomposed(k)) for k in keys if k}
        tier = min(near.values())
        if tier <= 3:
            want |= {(q, tier, k) for k, d in near.items() if d == tier}
    assert got == want


def covers(n, known):
    """All covers by known spans and single unknown graphemes."""
    if n == 0:
        return [[]]
    out = []

    def go(i, path):
        if i == n:
            out.append(path)
            return
        for end in range(i + 1, n + 1):
            if (i, end) in known:
                go(end, [*path, (i, end, True)])
        go(i + 1, [*path, (i, i + 1, False)])

    go(0, [])
    return out


@settings(max_examples=120, deadline=None)
@given(st.integers(1, 8), st.sets(st.tuples(st.integers(0, 7), st.integers(1, 8)), max_size=10))
def test_segmentation_equals_enumeration(n, raw):
    known = {(a, b): f"{a}-{b}" for a, b in raw if a < b <= n}
    got = segmentation.segment(["x"] * n, known, exclude_whole=True)
    assert [s[0] for s in got] == [0, *[s[1] for s in got[:-1]]] and got[-1][1] == n
    allowed = {k for k in known if k != (0, n)}

    def score(path):
        return sum(not k for *_, k in path), len(path), -max(b - a for a, b, _ in path)

    assert score(got) == min(score(p) for p in covers(n, allowed))


def test_segmentation_boundaries_and_hints():
    parts = list("abcd")
    assert segmentation.segment(parts, {(0, 4): "w"}) == [(0, 4, True)]
    assert segmentation.segment(parts, {(0, 3): "x", (0, 2): "y", (2, 4): "z"}, bounds=[2]) == [(0, 2, True), (2, 4, True)]
    assert segmentation.segment(parts, {(0, 3): "x", (0, 2): "y"}, hints=["y"])[0] == (0, 2, True)
    assert segmentation.segment([], {}) == []


def test_key_index_finds_every_headword(spark):
    entries = spark.createDataFrame([(1, "de", "Haus", "", "noun", '["house"]'), (2, "de", "Haus", "", "noun", '["house"]'), (3, "ko", "먹다", "", "verb", "to eat"), (4, "de", "leer", "", "adj", "[]")], "id bigint, db string, headword string, romanization string, pos string, glosses string")
    forms = spark.createDataFrame([(10, 2, "de", "Hauses", "genitive", ""), (11, 2, "de", "Hauses", "genitive", ""), (12, 9, "de", "lost", "", "")], "id bigint, entry_id bigint, db string, form_text string, morph_tags string, romanization string")
    got = {tuple(r) for r in lexicon.key_index(entries, forms).collect()}
    assert got == {("headword", "de", "haus", 1, 0), ("headword", "ko", "먹다", 3, 0), ("headword", "ko", "먹", 3, 0), ("form", "de", "hauses", 1, 10)}
    assert lexicon.key_index(entries.limit(0), forms.limit(0)).count() == 0


def test_chosen_reason(spark):
    rows = [(["hard_text:x", "exact_blacklist"],), (["rule_a_word_count", "hard_tag:class"],), (["odd"],), ([],)]
    got = [r[0] for r in spark.createDataFrame(rows, "r array<string>").select(prune.chosen_reason(F.col("r"))).collect()]
    assert got == ["exact_blacklist", "hard_tag:class", "odd", ""]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyzABCDEFGHJKLMNOPQRSTUVWXYZ0123456789-", min_size=1, max_size=12))
def test_plain_words_have_one_key_everywhere(word):
    keys = {normalize.lookup_key(word, lang) for lang in ("", *normalize.rule_sets(), "de", "zz")}
    assert keys == {word.replace("-", "").lower()}


def test_lookup_everywhere_equals_lookup_in_each_language(spark):
    index = spark.createDataFrame([("headword", normalize.lookup_key(w, g), g, i, 0) for i, (w, g) in enumerate([("Haus", "de"), ("haus", "fr"), ("Iki", "tr"), ("iki", "de"), ("كتاب", "ar"), ("کتاب", "fa"), ("café", "fr"), ("deva", "sa")])], "kind string, key string, db string, entry_id bigint, form_id bigint")
    words = ["HAUS", "Iki", "iki", "كتاب", "کتاب", "café", "Ha-us", "déva", "", None]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r.word, r.lang, r.entry_id) for r in lexicon.lookup_everywhere(frame, index).collect()}
    each = spark.createDataFrame([(w, g) for w in words for g in ("de", "fr", "tr", "ar", "fa", "sa")], "word string, lang string")
    assert got == {(r.word, r.lang, r.entry_id) for r in lexicon.lookup(each, index).collect()} and len(got) > 6
