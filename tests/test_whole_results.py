"""Results that were cut short once: every row, pair or value must come out."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexmill.operators import lexicon, vectors
from lexmill.operators.ordering import ranked
from lexmill.plans import lexical
from lexmill.sources import files


def tables(spark, folder, **given):
    for name, (rows, schema) in given.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_w13_every_surface_has_its_place(spark, tmp_path):
    rows = [(e, "xx", f"w{k:02d}") for k in range(30) for e in range(2 + k % 3)]
    d = tables(spark, tmp_path, forms=(rows, "entry_id bigint, db string, form_text string"))
    got = {r.form_text: r.place for r in entry.queries()["w13_fanout_places"](spark, d).collect()}
    order = sorted(range(30), key=lambda k: (-(k % 3), k))
    assert got == {f"w{k:02d}": at for at, k in enumerate(order, 1)}


def test_ranked_over_ranges_equals_a_sort(spark):
    rows = [(g, (k * 7919) % 1009, k) for g, n in (("a", 900), ("b", 3), ("c", 40)) for k in range(n)]
    out = ranked(spark.createDataFrame(rows, "g string, n int, k int"), ["g"], [F.desc("n"), F.asc("k")], parts=7)
    want = {(g, n, k, at) for x in "abc" for at, (g, n, k) in enumerate(sorted((r for r in rows if r[0] == x), key=lambda r: (-r[1], r[2])), 1)}
    assert {tuple(r) for r in out.collect()} == want


def test_m05_an_entry_of_many_spellings_keeps_them_all(spark, tmp_path):
    rows = [(1, f"s{k:03d}") for k in range(120)] + [(1, "s000"), (2, "x"), (None, "x"), (3, "")]
    d = tables(spark, tmp_path, forms=(rows, "entry_id bigint, romanization string"))
    got = {(r.entry_id, r.romanization): r.n for r in entry.queries()["m05_form_spellings"](spark, d).collect()}
    assert got == {(1, f"s{k:03d}"): 1 + (k == 0) for k in range(120)} | {(2, "x"): 1}


def test_x19_reads_quoted_tags_and_every_separator(spark, tmp_path):
    rows = [(1, 'Case=Nom;feminine;"accusative"'), (2, "Number=Sing；Case=Acc"), (3, "Case=Gen , Tense=Past"), (4, '["Gender=Fem", "Case=Dat"]'), (5, '"Case=Loc|x"|Number=Plur'), (6, "noun"), (7, None), (8, "Case=Nom;Case=Voc")]
    d = tables(spark, tmp_path, forms=(rows, "id bigint, morph_tags string"))
    got = {r.id: r.feats for r in entry.queries()["x19_feats"](spark, d).collect()}
    assert got == {1: "nom", 2: "acc;sing", 3: "gen;past", 4: "dat;fem", 5: "loc|x;plur", 8: "voc"}


def test_v15_every_pair_is_compared(spark, tmp_path):
    rows = [("a", "t", 2), ("a", "u", 2), ("b", "v", 5), ("c", "t", 1), ("c", "t", 2), ("d", "w", None), ("e", "x", 0)]
    d = tables(spark, tmp_path, form_tags_flat=(rows, "db string, form_tag string, occurrence_count bigint"))
    got = {(r.a, r.b): r.jaccard for r in entry.queries()["v15_jaccard_pairs"](spark, d).collect()}
    assert got == {(x, y): 0.4 if (x, y) == ("a", "c") else 0.0 for x in "abcde" for y in "abcde" if x < y}


def test_j19_keys_are_counted_exactly(spark, monkeypatch):
    rows = [("headword", f"k{k}", "xx", k) for k in range(5000)] + [("form", f"k{k}", "xx", k // 2) for k in range(3000)]
    index = spark.createDataFrame(rows, "kind string, key string, db string, entry_id bigint")
    monkeypatch.setattr(lexical, "_store", lambda s, d: (None, None))
    monkeypatch.setattr(lexicon, "key_index", lambda entries, forms: index)
    got = {r.kind: (r.n_postings, r.n_keys) for r in entry.queries()["j19_hits"](spark, "").collect()}
    assert got == {"headword": (5000, 5000), "form": (2999, 2999)}


def test_v14_cosines_of_grams_up_to_three_words(spark, tmp_path):
    rows = [("xx", "one two three", None), ("xx", "zero one two three", ""), ("xx", "two", "one | three"), *(("xx", f"w{c}w", None) for c in "abcdefgh")]
    d = tables(spark, tmp_path, form_tags_flat=(rows, "db string, form_tag string, sample_examples string"))
    got = {(r.a, r.b): r.cosine for r in entry.queries()["v14_ngram_cosines"](spark, d).collect()}
    rare, common = np.log(12 / 3) + 1, np.log(12 / 4) + 1
    part = np.sqrt(3 * common**2 / (3 * common**2 + 3 * rare**2))
    assert got == {("one two three", "zero one two three"): 1.0, ("one two three", "two"): round(part, 6), ("two", "zero one two three"): round(part, 6)}


def test_v18_csls_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(60, 4)), rng.normal(size=(5, 4))
    r = np.linalg.qr(rng.normal(size=(4, 4)))[0]
    rows = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id bigint, v array<double>").repartition(3)
    got = {a.id: (a.label, a.csls) for a in vectors.csls(rows, pd.DataFrame({"label": range(5), "centroid": list(c)}), r, "id", "v", "label", 3).collect()}
    sims = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ r @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T
    score = 2 * sims - np.sort(sims, axis=1)[:, -3:].mean(axis=1)[:, None] - np.sort(sims, axis=0)[-3:].mean(axis=0)
    assert {i: s[0] for i, s in got.items()} == dict(enumerate(score.argmax(axis=1)))
    assert all(abs(got[i][1] - score[i].max()) < 1e-6 for i in got)


def test_e02_long_texts_are_compared_whole(spark, tmp_path):
    d = tables(spark, tmp_path, documents=([(1, " ".join(f"w{k}" for k in range(100_050)))], "doc_id bigint, text string"))
    assert [tuple(r) for r in entry.queries()["e02_agreement"](spark, d).collect()] == [(1, 100_050, 0, 100_050, 100.0)]


def test_s19_texts_with_tags_are_sanitized(spark, tmp_path):
    rows = [(1, "a <b>bold</b> word<script>bad()</script>"), (2, "plain"), (3, None), (4, "x<!-- y > z -->")]
    d = tables(spark, tmp_path, documents=(rows, "doc_id bigint, text string"))
    got = {r.doc_id: r.text for r in entry.queries()["s19_texts"](spark, d).collect()}
    assert got == {1: "a bold word", 2: "plain", 4: "x"}
    html = {r.doc_id: r.html for r in entry.queries()["s19_sanitized"](spark, d).collect()}
    assert html == {1: '<div><p lang="en">a <b>bold</b> word</p>z</div>', 2: '<div><p lang="en">plain</p>z</div>', 4: '<div><p lang="en">x</p>z</div>'}


def test_s19_keeps_only_what_is_allowed():
    clean = files.clean_html
    assert clean('<a href="javascript:x" title="t" onclick="y">l</a>') == '<a title="t">l</a>'
    assert clean("<ul><li>a<li>b</ul><svg><p>no</p></svg>&lt;b&gt; &amp;<br/>") == "<ul><li>a<li>b</li></li></ul>&lt;b&gt; &amp;<br>"
    assert clean("<b>open <i>never closed") == "<b>open <i>never closed</i></b>" and clean(None) == "" and clean("</p>x</div>") == "x"
    assert clean("<style>p{}</style><scr<script>ipt>alert(1)</script>ok") == "ok" or "<script" not in clean("<style>p{}</style><scr<script>ipt>alert(1)</script>ok")


def test_k03_and_k08_run_on_whole_tables(spark, tmp_path):
    form = "entry_id bigint, form_text string, morph_tags string"
    d = tables(
        spark, tmp_path, forms=([(1, "a", None), (1, "a", None)], form), forms_stage=([(1, "a", None), (2, "b", "x"), (2, "b", "x"), (None, "c", None)], form),
        custom_dict_forms=([(1, "old"), (9, "orphan"), (None, "loose")], "entry_pk bigint, form_text string"), custom_dict_entries=([(1, "new"), (2, "other")], "id bigint, headword string"),
    )
    got = {name: sorted((tuple(r) for r in entry.queries()[name](spark, d).collect()), key=str) for name in ("k03_inserted_forms", "k08_replaced_all")}
    assert got["k03_inserted_forms"] == [(1, "a", None), (1, "a", None), (2, "b", "x"), (None, "c", None)]
    assert got["k08_replaced_all"] == [(1, "new"), (2, "other"), (9, "orphan"), (None, "loose")]
