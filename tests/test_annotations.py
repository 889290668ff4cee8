"""Annotated documents, display of lookups, importers' text functions and the groupings of vectors, on small cases."""

import itertools
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import scripts
from lexmill.operators import alignment, annotations, corpus, display, fuzzy, prune, vectors
from lexmill.operators.ordering import running


def test_tokens_have_their_place(spark):
    texts = [(1, "One two.  Three\nfour? Five"), (2, None), (3, ""), (4, "x")]
    got = {(r.doc_id, r.sent, r.id): (r.word, r.start, r.stop) for r in annotations.tokens(spark.createDataFrame(texts, "doc_id int, text string")).collect()}
    assert got == {(1, 0, 1): ("One", 0, 3), (1, 0, 2): ("two.", 4, 8), (1, 1, 1): ("Three", 10, 15), (1, 1, 2): ("four?", 16, 21), (1, 2, 1): ("Five", 22, 26), (4, 0, 1): ("x", 0, 1)}


def test_flattened_and_collapsed(spark):
    rows = annotations.tokens(spark.createDataFrame([(1, "a b-c-d e")], "doc_id int, text string"))
    flat = annotations.flattened(rows, F.regexp_extract_all("word", F.lit("([^-]*-+|[^-]+)"), F.lit(1)))
    assert [(r.id, r.word, r.start, r.stop, r.parent) for r in flat.orderBy("id").collect()] == [(1, "a", 0, 1, 1), (2, "b-", 2, 4, 2), (3, "c-", 4, 6, 2), (4, "d", 6, 7, 2), (5, "e", 8, 9, 3)]
    assert [(r.id, r.word, r.head, r.misc) for r in annotations.collapsed(flat).orderBy("id").collect()] == [(1, "a", 0, "_"), (2, "b-c-d", 1, "MWT=Yes"), (3, "e", 2, "_")]


def test_overlay_and_audit(spark):
    rows = [(1, 0, 1, 0, "X"), (1, 0, 2, 1, "X"), (1, 0, 3, 9, "NUM"), (1, 1, 1, 1, "X"), (1, 1, 2, 0, "X"), (2, 0, 1, 0, "X")]
    df = spark.createDataFrame(rows, "doc_id int, sent int, id int, head int, upos string")
    got = {(r.doc_id, r.token): (r.head_token, r.is_root) for r in annotations.overlay(df).collect()}
    assert got == {(1, 0): (None, True), (1, 1): (0, False), (1, 2): (None, False), (1, 3): (3, False), (1, 4): (None, True), (2, 0): (None, True)}
    more = df.withColumns({"is_mwt": F.lit(False), "word": F.lit("ab"), "start": F.lit(0), "stop": F.lit(2), "g": F.lit("x"), "n": F.lit(7)})
    one = annotations.audited(more, "g").head()
    assert (one.n_sentences, one.n_tokens, one.n_selves, one.n_beyond, one.n_unrooted, one.tags) == (3, 6, 1, 1, 0, "NUM,X")


def test_bioes_zip_and_best_runs(spark):
    tags = spark.createDataFrame([(1, k, t) for k, t in enumerate(["B-x", "O", "B-x", "I-x", "B-x", "I-y"])], "d int, k int, t string")
    assert [r.t for r in annotations.bioes(tags, ["d"], "k", "t").orderBy("k").collect()] == ["S-x", "O", "B-x", "E-x", "S-x", "E-y"]
    a = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "chunk int, row int, w string")
    b = spark.createDataFrame([(1, 1, "a"), (1, 2, "x"), (1, 3, "y"), (2, 1, "c")], "chunk int, row int, w string")
    assert {tuple(r) for r in annotations.zipped(a, b, "chunk", "row", "w").collect()} == {(1, 2, 3, 1, 2), (2, 1, 1, 1, None)}
    runs = spark.createDataFrame([("a", 1, True, 5), ("a", 2, True, 5), ("a", 3, False, 9), ("b", 1, False, 3), ("b", 2, False, 1), ("c", 1, True, 0)], "chunk string, retry int, valid boolean, size int")
    assert {(r.chunk, r.retry) for r in annotations.best_runs(runs, "chunk", "valid", "size", "retry").collect()} == {("a", 2), ("b", 1)}


def test_spans_move_however_deep_they_lie(spark):
    kind = "doc array<struct<id:int,span:array<int>,tokens:array<struct<w:string,dspan:array<int>,sub:struct<span:array<int>>>>>>"
    df = spark.createDataFrame([([(1, [0, 2], [("a", [0, 1], ([3, 4],)), ("b", None, None)])],)], kind)
    one = annotations.shifted(df, "doc", F.lit(10)).head().doc[0]
    assert one.span == [10, 12] and one.tokens[0].dspan == [10, 11] and one.tokens[0].sub.span == [13, 14] and one.tokens[1].dspan is None and one.tokens[1].sub is None
    text, places = annotations.kept_places("a, b! 😀c", False, True)
    assert (text, places) == ("a b c", [0, 2, 3, 5, 7])
    spans = spark.createDataFrame([([([0, 1],), ([2, 5],), ([4, 9],), ([9, 9],), ([-2, 0],)],)], "s array<struct<span:array<int>>>")
    back = annotations.remapped(spans, "s", F.array(*map(F.lit, places)), F.lit(8)).head().s
    assert [x.span for x in back] == [[0, 1], [3, 8], [7, 8], [8, 8], [0, 0]]
    assert annotations.remapped(spans, "s", F.array().cast("array<int>"), F.lit(0)).head().s[0].span == [0, 0]
    assert annotations.kept_places("كَتَبَ", True, False)[0] == "كتب" and annotations.kept_places(None, True, True) == ("", [])


def test_labels_are_repaired():
    out = [("the", "O"), ("Cat", "B-x"), ("sat-down", "I-x"), ("extra", "B-y")]
    labels, log = annotations.repaired_labels(["the", "cat", "sat", "down", "here"], out)
    assert labels[0] == "O" and len(labels) == 5 and [x["fix"] for x in log] == ["by_position"]
    labels, log = annotations.repaired_labels(["a", "b", "c", "d"], [("a", "B-x"), ("bc", "I-x"), ("d", None), ("e", "B-z")])
    assert labels == ["B-x", "I-x", "I-x", "O"] and [x["fix"] for x in log] == ["one_row_for_several", "extra_rows_dropped"]
    assert annotations.repaired_labels(["a", "b"], [("b", "B-x")])[0] == ["O", "B-x"] and annotations.repaired_labels([], []) == ([], [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=9), st.integers(1, 4), st.integers(0, 9))
def test_batches_cost_least(lengths, most, overhead):
    own = [n for n in lengths if n]

    def cost(cuts):
        return sum((b - a) * own[b - 1] + overhead for a, b in cuts)

    got = alignment.batches(lengths, most, overhead)
    assert [k for a, b in got for k in range(a, b)] == list(range(len(own))) and all(b - a <= most for a, b in got)
    every = [list(zip((0, *c), (*c, len(own)))) for r in range(len(own)) for c in itertools.combinations(range(1, len(own)), r)] if own else [[]]
    assert cost(got) == min(cost(c) for c in every if all(b - a <= most for a, b in c))


def test_importers_text_functions(spark):
    assert [scripts.pinyin(t) for t in ("ni3 hao3", "lv4 nü3", "gong1zuo4", "liu2 gui4", "ma5", "Xi'an1", "abc", "x9 r4")] == ["nǐ hǎo", "lǜ nǚ", "gōngzuò", "liú guì", "ma", "Xi'ān", "abc", "x9 r"]
    assert [scripts.romaji(t) for t in ("きゃく", "がっこう", "マッチ", "ラーメン", "しゃしん", "ティー", "ｶﾞﾑ", "漢じ", "っ")] == ["kyaku", "gakkou", "matchi", "raamen", "shashin", "tii", "gamu", "漢ji", ""]
    assert scripts.beta_greek("lo/gos") == unicodedata.normalize("NFC", "λόγος") and scripts.beta_greek("*)aqh=nai") == unicodedata.normalize("NFC", "Ἀθῆναι")
    assert [scripts.feats_text(x) for x in (None, " a=b ", '{"Case":"Nom","":"x"," ":""}', '["a", " ", "b"]', "[broken", "7")] == ["", "a=b", "Case=Nom|x", "a|b", "[broken", "7"]
    assert scripts.canonical_json('{"b":1,"a":[{"d":2,"c":"é"}]}') == '{"a":[{"c":"é","d":2}],"b":1}' and scripts.canonical_json("{") is None and scripts.canonical_json(None) is None
    df = spark.createDataFrame([("The Cités of classes/types, 12",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(scripts.plain_tokens(F.col("t"))).collect()] == [["cite", "class"], [], []]
    assert df.select(scripts.phrases(F.col("t"))).head()[0] == ["cite class"]
    glosses = [("nouns;  A Thing", "Nouns - a Thing"), ("a; b - c", "a; b - c"), ("plain", "plain"), ("; x", "; x"), (None, "")]
    df = spark.createDataFrame(glosses, "g string, want string")
    assert all(r.got == r.want for r in df.select("want", scripts.clean_gloss(F.col("g")).alias("got")).collect())


def test_sides(spark):
    rows = [(1, "en", "a", "verb", None), (2, "en", "a", "noun", None), (3, "en", "a", "character", None), (4, "en", "b", "root", ""), (5, "en", "c", "noun", ""), (6, "en", "c", "adj", None), (7, "en", "d", "phrase", ""), (8, "en", "d", "verb", "noun-from-verb"), (9, "ja", "e", "character", ""), (10, "ja", "e", "verb", ""), (11, "en", None, "verb", ""), (12, "en", None, "noun", "")]
    df = spark.createDataFrame(rows, "id int, db string, headword string, pos string, tags string")
    got = {r.id: r.side for r in display.sides(df, ["db", "headword"], display.UPOS["VERB"]).collect()}
    assert got == {1: "primary", 2: "other", 3: "other", 4: "primary", 5: "primary", 6: "primary", 7: "primary", 8: "other", 9: "other", 10: "primary", 11: "primary", 12: "other"}
    assert {r.side for r in display.sides(df.where("headword = 'a'"), ["db", "headword"], []).where("id < 3").collect()} == {"primary"}


def test_lookup_to_display(spark):
    entries = spark.createDataFrame([(1, "xx", "run", "r", "verb", "", "s", "e1", '[["runs","plural"],{"form":"ran","tags":"past"},"runner"]'), (2, "xx", "ran", "", "noun", "", "s", None, "{"), (3, "yy", "go", "", "verb", "", None, None, None)], "id bigint, db string, headword string, romanization string, pos string, tags string, source string, entry_id string, forms string")
    forms = spark.createDataFrame([(10, 1, "ran", "past", "R"), (11, 1, "ran", "past", "R"), (12, 1, "Run", "alternative", None), (13, 3, "ran", "alternative;x", ""), (14, 1, "字", "Hanja", ""), (15, 9, "ran", "", ""), (16, None, "ran", "", "")], "id bigint, entry_id bigint, form_text string, morph_tags string, romanization string")
    refs = display.surface_refs(spark.createDataFrame([("ran",), ("ran",), (None,), ("",)], "word string"), entries, forms)
    assert {(r.entry_id, r.form_id, r.match_kind) for r in refs.collect()} == {(2, 0, "headword"), (1, 10, "form"), (3, 13, "form")}
    assert {(r.entry_id, r.form_id, r.tags) for r in display.matched_forms(refs, forms).collect()} == {(1, 10, "past"), (3, 13, "alternative;x")}
    special = display.special_forms(refs, entries, forms)
    assert {(r.entry_id, r.form_text) for r in special.collect()} == {(1, "Run"), (1, "字")}
    shown = {r.entry_id: r for r in display.payload(refs, entries, forms).collect()}
    assert (shown[1].display_headword, shown[1].morph_base, shown[1].morph_info, shown[1].display_reading, shown[1].is_alternate, shown[1].ref_key) == ("ran", "run", "past", "R", False, "sqlite|xx|1|10")
    assert shown[3].is_alternate and shown[2].match_kind == "headword" and shown[2].morph_info is None
    sides = {r.ref_key: r.side for r in display.merged(display.payload(refs, entries, forms), "VERB").collect()}
    assert sides == {"sqlite|xx|1|10": "primary", "sqlite|xx|2": "other", "sqlite|yy|3|13": "other"}
    rows = {(r.entry_id, r.word, r.commentary) for r in display.display_rows(entries, special).collect()}
    assert rows == {(1, "runs", "plural"), (1, "ran", "past"), (1, "runner", ""), (1, "Run", "alternative"), (1, "字", "Hanja")}
    assert spark.range(1).select(display.buckets(F.lit("Sinitic, hán-nôm;x|HANJA"))).head()[0] == ["cjk", "hanja"]


def brute_merge(m, counts, least):
    groups = {i: [i] for i in range(len(m))}
    while len(groups) > 1:
        centre = {g: vectors.unit([sum(m[i] * counts[i] for i in x)])[0] for g, x in groups.items()}
        best, a, b = max(((float(centre[a] @ centre[b]), -a, -b) for a in groups for b in groups if a < b))
        if best < least:
            break
        groups[-a] = sorted(groups[-a] + groups.pop(-b))
    return {frozenset(x) for x in groups.values()}


def groups_of(own):
    return {frozenset(i for i, g in enumerate(own) if g == k) for k in set(own)}


@pytest.mark.parametrize("seed", range(6))
def test_groupings(seed):
    rng = np.random.default_rng(seed)
    m, counts = rng.normal(size=(14, 3)), rng.integers(1, 9, 14)
    assert groups_of(vectors.merge_groups(m, counts, 0.6)) == brute_merge(m, counts, 0.6)
    own = vectors.gated_groups(m, counts, 0.5, 0.7)
    u = vectors.unit(m)
    for g in groups_of(own):
        members = sorted(g)
        centre = vectors.unit([(u[members] * counts[members][:, None]).sum(axis=0)])[0]
        assert len(members) == 1 or np.average(u[members] @ centre, weights=counts[members]) >= 0.7 - 1e-9
    sizes = sorted(len(g) for g in groups_of(vectors.balanced_groups(m, 4)))
    assert sizes == [3, 3, 4, 4]
    for by_centre in (False, True):
        rolled = vectors.snowball_groups(m, counts, 0.3, by_centre)
        assert min(rolled) == 0 and set(rolled) == set(range(max(rolled) + 1))
        assert len(groups_of(vectors.snowball_groups(m, counts, 2.0, by_centre))) == len(m)
    told = vectors.partition_metrics(m, counts, own, [(0, 1, 0.5), (2, 3, 0.4)])
    assert told["n_groups"] == len(set(own)) and abs(told["score"] - sum(vectors.SCORE[k] * told[k] for k in vectors.SCORE)) < 1e-9
    assert vectors.modularity(4, [(0, 1, 1.0), (2, 3, 1.0)], [0, 0, 1, 1]) == 0.5 and vectors.modularity(2, [], [0, 1]) == 0.0


def test_long_keys_meet_by_segments(spark):
    rng = random.Random(3)
    keys = ["".join(rng.choices("abcd", k=rng.randrange(1, 22))) for _ in range(120)]
    asked = []
    for k in keys[:60]:
        s = list(k)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.randrange(2)] = rng.choices("abcdx", k=rng.randrange(2))
        asked.append("".join(s) or "x")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    got = {(r.query, r.tier, r.key) for r in fuzzy.tiered(spark.createDataFrame([(a,) for a in asked], "key string"), spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    want = set()
    for q in set(asked):
        near = {k: distance(q, k) for k in set(keys)}
        tier = min(near.values())
        if tier <= 3:
            want |= {(q, tier, k) for k, n in near.items() if n == tier}
    assert got == want


def test_running_sums_and_phrases(spark):
    rows = [(g, k, k % 5) for g in ("a", None) for k in range(40)]
    got = {(r.g, r.k): r.upto for r in running(spark.createDataFrame(rows, "g string, k int, n bigint"), ["g"], [F.asc("k")], "n", "upto", 5).collect()}
    assert got == {(g, k): sum(j % 5 for j in range(k + 1)) for g in ("a", None) for k in range(40)}
    df = spark.createDataFrame([(1, "aAaa b"), (2, None), (3, "B")], "id int, t string")
    found = corpus.occurrences(df, "t", spark.createDataFrame([("aa",), ("b",), ("",), (None,)], "phrase string"))
    assert {(r.id, r.phrase, r.n) for r in found.collect()} == {(1, "aa", 2), (1, "b", 1), (3, "b", 1)}


def test_a_rotation_learns_from_its_own_pairs(spark):
    import pandas as pd

    rng = np.random.default_rng(4)
    turn, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    centres = vectors.unit(rng.normal(size=(12, 6)))
    points = centres @ turn.T + rng.normal(scale=0.02, size=(12, 6))
    rows = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(99, None)], "id bigint, v array<double>")
    table = pd.DataFrame({"label": range(12), "centroid": list(centres)})
    rough, _ = np.linalg.qr(turn + rng.normal(scale=0.12, size=(6, 6)))
    rough = rough * np.sign(np.sum(rough * turn, axis=0))
    own, rotation = vectors.self_learned(rows, table, rough, "id", "v", "label", 5, 3)
    assert np.abs(rotation @ rotation.T - np.eye(6)).max() < 1e-9
    assert np.abs(rotation - turn).max() < np.abs(rough - turn).max() and np.abs(rotation - turn).max() < 0.1
    assert sum(r.id == r.label for r in own.collect()) >= 11


def test_what_an_import_keeps(spark):
    forms = '[["run","alternative"],["run","plural"],{"form":"ran","tags":"past"},"",["ran","past"]]'
    df = spark.createDataFrame([(1, "en", "run", forms), (2, "ko-krdict", "말", '[["말","x"],["말이",""]]'), (3, "en", None, None), (4, "en", "x", "{")], "id bigint, db string, headword string, forms string")
    assert {tuple(r) for r in display.imported_forms(df).collect()} == {(1, "run", "plural", ""), (1, "ran", "past", ""), (2, "말이", "", "")}
    rows = [("ko-krdict", "", ["말"], True), ("ko-krdict", "unk", [], True), ("ko-krdict", "[]", ["a horse"], False), ("ko-krdict", "noun", [], False), ("ko", "", [], False), ("ko-krdict", None, ["x"], False)]
    df = spark.createDataFrame(rows, "db string, pos string, g array<string>, want boolean")
    assert all(r.got == r.want for r in df.select("want", prune.placeholder(F.col("db"), F.col("pos"), F.col("g")).alias("got")).collect())
