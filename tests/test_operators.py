"""Ordering, state machines, corpus shaping, alignment, vectors, files."""

import difflib
import hashlib
import itertools
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.operators import alignment, corpus, ordering, sequential, vectors
from lexmill.sources import files


def test_global_rank(spark):
    df = spark.range(300).withColumnRenamed("id", "k")
    got = {r.k: r["rank"] for r in ordering.global_rank(df, F.md5(F.col("k").cast("string")), tie="k").collect()}
    order = sorted(range(300), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
    assert got == {k: i + 1 for i, k in enumerate(order)}


def test_limiter_counts_only_admissions(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, i, t + timedelta(seconds=10 * i)) for i in range(12)] + [(2, 99, t)]
    df = spark.createDataFrame(rows, "u bigint, i bigint, at timestamp_ntz")
    got = {r.i: r.ok for r in sequential.stepped(df, ["u"], ["at", "i"], "u bigint, i bigint, ok boolean", sequential.limiter(2, 60)).collect()}
    assert [i for i in range(12) if got[i]] == [0, 1, 6, 7] and got[99]


def test_rollover_and_store():
    step = sequential.rollover(30)()
    t = datetime(2024, 1, 1)
    assert [step((1, i, t + timedelta(days=d), 1.0))[2:] for i, d in enumerate((0, 29, 31))] == [(t, 1.0), (t, 2.0), (t + timedelta(days=31), 1.0)]
    s = sequential.BoundedStore(10, 100)
    assert s.put("a", 4, 0) == [] and s.put("b", 4, 1) == [] and s.get("a", 2)
    assert s.put("c", 4, 3) == ["b"] and not s.get("b", 4) and s.put("d", 11, 4) == []
    assert not s.get("a", 101) and s.get("c", 102)


def test_sentences_and_tokens_slice_back():
    text = "One two. “Three!” Four"
    assert [text[a:b] for a, b in corpus.sentence_spans(text, "en")] == ["One two.", "“Three!”", "Four"]
    assert corpus.sentence_spans(None) == [] and corpus.sentence_spans("  ") == []


def test_bio_repair_spans_packing(spark):
    df = spark.createDataFrame([(["O", "I-x", "I-x", "I-y", "B-y", "O"], ["a", None, "a", "a", "b", None], [100, 250, 50, 400, 10])], "t array<string>, l array<string>, n array<int>")
    r = df.select(corpus.repaired(F.col("t")).alias("r"), corpus.bio(F.col("l")).alias("b"), corpus.entity_spans(F.col("t")).alias("e"), corpus.packed(F.col("n"), 300).alias("p")).first()
    assert r.r == ["O", "B-x", "I-x", "B-y", "B-y", "O"]
    assert r.b == ["B-a", "O", "B-a", "I-a", "B-b", "O"]
    assert [(x.type, x.start, x.end) for x in r.e] == [("x", 1, 3), ("y", 3, 4), ("y", 4, 5)]
    assert r.p == [0, 1, 1, 2, 3]


def test_splits_are_disjoint_and_sized(spark):
    df = spark.range(200).select(F.col("id").alias("k"), F.concat(F.lit("g"), (F.col("id") % 20).cast("string")).alias("g"))
    parts = {r.part: r["count"] for r in corpus.hash_split(df.select("k"), "k", 0.8, 0.1).groupBy("part").count().collect()}
    assert parts == {"train": 160, "dev": 20, "test": 20}
    dev = {r.g for r in corpus.group_split(df, "g", 0.1).where("part = 'dev'").collect()}
    assert dev == set(sorted((f"g{i}" for i in range(20)), key=lambda g: hashlib.sha1(g.encode()).hexdigest())[:2])
    quota = corpus.allocation(df.groupBy("g").count(), "g", "count", 50).agg(F.sum("quota")).first()[0]
    assert quota == 50


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=5), st.text("abc", max_size=5))
def test_alignment_is_best(a, b):
    matched, edits, places = alignment.align(a, b)
    assert len(places) == len(a) and all(0 <= p < max(1, len(b)) for p in places) and places == sorted(places)
    lcs = max((len(x) for n in range(len(a) + 1) for x in itertools.combinations(a, n) if _sub(x, b)), default=0)
    assert matched == lcs


def _sub(x, b):
    it = iter(b)
    return all(c in it for c in x)


@pytest.mark.parametrize("probes, surface", [(["de", "el"], "del"), (["a", "el"], "al"), (["dar", "me", "lo"], "dármelo"), (["x"], "x"), (["al", "so"], "also")])
def test_partition_covers_surface(probes, surface):
    cuts = alignment.partition(probes, surface)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(surface) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert alignment.partition(["a", "b"], "x") is None


def test_sequence_helpers():
    assert alignment.agreement(list("abcd"), list("abxd"))["same"] == sum(b.size for b in difflib.SequenceMatcher(None, "abcd", "abxd").get_matching_blocks())
    assert alignment.drift(["a", "b", "c"], ["a", "x", "b", "c"]) == [(0, 0), (1, 2), (2, 3)]
    assert alignment.beam([[("a", 3), ("b", 1)], [("a", 2), ("c", 0)]]) == ["b", "a"]
    text, places = alignment.normalised_with_map("ﬁx")
    assert text == "fix" and places == [0, 0, 1]


def test_top_similar_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(60)] + [(60, None)], "id bigint, v array<float>").repartition(3)
    got = {}
    for r in vectors.top_similar(df.where("id % 10 = 0"), df, "id", "v", 3).collect():
        got.setdefault(r.query_id, {})[r.place] = r.neighbour_id
    u = vectors.unit(m.astype("float32"))
    for q in range(0, 60, 10):
        sims = u @ u[q]
        sims[q] = -9
        assert [got[q][k] for k in (1, 2, 3)] == list(np.argsort(-sims)[:3])


def test_components_equal_union_find(spark):
    edges = [(1, 2), (2, 3), (4, 5), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20)]
    got = {r.node: r.component for r in vectors.components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4, 8: 4, 9: 4, 20: 20}


def test_small_groupings():
    m = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99]])
    for own in (vectors.seed_groups(m, np.ones(4), 0.9), vectors.merge_groups(m, np.ones(4), 0.9), vectors.communities(4, vectors.mutual_edges(m, 1, 0.5))):
        assert own[0] == own[1] != own[2] == own[3]


def test_files_round_trip(spark, tmp_path):
    tokens = spark.createDataFrame([("s1", 1, "The", "DET"), ("s1", 2, "cat", "NOUN"), ("s2", 1, "Go", None)], "sent_id string, id int, form string, upos string")
    files.write_conllu(tokens, str(tmp_path / "c"))
    got = {(r.sent_id, r.id, r.form, r.upos) for r in files.read_conllu(spark, str(tmp_path / "c")).collect()}
    assert got == {("s1", "1", "The", "DET"), ("s1", "2", "cat", "NOUN"), ("s2", "1", "Go", "_")}
    (tmp_path / "b.bio").write_text("A B-x\nb I-x\n\nc Q\n")
    assert sorted((len(r.tokens), r.valid) for r in files.read_bio(spark, str(tmp_path / "b.bio")).collect()) == [(1, False), (2, True)]
    (tmp_path / "d.u8").write_text("# x\n漢字 汉字 [han4 zi4] /a/b/\n")
    assert files.read_cedict(spark, str(tmp_path / "d.u8")).first().glosses == ["a", "b"]
    (tmp_path / "x.xml").write_text("<r><e><w>a</w></e><e><w>b</w></e></r>")
    assert {r.w for r in files.read_xml(spark, str(tmp_path / "x.xml"), "e", "w string").collect()} == {"a", "b"}
    (tmp_path / "v.vec").write_text("2 2\na 3 4\nb 1 0\n")
    assert files.read_vec(spark, str(tmp_path / "v.vec"), spark.createDataFrame([("a",)], "word string")).first().v == [0.6, 0.8]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1").write_bytes(b"ab")
    (tmp_path / "p" / "2").write_bytes(b"c")
    assert files.reassembled(spark, str(tmp_path / "p"), 3, hashlib.sha256(b"abc").hexdigest()) == b"abc"
    with pytest.raises(ValueError):
        files.reassembled(spark, str(tmp_path / "p"), 4, "")
    html = spark.createDataFrame([("<p>a <b>b</b></p><script>x</script>",), (None,)], "h string").select(files.plain_text(F.col("h")).alias("t"))
    assert [r.t for r in html.collect()] == ["a b", ""]


def test_upserts(spark, tmp_path):
    have = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c"), (3, "c")], "k int, v string")
    assert sorted((r.k, r.v or "") for r in files.inserted(have, new, ["k", "v"]).collect()) == [(1, "a"), (2, ""), (3, "c")]
    assert sorted((r.k, r.v or "") for r in files.replaced(have, spark.createDataFrame([(2, "z")], "k int, v string"), "k").collect()) == [(1, "a"), (2, "z")]
    version = files.write_index(spark.createDataFrame([("form", "k", "de", 1, 2)], "kind string, key string, db string, entry_id int, form_id int"), str(tmp_path / "idx"))
    assert len(version) == 40


def test_feats_glosses_and_scores(spark):
    df = spark.createDataFrame([("Case=Nom|Tense=Past|Tense=Pres|X=1", ["A  b", "a b", "c"], ["nf03", "nf01", "x"])], "f string, g array<string>, t array<string>")
    r = df.select(corpus.feats_list(F.col("f"), ["Tense", "Case", "Number"]).alias("f"), corpus.ordered_glosses(F.col("g")).alias("g"), corpus.frequency_score(F.col("t")).alias("s")).first()
    assert r.f == "pres;nom" and r.g == ["A  b", "c"] and r.s == 100.0


def test_stream_equals_batch(spark):
    from lexmill.plans import analytics, transfer

    d = "/root/testdata/sf0.001"
    batch = {(r.event_id, r.admitted) for r in analytics.b03_limited(spark, d).collect()}
    assert {(r.event_id, r.admitted) for r in transfer.str_limited(spark, d).collect()} == batch
