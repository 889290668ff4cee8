"""Problems 7 to 10: term frequencies, leaked test items, mixing, subjects."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import frequency, leakage, mixing, subjects


def splitter():
    return lambda value: [t for x in value.split(";") if (t := frequency.folded(x))]


split = splitter()


def test_frequencies_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(400_000), ";".join(rng.choices(["a", "b", "Ｂ", "rare%d" % rng.randrange(50), ""], k=rng.randrange(4)))) for _ in range(3000)]
    rows += [(i, "hot") for i in range(70_000, 76_000)]
    rows = list({i: (i, v) for i, v in rows}.values()) + [(None, "a;a"), (None, "a"), (7_000_000, None)]
    df = spark.createDataFrame(rows, "id bigint, v string").repartition(5)
    got = {r.term: (r.occurrences, r.records) for r in frequency.frequencies(df, F.col("id"), "v", split).collect()}
    occurrences, records = Counter(), Counter()
    for _, v in rows:
        terms = split(v or "")
        occurrences.update(terms)
        records.update(set(terms))
    assert got == {t: (occurrences[t], records[t]) for t in occurrences}
    assert frequency.frequencies(df.limit(0), F.col("id"), "v", split).count() == 0


def test_bitmaps():
    rng = np.random.default_rng(0)
    for n in (1, 100, 5000, 60_000):
        a, b = (np.unique(rng.integers(0, 65536, n)) for _ in range(2))
        assert list(frequency.unpack(frequency.pack(a))) == list(a)
        u = frequency.union([frequency.pack(a), frequency.pack(b)])
        assert frequency.cardinality(u) == len(set(a) | set(b))


def test_marks(spark):
    counts = spark.createDataFrame([("a", 4), ("b", 5), ("c", 10), ("d", 11)], "term string, n bigint")
    got = {tuple(r) for r in frequency.marked(counts, "n", F.lit(100)).collect()}
    assert got == {("a", "rare"), ("d", "common")}


def test_search_equals_find():
    rng = random.Random(2)
    for _ in range(60):
        patterns = list({"".join(rng.choices("ab ", k=rng.randrange(5, 9))) for _ in range(8)})
        text = "".join(rng.choices("ab ", k=120))
        got = sorted(leakage.WuManber(patterns, 3).finditer(text))
        want = sorted(k for k, p in enumerate(patterns) for i in range(len(text)) if text.startswith(p, i))
        assert got == want
    assert list(leakage.WuManber([]).finditer("x")) == []


ITEM = "Read the passage and answer. " + " ".join(f"word{i}" for i in range(40))
W = ITEM.split()


def docs():
    other = " ".join(f"other{i}" for i in range(30))
    half = W[5:]
    return {
        1: other + " " + ITEM.upper().replace(" ", "\n", 5) + " " + other,
        2: other,
        3: "Read the passage and answer. " + other,
        4: " ".join(half[20:]) + " " + other + " " + " ".join(half[:15]),
        5: " ".join(w if i % 9 else "changed" for i, w in enumerate(half)),
        6: "he said " + " ".join(half[:8]) + " " + other,
        7: None,
        8: "",
        9: " ".join(w for i, w in enumerate(half) if i % 11),
        10: " ".join(half[:12]),
    }


def test_leaks_and_blocks(spark):
    rows = [(k, v, 0) for k, v in docs().items()] + [(11, docs()[1], 0)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(1, "s", ITEM), (2, "s", "too short"), (3, "s", None), (4, "s", ITEM)], "item_id bigint, suite string, text string")
    for size in (10, 200_000):
        got = {tuple(r) for r in leakage.found(d, items, size).collect()}
        assert got == {(k, i) for k in (1, 4, 5, 9, 11) for i in (1, 4)}
    assert leakage.found(d.limit(0), items).count() == 0 and leakage.found(d, items.limit(0)).count() == 0
    assert {r.item_id: r.n_docs for r in leakage.report(leakage.found(d, items), items).collect()} == {1: 5, 2: 0, 3: 0, 4: 5}


def test_many_items_are_joined_and_common_ones_scanned(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=30)) for _ in range(60)]
    d = spark.createDataFrame([(k, " ".join(rng.choices(vocabulary, k=20)) + " " + (t if k % 2 else " ".join(t.split()[:17]))) for k, t in enumerate(texts)] + [(100, ITEM)], "doc_id bigint, text string")
    items = spark.createDataFrame([*enumerate(texts), *((1000 + k, ITEM) for k in range(40))], "item_id bigint, text string")
    one, many = ({tuple(r) for r in leakage.found(d, items, size).collect()} for size in (200_000, 500))
    assert one == many and {(k, k) for k in range(60)} <= one and {(100, 1000 + k) for k in range(40)} <= one


def test_leaks_are_those_of_each_pair_for_any_number_of_items(spark):
    rng = random.Random(9)
    line = [f"stock{i}" for i in range(16)]
    own = [[f"a{k}x{i}" for i in range(24)] for k in range(50)]
    texts = [" ".join(line + w) for w in own[:10]] + [" ".join(line[:9] + w) for w in own[10:]]
    # a stock phrase and six words of the item, none of its other patterns
    rows = [(k, " ".join([*line, "y", *w[1:4], "y", *w[5:8]])) for k, w in enumerate(own[:10])] + [(k + 10, " ".join(rng.sample(line, 16) + w[: rng.randrange(8, 24)])) for k, w in enumerate(own)]
    rows += [(None, texts[3]), (None, texts[4]), (7, texts[20]), (7, texts[21])]
    items = [*enumerate(texts), (5, texts[6]), (5, texts[5])]
    want = Counter((d, i) for d, t in rows for i, x in items for _ in leakage.Items([(i, x)]).leaked(t))
    assert all(want[k, k] for k in range(10)) and want[None, 3] and want[5, 5] == 2
    frames = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for size in (10, 300, 200_000):
        assert Counter(map(tuple, leakage.found(*frames, size).collect())) == want


def test_unspaced_scripts_have_words():
    item = "春眠不覚暁処処聞啼鳥夜来風雨声花落知多少"
    assert leakage.Items([(1, item)]).leaked("前の文。" + item[:16] + "後の文。") == [1]
    assert leakage.Items([(1, item)]).leaked("前の文。" + item[:6] + "後の文。") == []


def test_long_text():
    text = " ".join(f"x{i % 977}" for i in range(60_000)) + " " + ITEM
    assert leakage.Items([(1, ITEM)]).leaked(text) == [1]


def mix_frames(spark):
    rng = random.Random(3)
    rows = [(i, "big" if i % 3 else "small", "word " * rng.randrange(1, 30)) for i in range(600)] + [(900, "Big", "word"), (901, None, "word"), (902, "big", None), (903, "big", "")]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2), ("none", 0.1, 5)], "source string, target_share double, max_repeats bigint")
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string"), targets


def test_mix(spark):
    d, targets = mix_frames(spark)
    sizes = mixing.sized(d, targets).cache()
    plan = {r.source: r for r in mixing.demands(sizes, targets).collect()}
    total = plan["big"].total
    assert plan["none"].short and plan["none"].size == 0 and {r.source for r in mixing.short_sources(d, targets).collect()} == {s for s, r in plan.items() if r.max_repeats * r.size < r.target_share * total}
    placed = mixing.placed(sizes, targets).collect()
    assert [r.position for r in placed] == sorted(r.position for r in placed) and all(0 <= r.position <= 1 for r in placed)
    per = Counter()
    seen = Counter()
    for r in placed:
        per[r.source] += r.n_tokens
        seen[r.source, r.doc_id] += 1
    for s in ("big", "small"):
        assert abs(per[s] - plan[s].demand) <= 40
        assert max(n for (x, _), n in seen.items() if x == s) <= plan[s].max_repeats
    shares = {r.source: r.actual_share for r in mixing.shares(sizes, targets).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares["none"] == 0
    # the schedule bends the order but keeps weights at one: halves hold about half of all
    half = sum(r.n_tokens for r in placed if r.position <= 0.5) / sum(r.n_tokens for r in placed)
    assert 0.4 < half < 0.6
    assert mixing.placed(sizes.limit(0), targets).count() == 0 and mixing.short_sources(d.limit(0), targets).count() == 0


def test_schedule(spark):
    d, targets = mix_frames(spark)
    sizes = mixing.sized(d, targets).cache()
    plan = mixing.slopes(mixing.demands(sizes, targets)).where("demand > 0").collect()
    assert abs(sum(r.slope * r.demand for r in plan)) < 1e-6 and all(abs(r.slope) <= mixing.SLOPE for r in plan)
    for source in ("big", "small"):
        own = [(r.repeat, r.position) for r in mixing.placed(sizes, targets).where(F.col("source") == source).collect()]
        assert own == sorted(own)
    # exactly enough is not short; the rows come from the placed mix
    exact = spark.createDataFrame([(1, "a", "word " * 10), (2, "b", "word " * 10)], "doc_id bigint, source string, text string")
    wanted = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1), ("c", 0.0, 1)], "source string, target_share double, max_repeats bigint")
    assert mixing.short_sources(exact, wanted).count() == 0
    more = spark.createDataFrame([("a", 0.4, 1), ("b", 0.6, 1), (None, 0.1, None)], "source string, target_share double, max_repeats bigint")
    assert [r.source for r in mixing.short_sources(exact, more).collect()] == ["b"]


TOPICS = {"sport": "goal referee league striker match penalty stadium coach", "law": "judge verdict statute witness appeal lease court plaintiff", "music": "violin chord tempo sonata choir flute melody rhythm"}


def sentence(rng, topic):
    words = TOPICS[topic].split()
    return f"The {rng.choice(words)} of N{rng.randrange(10**6)} met a {rng.choice(['pale', 'swift', 'damp'])} {rng.choice(words)}."


def test_subjects(spark):
    rng = random.Random(4)
    seeds = [(i, " ".join(sentence(rng, t) for _ in range(4)), t) for i, t in enumerate(list(TOPICS) * 15)]
    rows, want = [], set()
    for i in range(300):
        chosen = rng.sample(list(TOPICS), rng.choice([1, 1, 2]))
        paragraphs = [" ".join(sentence(rng, t) for _ in range(4)) for t in chosen]
        if i % 4 == 0:
            paragraphs[0] += " " + sentence(rng, rng.choice(list(TOPICS)))
        rows.append((i, "\n\n".join(paragraphs)))
        want |= {(i, t) for t in chosen}
    rows += [(900, None), (901, ""), (902, "The reader may look up a word.")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    s = spark.createDataFrame(seeds, "seed_id bigint, text string, subject string")
    got = {tuple(r) for r in subjects.found(d, s).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(want)
    listed = spark.createDataFrame([("sport",), ("law",), ("music",), ("other",)], "subject string")
    made = {r.subject: r.n_docs for r in subjects.make_up(d, s, listed).collect()}
    assert made["other"] == 0 and made["law"] == sum(t == "law" for _, t in got)
    assert subjects.found(d.limit(0), s).count() == 0 and subjects.found(d, s.limit(0)).count() == 0
    # the rows come from the leaf mixtures: without them there are none, with those of other leaves they change
    assert subjects.assigned(d, s, lambda mixed: [{} for _ in mixed]).count() == 0
    turned = {"sport": "law", "law": "music", "music": "sport"}
    other = {(r.doc_id, r.subject) for r in subjects.assigned(d, s, lambda mixed: [{turned[k]: p for k, p in m.items()} for m in mixed]).collect()}
    assert len(other & want) < 0.1 * len(want)


def test_subjects_are_fitted_on_all_paragraphs_wherever_they_lie(spark, monkeypatch):
    rng = random.Random(6)
    seeds = spark.createDataFrame([(i, " ".join(sentence(rng, t) for _ in range(4)), t) for i, t in enumerate(list(TOPICS) * 15)], "seed_id bigint, text string, subject string")
    d = spark.createDataFrame([(i, "\n".join(sentence(rng, t) + " " + sentence(rng, t) for t in rng.choices(list(TOPICS), k=21))) for i in range(1000)], "doc_id bigint, text string")
    fits, learn = [], subjects.Lexicon.learn

    def learned(self, by_leaf):
        got = learn(self, by_leaf)
        fits.append((by_leaf, got))
        return got

    monkeypatch.setattr(subjects.Lexicon, "learn", learned)
    near = subjects.assigned(d, seeds).collect()
    whole = {t: n for leaf in fits[0][0] for t, n in leaf.items()}
    parts = [set(p.lower().replace(".", "").split()) for r in d.collect() for p in r.text.split("\n")]
    assert whole["goal"] and all(n == sum(t in p for p in parts) for t, n in whole.items() if t in " ".join(TOPICS.values()).split())
    monkeypatch.setattr(subjects, "NEAR", -1)
    far = subjects.assigned(d.repartition(3), seeds).collect()
    assert fits[:2] == fits[2:] and sorted(near) == sorted(far)


def test_tree_parts_rows_and_sends_new_rows_to_their_leaf():
    rng = random.Random(2)
    terms = [[f"{g}{rng.randrange(6)}" for _ in range(5)] for k in range(400) for g in ["abcd"[k % 4]]]
    weights = {t: (j, 1.0) for j, t in enumerate(sorted({t for x in terms for t in x}))}
    rows = subjects.Rows(terms, weights)
    tree, members = subjects.grown(rows, len(weights), lambda own: max(Counter(k % 4 for k in own).values()) / len(own))
    assert sorted(k for some in members for k in some) == list(range(400))
    at = tree.leaves(rows)
    assert all(set(at[some]) == {leaf} for leaf, some in enumerate(members)) and all(len({k % 4 for k in some}) == 1 for some in members)
    assert list(tree.leaves(subjects.Rows([["zzz"], terms[3]], weights))) == [-1, at[3]]


def test_the_leaf_mixture_carries_the_decision():
    lexicon = subjects.Lexicon([("x", "law"), ("x", "linguistics")])
    lexicon.of = {"case": {"linguistics": 0.6, "law": 0.4}}
    assert lexicon.subject([["case"]] * 6, {"law": 0.95, "linguistics": 0.05}) == ("law", 6)
    assert lexicon.subject([["case"]] * 6, {"law": 0.5, "linguistics": 0.5}) == ("linguistics", 6)
    assert lexicon.subject([["case"]] * 6, {"law": 0.97, "linguistics": 0.03}) == ("law", 6) and lexicon.subject([["case"]] * 6, {}) is None


def test_wrapped_lines_are_one_paragraph(spark):
    texts = [(1, "One is here. Two goes\non. Three\r\nends.\nFour stands alone.\n \nFive."), (2, "A line\nanother line")]
    got = sorted((r.doc_id, r.paragraph) for r in subjects.paragraphs(spark.createDataFrame(texts, "doc_id bigint, text string")).collect())
    assert got == [(1, "Five."), (1, "Four stands alone."), (1, "One is here. Two goes on. Three ends."), (2, "A line"), (2, "another line")]


def test_short_paragraphs_need_two_votes():
    assert [subjects.least_votes(n) for n in (1, 2, 3, 4, 5, 12)] == [2, 2, 2, 2, 3, 3]


@pytest.mark.parametrize("text", ["plain words", "ünï ☃ code"])
def test_tokenizer_round_trip(text):
    enc = mixing.encoder(mixing.TOKENIZER)
    assert enc.decode(enc.encode_ordinary(text)) == text
