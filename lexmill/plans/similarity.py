"""Vector and grouping queries, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lexmill.operators import audit, vectors
from lexmill.operators.ordering import top_per_group
from lexmill.sources import load


def _tags(spark, d):
    return vectors.bounded(vectors.centroids(load(spark, d, "embeddings"), "label", "embedding")).sort_values("label").reset_index(drop=True)


def o02_top_similar(spark, d):
    """The five nearest rows of every vector whose id is divisible by 50."""
    rows = load(spark, d, "embeddings")
    return vectors.top_similar(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", 5).withColumn("cosine", F.round("cosine", 6))


def v01_centroids(spark, d):
    c = vectors.centroids(load(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", "n", F.posexplode("centroid").alias("k", "x")).select("label", "n", "k", F.round("x", 6).alias("x"))


def v02_tag_cosines(spark, d):
    """Cosine of every pair of label centres, a bounded table, in blocks."""
    return vectors.near_centres(spark, _tags(spark, d), "label").where("a < b").select("a", "b", F.round("w", 5).alias("cosine"))


def v03_mutual_knn(spark, d):
    return vectors.mutual(vectors.near_centres(spark, _tags(spark, d), "label", 3)).withColumn("w", F.round("w", 6))


def j16_similar_pairs(spark, d):
    """Pairs of label centres from a similarity on."""
    return vectors.near_centres(spark, _tags(spark, d), "label", None, 0.05).where("a < b").select("a", "b", F.round("w", 6).alias("w"))


def j17_mutual_nearest(spark, d):
    """Label centres that are each other's nearest."""
    return vectors.mutual(vectors.near_centres(spark, _tags(spark, d), "label", 1)).withColumn("w", F.round("w", 6))


def v04_communities(spark, d):
    t = _tags(spark, d)
    place = {int(x): k for k, x in enumerate(t["label"])}
    edges = vectors.mutual(vectors.near_centres(spark, t, "label", 4)).orderBy("a", "b").collect()
    own = vectors.communities(len(t), [(place[e.a], place[e.b], e.w) for e in edges])
    return spark.createDataFrame([(int(x), int(c)) for x, c in zip(t["label"], own)], "label int, community int")


def v07_assigned(spark, d):
    rows = load(spark, d, "embeddings")
    return vectors.assign(rows, _tags(spark, d), "vec_id", "embedding", "label")


def v07_gated(spark, d):
    return vectors.gated(v07_assigned(spark, d)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("cosine"), 5).alias("least"))


def v05_metrics(spark, d):
    """How good the labels are as a partition of the vectors."""
    m = vectors.metrics(load(spark, d, "embeddings"), _tags(spark, d), "vec_id", "embedding", "label")
    return m.select("n_groups", "n_singles", *(F.round(c, 6).alias(c) for c in ("largest_pct", "coherence", "margin", "p10_margin")))


def _grouped(spark, d):
    t = vectors.bounded(vectors.centroids(load(spark, d, "embeddings"), "label", "embedding"), vectors.MOST_GROUPED).sort_values("label").reset_index(drop=True)
    return t, np.stack(t["centroid"]), t["n"].to_numpy()


def _told(spark, rows):
    """Metrics as a table, rounded."""
    kind = lambda x: "string" if isinstance(x, str) else "bigint" if isinstance(x, int) else "double"
    table = [tuple(round(float(x), 6) if kind(x) == "double" else x for x in r.values()) for r in rows]
    return spark.createDataFrame(table, ", ".join(f"{n} {kind(x)}" for n, x in rows[0].items())) if rows else spark.createDataFrame([], "score double")


def v06_grid(spark, d):
    """Communities of the label centres over a grid of parameters."""
    _, m, n = _grouped(spark, d)
    return _told(spark, vectors.grid(m, n, [2, 3, 4], [-1.0, 0.0], [0.8, 1.0, 1.2]))


def _labelled(spark, t, own):
    return spark.createDataFrame([(int(x), int(g)) for x, g in zip(t["label"], own)], "label int, grp int")


def v10_gated_groups(spark, d):
    t, m, n = _grouped(spark, d)
    return _labelled(spark, t, vectors.gated_groups(m, n, 0.2, 0.4))


def v11_snowball(spark, d):
    """Both ways of rolling labels into groups."""
    t, m, n = _grouped(spark, d)
    pairwise, by_centre = (vectors.snowball_groups(m, n, 0.1, x) for x in (False, True))
    return spark.createDataFrame([(int(x), int(p), int(c)) for x, p, c in zip(t["label"], pairwise, by_centre)], "label int, pairwise int, by_centre int")


def v13_balanced(spark, d):
    t, m, _ = _grouped(spark, d)
    return _labelled(spark, t, vectors.balanced_groups(m, 4))


def v16_adjacency(spark, d):
    return vectors.adjacency(vectors.near_centres(spark, _tags(spark, d), "label", 3, 0.03)).withColumn("w", F.round("w", 6))


def v19_names(spark, d):
    """Of the vectors of each label the one to name it by, with support by its id."""
    rows = load(spark, d, "embeddings").where("label is not null and embedding is not null")
    support = rows.select(F.col("label").alias("grp"), F.col("vec_id").alias("word"), (F.col("vec_id") % 5 + 1).alias("n"))
    centres = vectors.centroids(rows, "label", "embedding").select(F.col("label").alias("grp"), "centroid")
    return vectors.named(support, centres, rows.select(F.col("vec_id").alias("word"), F.col("embedding").alias("v"))).select("grp", "word", F.round("score", 6).alias("score"))


def v20_sweep(spark, d):
    """All grouping methods over thresholds and sizes."""
    _, m, n = _grouped(spark, d)
    return _told(spark, vectors.sweep(m, n, [0.1, 0.3, 0.5, 0.7, 0.9], [3, 5]))


def v08_seed_groups(spark, d):
    t = _tags(spark, d)
    own = vectors.seed_groups(np.stack(t["centroid"]), t["n"].to_numpy(), 0.5)
    return spark.createDataFrame([(int(x), int(g)) for x, g in zip(t["label"], own)], "label int, grp int")


def v09_merged_groups(spark, d):
    t, m, n = _grouped(spark, d)
    own = vectors.merge_groups(m, n, 0.3)
    return spark.createDataFrame([(int(x), int(g)) for x, g in zip(t["label"], own)], "label int, grp int")


def v12_kmeans(spark, d):
    return vectors.kmeans(load(spark, d, "embeddings"), "embedding", 10, [1, 2, 3]).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def v14_tfidf(spark, d):
    words = load(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.filter(F.split(F.regexp_replace(F.lower("text"), "[^\\p{L}]+", " "), " "), lambda w: F.length(w) > 3)).alias("term"))
    return vectors.tfidf(words, "doc_id", "term", 3, 10).select("doc_id", "place", "term", "score")


def v14_ngram_cosines(spark, d):
    """Cosines of audit tags over the word 1- to 3-grams of their labels and examples; pairs that share none are 0 and left out."""
    rows = load(spark, d, "form_tags_flat").where("trim(form_tag) <> ''").select(F.lower(F.trim("form_tag")).alias("tag"), "form_tag", F.coalesce("sample_examples", F.lit("")).alias("ex"))
    texts = rows.select("tag", F.explode(F.concat(F.array("form_tag"), F.split("ex", " \\| "))).alias("text"))
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^\\p{L}]+", " "), " "), lambda w: F.length(w) > 1)
    grams = texts.select("tag", F.explode(audit.ngrams(words, 1, 3)).alias("gram"))
    return vectors.feature_cosines(vectors.ngram_features(grams, "tag"), "tag")


def _tag_bags(spark, d):
    return load(spark, d, "form_tags_flat").where("form_tag <> '' and db is not null").groupBy("db", "form_tag").agg(F.sum(F.coalesce("occurrence_count", F.lit(0))).alias("n"))


def v15_jaccard_pairs(spark, d):
    """Weighted Jaccard of the tag bags of every pair of dictionaries."""
    return vectors.weighted_jaccard_all(_tag_bags(spark, d), "db", "form_tag", "n")


def v15_jaccard(spark, d):
    """Adjacent-pairs report: only the dictionaries that are neighbours in name order; ``v15_jaccard_pairs`` has all."""
    bags = _tag_bags(spark, d)
    names = sorted(vectors.bounded(bags.select("db").distinct())["db"])
    pairs = spark.createDataFrame(list(zip(names, names[1:])), "a string, b string")
    return vectors.weighted_jaccard(bags, "db", "form_tag", "n", pairs)


def v17_cooccurrence(spark, d):
    rows = load(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split(F.lower(F.regexp_replace("text", "\\n", " ")), " ")).alias("pos", "word")).where("word <> ''")
    pairs = vectors.cooccurrence(rows, 3, 3)
    return top_per_group(pairs, ["a"], [F.desc("dice"), "b"], 5).select("a", "place", "b", "n", "dice")


def v18_lexicon(spark, d):
    """Each row with the label whose centre is its translation by CSLS, after the rotation fitted on rows and their centres."""
    rows = load(spark, d, "embeddings")
    pairs = rows.where("embedding is not null").join(vectors.centroids(rows, "label", "embedding").select("label", "centroid"), "label")
    return vectors.csls(rows, _tags(spark, d), vectors.procrustes(pairs, "embedding", "centroid"), "vec_id", "embedding", "label").select(F.col("id").alias("vec_id"), "label", F.round("csls", 6).alias("csls"))


def v18_learned(spark, d):
    """The same after the rotation has learned from its own pairs."""
    rows = load(spark, d, "embeddings")
    pairs = rows.where("embedding is not null").join(vectors.centroids(rows, "label", "embedding").select("label", "centroid"), "label")
    own, _ = vectors.self_learned(rows, _tags(spark, d), vectors.procrustes(pairs, "embedding", "centroid"), "vec_id", "embedding", "label")
    return own.select(F.col("id").alias("vec_id"), "label", F.round("csls", 6).alias("csls"))


def u05_families(spark, d):
    """Entries joined through an equal headword or lemma of their dictionary: entry id and family."""
    entries = load(spark, d, "entries")
    names = entries.select("id", F.explode(F.array_distinct(F.array(F.concat_ws("\x01", "db", "headword"), F.concat_ws("\x01", "db", "lemma")))).alias("k"), "headword", "lemma").where("k not like '%\x01'")
    hub = names.groupBy("k").agg(F.min("id").alias("hub"))
    edges = names.join(hub, "k").select(F.col("id").alias("src"), F.col("hub").alias("dst"))
    return vectors.components(edges).select(F.col("node").alias("id"), F.col("component").alias("family"))


QUERIES = {f.__name__: f for f in (o02_top_similar, v01_centroids, v02_tag_cosines, v03_mutual_knn, j16_similar_pairs, j17_mutual_nearest, v04_communities, v05_metrics, v06_grid, v10_gated_groups, v11_snowball, v13_balanced, v16_adjacency, v19_names, v20_sweep, v07_assigned, v07_gated, v08_seed_groups, v09_merged_groups, v12_kmeans, v14_tfidf, v14_ngram_cosines, v15_jaccard, v15_jaccard_pairs, v17_cooccurrence, v18_lexicon, v18_learned, u05_families)}

_UNIT = """
with u as (select vec_id, label, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: cast(y as double) * y)))) as v from embeddings),
p as (select label, unnest(v) as x, unnest(range(len(v))) as k from u),
c as (select label, k, avg(x) as x, count(*) as n from p group by 1, 2),
l as (select label, any_value(n) as n, list(x order by k) as v from c group by 1)
"""

_NEAR = _UNIT + """, s as (select a.label as a, b.label as b, round(list_cosine_similarity(a.v, b.v), 12) as w from l a join l b on a.label <> b.label),
        r as (select *, row_number() over (partition by a order by w desc, b) as k from s)"""
_NEAREST = _UNIT + """, s as (select vec_id as id, l.label, round(list_cosine_similarity(u.v, l.v), 9) as cosine from u, l),
        a as (select id, label, cosine from (select *, row_number() over (partition by id order by cosine desc, label) as k from s) where k = 1)"""

SQL = {
    "v08_seed_groups": _UNIT + """, o as (select label, v, row_number() over (order by n desc, label) as k from l),
        m as (select list(r order by k) as m from (select a.k, list(list_cosine_similarity(a.v, b.v) order by b.k) as r from o a, o b group by a.k))
        select o.label, g.own[o.k] - 1 as grp from o, (
          with recursive s as (select 1 as k, [1] as seeds, [1] as own union all
            select k + 1, case when hit is null then list_append(seeds, k + 1) else seeds end, list_append(own, coalesce(list_position(seeds, hit), len(seeds) + 1))
            from (select s.*, list_filter(seeds, lambda x: m.m[k + 1][x] >= 0.5)[1] as hit from s, m where k < len(m.m)))
          select own from s order by k desc limit 1) g""",
    "j16_similar_pairs": _NEAR + " select a, b, round(w, 6) as w from s where a < b and w >= 0.05",
    "j17_mutual_nearest": _NEAR + " select x.a, x.b, round(x.w, 6) as w from r x join r y on x.a = y.b and x.b = y.a where x.k = 1 and y.k = 1 and x.a < x.b",
    "v05_metrics": _UNIT + """, s as (select u.vec_id, u.label, l.label as other, list_cosine_similarity(u.v, l.v) as c from u, l),
        m as (select vec_id, label, max(c) filter (where other = label) as own, max(c) filter (where other = label) - max(c) filter (where other <> label) as margin from s where label is not null group by 1, 2),
        g as (select label, count(*) as n from m group by 1)
        select (select count(*) from g) as n_groups, (select count(*) from g where n = 1) as n_singles, round((select 100.0 * max(n) / sum(n) from g), 6) as largest_pct, round(avg(own), 6) as coherence, round(avg(margin), 6) as margin, round(quantile_cont(margin, 0.1), 6) as p10_margin from m""",
    "v16_adjacency": _NEAR + """, e as (select a, b, w from r where k <= 3 and w >= 0.03) select a, b, round(max(w * w), 6) as w from (select a, b, w from e union all select b, a, w from e) group by 1, 2""",
    "v19_names": _UNIT + """, s as (select u.label as grp, u.vec_id as word, round(list_cosine_similarity(u.v, l.v) + 0.035 * ln(1 + u.vec_id % 5 + 1), 9) as score, u.vec_id % 5 + 1 as n from u join l using (label))
        select grp, word, round(score, 6) as score from (select *, row_number() over (partition by grp order by score desc, n desc, word desc) as k from s) where k = 1""",
    "v03_mutual_knn": _NEAR + " select x.a, x.b, round(x.w, 6) as w from r x join r y on x.a = y.b and x.b = y.a where x.k <= 3 and y.k <= 3 and x.a < x.b",
    "v07_assigned": _NEAREST + " select id, label, cosine from a",
    "v07_gated": _NEAREST + ", g as (select label, greatest(0.45, quantile_cont(cosine, 0.05)) as least from a group by 1) select label, count(*) as n, round(min(cosine), 5) as least from a join g using (label) where cosine >= g.least group by 1",
    "u05_families": """
        with recursive n as (select id, unnest(list_distinct(list_filter([case when headword <> '' then coalesce(db || chr(1), '') || headword end, case when lemma <> '' then coalesce(db || chr(1), '') || lemma end], lambda k: k is not null))) as k from entries),
        h as (select k, min(id) as hub from n group by k), e as (select id as a, hub as b from n join h using (k) union select hub, id from n join h using (k)),
        c(id, family) as (select distinct a, a from e union select e.b, c.family from c join e on e.a = c.id where c.family < e.b)
        select id, min(family) as family from c group by id""",
    "o02_top_similar": """
        with e as (select vec_id, cast(embedding as double[]) as v from embeddings),
        s as (select q.vec_id as query_id, r.vec_id as neighbour_id, round(list_cosine_similarity(q.v, r.v), 9) as c from e q join e r on q.vec_id % 50 = 0 and r.vec_id <> q.vec_id),
        k as (select *, row_number() over (partition by query_id order by c desc, neighbour_id) as place from s)
        select query_id, cast(place as integer) as place, neighbour_id, round(c, 6) as cosine from k where place <= 5""",
    "v01_centroids": _UNIT + "select label, n, cast(k as integer) as k, round(x, 6) as x from c",
    "v02_tag_cosines": _UNIT + "select a.label as a, b.label as b, round(list_cosine_similarity(a.v, b.v), 5) as cosine from l a join l b on a.label < b.label",
    "v14_tfidf": r"""
        with w as (select doc_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g'), ' '), lambda x: length(x) > 3)) as term from documents where text is not null),
        t as (select doc_id, term, count(*) as tf from w group by 1, 2), f as (select term, count(*) as df from t group by 1 having count(*) >= 3),
        s as (select doc_id, term, round((1 + ln(tf)) * (ln((1 + (select count(distinct doc_id) from w)) / (1 + df)) + 1), 6) as score from t join f using (term)),
        r as (select *, row_number() over (partition by doc_id order by score desc, term) as place from s)
        select doc_id, cast(place as integer) as place, term, score from r where place <= 10""",
    "v14_ngram_cosines": r"""
        with f as (select row_number() over () as r, lower(trim(form_tag)) as tag, form_tag, coalesce(sample_examples, '') as ex from form_tags_flat where trim(form_tag) <> ''),
        x as (select r, tag, unnest(list_concat([form_tag], string_split(ex, ' | '))) as text, unnest(range(len(string_split(ex, ' | ')) + 1)) as p from f),
        l as (select r, p, tag, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g'), ' '), lambda y: length(y) > 1) as l from x),
        u as (select r, p, tag, unnest(l) as w, unnest(range(len(l))) as k from l),
        v as (select tag, w, lead(w) over (partition by r, p order by k) as w2, lead(w, 2) over (partition by r, p order by k) as w3 from u),
        g as (select tag, w as gram from v union all select tag, w || ' ' || w2 from v where w2 is not null union all select tag, w || ' ' || w2 || ' ' || w3 from v where w3 is not null),
        n as (select count(distinct tag) as n from g), t as (select tag, gram, count(*) as tf from g group by 1, 2),
        d as (select gram, count(*) as df from t group by 1 having count(*) >= 2 and count(*) <= 0.3 * (select n from n)),
        s as (select tag, gram, (1 + ln(tf)) * (ln((1 + (select n from n)) / (1 + df)) + 1) as x from t join d using (gram)),
        k as (select * from (select *, row_number() over (partition by tag order by x desc, gram) as place from s) where place <= 180),
        z as (select tag, gram, x / sqrt(sum(x * x) over (partition by tag)) as x from k)
        select a.tag as a, b.tag as b, round(sum(a.x * b.x), 6) as cosine from z a join z b on a.gram = b.gram and a.tag < b.tag group by 1, 2""",
    "v15_jaccard": """
        with b as (select db, form_tag, sum(coalesce(occurrence_count, 0)) as n from form_tags_flat where form_tag <> '' and db is not null group by 1, 2),
        n as (select db as a, lead(db) over (order by db) as b from (select distinct db from b)),
        z as (select db, sum(n) as size from b group by 1),
        s as (select n.a, n.b, sum(least(x.n, y.n)) as shared from n join b x on x.db = n.a join b y on y.db = n.b and y.form_tag = x.form_tag group by 1, 2)
        select n.a, n.b, round(coalesce(shared, 0) / (p.size + q.size - coalesce(shared, 0)), 6) as jaccard from n join z p on p.db = n.a join z q on q.db = n.b left join s on s.a = n.a and s.b = n.b where n.b is not null""",
    "v15_jaccard_pairs": """
        with b as (select db, form_tag, sum(coalesce(occurrence_count, 0)) as n from form_tags_flat where form_tag <> '' and db is not null group by 1, 2),
        z as (select db, sum(n) as size from b group by 1),
        s as (select x.db as a, y.db as b, sum(least(x.n, y.n)) as shared from b x join b y on y.form_tag = x.form_tag and x.db < y.db group by 1, 2)
        select p.db as a, q.db as b, case when p.size + q.size > coalesce(shared, 0) then round(coalesce(shared, 0) / (p.size + q.size - coalesce(shared, 0)), 6) else 0 end as jaccard
        from z p join z q on p.db < q.db left join s on s.a = p.db and s.b = q.db""",
    "v17_cooccurrence": r"""
        with s as (select doc_id, string_split(lower(replace(text, chr(10), ' ')), ' ') as l from documents where text is not null),
        u as (select doc_id, unnest(l) as word, unnest(range(len(l))) as p from s), w as (select doc_id, word, row_number() over (partition by doc_id order by p) as k from u where word <> ''),
        o as (select word, count(*) as w from w group by 1),
        c as (select x.word as a, y.word as b, count(*) as n from w x join w y on x.doc_id = y.doc_id and y.k - x.k between 1 and 3 group by 1, 2 having count(*) >= 3),
        d as (select a, b, n, round(2 * n / (p.w + q.w), 6) as dice from c join o p on p.word = a join o q on q.word = b),
        r as (select *, row_number() over (partition by a order by dice desc, b) as place from d)
        select a, cast(place as integer) as place, b, n, dice from r where place <= 5""",
}
