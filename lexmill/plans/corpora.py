"""Corpus, alignment and evaluation queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators import alignment, annotations, corpus
from lexmill.operators.ordering import ranked, running
from lexmill.plans import sqltext
from lexmill.sources import load, spread


def _docs(spark, d) -> DataFrame:
    return spread(load(spark, d, "documents").where("text is not null"))


def _words(spark, d) -> DataFrame:
    """doc_id, pos, word, is_name: blank-separated words; a name starts with a capital inside a sentence."""
    rows = _docs(spark, d).select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\\n", " "), " ")).alias("pos", "word")).where("word <> ''")
    return rows.withColumn("is_name", F.col("word").rlike("^[A-Z][a-z]+"))


def x16_sentences(spark, d):
    spans = _docs(spark, d).select("doc_id", F.posexplode(corpus.spans_of(F.col("text"), F.col("lang"))).alias("sent", "s"))
    return spans.select("doc_id", "sent", "s.start", "s.end")


def x17_tokens(spark, d):
    tokens = _docs(spark, d).select("doc_id", F.size(corpus.tokens_of(F.col("text"))).alias("n_tokens"))
    return tokens


def x18_search(spark, d):
    """Non-overlapping, case-folded occurrences of every subject's name in every document."""
    phrases = load(spark, d, "subjects").select(F.col("subject").alias("phrase"))
    return corpus.occurrences(_docs(spark, d).select("doc_id", "text"), "text", phrases).select("doc_id", "phrase", "n")


def x22_hashes(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("sha256"), F.sha1("text").alias("sha1"))


def x25_truncated(spark, d):
    return _docs(spark, d).select("doc_id", F.substring("text", 1, 400).alias("head"))


def w09_bio(spark, d):
    w = Window.partitionBy("doc_id").orderBy("pos")
    before = F.coalesce(F.lag("is_name").over(w), F.lit(False))
    return _words(spark, d).select("doc_id", "pos", F.when(~F.col("is_name"), "O").when(before, "I-NAME").otherwise("B-NAME").alias("tag"))


def w11_spans(spark, d):
    """Runs of name words: doc_id, first and last position, text."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    seq = _words(spark, d).withColumn("k", F.row_number().over(w)).where("is_name")
    island = seq.withColumn("g", F.col("k") - F.row_number().over(w))
    return island.groupBy("doc_id", "g").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("n_words")).drop("g")


def w08_packed(spark, d):
    """Sentences of each document packed into paragraphs of up to 300 characters."""
    sizes = F.transform(F.split("text", "(?<=[.!?])\\s+"), lambda s: F.length(s))
    groups = _docs(spark, d).select("doc_id", F.explode(corpus.packed(sizes, 300)).alias("g")).groupBy("doc_id", "g").agg(F.count(F.lit(1)).alias("n_sentences"))
    return groups.select("doc_id", F.col("g").alias("paragraph"), "n_sentences")


def w14_global_tokens(spark, d):
    """First and last place of each document's words in the corpus order by document and position."""
    n = _words(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return running(n, [], [F.asc("doc_id")], "n", "upto").select("doc_id", (F.col("upto") - F.col("n")).alias("first"), (F.col("upto") - 1).alias("last"))


def j13_overlap(spark, d):
    """Tokens labelled by the quoted span that covers most of them: quotes of two kinds, and bracketed text."""
    parts = _docs(spark, d).select("doc_id", corpus.tokens_of(F.col("text")).alias("tokens"), corpus.matches_of(F.col("text"), corpus.QUOTES).alias("spans"))
    labels = parts.select("doc_id", corpus.overlap_labels(F.col("tokens"), F.col("spans")).alias("l"))
    return labels.select("doc_id", F.explode("l").alias("label")).where("label is not null").groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n_tokens"))


def j14_label_map(spark, d):
    """Source spellings mapped by their exact name, else by their folded one, else by its first word, else as other."""
    targets = load(spark, d, "mix_targets").select(F.col("source").alias("label"))
    first = F.regexp_extract(F.lower("label"), "^([a-z]+)", 1)
    coarse = targets.select(first.alias("label")).groupBy("label").agg(F.concat(F.lit("coarse:"), F.first("label")).alias("target"))
    other = spark.createDataFrame([("", "other")], "label string, target string")
    levels = [(targets.withColumn("target", F.concat(F.lit("exact:"), "label")), F.col("label")), (targets.withColumn("target", F.concat(F.lit("folded:"), "label")), F.lower(F.trim("label"))), (coarse, F.regexp_extract(F.lower(F.trim("label")), "^([a-z]+)", 1)), (other, F.when(F.col("label").isNotNull(), F.lit("")))]
    mapped = corpus.label_map(load(spark, d, "documents").select("doc_id", F.col("source").alias("label")), levels)
    return mapped.groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def o05_allocation(spark, d):
    sizes = load(spark, d, "documents").where("work_id is not null").groupBy("work_id").agg(F.count(F.lit(1)).alias("n"))
    return corpus.allocation(sizes, "work_id", "n", 500)


def o06_split(spark, d):
    return corpus.hash_split(load(spark, d, "documents").select("doc_id"), "doc_id", 0.8, 0.1)


def o07_crc_split(spark, d):
    return load(spark, d, "documents").select("doc_id", corpus.crc_split(F.coalesce("work_id", F.lit(""))).alias("part"))


def o08_every_tenth(spark, d):
    placed = ranked(load(spark, d, "documents").where("work_id is not null").select("doc_id", "work_id"), ["work_id"], [F.asc("doc_id")])
    return placed.select("doc_id", "work_id", (F.col("place") % 10 == 0).alias("dev"))


def o09_place_split(spark, d):
    """Documents split by their place in the order of ids."""
    return corpus.split_by_place(load(spark, d, "documents").select("doc_id"), "doc_id", 0.8, 0.1)


def o01_most_common(spark, d):
    """The hundred most common words; ties by spelling."""
    return _words(spark, d).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(100)


def j15_label_use(spark, d):
    """Languages of documents by their raw spelling, else by their folded one, with the label that was used."""
    known = load(spark, d, "subject_seed").where("lang is not null").groupBy(F.col("lang").alias("label")).agg(F.count(F.lit(1)).alias("n_seeds"))
    names = known.withColumn("target", F.col("label")).drop("n_seeds")
    mapped = corpus.label_map(load(spark, d, "documents").select("doc_id", F.col("lang").alias("label")), [(names, F.col("label")), (names, F.lower(F.trim("label")))])
    return mapped.groupBy("label", "target").agg(F.count(F.lit(1)).alias("n"))


def w10_repaired(spark, d):
    """Tags that all claim to go on, with the first of each run mended."""
    rows = w09_bio(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.regexp_replace("tag", "^B-", "I-").alias("tag")))).alias("t"))
    fixed = rows.select("doc_id", F.posexplode(corpus.repaired(F.transform("t", lambda x: x.tag))).alias("k", "tag"))
    return fixed.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def w12_span_texts(spark, d):
    """Texts of the runs of name words, with their first place among the document's words."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    seq = _words(spark, d).withColumn("k", F.row_number().over(w)).where("is_name").withColumn("g", F.col("k") - F.row_number().over(w))
    runs = seq.groupBy("doc_id", "g").agg(F.min("k").alias("k"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("t"))
    return runs.select("doc_id", F.lit("NAME").alias("type"), (F.col("k") - 1).alias("start"), F.array_join(F.transform("t", lambda x: x.word), " ").alias("text"))


def o10_group_split(spark, d):
    return corpus.group_split(load(spark, d, "documents").select("work_id"), "work_id", 0.1)


def o11_diverse(spark, d):
    rows = load(spark, d, "subject_seed").select("seed_id", "subject", "lang")
    return corpus.diverse(rows, "subject", "lang", "seed_id", 10).select("subject", "lang", "seed_id", "place")


def j18_shared_texts(spark, d):
    """Sentences of held-out texts that stand in documents too, by the hash of their words; sentences of under four words are left out."""

    def keyed(df, name):
        sentences = df.where("text is not null").select(name, F.explode(F.split("text", "[.!?\\n]+")).alias("s"))
        plain = F.trim(F.lower(F.regexp_replace("s", "[^\\p{L}\\p{N}]+", " ")))
        return sentences.select(name, plain.alias("plain")).where(F.size(F.split("plain", " ")) >= 4).select(name, F.sha2("plain", 256).alias("k")).distinct()

    items, docs = keyed(load(spark, d, "heldout_items"), "item_id"), keyed(_docs(spark, d), "doc_id").select("k").distinct()
    return items.join(docs, "k", "left_semi").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_shared"))


def u02_shared_surfaces(spark, d):
    forms, stage = load(spark, d, "forms"), load(spark, d, "forms_stage")
    return forms.where("form_text is not null").select("form_text").intersect(stage.where("form_text is not null").select("form_text"))


def u04_label_union(spark, d):
    a = load(spark, d, "subject_seed").groupBy("subject").agg(F.count(F.lit(1)).alias("n_seeds"))
    b = load(spark, d, "subjects").select("subject", F.lit(1).alias("listed"))
    return a.join(b, "subject", "full").select("subject", F.coalesce("n_seeds", F.lit(0)).alias("n_seeds"), F.coalesce("listed", F.lit(0)).alias("listed"))


def e01_scores(spark, d):
    """Names and numbers found by shape, scored against those inside sentences."""
    rows = annotations.tokens(_docs(spark, d))
    shape = F.when(F.col("word").rlike("^[0-9]+[.,]?$"), "NUM").when(F.col("word").rlike("^[A-Z][a-z]+"), "NAME")
    pred = rows.withColumn("label", shape).where("label is not null")
    gold = pred.where("id > 1 or label = 'NUM'").unionByName(rows.where("word rlike '^[0-9]+[.]?$'").withColumn("label", F.lit("NUM")))
    return corpus.span_scores(gold, pred, ["doc_id", "start", "stop"], "label")


def e02_agreement(spark, d):
    """How far two tokenisations of each document agree."""
    words = F.filter(F.split("text", "\\s+"), lambda w: w != "")
    regexed = F.regexp_extract_all("text", F.lit("(\\w+|[^\\w\\s])"), F.lit(1))
    scored = _docs(spark, d).where("length(text) > 0").select("doc_id", alignment.agreement_column(words, regexed).alias("a"))
    return scored.select("doc_id", "a.same", "a.diff", "a.total", "a.same_percent")


def t08_alignment(spark, d):
    """How headwords align with their surfaces, over the distinct pairs."""
    heads = load(spark, d, "entries").select(F.col("id").alias("entry_id"), "headword")
    pairs = load(spark, d, "forms").where("form_text <> ''").select("entry_id", "form_text").distinct().join(heads.where("headword <> ''"), "entry_id").select("headword", "form_text").distinct()
    return pairs.select("headword", "form_text", alignment.align_column(F.col("headword"), F.col("form_text")).alias("a")).select("headword", "form_text", "a.matched", "a.edits", F.array_join(F.transform("a.places", lambda x: x.cast("string")), ",").alias("places"))


def t09_partition(spark, d):
    """Slices of multi-word headwords, run together, for each of their words."""
    words = F.filter(F.split("headword", "[ -]+"), lambda w: w != "")
    rows = load(spark, d, "entries").where("headword rlike '[^ -][ -]+[^ -]'").select("id", words.alias("w"), F.lower(F.regexp_replace("headword", "[ -]+", "")).alias("surface"))
    sliced = rows.select("id", F.posexplode(alignment.partition_column(F.col("w"), F.col("surface"))).alias("k", "s"))
    return sliced.select("id", "k", "s.start", "s.end")


QUERIES = {
    f.__name__: f
    for f in (x16_sentences, x17_tokens, x18_search, x22_hashes, x25_truncated, w09_bio, w11_spans, w08_packed, w14_global_tokens, j13_overlap, j14_label_map, o05_allocation, o06_split, o07_crc_split, o08_every_tenth, o09_place_split, o01_most_common, j15_label_use, w10_repaired, w12_span_texts, o10_group_split, o11_diverse, j18_shared_texts, u02_shared_surfaces, u04_label_union, e01_scores, e02_agreement, t08_alignment, t09_partition)
}

_WORDS = r"""
with s as (select doc_id, string_split(replace(text, chr(10), ' '), ' ') as l from documents where text is not null),
u as (select doc_id, unnest(l) as word, unnest(range(len(l))) as pos from s),
w as (select doc_id, cast(pos as integer) as pos, word, regexp_matches(word, '^[A-Z][a-z]+') as is_name from u where word <> '')
"""

_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

def _pieces() -> str:
    """The text in pieces that end after a sentence, by the stops of its language."""
    import re

    def pattern(stops: str) -> str:
        chars, closers = (re.sub(r"([\\\]^-])", r"\\\1", x).replace("'", "''") for x in (stops, corpus.CLOSERS))
        return f"regexp_extract_all(text, '[^{chars}]*[{chars}]+[{closers}]*|[^{chars}]+$')"

    code = f"lower(split_part({sqltext.strip('lang')}, '-', 1))"
    return f"case {code} " + " ".join(f"when '{g}' then {pattern(s)}" for g, s in corpus.STOPS.items() if g) + f" else {pattern(corpus.STOPS[''])} end"


#: CRC-32 of a string of ASCII characters, bit by bit.
_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda c: cast(ord(c) as bigint))), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end))), 4294967295)"

SQL = {
    "x16_sentences": f"""
        with p as (select doc_id, {_pieces()} as l from documents where text is not null), u as (select doc_id, unnest(l) as piece, unnest(range(len(l))) as k from p),
        o as (select doc_id, piece, k, cast(coalesce(sum(length(piece)) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as bigint) as offs from u),
        t as (select doc_id, k, offs + length(piece) - length(regexp_replace(piece, '^[{sqltext.WS}]+', '')) as start, offs + length(regexp_replace(piece, '[{sqltext.WS}]+$', '')) as stop from o where regexp_replace(piece, '[{sqltext.WS}]+', '', 'g') <> '')
        select doc_id, row_number() over (partition by doc_id order by k) - 1 as sent, start, stop as "end" from t""",
    "t09_partition": """
        with s as (select id, list_filter(regexp_split_to_array(headword, '[ -]+'), lambda w: w <> '') as l from entries where regexp_matches(headword, '[^ -][ -]+[^ -]')),
        u as (select id, unnest(range(len(l))) as k, length(unnest(l)) as n from s), e as (select id, k, n, cast(sum(n) over (partition by id order by k) as bigint) as stop from u)
        select id, k, stop - n as start, stop as "end" from e""",
    "o07_crc_split": f"""
        with k as (select doc_id, coalesce(work_id, '') as k from documents) select doc_id, cast(case when regexp_full_match(k, '[0-9]{{1,18}}') then cast(k as bigint) % 10 when k = '' then 0 else {_CRC} % 10 end as integer) as part from k""",
    "w08_packed": r"""
        with recursive l as (select doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)) as l from documents where text is not null),
        s as (select doc_id, length(unnest(l)) as n, unnest(range(len(l))) as k from l),
        c as (select doc_id, k, 0 as g, n as used from s where k = 0
          union all select s.doc_id, s.k, case when c.used + s.n <= 300 then c.g else c.g + 1 end, case when c.used + s.n <= 300 then c.used + s.n else s.n end from c join s on s.doc_id = c.doc_id and s.k = c.k + 1)
        select doc_id, g as paragraph, count(*) as n_sentences from c group by 1, 2""",
    "o09_place_split": "with r as (select doc_id, row_number() over (order by doc_id) as k, count(*) over () as n from documents) select doc_id, case when k <= floor(n * 0.8) then 'train' when k <= floor(n * 0.8) + floor(n * 0.1) then 'dev' else 'test' end as part from r",
    "o01_most_common": _WORDS + "select word, count(*) as n from w group by 1 order by n desc, word limit 100",
    "j15_label_use": "with k as (select distinct lang from subject_seed where lang is not null) select d.lang as label, coalesce(a.lang, b.lang) as target, count(*) as n from documents d left join k a on a.lang = d.lang left join k b on b.lang = lower(trim(d.lang)) where coalesce(a.lang, b.lang) is not null group by 1, 2",
    "w10_repaired": _WORDS + ", t as (select doc_id, case when not is_name then 'O' when lag(is_name, 1, false) over (partition by doc_id order by pos) then 'I-NAME' else 'B-NAME' end as tag from w) select doc_id, tag, count(*) as n from t group by 1, 2",
    "w12_span_texts": _WORDS + """
        , k as (select doc_id, pos, word, is_name, row_number() over (partition by doc_id order by pos) as k from w), g as (select doc_id, word, k, k - row_number() over (partition by doc_id order by pos) as g from k where is_name)
        select doc_id, 'NAME' as type, min(k) - 1 as start, string_agg(word, ' ' order by k) as text from g group by doc_id, g""",
    "x17_tokens": rf"select doc_id, len(regexp_extract_all(text, '{_TOKEN}')) as n_tokens from documents where text is not null",
    "j13_overlap": rf"""
        with q as (select doc_id, unnest(regexp_extract_all(text, '“[^”]*”|„[^“]*“|«[^»]*»|\([^)]*\)')) as q from documents where text is not null)
        select doc_id, case when q[1] = '(' then 'BRACKET' else 'QUOTE' end as label, sum(len(regexp_extract_all(q, '{_TOKEN}'))) as n_tokens from q group by 1, 2""",
    "x18_search": "select doc_id, subject as phrase, cast((length(lower(text)) - length(replace(lower(text), lower(subject), ''))) / length(subject) as bigint) as n from documents, subjects where text is not null and contains(lower(text), lower(subject))",
    "x22_hashes": "select doc_id, sha256(text) as sha256, sha1(text) as sha1 from documents where text is not null",
    "x25_truncated": "select doc_id, substr(text, 1, 400) as head from documents where text is not null",
    "w09_bio": _WORDS + "select doc_id, pos, case when not is_name then 'O' when lag(is_name, 1, false) over (partition by doc_id order by pos) then 'I-NAME' else 'B-NAME' end as tag from w",
    "w11_spans": _WORDS + """
        , k as (select doc_id, pos, is_name, row_number() over (partition by doc_id order by pos) as k from w),
        g as (select doc_id, pos, k - row_number() over (partition by doc_id order by pos) as g from k where is_name)
        select doc_id, min(pos) as first, max(pos) as last, count(*) as n_words from g group by doc_id, g""",
    "w14_global_tokens": _WORDS + """
        , n as (select doc_id, count(*) as n from w group by 1)
        select doc_id, cast(sum(n) over (order by doc_id rows unbounded preceding) - n as bigint) as first, cast(sum(n) over (order by doc_id rows unbounded preceding) - 1 as bigint) as last from n""",
    "j14_label_map": """
        with k as (select distinct regexp_extract(lower(source), '^([a-z]+)', 1) as w from mix_targets)
        select coalesce('exact:' || e.source, 'folded:' || c.source, 'coarse:' || k.w, 'other') as target, count(*) as n from documents d
        left join mix_targets e on e.source = d.source left join mix_targets c on c.source = lower(trim(d.source)) left join k on k.w = regexp_extract(lower(trim(d.source)), '^([a-z]+)', 1) where d.source is not null group by 1""",
    "o05_allocation": """
        with n as (select work_id, count(*) as n from documents where work_id is not null group by 1),
        i as (select *, 500 * n / sum(n) over () as ideal from n),
        b as (select *, cast(greatest(1, floor(ideal)) as bigint) as base, ideal - floor(ideal) as rest from i)
        select work_id, n, cast(base + case when row_number() over (order by rest desc, work_id) <= 500 - sum(base) over () then 1 else 0 end as bigint) as quota from b""",
    "o06_split": """
        with r as (select doc_id, row_number() over (order by md5('7:' || cast(doc_id as varchar)), doc_id) as k, count(*) over () as n from documents)
        select doc_id, case when k <= floor(n * 0.8) then 'train' when k <= floor(n * 0.8) + floor(n * 0.1) then 'dev' else 'test' end as part from r""",
    "o08_every_tenth": "select doc_id, work_id, row_number() over (partition by work_id order by doc_id) % 10 = 0 as dev from documents where work_id is not null",
    "o10_group_split": """
        with g as (select distinct work_id from documents where work_id is not null),
        r as (select work_id, row_number() over (order by sha1(work_id), work_id) as k, count(*) over () as n from g)
        select work_id, case when k <= greatest(1, round_even(n * 0.1, 0)) then 'dev' else 'train' end as part from r""",
    "o11_diverse": """
        with t as (select seed_id, subject, lang, row_number() over (partition by subject, lang order by seed_id) as turn from subject_seed),
        p as (select *, row_number() over (partition by subject order by turn, lang, seed_id) as place from t where turn <= 10)
        select subject, lang, seed_id, cast(place as integer) as place from p where place <= 10""",
    "j18_shared_texts": r"""
        with i as (select item_id, unnest(regexp_split_to_array(text, '[.!?\n]+')) as s from heldout_items where text is not null), d as (select unnest(regexp_split_to_array(text, '[.!?\n]+')) as s from documents where text is not null),
        p as (select distinct item_id, trim(lower(regexp_replace(s, '[^\p{L}\p{N}]+', ' ', 'g'))) as k from i), q as (select distinct trim(lower(regexp_replace(s, '[^\p{L}\p{N}]+', ' ', 'g'))) as k from d)
        select item_id, count(*) as n_shared from p where len(string_split(k, ' ')) >= 4 and k in (select k from q) group by 1""",
    "u02_shared_surfaces": "select form_text from forms where form_text is not null intersect select form_text from forms_stage where form_text is not null",
    "u04_label_union": """
        select coalesce(a.subject, b.subject) as subject, coalesce(n_seeds, 0) as n_seeds, case when b.subject is null then 0 else 1 end as listed
        from (select subject, count(*) as n_seeds from subject_seed group by 1) a full join subjects b on a.subject = b.subject""",
    "e01_scores": r"""
        with sp as (select doc_id, string_split(replace(text, chr(10), ' '), ' ') as l from documents where text is not null), u as (select doc_id, unnest(l) as word, unnest(range(len(l))) as pos from sp),
        p as (select *, coalesce(sum(case when regexp_matches(word, '[.!?]$') then 1 else 0 end) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as sent from u),
        t as (select *, row_number() over (partition by doc_id, sent order by pos) as id, case when regexp_matches(word, '^[0-9]+[.,]?$') then 'NUM' when regexp_matches(word, '^[A-Z][a-z]+') then 'NAME' end as label from p where word <> ''),
        g as (select doc_id, pos, label from t where label is not null and (id > 1 or label = 'NUM')), q as (select doc_id, pos, label from t where label is not null),
        c as (select label, (select count(*) from g where g.label = q.label) as n_gold, count(*) as n_pred, (select count(*) from g where g.label = q.label) as n_right from q group by 1),
        s as (select label, n_gold, 100.0 * n_right / n_pred as p, case when n_gold > 0 then 100.0 * n_right / n_gold else 0 end as r from c)
        select label, n_gold, round(cast(p as double), 4) as precision, round(cast(r as double), 4) as recall, round(cast(case when p + r > 0 then 2 * p * r / (p + r) else 0 end as double), 4) as f1 from s""",
}
