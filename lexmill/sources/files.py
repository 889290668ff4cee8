"""Readers and writers of the dictionary and corpus file formats.

Readers give DataFrames with fixed schemas; writers are partitioned and never gather the data in one task.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import sqlite3
import zipfile
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.sources.tables import spread

MOST_WORDS = 1_000_000
COMPACT = ["headword", "romanization", "pos", "glosses", "forms", "commentary", "lemma", "etymology", "source", "tags"]
# Fixed value: legacy column names and what they are called now.
LEGACY = {"word": "headword", "reading": "romanization", "part_of_speech": "pos", "definitions": "glosses", "notes": "commentary"}


def read_tsv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Tab-separated lines with a header, every column a string (S01, S17); gzip is transparent."""
    df = spark.read.csv(path, sep="\t", header=True, quote="", escape="", maxCharsPerColumn=-1, mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return df.select(*columns) if columns else df


SCAN = 5000


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """Rows of a table of every SQLite file under ``path`` (S03, S04), with ``source``, the file's name without its ending.

    One task per file opens it in memory and streams it in batches of ``SCAN`` rows; files without the table give none. Columns that a
    file lacks are null, text that isn't UTF-8 has its bad bytes replaced.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                con = sqlite3.connect(":memory:")
                con.text_factory = lambda b: b.decode("utf-8", "replace")
                con.deserialize(bytes(content))
                have = [r[1] for r in con.execute("select * from pragma_table_info(?)", (table,))]
                if have:
                    quoted = ", ".join('"' + n.replace('"', '""') + '"' if n in have else "null" for n in names)
                    cursor = con.execute(f'select {quoted} from "{table}"')
                    while rows := cursor.fetchmany(SCAN):
                        frame = pd.DataFrame(rows, columns=names, dtype=object)
                        frame["source"] = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                        yield frame
                con.close()

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"{schema}, source string")


def unified(df: DataFrame) -> DataFrame:
    """Rows of the compact or the legacy column set brought to the compact one."""
    have = {c.lower(): c for c in df.columns}
    old = {new: name for name, new in LEGACY.items()}
    return df.select(*(F.coalesce(*(F.col(have[n]) for n in (c, old.get(c, c)) if n in have), F.lit(None).cast("string")).alias(c) for c in COMPACT))


def by_source(df: DataFrame, lang: str, sources: list[str] | None = None) -> DataFrame:
    """Rows of a language's dictionaries: ``lang``, ``lang-*``, else the base language.

    ``sources`` narrows them, unless none of them is there.
    """
    names = sorted(r.db for r in df.select("db").distinct().collect())
    code = lang.lower()
    hits = [n for n in names if n == code] + [n for n in names if n.startswith(code + "-")]
    if not hits and "-" in code:
        base = code.split("-")[0]
        hits = [n for n in names if n == base or n.startswith(base + "-")]
    wanted = [n for n in hits if n in (sources or [])] or hits
    return df.where(F.col("db").isin(wanted)) if wanted else df.limit(0)


def read_json_refs(refs: DataFrame, column: str) -> DataFrame:
    """A JSON array of references as rows."""
    parsed = F.from_json(column, "array<struct<kind:string,db:string,entry_id:bigint,form_id:bigint>>")
    return refs.select(F.inline(parsed))


SKIPPED_FORM_TAGS = {"table-tags", "inflection-template"}
RELATION_TAGS = {"form-of", "alt-of"}
DUMP = "rec_id bigint, status string, word string, pos string, romanization string, glosses array<array<string>>, forms array<struct<form:string,tags:string,roman:string>>, form_of boolean"


def _texts(x) -> list[str]:
    return [t for g in x if g and (t := str(g).strip())] if isinstance(x, list) else []


def _objects(x) -> list[dict]:
    return [e for e in (x if isinstance(x, list) else [x]) if isinstance(e, dict)]


def _tags(x) -> list[str] | None:
    return [str(t) for t in x if t is not None] if isinstance(x, list) else [] if x is None else None


def _chosen_glosses(sense: dict) -> list[str]:
    """The shorter of glosses and raw glosses where both are there."""
    kinds = [t for t in (_texts(sense.get("glosses")), _texts(sense.get("raw_glosses"))) if t]
    return min(kinds, key=lambda t: sum(len(" ".join(g.split())) for g in t), default=[])


def dump_record(line: str | None) -> tuple:
    """One dump line as (status, word, pos, romanization, glosses by sense, forms, form_of)."""
    try:
        record = json.loads(line or "")
    except (ValueError, RecursionError):
        record = None
    if not isinstance(record, dict):
        return ("unreadable" if (line or "").strip() else "blank"), None, None, None, None, None, None
    word = record["word"].strip() if isinstance(record.get("word"), str) else ""
    if not word:
        return "no_word", None, None, None, None, None, None
    senses, forms = _objects(record.get("senses")), _objects(record.get("forms"))
    glosses = [g for s in senses if (g := _chosen_glosses(s))]
    form_of = bool(senses) and all(s.get("form_of") or s.get("alt_of") or RELATION_TAGS & set(_tags(s.get("tags")) or ()) for s in senses)
    roman = next((str(f.get("form") or "") for f in forms if f.get("tags") == ["romanization"]), "")
    kept = []
    for f in forms:
        text, tags = str(f.get("form") or "").strip(), _tags(f.get("tags"))
        if text and tags is not None and tags != ["romanization"] and not SKIPPED_FORM_TAGS & set(tags):
            kept.append({"form": text, "tags": ";".join(sorted(tags)), "roman": str(f.get("roman") or "")})
    return ("ok" if glosses else "no_gloss"), word, str(record.get("pos") or ""), roman, glosses, kept, form_of


def read_dump(raw: DataFrame) -> DataFrame:
    """Every dump line with its status (ok, no_gloss, no_word, blank, unreadable) and, where it has a word, its entry.

    Senses keep the shorter of their glosses and raw glosses, senses without any are dropped. Forms leave out table
    metadata and the romanization, which is a column; their tags are sorted.
    """
    names = [x.split()[0] for x in DUMP.split(", ")]

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([(i, *dump_record(line)) for i, line in zip(batch["rec_id"], batch["raw"])], columns=names)

    return spread(raw.select("rec_id", "raw")).mapInPandas(run, DUMP)


def first_lines(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``order``: a scan with a limit."""
    return df.orderBy(order).limit(n)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Elements of an XML dictionary as rows."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_cedict(spark: SparkSession, path: str) -> DataFrame:
    """``Traditional Simplified [pin1 yin1] /gloss/gloss/`` lines."""
    line = "^(\\S+) (\\S+) \\[([^\\]]*)\\] /(.*)/\\s*$"
    rows = spark.read.text(path).where(F.col("value").rlike(line))
    return rows.select(*(F.regexp_extract("value", line, k).alias(n) for k, n in enumerate(("traditional", "simplified", "pinyin"), 1)), F.split(F.regexp_extract("value", line, 4), "/").alias("glosses"))


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of CoNLL-U blocks: sent_id, text, id, form, lemma, upos, xpos, feats, head, deprel, misc."""
    blocks = spark.read.text(path, lineSep="\n\n").where("trim(value) <> ''")
    named = blocks.select(F.regexp_extract("value", "(?m)^# sent_id = (.*)$", 1).alias("sent_id"), F.regexp_extract("value", "(?m)^# text = (.*)$", 1).alias("text"), F.explode(F.filter(F.split("value", "\n"), lambda x: x.rlike("^[0-9]"))).alias("line"))
    cells = F.split("line", "\t")
    names = ["id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"]
    return named.select("sent_id", "text", *(F.try_element_at(cells, F.lit(k)).alias(n) for k, n in enumerate(names, 1)))


def read_bio(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of ``token label`` lines as arrays, with a flag for labels that are none."""
    blocks = spark.read.text(path, lineSep="\n\n").where("trim(value) <> ''")
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    labels = F.transform(lines, lambda x: F.regexp_extract(x, "(\\S+)\\s*$", 1))
    return blocks.select(F.transform(lines, lambda x: F.regexp_extract(x, "^(\\S+)", 1)).alias("tokens"), labels.alias("labels"), F.forall(labels, lambda x: x.rlike("^(O|[BIES]-\\S+)$")).alias("valid"))


def write_bio(tokens: DataFrame, path: str) -> None:
    """Tokens (sent_id, id, form, label) as ``token label`` blocks."""
    lines = tokens.select("sent_id", F.struct(F.col("id").cast("int").alias("o"), F.concat_ws(" ", "form", "label").alias("line")).alias("r"))
    blocks = lines.groupBy("sent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["line"]), "\n").alias("value"))
    blocks.select("value").write.mode("overwrite").option("lineSep", "\n\n").text(path)


def write_spans(spans: DataFrame, path: str) -> None:
    """Documents (doc_id, text) with their spans (start, end, label) as JSON lines, one document each."""
    spans.select(F.to_json(F.struct("doc_id", "text", "spans")).alias("value")).write.mode("overwrite").text(path)


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema="doc_id bigint, text string, spans array<struct<start:int,end:int,label:string>>")


def exported(entries: DataFrame, source: str, path: str) -> None:
    """Custom entries of one source in the compact column set, sorted by id over the files."""
    rows = entries.where(F.lower(F.trim("source")) == source).select("id", F.col("entry_id").alias("key"), "headword", "romanization", "pos", F.col("glosses_json").alias("glosses"), F.col("forms_json").alias("forms"), "commentary", "lemma", "source")
    write_tsv(rows.repartitionByRange("id").sortWithinPartitions("id"), path)


def read_zipped_vec(spark: SparkSession, path: str, words: DataFrame) -> DataFrame:
    """``read_vec`` of ``.vec`` files inside zip archives (S16): one task per archive reads it as a stream and keeps the lines of the
    words wanted, a set whose size is checked."""
    wanted = [r.word for r in words.select("word").where("word is not null").distinct().limit(MOST_WORDS + 1).collect()]
    if len(wanted) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words; unpack the archive and use read_vec")
    given = spark.sparkContext.broadcast(frozenset(wanted))

    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                out = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(".vec")):
                        with io.TextIOWrapper(z.open(name), encoding="utf-8", errors="replace") as lines:
                            for line in lines:
                                word, _, rest = line.rstrip("\n").partition(" ")
                                if word in given.value and " " in rest:
                                    out.append((word, [float(x) for x in rest.split()]))
                yield pd.DataFrame(out, columns=["word", "v"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "word string, v array<double>")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("word", F.transform("v", lambda x: x / norm).alias("v"))


def read_vec(spark: SparkSession, path: str, words: DataFrame) -> DataFrame:
    """Vectors of a ``.vec`` text file for the given words, scaled to length one."""
    cells = F.split("value", " ")
    rows = spark.read.text(path).select(cells[0].alias("word"), F.transform(F.slice(cells, F.lit(2), F.size(cells)), lambda x: x.cast("double")).alias("v")).where(F.size("v") > 1)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.join(words.select("word").distinct(), "word", "left_semi").select("word", F.transform("v", lambda x: x / norm).alias("v"))


def reassembled(spark: SparkSession, path: str, size: int, sha256: str) -> bytes:
    """An artifact from its shards in name order, refused when size or digest differ (S18). One artifact fits the driver."""
    shards = sorted(spark.read.format("binaryFile").load(path).select("path", "content").collect(), key=lambda r: r.path)
    whole = b"".join(bytes(r.content) for r in shards)
    if len(whole) != size or hashlib.sha256(whole).hexdigest() != sha256:
        raise ValueError("the shards don't make up the artifact")
    return whole


# What a stored page may hold.
ALLOWED_TAGS = "a abbr b blockquote br code div em h1 h2 h3 h4 h5 h6 hr i li ol p pre rp rt ruby s small span strong sub sup table tbody td th thead tr u ul".split()
ALLOWED_ATTRIBUTES = ["lang", "dir", "title"]


class _Cleaner(HTMLParser):
    """Writes out allowed elements and attributes, links without their target; what stands in scripts and the like is dropped, other elements are unwrapped."""

    DROPPED = {"script", "style", "iframe", "object", "embed", "noscript", "template", "svg", "math", "title", "head"}
    VOID = {"br", "hr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.inside = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.DROPPED:
            self.inside += tag != "embed"
        elif not self.inside and tag in ALLOWED_TAGS:
            kept = [(k, v or "") for k, v in attrs if k in ALLOWED_ATTRIBUTES]
            self.out.append("<" + tag + "".join(f' {k}="{escape(v)}"' for k, v in kept) + ">")
            if tag not in self.VOID:
                self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        if tag in self.VOID:
            self.handle_starttag(tag, attrs)
        elif tag in ALLOWED_TAGS and not self.inside:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.DROPPED:
            self.inside = max(0, self.inside - 1)
        elif not self.inside and tag in self.open:
            while True:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_data(self, data):
        if not self.inside:
            self.out.append(escape(data, quote=False))

    def done(self) -> str:
        self.close()
        return "".join([*self.out, *(f"</{t}>" for t in reversed(self.open))])


def clean_html(html: str | None) -> str:
    """Allowed elements and attributes of a page, well-formed; text is escaped."""
    cleaner = _Cleaner()
    cleaner.feed(html or "")
    return cleaner.done()


def sanitized(html: Column) -> Column:
    """``clean_html`` as a vectorised column."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([clean_html(p) for p in pages], dtype=object)

    return run(html)


def plain_text(html: Column) -> Column:
    """Text of an HTML column: scripts, styles, comments and tags removed, white space joined."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<(script|style|iframe|object)\\b.*?</\\1\\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "(?s)<[^>]*>", " "), "(?U)\\s+", " "))


def write_store(df: DataFrame, path: str) -> None:
    """The store, one folder per dictionary."""
    df.write.mode("overwrite").partitionBy("db").parquet(path)


def write_tsv(df: DataFrame, path: str, header: bool = True, compression: str = "none") -> None:
    """A tab-separated report (K05, K07); tabs and line feeds in values become spaces."""
    plain = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\\t\\r\\n]", " ").alias(c) for c in df.columns]
    df.select(*plain).write.mode("overwrite").csv(path, sep="\t", header=header, quote="", escape="", emptyValue="", compression=compression, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_conllu(tokens: DataFrame, path: str) -> None:
    """Tokens (sent_id, id, form, …) as CoNLL-U blocks (K06, S15); a sentence is one row of text."""
    names = ["id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"]
    cells = [F.coalesce(F.when(F.col(n).cast("string") != "", F.col(n).cast("string")), F.lit("_")) if n in tokens.columns else F.lit("_") for n in names]
    lines = tokens.select("sent_id", F.struct(F.regexp_extract(F.col("id").cast("string"), "^(\\d+)", 1).cast("int").alias("o"), F.concat_ws("\t", *cells).alias("line")).alias("r"))
    blocks = lines.groupBy("sent_id").agg(F.concat(F.lit("# sent_id = "), F.first("sent_id"), F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["line"]), "\n")).alias("value"))
    blocks.select("value").write.mode("overwrite").option("lineSep", "\n\n").text(path)


def write_index(index: DataFrame, path: str) -> str:
    """The key index as gzip JSON lines, one key each, and its SHA-1 version.

    The version is made from one digest per key, combined in an order-free way.
    """
    rows = index.groupBy("kind", "key").agg(F.to_json(F.array_sort(F.collect_list(F.struct("db", "entry_id", "form_id")))).alias("postings"))
    lines = rows.select(F.to_json(F.struct("kind", "key", "postings")).alias("value"))
    lines.write.mode("overwrite").option("compression", "gzip").text(path)
    digest = lines.agg(F.sum(F.conv(F.substring(F.sha1("value"), 1, 12), 16, 10).cast("decimal(38,0)")).alias("d")).first().d
    return hashlib.sha1(str(digest).encode()).hexdigest()


def inserted(have: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``have`` with the rows of ``new`` whose key it lacks, each key once."""
    rest = sorted(set(new.columns) - set(keys)) or keys
    first = new.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*rest)))
    fresh = first.where("_k = 1").drop("_k")
    missing = fresh.alias("n").join(have.select(*keys).distinct().alias("h"), [F.col(f"n.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys], "left_anti")
    return have.unionByName(missing.select(*have.columns))


def replaced(have: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``have`` with all rows of the keys in ``new`` replaced by those (K08); also the upsert of B05."""
    return have.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*have.columns))


def gzip_lines(path: str) -> list[dict]:
    """JSON lines of one gzip file."""
    with gzip.open(path, "rt", encoding="utf-8") as f:
        return [json.loads(x) for x in f]
