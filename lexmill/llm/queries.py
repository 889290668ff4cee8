"""Queries of the problems on text, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import canonical, frequency, leakage, mixing, mojibake, subjects
from lexmill.operators.unpack import TAGS, Parser
from lexmill.sources import load
from lexmill.sources.tables import cut


def _whole(value: str) -> list[str]:
    term = frequency.folded(value)
    return [term] if term else []


def _tags(value: str) -> list[str]:
    return [t for v, _, _ in Parser(TAGS).parse(value) if (t := frequency.folded(v))]


def _tag_counts(spark, d) -> DataFrame:
    return frequency.frequencies(load(spark, d, "forms"), F.col("id"), "morph_tags", _tags)


def _pos_counts(spark, d) -> DataFrame:
    return frequency.frequencies(load(spark, d, "entries"), F.col("id"), "pos", _whole)


def _audit_counts(spark, d) -> DataFrame:
    audit = load(spark, d, "form_tags_flat")
    return frequency.frequencies(audit, F.xxhash64(F.coalesce("db", F.lit(""))), "form_tag", _whole, "occurrence_count")


def p1_found(spark, d):
    return mojibake.found(load(spark, d, "entries"))


def p1_repaired(spark, d):
    return mojibake.repaired(load(spark, d, "entries"))


def p1_by_source(spark, d):
    return mojibake.by_source(load(spark, d, "entries"))


def _keyed(spark, d) -> dict[str, DataFrame]:
    return {tab: load(spark, d, tab) for tab in ("entries", "forms")}


def p2_found(spark, d):
    return canonical.found(_keyed(spark, d))


def p2_canonical(spark, d):
    parts = [canonical.rewritten(df, "db", canonical.FIELDS[tab]).select(F.lit(tab).alias("tab"), "row_id", "field", "canonical") for tab, df in _keyed(spark, d).items()]
    return reduce(DataFrame.unionByName, parts)


def p2_lookups(spark, d):
    return canonical.lookups(_keyed(spark, d))


def p7_found(spark, d):
    forms, entries = load(spark, d, "forms"), load(spark, d, "entries")
    n_forms, n_entries = forms.agg(F.count(F.lit(1))).scalar(), entries.agg(F.count(F.lit(1))).scalar()
    audit = _audit_counts(spark, d)
    parts = [
        ("forms.morph_tags", frequency.marked(_tag_counts(spark, d), "records", n_forms)),
        ("entries.pos", frequency.marked(_pos_counts(spark, d), "records", n_entries)),
        ("form_tags_flat.form_tag", frequency.marked(audit, "occurrences", load(spark, d, "form_tags_flat").agg(F.coalesce(F.sum(F.when(F.trim("form_tag") != "", F.col("occurrence_count"))), F.lit(0))).scalar())),
    ]
    return reduce(DataFrame.unionByName, [df.select(F.lit(field).alias("field"), "term", "mark") for field, df in parts])


def p7_counts(spark, d):
    parts = [("forms.morph_tags", _tag_counts(spark, d)), ("entries.pos", _pos_counts(spark, d)), ("form_tags_flat.form_tag", _audit_counts(spark, d))]
    return reduce(DataFrame.unionByName, [df.select(F.lit(field).alias("field"), "term", "occurrences", "records") for field, df in parts])


def p7_pos(spark, d):
    """Every part of speech with its counts."""
    return _pos_counts(spark, d).select("term", "occurrences", "records")


def p7_audit(spark, d):
    """Every audit tag with its counts; records are dictionaries."""
    return _audit_counts(spark, d).select("term", "occurrences", "records")


def p8_found(spark, d):
    return leakage.found(load(spark, d, "documents"), load(spark, d, "heldout_items"))


def p8_report(spark, d):
    return leakage.report(p8_found(spark, d), load(spark, d, "heldout_items"))


def p9_found(spark, d):
    return mixing.short_sources(load(spark, d, "documents"), load(spark, d, "mix_targets"))


def p9_mix(spark, d):
    targets = load(spark, d, "mix_targets")
    return mixing.placed(cut(mixing.sized(load(spark, d, "documents"), targets)), targets)


def p9_shares(spark, d):
    targets = load(spark, d, "mix_targets")
    return mixing.shares(cut(mixing.sized(load(spark, d, "documents"), targets)), targets)


def p10_found(spark, d):
    return subjects.found(load(spark, d, "documents"), load(spark, d, "subject_seed"))


def p10_make_up(spark, d):
    return subjects.make_up(load(spark, d, "documents"), load(spark, d, "subject_seed"), load(spark, d, "subjects"))


QUERIES = {f.__name__: f for f in (p1_found, p1_repaired, p1_by_source, p2_found, p2_canonical, p2_lookups, p7_found, p7_counts, p7_pos, p7_audit, p8_found, p8_report, p9_found, p9_mix, p9_shares, p10_found, p10_make_up)}
#: Width and case folding of the values in these tables, which hold no other compatibility characters than full-width ones.
_WIDE, _PLAIN = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000", "".join(map(chr, range(0x21, 0x7F))).replace("'", "''") + " "


def _folded(x: str) -> str:
    return f"trim(lower(translate({x}, '{_WIDE}', '{_PLAIN}')))"


SQL: dict[str, str] = {
    "p7_pos": f"select term, count(*) as occurrences, count(*) as records from (select {_folded('pos')} as term from entries) where term <> '' group by 1",
    "p7_audit": f"""select term, cast(sum(n) as bigint) as occurrences, count(distinct db) as records from (select {_folded('form_tag')} as term, coalesce(occurrence_count, 0) as n, coalesce(db, '') as db from form_tags_flat) where term <> '' group by 1""",
}
