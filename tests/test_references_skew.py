"""Problems 4 and 5: orphan references and skewed keys."""

from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from lexmill.operators import references, skew

EARLY, LATE = datetime(2024, 1, 1), datetime(2024, 6, 1)


def frames(spark):
    refs = spark.createDataFrame([(1, 10, EARLY), (2, 11, LATE), (3, 12, LATE), (4, 0, LATE), (5, None, LATE), (6, 10, None), (7, 13, LATE)] + [(100 + i, 10, LATE) for i in range(50)], "row_id bigint, key bigint, at timestamp_ntz")
    parents = spark.createDataFrame([(10, LATE), (13, None)], "key bigint, valid_from timestamp_ntz")
    gone = spark.createDataFrame([("entries", 11, LATE), ("entries", 11, LATE), ("entries", 10, EARLY), ("other", 12, EARLY)], "tab string, row_id bigint, deleted_at timestamp_ntz")
    return refs, parents, gone


def test_kinds(spark):
    refs, parents, gone = frames(spark)
    for hot_parts in (2, 200):
        got = {(r.row_id, r.kind) for r in references.orphans([("forms", "entries", refs)], {"entries": parents}, gone, hot_parts=hot_parts).collect()}
        assert got == {(1, "late"), (2, "deleted"), (3, "missing"), (4, "missing")}


def test_intervals(spark):
    _, parents, gone = frames(spark)
    more = gone.unionByName(spark.createDataFrame([("entries", 20, None), ("entries", None, LATE), ("entries", 11, EARLY)], "tab string, row_id bigint, deleted_at timestamp_ntz"))
    got = {r.key: (r.valid_from, r.valid_to, r.ended) for r in references.intervals({"entries": parents}, more).collect()}
    assert got == {10: (LATE, None, False), 13: (None, None, False), 11: (None, LATE, True), 20: (None, None, True)}


def test_empty_and_report(spark):
    refs, parents, gone = frames(spark)
    assert references.orphans([("forms", "entries", refs.limit(0))], {"entries": parents}, gone).count() == 0
    got = references.orphans([("forms", "entries", refs)], {"entries": parents.limit(0)}, None)
    assert got.count() == 56
    months = {(r.month, r.orphans) for r in references.report(got).where("kind = 'missing'").collect()}
    assert (None, 1) in months and ("2024-01", 1) in months


def test_profile_equals_brute_force(spark):
    rows = [(1, "a")] * 40 + [(1, "b")] * 40 + [(1, None)] * 3 + [(2, "ccc")] + [(None, "z")] * 5 + [(3, None)]
    df = spark.createDataFrame(rows, "k int, v string")
    got = {r.key: r for r in skew.profile(skew.compress(df, "k", "v"), F.length).collect()}
    assert set(got) == {1, 2, 3}
    for k in got:
        own = [v for key, v in rows if key == k]
        told = Counter(v for v in own if v is not None)
        assert got[k].n_rows == len(own) and got[k].n_values == len(told)
        best = min(told, key=lambda v: (-told[v], v)) if told else None
        assert got[k].mode_value == best
    assert got[2].p50 == 3.0


def test_heavy_is_strict(spark):
    df = spark.createDataFrame([(1, "a")] * 2 + [(i, f"s{i}") for i in range(10, 108)], "k int, v string")
    assert skew.heavy(df, "k", "v").count() == 0
    got = {tuple(r) for r in skew.heavy(df, "k", "v", 0.015).collect()}
    assert got == {("k", "1"), ("v", "a")}
    assert skew.heavy(df.limit(0), "k", "v").count() == 0
