"""Flat, linked tables out of one-record-per-line JSON with nested lists (problem 3).

Each line is stream-parsed, token by token and without a tree, into (path, ordinals, value) triples. Paths are
discovered, none is lost: a list element or an object lies under the path of its member, a scalar member under the
path of its object. Triples are grouped by their repeated ancestor, the innermost element that they lie in, and every
group becomes one row of the table of that ancestor. A record lies wholly in one row, so the grouping happens
inside the record and the operator is one narrow pass without a shuffle, however the rows are spread. ``elements``
gives the rows of all tables; the tables of ``TABLES`` are projections of it, for which nothing else is kept.

Cases: null, blank or unreadable lines, and lines that hold something else than one object, give no rows.
A null member or a missing one gives none. A single object in place of a list, and a single string in place of a list
of ``TABLES``, count as a list of one. Null elements give no row but keep their place. Of repeated members of an object
the last counts. A list inside a list lies under the member ``[]``. Repeated lines count under their own id.
"""

from __future__ import annotations

import re
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.sources.tables import spread

#: Child table -> path of the repeated ancestor (fixed names of the dump format).
TABLES = {
    "senses": ("senses",),
    "sense_glosses": ("senses", "glosses"),
    "sense_examples": ("senses", "examples"),
    "sense_tags": ("senses", "tags"),
    "sounds": ("sounds",),
    "sound_tags": ("sounds", "tags"),
    "forms": ("forms",),
    "form_tags": ("forms", "tags"),
}
#: Scalar members that become columns of each table; the element itself is ``val`` when it is a string.
MEMBERS = {
    "senses": ("qualifier",),
    "sense_examples": ("text", "english"),
    "sounds": ("ipa", "enpr", "audio"),
    "forms": ("form", "roman", "source"),
}
COLUMNS = sorted({m for ms in MEMBERS.values() for m in ms})
SCHEMA = "rec_id bigint, tab string, parent_pos bigint, pos bigint, val string, " + ", ".join(f"m_{m} string" for m in COLUMNS)
ELEMENTS = "rec_id bigint, path string, ordinals array<int>, val string, members map<string,string>"
_BY_PATH = {path: name for name, path in TABLES.items()}
_KEPT = set(_BY_PATH) | {path + (m,) for name, path in TABLES.items() for m in MEMBERS.get(name, ())}
_TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\],:])|(")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))')
_BLANK = re.compile(r"[ \t\r\n]*$")

Path = tuple[str, ...]
Triple = tuple[Path, tuple[int, ...], str | None]


class _Frame:
    """An open object or list: its path, its ordinals, and where it is."""

    __slots__ = ("path", "at", "listed", "key", "places", "k")

    def __init__(self, path: Path, at: tuple[int, ...], listed: bool):
        self.path, self.at, self.listed = path, at, listed
        self.key: str | None = None
        self.places: dict[str, int] = {}  # member -> its first triple
        self.k = 0


def triples(line: str | None, kept: set[Path] | None = None) -> list[Triple] | None:
    """(path, ordinals, value) in document order, or None where the line isn't one complete object.

    An element of a list, and an object, gives a triple under its path, with its value if that is a string; its
    scalar members give one each, a step longer, with the same ordinals. ``kept``: the only paths to give.
    """
    if not line:
        return None
    out: list[Triple | None] = []
    stack: list[_Frame] = []
    paths: dict[tuple[Path, str], Path] = {}
    match, i, ready = _TOKEN.match, 0, False  # ready: a value has just ended
    while True:
        m = match(line, i)
        if m is None:
            return None
        i, kind = m.end(), m.lastindex
        mark = m[1] if kind == 1 else ""
        top = stack[-1] if stack else None
        if mark == "}" or mark == "]":
            if top is None or top.listed != (mark == "]") or not (ready or (top.k == 0 and top.key is None)):
                return None
            stack.pop()
            if not stack:
                return [t for t in out if t is not None] if _BLANK.match(line, i) else None
            ready = True
            continue
        if mark == ",":
            if not ready or top is None:
                return None
            ready = False
            top.k += 1
            if not top.listed:
                top.key = None
            continue
        if ready or mark == ":":
            return None
        if top is None:  # only an object may stand alone
            if mark != "{":
                return None
            stack.append(_Frame((), (), False))
            continue
        value = None
        if kind == 2:
            try:
                value, i = scanstring(line, i, True)
            except ValueError:
                return None
        if not top.listed and top.key is None:  # a member's name
            if kind != 2:
                return None
            colon = match(line, i)
            if colon is None or colon[1] != ":":
                return None
            i = colon.end()
            if value in top.places:  # the later of two counts
                for j in range(top.places[value], len(out)):
                    t = out[j]
                    if t is not None and t[0][: len(top.path) + 1] == top.path + (value,) and t[1][: len(top.at)] == top.at:
                        out[j] = None
            else:
                top.places[value] = len(out)
            top.key = value
            continue
        if top.listed:
            path, at = top.path, top.at + (top.k,)
        else:
            path = paths.get((top.path, top.key)) or paths.setdefault((top.path, top.key), top.path + (top.key,))
            at = top.at
        if mark == "{":
            at = at if top.listed else at + (0,)
            if kept is None or path in kept:
                out.append((path, at, None))
            stack.append(_Frame(path, at, False))
            continue
        if mark == "[":
            if top.listed:
                if kept is None or path in kept:
                    out.append((path, at, None))
                path = path + ("[]",)
            stack.append(_Frame(path, at, True))
            continue
        ready = True
        if kind == 4 and m[4] == "null":
            continue
        text = value if kind == 2 else m[kind]
        if not top.listed and path in _BY_PATH and len(at) == len(path) - 1:
            if kind == 2 and (kept is None or path in kept):
                out.append((path, at + (0,), text))
            elif kept is None:
                out.append((path, at, text))
        elif kept is None or path in kept:
            out.append((path, at, (text if kind == 2 or kept is None else None) if top.listed else text))


def grouped(found_: list[Triple]) -> dict[tuple[Path, tuple[int, ...]], list]:
    """Triples by repeated ancestor: (path, ordinals) -> [value of the element, its scalar members]."""
    out: dict[tuple[Path, tuple[int, ...]], list] = {((), ()): [None, {}]}
    for path, at, value in found_:
        if len(at) == len(path):  # every step of an element has its ordinal; a scalar member has one less
            out[path, at] = [value, {}]
        else:
            out.setdefault((path[:-1], at), [None, {}])[1][path[-1]] = value
    return out


def rows_of(rec_id: int, line: str | None):
    """One row per element of the fixed tables: its triples pivoted into columns."""
    for (path, at), (val, members) in grouped(triples(line, _KEPT) or []).items():
        if path in _BY_PATH:
            yield (rec_id, _BY_PATH[path], at[-2] if len(at) > 1 else -1, at[-1], val, *(members.get(m) for m in COLUMNS))


def _mapped(raw: DataFrame, id_col: str, raw_col: str, rows, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for rec_id, line in zip(batch["rec_id"], batch["raw"]):
                out.extend(rows(rec_id, line))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    picked = raw.select(F.col(id_col).cast("bigint").alias("rec_id"), F.col(raw_col).cast("string").alias("raw"))
    return spread(picked.where("rec_id is not null and raw is not null")).mapInPandas(run, schema)


def flatten(raw: DataFrame, id_col: str = "rec_id", raw_col: str = "raw") -> DataFrame:
    """All rows of the fixed tables, ``tab`` naming their table: rec_id, tab, parent_pos, pos, val and m_* members."""
    return _mapped(raw, id_col, raw_col, rows_of, SCHEMA)


def elements(raw: DataFrame, id_col: str = "rec_id", raw_col: str = "raw") -> DataFrame:
    """The rows of every table that the records hold: rec_id, path, ordinals, val, members.

    ``path`` is dotted and empty for the record itself. The parent of a row has the path and the ordinals without their last.
    """

    def rows(rec_id, line):
        found_ = triples(line)
        if found_ is not None:
            for (path, at), (val, members) in grouped(found_).items():
                yield rec_id, ".".join(path), list(at), val, members

    return _mapped(raw, id_col, raw_col, rows, ELEMENTS)


def columns(raw: DataFrame) -> DataFrame:
    """The discovered tables and their columns: path, member (null for the rows themselves), n_rows, n_records."""
    rows = elements(raw)
    own = rows.select("rec_id", "path", F.lit(None).cast("string").alias("member"))
    members = rows.select("rec_id", "path", F.explode(F.map_keys("members")).alias("member"))
    per_record = own.unionByName(members).groupBy("path", "member", "rec_id").agg(F.count(F.lit(1)).alias("n"))
    return per_record.groupBy("path", "member").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_records"))


def found(raw: DataFrame) -> DataFrame:
    """rec_id, tab, parent_pos, pos of every child row."""
    return flatten(raw).select("rec_id", "tab", "parent_pos", "pos")


def child_table(raw: DataFrame, name: str) -> DataFrame:
    """One flat child table with its link (rec_id, parent_pos) and its own columns."""
    members = [F.col(f"m_{m}").alias(m) for m in MEMBERS.get(name, ())]
    own = [] if name in ("senses", "sounds", "forms") else ["val"]
    return flatten(raw).where(F.col("tab") == name).select("rec_id", "parent_pos", "pos", *own, *members)
