"""Several values packed in one field, unpacked to one value per row (problem 6).

A parsing expression grammar with ordered choice:

    Field  <- Bracketed / Values
    Values <- Sep* (Value (Sep+ Value)*)? Sep* End
    Value  <- Quoted / Bare
    Quoted <- Space* '"' ('""' / !'"' Any)* '"' &(Space* (Sep / End))
    Bare   <- (QuotedSpan / !Sep Any)+

``Bracketed`` is JSON that reads to the end. Where ``Quoted`` fails, because the quote isn't closed or text
follows it, the parser backtracks to the quote and takes ``Bare``; the value then carries the flag
``malformed_quote``. Brackets that can't be read as JSON fall back to ``Values`` for tags, with the flag
``malformed_bracket``; glosses have no values then, but one error row with that flag and neither position nor value.

Each Arrow batch is dictionary-encoded, so the grammar runs once per distinct string of the batch, and
positions are emitted by Spark's ``posexplode``.

Cases: null and empty strings have no values; empty values are dropped and not counted; repeated values
stay; very long fields are parsed whole.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.sources.tables import spread


@dataclass(frozen=True)
class Grammar:
    """What separates values, and how JSON is read ('array' or 'glosses')."""

    separators: str
    slash: bool = True
    numbered: bool = False
    bracketed: str = "array"


#: Commas, semicolons and bars with their East Asian forms.
TAGS = Grammar(",;|，、､；｜")
GLOSSES = Grammar(";|；｜\n", numbered=True, bracketed="glosses")

_QUOTED = re.compile(r' *"((?:[^"]|"")*)"')
_SPAN = re.compile(r'"(?:[^"]|"")*"')
_NUMBER = re.compile(r"(?:(\d+)\.|\((\d+)\))(?=\s)")
_UNREADABLE = object()


def _read_json(text: str):
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return _UNREADABLE


def _gloss_strings(node, out: list[str]) -> None:
    """Bare strings, and strings under glosses and gloss, in the order written."""
    if isinstance(node, str):
        out.append(node)
    elif isinstance(node, list):
        for x in node:
            _gloss_strings(x, out)
    elif isinstance(node, dict):
        for key, value in node.items():
            if key in ("glosses", "gloss"):
                _gloss_strings(value, out)


class Parser:
    """The grammar over one string; ``parse`` gives (value, kind, flag) in order."""

    def __init__(self, grammar: Grammar):
        self.g = grammar
        chars = re.escape(grammar.separators)
        self.sep = re.compile(f"[{chars}]" + ("|(?<= )/(?= )" if grammar.slash else ""))

    def parse(self, text: str | None) -> list[tuple[str | None, str, str]]:
        if not text:
            return []
        flag, head = "", text.lstrip()[:1]
        if head in ("[", "{") and (head == "[" or self.g.bracketed == "glosses"):
            got = _read_json(text)
            if got is not _UNREADABLE:
                return [(x.strip(" "), "bracketed", "") for x in self._strings(got) if x.strip(" ")]
            if self.g.bracketed == "glosses":
                return [(None, "error", "malformed_bracket")]
            flag = "malformed_bracket"
        return [(v.strip(" "), kind, f or flag) for v, kind, f in self._values(text) if v.strip(" ")]

    def _strings(self, got) -> list[str]:
        out: list[str] = []
        if self.g.bracketed == "glosses":
            _gloss_strings(got, out)
            return out
        for x in got:
            if isinstance(x, str):
                out.append(x)
            elif x is not None:
                out.append(json.dumps(x, ensure_ascii=False))
        return out

    def _values(self, text: str):
        if '"' not in text and not (self.g.numbered and _NUMBER.match(text.lstrip())):
            for v in self.sep.split(text):
                yield v, "bare", ""
            return
        at, end, expected = 0, len(text), 1
        while at < end:
            if self.g.numbered and (m := self._number(text, at, expected)):
                at, expected = m.end(), expected + 1
                continue
            if s := self.sep.match(text, at):
                at = s.end()
                continue
            if got := self._quoted(text, at):
                value, at = got
                yield value, "quoted", ""
            else:
                stop, clean = self._bare(text, at, expected)
                yield text[at:stop], "bare", "" if clean else "malformed_quote"
                at = stop

    def _number(self, text: str, at: int, expected: int):
        """A running number where a value may begin: 1 only at the start, then each next one."""
        m = _NUMBER.match(text, at + (len(text[at : at + 8]) - len(text[at : at + 8].lstrip())))
        if not m or int(m[1] or m[2]) != expected:
            return None
        if expected == 1:
            return m if not text[: m.start()].strip() else None
        return m if text[m.start() - 1].isspace() or text[m.start() - 1] in self.g.separators else None

    def _quoted(self, text: str, at: int):
        m = _QUOTED.match(text, at)
        if not m:
            return None
        after = m.end()
        while after < len(text) and text[after] == " ":
            after += 1
        if after < len(text) and not self.sep.match(text, after):
            return None
        return m[1].replace('""', '"'), after

    def _bare(self, text: str, at: int, expected: int) -> tuple[int, bool]:
        clean, i = True, at
        while i < len(text):
            if text[i] == '"' and (m := _SPAN.match(text, i)):
                clean = clean and bool(text[at:i].strip(" "))
                i = m.end()
                continue
            if text[i] == '"':
                clean = False
            if i > at and (self.sep.match(text, i) or (self.g.numbered and expected > 1 and text[i].isspace() and self._number(text, i, expected))):
                break
            i += 1
        return i, clean


_ITEM = pa.struct([("val", pa.string()), ("kind", pa.string()), ("flag", pa.string())])
MEMO = 100_000


def parsed(df: DataFrame, id_col: str, value_col: str, grammar: Grammar, least: int = 1) -> DataFrame:
    """row_id, items (val, kind, flag): the values of fields with at least ``least`` values, in order."""

    def run(batches):
        parser, memo = Parser(grammar), {}
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            lists = []
            for text in coded.dictionary.to_pylist():
                got = memo.get(text)
                if got is None:
                    got = [{"val": v, "kind": k, "flag": f} for v, k, f in parser.parse(text)]
                    got = got if len(got) >= least else []
                    if len(memo) < MEMO and len(text) < 1000:
                        memo[text] = got
                lists.append(got)
            items = pa.array(lists, pa.list_(_ITEM)).take(coded.indices)
            yield pa.RecordBatch.from_arrays([batch.column(0), items], names=["row_id", "items"])

    packed = df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(value_col).cast("string").alias("packed")).where("packed is not null and packed <> ''")
    lists = spread(packed).mapInArrow(run, "row_id bigint, items array<struct<val:string,kind:string,flag:string>>")
    return lists.where(F.size("items") > 0)


def unpack(df: DataFrame, id_col: str, value_col: str, grammar: Grammar, least: int = 1) -> DataFrame:
    """row_id, pos (from 1), val, kind, flag: one row per value of fields with at least ``least`` values.

    With ``least`` 1 also the error rows of unreadable fields.
    """
    items = parsed(df, id_col, value_col, grammar, least).select("row_id", F.posexplode("items").alias("k", "item"))
    pos = F.when(F.col("item.kind") != "error", (F.col("k") + 1).cast("bigint"))
    return items.select("row_id", pos.alias("pos"), "item.val", "item.kind", "item.flag")
