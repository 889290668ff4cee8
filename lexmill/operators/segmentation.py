"""Dictionary segmentation (T01 to T04): the best cover of a word by dictionary pieces and unknown graphemes.

Candidate spans come from an equi-join of the words' distinct substrings with the keys, so the key set is
never sent to the tasks; only the matched spans of a word meet again. The cover of each word is found by
dynamic programming from the right, comparing, in this order: a promoted piece here, the longer one of two
promoted, fewer unknown graphemes, more promoted pieces, fewer pieces, the longest span anywhere, the longer
span here. A promoted lemma is used once along a path. Spans may not cross a given boundary unless both of
their ends are boundaries; white space bounds pieces.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GRAPHEME = regex.compile(r"\X")


def graphemes(word: str) -> list[str]:
    return _GRAPHEME.findall(word or "")


def allowed(start: int, end: int, bounds: list[int]) -> bool:
    """Whether a span respects the boundaries."""
    if not bounds or (start in bounds and end in bounds):
        return True
    return not any(start < b < end for b in bounds)


def segment(parts: list[str], known: dict[tuple[int, int], str], bounds: Iterable[int] = (), hints: Iterable[str] = (), exclude_whole: bool = False) -> list[tuple[int, int, bool]]:
    """(start, end, known) of the best cover of ``parts``; ``known`` maps spans to their lemma.

    A span whose lemma is among ``hints`` is promoted. A whole-word match wins unless excluded.
    """
    n, hints = len(parts), set(hints)
    spaces = {p for i, c in enumerate(parts) if c in " \t" for p in (i, i + 1)}
    edges = sorted(set(bounds) | spaces | ({0, n} if bounds or spaces else set()))
    if not exclude_whole and (0, n) in known and n:
        return [(0, n, True)]
    best: list = [None] * (n + 1)
    best[n] = (0, 0, 0, 0, frozenset(), [])  # unknown, promoted, pieces, longest, lemmas used, spans
    ends: dict[int, list[int]] = {}
    for a, b in known:
        ends.setdefault(a, []).append(b)
    for i in range(n - 1, -1, -1):
        choice = None
        for end in sorted({*ends.get(i, ()), i + 1}):
            rest = best[end]
            options = []
            if (i, end) in known and not (exclude_whole and (i, end) == (0, n)) and allowed(i, end, edges):
                lemma = known[i, end]
                lifted = lemma in hints and lemma not in rest[4]
                if not (lemma in hints and lemma in rest[4]):
                    options.append((lifted, 0, True, rest[4] | {lemma} if lifted else rest[4]))
            if end == i + 1:
                options.append((False, 1, False, rest[4]))
            for lifted, unknown, is_known, used in options:
                size = end - i
                value = (rest[0] + unknown, rest[1] + lifted, rest[2] + 1, max(rest[3], size))
                rank = (-lifted, -size if lifted else 0, value[0], -value[1], value[2], -value[3], -size, not is_known)
                if choice is None or rank < choice[0]:
                    choice = rank, (*value, used, [(i, end, is_known), *rest[5]])
        best[i] = choice[1]
    return best[0][5]


def spans(words: DataFrame, keys: DataFrame, longest: int = 24) -> DataFrame:
    """word, spans of its pieces that are keys (0-based code points, end exclusive).

    ``longest`` is the length of the longest key; a longer piece can't match.
    """
    starts = F.sequence(F.lit(1), F.length("word"))
    pieces = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - i + 1)), lambda n: F.struct((i - 1).alias("start"), (i - 1 + n).alias("end"), F.substring("word", i, n).alias("piece")))))
    asked = words.where("word <> ''").select("lang", "word").distinct()
    met = asked.select("lang", "word", F.explode(pieces).alias("p")).select("lang", "word", "p.start", "p.end", F.col("p.piece").alias("key"))
    hits = met.join(keys.select("lang", "key").distinct(), ["lang", "key"], "left_semi")
    grouped = hits.groupBy("lang", "word").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return asked.join(grouped, ["lang", "word"], "left")


def segmented(words: DataFrame, keys: DataFrame) -> DataFrame:
    """lang, word, pieces (joined by |), n_pieces, n_unknown. A word of n characters has at most n² spans.

    ``words`` may have bounds (array of code point places that no known piece may cross, T02) and hints (lemmas that the
    word should hold, each used once, T04).
    """
    extra = [c for c in ("bounds", "hints") if c in words.columns]
    most = keys.agg(F.max(F.length("key"))).first()[0] or 1

    @F.pandas_udf("struct<pieces:string,n_pieces:int,n_unknown:int>")
    def cover(word: pd.Series, found: pd.Series, bounds: pd.Series, hints: pd.Series) -> pd.DataFrame:
        out = []
        for w, s, edges, wanted in zip(word, found, bounds, hints):
            parts = graphemes(w)
            at, place = {0: 0}, 0
            for i, g in enumerate(parts):
                place += len(g)
                at[place] = i + 1
            known = {(at[x["start"]], at[x["end"]]): w[x["start"] : x["end"]] for x in (s if s is not None else []) if x["start"] in at and x["end"] in at}
            got = segment(parts, known, [at[b] for b in (edges if edges is not None else []) if b in at], wanted if wanted is not None else [])
            out.append(("|".join("".join(parts[a:b]) for a, b, _ in got), len(got), sum(not k for _, _, k in got)))
        return pd.DataFrame(out, columns=["pieces", "n_pieces", "n_unknown"])

    asked = spans(words, keys, most)
    if extra:
        asked = asked.join(words.groupBy("lang", "word").agg(*(F.first(c, True).alias(c) for c in extra)), ["lang", "word"])
    given = [F.col("bounds") if "bounds" in extra else F.lit(None).cast("array<int>"), F.col("hints") if "hints" in extra else F.lit(None).cast("array<string>")]
    return asked.withColumn("s", cover(F.col("word"), F.col("spans"), *given)).select("lang", "word", "s.pieces", "s.n_pieces", "s.n_unknown")
