"""Alignments of strings and token sequences."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def align(probe: str, surface: str) -> tuple[int, int, list[int]]:
    """(matched characters, edits, place in the surface of every probe character) of the best alignment.

    Most matched characters first, then fewest edits. An unmatched character takes the place of the last
    one before it.
    """
    n, m = len(probe), len(surface)
    table = [[(0, 0)] * (m + 1) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            options = []
            if i < n and j < m:
                same = probe[i] == surface[j]
                a, b = table[i + 1][j + 1]
                options.append((a + same, b - (not same)))
            if i < n:
                a, b = table[i + 1][j]
                options.append((a, b - 1))
            if j < m:
                a, b = table[i][j + 1]
                options.append((a, b - 1))
            if options:
                table[i][j] = max(options)
    places, i, j, last = [], 0, 0, 0
    while i < n:
        value = table[i][j]
        if j < m:
            same = probe[i] == surface[j]
            a, b = table[i + 1][j + 1]
            if (a + same, b - (not same)) == value:
                places.append(j)
                i, j, last = i + 1, j + 1, j
                continue
            a, b = table[i][j + 1]
            if (a, b - 1) == value:
                j, last = j + 1, j
                continue
        places.append(last)
        i += 1
    matched, edits = table[0][0]
    return matched, -edits, places


def partition(probes: list[str], surface: str) -> list[tuple[int, int]] | None:
    """Contiguous slices of the surface for each probe that cover it all.

    Most exact slices first, then most matched characters, then fewest edits; every non-empty probe gets at
    least one character. None where the surface is too short.
    """
    if "".join(probes) == surface:
        out, at = [], 0
        for p in probes:
            out.append((at, at + len(p)))
            at += len(p)
        return out
    m = len(surface)
    memo: dict[tuple[str, int, int], tuple[int, int, int]] = {}

    def value(p: str, a: int, b: int):
        got = memo.get((p, a, b))
        if got is None:
            matched, edits, _ = align(p, surface[a:b])
            got = memo[p, a, b] = (int(p == surface[a:b]), matched, -edits)
        return got

    best: dict[int, tuple[tuple[int, int, int], list]] = {0: ((0, 0, 0), [])}
    for p in probes:
        after: dict[int, tuple[tuple[int, int, int], list]] = {}
        for a, (score, cuts) in best.items():
            for b in range(a + 1, m + 1) if p else (a,):
                total = tuple(x + y for x, y in zip(score, value(p, a, b)))
                if b not in after or total > after[b][0]:
                    after[b] = total, [*cuts, (a, b)]
        best = after
    return best[m][1] if m in best else None


def normalised_with_map(text: str) -> tuple[str, list[int]]:
    """NFKC per character, with the source place of every character that comes out."""
    out, places = [], []
    for i, c in enumerate(text):
        for x in unicodedata.normalize("NFKC", c):
            out.append(x)
            places.append(i)
    return "".join(out), places


def agreement(left: list[str], right: list[str]) -> dict[str, float]:
    """Same and differing items of two sequences by matched blocks."""
    matcher = difflib.SequenceMatcher(None, left, right, autojunk=False)
    same = sum(b.size for b in matcher.get_matching_blocks())
    total = max(len(left), len(right))
    return {"same": same, "diff": total - same, "total": total, "same_percent": round(100 * same / total, 2) if total else 100.0}


def drift(left: list[str], right: list[str], ahead: int = 3) -> list[tuple[int, int]]:
    """Pairs of equal tokens of two tokenisations, looking up to ``ahead`` tokens past a difference."""
    i = j = 0
    out = []
    while i < len(left) and j < len(right):
        if left[i] == right[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
            continue
        for k in range(1, ahead + 1):
            if i + k < len(left) and left[i + k] == right[j]:
                i += k
                break
            if j + k < len(right) and left[i] == right[j + k]:
                j += k
                break
        else:
            i, j = i + 1, j + 1
    return out


def beam(slots: list[list[tuple[str, int]]], width: int = 8) -> list[str]:
    """One candidate (id, position) per slot with rising positions and each id once, by beam search.

    Slots that nothing fits stay empty; the fullest, then the leftmost path wins.
    """
    paths: list[tuple[int, int, tuple[str, ...]]] = [(0, -1, ())]
    for slot in slots:
        grown = [(n, last, (*ids, "")) for n, last, ids in paths]
        grown += [(n + 1, at, (*ids, i)) for n, last, ids in paths for i, at in slot if at > last and i not in ids]
        grown.sort(key=lambda p: (-p[0], p[1], p[2]))
        paths = grown[:width]
    return list(paths[0][2])


def batches(lengths: list[int], most: int = 16, overhead: int = 32) -> list[tuple[int, int]]:
    """[start, end) of the batches of least total cost (T16): items times the last one's length, and an overhead each.

    Lengths are taken in the order given, those of 0 left out; the latest start wins among equals.
    """
    own = [n for n in lengths if n and n > 0]
    cost, start = [0] + [0] * len(own), [0] * (len(own) + 1)
    for end in range(1, len(own) + 1):
        options = [(cost[a] + (end - a) * own[end - 1] + overhead, -a) for a in range(max(0, end - most), end)]
        cost[end], a = min(options)
        start[end] = -a
    out, at = [], len(own)
    while at:
        out.append((start[at], at))
        at = start[at]
    return out[::-1]


def batches_column(lengths: Column, most: int = 16, overhead: int = 32) -> Column:
    """``batches`` as a vectorised column."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in batches([int(x) for x in v], most, overhead)] for v in values], dtype=object)

    return run(lengths)


def drift_column(left: Column, right: Column, ahead: int = 3) -> Column:
    """``drift`` as a vectorised column of pairs."""

    @F.pandas_udf("array<struct<left:int,right:int>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"left": i, "right": j} for i, j in drift(list(x), list(y), ahead)] for x, y in zip(a, b)], dtype=object)

    return run(left, right)


def normalised_column(text: Column) -> Column:
    """``normalised_with_map`` as a vectorised column: text, places."""

    @F.pandas_udf("struct<text:string,places:array<int>>")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([normalised_with_map(v or "") for v in values], columns=["text", "places"])

    return run(text)


def surface_parts(surface: str, parts: list[str]) -> tuple[str, list[tuple[int, int, tuple[int, ...]]]]:
    """How the characters of a surface belong to the parts of its analysis (T17): the basis, and (start, end, parts) of each group.

    Parts that make up the surface exactly are ``exact``. Else the decomposed characters (syllables fall into their letters) are cut by
    ``partition``, the basis being ``units``; a character whose letters belong to several parts belongs to all of them. Where no letter
    agrees, the surface is divided in proportion to the lengths of the parts.
    """
    parts = [p for p in parts if p]
    if not surface or not parts:
        return "none", []
    owner: list[set[int]] = [set() for _ in surface]
    units = [(u, i) for i, c in enumerate(surface) for u in unicodedata.normalize("NFD", c)]
    text, own = "".join(u for u, _ in units), [unicodedata.normalize("NFD", p) for p in parts]
    cuts = partition(own, text) if len(text) >= len(own) else None
    if cuts is not None and any(align(p, text[a:b])[0] for p, (a, b) in zip(own, cuts)):
        basis = "exact" if "".join(own) == text else "units"
        for k, (a, b) in enumerate(cuts):
            for _, i in units[a:b]:
                owner[i].add(k)
    else:
        basis, at, whole = "proportional", 0, sum(map(len, parts))
        for k, p in enumerate(parts):
            last = k == len(parts) - 1
            size = len(surface) - at if last else min(max(1, (2 * len(surface) * len(p) + whole) // (2 * whole)), len(surface) - at)
            for i in range(at, at + size):
                owner[i].add(k)
            at += size
        owner = [o or {len(parts) - 1} for o in owner]
    groups: list[tuple[int, int, tuple[int, ...]]] = []
    for i, o in enumerate(owner):
        ids = tuple(sorted(o))
        if groups and groups[-1][2] == ids:
            groups[-1] = (groups[-1][0], i + 1, ids)
        else:
            groups.append((i, i + 1, ids))
    return basis, groups


def surface_parts_column(surface: Column, parts: Column) -> Column:
    """``surface_parts`` as a vectorised column."""

    @F.pandas_udf("struct<basis:string,groups:array<struct<start:int,end:int,parts:array<int>>>>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        got = [surface_parts(s or "", list(p) if p is not None else []) for s, p in zip(a, b)]
        return pd.DataFrame([(basis, [{"start": x, "end": y, "parts": list(ids)} for x, y, ids in groups]) for basis, groups in got], columns=["basis", "groups"])

    return run(surface, parts)


def align_column(probe: Column, surface: Column) -> Column:
    """``align`` as a vectorised column, once per distinct pair of a batch; places is the character map."""

    @F.pandas_udf("struct<matched:int,edits:int,places:array<int>>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        seen: dict = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna("")):
            if pair not in seen:
                seen[pair] = align(*pair)
            out.append(seen[pair])
        return pd.DataFrame(out, columns=["matched", "edits", "places"])

    return run(probe, surface)


def partition_column(probes: Column, surface: Column) -> Column:
    """``partition`` as a vectorised column of slices."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e} for s, e in (partition(list(p), t) or [])] for p, t in zip(a, b)], dtype=object)

    return run(probes, surface)


def agreement_column(left: Column, right: Column) -> Column:
    """``agreement`` as a vectorised column."""

    @F.pandas_udf("struct<same:int,diff:int,total:int,same_percent:double>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([agreement(list(x), list(y)) for x, y in zip(a, b)], columns=["same", "diff", "total", "same_percent"])

    return run(left, right)
