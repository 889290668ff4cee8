"""Occurrences and record frequency of every term (problem 7).

Vertical layout: every task turns its rows into one compressed bitmap of record ids per (term, chunk of
65,536 ids), with an occurrence counter beside it. A bitmap is a sorted list of 16-bit numbers up to 4,096
ids and 8 KB of bits beyond. Bitmaps of the same term and chunk are brought together, sorted and merged by
union in one streaming pass; the chunks of a term are disjoint, so its record frequency is the sum of their
cardinalities. A frequent term is spread over as many keys as it has chunks, and no key holds more than 8 KB
per task that saw it.

Cases: null and empty values have no terms; a term that stands twice in a record counts twice as occurrence
and once as record; rows without an id count as a record each; null weights count 0; empty tables give
no terms.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.sources.tables import spread

CHUNK_BITS = 16
ARRAY_MOST = 4096
FLUSH_IDS = 2_000_000
_SCHEMA = "term string, chunk bigint, occurrences bigint, bits binary"


def folded(value: str) -> str:
    """NFKC, trimmed, case-folded."""
    return unicodedata.normalize("NFKC", value).strip().casefold()


def pack(low: np.ndarray) -> bytes:
    """Sorted distinct 16-bit numbers as an array or as bits, whichever is smaller."""
    if len(low) <= ARRAY_MOST:
        return b"A" + low.astype("<u2").tobytes()
    bits = np.zeros(1 << CHUNK_BITS, np.uint8)
    bits[low] = 1
    return b"B" + np.packbits(bits).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    """The numbers in a packed bitmap."""
    if packed[:1] == b"A":
        return np.frombuffer(packed, "<u2", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, offset=1))).astype("<u2")


def union(parts: list[bytes]) -> bytes:
    """The union of packed bitmaps."""
    if len(parts) == 1:
        return parts[0]
    bits = np.zeros(1 << CHUNK_BITS, np.uint8)
    for p in parts:
        bits[unpack(p)] = 1
    return pack(np.flatnonzero(bits))


def cardinality(packed: bytes) -> int:
    """How many numbers a packed bitmap holds."""
    if packed[:1] == b"A":
        return (len(packed) - 1) // 2
    return int(np.unpackbits(np.frombuffer(packed, np.uint8, offset=1)).sum())


def bitmaps(rows: DataFrame, terms_of: Callable[[str], list[str]]) -> DataFrame:
    """Partial bitmaps of each task: term, chunk, occurrences, bits. ``rows`` has id, value and weight."""

    def flush(held: dict[str, list]) -> pd.DataFrame:
        out = []
        for term, (ids, occurrences) in held.items():
            at, weights = np.concatenate(ids), np.concatenate(occurrences)
            order = np.argsort(at, kind="stable")
            at, weights = at[order], weights[order]
            chunks = at >> CHUNK_BITS
            starts = np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(at)]):
                out.append((term, int(chunks[a]), int(weights[a:b].sum()), pack(np.unique(at[a:b] & 0xFFFF))))
        return pd.DataFrame(out, columns=["term", "chunk", "occurrences", "bits"])

    def run(batches):
        memo: dict[str, list[str]] = {}
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            codes, values = pd.factorize(batch["value"])
            order = np.argsort(codes, kind="stable")
            ids, weights = batch["id"].to_numpy("int64")[order], batch["weight"].to_numpy("int64")[order]
            bounds = np.searchsorted(codes[order], np.arange(len(values) + 1))
            for k, value in enumerate(values):
                terms = memo.get(value)
                if terms is None:
                    terms = terms_of(value)
                    if len(memo) < 100_000 and len(value) < 1000:
                        memo[value] = terms
                a, b = bounds[k], bounds[k + 1]
                for term in terms:
                    got = held.setdefault(term, [[], []])
                    got[0].append(ids[a:b])
                    got[1].append(weights[a:b])
                    size += b - a
            if size > FLUSH_IDS:
                yield flush(held)
                held, size = {}, 0
        yield flush(held)

    return spread(rows).mapInPandas(run, _SCHEMA)


def merged(partial: DataFrame) -> DataFrame:
    """One bitmap per term and chunk: term, chunk, occurrences, records, bits."""

    def run(batches):
        key, count, parts = None, 0, []
        for batch in batches:
            out = []
            for term, chunk, n, bits in zip(batch["term"], batch["chunk"], batch["occurrences"], batch["bits"]):
                if (term, chunk) != key:
                    if key is not None:
                        u = union(parts)
                        out.append((*key, count, cardinality(u), u))
                    key, count, parts = (term, chunk), 0, []
                elif len(parts) >= 64:
                    parts = [union(parts)]
                count += n
                parts.append(bytes(bits))
            yield pd.DataFrame(out, columns=["term", "chunk", "occurrences", "records", "bits"])
        if key is not None:
            u = union(parts)
            yield pd.DataFrame([(*key, count, cardinality(u), u)], columns=["term", "chunk", "occurrences", "records", "bits"])

    return partial.repartition("term", "chunk").sortWithinPartitions("term", "chunk").mapInPandas(run, "term string, chunk bigint, occurrences bigint, records bigint, bits binary")


def frequencies(df: DataFrame, id_col, value_col: str, terms_of: Callable[[str], list[str]], weight_col: str | None = None) -> DataFrame:
    """term, occurrences, records over all rows of ``df``."""
    identity = F.coalesce(id_col, -F.monotonically_increasing_id() - 1)
    weight = F.coalesce(F.col(weight_col).cast("bigint"), F.lit(0)) if weight_col else F.lit(1)
    rows = df.select(identity.cast("bigint").alias("id"), F.col(value_col).cast("string").alias("value"), weight.cast("bigint").alias("weight")).where("value is not null and value <> ''")
    return merged(bitmaps(rows, terms_of)).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(counts: DataFrame, count_col: str, total, rare_below: int = 5, common_share: float = 0.1) -> DataFrame:
    """term, mark of the terms that are too rare or too common."""
    mark = F.when(F.col(count_col) < rare_below, F.lit("rare")).when(F.col(count_col) > F.lit(common_share) * total, F.lit("common"))
    return counts.select("term", mark.alias("mark")).where("mark is not null")
