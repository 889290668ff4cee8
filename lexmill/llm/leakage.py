"""Held-out items that stand in training documents (problem 8).

Wu-Manber multi-pattern search over normalised words finds, in one pass over a document, the four-word
patterns of all items: a shift table over hashed character blocks skips positions where no pattern can end,
buckets of the zero-shift blocks with their prefix hash select patterns, and a direct comparison confirms.
An item whose confirmed patterns cover a quarter of its words is then aligned with the document exactly:
passages grow from common three-word runs over single changed, missing or added words.

A passage counts from ``MIN_SCORE`` net words on (one per equal word, less ``PENALTY`` per changed one), so
that instruction lines, stock phrases and short quotations don't count. Such a passage always holds a run of
three equal words, so no passage is missed by its seed. A document holds an item when its passages have at
least half of the item's words.

Whether a document holds an item depends on the two alone: what is skipped before can't reach the quarter, so the
rows are the same for any number of items and any blocks.

Items of up to ``BLOCK_WORDS`` words altogether are compiled into one search, sent to the tasks as a broadcast of
that bounded size, and the documents are read once, without a shuffle. More items are joined: the hashes of their
patterns meet those of the documents, after a bitmap of fixed size has dropped nearly all other hashes, and the
pairs that may share enough patterns are confirmed as above. A pattern of more than ``COMMON`` items (an instruction
line) isn't joined, as it would pair everything; the words that it covers count as held until the pair is confirmed.
Items of which such patterns cover a quarter are searched in blocks. There is no limit on matches.

Words are runs of letters and digits; in scripts written without spaces every character is one.

Cases: null and empty texts match nothing; items under four words have no pattern and match nothing; repeated
documents and repeated items count each, whatever their ids; documents without an id keep their rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.text import words
from lexmill.sources.tables import cut, spread

SIZE = 4
SEED = 3
BLOCK = 9
MIN_SCORE, PENALTY, SHARE, SEED_SHARE = 8, 2, 0.5, 0.25
BLOCK_WORDS = 200_000
COMMON, SHARED = 32, 8
SLOTS = 1 << 21
MEMO = 200_000


class WuManber:
    """Search for many strings at once; ``finditer`` yields the index of each pattern that occurs."""

    def __init__(self, patterns: list[str], block: int = BLOCK):
        self.patterns = patterns
        self.m = min(map(len, patterns), default=0)
        self.block = b = min(block, self.m)
        self.default = self.m - b + 1
        self.shift: dict[str, int] = {}
        self.buckets: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for k, p in enumerate(patterns):
            for q in range(b, self.m + 1):
                piece = p[q - b : q]
                self.shift[piece] = min(self.shift.get(piece, self.default), self.m - q)
            self.buckets[p[self.m - b : self.m]].append((p[:b], k))
        by_prefix: dict[str, dict[str, list[int]]] = {}
        for suffix, entries in self.buckets.items():
            group = by_prefix.setdefault(suffix, {})
            for prefix, k in entries:
                group.setdefault(prefix, []).append(k)
        self.by_prefix = by_prefix

    def finditer(self, text: str):
        if not self.patterns:
            return
        m, b, shift, default = self.m, self.block, self.shift.get, self.default
        at, end = m, len(text)
        while at <= end:
            piece = text[at - b : at]
            step = shift(piece, default)
            if step:
                at += step
                continue
            start = at - m
            for k in self.by_prefix[piece].get(text[start : start + b], ()):
                if text.startswith(self.patterns[k], start):
                    yield k
            at += 1


class Items:
    """A block of compiled items."""

    def __init__(self, rows: list[tuple[int, str]]):
        held = [(i, w) for i, t in rows if len(w := words(t)) >= SIZE]
        self.ids, self.words = [i for i, _ in held], [w for _, w in held]
        places: dict[str, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, w in enumerate(self.words):
            for k, p in enumerate(patterns(w)):
                places[p][i].append(k)
        span = (1 << SIZE) - 1
        #: Per pattern, a bit for every word of an item that it covers.
        self.covers = [{i: reduce(or_, (span << x for x in at)) for i, at in p.items()} for p in places.values()]
        self.shared = [len(p) >= SHARED for p in self.covers]
        self.need = [SEED_SHARE * len(w) for w in self.words]
        self.runs: list[dict[tuple, list[int]]] = []
        for w in self.words:
            own = defaultdict(list)
            for k, run in enumerate(zip(w, w[1:], w[2:])):
                own[run].append(k)
            self.runs.append(own)
        self.pairs = [list(zip(w, w[1:])) for w in self.words]
        self.stock_memo: dict[frozenset[int], tuple[dict[int, int], list[int]]] = {}
        self.kept = 0
        self.search = WuManber(list(places))

    def leaked(self, text: str | None) -> list[int]:
        """Ids of the items that stand in the text."""
        w = words(text)
        if len(w) < SIZE:
            return []
        hits = set(self.search.finditer(" " + " ".join(w) + " "))
        rare = self.covered(k for k in hits if not self.shared[k])
        stock, enough = self.by_stock(frozenset(k for k in hits if self.shared[k]))
        likely = [i for i, bits in rare.items() if (bits | stock.get(i, 0)).bit_count() >= self.need[i]] + [i for i in enough if i not in rare]
        if not likely:
            return []
        known, pairs, runs, index, out = set(w), None, None, None, []
        for i in likely:
            own = self.words[i]
            if sum(map(known.__contains__, own)) < SHARE * len(own):
                continue
            # every word of a passage has an equal one beside it
            pairs = pairs or set(zip(w, w[1:]))
            equal = [*map(pairs.__contains__, self.pairs[i])]
            if sum(map(or_, [False, *equal], [*equal, False])) < SHARE * len(own):
                continue
            runs = runs or set(zip(w, w[1:], w[2:]))
            # passages begin and end in common runs, so they lie between the first and the last
            at = [p for run in self.runs[i].keys() & runs for p in self.runs[i][run]]
            if not at or max(at) + SEED - min(at) < SHARE * len(own):
                continue
            if index is None:
                index = defaultdict(list)
                for j, run in enumerate(zip(w, w[1:], w[2:])):
                    index[run].append(j)
            if len(passages(own, w, index)) >= SHARE * len(own):
                out.append(self.ids[i])
        return out

    def covered(self, hits) -> dict[int, int]:
        """The words of every item that patterns cover, as bits."""
        got: dict[int, int] = {}
        for k in hits:
            for i, bits in self.covers[k].items():
                got[i] = got.get(i, 0) | bits
        return got

    def by_stock(self, hits: frozenset[int]) -> tuple[dict[int, int], list[int]]:
        """The words that stock phrases cover, and the items with enough of them; documents often hold the same phrases."""
        if hits in self.stock_memo:
            return self.stock_memo[hits]
        bits = self.covered(hits)
        got = bits, [i for i, b in bits.items() if b.bit_count() >= self.need[i]]
        if self.kept + len(bits) < MEMO:
            self.kept += len(bits) + 1
            self.stock_memo[hits] = got
        return got


def patterns(w: list[str]) -> list[str]:
    """The patterns of consecutive words, with their bounds."""
    return [" " + " ".join(w[k : k + SIZE]) + " " for k in range(len(w) - SIZE + 1)]


def _extend(a, b, x, y, step):
    """Equal places on one side of a seed, to the best score over single changes."""
    n, m = len(a), len(b)

    def equal(p, q):
        return 0 <= p < n and 0 <= q < m and a[p] == b[q]

    score = best = kept = 0
    got: list[tuple[int, int]] = []
    while 0 <= x < n and 0 <= y < m:
        if a[x] == b[y]:
            score += 1
            got.append((x, y))
            x, y = x + step, y + step
            if score > best:
                best, kept = score, len(got)
            continue
        for dx, dy in ((step, step), (step, 0), (0, step)):
            if equal(x + dx, y + dy) and equal(x + dx + step, y + dy + step):
                x, y = x + dx, y + dy
                break
        else:
            break
        score -= PENALTY
    return best, got[:kept]


def passages(item: list[str], doc: list[str], index) -> set[int]:
    """Places of the item's words that stand in a passage of the document."""
    out: set[int] = set()
    seen: set[tuple[int, int]] = set()
    for x in range(len(item) - SEED + 1):
        for y in index.get((item[x], item[x + 1], item[x + 2]), ()):
            if (x, y) in seen:
                continue
            right, after = _extend(item, doc, x, y, 1)
            left, before = _extend(item, doc, x - 1, y - 1, -1)
            seen.update(after)
            if right + left >= MIN_SCORE:
                out.update(p for p, _ in after)
                out.update(p for p, _ in before)
    return out


def blocks(items: DataFrame, block_words: int = BLOCK_WORDS):
    """The items as lists of (id, text) of at most ``block_words`` words, or one item where it is longer."""
    got, size = [], 0
    for r in items.toLocalIterator():
        n = len(words(r.text))
        if got and size + n > block_words:
            yield got
            got, size = [], 0
        got.append((r.item_id, r.text))
        size += n
    yield got


def _lists(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch[n].to_pylist() for n in names]


def _pairs(rows) -> pa.RecordBatch:
    """A batch of (doc_id, item_id); ids may be null."""
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["doc_id", "item_id"])


def scanned(docs: DataFrame, items: DataFrame, block_words: int) -> DataFrame:
    """doc_id, item_id by one scan of the documents per block of items."""

    def scan(block):
        given = docs.sparkSession.sparkContext.broadcast({"rows": block})

        def run(batches):
            held = given.value
            if "items" not in held:  # once per worker
                held["items"] = Items(held["rows"])
            for batch in batches:
                yield _pairs((d, i) for d, t in zip(*_lists(batch, "doc_id", "text")) for i in held["items"].leaked(t))

        return docs.mapInArrow(run, "doc_id bigint, item_id bigint")

    return reduce(DataFrame.unionByName, [scan(b) for b in blocks(items, block_words)])


def hashed(w: list[str]) -> np.ndarray:
    """Hashes of the patterns of consecutive words."""
    return np.array([xxhash.xxh3_64_intdigest(p) for p in patterns(w)], dtype=np.uint64).view(np.int64)


def joined(docs: DataFrame, items: DataFrame, block_words: int) -> DataFrame:
    """doc_id, item_id by joining pattern hashes."""
    spark = docs.sparkSession
    rows = cut(items.withColumn("row", F.monotonically_increasing_id()))

    def of_items(batches):
        for batch in batches:
            out = []
            for i, t in zip(batch["row"], batch["text"]):
                if len(w := words(t)) >= SIZE:
                    at = defaultdict(list)
                    for k, h in enumerate(hashed(w).tolist()):
                        at[h].append(k)
                    out += [(i, h, SEED_SHARE * len(w), len(p), sorted({x + y for x in p for y in range(SIZE)})) for h, p in at.items()]
            yield pd.DataFrame(out, columns=["row", "h", "need", "n", "covers"])

    pieces = cut(rows.mapInPandas(of_items, "row bigint, h bigint, need double, n bigint, covers array<bigint>"))
    common = pieces.groupBy("h").agg(F.count(F.lit(1)).alias("n_items")).where(F.col("n_items") > COMMON).select("h")
    covered = cut(pieces.join(common, "h", "left_semi").groupBy("row").agg(F.size(F.array_distinct(F.flatten(F.collect_list("covers")))).alias("covered"), F.first("need").alias("need")))
    left = F.col("need") - F.coalesce("covered", F.lit(0))  # what other patterns must cover
    rare = pieces.join(common, "h", "left_anti").join(covered.drop("need"), "row", "left").select("row", "h", "n", left.alias("need"))
    chosen = cut(rare.where("need > 0"))
    slot = F.pmod("h", F.lit(SLOTS))
    held = chosen.select(slot.cast("int").alias("slot"), F.expr("shiftleft(1L, cast(pmod(shiftright(h, 32), 64) as int))").alias("bits")).groupBy("slot").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(SLOTS, dtype=np.int64)
    table[held["slot"].to_numpy()] = held["bits"].to_numpy()
    given = spark.sparkContext.broadcast(table)

    def of_docs(batches):
        bits = given.value.view(np.uint64)
        for batch in batches:
            ids, got = [], []
            for d, t in zip(*_lists(batch, "doc_id", "text")):
                h = np.unique(hashed(words(t)))
                h = h[(bits[h % SLOTS] >> ((h >> 32) % 64).astype(np.uint64)) & np.uint64(1) == 1] if len(h) else h
                ids += [d] * len(h)
                got += h.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(got, pa.int64())], ["doc_id", "h"])

    meets = docs.mapInArrow(of_docs, "doc_id bigint, h bigint").join(chosen, "h").groupBy("doc_id", "row", "need").agg(F.sum("n").alias("n"))
    likely = cut(meets.where(SIZE * F.col("n") >= F.col("need")).select(F.col("doc_id").alias("of_doc"), "row"))
    pairs = likely.join(rows.withColumnRenamed("text", "item"), "row").join(docs, F.col("of_doc").eqNullSafe(F.col("doc_id")))

    def confirm(batches):
        for batch in batches:
            yield _pairs((d, i) for d, i, item, t in zip(*_lists(batch, "doc_id", "item_id", "item", "text")) if Items([(i, item)]).leaked(t))

    found_ = pairs.select("doc_id", "item_id", "item", "text").mapInArrow(confirm, "doc_id bigint, item_id bigint")
    rest = rows.join(covered.where("covered >= need"), "row", "left_semi").select("item_id", "text")
    return found_ if rest.isEmpty() else found_.unionByName(scanned(docs, rest, block_words))


def found(documents: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id of every document and leaked item."""
    docs = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null"))
    wanted = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    n_words = wanted.agg(F.sum(F.size(F.split("text", "\\s+")))).head()[0] or 0
    return (scanned if n_words <= block_words else joined)(docs, wanted, block_words)


def report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """Per suite and item: the number of documents it leaked into, 0 included."""
    hits = leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return items.select("suite", "item_id").join(hits, "item_id", "left").select("suite", "item_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
