"""Subject areas of documents (problem 10).

The unit is the paragraph. Paragraph vectors over a vocabulary of content terms are normalised and clustered
by bisecting k-means (cosine); the leaf that is least settled on a subject is split next. A leaf is labelled by
its discriminative terms, those that stand in it more often than elsewhere: they give it a mixture over the
subjects, which its terms learned from the labelled examples. Leaves in turn give subjects to corpus terms that
the examples hold too rarely. A document's subjects are read off the mixtures of the leaves that its paragraphs
fall into: only subjects with ``LEAST_MIX`` of a leaf's mixture are open to its paragraphs, and among them the
posterior decides, mixture times the likelihood of the sentences. It counts when enough of the paragraph's own
sentences vote for it (``least_votes``); so a passing mention, or sentences about the reading, don't.

A line feed ends a paragraph. In texts with blank lines, one inside a sentence is only a wrapped line.

Scale: all examples are counted, and the tree and its mixtures are fitted on all paragraphs. These are packed once as
arrays of term numbers and weights, and stay distributed; the leaves that may be split next are split together, and a
pass over the rows of open leaves brings their sums, counts or least similar rows. Once open leaves hold no more than
``NEAR`` terms, the driver makes the same passes over them itself. Sums are of whole numbers, so that neither this nor
the partitions change the tree. Corpus terms need a share of at least ``LEAST_SHARE`` of all paragraphs, so the
vocabulary, the tree and what a pass brings to the driver have a size that doesn't grow with the corpus.

Cases: null and empty texts have no subject; repeated documents count each; without examples nothing is
assigned; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.text import words
from lexmill.sources.tables import cut, drop, spread

LEAST_SHARE, LEAST_PARAGRAPHS = 0.0004, 5
LEAVES, ITERATIONS, LEAST_LEAF = 256, 8, 20
STEPS = float(1 << 24)  # weights are summed in such steps
LEAST_MIX, SETTLED, LIFT = 0.05, 0.98, 1.5
LEAST_SENTENCES = 3
UNKNOWN_WEIGHT, KNOWN_FROM = 0.3, 3
SENTENCE = re.compile(r"(?<=[.!?…])\s+")
SMOOTHING = 0.01
#: A line after which the next one isn't wrapped: it ends with a sentence, or holds nothing.
_ENDED = re.compile(r"(?:^|[.!?…])[\"'”’»)\]]{0,2}[ \t]{0,8}$")


def parts_of(text: str | None) -> list[str]:
    """The non-blank paragraphs of a text."""
    if not text:
        return []
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if "\r" in text else text.split("\n")
    if len(lines) > 2 and not all(line.strip(" \t") for line in lines[1:-1]):
        joined = [lines[0]]
        for line in lines[1:]:
            if line.strip(" \t") and not _ENDED.search(joined[-1]):
                joined[-1] += " " + line
            else:
                joined.append(line)
        lines = joined
    return [line for line in lines if line.strip(" ")]


def _texts(documents: DataFrame) -> DataFrame:
    return spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null"))


def paragraphs(documents: DataFrame) -> DataFrame:
    """doc_id and text of every non-blank paragraph."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([(d, p) for d, t in zip(batch["doc_id"], batch["text"]) for p in parts_of(t)], columns=["doc_id", "paragraph"])

    return _texts(documents).mapInPandas(run, "doc_id bigint, paragraph string")


def least_votes(n_sentences: int) -> int:
    """Sentences that must vote for a subject: half of the paragraph's, but two at least and ``LEAST_SENTENCES`` at most."""
    return max(2, min(LEAST_SENTENCES, (n_sentences + 1) // 2))


def term_shares(docs: DataFrame) -> tuple[dict[str, float], int]:
    """Paragraph shares of the terms at or above the least share, and the number of paragraphs."""

    def count(batches):
        for batch in batches:
            got: Counter = Counter()
            for text in batch["text"]:
                for part in parts_of(text):
                    got.update({w for w in words(part) if len(w) > 2})
                    got[""] += 1
            yield pd.DataFrame(list(got.items()), columns=["term", "n"])

    counts = docs.select("text").mapInPandas(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    total = counts.where("term = ''").select("n").head()
    kept = counts.where(F.col("n") >= max(LEAST_PARAGRAPHS, LEAST_SHARE * (total.n if total else 0))).collect()
    shares = {r.term: r.n for r in kept}
    n = shares.pop("", 0)
    return {t: c / n for t, c in shares.items()}, n


def uses(seeds) -> list[tuple[str, str, int]]:
    """(word, subject, sentences with it) over labelled examples; the empty word counts the examples."""
    got: Counter = Counter()
    for text, subject in seeds:
        got["", subject] += 1
        for sentence in SENTENCE.split(text):
            got.update((w, subject) for w in set(words(sentence)))
    return [(w, s, n) for (w, s), n in got.items()]


def lexicon_of(seeds: DataFrame) -> Lexicon:
    """The lexicon of all examples; words that stand in one sentence only say nothing and aren't collected."""

    def count(batches):
        for batch in batches:
            yield pd.DataFrame(uses(zip(batch["text"], batch["subject"])), columns=["term", "subject", "n"])

    labelled = seeds.select("text", "subject").where("text is not null and subject is not null")
    counts = labelled.mapInPandas(count, "term string, subject string, n bigint").groupBy("term", "subject").agg(F.sum("n").alias("n"))
    kept = counts.withColumn("of_all", F.sum("n").over(Window.partitionBy("term"))).where("of_all > 1 or term = ''")
    return Lexicon([], sorted((r.term, r.subject, r.n) for r in kept.collect()))


class Lexicon:
    """Subjects of terms: counts from labelled sentences, later also from leaves."""

    def __init__(self, seeds: list[tuple[str, str]], counted: list[tuple[str, str, int]] = ()):
        self.subjects = sorted({s for _, s in seeds} | {s for _, s, _ in counted})
        counts: dict[str, Counter] = defaultdict(Counter)
        for w, subject, n in (*uses(seeds), *counted):
            counts[w][subject] += n
        self.seen = {w: sum(c.values()) for w, c in counts.items()}
        self.of: dict[str, dict[str, float]] = {}
        few = max(1, len(self.subjects) // 3)
        for w, c in counts.items():
            n = self.seen[w]
            if n >= 2 and len(w) > 2 and len(c) <= few and max(c.values()) >= 0.3 * n:
                self.of[w] = {s: v / n for s, v in c.items()}

    def weight(self, term: str) -> float:
        """How much a term tells about the subject: by its spread over them, little for unknown terms."""
        if term in self.of:
            h = -sum(p * math.log(p) for p in self.of[term].values() if p)
            return max(0.1, 1 - h / math.log(max(2, len(self.subjects))))
        return UNKNOWN_WEIGHT if self.seen.get(term, 0) < KNOWN_FROM else 0.0

    def learn(self, by_leaf: list[dict[str, int]]) -> list[dict[str, float]]:
        """Mixtures of leaves from their terms' paragraph counts; unknown terms get their leaves' subjects.

        A leaf's discriminative terms are those whose share of the leaf is ``LIFT`` times their share of all.
        """
        everywhere: Counter = Counter()
        for terms in by_leaf:
            everywhere.update(terms)
        whole = sum(everywhere.values()) or 1
        mixed, leaves = [], defaultdict(Counter)
        for leaf, terms in enumerate(by_leaf):
            size, mixture = sum(terms.values()) or 1, Counter()
            for term, n in terms.items():
                leaves[term][leaf] += n
                if len(by_leaf) == 1 or n * whole >= LIFT * everywhere[term] * size:
                    for s, p in self.of.get(term, {}).items():
                        mixture[s] += n * p * self.weight(term)
            mixed.append({s: v / sum(mixture.values()) for s, v in mixture.items()})
        for term, at in leaves.items():
            if term in self.of or self.seen.get(term, 0) >= KNOWN_FROM:
                continue
            total, q = sum(at.values()), Counter()
            for leaf, n in at.items():
                for s, p in mixed[leaf].items():
                    q[s] += n / total * p
            if q and q.most_common(1)[0][1] >= 0.7:
                self.of[term] = dict(q.most_common(1))
        return mixed

    def subject(self, sentences: list[list[str]], mixture: dict[str, float]) -> tuple[str, int] | None:
        """The subject of the leaf's mixture with the highest posterior, mixture times likelihood of the sentences, and its votes."""
        votes: Counter = Counter()
        score = {s: math.log(p) for s, p in mixture.items() if p >= LEAST_MIX}
        for terms in sentences:
            got: Counter = Counter()
            for t in terms:
                for s, p in self.of.get(t, {}).items():
                    got[s] += p
            votes.update(got.keys())
            whole = sum(got.values()) + SMOOTHING * len(self.subjects)
            for s in score:
                score[s] += math.log((got[s] + SMOOTHING) / whole)
        if not score:
            return None
        best = max(score, key=lambda s: (score[s], s))
        return best, votes[best]


class Rows:
    """Normalised sparse vectors: row, term and weight of every value that isn't 0."""

    def __init__(self, terms: list[list[str]], weights: dict[str, tuple[int, float]]):
        row, at, value = [], [], []
        for k, own in enumerate(terms):
            for t in own:
                if t in weights:
                    j, w = weights[t]
                    row.append(k), at.append(j), value.append(w)
        self.n, self.row, self.term = len(terms), np.array(row, dtype=np.int64), np.array(at, dtype=np.int64)
        raw = np.array(value, dtype=np.float64)
        # a term that stands several times in a row counts with its sum
        key = self.row * (len(weights) + 1) + self.term
        kept, back = np.unique(key, return_inverse=True)
        self.row, self.term = np.divmod(kept, len(weights) + 1)
        raw = np.bincount(back.ravel(), raw, len(kept)) if len(kept) else raw
        norm = np.sqrt(np.bincount(self.row, raw * raw, self.n))
        self.value = raw / norm[self.row] if len(kept) else raw
        self.empty = norm == 0


class Tree:
    """Bisecting k-means over rows of unit length."""

    def __init__(self, axes: np.ndarray, children: np.ndarray):
        self.axes, self.children = axes, children  # per inner node: the axis between its two centres; child < 0 is leaf -1 - child

    def leaves(self, rows: Rows) -> np.ndarray:
        """The leaf of every row, -1 for rows without any known term."""
        at = np.zeros(rows.n, dtype=np.int64)
        if not len(self.axes):
            return np.where(rows.empty, -1, 0)
        row, term, value = rows.row, rows.term, rows.value
        while len(row):
            node = at[row]
            side = np.bincount(row, value * self.axes[node, term], rows.n) <= 0
            moving = np.zeros(rows.n, dtype=bool)
            moving[row] = True
            at = np.where(moving, self.children[np.maximum(at, 0), side.astype(np.int64)], at)
            going = at[row] >= 0
            row, term, value = row[going], term[going], value[going]
        return np.where(rows.empty, -1, -1 - at)


def _halves(row, term, value, n, size, rng) -> tuple[np.ndarray, np.ndarray] | None:
    """Which of ``n`` rows lie nearer the first of two centres, and the axis between the centres."""

    def nearest(centre):
        return np.bincount(row, value * centre[term], n)

    def vector(k):
        v = np.zeros(size)
        v[term[row == k]] = value[row == k]
        return v

    first = vector(int(np.argmin(nearest(vector(int(rng.integers(n)))))))
    axis = first - vector(int(np.argmin(nearest(first))))
    left = None
    for _ in range(ITERATIONS):
        new = np.bincount(row, value * axis[term], n) > 0
        if new.all() or not new.any() or (left is not None and (new == left).all()):
            break
        left = new
        of = left[row]
        a, b = (np.bincount(term[x], value[x], size) for x in (of, ~of))
        axis = a / (np.linalg.norm(a) or 1) - b / (np.linalg.norm(b) or 1)
    if left is None:
        return None
    left = np.bincount(row, value * axis[term], n) > 0
    return None if left.all() or not left.any() else (left, axis)


def best_first(size: int, root, split) -> tuple[Tree, list]:
    """The tree that splits the leaf with most unsettled rows next, and its leaves.

    A leaf is (number of rows, share of its leading subject, its own data). ``split(leaves)`` gives for each, the most
    unsettled first, its axis and two leaves, or None. It may be asked for more than are needed in the end.
    """
    members, done, axes, children, inner, named = {0: root}, {}, [], [], {}, 1
    open_ = {0: root[0] * (1 - root[1])}
    while open_ and len(members) < LEAVES:
        k = max(open_, key=lambda x: (open_[x], -x))
        if open_[k] <= 0:
            break
        if members[k][0] < 2 * LEAST_LEAF:
            del open_[k]
            continue
        if k not in done:
            wanted = sorted((x for x, n in open_.items() if n > 0 and x not in done and members[x][0] >= 2 * LEAST_LEAF), key=lambda x: (-open_[x], x))[: LEAVES - len(members)]
            done.update(zip(wanted, split([members[x] for x in wanted])))
        del open_[k]
        got = done.pop(k)
        if got is None:
            continue
        inner[k] = len(axes)
        axes.append(got[0])
        children.append((named, named + 1))
        for leaf in got[1:]:
            members[named] = leaf
            open_[named] = leaf[0] * (1 - leaf[1]) if leaf[1] < SETTLED else 0.0
            named += 1
        del members[k]
    place = {k: j for j, k in enumerate(members)}
    table = np.array([[inner[c] if c in inner else -1 - place[c] for c in pair] for pair in children], dtype=np.int64).reshape(-1, 2)
    return Tree(np.array(axes).reshape(len(axes), size), table), list(members.values())


def grown(rows: Rows, size: int, settled) -> tuple[Tree, list[np.ndarray]]:
    """The tree over rows in memory with known terms, and the rows of every leaf.

    ``settled(members)`` gives the share of the leading subject in a leaf.
    """
    rng = np.random.default_rng(7)
    order = np.argsort(rows.row, kind="stable")
    row, term, value = rows.row[order], rows.term[order], rows.value[order]

    def leaf(own):
        return len(own), settled(own), own

    def halved(own):
        place = np.full(rows.n, -1)
        place[own] = np.arange(len(own))
        of = place[row] >= 0
        got = _halves(place[row[of]], term[of], value[of], len(own), size, rng)
        return None if got is None or min(got[0].sum(), (~got[0]).sum()) < 2 else (got[1], leaf(own[got[0]]), leaf(own[~got[0]]))

    tree, leaves = best_first(size, leaf(np.flatnonzero(~rows.empty)), lambda some: [halved(own) for _, _, own in some])
    return tree, [own for _, _, own in leaves]


def _sentences(paragraph: str, kept) -> list[list[str]]:
    return [t for s in SENTENCE.split(paragraph) if (t := sorted({w for w in words(s) if w in kept}))]


GROUP = 1_000_000  # terms that are packed together
NEAR = 8_000_000  # terms, at eight bytes each
PACKED = "n bigint, sizes binary, terms binary, weights binary, nodes binary, keys binary"


def packed(docs: DataFrame, place: dict[str, int], weight: np.ndarray) -> DataFrame:
    """All paragraphs with a weighted term, as arrays: terms of each, their numbers and normalised weights, node 0, a hash of the text."""

    def group(sizes, terms, times, keys):
        sizes, terms, keys = np.array(sizes, np.int32), np.array(terms, np.int32), np.array(keys, np.int64)
        raw, row = weight[terms] * np.array(times, np.float64), np.repeat(np.arange(len(sizes)), sizes)
        norm = np.sqrt(np.bincount(row, raw * raw, len(sizes)))
        known = norm > 0
        of = known[row]
        value = (raw[of] / norm[row[of]]).astype(np.float32)
        return _packed_batch(sizes[known], terms[of], value, np.zeros(known.sum(), np.int32), keys[known])

    def run(batches):
        sizes, terms, times, keys = got = [], [], [], []
        for batch in batches:
            for text in batch["text"].to_pylist():
                for part in parts_of(text):
                    own = Counter(t for x in _sentences(part, place) for t in x)
                    if own:
                        sizes.append(len(own))
                        keys.append(xxhash.xxh64_intdigest(part) >> 1)
                        terms += [place[t] for t in own]
                        times += own.values()
                if len(terms) > GROUP:
                    yield group(*got)
                    for x in got:
                        x.clear()
        yield group(*got)

    return cut(docs.select("text").mapInArrow(run, PACKED))


def _packed_batch(sizes, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([len(sizes)], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in (sizes, *arrays))], [c.split()[0] for c in PACKED.split(", ")])


def _unpacked(batches):
    """sizes, terms, weights, nodes, keys of every group of rows."""
    for batch in batches:
        for own in zip(*(batch[k].to_pylist() for k in range(1, 6))):
            yield tuple(np.frombuffer(b, t) for b, t in zip(own, (np.int32, np.int32, np.float32, np.int32, np.int64)))


def _sides(sizes, terms, weights, slot, axes):
    """Of rows with a slot: row of each value, and the product of each row with its slot's axis."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.bincount(row, weights * axes[slot[row], terms], len(sizes))


def _chosen(own, slots):
    """The rows of the nodes that have a slot."""
    sizes, terms, weights, nodes, keys = own
    slot = slots[nodes]
    of = slot >= 0
    if of.all():
        return sizes, terms, weights, slot, keys
    inside = np.repeat(of, sizes)
    return sizes[of], terms[inside], weights[inside], slot[of], keys[of]


def _partial(groups, slots: np.ndarray, axes: np.ndarray, what: str) -> tuple[dict[int, tuple], dict[int, np.ndarray]]:
    """slot -> (score, hash, terms and weights) of the row least similar to its axis, and slot -> totals."""
    m, size = axes.shape
    best: dict[int, tuple] = {}
    width = {"least": 0, "counts": size + 1, "sums": 2 * (size + 1)}[what]
    total = np.zeros(m * width)
    for own in groups:
        sizes, terms, weights, slot, keys = _chosen(own, slots)
        if not len(sizes):
            continue
        if what == "counts":
            row = np.repeat(np.arange(len(sizes)), sizes)
            total += np.bincount(slot[row] * width + terms, minlength=len(total)) + np.bincount(slot * width + size, minlength=len(total))
            continue
        row, product = _sides(sizes, terms, weights, slot, axes)
        if what == "sums":
            at = slot * width + (product <= 0) * (size + 1)
            total += np.bincount(at[row] + terms, np.rint(weights * STEPS), len(total)) + np.bincount(at + size, minlength=len(total))
            continue
        order = np.lexsort((keys, product, slot))
        ends = np.cumsum(sizes)
        for k in order[np.flatnonzero(np.diff(slot[order], prepend=-1))]:
            cell = slice(ends[k] - sizes[k], ends[k])
            mine = float(product[k]), int(keys[k]), terms[cell].tobytes() + weights[cell].tobytes()
            best[int(slot[k])] = min(best.get(int(slot[k]), mine), mine)
    parts = total.reshape(m, width)
    return best, {k: parts[k] for k in range(m) if width and parts[k].any()}


def _pass(stage, slots: np.ndarray, axes: np.ndarray, what: str) -> dict[int, tuple]:
    """One pass over the rows of the nodes with a slot: slot -> (terms and weights of a row, totals).

    ``stage`` is a table of packed rows, or a list of them. ``what``: "least": the row least similar to the slot's axis,
    that with the lowest hash of several; "counts": rows with each term and rows; "sums": weights of each term and
    rows, on the side of the axis and on the other.
    """

    def unpacked(b):
        return np.frombuffer(b[: len(b) // 2], np.int32), np.frombuffer(b[len(b) // 2 :], np.float32)

    if isinstance(stage, list):
        best, total = _partial(stage, slots, axes, what)
        return {k: (*unpacked(best[k][2] if k in best else b""), total.get(k)) for k in best.keys() | total.keys()}
    spark = stage.sparkSession
    given = spark.sparkContext.broadcast((slots, axes))
    schema = "slot int, score double, key bigint, best binary, total binary"

    def out(best, total):
        got = [(k, *(best.get(k) or (0.0, 0, b"")), total[k].tobytes() if k in total else b"") for k in sorted(best.keys() | total.keys())]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], t) for k, t in enumerate((pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary()))], ["slot", "score", "key", "best", "total"])

    def run(batches):
        yield out(*_partial(_unpacked(batches), *given.value, what))

    def merged(batches):
        best, total = {}, {}
        for batch in batches:
            for k, score, key, b, t in zip(*(batch[c].to_pylist() for c in range(5))):
                if b:
                    best[k] = min(best.get(k, (score, key, b)), (score, key, b))
                if t:
                    total[k] = total[k] + np.frombuffer(t) if k in total else np.frombuffer(t)
        yield out(best, total)

    rows = stage.mapInArrow(run, schema).repartition(1 + axes.size // GROUP, "slot").mapInArrow(merged, schema).collect()
    given.destroy()
    return {r.slot: (*unpacked(bytes(r.best)), np.frombuffer(r.total)) for r in rows}


def _children(own, slots, axes, first, kept):
    """The rows of split nodes under their children, ``first`` and the next number, and those of other nodes in ``kept``."""
    split = _chosen(own, slots)
    _, product = _sides(*split[:4], axes)
    rest = _chosen(own, np.where(kept, np.arange(len(kept)), -1))
    nodes = first[split[3]] + (product <= 0)
    return tuple(np.concatenate(x) for x in zip((*split[:3], nodes.astype(np.int32), split[4]), (*rest[:3], rest[3].astype(np.int32), rest[4])))


def _parted(stage, *how):
    if isinstance(stage, list):
        return [_children(own, *how) for own in stage]
    given = stage.sparkSession.sparkContext.broadcast(how)

    def run(batches):
        for own in _unpacked(batches):
            yield _packed_batch(*_children(own, *given.value))

    return cut(stage.mapInArrow(run, PACKED))


def _near(stage: DataFrame, kept: np.ndarray) -> list[tuple]:
    """The rows of the nodes in ``kept``, in the driver."""
    slots = np.where(kept, np.arange(len(kept)), -1)

    def run(batches):
        for own in _unpacked(batches):
            sizes, terms, weights, slot, keys = _chosen(own, slots)
            yield _packed_batch(sizes, terms, weights, slot.astype(np.int32), keys)

    return [own for batch in stage.mapInArrow(run, PACKED).toArrow().to_batches() for own in _unpacked([batch])]


class Splits:
    """Leaves of the distributed rows; each splits by bisecting k-means over all of its rows."""

    def __init__(self, stage: DataFrame, size: int, subject: np.ndarray):
        self.stage, self.size, self.subject, self.named = stage, size, subject, 1
        self.open: dict[int, int] = {}  # leaves that may be split, and their terms

    def slots(self, nodes: list[int]) -> np.ndarray:
        got = np.full(self.named, -1)
        got[nodes] = np.arange(len(nodes))
        return got

    def leaves(self, nodes: list[int]) -> list[tuple]:
        """(rows, share of the leading subject, (node, rows with each term)) of nodes."""
        got, out = _pass(self.stage, self.slots(nodes), np.zeros((len(nodes), self.size)), "counts"), []
        for k, node in enumerate(nodes):
            count = got[k][2] if k in got else np.zeros(self.size + 1)
            mass = count[:-1] @ self.subject
            share = mass.max() / mass.sum() if mass.sum() else 1.0
            if share < SETTLED and count[-1] >= 2 * LEAST_LEAF:
                self.open[node] = int(count[:-1].sum())
            out.append((int(count[-1]), share, (node, count[:-1])))
        if not isinstance(self.stage, list) and sum(self.open.values()) <= NEAR:
            far, kept = self.stage, np.zeros(self.named, dtype=bool)
            kept[[*self.open, *(nodes if self.named == 1 else ())]] = True
            self.stage = _near(far, kept)
            drop(far)
        return out

    def rows(self, slots: np.ndarray, axes: np.ndarray) -> np.ndarray:
        """The row least similar to each axis."""
        got = np.zeros_like(axes)
        for k, (terms, weights, _) in _pass(self.stage, slots, axes, "least").items():
            got[k, terms] = weights
        return got

    def axes(self, slots: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The axis between the two centres of each slot, and which of them part their rows."""
        first = self.rows(slots, self.rows(slots, np.zeros((m, self.size))))
        axes = first - self.rows(slots, first)
        good, going, before = np.ones(m, dtype=bool), np.ones(m, dtype=bool), {}
        for _ in range(ITERATIONS):
            own = np.flatnonzero(going)
            if not len(own):
                break
            place = np.full(m + 1, -1)
            place[own] = np.arange(len(own))
            for k, (_, _, total) in _pass(self.stage, place[slots], axes[own], "sums").items():
                k = own[k]
                a, b = total.reshape(2, -1)
                if not a[-1] or not b[-1]:
                    good[k] = going[k] = False
                elif k in before and (before[k] == total).all():
                    going[k] = False
                else:
                    before[k] = total
                    axes[k] = a[:-1] / np.linalg.norm(a[:-1]) - b[:-1] / np.linalg.norm(b[:-1])
        return axes, good

    def split(self, wanted: list[tuple]) -> list[tuple | None]:
        nodes = [node for _, _, (node, _) in wanted]
        slots = self.slots(nodes)
        for node in nodes:
            self.open.pop(node, None)
        axes, good = self.axes(slots, len(nodes))
        own = np.flatnonzero(good)
        if not len(own):
            return [None] * len(nodes)
        parted = self.slots([nodes[k] for k in own])
        kept = np.zeros(self.named, dtype=bool)
        kept[list(self.open)] = True
        first = self.named + 2 * np.arange(len(own))
        old, self.stage = self.stage, _parted(self.stage, parted, axes[own], first, kept)
        self.named += 2 * len(own)
        if not isinstance(old, list):
            drop(old)
        leaves = self.leaves([int(x) for f in first for x in (f, f + 1)])
        out: list[tuple | None] = [None] * len(nodes)
        for j, k in enumerate(own):
            a, b = leaves[2 * j : 2 * j + 2]
            if min(a[0], b[0]) >= 2:
                out[k] = axes[k], a, b
        return out


def fitted(docs: DataFrame, lexicon: Lexicon, weights: dict[str, tuple[int, float]]) -> tuple[Tree, list[dict[str, float]]]:
    """The tree and the mixtures of its leaves, from all paragraphs; the last mixture is that of all."""
    known = [*weights, *sorted(lexicon.of.keys() - weights.keys())]  # terms of the vectors first
    place = {t: j for j, t in enumerate(known)}
    weight = np.array([weights[t][1] if t in weights else 0.0 for t in known])
    subject = np.zeros((len(known), len(lexicon.subjects)))
    for t, (j, _) in weights.items():
        for s, p in lexicon.of.get(t, {}).items():
            subject[j, lexicon.subjects.index(s)] = p * lexicon.weight(t)
    splits = Splits(packed(docs, place, weight), len(known), subject)
    tree, leaves = best_first(len(known), splits.leaves([0])[0], splits.split)
    if not isinstance(splits.stage, list):
        drop(splits.stage)
    by_leaf = [{known[j]: int(count[j]) for j in np.flatnonzero(count)} for _, _, (_, count) in leaves]
    everything = lexicon.learn([sum(map(Counter, by_leaf), Counter())])
    return Tree(tree.axes[:, : len(weights)], tree.children), lexicon.learn(by_leaf) + everything


def assigned(documents: DataFrame, seeds: DataFrame, mixtures=None) -> DataFrame:
    """doc_id, subject, n_paragraphs: the subjects of every document with the paragraphs devoted to each.

    ``mixtures`` may change the list of leaf mixtures, for experiments.
    """
    spark = documents.sparkSession
    empty = spark.createDataFrame([], "doc_id bigint, subject string, n_paragraphs bigint")
    lexicon = lexicon_of(seeds)
    docs = _texts(documents)
    shares, _ = term_shares(docs)
    weighed = {t: w * math.log(1 / share) for t, share in sorted(shares.items()) if (w := lexicon.weight(t)) > 0 and share < 1}
    if not lexicon.of or not weighed:
        return empty
    weights = {t: (j, w) for j, (t, w) in enumerate(weighed.items())}
    tree, mixed = fitted(docs, lexicon, weights)
    mixed = mixtures(mixed) if mixtures else mixed
    given = spark.sparkContext.broadcast((tree.axes.astype(np.float32), tree.children, mixed))

    def decide(batches):
        axes, children, mixture = given.value
        own, kept = Tree(axes, children), set(weights) | set(lexicon.of)
        for batch in batches:
            ids, said = [], []
            for d, t in zip(batch["doc_id"], batch["text"]):
                for part in parts_of(t):
                    if sentences := _sentences(part, kept):
                        ids.append(d)
                        said.append(sentences)
            leaf = own.leaves(Rows([[t for s in x for t in s] for x in said], weights))
            out = []
            for d, k, sentences in zip(ids, leaf, said):
                got = lexicon.subject(sentences, mixture[k])
                if got and got[1] >= least_votes(len(sentences)):
                    out.append((d, got[0]))
            yield pd.DataFrame(out, columns=["doc_id", "subject"])

    return docs.mapInPandas(decide, "doc_id bigint, subject string").groupBy("doc_id", "subject").agg(F.count(F.lit(1)).alias("n_paragraphs"))


def found(documents: DataFrame, seeds: DataFrame) -> DataFrame:
    """doc_id, subject."""
    return assigned(documents, seeds).select("doc_id", "subject")


def make_up(documents: DataFrame, seeds: DataFrame, subjects: DataFrame) -> DataFrame:
    """The corpus by subject: subject, n_docs, n_paragraphs, 0 where none."""
    by = assigned(documents, seeds).groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_paragraphs").alias("n_paragraphs"))
    return subjects.select("subject").join(by, "subject", "left").select("subject", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"))
