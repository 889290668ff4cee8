"""Text decoded with the wrong character encoding: found and repaired (problem 1).

A stored token is explained by a latent chain: nothing happened, or its characters were encoded in one
encoding and decoded in another, once or twice, perhaps lower-cased or written as entities afterwards, or
parts of it were lost. Undoing a chain gives the text that it supposes, and a character model (classes of
neighbouring characters, characters within their class, and scripts within a dictionary's field) says how
likely that text is. The model is estimated from the tokens that no chain can undo as a whole to usual characters, then again
from those that the first model doesn't take for damaged.

How often each chain occurs is estimated per source and field by expectation-maximization from all tokens,
with the estimate over all sources as its prior, so weak evidence is pooled across records. A field is
damaged when in one of its tokens the posterior of "nothing happened" is below ``LEAST_WHOLE``; such a token
is repaired by its most probable chain.

Scale: values are split and counted in the JVM, one row per distinct token of a source, dictionary and field;
these rows lie together by token, so every distinct token is undone once and scored once per model. Rates are
a table joined by source and field, script counts one joined by dictionary and field, and the decided tokens
are joined back to the values. Evidence is counted in steps of ``QUANTUM`` at any size; the pooled rates are summed over
it in place, ``MOST_SIGNATURES`` kinds to a task, in whole numbers, so that the tasks don't change them. What is
collected is the character model (bounded by the alphabet) and one sum per chain and task.
Every token of every value is judged, whatever its source.

Cases: null and empty values are whole; repeated entries count each under their ids, rows alike in id and value
give one row; null sources form their own group; values without non-ASCII characters or entities are whole;
what can't be restored (lost characters) is found too and keeps its stored form.
"""

from __future__ import annotations

import html.entities
import json
import math
import re
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.sources.tables import cut, spread

# Encodings that UTF-8 text is read with, single-byte and multi-byte.
SINGLE = ["latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1256", "cp437", "cp850", "cp852", "cp866", "mac_roman", "mac_cyrillic", "koi8_r", "iso8859_2", "iso8859_15"]
MULTI = ["gbk", "big5", "cp932", "cp949"]
# Encodings whose text is read as Western European.
LEGACY_SCRIPTS = ["cp1251", "koi8_r", "cp866", "cp1256", "cp1253"]
DOUBLE_BYTE = ["gbk", "big5", "cp932", "euc_jp", "euc_kr"]
LEGACY = [*LEGACY_SCRIPTS, "cp1250", "cp1252", "mac_roman", *DOUBLE_BYTE]
#: Fixed values: (stored, read) of Cyrillic encodings taken for each other.
CYRILLIC = [("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8_r", "cp866"), ("cp866", "koi8_r")]
#: East Asian encodings taken for each other.
EAST_ASIAN = ["gbk", "big5", "cp932", "euc_jp", "euc_kr"]
BIG = {"CJK", "HANGUL", "HIRAGANA", "KATAKANA"}
FIELDS = ["glosses", "etymology", "commentary"]
PLACE = ["source", "db", "field"]
WHOLE, LOST = "whole", "lost"
START = {WHOLE: 0.97, LOST: 0.001}
MOST_SIGNATURES = 50_000
ROUNDS, PRIOR_ROWS, FLOOR = 30, 50, 1e-7
STEPS = float(1 << 24)  # expected counts are summed in such steps
QUANTUM, LEAST_EVIDENCE, MOST_EVIDENCE = 2, -12, 60
FIRST_EVIDENCE = -20  # under the first model
LEAST_WHOLE = 0.5
SHRINK = 5
DOUBT = 3.0
ODD_LOGLIK, LOST_LOGLIK, LEFT_LOGLIK = -30.0, -4.0, -4.0
MEMO = 200_000

_BYTES = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_LOWERED = re.compile("[\xe0-\xef][\x80-\xbf]{2}|[\xe2-\xfe][\x80-\xbf]|[\xc2-\xdf][\x80-\xbf]")
_HIGH = re.compile("[^\x00-\x7f]+")
_RUN = re.compile("[^\x00-\x7f]{2}")
_ESCAPE = re.compile(r"\\u(00[89a-fA-F][0-9a-fA-F]|0[1-9a-fA-F][0-9a-fA-F]{2}|[1-9a-fA-F][0-9a-fA-F]{3})")
_ENTITY = re.compile(r"&([A-Za-z]{2,8});")
_EAST = re.compile("[\u2e80-\ud7a3\uf900-\ufaff\uff61-\uff9f]")
_CYRILLIC = re.compile("[\u0400-\u04ff]")
#: A letter beyond ASCII beside a Latin one, which in another alphabet's encoding would make a mixed word.
_BESIDE = re.compile("[A-Za-z][\xc0-\u024f]|[\xc0-\u024f][A-Za-z]")
#: Double-byte text has more than one character beyond ASCII, beside each other or not.
_DOUBLE = re.compile("[^\x00-\x7f].*[^\x00-\x7f]", re.S)
#: Latin letters run together with those of another alphabet: no word.
_MIXED = re.compile("[A-Za-z][\u0370-\u06ff]|[\u0370-\u06ff][A-Za-z]")
_ODD = re.compile("[\x80-\x9f�]")
PARTS = "[ \\t\\r\\n]+"
GATE = "[^\\x00-\\x7f]|\\\\u[0-9a-fA-F]{4}|&[A-Za-z]{2,8};"


@lru_cache(64)
def _table(codec: str) -> dict[int, int]:
    """Character -> byte of a single-byte encoding; undefined bytes stand for themselves."""
    table: dict[int, int] = {}
    for b in range(128, 256):
        try:
            c = ord(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            c = b
        table.setdefault(c, b)
    for b in range(128, 160):
        table.setdefault(b, b)
    for c in range(128, 256):  # a character the encoding hasn't must not pass for a byte
        table.setdefault(c, 0xF0000 + c)
    return table


def _sequence(m: re.Match) -> str:
    try:
        return m[0].encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return m[0]




def _class(table: dict[int, int], low: int, high: int) -> str:
    """A regular expression class of the characters that stand for the bytes from ``low`` to ``high``."""
    return "[" + "".join(re.escape(chr(c)) for c, b in table.items() if low <= b <= high) + "]"


@lru_cache(64)
def _sequences(codec: str) -> str:
    """A pattern for a UTF-8 sequence beyond ASCII as it looks when read with ``codec``."""
    table = _table(codec)
    tail = _class(table, 0x80, 0xBF)
    return f"{_class(table, 0xC2, 0xDF)}{tail}|{_class(table, 0xE0, 0xEF)}{tail}{{2}}|{_class(table, 0xF0, 0xF4)}{tail}{{3}}"


@lru_cache(64)
def _holds(codec: str) -> re.Pattern:
    return re.compile(_sequences(codec))


@lru_cache(1)
def _holds_any() -> re.Pattern:
    return re.compile("|".join(map(_sequences, SINGLE)))


@lru_cache(1)
def _western() -> re.Pattern:
    """Tokens whose characters all stand for a byte of Western European text."""
    return re.compile("[\x00-\x7f" + _class(_table("cp1252"), 0x80, 0xFF)[1:] + "*")


def undo_single(text: str, codec: str) -> str | None:
    """Each run of characters that is UTF-8 read with ``codec`` turned back, or None where there is none."""
    if not _holds(codec).search(text):
        return None
    raw = text.translate(_table(codec))
    out, at = [], 0
    for m in _BYTES.finditer(raw):
        out += [text[at : m.start()], _sequence(m)]
        at = m.end()
    got = "".join([*out, text[at:]])
    return got if got != text else None


def undo_multi(text: str, codec: str) -> str | None:
    """Runs of characters that are UTF-8 read with a multi-byte encoding turned back."""

    def run(m: re.Match) -> str:
        try:
            return m[0].encode(codec).decode("utf-8")
        except UnicodeError:
            return m[0]

    got = _HIGH.sub(run, text)
    return got if got != text else None


@lru_cache(2)
def _lowered_holds(upper_tail: bool) -> re.Pattern:
    table = _lowered_table(upper_tail)
    tail = _class(table, 0x80, 0xBF)
    return re.compile(f"{_class(table, 0xC2, 0xFE)}{tail}")


@lru_cache(2)
def _lowered_table(upper_tail: bool) -> dict[int, int]:
    return _table("cp1252") | {0xFF: 0x9F} | ({0x161: 0x8A, 0x153: 0x8C, 0x17E: 0x8E} if upper_tail else {})


def undo_lowered(text: str, upper_tail: bool) -> str | None:
    """UTF-8 read as cp1252 and lower-cased; ``upper_tail``: later bytes were capitals."""
    if not _lowered_holds(upper_tail).search(text):
        return None
    raw = text.translate(_lowered_table(upper_tail))

    def run(m: re.Match) -> str:
        s = m[0]
        if len(s) == 2 and s[0] > "\xe1":
            s = chr(ord(s[0]) - 0x20) + s[1]
        try:
            return s.encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    if not _LOWERED.search(raw):
        return None
    out, at = [], 0
    for m in _LOWERED.finditer(raw):
        done = run(m)
        out += [text[at : m.start()], text[m.start() : m.end()] if done == m[0] else done]
        at = m.end()
    got = "".join([*out, text[at:]])
    return got if got != text else None


def opened(text: str) -> str:
    """JSON escapes and entities of non-ASCII characters written out."""
    if "\\u" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if not 0xD800 <= int(m[1], 16) < 0xE000 else m[0], text)
    if "&" in text:
        points = html.entities.name2codepoint
        text = _ENTITY.sub(lambda m: chr(points[m[1]]) if points.get(m[1], 0) > 127 else m[0], text)
    return text


def candidates(token: str) -> list[tuple[str, str]]:
    """(chain, supposed text) of every chain that can be undone."""
    out: list[tuple[str, str]] = []
    run = _RUN.search(token)  # a byte sequence shows as two characters or more
    for codec in SINGLE if run and _holds_any().search(token) else ():
        once = undo_single(token, codec)
        if once is None:
            continue
        out.append((codec, once))
        for second in (codec, "cp1252", "latin-1"):
            twice = undo_single(once, second)
            if twice is not None:
                out.append((f"{second}>{codec}", twice))
                break
    if _EAST.search(token):
        out += [(codec, got) for codec in MULTI if (got := undo_multi(token, codec)) is not None]
    plain = {text for _, text in out}
    for tail in (False, True) if run else ():
        if (got := undo_lowered(token, tail)) is not None and got not in plain:
            out.append(("cp1252-lowered", got))
    return out


def legacy_candidates(token: str) -> list[tuple[str, str]]:
    """(chain, supposed text) of legacy encodings read as Western European, where all of the token decodes."""
    out: list[tuple[str, str]] = []
    if not _western().fullmatch(token):
        return out
    mixed, paired_ = _BESIDE.search(token), _DOUBLE.search(token)
    for text, mark in ((token, ""), (token.upper(), "-lowered")):
        if mark and mixed:
            continue
        if mark and (text == token or not token.islower() or not _western().fullmatch(text)):
            continue
        raw = text.translate(_table("cp1252")).encode("latin-1", "replace")
        for codec in LEGACY_SCRIPTS if mark else LEGACY:
            if (mixed and codec in LEGACY_SCRIPTS) or (not paired_ and codec in DOUBLE_BYTE):
                continue
            try:
                got = raw.decode(codec)
            except UnicodeError:
                continue
            if got != text and not _MIXED.search(got):
                out.append((f"{codec} read as cp1252{mark}", got.lower() if mark else got))
    return out


def swapped_candidates(token: str) -> list[tuple[str, str]]:
    """(chain, supposed text) of one Cyrillic or East Asian encoding read as another, where all decodes."""
    pairs = CYRILLIC if _CYRILLIC.search(token) else []
    if _EAST.search(token):
        pairs = [*pairs, *((a, b) for b in EAST_ASIAN for a in EAST_ASIAN if a != b)]
    out, raw = [], {}
    for stored, read in pairs:
        try:
            if read not in raw:
                raw[read] = token.encode(read)
        except UnicodeError:
            raw[read] = None
        if raw[read] is not None:
            try:
                got = raw[read].decode(stored)
            except UnicodeError:
                continue
            if got != token:
                out.append((f"{stored} read as {read}", got))
    return out


#: Characters that texts are usually made of; anything else in a supposed text speaks against it.
_USUAL = re.compile("^[\x00-\x7f\xa0-\u017f\u0192\u01a0\u01a1\u01af\u01b0\u0218-\u021b\u0232\u0233\u0370-\u03ff\u0400-\u045f\u0490\u0491\u05d0-\u05ea\u0600-\u06ff\u0900-\u097f\u1e00-\u1fff\u200c-\u203a\u20ac\u2122\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff00-\uffef]*$")
_IMPOSSIBLE = ("Cn", "Co", "Cs", "Cc")


def possible(text: str) -> bool:
    """Whether a supposed text holds assigned, printable characters only."""
    return bool(_USUAL.match(text)) or not any(unicodedata.category(c) in _IMPOSSIBLE for c in text if not c.isascii())


def left_over(token: str, text: str) -> int:
    """Letters beyond ASCII that a chain leaves as they are beside letters that it turns back."""
    if len(text) >= len(token):
        return 0
    kept = Counter(token) & Counter(text)
    beside = sum(n for c, n in kept.items() if not c.isascii() and c.isalpha() and any(c in run and not set(run) <= set(text) for run in _HIGH.findall(token)))
    return max(0, beside - (len(token) - len(text)))  # what the chain put in may equal a stored letter


@lru_cache(50_000)
def kind(c: str) -> str:
    """The class of a character: script and case of letters, the character itself for ASCII marks."""
    if c.isascii():
        return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c
    if "\x80" <= c <= "\x9f" or c == "�":
        return "odd"
    category = unicodedata.category(c)
    if category[0] in "LM":
        script = unicodedata.name(c, "other").split()[0]
        return script + category[1] if category in ("Lu", "Ll") else script
    if "‐" <= c <= "‧":
        return c
    return category


class Steps(dict):
    """Log-probabilities of (character, next character), computed when first asked for."""

    def __init__(self, step):
        self.step = step

    def __missing__(self, pair: tuple[str, str]) -> float:
        got = self.step(*pair)
        if len(self) < MEMO:
            self[pair] = got
        return got


class Model:
    """Character model: a character given the one before, backed by classes given the class before.

    ``pairs`` counts (class, class), ``chars`` (character, character), ``singles`` characters.
    """

    def __init__(self, pairs: dict[tuple[str, str], int], chars: dict[tuple[str, str], int], singles: dict[str, int]):
        self.pairs, self.chars, self.singles = pairs, chars, singles
        self.before, self.of, self.members, self.starts = Counter(), Counter(), Counter(), Counter()
        for (a, _), n in pairs.items():
            self.before[a] += n
        for (a, _), n in chars.items():
            self.starts[a] += n
        for c, n in singles.items():
            self.of[kind(c)] += n
            self.members[kind(c)] += 1
        self.steps = Steps(self.step)

    def step(self, a: str, c: str) -> float:
        k = kind(c)
        if k == "odd":
            return ODD_LOGLIK
        p = (self.pairs.get((kind(a), k), 0) + 0.02) / (self.before.get(kind(a), 0) + 2)
        if not c.isascii():
            p *= (self.singles.get(c, 0) + 0.05) / (self.of.get(k, 0) + 0.05 * (self.members.get(k, 0) + 1000))
        if paired(a, c):
            p = (self.chars.get((a, c), 0) + SHRINK * p) / (self.starts.get(a, 0) + SHRINK)
        return math.log(p)

    def loglik(self, token: str) -> float:
        return sum(map(self.steps.__getitem__, zip(" " + token, token + " ")))


def paired(a: str, c: str) -> bool:
    """Whether a pair of characters is counted: one beyond ASCII, none of a script with thousands."""
    return not (a.isascii() and c.isascii()) and kind(a) not in BIG and kind(c) not in BIG


@lru_cache(100_000)
def script_of(token: str) -> str:
    """The script of most of the letters beyond ASCII, or "" without any."""
    found = Counter(kind(c).rstrip("ul") for c in token if not c.isascii() and c.isalpha())
    return max(found, key=lambda k: (found[k], k)) if found else ""



def tally(counted: dict[int, list[str]]) -> tuple[Counter, Counter, Counter]:
    """Counts of (class, class), (character, character) and characters over tokens, given by their frequency."""
    steps: Counter = Counter()
    for n, some in counted.items():
        text = " " + " ".join(some) + " "
        for pair, k in Counter(zip(text, text[1:])).items():
            steps[pair] += n * k
    pairs, chars, singles = Counter(), Counter(), Counter()
    for (a, c), n in steps.items():
        pairs[kind(a), kind(c)] += n
        if paired(a, c):
            chars[a, c] += n
        if not c.isascii():
            singles[c] += n
    return pairs, chars, singles


def options(token: str) -> list[tuple[str, str]]:
    """(chain, supposed text) of every chain that can be undone to characters that texts may hold."""
    return [x for x in (*candidates(token), *legacy_candidates(token), *swapped_candidates(token)) if possible(x[1])]


def evidence(model: Model, token: str, chains: list[tuple[str, str]], least: float = LEAST_EVIDENCE) -> list[tuple[str, float, str]]:
    """(chain, log-likelihood above "whole", supposed text) of a token, the best text of each chain."""
    odd = _ODD.search(token)
    if not chains and not odd:
        return []
    base = model.loglik(token)
    best: dict[str, tuple[float, str]] = {}
    scores: dict[str, float] = {}
    for chain, text in chains:
        if text not in scores:
            scores[text] = model.loglik(text) - base + LEFT_LOGLIK * left_over(token, text)
        score = scores[text]
        if score > least and (chain not in best or score > best[chain][0]):
            best[chain] = score, text
    if odd:
        rest = _ODD.sub("", token)
        best[LOST] = model.loglik(rest) + LOST_LOGLIK * (len(token) - len(rest)) - base, token
    return [(c, s, t) for c, (s, t) in best.items()]


def decided(scored: list[tuple[str, float, str]], rates: dict[str, float]) -> tuple[str, str] | None:
    """(chain, text) that a token is repaired by, or None where it is whole."""
    if not scored:
        return None
    weighed = [(math.log(rates.get(c, 1e-7)) + s, c, t) for c, s, t in scored]
    mass = sum(math.exp(min(80.0, s)) for s, _, _ in weighed)
    if mass * LEAST_WHOLE < rates[WHOLE] * (1 - LEAST_WHOLE):
        return None
    best = max(weighed, key=lambda x: (x[0], x[1]))
    return best[1], best[2]


def coded(signatures, chains: list[str]) -> tuple[np.ndarray, ...]:
    """Counted evidence (signature, n) as arrays: row, chain and likelihood ratio of each piece, count of each row."""
    place = {c: k for k, c in enumerate(chains)}
    row, chain, ratio, counts = [], [], [], []
    for k, (signature, n) in enumerate(signatures):
        counts.append(n)
        for piece in signature.split("|") if signature else ():
            c, _, score = piece.rpartition("=")
            row.append(k), chain.append(place[c]), ratio.append(math.exp(float(score)))
    return np.array(row, np.int64), np.array(chain, np.int64), np.array(ratio, np.float64), np.array(counts, np.int64)


def expected(evidence_: tuple[np.ndarray, ...], rates: np.ndarray) -> np.ndarray:
    """Expected number of tokens of each chain, in steps; the first is "whole"."""
    row, chain, ratio, n = evidence_
    weight = rates[chain] * ratio
    share = n / (rates[0] + np.bincount(row, weight, len(n))) * STEPS
    got = np.zeros(len(rates), np.int64)
    np.add.at(got, chain, np.rint(weight * share[row]).astype(np.int64))
    got[0] = np.rint(rates[0] * share).astype(np.int64).sum()
    return got


def maximized(expect, chains: list[str], prior: dict[str, float] | None = None) -> dict[str, float]:
    """Rates of the chains by expectation-maximization; ``expect(rates)`` sums the expected numbers of tokens."""
    if prior:
        rates, held = (np.array([prior.get(c, low) for c in chains]) for low in (FLOOR, 0.0))
    else:
        rates, held = np.array([START[WHOLE], *[(1 - START[WHOLE]) / (len(chains) - 1)] * (len(chains) - 1)]), 0.0
    for _ in range(ROUNDS):
        got = expect(rates) / STEPS + PRIOR_ROWS * held
        if not got.sum():
            break
        rates = np.maximum(FLOOR, got / got.sum())
    return dict(zip(chains, map(float, rates)))


def fit(signatures: dict[str, int], prior: dict[str, float] | None = None) -> dict[str, float]:
    """Rates of the chains from counted evidence, by expectation-maximization."""
    own = {piece.rpartition("=")[0] for s in signatures if s for piece in s.split("|")}
    chains = [WHOLE, *sorted((own | {LOST} | set(prior or ())) - {WHOLE})]
    given = coded(signatures.items(), chains)
    return maximized(lambda rates: expected(given, rates), chains, prior)


def _stacked(entries: DataFrame) -> DataFrame:
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in FIELDS))
    rows = entries.select(F.col("id").cast("bigint").alias("id"), F.coalesce("source", F.lit("\0")).alias("source"), F.coalesce("db", F.lit("\0")).alias("db"), F.explode(fields).alias("s"))
    return rows.select("id", "source", "db", "s.field", "s.value").where(F.col("value").rlike(GATE))


def _tokens(stacked: DataFrame) -> DataFrame:
    return stacked.select("id", *PLACE, F.explode(F.split("value", PARTS)).alias("token")).where(F.col("token").rlike(GATE))


def _distinct(tokens_: DataFrame) -> DataFrame:
    """Counted distinct tokens, rows of a token together: source, db, field, token, n, text, script, whole.

    ``whole``: no chain that reads UTF-8 wrongly can be undone as a whole to usual characters.
    """
    spark = tokens_.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = tokens_.groupBy(*PLACE, "token").agg(F.count(F.lit(1)).alias("n"))

    def run(batches):
        last, got = None, ("", "", False)
        for batch in batches:
            out = []
            for token in batch["token"]:
                if token != last:
                    text, last = opened(token), token
                    whole = not _ODD.search(text) and not any(_USUAL.match(x) and not left_over(text, x) for _, x in candidates(text))
                    got = (text, script_of(text), whole)
                out.append(got)
            frame = pd.DataFrame(out, columns=["text", "script", "whole"])
            yield pd.concat([batch, frame], axis=1)[[not t.isascii() for t, _, _ in out]]

    schema = "source string, db string, field string, token string, n bigint, text string, script string, whole boolean"
    return cut(counted.repartition(parts, "token").sortWithinPartitions("token").mapInPandas(run, schema))


def character_model(kept: DataFrame) -> tuple:
    """Counts for a character model over tokens (text, n)."""

    def run(batches):
        counted: dict[int, list[str]] = defaultdict(list)
        for batch in batches:
            for text, n in zip(batch["text"], batch["n"]):
                counted[n].append(text)
        pairs, chars, singles = tally(counted)
        yield pd.DataFrame([("p", a, b, n) for (a, b), n in pairs.items()] + [("c", a, b, n) for (a, b), n in chars.items()] + [("s", c, "", n) for c, n in singles.items()], columns=["what", "a", "b", "n"])

    rows = kept.select("text", "n").mapInPandas(run, "what string, a string, b string, n bigint").groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    pairs, chars = ({(r.a, r.b): r.n for r in rows if r.what == w} for w in "pc")
    return pairs, chars, {r.a: r.n for r in rows if r.what == "s"}


def _weighed(rows: DataFrame, model: tuple, least: float, given_options: bool) -> DataFrame:
    """``rows`` with ``options``: (chain, score, text, script) of every chain with a score above ``least``.

    The chains are those of the row's earlier options, or all.
    """
    given = rows.sparkSession.sparkContext.broadcast(model)
    kind_of = pa.list_(pa.struct([("chain", pa.string()), ("score", pa.float64()), ("text", pa.string()), ("script", pa.string())]))

    def run(batches):
        judge, last, got = Model(*given.value), None, []
        for batch in batches:
            texts = batch["text"].to_pylist()
            out = []
            for k, text in enumerate(texts):
                if text != last:
                    last = text
                    chains = [(x["chain"], x["text"]) for x in batch["options"][k].as_py() if x["chain"] != LOST] if given_options else options(text)
                    got = [{"chain": c, "score": s, "text": t, "script": script_of(t)} for c, s, t in evidence(judge, text, chains, least)]
                out.append(got)
            names = [n for n in batch.schema.names if n != "options"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(out, kind_of)], [*names, "options"])

    plain = rows.drop("options")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", options array<struct<chain string, score double, text string, script string>>"
    return rows.select(*plain.columns, *(["options"] if given_options else [])).mapInArrow(run, schema)


def _scored(tokens_: DataFrame) -> DataFrame:
    """source, db, field, token, n, scored: (chain, score, text) of every token, in its dictionary's field."""
    distinct = _distinct(tokens_)
    first = cut(_weighed(distinct, character_model(distinct.where("whole")), FIRST_EVIDENCE, False))
    doubted = F.exists("options", lambda x: (x.score >= DOUBT) | (x.chain == LOST))
    model = character_model(first.where(~doubted))
    table = cut(_weighed(first.where(F.size("options") > 0), model, LEAST_EVIDENCE, True))
    plain = distinct.where("whole").groupBy("db", "field", "script").agg(F.sum("n").alias("n"))
    all_in = plain.groupBy("script").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("script", "n"))).alias("everywhere"), F.sum("n").alias("total"))
    own = plain.groupBy("db", "field").agg(F.map_from_entries(F.collect_list(F.struct("script", "n"))).alias("own"), F.sum("n").alias("held"))
    ever = all_in.head()
    everywhere, total = dict(ever.everywhere or {}), ever.total or 0

    def log_share(script):
        base = (F.coalesce(F.element_at(F.from_json(F.lit(json.dumps(everywhere)), "map<string,bigint>"), script), F.lit(0)) + 1) / (total + 50)
        return F.log((F.coalesce(F.element_at("own", script), F.lit(0)) + 5 * base) / (F.coalesce("held", F.lit(0)) + 5))

    moved = F.transform("options", lambda x: F.struct(x.chain.alias("chain"), (x.score + log_share(x.script) - log_share(F.col("script"))).alias("score"), x.text.alias("text")))
    placed = table.join(own, ["db", "field"], "left").select(*PLACE, "token", "n", moved.alias("scored"))
    none = F.array().cast("array<struct<chain string, score double, text string>>").alias("scored")
    return placed.unionByName(first.where(F.size("options") == 0).groupBy(*PLACE).agg(F.sum("n").alias("n")).select(*PLACE, F.lit("").alias("token"), "n", none))


def _signature(scored: str, quantum: int):
    """Evidence in steps of ``quantum``, the best first."""
    stepped = F.transform(scored, lambda x: F.struct((-F.round(F.greatest(F.lit(LEAST_EVIDENCE), F.least(F.lit(MOST_EVIDENCE), x.score)) / quantum) * quantum).cast("int").alias("s"), x.chain.alias("c")))
    return F.array_join(F.transform(F.array_sort(stepped), lambda x: F.concat(x.c, F.lit("="), (-x.s).cast("string"))), "|")


def pooled_rates(counts: DataFrame) -> dict[str, float]:
    """Rates over all counted evidence (signature, n), of any number of kinds."""
    parts = 1 + counts.count() // MOST_SIGNATURES
    pieces = counts.where("signature <> ''").select(F.explode(F.split("signature", "[|]")).alias("piece"))
    named = pieces.select(F.regexp_replace("piece", "=[^=]*$", "").alias("chain")).distinct().collect()
    chains = [WHOLE, *sorted({r.chain for r in named} | {LOST})]
    kinds = (np.int64, np.int64, np.float64, np.int64)

    def pack(batches):
        rows = [x for batch in batches for x in zip(batch["signature"].to_pylist(), batch["n"].to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in coded(rows, chains)], ["row", "chain", "ratio", "n"])

    packed = cut(counts.select("signature", "n").repartition(parts).mapInArrow(pack, "row binary, chain binary, ratio binary, n binary"))

    def expect(rates):
        def run(batches):
            for batch in batches:
                for own in zip(*(batch[k].to_pylist() for k in range(4))):
                    yield pa.RecordBatch.from_arrays([pa.array([expected(tuple(map(np.frombuffer, own, kinds)), rates).tobytes()], pa.binary())], ["sums"])

        rows = packed.mapInArrow(run, "sums binary").collect()
        return sum((np.frombuffer(bytes(r.sums), np.int64) for r in rows), np.zeros(len(chains), np.int64))

    return maximized(expect, chains)


def chain_rates(scored: DataFrame) -> tuple[dict[str, float], DataFrame]:
    """Pooled rates, and a table of the rates of each source and field."""
    counts = cut(scored.groupBy("source", "field", _signature("scored", QUANTUM).alias("signature")).agg(F.sum("n").alias("n")))
    pooled = pooled_rates(cut(counts.groupBy("signature").agg(F.sum("n").alias("n"))))

    def own(key, frame):
        rates = fit(dict(zip(frame["signature"], frame["n"])), pooled)
        return pd.DataFrame([(*key, c, p) for c, p in rates.items()], columns=["source", "field", "chain", "rate"])

    fitted = counts.groupBy("source", "field").applyInPandas(own, "source string, field string, chain string, rate double")
    return pooled, fitted.groupBy("source", "field").agg(F.map_from_entries(F.collect_list(F.struct("chain", "rate"))).alias("rates"))


def decisions(scored: DataFrame, rates: DataFrame) -> DataFrame:
    """source, db, field, token, chain, fixed of the tokens whose posterior of "whole" is below ``LEAST_WHOLE``."""
    weigh = F.transform("scored", lambda x: F.struct((F.log(F.coalesce(F.element_at("rates", x.chain), F.lit(1e-7))) + x.score).alias("w"), x.chain.alias("chain"), x.text.alias("text")))
    weighed = scored.where(F.size("scored") > 0).join(rates, ["source", "field"]).withColumn("weighed", weigh)
    mass = F.aggregate("weighed", F.lit(0.0), lambda total, x: total + F.exp(F.least(F.lit(80.0), x.w)))
    best = weighed.where(mass * LEAST_WHOLE >= F.element_at("rates", WHOLE) * (1 - LEAST_WHOLE)).withColumn("best", F.array_max("weighed"))
    return best.select(*PLACE, "token", F.col("best.chain").alias("chain"), F.col("best.text").alias("fixed"))


def damaged(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stacked values, and one row per damaged token of a value: id, source, db, field, token, chain, fixed."""
    stacked = _stacked(entries)
    scored = _scored(_tokens(spread(stacked)))
    decided_ = cut(decisions(scored, chain_rates(scored)[1]))
    return stacked, _tokens(stacked).join(decided_, [*PLACE, "token"])


def judged(entries: DataFrame) -> DataFrame:
    """id, source, field, repaired, restorable, chain of every damaged value."""
    stacked, hits = damaged(entries)
    lost = F.max(F.col("fixed").rlike(_ODD.pattern))
    per = hits.groupBy("id", *PLACE).agg(F.map_from_entries(F.collect_set(F.struct("token", "fixed"))).alias("fixes"), (~lost).alias("restorable"), F.mode("chain", True).alias("chain"))
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("id", *PLACE)]
    parts = F.regexp_extract_all("v.value", F.lit("[^ \\t\\r\\n]+|[ \\t\\r\\n]+"), F.lit(0))
    repaired_ = F.array_join(F.transform(parts, lambda t: F.coalesce(F.element_at("h.fixes", t), t)), "")
    values = stacked.alias("v").join(per.alias("h"), same)
    return values.select("v.id", "v.source", "v.field", repaired_.alias("repaired"), "h.restorable", "h.chain")


def found(entries: DataFrame) -> DataFrame:
    """entry_pk, field of every damaged value."""
    return damaged(entries)[1].select(F.col("id").alias("entry_pk"), "field").distinct()


def repaired(entries: DataFrame) -> DataFrame:
    """entry_pk, field, repaired, restorable of every damaged value."""
    return judged(entries).select(F.col("id").alias("entry_pk"), "field", "repaired", "restorable")


def by_source(entries: DataFrame) -> DataFrame:
    """Damaged values per source, field and chain."""
    return judged(entries).groupBy(F.nullif("source", F.lit("\0")).alias("source"), "field", "chain").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("restorable").cast("bigint")).alias("n_restorable"))
