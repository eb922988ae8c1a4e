"""Garbled text from wrong character encoding, found and restored.

A hidden Markov model with one clean state and one state per encoding pair
labels the characters of a value, in one decoding over all states. Emissions
come from character bigrams of the corpus: the clean state emits the stored
character, a pair's state the character that its inverse transform gives, or
the stored one where damage leaves it out. Transitions are weighed by how
often each pair explains tokens of the corpus. Each labelled span then gets
its state's inverse transform.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.session import checkpoint, share

#: (what the text was, what it was read as, how often in a row). Fixed values.
PAIRS = [
    ("utf-8", "cp1252", 1),
    ("utf-8", "latin-1", 1),
    ("utf-8", "cp1252", 2),
    ("utf-8", "latin-1", 2),
    ("utf-8", "mac-roman", 1),
    ("utf-8", "cp437", 1),
    ("utf-8", "cp850", 1),
    ("utf-8", "cp852", 1),
    ("utf-8", "cp1250", 1),
    ("utf-8", "cp1251", 1),
    ("utf-8", "iso8859-15", 1),
    ("cp1252", "cp437", 1),
    ("cp1252", "cp850", 1),
    ("cp1252", "mac-roman", 1),
    ("cp1252", "cp1250", 1),
    ("cp1252", "cp1251", 1),
    ("cp437", "cp1252", 1),
    ("cp850", "cp1252", 1),
    ("mac-roman", "cp1252", 1),
    ("cp1250", "cp1252", 1),
    ("iso8859-2", "cp1252", 1),
    ("cp1251", "cp1252", 1),
    ("koi8-r", "cp1252", 1),
    ("koi8-r", "cp1251", 1),
    ("cp866", "cp1251", 1),
]
LOST = "�"
#: Costs in nats before the corpus is seen: entering a pair whose true encoding has several bytes a character, and one of single bytes.
ENTER_MULTI, ENTER_SINGLE = 4.0, 4.8
#: A token's gain below this says nothing: small gains of genuine words must not add up in long texts.
LEAST_GAIN = 1.0
#: Cost of changing between clean and garbled within a token, and from one pair to another anywhere.
SWITCH, CHANGE = 1.0, 3.0
#: Weight of the unigram in a bigram's estimate.
BACKOFF = 4.0
#: Words end at ASCII other than letters and digits, which no garbled sequence holds.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
NOT_ASCII = "[^\\x00-\\x7F]"


def _bytes_of(encoding: str) -> dict[str, int]:
    """Character to byte; bytes that the encoding leaves undefined stand for themselves, as lenient readers have it."""
    table = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, b)
    return table


def _class_of(c: str) -> str:
    """Scripts with very many characters count as one symbol in the model, which bounds its size."""
    code = ord(c)
    if code < 0x3000:
        return c
    for name, low, high in (("kana", 0x3000, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF)):
        if low <= code <= high:
            return name
    return c if code in (0xFEFF, 0xFFFD) else "other"


def _kind(symbol: str) -> str:
    """Script and case of a letter, or the sort of another character: what a bigram backs off to."""
    if len(symbol) != 1:
        return symbol
    sort, code = unicodedata.category(symbol), ord(symbol)
    if sort[0] in "LM":
        script = "Latin" if code < 0x250 or 0x1E00 <= code <= 0x1EFF else "Greek" if 0x370 <= code < 0x400 else "Cyrillic" if 0x400 <= code < 0x530 else "letter"
        return script + ("upper" if sort == "Lu" else "")
    return sort[0] + ("" if code < 0x80 else "+")


def _floor(c: str) -> float:
    """The probability of a character that the corpus doesn't show, before smoothing."""
    kind, code = unicodedata.category(c), ord(c)
    if code < 0x80:
        return 1e-4
    if kind in ("Cc", "Co", "Cn", "Cs") or 0x2500 <= code <= 0x259F:
        return 1e-10
    if kind[0] == "L" and (code < 0x180 or 0x391 <= code <= 0x3C9 or 0x410 <= code <= 0x44F or 0x3040 <= code <= 0x30FF or 0x4E00 <= code <= 0x9FFF or 0x1EA0 <= code <= 0x1EF9):
        return 1e-5
    if 0x2010 <= code <= 0x2026 or code in (0x20AC, 0xFEFF, 0xB0, 0xA3, 0xBF, 0xA1, 0xAB, 0xBB, 0x266B):
        return 1e-5
    return 1e-7 if kind[0] in "LPS" else 1e-8


class Inverse:
    """The inverse transforms: which stored characters, from a position on, stand for one true character."""

    def __init__(self, pairs: list[tuple[str, str, int]]):
        self.pairs = pairs
        self.tables = [_bytes_of(wrong) for _, wrong, _ in pairs]
        self.single = [{} if true == "utf-8" else self._single(true, wrong) for true, wrong, _ in pairs]

    @staticmethod
    def _single(true: str, wrong: str) -> dict[str, str]:
        out = {}
        for c, b in _bytes_of(wrong).items():
            if b >= 0x80:
                try:
                    t = bytes([b]).decode(true)
                except UnicodeDecodeError:
                    continue
                if t != c and unicodedata.category(t)[0] in "LPSN":
                    out[c] = t
        return out

    @staticmethod
    def _unit(text: str, at: int, table: dict[str, int]) -> tuple[str, int] | None:
        """One character of UTF-8 read by a single-byte table."""
        lead = table.get(text[at], 0)
        size = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
        if not size or at + size > len(text):
            return None
        raw = [table.get(c, 0) for c in text[at : at + size]]
        if not all(0x80 <= b <= 0xBF for b in raw[1:]):
            return None
        try:
            return bytes(raw).decode("utf-8"), size
        except UnicodeDecodeError:
            return None

    def __call__(self, pair: int, text: str, at: int) -> tuple[str, int] | None:
        true, _, times = self.pairs[pair]
        if true != "utf-8":
            c = self.single[pair].get(text[at])
            return (c, 1) if c else None
        table = self.tables[pair]
        if times == 1:
            return self._unit(text, at, table)
        inner, end = "", at
        while end < len(text) and len(inner) < 4:
            got = self._unit(text, end, table)
            if not got:
                break
            inner, end = inner + got[0], end + got[1]
            twice = self._unit(inner, 0, table)
            if twice and twice[1] == len(inner):
                return twice[0], end - at
        return None

    def structural(self, token: str) -> bool:
        """Whether the token could be garbled by its make-up alone; such tokens don't train the clean state."""
        if any(c == LOST or "\x80" <= c <= "\x9f" or "─" <= c <= "▟" for c in token):
            return True
        units = (self(p, token, i) for p, (true, _, _) in enumerate(self.pairs) if true == "utf-8" for i, c in enumerate(token) if c > "\x7f")
        return any(got and _floor(got[0]) >= 1e-5 for got in units)


@dataclass
class Statistics:
    """What the corpus says: counts of character pairs in clean tokens, and the share of tokens that each encoding pair explains."""

    bigrams: dict[tuple[str, str], int]
    shares: dict[int, float] = field(default_factory=dict)


class Model:
    """Bigram probabilities of clean characters, and the Viterbi labelling with them."""

    def __init__(self, statistics: Statistics):
        self.inverse = Inverse(PAIRS)
        self.count, self.total = Counter(), Counter()
        self.pair = statistics.bigrams
        self.kinds, self.kind_from, self.of_kind = Counter(), Counter(), Counter()
        for (a, b), n in self.pair.items():
            self.count[b] += n
            self.total[a] += n
            self.kinds[_kind(a), _kind(b)] += n
            self.kind_from[_kind(a)] += n
            self.of_kind[_kind(b)] += n
        self.cache: dict[str, tuple[dict[int, float], dict[int, str]]] = {}
        self.logs: dict[tuple[str, str], float] = {}
        first = [ENTER_MULTI if true == "utf-8" else ENTER_SINGLE for true, _, _ in PAIRS]
        self.enter = [-math.log(min(1.0, math.exp(-cost) + statistics.shares.get(p, 0.0))) for p, cost in enumerate(first)]

    def log(self, before: str, c: str) -> float:
        key = before, c
        if key not in self.logs:
            self.logs[key] = self._log(_class_of(before) if before else "", c)
        return self.logs[key]

    def _log(self, a: str, c: str) -> float:
        b = _class_of(c)
        ka, kb = _kind(a), _kind(b)
        follows = (self.kinds[ka, kb] + 0.01) / (self.kind_from[ka] + 1.0)
        among = (self.count[b] + _floor(c) * 1000) / (self.of_kind[kb] + 1.0)
        return math.log((self.pair.get((a, b), 0) + BACKOFF * follows * min(among, 1.0)) / (self.total[a] + BACKOFF))

    def gains(self, token: str) -> tuple[dict[int, float], dict[int, str]]:
        """For each pair that can be in the token: by how much a path through its state beats the clean one, in nats, and what it restores."""
        if token not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[token] = self._gains(token)
        return self.cache[token]

    def _gains(self, token: str) -> tuple[dict[int, float], dict[int, str]]:
        clean = sum(self.log(token[i - 1] if i else "", c) for i, c in enumerate(token))
        gain, text, units_of = {}, {}, {}
        for p in range(len(PAIRS)):
            units = {i: got for i, c in enumerate(token) if c > "\x7f" and (got := self.inverse(p, token, i))}
            if units:
                units_of[p] = units
                score, restored = self._viterbi(token, units)
                if restored != token and score > clean + LEAST_GAIN:
                    gain[p], text[p] = score - clean, restored
        if len(gain) > 1:  # spans of several pairs may explain more than any one
            score, restored, used = self._mixed(token, {p: units_of[p] for p in gain})
            if len(used) > 1 and score - clean > max(gain.values()):
                for p in used:
                    gain[p], text[p] = score - clean, restored
        return gain, text

    def _mixed(self, token: str, units_of: dict[int, dict[int, tuple[str, int]]]) -> tuple[float, str, set[int]]:
        """The best path through the states of several pairs, and which of them it uses. A state is a pair and whether the last character was garbled."""
        best: list[dict[tuple[int, bool], tuple]] = [{} for _ in range(len(token) + 1)]
        best[0] = {(p, garbled): (0.0, "", 0, None, "") for p in units_of for garbled in (False, True)}
        for i, c in enumerate(token):
            if not best[i]:
                continue
            top = max(best[i], key=lambda s: best[i][s][0])
            for p, units in units_of.items():
                came = [((q, g), cost) for (q, g), cost in (((p, False), 0.0), ((p, True), 0.0), (top, CHANGE if top[0] != p else 0.0)) if (q, g) in best[i]]
                for state, cost in came:
                    score, before = best[i][state][:2]
                    steps = [(i + 1, state[1] and c <= "\x7f", c, SWITCH if state[1] and c > "\x7f" else 0.0)]
                    if i in units:
                        steps.append((i + units[i][1], True, units[i][0], 0.0 if state[1] else SWITCH))
                    for end, garbled, emitted, change in steps:
                        total = score - cost - change + self.log(before, emitted)
                        if (p, garbled) not in best[end] or total > best[end][p, garbled][0]:
                            best[end][p, garbled] = (total, emitted, i, state, emitted)
        state = max(best[-1], key=lambda s: best[-1][s][0])
        total, out, used, at = best[-1][state][0], [], set(), len(token)
        while at:
            _, _, start, came, emitted = best[at][state]
            if emitted != token[start:at]:
                used.add(state[0])
            out.append(emitted)
            at, state = start, came
        return total, "".join(reversed(out)), used

    def _viterbi(self, token: str, units: dict[int, tuple[str, int]]) -> tuple[float, str]:
        """The best path through the clean state (0) and one pair's (1); ASCII reads the same in both, so a span goes on across it."""
        n = len(token)
        best: list[list[tuple | None]] = [[None, None] for _ in range(n + 1)]
        best[0] = [(0.0, "", 0, 0, ""), (0.0, "", 0, 0, "")]
        for i, c in enumerate(token):
            for state in (0, 1):
                if not best[i][state]:
                    continue
                score, before = best[i][state][:2]
                steps = [(i + 1, 0 if c > "\x7f" else state, c, SWITCH if state and c > "\x7f" else 0.0)]
                if i in units:
                    steps.append((i + units[i][1], 1, units[i][0], 0.0 if state else SWITCH))
                for end, to, emitted, cost in steps:
                    total = score + self.log(before, emitted) - cost
                    if best[end][to] is None or total > best[end][to][0]:
                        best[end][to] = (total, emitted, i, state, emitted)
        state = max((s for s in (0, 1) if best[n][s]), key=lambda s: best[n][s][0])
        total, out, at = best[n][state][0], [], n
        while at:
            _, _, start, came, emitted = best[at][state]
            out.append(emitted)
            at, state = start, came
        return total, "".join(reversed(out))

    def label(self, tokens: list[str]) -> list[str | None]:
        """For each of a value's tokens in order, what it was if it is garbled, else None. A token that comes again is no new evidence and reads as at first.

        One Viterbi decoding of the value: it begins in the clean state; a
        pair's state is entered at the cost of its transition and kept at
        none, as damage runs through a value and weak signs in many tokens
        add up; CHANGE leads from pair to pair. Tokens that no pair explains
        are as likely in every state, so they are passed over.
        """
        out = {t: t if LOST in t else None for t in tokens}
        told = [(t, *found) for t in out if (found := self.gains(t))[0]]
        score, back = {None: 0.0}, []
        for _, gain, _ in told:
            top = max((s for s in score if s is not None), key=lambda s: (score[s], -s), default=None)
            reached, came = {None: 0.0}, {None: None}
            for p in {*gain, *score} - {None}:
                ways = [(0.0 - self.enter[p], None)]
                if p in score:
                    ways.append((score[p], p))
                if top is not None and top != p:
                    ways.append((score[top] - CHANGE, top))
                best, came[p] = max(ways, key=lambda w: w[0])
                reached[p] = best + gain.get(p, 0.0)
            back.append(came)
            score = reached
        state = max(score, key=lambda s: (score[s], s is None, -(s or 0)))
        for (t, _, text), came in zip(reversed(told), reversed(back), strict=True):
            if state in text:
                out[t] = text[state]
            state = came[state]
        return [out[t] for t in tokens]


def _tokens(value: Column) -> Column:
    return F.filter(F.split(value, BETWEEN, -1), lambda t: t.rlike(NOT_ASCII))


def clean_bigrams(values: DataFrame, column: str) -> Statistics:
    """Counts of character pairs in the tokens that hold more than ASCII, and how often each encoding pair explains one, over all rows.

    Tokens are counted in the JVM before the shuffle; the driver gets pairs
    of the model's alphabet that occur (it has at most some 12,000 symbols, as
    large scripts count as one symbol each), whatever the number of rows.
    """
    spark = values.sparkSession
    tokens = checkpoint(values.where(F.col(column).rlike(NOT_ASCII)).select(F.explode(_tokens(F.col(column))).alias("token")).groupBy("token").count())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inverse, pairs = Inverse(PAIRS), Counter()
        for batch in batches:
            for token, n in zip(batch["token"], batch["count"], strict=True):
                if inverse.structural(token):
                    continue
                before = ""
                for c in token:
                    symbol = _class_of(c)
                    pairs[before, symbol] += n
                    before = symbol
        yield pd.DataFrame([(a, b, n) for (a, b), n in pairs.items()], columns=["a", "b", "n"])

    rows = tokens.mapInPandas(count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    seen = Statistics({(r.a, r.b): r.n for r in rows})
    shared = share(spark, seen)

    def explained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, by = Model(shared.value), Counter()
        for batch in batches:
            for token, n in zip(batch["token"], batch["count"], strict=True):
                gain, _ = model.gains(token)
                if gain and max(gain[p] - model.enter[p] for p in gain) > 0:
                    by[max(gain, key=lambda p: (gain[p] - model.enter[p], -p))] += n
                by[-1] += n
        yield pd.DataFrame(list(by.items()), columns=["pair", "n"])

    by = {r.pair: r.n for r in tokens.mapInPandas(explained, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    seen.shares = {p: n / by[-1] for p, n in by.items() if p >= 0}
    return seen


def restore(values: DataFrame, column: str, statistics: Statistics) -> DataFrame:
    """`values` with `restored` (text as it was meant, as far as possible) and `garbled` (whether it held wrongly decoded characters).

    A null stays null and isn't garbled; U+FFFD is garbled but can't be
    restored. Genuine accents, symbols and scripts, and a leading U+FEFF, are
    left alone. Whole values are read. Columns named restored or garbled are
    replaced. ASCII values never leave the JVM.
    """
    shared = share(values.sparkSession, statistics)

    @F.pandas_udf("restored string, garbled boolean")
    def fix(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, word = Model(shared.value), re.compile(WORD)
        for texts in batches:
            rows = []
            for text in texts:
                if text is None or text.isascii():
                    rows.append((text, False))
                    continue
                labels = iter(model.label([t for t in word.findall(text) if not t.isascii()]))
                found = []

                def restored(m: "re.Match[str]", labels: Iterator = labels, found: list = found) -> str:
                    was = None if m[0].isascii() else next(labels)
                    if was is None:
                        return m[0]
                    found.append(was)
                    return was

                rows.append((word.sub(restored, text), bool(found)))
            yield pd.DataFrame(rows, columns=["restored", "garbled"])

    foreign = F.col(column).rlike(NOT_ASCII)
    return (
        values.withColumn("__fixed", fix(F.when(foreign, F.col(column))))
        .withColumn("restored", F.when(foreign, F.col("__fixed.restored")).otherwise(F.col(column)))
        .withColumn("garbled", F.coalesce(foreign & F.col("__fixed.garbled"), F.lit(False)))
        .drop("__fixed")
    )
