"""Reading level of each document.

A regularised ordinal regression grades sentences by lexical diversity, word
rarity (in the corpus, and in graded text of each level), connectives, a
clause-depth proxy and lengths; a document has the level of most of its
sentences. The regression is fitted to graded documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import share

LEVELS = 3
#: Words share this many counters in the corpus table, which bounds the model's size.
BUCKETS = 1 << 18
#: Words that join clauses or sentences in English, German and Spanish. Fixed values.
CONNECTIVES = set(
    "because although while whereas since unless until though however therefore thus hence moreover furthermore conversely notwithstanding insofar inasmuch whose which whereby thereby that when before after if so but and or as "
    "weil obwohl während bevor nachdem sofern insofern wenngleich sodass wobei deren dessen infolgedessen ungeachtet jedoch daher dass wenn als und aber oder denn "
    "porque aunque mientras cuando antes después sino si que cuya cuyo lo cual pues pero y o por tanto consiguiente obstante cuanto".split()
)
WORD = r"[^\W\d_]+(?:['’][^\W\d_]+)*"
TOKENS = re.compile(rf"{WORD}|[.!?…\n]+|[,;:()—–]|\x1e")
NOTE = re.compile(r"(?m)^[:*FRG] *-?\d+ +-?\d+ +-?\d+ ?(.*?) *$")
BREAK = re.compile(r"(?m)^-.*$")
HEADER = re.compile(r"(?m)^#(?:[^:\n]*:)?([^\n]*)$")


def sung_text(text: str, headers: bool = False) -> str:
    """The words of a song file, a line each, with or without what its header tags say; other texts as they are."""
    if not text.startswith(("#", "﻿#")) or not NOTE.search(text):
        return text
    text = BREAK.sub("\x1d", HEADER.sub("\\1\x1d" if headers else "", text.replace("﻿", "").replace("\r", "")))
    text = NOTE.sub(r"\1", text)
    return re.sub(r"\x1d", "\n", re.sub(r"\n", " ", text).replace(" ~", ""))


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


@dataclass
class Sentences:
    """Sentences of a batch of texts: which text each is of, and its sums over words."""

    doc: np.ndarray  # by sentence
    words: np.ndarray  # by sentence
    marks: np.ndarray  # by sentence: commas and the like
    word_ids: np.ndarray  # by word, into vocabulary
    sentence: np.ndarray  # by word
    vocabulary: list[str]


def read_sentences(texts: list[str | None]) -> Sentences:
    """All sentences of the texts, whole texts, in one pass over the batch."""
    found = TOKENS.findall("\x1e".join(sung_text(t).replace("\x1e", " ") if t else "" for t in texts).lower())
    ids: dict[str, int] = {}
    for t in set(found):
        ids[t] = len(ids)
    code = np.fromiter(map(ids.__getitem__, found), np.int64, len(found))
    vocabulary = list(ids)
    kind = np.array([0 if t[0].isalpha() else 3 if t == "\x1e" else 1 if t[0] in ".!?…\n" else 2 for t in vocabulary], np.int8)
    of = kind[code] if len(code) else np.empty(0, np.int8)
    doc = np.cumsum(of == 3)
    sentence = np.cumsum((of == 1) | (of == 3))
    is_word = of == 0
    used, inverse = np.unique(sentence[is_word], return_inverse=True)
    n = len(used)
    first = np.searchsorted(sentence[is_word], used)
    marks = np.zeros(n)
    at = sentence[of == 2]
    place = np.searchsorted(used, at)
    ok = (place < n) & (used[np.minimum(place, max(n - 1, 0))] == at) if n else np.zeros(len(at), bool)
    np.add.at(marks, place[ok], 1)
    return Sentences(doc[is_word][first] if n else np.empty(0, np.int64), np.bincount(inverse, minlength=n).astype(float), marks, code[is_word], inverse, vocabulary)


def corpus_counts(documents: DataFrame, text: str) -> np.ndarray:
    """How often the words of each counter occur in all documents, summed before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        words = re.compile(WORD)
        for batch in batches:
            total.update(words.findall("\n".join(t for t in batch[text] if t).lower()))
            if len(total) > 500_000:
                yield _counted(total)
                total.clear()
        yield _counted(total)

    rows = documents.select(text).mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(BUCKETS)
    table[rows["bucket"].to_numpy(int)] = rows["n"].to_numpy(float)
    return table


def _counted(total: Counter) -> pd.DataFrame:
    by: Counter = Counter()
    for word, n in total.items():
        by[bucket(word)] += n
    return pd.DataFrame({"bucket": np.fromiter(by.keys(), np.int32, len(by)), "n": np.fromiter(by.values(), np.int64, len(by))})


@dataclass
class Grader:
    """The fitted model: its size depends on the graded sample and the counters, not on the corpus."""

    rarity: np.ndarray  # by bucket
    graded: dict[str, np.ndarray]  # log probability of a word in sentences of each level
    unseen: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def features(self, s: Sentences) -> np.ndarray:
        n = len(s.words)
        if not n:
            return np.zeros((0, 8))
        length = np.array([len(w) for w in s.vocabulary], float)
        joins = np.array([w in CONNECTIVES for w in s.vocabulary], float)
        rare = np.array([self.rarity[bucket(w)] for w in s.vocabulary])
        level = np.array([self.graded.get(w, self.unseen) for w in s.vocabulary])
        mean = lambda x: np.bincount(s.sentence, x[s.word_ids], n) / s.words
        distinct = np.bincount(np.unique(s.sentence * len(s.vocabulary) + s.word_ids) // len(s.vocabulary), minlength=n)
        joined = mean(joins)
        return np.stack(
            [
                mean(length),
                np.log(s.words),
                distinct / s.words,
                mean(rare),
                joined,
                np.log1p(s.marks + joined * s.words),  # clause depth: what opens a clause
                np.clip(np.bincount(s.sentence, (level[:, 1] - level[:, 0])[s.word_ids], n) / np.sqrt(s.words), -8, 8),
                np.clip(np.bincount(s.sentence, (level[:, 2] - level[:, 1])[s.word_ids], n) / np.sqrt(s.words), -8, 8),
            ],
            axis=1,
        )

    def levels(self, s: Sentences) -> np.ndarray:
        """The likeliest level of each sentence, from 1."""
        if not len(s.words):
            return np.empty(0, int)
        score = ((self.features(s) - self.mean) / self.scale) @ self.weights
        below = 1 / (1 + np.exp(-(self.cuts[None, :] - score[:, None])))
        return np.diff(np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], 1), axis=1).argmax(1) + 1


def _ordinal_fit(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Proportional odds by gradient steps (Adam) with an L2 penalty; y from 0."""
    n, k = x.shape
    theta = np.concatenate([np.zeros(k), [-1.0, np.log(2.0)]])  # weights, first cut, log of the step to the next
    m, v = np.zeros(k + 2), np.zeros(k + 2)
    for t in range(1, rounds + 1):
        w, cuts = theta[:k], np.array([theta[k], theta[k] + np.exp(theta[k + 1])])
        score = x @ w
        p = 1 / (1 + np.exp(-np.clip(cuts[None, :] - score[:, None], -40, 40)))
        low, high = np.concatenate([np.zeros((n, 1)), p], 1), np.concatenate([p, np.ones((n, 1))], 1)
        at = np.arange(n)
        lo, hi = low[at, y], high[at, y]
        chance = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / chance, lo * (1 - lo) / chance
        dhi[y == LEVELS - 1] = 0
        dlo[y == 0] = 0
        dscore = -(dhi - dlo)
        dcut = np.array([dhi[y == 0].sum() - dlo[y == 1].sum(), dhi[y == 1].sum() - dlo[y == 2].sum()]) / n
        g = np.concatenate([-(x.T @ dscore) / n + penalty * w, [-dcut.sum(), -dcut[1] * np.exp(theta[k + 1])]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:k], np.array([theta[k], theta[k] + np.exp(theta[k + 1])])


def fit(texts: list[str], levels: list[float], counts: np.ndarray, *, penalty: float = 1e-4, rounds: int = 4) -> Grader:
    """A grader from graded documents.

    A graded document may hold sentences of other levels: the words' levels
    start from the documents' grades, then sentences are told apart by their
    words and their document's grade, and the words counted anew. The
    regression learns the sentences' levels so found.
    """
    s = read_sentences(texts)
    grade = np.clip(np.round(np.asarray(levels)), 1, LEVELS).astype(int) - 1
    y, doc = grade[s.doc], grade[s.doc]
    prior = np.log(np.where(np.arange(LEVELS)[None, :] == doc[:, None], 0.8, 0.1))
    size = len(s.vocabulary)
    for _ in range(rounds):
        table = np.stack([np.bincount(s.word_ids, (y == k)[s.sentence].astype(float), size) for k in range(LEVELS)], 1) + 0.1
        logs = np.log(table / table.sum(0))
        score = np.stack([np.bincount(s.sentence, logs[s.word_ids, k], len(s.words)) for k in range(LEVELS)], 1)
        y = (score + prior).argmax(1)
    used = np.bincount(s.word_ids, minlength=size) > 0
    total = counts.sum() + BUCKETS
    grader = Grader(-np.log((counts + 1) / total), {w: logs[i] for i, w in enumerate(s.vocabulary) if used[i]}, np.zeros(LEVELS), np.zeros(8), np.ones(8), np.zeros(8), np.zeros(2))
    x = grader.features(s)
    grader.mean, grader.scale = x.mean(0), x.std(0) + 1e-9
    grader.weights, grader.cuts = _ordinal_fit((x - grader.mean) / grader.scale, y, penalty)
    return grader


def document_levels(grader: Grader, texts: list[str | None]) -> list[int | None]:
    """The level of most sentences of each text; a tie goes to the level nearer the mean; None without a sentence."""
    s = read_sentences(texts)
    votes = np.zeros((len(texts), LEVELS))
    np.add.at(votes, (s.doc, grader.levels(s) - 1), 1)
    total = votes.sum(1)
    mean = (votes @ np.arange(LEVELS)) / np.maximum(total, 1)
    best = (votes - 1e-6 * np.abs(np.arange(LEVELS)[None, :] - mean[:, None])).argmax(1) + 1
    return [int(b) if t else None for b, t in zip(best, total, strict=True)]


def graded_sample(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, level: str, most: int, longest: int) -> pd.DataFrame:
    """Graded documents with the mean of their raters' levels: all of them up to `longest` letters, or `most` of them picked by a hash of the id."""
    grades = labels.where(F.col(level).isNotNull()).groupBy(doc_id).agg(F.avg(level).alias("grade"))
    lengths = documents.select(doc_id, F.length(text).alias("__letters")).where(F.col("__letters").between(1, longest))
    picked = grades.join(lengths, doc_id).orderBy(F.xxhash64(doc_id), doc_id).limit(most).drop("__letters")
    return documents.select(doc_id, text).where(F.length(text).between(1, longest)).join(F.broadcast(picked), doc_id).toPandas()


def reading_levels(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", level: str = "reading_level", most_graded: int = 2_000, longest_graded: int = 100_000) -> DataFrame:
    """(doc_id, reading_level) for every row of `documents`; null for a null text or one without words.

    The model is fitted on the driver to at most `most_graded` graded
    documents of at most `longest_graded` letters each, which bounds what the
    driver gets; corpus word counts cover all documents, and whole texts are
    graded in one pass without a shuffle. Other columns are ignored.
    Without any label an error is raised.
    """
    sample = graded_sample(documents, labels, doc_id, text, level, most_graded, longest_graded)
    if not len(sample):
        raise ValueError("no graded document to fit to")
    grader = fit(list(sample[text]), list(sample["grade"]), corpus_counts(documents, text))
    shared = share(documents.sparkSession, grader)
    id_type = documents.schema[doc_id].dataType.simpleString()

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({doc_id: batch[doc_id], "reading_level": pd.array(document_levels(shared.value, list(batch[text])), "Int32")})

    return documents.select(doc_id, text).mapInPandas(grade, f"`{doc_id}` {id_type}, reading_level int")
