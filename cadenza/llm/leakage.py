"""Evaluation texts leaking into training text.

Latent semantic retrieval: passages of documents and items are TF-IDF vectors
over word pairs, a distributed randomised SVD gives the latent space, and
passages of a high cosine, found by a hyperplane index over the items', give
candidates. Each candidate pair of document and item is then checked by
longest common subsequences: stretches of the item's words in order, over
small changes, of the item and of the question it ends with. Whole texts are
read.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.readability import sung_text
from cadenza.llm.sums import STRIPE, matrix_sum, striped
from cadenza.session import checkpoint, share

#: Word pairs share this many columns of the TF-IDF matrix, which bounds the model.
COLUMNS = 1 << 14
#: Passages are two neighbouring blocks of so many words; items' passages begin every ITEM_STEP words.
BLOCK, ITEM_STEP = 16, 8
RANK, OVERSAMPLE = 128, 16
#: Blocks worked on at a time, which bounds memory; so few where their rows are gathered that these stay in the cache.
SLICE, GATHER = 1 << 12, 1 << 8
SEED = 7
#: Cyrillic letters that look like Latin ones. Fixed values.
LOOKALIKES = str.maketrans("аеорсухіјѕһԁԛԝ", "aeopcyxijshdqw")
#: Characters that don't show: combining marks, soft hyphens, joiners and spaces without width, byte order marks.
HIDDEN = "\u0300-\u036f\u00ad\u200b-\u200f\u2060\ufeff"
INVISIBLE = re.compile(f"[{HIDDEN}]+")
BROKEN = re.compile(r"-(?<=[^\W\d_]-)[ \t]*\r?\n\s*(?=[^\W\d_])")
TOKEN = re.compile(f"[\\w{HIDDEN}]+|\x1e")


def word_number(word: str) -> int:
    """A word's number; -1 for what shows nothing."""
    if not word.isascii():
        word = INVISIBLE.sub("", unicodedata.normalize("NFKD", word.translate(LOOKALIKES)).replace("ß", "ss"))
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & 0x7FFFFFFF if word else -1


def words_of(texts: list[str | None]) -> list[np.ndarray]:
    """By text, its words as numbers: case, accents, punctuation, look-alike letters and line-end hyphens make no difference."""
    whole = "\x1e".join(sung_text(t, headers=True).replace("\x1e", " ") if t else "" for t in texts).lower().replace("_", " ")
    if "-\n" in whole or "-\r" in whole or "- " in whole:
        whole = BROKEN.sub("", whole)
    found = TOKEN.findall(whole)
    number = {w: word_number(w) for w in set(found)}
    number["\x1e"] = -2
    codes = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
    return [p[p >= 0].astype(np.int32) for p in np.split(codes, np.flatnonzero(codes == -2))]


def pairs(words: np.ndarray) -> np.ndarray:
    """The number of each pair of neighbouring words."""
    w = words.astype(np.int64)
    return (w[:-1] * 1_000_003 + w[1:]) % 2_147_483_647


class Blocks:
    """The word pairs of several documents, cut into blocks that don't cross documents; the last one of each is filled up with a column of zeros."""

    def __init__(self, documents: list[np.ndarray]):
        each = [pairs(d) if len(d) > 1 else np.zeros(0, np.int64) for d in documents]
        sizes = np.array([len(p) for p in each], int)
        counts = -(-sizes // BLOCK)
        self.pair = np.concatenate(each) if each else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(documents)), sizes)
        self.doc = np.repeat(np.arange(len(documents)), counts)
        place = np.arange(len(self.pair)) + np.repeat(np.cumsum(counts * BLOCK) - counts * BLOCK - (np.cumsum(sizes) - sizes), sizes)
        self.column = np.full(len(self.doc) * BLOCK, COLUMNS)
        self.column[place] = self.pair % COLUMNS

    def sums(self, matrix: np.ndarray) -> np.ndarray:
        """By block, the sum of its pairs' rows of the matrix, whose last row is zero."""
        out = np.zeros((len(self.doc), matrix.shape[1]), np.float32)
        for at in range(0, len(self.doc), GATHER):
            rows = matrix[self.column[at * BLOCK : (at + GATHER) * BLOCK]]
            out[at : at + GATHER] = np.einsum("bkd->bd", rows.reshape(-1, BLOCK, matrix.shape[1]))
        return out

    def passages(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of two neighbouring blocks of a document (a lone block is a passage), and whose they are."""
        n = len(self.doc)
        if not n:
            return sums, self.doc
        follows = np.append(self.doc[1:] == self.doc[:-1], False)
        alone = ~follows & np.append(True, self.doc[1:] != self.doc[:-1])
        at = np.flatnonzero(follows | alone)
        return sums[at] + np.where(follows[at][:, None], sums[np.minimum(at + 1, n - 1)], 0), self.doc[at]

    def spread(self, rows: np.ndarray, into: np.ndarray) -> None:
        """Adds each block's row to the columns of its pairs; `into` has a row for each of the row's values."""
        for at in range(0, len(self.doc), SLICE):
            column = self.column[at * BLOCK : (at + SLICE) * BLOCK]
            for k, of_block in enumerate(np.ascontiguousarray(rows[at : at + SLICE].T)):
                into[k] += np.bincount(column, np.repeat(of_block, BLOCK), len(into[k]))


def _batched(frames: Iterator[pd.DataFrame], words: str, size: int = 400) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    for frame in frames:
        for at in range(0, len(frame), size):
            part = frame.iloc[at : at + size]
            yield part, [np.frombuffer(b, np.int32) for b in part[words]]


def _summed(numbered: DataFrame, of_task: Callable[[Iterator[list[np.ndarray]]], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of the matrices that `of_task` makes of the documents' words, in as many tasks as there are cores, however many partitions there are."""
    context = numbered.sparkSession.sparkContext
    tasks = max(1, min(numbered.rdd.getNumPartitions(), context.defaultParallelism))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from striped(of_task(docs for _, docs in _batched(frames, "words")))

    return matrix_sum(numbered.select("words").coalesce(tasks).mapInPandas(run, STRIPE), shape, tasks)[0]


def inverse_frequency(numbered: DataFrame) -> np.ndarray:
    """IDF by column over all documents; a pair counts each time, as it hardly ever comes twice in a block."""

    def count(batches: Iterator[list[np.ndarray]]) -> np.ndarray:
        total = np.zeros(COLUMNS + 1)
        for docs in batches:
            b = Blocks(docs)
            total[:COLUMNS] += np.bincount(b.column, minlength=COLUMNS + 1)[:COLUMNS]
            total[COLUMNS] += len(b.doc)
        return total

    total = _summed(numbered, count, (COLUMNS + 1,))
    return np.maximum(np.log((total[COLUMNS] + 1) / (total[:COLUMNS] + 1)), 0.0).astype(np.float32)


def _with_zero(matrix: np.ndarray) -> np.ndarray:
    return np.concatenate([matrix, np.zeros((1, matrix.shape[1]))]).astype(np.float32)


def latent_space(numbered: DataFrame, idf: np.ndarray) -> np.ndarray:
    """COLUMNS x RANK: the leading right singular vectors of the blocks' TF-IDF matrix, times IDF.

    A randomised SVD in one distributed pass: tasks sum A'(A W) for a random
    W over all blocks; the driver gets one COLUMNS x (RANK + OVERSAMPLE)
    matrix and finishes by the Nystroem formula for A'A.
    """
    width = RANK + OVERSAMPLE
    random = np.random.RandomState(SEED).standard_normal((COLUMNS, width)).astype(np.float32)
    spark = numbered.sparkSession
    shared = share(spark, _with_zero(random * idf[:, None]))

    def sketch(batches: Iterator[list[np.ndarray]]) -> np.ndarray:
        total = np.zeros((width, COLUMNS + 1))
        for docs in batches:
            b = Blocks(docs)
            if len(b.doc):
                b.spread(b.sums(shared.value), total)
        return np.ascontiguousarray(total.T[:COLUMNS])

    y = _summed(numbered, sketch, (COLUMNS, width)) * idf[:, None]
    shared.destroy()
    core = random.T.astype(np.float64) @ y
    core = (core + core.T) / 2 + np.eye(width) * (1e-6 * np.trace(core) / width + 1e-12)
    values, vectors = np.linalg.eigh(core)
    good = values > values.max() * 1e-9
    left, scale, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return (left[:, :RANK] * idf[:, None]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)


class Probes:
    """Multi-table hyperplane hashing of the items' passages: which of them may be as near to a document's as `least_cosine`.

    Bits grow with the number of probes, so that a bucket holds a fraction of
    one whatever their number, and tables are what finds a pair of exactly
    that cosine with `target_recall`; nearer pairs are missed far more rarely.
    """

    def __init__(self, vectors: np.ndarray, owners: np.ndarray, least_cosine: float, target_recall: float):
        self.vectors, self.owners, self.least = vectors, owners, least_cosine
        self.bits = max(6, math.ceil(math.log2(max(2, len(vectors)))) + 2)
        alike = min(1 - 1e-9, 1 - math.acos(max(0.0, least_cosine)) / math.pi)  # how often a plane leaves both on one side
        self.tables = max(1, math.ceil(math.log(1 - target_recall) / math.log(1 - alike**self.bits)))
        self.planes = np.random.RandomState(SEED + 1).standard_normal((vectors.shape[1], self.tables * self.bits)).astype(np.float32)
        places = self.places(vectors).ravel()
        order = np.argsort(places, kind="stable")
        self.probe = (order // self.tables).astype(np.int32)
        counts = np.bincount(places, minlength=self.tables << self.bits)
        self.first = (np.cumsum(counts) - counts).astype(np.int32)
        self.count = counts.astype(np.int32)

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """A vector's bucket in each table, numbered through the tables."""
        signs = np.packbits((vectors @ self.planes > 0).reshape(len(vectors), self.tables, self.bits), axis=2, bitorder="little")
        buckets = signs[..., 0].astype(np.int32)
        for k in range(1, signs.shape[2]):
            buckets |= signs[..., k].astype(np.int32) << (8 * k)
        return buckets + (np.arange(self.tables, dtype=np.int32) << self.bits)

    def near(self, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The (passage, item) pairs of an exact cosine of at least the least, some more than once."""
        if not len(self.vectors) or not len(passages):
            return np.zeros(0, int), np.zeros(0, int)
        places = self.places(passages)
        used = np.flatnonzero(self.count[places])
        places = places.ravel()[used]
        n = self.count[places]
        row = np.repeat(used // self.tables, n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        probe = self.probe[np.repeat(self.first[places], n) + inside]
        close = np.concatenate([np.einsum("nd,nd->n", passages[row[at : at + 8192]], self.vectors[probe[at : at + 8192]]) >= self.least for at in range(0, len(row), 8192)] or [np.zeros(0, bool)])
        return row[close], self.owners[probe[close]]


class Item:
    """An item's words, where its pairs are, and where the question that it ends with begins (its size: none)."""

    def __init__(self, words: np.ndarray, asked_from: int | None = None):
        self.size = len(words)
        self.asked_from = self.size if asked_from is None else asked_from
        self.at: dict[int, list[int]] = defaultdict(list)
        for i, p in enumerate(pairs(words).tolist() if len(words) > 1 else []):
            self.at[p].append(i)
        self.pairs = np.array(sorted(self.at), np.int64)


class Shared:
    """Which items hold a pair: counts what documents and candidates have in common before they are aligned."""

    def __init__(self, items: list[Item]):
        held = sorted((p, k) for k, item in enumerate(items) for p in item.at)
        codes = np.array([p for p, _ in held], np.int64)
        self.item = np.array([k for _, k in held], np.int64)
        self.known, self.first = np.unique(codes, return_index=True)
        self.count = np.diff(np.append(self.first, len(codes)))
        self.items = len(items)

    def hits(self, b: Blocks, wanted: np.ndarray) -> np.ndarray:
        """How many pairs each document (a row of `wanted`, which says what documents are candidates for what items) and item have in common; 0 for documents without candidates."""
        some = np.flatnonzero(wanted.any(1)[b.owner]) if len(b.pair) else np.zeros(0, int)
        if not len(self.known) or not len(some):
            return np.zeros(wanted.shape, int)
        pair, owner = b.pair[some], b.owner[some]
        near = np.minimum(np.searchsorted(self.known, pair), len(self.known) - 1)
        at = np.flatnonzero(self.known[near] == pair)
        n = self.count[near[at]]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        items = self.item[np.repeat(self.first[near[at]], n) + inside]
        return np.bincount(np.repeat(owner[at], n) * self.items + items, minlength=wanted.size).reshape(wanted.shape)


def held_words(item: Item, document_pairs: np.ndarray, *, gap: int = 2, density: float = 0.7, loose: int = 10, strict: int = 8) -> np.ndarray:
    """Which of the item's words are in stretches that the document holds in order.

    A stretch is a chain of common word runs, at most `gap` other words apart
    on either side (changed, left out, added or split words), of which at
    least `density` are the same: either `strict` words in one run, or
    `loose` words in all, as short runs of set phrases meet by chance. Runs
    come in the document's order, so a chain that ends more than `gap` words
    before one is out of reach of all that follow. Half of a stretch's words
    at least begin a common pair, so pairs count only among so many that
    follow each other closely.
    """
    runs, open_run, held = [], {}, np.zeros(item.size, bool)
    if not len(item.pairs):
        return held
    place = np.searchsorted(item.pairs, document_pairs)
    common = np.flatnonzero(item.pairs[np.minimum(place, len(item.pairs) - 1)] == document_pairs)
    cluster = np.cumsum(np.diff(common, prepend=common[:1]) > gap + 2)
    common = common[np.bincount(cluster)[cluster] >= min(-(-loose // 2), strict - 1)]
    for j, p in zip(common.tolist(), document_pairs[common].tolist(), strict=True):
        for i in item.at[p]:
            run = open_run.get(j - i)
            if run and run[1] == i + 1:
                run[1] = i + 2
            else:
                run = open_run[j - i] = [i, i + 2, j - i]
                runs.append(run)
    runs.sort(key=lambda r: (r[0] + r[2], r[0]))
    tails: dict[int, list[tuple]] = defaultdict(list)
    for low, high, shift in runs:
        same, start, longest = high - low, low, high - low
        for step in range(-gap, gap + 1):
            if shift + step not in tails:
                continue
            near = tails[shift + step] = [t for t in tails[shift + step] if low - t[1] - step <= gap]
            for from_i, to_i, n, began, most in near:
                apart = max(low - to_i, low - to_i - step)
                overlap = max(0, to_i - low, to_i - low + step)
                if from_i < low and apart <= gap and overlap <= gap and overlap < high - low and n + high - low - overlap > same:
                    same, start, longest = n + high - low - overlap, began, max(most, high - low)
        tails[shift].append((low, high, same, start, longest))
        if same >= density * (high - start) and (same >= loose or longest >= strict):
            held[start:high] = True
    return held


QUESTION = re.compile(r"[^.!?…]*[?？]\s*$")


def leaked(
    documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", least_share: float = 0.4, least_cosine: float = 0.85, target_recall: float = 0.9, most_letters: int = 5_000_000
) -> DataFrame:
    """(doc_id, item_id, share, asked): the documents that hold at least `least_share` of an item's words in stretches.

    asked: the share of the words of the question at the item's end that are
    in such stretches, the check for items whose passage and question leaked
    together; null for an item without one. Items go to every task, so their
    texts' letters are counted first and may be `most_letters`. A candidate is
    a document with a passage whose latent cosine to a passage of the item is
    at least `least_cosine`, found by a hyperplane index; nothing else limits
    candidates. Null and empty texts match nothing; repeated rows give
    repeated results; other columns are ignored.
    """
    wanted = items.select(item_id, text).where(F.col(text).isNotNull())
    letters = wanted.agg(F.sum(F.length(text) + 1).alias("n")).first()["n"] or 0
    if letters > most_letters:
        raise ValueError(f"the items have {letters} letters, more than the {most_letters} that may be sent to every task")
    rows = wanted.collect()
    spark = documents.sparkSession
    kinds = {c: f.dataType.simpleString() for c, f in ((doc_id, documents.schema[doc_id]), (item_id, items.schema[item_id]))}

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 2000):
                part = frame.iloc[at : at + 2000]
                yield pd.DataFrame({doc_id: part[doc_id], "words": [w.tobytes() for w in words_of(list(part[text]))]})

    numbered = checkpoint(documents.select(doc_id, text).where(F.length(text) > 0).mapInPandas(number, f"`{doc_id}` {kinds[doc_id]}, words binary"))
    idf = inverse_frequency(numbered)
    space = latent_space(numbered, idf)
    words = words_of([r[1] for r in rows]) if rows else []
    before = words_of([QUESTION.sub("", r[1]) for r in rows]) if rows else []
    ids = [r[0] for r in rows]
    vectors, owners = [], []
    for k, w in enumerate(words):
        p = pairs(w) % COLUMNS if len(w) > 1 else np.zeros(0, np.int64)
        for at in range(0, max(1, len(p) - 2 * BLOCK + ITEM_STEP), ITEM_STEP):
            if len(part := p[at : at + 2 * BLOCK]):
                vectors.append(space[part].sum(0))
                owners.append(k)
    probes = Probes(_unit(np.array(vectors, np.float32).reshape(-1, space.shape[1])), np.array(owners, int), least_cosine, target_recall)
    shared = share(spark, (_with_zero(space), probes, [Item(w, min(len(b), len(w))) for w, b in zip(words, before, strict=True)], ids))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, probes, known, ids = shared.value
        common = Shared(known)
        least = np.array([0.35 * least_share * item.size for item in known])
        for part, docs in _batched(frames, "words"):
            b = Blocks(docs)
            passage, of = b.passages(b.sums(space))
            passage = _unit(passage)
            found = np.zeros((len(docs), len(known)), bool)
            for at in range(0, len(passage), 4096):
                row, item = probes.near(passage[at : at + 4096])
                found[of[at + row], item] = True
            # Stretches are dense in common runs of two words or more, so fewer common pairs than this reach no such share.
            out, last, of_doc = [], -1, np.zeros(0, np.int64)
            for d, k in np.argwhere(found & (common.hits(b, found) >= least)).tolist():
                if d != last:
                    last, of_doc = d, pairs(docs[d])
                held = held_words(known[k], of_doc)
                if len(held) and held.mean() >= least_share:
                    question = held[known[k].asked_from :]
                    out.append((part[doc_id].iloc[d], ids[k], float(held.mean()), float(question.mean()) if len(question) else None))
            if out:
                yield pd.DataFrame(out, columns=[doc_id, item_id, "share", "asked"])

    return numbered.mapInPandas(search, f"`{doc_id}` {kinds[doc_id]}, `{item_id}` {kinds[item_id]}, share double, asked double")
