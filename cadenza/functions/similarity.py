"""String similarities that differ from each other and are never substituted for one another."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.session import checkpoint, unsent


def fold_word(text: str | None) -> str | None:
    """Lower case, no accents, letters only."""
    return None if text is None else "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if c.isalpha())


def normal_name(text: str | None) -> str | None:
    """Accents out, anything but letters and digits a blank, blanks collapsed."""
    if text is None:
        return None
    bare = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    return " ".join("".join(c if c.isalnum() else " " for c in bare).split())


def indel_ratio(a: str, b: str) -> float:
    """1 minus insertions and deletions over both lengths: twice the longest common subsequence over them."""
    if not a and not b:
        return 1.0
    codes = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    row = np.zeros(len(b) + 1, np.int64)
    for x in map(ord, a):  # a match adds one to what is common before it; the best so far runs on
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(codes == x, row[:-1] + 1, 0)))
    return 2.0 * int(row[-1]) / (len(a) + len(b))


def block_ratio(a: str, b: str) -> float:
    """The ratio of matching blocks; the order of the arguments matters."""
    return SequenceMatcher(None, a, b).ratio()


def osa(a: str, b: str) -> int:
    """Edits and swaps of neighbouring letters that make one string the other, no letter touched twice."""
    older, before, row = [], [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            swap = older[j - 2] + 1 if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2] else i + j
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y), swap))
    return row[-1]


def similar_words(a: str, b: str, least: float = 0.7) -> bool:
    """Equal, or of like length and a ratio of at least `least`."""
    if a == b or not a or not b or min(len(a), len(b)) / max(len(a), len(b)) < 0.5:
        return a == b
    blocks = SequenceMatcher(None, a, b)
    return blocks.real_quick_ratio() >= least and blocks.quick_ratio() >= least and blocks.ratio() >= least


class Alike:
    """similar_words with its answers kept, up to 200,000 of them: songs share most of their words."""

    def __init__(self, least: float = 0.7):
        self.least = least
        self.known: dict[tuple[str, str], bool] = {}

    def __call__(self, a: str, b: str) -> bool:
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) >= 200_000:
                self.known.clear()
            found = self.known[a, b] = similar_words(a, b, self.least)
        return found


def _each(f, kind: T.DataType):
    @F.pandas_udf(kind)
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)])

    return apply


def block_ratio_column(a: Column, b: Column) -> Column:
    return _each(block_ratio, T.DoubleType())(a, b)


def indel_ratio_column(a: Column, b: Column) -> Column:
    return _each(indel_ratio, T.DoubleType())(a, b)


def osa_column(a: Column, b: Column) -> Column:
    return _each(osa, T.IntegerType())(a, b)


def fold_word_column(x: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(fold_word, na_action="ignore"), T.StringType(), functionType=F.PandasUDFType.SCALAR)(x)


def _at_least(least: float, a: Column, b: Column) -> Column:
    """The ratio of matching blocks, null where a name is missing, -1 where cheap bounds show it below `least`."""

    def ratio(x: str, y: str) -> float:
        m = SequenceMatcher(None, x, y)
        return m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else -1.0

    return _each(ratio, T.DoubleType())(a, b)


#: Names of a block on either side, and of the parts of it that are compared at once.
LEFT_BLOCK, RIGHT_BLOCK, PART = 2048, 8192, 1024
#: Letters are told apart in so many classes, and counted up to so many of each; longer names aren't compared letter by letter before their ratio.
CLASSES, COUNTED, BITS = 32, 4, 64


class Letters:
    """Names as numbers, shortest first: their letters' classes in order (filled up with -1), and a 1 for each of the first, second, ... letter of a class."""

    def __init__(self, names: list[str]):
        self.names = sorted(names, key=len)
        self.size = np.array([len(n) for n in self.names], np.int64)
        codes = np.frombuffer("".join(self.names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        kinds = np.where((codes >= 97) & (codes <= 122), codes - 97, np.where(codes == 32, 26, np.where((codes >= 48) & (codes <= 57), 27, 28 + codes % 4)))
        row = np.repeat(np.arange(len(names)), self.size)
        at = np.arange(len(codes)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        short = at < BITS
        self.kinds = np.full((len(names), BITS), -1, np.int8)
        self.kinds[row[short], at[short]] = kinds[short]
        self.places = np.zeros((len(names), CLASSES), np.uint64)  # of each class, as bits
        np.bitwise_or.at(self.places, (row[short], kinds[short]), np.uint64(1) << at[short].astype(np.uint64))
        counts = np.bincount(row * CLASSES + kinds, minlength=len(names) * CLASSES).reshape(len(names), CLASSES)
        self.ones = (counts[:, :, None] > np.arange(COUNTED)).astype(np.float32).reshape(len(names), -1)
        self.more = np.maximum(counts - COUNTED, 0).sum(1)


def _common(a: Letters, b: Letters, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The longest common subsequences' lengths, of letters' classes, for pairs of names of at most BITS letters: a bit for each place of b, all pairs at once."""
    places, left = b.places[j], np.full(len(i), ~np.uint64(0))
    kinds, row = a.kinds[i], np.arange(len(i))
    for at in range(int(a.size[i].max(initial=0))):
        kind = kinds[:, at]
        match = left & np.where(kind >= 0, places[row, kind], np.uint64(0))
        left = (left + match) | (left - match)
    inside = np.where(b.size[j] >= BITS, ~np.uint64(0), (np.uint64(1) << np.minimum(b.size[j], BITS - 1).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~left & inside).astype(np.int64)


def may_be_alike(a: Letters, b: Letters, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs whose ratio of matching blocks may be `least`, for blocks match no more than the letters in common, nor than a common subsequence."""
    for x in range(0, len(a.names), PART):
        for y in range(0, len(b.names), PART):
            of, to = slice(x, x + PART), slice(y, y + PART)
            if 2 * min(a.size[of][-1], b.size[to][-1]) < (least - 1e-9) * (a.size[of][0] + b.size[to][0]):
                continue
            need = (least / 2 - 1e-9) * (a.size[of][:, None] + b.size[to]).astype(np.float32)
            i, j = np.nonzero(a.ones[of] @ b.ones[to].T + a.more[of][:, None].astype(np.float32) >= need - 1e-3)
            i, j = i + x, j + y
            for at in range(0, len(i), 1 << 18):
                m, n = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
                keep = (a.size[m] > BITS) | (b.size[n] > BITS)
                rest = np.flatnonzero(~keep)
                keep[rest] = 2 * _common(a, b, m[rest], n[rest]) >= (least - 1e-9) * (a.size[m[rest]] + b.size[n[rest]])
                yield m[keep], n[keep]


def similar_names(left: DataFrame, right: DataFrame, least: float, *, exact: bool = True) -> DataFrame:
    """(l_name, r_name, ratio): all pairs of different values of two columns `name` with a ratio of matching blocks of at least `least`.

    All blocks of both sides meet, each two in a task of its own, where bounds
    that cost little decide nearly all pairs. The work is the product of both
    numbers of names. Not `exact`: (l_name, r_name) of what the bounds leave.
    """

    def blocks(df: DataFrame, most: int) -> tuple[DataFrame, int]:
        df = checkpoint(df.where("name is not null").select("name").distinct())
        return df, max(1, math.ceil(df.count() / most))

    (left, ls), (right, rs) = blocks(left, LEFT_BLOCK), blocks(right, RIGHT_BLOCK)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("name"), F.lit(n)).cast("int")
    a, b = left.select("name", own(ls).alias("l"), all_of(rs).alias("r")), right.select("name", all_of(ls).alias("l"), own(rs).alias("r"))

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found: tuple[list, list, list] = ([], [], [])
        if len(x) and len(y):
            p, q = Letters(list(x["name"])), Letters(list(y["name"]))
            for i, j in may_be_alike(p, q, least):
                matcher, at = SequenceMatcher(), -1
                order = np.argsort(j, kind="stable")
                for m, n in zip(i[order].tolist(), j[order].tolist(), strict=True):
                    if exact:
                        if n != at:  # what it knows of the second name is kept
                            matcher.set_seq2(q.names[n])
                            at = n
                        matcher.set_seq1(p.names[m])
                    if not exact or matcher.quick_ratio() >= least and matcher.ratio() >= least:
                        for of, v in zip(found, (p.names[m], q.names[n], matcher.ratio() if exact else None), strict=True):
                            of.append(v)
        return pd.DataFrame(dict(zip(("l_name", "r_name", "ratio"), found, strict=True)))

    parts = min(ls * rs, 4096)
    met = [df.repartition(parts, "l", "r").groupBy("l", "r") for df in (a, b)]
    pairs = met[0].cogroup(met[1]).applyInPandas(compare, "l_name string, r_name string, ratio double")
    return pairs if exact else pairs.drop("ratio")


def _forms(df: DataFrame, names: list[str], p: str) -> tuple[DataFrame, DataFrame]:
    """`df` with <p>form, a number, in place of its names; and what it stands for, the different names made normal: (<p>form, <p><name>...)."""
    normal = F.pandas_udf(lambda s: s.map(normal_name, na_action="ignore"), T.StringType(), functionType=F.PandasUDFType.SCALAR)
    others = [c for c in df.columns if c not in names]
    rows = checkpoint(df.select(*others, *[normal(F.col(n)).alias(p + n) for n in names]))
    forms = checkpoint(rows.select(*[p + n for n in names]).distinct().withColumn(p + "form", F.monotonically_increasing_id()))
    numbers = forms.select(p + "form", *[F.col(p + n).alias("__" + n) for n in names])
    met = rows.join(unsent(numbers), [F.col(p + n).eqNullSafe(F.col("__" + n)) for n in names])
    return checkpoint(met.select(*others, p + "form")), forms


def similar_forms(a: DataFrame, b: DataFrame, names: list[str], least: float) -> DataFrame:
    """(l_form, r_form, score): all pairs of forms whose worst name ratio is at least `least`, once.

    A missing name doesn't count. Forms meet by the first name that both have
    and by the next one, as far as both have it, so a band of many songs
    isn't compared with itself whole; no pair is lost.
    """
    pairs = None
    near = [checkpoint(similar_names(a.select(F.col("l_" + n).alias("name")), b.select(F.col("r_" + n).alias("name")), least, exact=not i)) for i, n in enumerate(names)]
    for i, n in enumerate(names):
        first = near[0] if i == 0 else near[i].withColumn("ratio", _at_least(least, F.col("l_name"), F.col("r_name"))).where(F.col("ratio") >= least)
        alike = first.select(F.col("l_name").alias("l_" + n), F.col("r_name").alias("r_" + n), F.col("ratio").alias("first"))
        lefts, rest = a.join(unsent(alike), "l_" + n), names[i + 1 :]
        ways = []
        if rest:  # by the next name too; where one form lacks it, by this one alone
            l_next, r_next = "l_" + rest[0], "r_" + rest[0]
            rights = b.join(unsent(near[i + 1].select(F.col("l_name").alias(l_next), F.col("r_name").alias(r_next))), r_next)
            ways = [lefts.join(unsent(rights), ["r_" + n, l_next]), lefts.where(F.col(l_next).isNull()).join(unsent(b), "r_" + n), lefts.where(F.col(l_next).isNotNull()).join(unsent(b.where(F.col(r_next).isNull())), "r_" + n)]
        for met in ways or [lefts.join(unsent(b), "r_" + n)]:
            for x in names[:i]:
                met = met.where(F.col("l_" + x).isNull() | F.col("r_" + x).isNull())
            ratios = [_at_least(least, F.col("l_" + x), F.col("r_" + x)) for x in rest]
            score = F.least("first", *ratios) if ratios else F.col("first")
            met = met.select("l_form", "r_form", score.alias("score"))
            pairs = met if pairs is None else pairs.union(met)
    return pairs.where(F.col("score") >= least)


def fuzzy_best(left: DataFrame, right: DataFrame, row: str, candidate: str, names: list[str], *, least: float = 0.9, k: int = 3) -> DataFrame:
    """For each left row the k right rows whose worst name ratio is at least `least`: row, candidate, score, place.

    Different names are compared once, however many rows have them, and of the
    rows of a right form only the k that can be among the best go on.
    """
    from cadenza.operators.joins import top_of

    rows, a = _forms(left.select(row, *names), names, "l_")
    offers, b = _forms(right.select(candidate, *names), names, "r_")
    offers = top_of(offers, ["r_form"], [F.col(candidate)], k).drop("place")
    order = [F.desc("score"), F.col(candidate)]
    met = similar_forms(a, b, names, least).join(unsent(offers), "r_form").select("l_form", candidate, "score")
    best = top_of(met, ["l_form"], order, k).drop("place")
    return top_of(rows.join(unsent(best), "l_form").select(row, candidate, "score"), [row], order, k)


def fuzzy_first(left: DataFrame, right: DataFrame, row: str, names: list[str], rank: list[str], *, least: float) -> DataFrame:
    """Each left row with the least `rank` (columns of the right) of the right rows whose worst name ratio is at least `least`; rows without any are left out.

    Only the first row of each right form and of each left form goes on, so
    rows that share their names aren't paired with each other.
    """
    rows, a = _forms(left.select(row, *names), names, "l_")
    offers, b = _forms(right.select(*rank, *names), names, "r_")
    firsts = offers.groupBy("r_form").agg(F.min(F.struct(*rank)).alias("of"))
    best = similar_forms(a, b, names, least).join(unsent(firsts), "r_form").groupBy("l_form").agg(F.min("of").alias("of"))
    return rows.join(unsent(best), "l_form").groupBy(row).agg(F.min("of").alias("of")).select(row, "of.*")
