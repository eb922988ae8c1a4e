"""Monotone alignment of two word sequences."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.similarity import Alike, similar_words


def likeness(a: list[str], b: list[str], alike: Callable[[str, str], bool]) -> np.ndarray:
    """Which words of `a` (rows) are similar to which of `b`; each two different words are looked at once."""
    rows, row_of = np.unique(np.array(a, object).astype(str), return_inverse=True)
    columns, column_of = np.unique(np.array(b, object).astype(str), return_inverse=True)
    table = np.array([[alike(str(x), str(y)) for y in columns] for x in rows], bool).reshape(len(rows), len(columns))
    return table[row_of][:, column_of]


def common_subsequence(a: list[str], b: list[str], alike: Callable[[str, str], bool] = similar_words) -> list[tuple[int, int]]:
    """The longest pairing of similar words that runs forward in both lists; of equally long ones, each pair in turn is the earliest possible in `a`, then in `b`.

    A similar pair's rank is the length of the longest pairing that begins
    with it. From the last word of `a` to the first, `begins[r]` is the last
    place in `b` at which a pairing of r + 1 words begins; it falls as r
    grows, so a search in it ranks a pair. Pairs of falling rank are the result.
    """
    if not a or not b:
        return []
    like = likeness(a, b, alike)
    begins: list[int] = []
    ranked: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i in reversed(range(len(a))):
        places = np.flatnonzero(like[i]).tolist()
        ranks = [bisect_left(begins, -j, key=int.__neg__) for j in places]  # how many pairings begin after place j
        for j, r in zip(places, ranks, strict=True):
            ranked[r].append((i, j))
            if r == len(begins):
                begins.append(j)
            else:
                begins[r] = max(begins[r], j)
    out, last = [], (-1, -1)
    for r in reversed(range(len(begins))):
        last = min(p for p in ranked[r] if p[0] > last[0] and p[1] > last[1])
        out.append(last)
    return out


def _first_best(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest value so far at each place, and where it came first."""
    best = np.maximum.accumulate(values)
    new = np.append(True, best[1:] > best[:-1])
    return best, np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))


def affine_pairs(a: list[str], b: list[str], gap: float = 2.0, alike: Callable[[str, str], bool] = similar_words) -> list[tuple[int, int]]:
    """The forward pairing of similar words with the best score: 1 a pair, less `gap` for each run of skipped words of either list, at the ends too.

    Row by row of `a`, a pair is reached from the pair right before it, from
    one further back in the same neighbouring row or column (one run), from
    any further back in both (two runs), or from the start. Ties go to the
    first of these. Nothing is paired if skipping everything scores best.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return []
    like = likeness(a, b, alike)
    nowhere = np.full(m, -np.inf)
    score, came = np.full((n, m), -np.inf), np.full((n, m), -1)
    above, above_row = nowhere.copy(), np.zeros(m, int)  # by column, the best of the rows before the last, and its row
    columns = np.arange(m)
    started = -gap * (columns > 0)
    for i in range(n):
        back = score[i - 1] if i else nowhere
        along, along_at = _first_best(back)
        both, both_at = _first_best(above)
        shift = lambda x, by, fill: np.concatenate([np.full(min(by, m), fill), x[: max(m - by, 0)]])
        options = np.stack(
            [shift(back, 1, -np.inf), shift(along, 2, -np.inf) - gap, shift(above, 1, -np.inf) - gap, shift(both, 2, -np.inf) - 2 * gap, started - gap * (i > 0)]
        )
        sources = np.stack(
            [(i - 1) * m + columns - 1, (i - 1) * m + shift(along_at, 2, 0), shift(above_row, 1, 0) * m + columns - 1, shift(above_row[both_at], 2, 0) * m + shift(both_at, 2, 0), np.full(m, -1)]
        )
        pick = options.argmax(0)
        score[i] = np.where(like[i], options[pick, columns] + 1, -np.inf)
        came[i] = sources[pick, columns]
        better = back > above
        above, above_row = np.where(better, back, above), np.where(better, i - 1, above_row)
    final = score - gap * (np.arange(n) < n - 1)[:, None] - gap * (columns < m - 1)
    at = int(final.argmax())
    out = []
    if final.flat[at] >= -2 * gap:
        while at >= 0:
            out.append(divmod(at, m))
            at = int(came.flat[at])
    return out[::-1]


def matching_blocks(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of the longest equal blocks, recursively."""
    return [(m.a + k, m.b + k) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for k in range(m.size)]


METHODS = {"subsequence": lambda a, b, alike: common_subsequence(a, b, alike), "affine": lambda a, b, alike: affine_pairs(a, b, alike=alike), "blocks": lambda a, b, alike: matching_blocks(a, b)}


def align(left: DataFrame, right: DataFrame, key: str | list[str], order: str, word: str, method: str = "subsequence") -> DataFrame:
    """(key, left order, right order) of aligned words, a group for each key (one column or several); keys of one side only give no rows.

    Costs words times words of one key, so keys must be songs or takes, not libraries.
    """
    pair, alike = METHODS[method], Alike()
    keys = [key] if isinstance(key, str) else key
    kinds = ", ".join(f"`{k}` {left.schema[k].dataType.simpleString()}" for k in keys)

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = (x[x[word].notna()].sort_values([order, word]) for x in (a, b))
        if not len(a) or not len(b):
            return pd.DataFrame({**{k: [] for k in keys}, "left_no": [], "right_no": []})
        pairs = pair(list(a[word]), list(b[word]), alike)
        return pd.DataFrame({**{k: a[k].iloc[0] for k in keys}, "left_no": [int(a[order].iloc[i]) for i, _ in pairs], "right_no": [int(b[order].iloc[j]) for _, j in pairs]})

    # New columns on both sides: those of one table could not be told apart.
    sides = [df.select(*[F.col(c).alias(c) for c in (*keys, order, word)]).groupBy(*keys) for df in (left, right)]
    return sides[0].cogroup(sides[1]).applyInPandas(one, f"{kinds}, left_no long, right_no long")
