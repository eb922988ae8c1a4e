"""Spelling distance and the symmetric-delete neighbourhoods that find small ones."""

from __future__ import annotations

import unicodedata
from itertools import combinations

VOWELS = set("aeiouy")


def plain(text: str) -> str:
    """Lower case without accents; letters that don't decompose are spelled out."""
    text = unicodedata.normalize("NFKD", text.lower().replace("ß", "ss").replace("ł", "l").replace("ø", "o").replace("œ", "oe").replace("æ", "ae").replace("đ", "d").replace("ð", "d").replace("þ", "th"))
    return "".join(c for c in text if not unicodedata.combining(c))


def squeezed(text: str) -> str:
    """Only the letters and digits of a plain text."""
    return "".join(c for c in plain(text) if c.isalnum())


def deletes(word: str, depth: int) -> set[str]:
    """The word and what is left of it after up to `depth` deletions: words within that edit distance share one."""
    out = {word}
    for d in range(1, min(depth, len(word)) + 1):
        for gone in combinations(range(len(word)), d):
            drop = set(gone)
            out.add("".join(c for i, c in enumerate(word) if i not in drop))
    return out


def osa(a: str, b: str, limit: int) -> int:
    """Optimal string alignment distance (edits and swaps of neighbours), or limit + 1 if it is larger.

    Only the `limit` cells on either side of the diagonal can hold a distance
    within it, so the cost is the length times the limit.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    far = limit + 1
    before, row = {}, {j: j for j in range(min(len(b), limit) + 1)}
    for i, x in enumerate(a, 1):
        older, before, row = before, row, {}
        for j in range(max(0, i - limit), min(len(b), i + limit) + 1):
            best = before.get(j, far) + 1
            if j:
                y = b[j - 1]
                best = min(best, row.get(j - 1, far) + 1, before.get(j - 1, far) + (x != y))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    best = min(best, older.get(j - 2, far) + 1)
            row[j] = min(best, far)
        if min(row.values()) > limit and min(before.values(), default=far) > limit:
            return far
    return row.get(len(b), far)


def weighted(a: str, b: str) -> float:
    """Damerau-Levenshtein with weights: a swap or a doubled letter is a lighter slip than another letter; a vowel for a vowel is between."""
    n, m = len(a), len(b)
    d = [[0.0] * (m + 1) for _ in range(n + 1)]

    def gap(word: str, i: int) -> float:
        return 0.6 if i > 0 and word[i] == word[i - 1] else 1.0

    for i in range(1, n + 1):
        d[i][0] = d[i - 1][0] + gap(a, i - 1)
    for j in range(1, m + 1):
        d[0][j] = d[0][j - 1] + gap(b, j - 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            change = 0.0 if a[i - 1] == b[j - 1] else 0.8 if a[i - 1] in VOWELS and b[j - 1] in VOWELS else 1.0
            d[i][j] = min(d[i - 1][j] + gap(a, i - 1), d[i][j - 1] + gap(b, j - 1), d[i - 1][j - 1] + change)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 0.7)
    return d[n][m]


#: Longer words meet by pieces instead of deletions, of which they would leave too many.
LONG_WORD = 40


def met_under(word: str, slips: int) -> list[str]:
    """Keys of which two words share one if they are within `slips` edits or swaps of neighbours.

    Words of up to LONG_WORD letters: what deletions leave. From LONG_WORD -
    slips on also pieces: a word is cut into 2 slips + 1 of them, of which one
    stays whole, as an edit touches one and a swap two at most. Both words give
    their own pieces and those that another length or shift would have, marked
    by which is which, so that own pieces meet others'.
    """
    keys = deletes(word, slips) if len(word) <= LONG_WORD else {word}
    if slips and len(word) > LONG_WORD - slips:
        count = 2 * slips + 1
        for size in range(len(word) - slips, len(word) + slips + 1):
            cuts = [size * i // count for i in range(count + 1)]
            for i in range(count):
                for at in range(max(0, cuts[i] - slips), min(cuts[i] + slips, len(word)) + 1):
                    keys.add(f"{size}/{i}/{word[at : at + cuts[i + 1] - cuts[i]]}")
    return sorted(keys)


def assignment(cost: list[list[float]]) -> float:
    """The least sum of a square table with one cell of each row and column (infinite cells can't be taken): successive shortest augmenting paths."""
    n = len(cost)
    infinite = float("inf")
    of_row, of_column = [0.0] * n, [0.0] * (n + 1)
    row_at = [-1] * (n + 1)  # the row that has each column; the last column starts each search
    for row in range(n):
        row_at[n], column = row, n
        least, came, done = [infinite] * n, [n] * n, [False] * (n + 1)
        while row_at[column] >= 0:
            done[column] = True
            r, step, following = row_at[column], infinite, -1
            for j in range(n):
                if done[j]:
                    continue
                reduced = cost[r][j] - of_row[r] - of_column[j]
                if reduced < least[j]:
                    least[j], came[j] = reduced, column
                if least[j] < step:
                    step, following = least[j], j
            if following < 0:
                return infinite
            for j in range(n + 1):
                if done[j]:
                    of_row[row_at[j]] += step
                    of_column[j] -= step
                elif j < n:
                    least[j] -= step
            column = following
        while column != n:
            row_at[column] = row_at[came[column]]
            column = came[column]
    return sum(cost[row_at[j]][j] for j in range(n))
