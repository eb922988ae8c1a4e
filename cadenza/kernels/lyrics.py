"""Lyrics against what is heard: missing lines, words placed back, anchors, heard shares."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.similarity import Alike, fold_word, similar_words
from cadenza.kernels.align import affine_pairs, common_subsequence


def _folded(words: list[str]) -> list[str]:
    return [f for w in words if (f := fold_word(w))]


def looping(words: list[str], least: int = 6) -> set[int]:
    """The places of words in runs of `least` or more of the same one."""
    change = np.flatnonzero([True, *(a != b for a, b in zip(words, words[1:], strict=False))]) if words else np.zeros(0, int)
    sizes = np.diff(np.append(change, len(words)))
    return {i for at, n in zip(change.tolist(), sizes.tolist(), strict=True) if n >= least and words[at] for i in range(at, at + n)}


def copies_in(run: list[str], lines: list[list[str]], alike: Callable[[str, str], bool] = similar_words, *, share: float = 0.6, different: int = 3) -> list[tuple[int | None, int, int]]:
    """A run of heard words covered from the left by copies of lyric lines: (line or None for words of no line, from, to).

    A copy begins like one of the line's first two words, holds at least
    `share` of its words in order, and `different` different ones of them (all
    of a line with fewer). Of several copies at a place the one with the most
    words in it is taken, of equal ones the first line's.
    """
    out: list[tuple[int | None, int, int]] = []
    folded_lines = [_folded(line) for line in lines]
    at = 0
    while at < len(run):
        opening, best = _folded(run[at : at + 2]), (0, None, 0)
        for k, line in enumerate(folded_lines):
            if not line or not any(alike(x, y) for x in opening for y in line[:2]):
                continue
            heard = [(i, f) for i, w in enumerate(run[at : at + len(line) + 2]) if (f := fold_word(w))]
            pairs = common_subsequence(line, [f for _, f in heard], alike)
            if len(pairs) >= share * len(line) and len({line[i] for i, _ in pairs}) >= min(different, len(set(line))) and len(pairs) > best[0]:
                best = len(pairs), k, heard[pairs[-1][1]][0] + 1
        if best[1] is not None:
            out.append((best[1], at, at + best[2]))
        elif out and out[-1][0] is None:
            out[-1] = None, out[-1][1], at + 1
        else:
            out.append((None, at, at + 1))
        at = out[-1][2]
    return out


def missing_lines(lines: list[list[str]], heard: list[str], alike: Callable[[str, str], bool] = similar_words, *, least: int = 3, most_copies: int = 2) -> list[tuple[int, str, int | None, int, int]]:
    """Lines that are heard but not in the lyrics: (line before which they belong, kind, line repeated, first and last heard word).

    Heard words that match no lyric word, `least` or more together between
    words of different lines, are a `repeat` of a line, up to `most_copies`
    times each, or `heard` as they are, which before the first and after the
    last line they aren't (spoken there); where neither holds they're for
    `review`. Words heard over and over don't count.
    """
    words = [(f, k) for k, line in enumerate(lines) for w in line if (f := fold_word(w))]
    loops = looping([fold_word(w) or "" for w in heard])
    kept = [(f, i) for i, w in enumerate(heard) if i not in loops and (f := fold_word(w))]
    line_at = {j: words[i][1] for i, j in affine_pairs([f for f, _ in words], [f for f, _ in kept], alike=alike)}
    out: list[tuple[int, str, int | None, int, int]] = []
    marks = [-1, *sorted(line_at), len(kept)]
    for a, b in zip(marks, marks[1:], strict=False):
        before, after = line_at.get(a), line_at.get(b)
        run = [kept[j][1] for j in range(a + 1, b)]
        if len(run) < least or (before is not None and after is not None and after <= before):
            continue
        place = len(lines) if after is None else after
        found, copies = [], {}
        for line, start, end in copies_in([heard[i] for i in run], lines, alike):
            if line is not None:
                copies[line] = copies.get(line, 0) + 1
                if copies[line] <= most_copies:
                    found.append((place, "repeat", line, run[start], run[end - 1]))
            elif end - start >= least and before is not None and after is not None:
                found.append((place, "heard", None, run[start], run[end - 1]))
        out += found or [(place, "review", None, run[0], run[-1])]
    return out


def propose_lines(lyrics: DataFrame, heard: DataFrame, keys: list[str], line: str, order: str, word: str) -> DataFrame:
    """(keys, before_line, kind, repeats, first, last) of missing_lines for each song: lyrics (keys, line, order, word), heard (keys, order, word)."""
    kinds = ", ".join(f"`{k}` {lyrics.schema[k].dataType.simpleString()}" for k in keys)
    names, alike = [*keys, "before_line", "kind", "repeats", "first", "last"], Alike()

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({n: [] for n in names})
        b = b.sort_values([order, word])
        of = [list(g.sort_values([order, word])[word]) for _, g in a.sort_values(line).groupby(line)]
        places = b[order].tolist()
        rows = [([*(a[k].iloc[0] for k in keys), at, kind, k, places[x], places[y]]) for at, kind, k, x, y in missing_lines(of, list(b[word]), alike)]
        return pd.DataFrame(rows, columns=names).astype({"repeats": "Int64"})

    sides = [df.select(*[F.col(c).alias(c) for c in columns]).groupBy(*keys) for df, columns in ((lyrics, [*keys, line, order, word]), (heard, [*keys, order, word]))]
    return sides[0].cogroup(sides[1]).applyInPandas(one, f"{kinds}, before_line long, kind string, repeats long, first long, last long")


def natural_length(word: str) -> float:
    return 0.1 + 0.06 * len(word)


def without_outliers(start: np.ndarray, end: np.ndarray, score: np.ndarray, words: list[str], most_gap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A line's word times with the words that lie more than `most_gap` from the largest cluster (of equal ones that of the better scores) put back beside it at their natural length, score 0. Untimed words are NaN and stay."""
    start, end, score = start.copy(), end.copy(), score.copy()
    timed = np.flatnonzero(~np.isnan(start))
    if len(timed) < 2:
        return start, end, score
    cluster = np.cumsum(np.append(False, start[timed[1:]] - end[timed[:-1]] > most_gap))
    best = max(range(cluster[-1] + 1), key=lambda c: ((cluster == c).sum(), score[timed[cluster == c]].mean()))
    kept = timed[cluster == best]
    length = np.array([natural_length(w) for w in words])
    before, after = timed[timed < kept[0]], timed[timed > kept[-1]]
    if len(before):
        at = start[kept[0]] - np.cumsum(length[before][::-1])[::-1]
        start[before], end[before], score[before] = at, at + length[before], 0.0
    if len(after):
        at = end[kept[-1]] + np.cumsum(length[after])
        start[after], end[after], score[after] = at - length[after], at, 0.0
    return start, end, score


def extended_ends(start: np.ndarray, end: np.ndarray, levels: np.ndarray, frame_s: float, *, drop_db: float, most_s: float, apart_s: float = 0.04, longest_s: float = 15.0) -> np.ndarray:
    """Ends of words moved on while the level stays within `drop_db` of the word's own mean, at most `most_s`, not closer than `apart_s` to the next word, never back."""
    out = end.copy()
    for i in range(len(start)):
        first = int(start[i] / frame_s)
        last = max(first + 1, int(end[i] / frame_s))
        own = levels[first:last].mean() if last <= len(levels) else -120.0
        limit = min(start[i + 1] - apart_s if i + 1 < len(start) else np.inf, start[i] + longest_s, end[i] + most_s)
        frame = int(end[i] / frame_s)
        quiet = np.flatnonzero(levels[frame:] <= own - drop_db)
        reach = min(frame + quiet[0] if len(quiet) else len(levels), max(frame, int((limit + 1e-9) / frame_s)))
        out[i] = max(end[i], min(limit, reach * frame_s))
    return out


def refine_times(df: DataFrame, keys: list[str], line: str, order: str, word: str, start: str, end: str, score: str, *, most_gap: float = 3.0, lead_s: float = 0.04) -> DataFrame:
    """(keys, line, order, start, end, score): words of each line placed back by without_outliers, starts `lead_s` earlier."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in [*keys, line, order])

    def one(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, of in group.sort_values([line, order, word]).groupby(line, sort=False):
            a, z, s = without_outliers(*(of[c].to_numpy(float) for c in (start, end, score)), list(of[word].fillna("")), most_gap)
            out.append(of[[*keys, line, order]].assign(start=np.maximum(0.0, a - lead_s), end=z, score=s))
        return pd.concat(out)

    return df.select(*keys, line, order, word, start, end, score).groupBy(*keys).applyInPandas(one, f"{kinds}, start double, end double, score double")


def latest_places(wanted: list[str], texts: list[str]) -> list[int] | None:
    """For each wanted text the last place of it before the next one's, from the end; None if one isn't there in that order."""
    out, limit = [], len(texts)
    for text in reversed(wanted):
        limit = next((i for i in range(limit - 1, -1, -1) if texts[i] == text), -1)
        if limit < 0:
            return None
        out.append(limit)
    return out[::-1]


def pieces_between(places: list[int], times: list[float], count: int, whole_s: float) -> list[tuple[int, int, float, float]]:
    """Lines cut at anchored ones into pieces with the stretch of sound of each: (from line, to line, from s, to s)."""
    cuts = [0, *places, count]
    at = [0.0, *times, whole_s]
    return [(a, b, s, e) for a, b, s, e in zip(cuts, cuts[1:], at, at[1:], strict=False) if b > a]
