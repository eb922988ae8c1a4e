"""Signals and sequences: segmentation, lag, clusters, forced alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_segments(values: np.ndarray, penalty: float, least: int, most: int) -> list[int]:
    """Where the best piecewise constant fit begins new parts: squares plus `penalty` a part, parts of `least` values at least, `most` parts at most."""
    n = len(values)
    sums, squares = (np.concatenate([[0.0], np.cumsum(x)]) for x in (values, values**2))
    size = np.arange(n + 1)[None, :] - np.arange(n + 1)[:, None]
    fit = np.where(size >= least, squares[None, :] - squares[:, None] - (sums[None, :] - sums[:, None]) ** 2 / np.maximum(size, 1), np.inf)  # of values i to j as one part
    best, came = [np.where(np.arange(n + 1) == 0, 0.0, np.inf)], []
    for _ in range(min(most, n // max(1, least))):
        total = best[-1][:, None] + fit + penalty
        came.append(total.argmin(0))
        best.append(total.min(0))
    k = int(np.argmin([b[n] for b in best]))
    cuts, j = [], n
    for of in reversed(came[:k]):
        j = int(of[j])
        cuts.append(j)
    return cuts[::-1]


def held_pitches(df: DataFrame, keys: list[str], at: str, hz: str, confidence: str, *, sure: float = 0.2, penalty: float = 40.0, part_s: float = 0.12, hop_s: float = 0.016, most: int = 6) -> DataFrame:
    """(keys, part, first_s, last_s, level): a pitch track in parts of about one level, in semitones.

    Frames of too little confidence have no say. Octaves are folded toward the
    median first; parts last `part_s` at least.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    least = max(1, int(np.ceil(part_s / hop_s - 1e-6)))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group[(group[confidence] > sure) & (group[hz] > 0)].sort_values(at)
        midi = 12 * np.log2(group[hz].to_numpy(float) / 440.0) + 69
        if len(midi):
            midi = midi - 12 * np.round((midi - np.median(midi)) / 12)
        cuts = best_segments(midi, penalty, least, most) if len(midi) >= least else [0] * bool(len(midi))
        ends = [*cuts[1:], len(midi)]
        times = group[at].to_numpy(float)
        return pd.DataFrame([[*(group[k].iloc[0] for k in keys), p, times[a], times[b - 1], float(np.median(midi[a:b]))] for p, (a, b) in enumerate(zip(cuts, ends, strict=False))], columns=[*keys, "part", "first_s", "last_s", "level"])

    return df.select(*keys, at, hz, confidence).groupBy(*keys).applyInPandas(one, f"{kinds}, part int, first_s double, last_s double, level double")


def quiet_stretches(df: DataFrame, keys: list[str], frame: str, db: str, below: float, least: int) -> DataFrame:
    """(keys, first, last): runs of at least `least` neighbouring frames under a level."""
    quiet = df.where(F.col(db) < below)
    run = F.col(frame) - F.row_number().over(Window.partitionBy(*keys).orderBy(frame))
    return quiet.withColumn("__run", run).groupBy(*keys, "__run").agg(F.min(frame).alias("first"), F.max(frame).alias("last")).where(F.col("last") - F.col("first") + 1 >= least).drop("__run")


def outro_cut(levels: DataFrame, keys: list[str], frame: str, db: str, expected_s: float, *, frame_s: float = 0.25, below: float = 30.0, before_s: float = 10.0, after_s: float = 15.0, pause_s: float = 1.0, into_s: float = 0.5, extra_s: float = 8.0) -> DataFrame:
    """(keys, cut_s): where a song ends inside a longer recording, null where nothing shows it.

    Loud frames are at most `below` under the ninetieth percentile. The end is
    expected `expected_s` after the first loud frame; the pause of `pause_s` or
    more that begins nearest to it, from `before_s` before to `after_s` after,
    is cut `into_s` after its start (of two as near the earlier). Recordings
    that aren't `extra_s` longer than expected are left whole.
    """
    loudness = levels.groupBy(*keys).agg((F.percentile(db, 0.9) - below).alias("loud"), (F.count(F.lit(1)) * frame_s).alias("whole_s"))
    marked = levels.join(loudness, keys)
    begin = marked.where(F.col(db) > F.col("loud")).groupBy(*keys).agg((F.min(frame) * frame_s + expected_s).alias("end"), F.first("whole_s").alias("whole_s"))
    quiet = marked.where(F.col(db) <= F.col("loud"))
    run = F.col(frame) - F.row_number().over(Window.partitionBy(*keys).orderBy(frame))
    pauses = quiet.withColumn("__run", run).groupBy(*keys, "__run").agg((F.min(frame) * frame_s).alias("first"), (F.count(F.lit(1)) * frame_s).alias("n")).where(F.col("n") >= pause_s)
    near = pauses.join(begin, keys).where(F.col("first").between(F.col("end") - before_s, F.col("end") + after_s) & (F.col("whole_s") - expected_s >= extra_s))
    cut = near.groupBy(*keys).agg((F.min_by("first", F.struct(F.abs(F.col("first") - F.col("end")), "first")) + into_s).alias("cut_s"))
    return begin.join(cut, keys, "left").select(*keys, "cut_s")


def lag_of(a: np.ndarray, b: np.ndarray, most: int) -> tuple[float, float]:
    """By how much b comes after a: the peak of the cross-correlation, refined by a parabola, and the correlation there."""
    x, y = a - a.mean(), b - b.mean()
    size = 1 << (len(x) + len(y)).bit_length()
    full = np.fft.irfft(np.conj(np.fft.rfft(x, size)) * np.fft.rfft(y, size), size)
    lags = np.concatenate([np.arange(-most, 0), np.arange(0, most + 1)])
    r = full[lags % size]
    k = int(r.argmax())
    shift = 0.0
    if 0 < k < len(r) - 1 and (bend := r[k - 1] - 2 * r[k] + r[k + 1]) < 0:
        shift = 0.5 * (r[k - 1] - r[k + 1]) / bend
    lag = int(lags[k])
    u, v = (x[: len(x) - lag], y[lag:]) if lag >= 0 else (x[-lag:], y[: len(y) + lag])
    n = min(len(u), len(v))
    scale = np.sqrt((u[:n] ** 2).sum() * (v[:n] ** 2).sum()) if n else 0.0
    return lag + shift, float((u[:n] * v[:n]).sum() / scale) if scale > 0 else 0.0


def find_lag(df: DataFrame, keys: list[str], order: str, a: str, b: str, most: int, *, frame: int | None = None) -> DataFrame:
    """(keys, lag, correlation) of two signals by key, or of their onsets by frames of `frame` values; nulls where one of them doesn't change."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order).fillna({a: 0.0, b: 0.0})
        x, y = (group[c].to_numpy(float) if frame is None else onsets(group[c].to_numpy(float), frame) for c in (a, b))
        if min(len(x), len(y)) < 2 or x.std() == 0 or y.std() == 0:
            return pd.DataFrame([[*(group[k].iloc[0] for k in keys), None, None]], columns=[*keys, "lag", "correlation"])
        lag, r = lag_of(x, y, most)
        return pd.DataFrame([[*(group[k].iloc[0] for k in keys), lag, r]], columns=[*keys, "lag", "correlation"])

    return df.select(*keys, order, a, b).groupBy(*keys).applyInPandas(one, f"{kinds}, lag double, correlation double")


def two_voices(vectors: np.ndarray, fixed: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Spherical 2-means: labels 0 and 1 (-1 for a zero vector), fixed ones kept, and how far apart the groups are.

    It starts from the fixed vectors, or the first and the one least like it.
    """
    size = np.linalg.norm(vectors, axis=1)
    good = size > 0
    if good.sum() < 2:
        return np.where(good, 0, -1), 0.0
    x = np.where(good[:, None], vectors / np.maximum(size, 1e-12)[:, None], 0.0)
    first = int(np.flatnonzero(good)[0])
    other = int(np.flatnonzero(good)[(x[good] @ x[first]).argmin()])
    centres = np.stack([x[fixed == k].sum(0) if (good & (fixed == k)).any() else x[(first, other)[k]] for k in (0, 1)])
    labels = np.full(len(x), -1)
    for _ in range(rounds):
        new = np.where(good, (x @ centres.T).argmax(1), -1)
        new = np.where(good & (fixed >= 0), fixed, new)
        if (new == labels).all():
            break
        labels = new
        for k in (0, 1):
            if (labels == k).any():
                centres[k] = x[labels == k].sum(0)
                centres[k] /= np.linalg.norm(centres[k]) + 1e-12
    own = np.array([x[i] @ centres[labels[i]] for i in np.flatnonzero(good)])
    away = np.array([x[i] @ centres[1 - labels[i]] for i in np.flatnonzero(good)])
    return labels, float((1 - away.mean()) / max(1e-9, 1 - own.mean()))


def assign_voices(df: DataFrame, keys: list[str], order: str, vector: str, fixed: str) -> DataFrame:
    """(keys, order, voice, separation): lines of a song in two voices; voice null without a vector."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        width = max((len(v) for v in group[vector] if v is not None), default=1)
        x = np.array([np.zeros(width) if v is None else np.asarray(v, float) for v in group[vector]])
        labels, apart = two_voices(x, group[fixed].fillna(-1).to_numpy(int))
        return pd.DataFrame({**{k: group[k] for k in keys}, order: group[order], "voice": pd.array([None if v < 0 else int(v) for v in labels], "Int32"), "separation": apart})

    return df.select(*keys, order, vector, fixed).groupBy(*keys).applyInPandas(one, f"{kinds}, `{order}` {df.schema[order].dataType.simpleString()}, voice int, separation double")


class Graph:
    """States with the emission column of each, weighed moves between them, and what beginning and ending in each costs."""

    def __init__(self) -> None:
        self.column: list[int] = []
        self.moves: dict[tuple[int, int], float] = {}
        self.begin: dict[int, float] = {}
        self.end: dict[int, float] = {}

    def state(self, column: int) -> int:
        self.column.append(column)
        self.move(len(self.column) - 1, len(self.column) - 1)
        return len(self.column) - 1

    def move(self, a: int, b: int, cost: float = 0.0) -> None:
        self.moves[a, b] = min(cost, self.moves.get((a, b), np.inf))

    def best_path(self, emissions: np.ndarray) -> list[int] | None:
        """The state of each row on the best path, None if there is none. Of equally good moves the one from the lowest state counts."""
        pairs = sorted(self.moves, key=lambda m: (m[1], m[0]))
        source, target = np.array(pairs).T
        cost = np.array([self.moves[p] for p in pairs])
        first = np.flatnonzero(np.append(True, target[1:] != target[:-1]))  # every state can stay, so each has a move into it
        score = np.full(len(self.column), -np.inf)
        for s, c in self.begin.items():
            score[s] = -c
        score += emissions[0, self.column]
        back = np.zeros((len(emissions), len(score)), np.int32)
        place = np.arange(len(source))
        for t in range(1, len(emissions)):
            value = score[source] - cost
            top = np.maximum.reduceat(value, first)
            back[t] = source[np.minimum.reduceat(np.where(value == np.repeat(top, np.diff(np.append(first, len(value)))), place, len(value) - 1), first)]
            score = top + emissions[t, self.column]
        final = max(self.end, key=lambda s: (score[s] - self.end[s], -s), default=None)
        if final is None or score[final] == -np.inf:
            return None
        path = [final]
        for t in range(len(emissions) - 1, 0, -1):
            path.append(int(back[t, path[-1]]))
        return path[::-1]


def sung_graph(lines: list[list[list[int]]], blank: int, filler: int | None, *, filler_enter: float, end_penalty: float | None, line_skip: list[float | None] | None, skip_most: int) -> tuple[Graph, list[int], dict[int, int]]:
    """The graph of lines of words of tokens, the state of each token, and which line each filler state stands before.

    Between neighbouring tokens a blank may sit, and must between equal ones.
    A filler before each line and after the last takes singing that the lyrics
    don't have. With `end_penalty` the path may end after any word at that
    cost for each token left out; a line with a cost in `line_skip` may be
    passed over at that cost for each of its tokens, up to `skip_most` lines
    at once.
    """
    graph, token_state, token_of = Graph(), [], []
    gap = graph.state(blank)
    graph.begin[gap] = 0.0
    line_start, line_gap, fillers = [], [gap], {}
    total = sum(len(w) for line in lines for w in line)
    for line in lines:
        line_start.append(len(token_state))
        for word in line:
            for token in word:
                here = graph.state(token)
                graph.move(gap, here)
                if not token_state:
                    graph.begin[here] = 0.0
                elif token_of[-1] != token:
                    graph.move(token_state[-1], here)
                token_state.append(here)
                token_of.append(token)
                after = graph.state(blank)
                graph.move(here, after)
                gap = after
            left = total - len(token_state)
            if left == 0 or end_penalty is not None:
                for s in (token_state[-1], gap):
                    graph.end[s] = (end_penalty or 0.0) * left
        line_gap.append(gap)
    starts = [token_state[i] for i in line_start]
    if filler is not None:
        for k in range(len(lines) + 1):
            s = graph.state(filler)
            fillers[s] = k
            if k == 0:
                graph.begin[s] = filler_enter
            else:
                graph.move(line_gap[k], s, filler_enter)
                graph.move(token_state[(line_start[k] if k < len(lines) else total) - 1], s, filler_enter)
            if k < len(lines):
                graph.move(s, line_gap[k])
            else:
                graph.end[s] = 0.0
    if line_skip is not None:
        cost = [np.inf if c is None else c * sum(map(len, line)) for c, line in zip(line_skip, lines, strict=True)]
        for j in range(len(lines)):
            for i in range(max(0, j - skip_most), j):
                if np.isfinite(skipped := float(sum(cost[i:j]))):
                    graph.move(line_gap[i], line_gap[j], skipped)
                    graph.move(line_gap[i], starts[j], skipped)
                    if i == 0:
                        graph.begin[line_gap[j]] = min(skipped, graph.begin.get(line_gap[j], np.inf))
    return graph, token_state, fillers


def align_sung(logp: np.ndarray, lines: list[list[list[int]]], *, blank: int = 0, filler_beta: float | None = None, filler_enter: float = 0.0, end_penalty: float | None = None, line_skip: list[float | None] | None = None, skip_most: int = 4) -> tuple[list[tuple[int, int, float] | None], list[tuple[int, int, int]]] | None:
    """For each token its first and last frame and mean probability (None if it is left out), and the fillers used as (first frame, last frame, line that it stands before); None if the tokens don't fit."""
    tokens = [t for line in lines for w in line for t in w]
    if not tokens:
        return [], []
    filler, emissions = None, logp
    if filler_beta is not None:
        others = np.delete(logp, blank, axis=1)
        emissions = np.column_stack([logp, np.maximum(logp[:, blank], others.max(1) - filler_beta)])
        filler = logp.shape[1]
    graph, token_state, fillers = sung_graph(lines, blank, filler, filler_enter=filler_enter, end_penalty=end_penalty, line_skip=line_skip, skip_most=skip_most)
    path = graph.best_path(emissions) if len(logp) else None
    if path is None:
        return None
    at: dict[int, list[int]] = {}
    for t, s in enumerate(path):
        at.setdefault(s, []).append(t)
    spans = [(f[0], f[-1], float(np.exp(logp[f, token]).mean())) if (f := at.get(s)) else None for s, token in zip(token_state, tokens, strict=True)]
    return spans, sorted((at[s][0], at[s][-1], k) for s, k in fillers.items() if s in at)


def align_tokens(emissions: DataFrame, targets: DataFrame, key: str, **options: float) -> DataFrame:
    """(key, token_no, first, last, probability): emissions (key, frame, logp array) aligned with targets (key, line, word, token_no, token); tokens left out have nulls. Songs that can't fit give no rows."""
    kind = emissions.schema[key].dataType.simpleString()

    def one(e: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        names = [key, "token_no", "first", "last", "probability"]
        if not len(e) or not len(t):
            return pd.DataFrame({n: [] for n in names})
        e, t = e.sort_values("frame"), t.sort_values("token_no")
        lines = [[list(w["token"].astype(int)) for _, w in of.groupby("word", sort=False)] for _, of in t.groupby("line", sort=False)]
        found = align_sung(np.stack([np.asarray(x, float) for x in e["logp"]]), lines, **options)
        spans = found[0] if found else []
        return pd.DataFrame([(e[key].iloc[0], int(n), *(s or (None, None, None))) for n, s in zip(t["token_no"], spans, strict=False)], columns=names).astype({"first": "Int64", "last": "Int64", "probability": "Float64"})

    return emissions.groupBy(key).cogroup(targets.groupBy(key)).applyInPandas(one, f"`{key}` {kind}, token_no long, first long, last long, probability double")


def onsets(samples: np.ndarray, frame: int) -> np.ndarray:
    """How much the log energy rises from frame to frame, never below 0."""
    whole = len(samples) // frame
    if whole < 2:
        return np.zeros(0)
    energy = np.square(samples[: whole * frame].reshape(whole, frame)).mean(1)
    return np.maximum(np.diff(np.log(energy + 1e-10)), 0.0)
