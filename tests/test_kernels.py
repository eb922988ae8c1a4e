"""Kernels against brute force and known cases."""

import itertools
import random
from functools import lru_cache

import numpy as np
import pytest

from cadenza.functions import wording
from cadenza.functions.similarity import indel_ratio, osa, similar_words
from cadenza.kernels import lyrics, signal
from cadenza.kernels.align import affine_pairs, align, common_subsequence
from cadenza.operators import genres as G
from cadenza.operators import joins as J
from cadenza.operators import music as M
from cadenza.sources import duets as D


def pairs_score(pairs, n, m, gap):
    marks = [(-1, -1), *pairs, (n, m)]
    return len(pairs) - sum(gap * ((c - a > 1) + (d - b > 1)) for (a, b), (c, d) in itertools.pairwise(marks))


def test_pairings_are_the_best():
    rng = random.Random(1)
    for _ in range(600):
        words = ["sun", "sunn", "moon", "rise", "ride", "x", "sea"][: rng.randint(1, 7)]
        a, b = ([rng.choice(words) for _ in range(rng.randint(0, 8))] for _ in range(2))
        gap = rng.choice([0.5, 1.0, 2.0])

        @lru_cache(None)
        def best(i, j, state, a=tuple(a), b=tuple(b), gap=gap):
            if i == len(a) and j == len(b):
                return 0.0
            ways = [1 + best(i + 1, j + 1, 0)] if i < len(a) and j < len(b) and similar_words(a[i], b[j]) else []
            ways += [best(i + 1, j, 1) - gap * (state != 1)] if i < len(a) else []
            ways += [best(i, j + 1, 2) - gap * (state != 2)] if j < len(b) else []
            return max(ways)

        @lru_cache(None)
        def longest(i, j, a=tuple(a), b=tuple(b)):
            if i == len(a) or j == len(b):
                return 0
            return max(longest(i + 1, j), longest(i, j + 1), 1 + longest(i + 1, j + 1) if similar_words(a[i], b[j]) else 0)

        for pairs in (common_subsequence(a, b), affine_pairs(a, b, gap)):
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(pairs)) and all(similar_words(a[i], b[j]) for i, j in pairs)
        assert len(common_subsequence(a, b)) == longest(0, 0)
        if a and b:
            assert pairs_score(affine_pairs(a, b, gap), len(a), len(b), gap) == pytest.approx(best(0, 0, 0))
    assert common_subsequence([], ["a"]) == [] and affine_pairs(["a"], []) == []


def test_affine_pairing_charges_the_ends(spark):
    assert affine_pairs(["a"] + ["x"] * 3, ["a"], 2.0) == [(0, 0)] and affine_pairs(list("pqrs"), list("tuvw"), 2.0) == []
    nothing = spark.createDataFrame([], "k int, n int, w string")
    some = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (None, 1, "b")], "k int, n int, w string")
    assert align(nothing, some, "k", "n", "w").count() == 0 and align(some, some, "k", "n", "w").count() == 2


def test_best_path_is_that_of_brute_force():
    rng = np.random.RandomState(0)
    for turn in range(40):
        lines = [[[1]], [[2]]] if turn % 2 else [[[1], [1]]]
        graph, _, _ = signal.sung_graph(lines, 0, 3 if turn % 5 == 0 else None, filler_enter=1.0, end_penalty=0.7 if turn % 3 else None, line_skip=[0.5] * len(lines) if turn % 4 == 0 else None, skip_most=4)
        emissions = rng.randn(5, 4)

        def score(path, graph=graph, emissions=emissions):
            if path[0] not in graph.begin or path[-1] not in graph.end or any(m not in graph.moves for m in itertools.pairwise(path)):
                return -np.inf
            return sum(emissions[t, graph.column[s]] for t, s in enumerate(path)) - graph.begin[path[0]] - graph.end[path[-1]] - sum(graph.moves[m] for m in itertools.pairwise(path))

        want = max(score(p) for p in itertools.product(range(len(graph.column)), repeat=5))
        assert score(graph.best_path(emissions)) == pytest.approx(want)


def test_fillers_and_left_out_words():
    shown = lambda *classes: np.log(np.eye(5)[list(classes)] * 0.9 + 0.02)
    spans, fillers = signal.align_sung(shown(0, 1, 1, 0, 4, 4, 4, 0, 2, 0), [[[1]], [[2]]], filler_beta=0.1, filler_enter=0.5)
    assert [s[:2] for s in spans] == [(1, 2), (8, 8)] and fillers == [(4, 6, 1)]
    spans, _ = signal.align_sung(shown(1, 0, 2, 0), [[[1], [2], [3]]], end_penalty=0.5)
    assert [s and s[:2] for s in spans] == [(0, 0), (2, 2), None]
    spans, _ = signal.align_sung(shown(1, 0, 3, 0), [[[1]], [[2]], [[3]]], line_skip=[None, 0.1, None])
    assert [s and s[:2] for s in spans] == [(0, 0), None, (2, 2)]
    assert signal.align_sung(shown(1), [[[1], [1]]]) is None and signal.align_sung(shown(1), []) == ([], [])


def test_lag_by_onsets():
    rng = np.random.RandomState(3)
    a = rng.standard_normal(4000) * np.repeat(rng.choice([0.1, 3.0], 400), 10)
    lag, r = signal.lag_of(signal.onsets(a, 10), signal.onsets(np.concatenate([rng.standard_normal(70) * 0.1, a])[:4000], 10), 30)
    assert lag == pytest.approx(7, abs=0.2) and r > 0.8


def test_missing_lines():
    lines = [["sun", "is", "up"], ["moon", "goes", "down"]]
    heard = "sun is up sun is up stars fall on me moon goes down la la la la la la".split()
    assert lyrics.missing_lines(lines, heard) == [(1, "repeat", 0, 3, 5), (1, "heard", None, 6, 9)]
    assert lyrics.missing_lines(lines, "good evening every one sun is up moon goes down".split()) == [(0, "review", None, 0, 3)]
    assert lyrics.missing_lines([], []) == [] and lyrics.missing_lines(lines, []) == []


def test_times_put_right():
    nan = float("nan")
    start, end, score = lyrics.without_outliers(np.array([1.0, 1.5, 20.0, nan]), np.array([1.2, 1.9, 20.5, nan]), np.array([0.9, 0.8, 0.1, 0.0]), ["a", "bb", "ccc", "d"], 3.0)
    assert start[2] == pytest.approx(1.9) and end[2] == pytest.approx(2.18) and score[2] == 0 and np.isnan(start[3])
    levels = np.array([0.0] * 50 + [-40.0] * 50)
    assert lyrics.extended_ends(np.array([0.2]), np.array([0.4]), levels, 0.02, drop_db=9, most_s=2.0)[0] == pytest.approx(1.0)
    assert lyrics.extended_ends(np.array([0.2, 0.6]), np.array([0.4, 0.7]), levels, 0.02, drop_db=9, most_s=0.1) == pytest.approx([0.5, 0.8])
    assert lyrics.latest_places(["a", "b"], ["a", "b", "a", "b"]) == [2, 3] and lyrics.latest_places(["b", "a"], ["a", "b"]) is None
    assert lyrics.pieces_between([2, 5], [10.0, 20.0], 8, 30.0) == [(0, 2, 0.0, 10.0), (2, 5, 10.0, 20.0), (5, 8, 20.0, 30.0)]


def test_distances_and_wordings():
    assert (osa("abcd", "acbd"), osa("ca", "abc"), osa("", "abc")) == (1, 3, 3)
    assert indel_ratio("abc", "axc") == pytest.approx(4 / 6) and indel_ratio("", "") == 1 and indel_ratio("", "a") == 0
    assert wording.numbers_in_words("21 and 1001, not 3.5 or x7", "en") == "twenty-one and one thousand and one, not 3.5 or x7"
    assert wording.numbers_in_words("121 Lieder, 1000000", "de") == "einhunderteinundzwanzig Lieder, eine Million" and wording.numbers_in_words("5", "xx") == "5"
    hyphens = wording.Hyphens(["a1b", "1ca", "2b3c"])
    assert hyphens("ab-aca'x") == ["ab-a", "ca'x"] and hyphens("") == [""] and hyphens(None) is None and hyphens("!?") == ["!?"]


def test_genre_bases():
    known = G.Known({"rock", "pop", "folk", "metal", "power"}, {"rock", "pop", "folkmetal", "powermetal"}, {"rock", "pop", "metal"}, {"rock", "pop", "folk", "metal", "power"})
    s = G.Splitter(G.Rules(whole={"hiphop": "Hip-Hop"}, dropped={"easylistening"}, phrases={"gamemusic": ["soundtrack"]}, merged={"pop": ["popular"]}), known)
    cases = {"Folk Metal": ["folk", "metal"], "folkmetal": ["folk", "metal"], "Hip Hop": ["hip-hop"], "Easy Listening": [], "game music": ["soundtrack"], "Pop": ["popular"], "metla": ["metal"], "the Music of Rock": ["rock"], "": [], "xyzzy": ["xyzzy"]}
    assert {name: s.bases(name) for name in cases} == cases


def test_duets(spark):
    song = "#TITLE:T\n#P1:A\nP1\n: 0 4 1 Hel\n: 4 4 1 lo \n- 9\n: 20 30 1 long \nP2\n: 0 4 1 Hel\n: 4 4 1 lo\n- 9\n: 30 10 1 short\nE\n: 99 1 1 after"
    df = spark.createDataFrame([(1, song), (2, "#TITLE:U\n: 5 1 1 a\n: 3 1 1 b"), (3, None)], "k int, t string")
    of = D.part_lines(df, "k", "t")
    assert [(r.k, r.part, r.lyric_line, r.text, r.back_in_time) for r in of.orderBy("k", "part", "lyric_line").collect()] == [(1, "P1", 1, "Hello", 0), (1, "P1", 2, "long", 0), (1, "P2", 1, "Hello", 0), (1, "P2", 2, "short", 0), (2, "P1", 1, "ab", 1)]
    lines = D.timeline(of, "k")
    assert sorted((r.text, r.singers) for r in lines.where("k = 1").collect()) == [("Hello", "P1P2"), ("long", "P1"), ("short", "P2")]
    assert [(r.start, r.partner_start) for r in D.overlapping(lines, "k").collect()] == [(30.0, 20.0)]
    assert {r.k: r.error for r in D.duets(df, "k", "t").collect()} == {1: None, 2: "P2"}


def test_numbering_and_picks(spark):
    df = spark.createDataFrame([(x,) for x in [5, 3, 9, 1, 7]], "x int")
    assert [(r.x, r.place) for r in J.numbered(df, [df.x.asc()], "place").orderBy("place").collect()] == [(1, 1), (3, 2), (5, 3), (7, 4), (9, 5)]
    assert J.numbered(df.where("x > 99"), [df.x.asc()], "place").count() == 0


def test_syllables_in_sixteenths(spark):
    df = spark.createDataFrame([(1, 0.0, 0.1, "a "), (2, 0.0, 0.43, "bo "), (3, 0.0, 0.30, "c")], "k int, s double, e double, w string")
    got = [(r.k, r.piece, round(r.piece_start, 3), round(r.piece_end, 3), r.word) for r in M.sixteenths(df, ["k"], "s", "e", "w", 0.125).orderBy("k", "piece").collect()]
    assert got == [(1, 0, 0.0, 0.1, "a "), (2, 0, 0.0, 0.125, "bo"), (2, 1, 0.125, 0.25, "~"), (2, 2, 0.25, 0.43, "~ "), (3, 0, 0.0, 0.125, "c"), (3, 1, 0.125, 0.3, "~")]
