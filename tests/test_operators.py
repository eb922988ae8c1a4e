"""Edge cases that the data don't show: nulls, ties, empty tables, one row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import scalars as S
from cadenza.functions.similarity import block_ratio, fuzzy_best, indel_ratio, normal_name, similar_words
from cadenza.kernels import align, signal
from cadenza.operators import aggregates as A
from cadenza.operators import joins as J
from cadenza.operators import windows as W
from cadenza.sources import songs, texts


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=lambda r: tuple((x is None, str(x)) for x in r))


def test_windows_on_nothing_and_nulls(spark):
    empty = spark.createDataFrame([], "k int, i int, v double")
    assert W.rolling_median(empty, ["k"], ["i"], "v", 2).count() == 0
    df = spark.createDataFrame([(1, 1, None), (1, 2, 4.0), (1, 3, 2.0), (None, 1, 7.0)], "k int, i int, v double")
    assert rows(W.rolling_median(df, ["k"], ["i"], "v", 5).select("k", "i", "median")) == [(1, 1, 3.0), (1, 2, 3.0), (1, 3, 3.0), (None, 1, 7.0)]
    assert rows(W.newest(df, ["k"], ["i"]).select("k", "v")) == [(1, 2.0), (None, 7.0)]


def test_clamp_is_the_loop(spark):
    given = [(1, 0, 4), (2, 2, 3), (3, 20, 1), (4, 3, 0), (5, 21, 2)]
    at, want = -(10**9), {}
    for i, start, length in given:
        at = max(start, at)
        want[i], at = at, at + length
    df = spark.createDataFrame([(7, *g) for g in given], "k int, i int, s int, n int")
    assert {r.i: r.clamped for r in W.monotone_clamp(df, ["k"], ["i"], "s", "n").collect()} == want


def test_mode_ties_go_to_the_first_seen(spark):
    df = spark.createDataFrame([(1, 3, "b"), (1, 1, "a"), (1, 2, "b"), (1, 4, "a"), (2, 1, None)], "k int, i int, v string")
    assert rows(A.most_frequent(df, ["k"], "v", ["i"])) == [(1, "a", 2)]


def test_theil_sen_finds_the_line(spark):
    points = [(1, float(x), 0.7 + 1.02 * x + (40 if x % 9 == 0 else 0)) for x in range(60)]
    (r,) = A.theil_sen(spark.createDataFrame([*points, (2, 1.0, 1.0)], "k int, x double, y double"), ["k"], "x", "y").collect()
    assert r.k == 1 and r.slope == pytest.approx(1.02, abs=1e-3) and r.intercept == pytest.approx(0.7, abs=0.1) and r.agree == pytest.approx(53 / 60)


def test_key_of_a_scale(spark):
    df = spark.createDataFrame([(1, 2 + s, 1) for s in S.MAJOR_STEPS] + [(1, 2, 5), (1, 9, 3)], "k int, p int, w int")
    assert rows(A.detect_key(df, ["k"], "p", F.col("w")).select("tonic", "minor")) == [(2, 0)]


def test_nearest_takes_the_later_of_a_tie(spark):
    left = spark.createDataFrame([(1, 5.0), (1, 0.0), (2, 1.0)], "k int, t double")
    right = spark.createDataFrame([(1, 4.0, 40), (1, 6.0, 60), (1, 6.0, 61)], "k int, t double, id int")
    assert rows(J.nearest(left, right, ["k"], "t", ["id"], unique="id").select("k", "t", "r_id")) == [(1, 0.0, 40), (1, 5.0, 61), (2, 1.0, None)]


def test_subtraction_keeps_measure(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 2.0, 3.0), (1, 2, 20.0, 21.0)], "k int, i int, s double, e double")
    holes = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.5, 4.0), (1, 9.0, 12.0), (1, 21.0, 30.0)], "k int, s double, e double")
    got = rows(J.subtract_intervals(df, holes, ["k"], "s", "e", row="i", least=0.1, width=3.0).select("i", "piece_start", "piece_end"))
    assert got == [(0, 0.0, 1.0), (0, 4.0, 9.0), (2, 20.0, 21.0)]


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_BYTES", 10)
    big = spark.range(1000)
    assert J.small(big) is big


def test_map_values_drops_and_keeps(spark):
    df = spark.createDataFrame([(1, ["Rock", "x", "ROCK", "zap"]), (2, ["x"])], "i int, v array<string>")
    mapping = spark.createDataFrame([("rock", ["Rock", "Roll"]), ("x", [])], "p string, b array<string>")
    assert rows(J.map_values(df, mapping, "i", F.col("v"), "p", "b")) == [(1, ["Rock", "Roll", "zap"]), (2, [])]


@pytest.mark.parametrize(("text", "seconds"), [("75", 75.0), ("1:05", 65.0), ("1:02:03.5", 3723.5), ("1:75", None), ("", None), ("x", None), ("1:5", None)])
def test_parse_clock(spark, text, seconds):
    assert spark.range(1).select(S.parse_clock(F.lit(text)).alias("s")).first().s == seconds


def test_bpm_and_rounding(spark):
    got = spark.createDataFrame([(100.0,), (399.0,), (400.0,), (401.0,), (133.0,)], "b double").select("b", S.bpm_multiplier(F.col("b")).alias("k"))
    assert {r.b: r.k for r in got.collect()} == {100.0: 3, 399.0: 1, 400.0: 0, 401.0: 0, 133.0: 3}
    assert spark.range(1).select(S.quarter_length(F.lit(0.625)).alias("q")).first().q == 0.5


def test_similarities_differ():
    assert indel_ratio("abcd", "abxd") == pytest.approx(6 / 8) and block_ratio("abcd", "abxd") == pytest.approx(6 / 8)
    assert indel_ratio("", "") == 1.0 and similar_words("a", "a") and not similar_words("night", "day")
    assert normal_name("Étude—No5!") == "etude no5" and normal_name(None) is None


def test_fuzzy_best(spark):
    a = spark.createDataFrame([(1, "Björn Lund", "Golden River"), (2, None, "x")], "i int, artist string, title string")
    b = spark.createDataFrame([(9, "Bjorn Lund", "Golden Rivr"), (8, "Bjorn Lund", "Silver")], "j int, artist string, title string")
    assert [(r.i, r.j, r.place) for r in fuzzy_best(a, b, "i", "j", ["artist", "title"]).collect()] == [(1, 9, 1)]


def test_alignment_is_monotone():
    a, b = "the river runs to the quiet sea".split(), "river ran to a the quiett sea again".split()
    for method in align.METHODS.values():
        pairs = method(a, b, similar_words)
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs})
    assert len(align.common_subsequence(a, b)) == 5
    assert align.affine_pairs([], b) == [] and align.matching_blocks(a, a) == [(i, i) for i in range(7)]


def test_segments_lag_clusters_and_paths():
    x = np.array([3.0] * 20 + [9.0] * 20)
    assert signal.best_segments(x, 5.0, 4, 6) == [0, 20]
    rng = np.random.default_rng(1)
    a = rng.normal(size=300)
    lag, r = signal.lag_of(a, np.concatenate([np.zeros(7), a[:-7]]), 20)
    assert round(lag) == 7 and r > 0.95
    v = np.array([[1, 0.1], [0.1, 1], [1, 0], [0, 0], [0, 1]], float)
    labels, apart = signal.two_voices(v, np.array([-1, -1, -1, -1, -1]))
    assert labels[0] == labels[2] != labels[1] == labels[4] and labels[3] == -1 and apart > 5
    logp = np.full((8, 3), -5.0)
    logp[:, 0] = -1.0
    logp[2, 1] = logp[3, 1] = logp[6, 2] = 0.0
    assert [x[:2] for x in signal.align_sung(logp, [[[1], [2]]])[0]] == [(2, 3), (6, 6)]
    assert signal.align_sung(logp[:1], [[[1, 2, 1]]]) is None and signal.align_sung(logp, []) == ([], [])


def test_song_files(spark, tmp_path):
    text = "﻿#TITLE:Río\r\n#ARTIST:A\r\n#title:Other\r\n#BPM:300,5\r\n#GAP:\r\nP1\r\n: 0 4 2 la \r\n: 4,5 2 -3 ~\r\n- 8\r\nP2\r\n* 8 4 5  lu\r\nE\r\n"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.txt").write_bytes(text.encode())
    (tmp_path / "two.txt").write_bytes("#TITLE:Größe\n#ARTIST:B\n: 0 1 1 x\nE\n".encode("cp1252"))
    (tmp_path / "none.txt").write_text("#TITLE:\n#ARTIST:C\n")
    library = songs.read_library(spark, str(tmp_path))
    assert library.count() == 2
    tags = {(r.path[-7:], r.tag): r.value for r in songs.tags(library, "path", "text").collect()}
    assert tags["one.txt", "TITLE"] == "Río" and tags["two.txt", "TITLE"] == "Größe"
    notes = [(r.part, r.lyric_line, r.type, r.beat, r.word) for r in songs.read_notes(library.where("path like '%one.txt'"), "path", "text").orderBy("line_no").collect()]
    assert notes == [("P1", 0, ":", 0.0, "la "), ("P1", 0, ":", 4.5, "~"), ("P2", 1, "*", 8.0, " lu")]
    one = spark.createDataFrame([("#A:1\n#GENRE:x\n#genre:y\n: 0 1 1 z\n",), ("#A:1\n: 0 1 1 z\n",)], "t string")
    assert [r.t for r in one.select(songs.set_tag(F.col("t"), "GENRE", "Pop").alias("t")).collect()] == ["#A:1\n#GENRE:Pop\n: 0 1 1 z\n", "#A:1\n#GENRE:Pop\n: 0 1 1 z\n"]
    assert one.select(songs.set_tag(F.col("t"), "GENRE", None).alias("t")).first().t == "#A:1\n: 0 1 1 z\n"


def test_other_texts(spark, tmp_path):
    lists = spark.createDataFrame([("f", '# note\n\nBand Name;Song Name;Link\nA;B;https://x\nBand Name;Song Name;Link\n# c\nC;"D;E\nF #";;extra\n'), ("g", "# only\n"), ("h", None)], "f string, t string")
    got = texts.read_delimited(lists, "f", "t", {"band": ["band name"], "title": ["song name"], "url": ["youtube link", "link"]})
    assert rows(got) == [("f", 1, "A", "B", "https://x"), ("f", 2, "Band Name", "Song Name", "Link"), ("f", 3, "C", "D;E\nF #", None)]
    anchors = spark.createDataFrame([(1, "# c\n0:10 | one\n0:05 | two\nend 1:00\nx | y")], "k int, t string")
    assert [(r.kind, r.at_s, r.problem) for r in texts.read_anchors(anchors, "k", "t").orderBy("line_no").collect()] == [("anchor", 10.0, None), ("anchor", 5.0, "order"), ("end", 60.0, None), ("anchor", None, "time")]
    log = spark.createDataFrame([(1, 1, "DONE a=1 b=x"), (1, 2, "an Error here"), (1, 3, "DONE a=2 a=3")], "k int, n int, l string")
    assert rows(texts.read_log(log, "k", "n", "l", "DONE")) == [(1, {"a": "3"}, "an Error here")]
    mounts = spark.createDataFrame([("//h/s /mnt/a\\040b cifs rw 0 0",)], "l string")
    assert rows(texts.read_mounts(mounts, "l")) == [("//h/s", "/mnt/a b", "cifs")]
    logs = spark.createDataFrame([("2", '{"name":"a","v":3}\nbroken {\n'), ("1", '{"name":"a","v":1}\n{"name":"b","v":2}\n{"name":"a","v":5}\n{"v":1}'), ("0", None)], "f string, t string")
    assert rows(texts.read_results(logs, "f", "t", "name string, v int", "name")) == [("a", 3), ("b", 2)]
    again = logs.where("f = '2'").select(texts.append_result(F.col("t"), F.struct(F.lit("b").alias("name"), F.lit(9).alias("v"))).alias("t")).first().t
    assert again.endswith('broken {\n{"name":"b","v":9}\n')


def test_written_songs_read_back(spark):
    song = "#TITLE:T\n#BPM:100\nP1\n: 0 2 5  So\n: 2 2 5 ng\n- 9\n* 10 4 7 on\nP2\n: 0 2 3 la\n- 5\nF 8 2 1 \nE\n"
    df = spark.createDataFrame([(1, song), (2, "#TITLE:U\n: 3 1 0 x\n- 8\n: 9 1 0 y"), (3, "#TITLE:none")], "k int, t string")
    what = ["k", "part", "type", "beat", "length", "pitch", "word"]
    notes = songs.read_notes(df, "k", "t")
    written = songs.write_text(songs.tags(df, "k", "t"), notes, "k", ["TITLE"])
    again = songs.read_notes(written, "k", "text")
    assert rows(notes.select(*what)) == rows(again.select(*what)) and notes.select("k", "part", "lyric_line").distinct().count() == again.select("k", "part", "lyric_line").distinct().count()
    text = {r.k: r.text for r in written.collect()}
    assert "P1\n: 0 2 5  So\n: 2 2 5 ng\n- 4\n* 10" in text[1] and "- 2\nF 8" in text[1] and text[3] == "#TITLE:none\nE\n"


def test_sections_and_credits(spark):
    song = "Intro line\n[Chorus x2]\nHey (oh)\n(ooh)\nComposer: X\n[Verse 1]\nOne\n[Chorus]\n\n[Bridge]\n[chorus] (2x)\nProducer of my dreams\n[0:12.5] [0:13] Stamped\n"
    got = texts.read_plain_lyrics(spark.createDataFrame([(1, song), (2, None), (3, "")], "k int, t string"), "k", "t").orderBy("section_no", "line_no")
    assert [(r.mark, r.line) for r in got.collect()] == [(None, "Intro line"), ("chorus", "Hey (oh)"), ("verse 1", "One"), ("chorus", "Hey (oh)"), ("chorus", "Producer of my dreams"), ("chorus", "Stamped")]


def test_levels_in_db(spark):
    df = spark.createDataFrame([(1, i, 0.5) for i in range(7)], "k int, i int, v double")
    (r,) = A.frame_levels(df, ["k"], "i", "v", 4).collect()
    assert r.frame == 0 and r.db == pytest.approx(10 * math.log10(0.25))
