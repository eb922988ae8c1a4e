"""Queries on small tables of their own: the whole job, not a part of it."""

import random

from cadenza.functions import similarity
from cadenza.plans import kernels, lyrics, relations


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_every_take_is_aligned_with_every_voice(spark, tmp_path):
    notes = [(7, "P1", 1, 1, "sun"), (7, "P1", 1, 2, "rise"), (7, "P2", 1, 3, "moon"), (8, None, 1, 1, "tide"), (9, None, 1, 1, "untaken")]
    words = [(7, 70, 0, "sun"), (7, 70, 1, "rise"), (7, 71, 0, "rise"), (7, 71, 1, "moon"), (8, 80, 0, "tide")]
    d = write(spark, tmp_path, notes=(notes, "song_id long, voice string, line_no int, note_seq int, word string"), timed_words=(words, "song_id long, take_id long, seq int, word string"))
    want = {(7, 70, "P1", 1, 1), (7, 70, "P1", 2, 2), (7, 71, "P1", 2, 1), (7, 71, "P2", 1, 2), (8, 80, "P1", 1, 1)}
    for q in (kernels.k1, kernels.k2, kernels.k3):
        assert {(r.song_id, r.take_id, r.voice, r.left_no, r.right_no) for r in q(spark, d).collect()} == want
    heard = {(r.song_id, r.take_id, r.voice): (r.heard, r.longest_unheard) for r in kernels.a16(spark, d).collect()}
    assert heard == {(7, 70, "P1"): (1.0, 0), (7, 70, "P2"): (0.0, 1), (7, 71, "P1"): (0.5, 1), (7, 71, "P2"): (1.0, 0), (8, 80, "P1"): (1.0, 0)}


def test_fuzzy_best_is_the_brute_force(spark):
    rng = random.Random(5)
    slip = lambda t: "".join(c for c in t if rng.random() > 0.12) + rng.choice(["", "x"])
    names = [("penelope jidomakelund", "rsve ile"), ("abba", "sos"), ("u2", "one"), ("the midnight band", "paper harbour"), ("", "nothing"), (None, "silence"), ("alone", None)]
    left = [(i, *n) for i, n in enumerate(names * 3)]
    right = [(100, "peenlope jidomakelund", "reve ile")] + [(101 + i, *(n and slip(n) for n in names[i % len(names)])) for i in range(60)]
    norm = similarity.normal_name
    for least in (0.8, 0.9):
        want = set()
        for i, *x in left:
            scored = []
            for j, *y in right:
                ratios = [similarity.block_ratio(norm(p), norm(q)) for p, q in zip(x, y, strict=True) if p is not None and q is not None]
                if ratios and min(ratios) >= least:
                    scored.append((-min(ratios), j))
            want |= {(i, j) for _, j in sorted(scored)[:50]}
        frames = [spark.createDataFrame(rows, "id int, artist string, title string") for rows in (left, right)]
        got = similarity.fuzzy_best(frames[0], frames[1].withColumnRenamed("id", "other"), "id", "other", ["artist", "title"], least=least, k=50)
        assert {(r.id, r.other) for r in got.collect()} == want and (least > 0.8 or (0, 100) in want)


def test_words_of_all_scripts_are_folded(spark, tmp_path):
    want = {"Łódź ": "łodz", "ÅNGSTRÖM": "angstrom", "Привет, мир": "приветмир", "すし": "すし", "dîner": "diner", "it's": "its", "~": ""}
    notes = [(1, w) for w in want] * 2 + [(2, None)]
    d = write(spark, tmp_path, notes=(notes, "song_id long, word string"))
    assert sorted((r.word, r.folded) for r in kernels.QUERIES["f1_fold_word"](spark, d).collect()) == sorted(want.items())


def test_union_takes_all_fixes(spark, tmp_path):
    fixes = [(1, "Odd", "one"), (2, "Even", "two"), (3, "odd", "one")]
    info = [("ODD", "One"), ("even", "TWO"), ("New", "three"), ("NEW", "three")]
    d = write(spark, tmp_path, genre_song_fixes=(fixes, "fix_id long, band string, title string"), song_info=(info, "artist string, title string"))
    got = sorted(tuple(r) for r in relations.QUERIES["x2_union_distinct"](spark, d).select("band", "title").collect())
    assert got == [("Even", "two"), ("NEW", "three"), ("Odd", "one"), ("odd", "one")]


def test_bounds_keep_all_alike_names_and_few_others():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuéжす01 ") for _ in range(rng.choice([1, 2, 5, 12, 20, 30, 63, 64, 65, 90])))
    slip = lambda t: "".join(c for c in t if rng.random() > 0.1) + rng.choice(["", "x", "aa"])
    left = sorted({"", "aaaaaaaaaaaaa", *(word() for _ in range(400))})
    right = sorted({"", "a", "aaaaaaaaaaaaaa", *map(slip, left), *(word() for _ in range(100))})
    a, b = similarity.Letters(left), similarity.Letters(right)
    for least in (0.0, 0.5, 0.8, 1.0):
        got = [(a.names[m], b.names[n]) for i, j in similarity.may_be_alike(a, b, least) for m, n in zip(i, j, strict=True)]
        few = left if least == 0.8 else left[::7]
        want = {(x, y) for x in few for y in right if (r := similarity.SequenceMatcher(None, x, y)).quick_ratio() >= least and r.ratio() >= least}
        assert len(set(got)) == len(got) and want <= set(got)
        assert least != 0.8 or len(want) > 10 and len(got) < 0.1 * len(left) * len(right)


def test_songs_of_a_hot_band_meet_by_title(spark, monkeypatch):
    """The pairs that are scored are those alike in both names, not all of a band's; a missing name doesn't count."""
    rng = random.Random(9)
    title = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))
    titles = [title() for _ in range(200)]
    seen = spark.sparkContext.accumulator(0)
    ratio = similarity._at_least
    monkeypatch.setattr(similarity, "_at_least", lambda least, x, y: ratio(least, x, y) + similarity.F.udf(lambda v: seen.add(1) or 0.0, "double")(y))
    left = spark.createDataFrame([*((i, "the one band", t) for i, t in enumerate(titles)), (900, None, titles[3]), (901, "the one band", None)], "id int, artist string, title string")
    right = spark.createDataFrame([*((i, "the one bnad", t + "x") for i, t in enumerate(titles)), (900, "the one band", None)], "other int, artist string, title string")
    got = {(r.id, r.other) for r in similarity.fuzzy_best(left, right, "id", "other", ["artist", "title"], least=0.8, k=1000).collect()}
    assert got == {*((i, i) for i in range(200)), *((i, 900) for i in range(200)), (900, 3), *((901, i) for i in range(200)), (901, 900)}
    assert seen.value < 5000


def test_rows_that_share_their_names_are_not_paired(spark, tmp_path, monkeypatch):
    """j19 and j4 score different names once, however many rows have them; each fix still gets its hit."""
    seen = spark.sparkContext.accumulator(0)
    ratio = similarity._at_least
    monkeypatch.setattr(similarity, "_at_least", lambda least, x, y: ratio(least, x, y) + similarity.F.udf(lambda v: seen.add(1) or 0.0, "double")(y))
    fixes = [*((i, "The One Band", "Paper Harbour") for i in range(60)), *((100 + i, "the one band", None) for i in range(3)), (200, None, "Other Song"), (300, "Nobody", "Nothing")]
    media = [*((1000 - i, "The One Bnad", "Paper harbour!", 100.0 + i, None) for i in range(60)), (5, "Stone Lake", "Other Song", None, None), (6, "Stone Lake", "other song", 199.0, None), (7, "The One Band", "River", 0.0, "link"), (8, None, "Other Song", 200.0, "link")]
    d = write(spark, tmp_path, genre_song_fixes=(fixes, "fix_id long, band string, title string"), media_info=(media, "media_id long, artist string, title string, bpm double, video_url string"))
    assert {(r.fix_id, r.media_id) for r in lyrics.QUERIES["j19_cheapest_hit"](spark, d).collect()} == {*((i, 941) for i in range(60)), *((100 + i, 7) for i in range(3)), (200, 6)}
    best = {(r.fix_id, r.media_id, r.place) for r in kernels.QUERIES["j4_fuzzy_best"](spark, d).collect()}
    assert best == {*((i, 941 + n, n + 1) for i in range(60) for n in range(3)), *((100 + i, m, n + 1) for i in range(3) for n, m in enumerate((7, 941, 942))), (200, 5, 1), (200, 6, 2)}
    assert seen.value < 100
