import random

import pytest
from pyspark.sql import functions as F

from cadenza.llm.leakage import Item, held_words, leaked, pairs, words_of
from cadenza.llm.mixing import mix, plan, route, token_counts
from cadenza.llm.readability import read_sentences, reading_levels, sung_text

NOUNS = "garden river lantern mirror harbour window letter train kingdom compass orchard signal".split()
VERBS = "kept sold drew lifted changed finished mentioned repeated missed improved".split()


def sentence(rng, n=12):
    return " ".join(rng.choice(NOUNS if i % 2 else VERBS) + rng.choice(["", "s", "ed"]) for i in range(n)).capitalize() + "."


def text(rng, n=8):
    return " ".join(sentence(rng) for _ in range(n))


def test_leaks(spark):
    rng = random.Random(3)
    items = [(i, text(rng, 5)) for i in range(8)]
    docs = [(i, text(rng)) for i in range(60)]
    words = items[2][1].split()
    typos = " ".join(w[:-1] if k % 9 == 5 else w for k, w in enumerate(words))
    docs += [
        (100, f"{docs[0][1]} {items[0][1]}"),
        (101, items[1][1].upper().replace(" ", "\n")),
        (102, typos),
        (103, " ".join(items[3][1].split()[:30]) + " " + docs[1][1]),
        (104, " ".join(items[4][1].split()[:14]) + " " + docs[2][1]),
        (105, "#TITLE:x\n#BPM:300\n" + "\n".join(f": {k} 1 5 {w} " for k, w in enumerate(items[5][1].split())) + "\nE"),
        (106, None),
        (107, ""),
        (108, "word"),
        (109, items[6][1].replace("a", "а").replace("e", "е")),
        (110, (docs[3][1] + " ") * 300 + items[7][1]),
    ]
    df = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id int, text string, share string")
    got = {(r.doc_id, r.item_id) for r in leaked(df, spark.createDataFrame([*items, (9, None), (10, "")], "item_id int, text string")).collect()}
    assert got == {(100, 0), (101, 1), (102, 2), (103, 3), (105, 5), (109, 6), (110, 7)}


def test_leaks_are_those_of_brute_force(spark):
    """Every document against every item, without retrieval: the index loses no pair of such texts, and the question's share is that of its own words."""
    rng = random.Random(8)
    items = [(i, text(rng, 4) + f" Who kept {rng.choice(NOUNS)} number {i} near the garden?") for i in range(25)]

    def changed(t):
        words = t.split()
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = rng.choice(NOUNS)
        start = rng.randrange(max(1, len(words) // 2))
        return " ".join(words[start : start + rng.randrange(12, len(words))])

    docs = [(i, text(rng, 3) + " " + changed(rng.choice(items)[1]) + " " + text(rng, 2)) for i in range(150)]
    known = {i: Item(words_of([t])[0]) for i, t in items}
    want = {(d, i) for d, t in docs for i, item in known.items() if held_words(item, pairs(words_of([t])[0])).mean() >= 0.4}
    rows = leaked(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got <= want and len(got) >= 0.97 * len(want) > 30
    assert {r.asked == 1.0 for r in rows} == {True, False} and all(r.asked is not None for r in rows)


def test_leaks_of_nothing(spark):
    none, one = spark.createDataFrame([], "doc_id int, text string"), spark.createDataFrame([(1, "a b c")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "some words of an item")], "item_id int, text string")
    assert leaked(none, items).count() == 0 and leaked(one, items.where("item_id > 1")).count() == 0
    with pytest.raises(ValueError):
        leaked(one, items, most_letters=5)


def test_words_are_folded():
    a, b = words_of(["Per-\nformance, ÉTÉ naïve", "performance été n­aïve"])
    assert list(a) == list(b)


def test_flow_is_least_repetition():
    total, used = route({("a", "b"): 100, ("a",): 10, ("b",): 5}, {"a": 60, "b": 60}, {"a": 2, "b": 2})
    assert total == 120 and sum(n for (_, use, _), n in used.items() if use == 2) == 5
    size, quotas, flow = plan({("a",): 100, ("b",): 10}, {"a": (0.5, 1), "b": (0.4, 3), "gone": (0.1, 9)}, None)
    assert abs(quotas["b"] - 30) <= 1 and abs(size - 67) <= 2 and sum(flow.values()) == sum(quotas.values())
    assert plan({}, {"a": (1.0, 1)}, None) == (0, {}, {})


def test_mixture(spark):
    rng = random.Random(5)
    docs = [(i, ["a"] if i % 10 < 6 else ["b"] if i % 10 < 9 else ["c"], rng.randrange(1, 60), "x") for i in range(3000)] + [(9001, None, 5, "x"), (9002, [], 5, "x"), (9003, ["a"], 0, "x"), (9004, ["a"], None, "x")]
    df = spark.createDataFrame(docs, "doc_id int, members array<string>, tokens int, source_name string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 2), ("c", 0.3, 4), ("gone", 0.1, 2)], "source_name string, target_share double, max_repeats int")
    first, shares = mix(df, targets, doc_id="doc_id", members="members")
    rows = first.collect()
    caps = {"a": 1, "b": 2, "c": 4}
    assert rows and all(1 <= r.repeats <= caps[r.source_name] for r in rows)
    reached = {r.source_name: r.reached_share for r in shares.collect()}
    assert all(abs(reached[s] - 1 / 3) < 0.01 for s in caps) and reached["gone"] == 0
    assert sorted(rows) == sorted(mix(df, targets, doc_id="doc_id", members="members")[0].collect())
    assert sorted(rows) != sorted(mix(df, targets, doc_id="doc_id", members="members", seed=1)[0].collect())
    assert max(r.repeats for r in rows if r.source_name == "c") == 4
    assert mix(df.where("doc_id < 0"), targets, doc_id="doc_id", members="members")[0].count() == 0


def test_tokens_are_those_of_the_whole_text(spark):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Größe der Straße", "", None, "<|endoftext|>", "word " * 20_000]
    got = {r.i: r.tokens for r in token_counts(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), ["i"], "text").collect()}
    assert got == {i: len(encoding.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


EASY = ["The cat has a red hat.", "Tom can sing.", "My dog ran to the park.", "I like the ball and Mia."]
MIDDLE = ["The patient singer repeated a forgotten chorus near the station, because the village went quiet.", "Most fans remembered the acoustic album when the second concert was over.", "Our guitar player described a cheaper ticket before the break."]
HARD = ["Notwithstanding the hermeneutic periodicity of phonology, the epistemology instantiates a predominantly institutional historiography, whose commensurability destabilises representation.", "Teleological instrumentation presupposes intersubjective commensurability.", "Irrespective of signification as such, multifactorial heterophony subordinates ethnomusicology."]


def test_levels(spark):
    rng = random.Random(1)
    docs, grades = [], []
    for i in range(240):
        level = i % 3
        docs.append((i, " ".join(rng.choice((EASY, MIDDLE, HARD)[level if rng.random() < 0.8 else rng.randrange(3)]) for _ in range(9)), "z"))
        if i < 150:
            grades.append((i, 1, level + 1))
    docs += [(900, None, "z"), (901, "", "z"), (902, "...!", "z"), (903, " ".join(HARD * 3000), "z"), (904, "\n".join(s.rstrip(".") for s in EASY * 3), "z")]
    df = spark.createDataFrame(docs, "doc_id int, text string, reading_level string")
    labels = spark.createDataFrame([*grades, (5, 2, None), (7777, 1, 2)], "doc_id int, rater int, reading_level int")
    got = {r.doc_id: r.reading_level for r in reading_levels(df, labels).collect()}
    right = [got[i] == i % 3 + 1 for i in range(150, 240)]
    assert sum(right) >= 0.95 * len(right)
    assert [got[i] for i in (900, 901, 902, 903, 904)] == [None, None, None, 3, 1]
    assert reading_levels(df.where("doc_id < 0").unionByName(df.where("doc_id < 150")), labels).where(F.col("reading_level").isNull()).count() == 0
    with pytest.raises(ValueError):
        reading_levels(df, labels.where("doc_id > 90000"))


def test_sentences_of_song_files():
    song = "#TITLE:T\n: 0 1 2 Soon \n: 1 1 2 Tom \n: 2 1 2 ran. \n- 9\n: 9 1 1 We \n: 10 1 1 sang\nE\n"
    assert "Soon" in sung_text(song) and "TITLE" not in sung_text(song) and "0 1 2" not in sung_text(song)
    assert len(read_sentences([song, None, "One. Two! Three"]).words) >= 5
