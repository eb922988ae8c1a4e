import pytest
from pyspark.sql import functions as F

from cadenza.llm.encodings import PAIRS, Statistics, clean_bigrams, restore

CLEAN = ["Jürgen tanzt über die Straße", "früh höher schön Glück für Mädchen", "Conceição não então coração são João", "CONCEIÇÃO JOÃO SÃO", "canción mañana corazón señal niño", "été âme forêt fenêtre cœur Noël", "Małgorzata świat księżyc żółte", "Группа песня дорога снова ночь любовь", "L’été – “nuit”", "50 € for £ 3", "°C or °F?", "Âme Ñandú Đêm № 5", "そらずっとかぜ"]


@pytest.fixture(scope="module")
def bigrams(spark):
    df = spark.createDataFrame([(t,) for t in CLEAN * 4] + [(None,), ("",)], "v string")
    return clean_bigrams(df, "v")


def fixed(spark, bigrams, texts):
    df = spark.createDataFrame([(i, t, "x", True) for i, t in enumerate(texts)], "i int, v string, restored string, garbled boolean")
    return {r.i: (r.restored, r.garbled) for r in restore(df, "v", bigrams).collect()}


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac-roman", "cp437", "cp1250", "cp1251"])
def test_round_trip_of_utf8(spark, bigrams, wrong):
    pairs = []
    for text in CLEAN[:7]:
        try:
            pairs.append((text, text.encode().decode(wrong)))
        except UnicodeDecodeError:
            continue
    got = fixed(spark, bigrams, [bad for _, bad in pairs])
    assert pairs and all(got[i] == (text, True) for i, (text, _) in enumerate(pairs) if not text.isascii())


def test_twice_and_single_byte(spark, bigrams):
    twice = "Jürgen für".encode().decode("latin-1").encode().decode("latin-1")
    russian = "песня дорога снова ночь".encode("cp1251").decode("cp1252")
    got = fixed(spark, bigrams, [twice, russian, "fran�ais", "ï»¿#TITLE:Tür"])
    assert got[0] == ("Jürgen für", True) and got[1] == ("песня дорога снова ночь", True)
    assert got[2] == ("fran�ais", True) and got[3][1]


def test_genuine_text_is_left_alone(spark, bigrams):
    texts = [*CLEAN, None, "", "plain", "﻿#TITLE:Über", "x" * 200_000 + " für"]
    assert fixed(spark, bigrams, texts) == {i: (t, False) for i, t in enumerate(texts)}


def test_empty(spark, bigrams):
    empty = spark.createDataFrame([], "v string")
    none = clean_bigrams(empty, "v")
    assert none == Statistics({}) and restore(empty, "v", none).count() == 0
    assert restore(spark.createDataFrame([("für",)], "v string"), "v", none).where(F.col("garbled")).count() == 0


def test_two_pairs_in_one_value_and_in_one_token(spark, bigrams):
    """One decoding over all states: each span gets the inverse transform of its own pair."""
    utf8, mac = "für Jürgen über".encode().decode("cp1252"), "schön Glück".encode("cp1252").decode("mac-roman")
    mixed = "Mädchen".encode().decode("cp1252") + "Straße".encode("cp1252").decode("mac-roman")
    got = fixed(spark, bigrams, [f"{utf8} {mac}", f"{utf8} {mixed} {mac}"])
    assert got[0] == ("für Jürgen über schön Glück", True)
    assert got[1] == ("für Jürgen über MädchenStraße schön Glück", True)


def test_shares_make_frequent_damage_cheaper(spark):
    df = spark.createDataFrame([(t,) for t in CLEAN * 4] + [(t.encode().decode("mac-roman"),) for t in CLEAN[:6] * 3], "v string")
    shares = clean_bigrams(df, "v").shares
    assert max(shares, key=shares.get) == PAIRS.index(("utf-8", "mac-roman", 1)) and 0 < sum(shares.values()) < 1
