import pytest

from cadenza.operators.packed import CLOSE, OPEN, explode_packed

NAMES = ["R&B", "Waltz, Slow", "Opera, Comic", "n/a", "Hip-Hop"]
CASES = [
    ("Rock, Pop", ["Rock", "Pop"]),
    ("Rock;;Pop / Jazz|Soul\tFunk\\Ska · Emo • Folk\nBlues", ["Rock", "Pop", "Jazz", "Soul", "Funk", "Ska", "Emo", "Folk", "Blues"]),
    ('["Rock", "opera, cmic", Pop]', ["Rock", "opera, cmic", "Pop"]),
    ("Waltz, Slow, Rock", ["Waltz, Slow", "Rock"]),
    ("WALTZ,  SLOW; R&B", ["WALTZ,  SLOW", "R&B"]),
    ('Rock/n/a/"Waltz, Slow"', ["Rock", "n/a", "Waltz, Slow"]),
    ('"Rock, Pop', ["Rock", "Pop"]),
    ('12" mix, 7" mix', ["12\" mix", "7\" mix"]),
    (f"a{OPEN}0{CLOSE}, b{CLOSE}", [f"a{OPEN}0{CLOSE}", f"b{CLOSE}"]),
    ("Rock", ["Rock"]),
    (" , ;", []),
    ("", []),
    (None, []),
    (", ".join(["Rock"] * 20_000), ["Rock"] * 20_000),
]


@pytest.mark.parametrize("least", [1, 2])
def test_split(spark, least):
    df = spark.createDataFrame([(i, v, 9) for i, (v, _) in enumerate(CASES)], "id int, v string, pos int")
    got: dict = {}
    for r in explode_packed(df, "v", NAMES, keep=["id"], least=least).collect():
        got.setdefault(r.id, {})[r.pos] = r.piece
    want = {i: dict(enumerate(p)) for i, (_, p) in enumerate(CASES) if len(p) >= least}
    assert got == want


def test_empty_and_no_names(spark):
    assert explode_packed(spark.createDataFrame([], "id int, v string"), "v", [], keep=["id"]).count() == 0
