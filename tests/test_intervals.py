import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.operators.intervals import dyadic_union, periods_and_gaps


def brute(rows):
    """Periods and gaps by sorting each key's intervals."""
    out, by = set(), {}
    for key, s, e in rows:
        if s is not None and e is not None and e > s:
            by.setdefault(key, []).append((s, e))
    for key, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(key, "period", s, e) for s, e in merged}
        out |= {(key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:], strict=False)}
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-200, 200), st.integers(1, 90)), min_size=1, max_size=60))
def test_dyadic_union_is_the_union(rows):
    group, start, length = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    low, high, of = dyadic_union(start, start + length, group)
    got = set(zip(of.tolist(), low.tolist(), high.tolist(), strict=True))
    assert got == {(k, a, b) for k, kind, a, b in brute([(g, s, s + n) for g, s, n in rows]) if kind == "period"}


def run(spark, rows, **more):
    df = spark.createDataFrame([(k, s, e, "x") for k, s, e in rows], "key string, s long, e long, kind string")
    got = periods_and_gaps(df, ["key"], "s", "e", **more).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_hot_key_over_many_ranges(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice(["hot", "hot", "a", None]), s := rng.randrange(-3000, 3000), s + rng.randrange(-2, 12)) for _ in range(900)]
    rows += [("hot", -100, 2500), ("long", -(10**12), 10**12), ("hot", None, 4), ("a", 5, None)] + rows[:40]
    assert run(spark, rows, partitions=partitions) == brute(rows)


def test_empty_touching_and_repeated(spark):
    assert run(spark, []) == set()
    assert run(spark, [("k", 3, 3), ("k", 4, 2), ("k", None, None)]) == set()
    assert run(spark, [("k", 0, 2), ("k", 2, 4), ("k", 0, 2), ("k", 6, 7)]) == {("k", "period", 0, 4), ("k", "gap", 4, 6), ("k", "period", 6, 7)}
