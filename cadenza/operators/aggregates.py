"""Aggregations, with the tie rules and tolerances spelled out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.windows import middle_of


def most_frequent(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the first seen. Nulls don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))
    best = F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col("first")))
    return counts.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b")[value].alias(value), F.col("b")["n"].alias("n"))


def status_counts(df: DataFrame, key: str, status: str, values: list[str]) -> DataFrame:
    """A column of counts for each status, and the total, in one pass."""
    return df.groupBy(key).agg(*[F.count_if(F.col(status) == v).alias(f"n_{v.lower()}") for v in values], F.count(F.lit(1)).alias("total"))


def roll_up(df: DataFrame, base: str, item: str, spelling: str) -> DataFrame:
    """By base: different items, and its spellings as "a (2), b (1)", most items first, then by name."""
    each = df.select(base, item, spelling).distinct().groupBy(base, spelling).agg(F.count(F.lit(1)).alias("n"))
    items = df.select(base, item).distinct().groupBy(base).agg(F.count(F.lit(1)).alias("items"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(spelling).alias("s")))), lambda x: F.concat(x["s"], F.lit(" ("), (-x["m"]).cast("string"), F.lit(")"))), ", ")
    return each.groupBy(base).agg(listed.alias("spellings")).join(items, base)


def consensus(df: DataFrame, keys: list[str], value: str, source: str, rank: str) -> DataFrame:
    """Values of each key ranked by how many sources name them, then by their best rank, then by name: `place` from 1."""
    votes = df.groupBy(*keys, value).agg(F.count_distinct(source).alias("sources"), F.min(rank).alias("best"))
    return votes.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("sources"), "best", value)))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, and the distance from the tenth to the ninetieth percentile, both by linear interpolation."""
    return df.groupBy(*keys).agg(F.median(value).alias("median"), (F.percentile(value, 0.9) - F.percentile(value, 0.1)).alias("spread"), F.count(value).alias("n"))


def settled_median(df: DataFrame, keys: list[str], value: str, *, least: int, most_spread: float) -> DataFrame:
    """The median where there are `least` values that spread at most so far, else null, with the reason."""
    s = spread(df, keys, value)
    reason = F.when(F.col("n") < least, "few").when(F.col("spread") > most_spread, "spread").otherwise("ok")
    return s.withColumn("reason", reason).withColumn("settled", F.when(F.col("reason") == "ok", F.bround(F.col("median") * 1000)))


def share_within(df: DataFrame, keys: list[str], value: str, tolerances: dict[str, float]) -> DataFrame:
    """The share of values within each tolerance of zero (a billionth of slack for rounding)."""
    return df.groupBy(*keys).agg(*[F.avg((F.abs(value) <= t + 1e-9).cast("double")).alias(n) for n, t in tolerances.items()])


def mean_without_largest(df: DataFrame, keys: list[str], value: str, *, least: int = 5) -> DataFrame:
    """The mean without the values equal to the largest; 0 where there are fewer than `least` values or nothing is left.

    Sums and counts by value are combined first, so no key is collected.
    """
    by_value = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    top = by_value.groupBy(*keys).agg(F.max_by(F.struct(value, "n"), value).alias("top"), F.sum(F.col(value) * F.col("n")).alias("total"), F.sum("n").alias("n"))
    left = F.col("n") - F.col("top")["n"]
    return top.select(*keys, F.when((F.col("n") >= least) & (left > 0), (F.col("total") - F.col("top")[value] * F.col("top")["n"]) / left).otherwise(0.0).alias("mean"))


def theil_sen(df: DataFrame, keys: list[str], x: str, y: str, *, least: int = 8, most: int = 400, apart: float = 1.0, within: float = 1.0) -> DataFrame:
    """Robust line through each key's points: median slope of pairs more than `apart` in x, median intercept, and the share of points within `within`.

    Pairs are taken of every (n // most)-th point, as the method has it, so a
    key sends at most 2 most points to the function that pairs them, however
    many it has; the intercept and the share use all points. Slope 1 where no pair is far
    enough apart; keys with fewer than `least` points give no row.
    """
    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("x"), F.col(y).alias("y"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("x", "y")) - 1
    sized = points.join(points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), keys)
    thin = sized.withColumn("i", place).where(F.col("i") % F.greatest(F.lit(1), F.floor(F.col("n") / most)) == 0)
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def median_slope(group: pd.DataFrame) -> pd.DataFrame:
        at, level = group.sort_values("i")[["x", "y"]].to_numpy(float).T
        far = np.triu(at[None, :] - at[:, None] > apart, 1)
        slope = [float(np.median((level[None, :] - level[:, None])[far] / (at[None, :] - at[:, None])[far]))] if far.any() else []
        return pd.DataFrame({**{k: [group[k].iloc[0]] * len(slope) for k in keys}, "slope": slope})

    slopes = thin.select(*keys, "x", "y", "i").groupBy(*keys).applyInPandas(median_slope, f"{kinds}, slope double")
    sloped = sized.join(slopes, keys, "left").withColumn("slope", F.coalesce("slope", F.lit(1.0)))
    level = sloped.groupBy(*keys).agg(F.first("slope").alias("slope"), F.median(F.col("y") - F.col("slope") * F.col("x")).alias("intercept"), F.count(F.lit(1)).alias("n"))
    fitted = sized.drop("n").join(level, keys)
    off = F.abs(F.col("y") - F.col("slope") * F.col("x") - F.col("intercept")) <= within
    return fitted.groupBy(*keys).agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.first("n").alias("n"), F.avg(off.cast("double")).alias("agree"))


def best_window_share(df: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """The largest share of a key's values that lie within `width` of each other."""
    w = f"PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY `{value}` RANGE BETWEEN {width + 1e-9!r}D PRECEDING AND CURRENT ROW"
    seen = df.where(F.col(value).isNotNull()).select(*keys, F.expr(f"count(1) OVER ({w})").alias("c"))
    return seen.groupBy(*keys).agg((F.max("c") / F.count(F.lit(1))).alias("share"))


def mismatch_share(df: DataFrame, keys: list[str], order: list[str], value: str, *, k: int = 2, most: float, share: float) -> DataFrame:
    """The share of values more than `most` from the local upper median, and whether that is above `share`."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-k, k)
    odd = df.withColumn("__odd", (F.abs(F.col(value) - middle_of(F.collect_list(value).over(frame), upper=True)) > most).cast("double"))
    return odd.groupBy(*keys).agg(F.avg("__odd").alias("share")).withColumn("suspicious", F.col("share") > share)


def ranges_text(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """A key's different numbers as "1-3, 5"."""
    w = Window.partitionBy(*keys).orderBy(number)
    runs = df.select(*keys, number).where(F.col(number).isNotNull()).distinct().withColumn("__run", F.col(number) - F.row_number().over(w))
    each = runs.groupBy(*keys, "__run").agg(F.min(number).alias("a"), F.max(number).alias("b"))
    text = lambda x: F.when(x["a"] == x["b"], x["a"].cast("string")).otherwise(F.concat(x["a"].cast("string"), F.lit("-"), x["b"].cast("string")))
    return each.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b"))), text), ", ").alias("ranges"))


#: The steps of a major and a minor scale. Fixed values.
MAJOR_STEPS, MINOR_STEPS = [0, 2, 4, 5, 7, 9, 11], [0, 2, 3, 5, 7, 8, 10]


def detect_key(df: DataFrame, keys: list[str], pitch: str, weight: Column) -> DataFrame:
    """The musical key whose scale correlates best with the key's pitch classes (1 for those of the scale, 0 for others); of equal ones the lower tonic, then major."""
    classes = df.where(F.col(pitch).isNotNull()).groupBy(*keys).agg(*[F.sum(F.when(F.pmod(pitch, F.lit(12)) == i, weight).otherwise(0)).cast("double").alias(f"c{i}") for i in range(12)])
    mean = sum((F.col(f"c{i}") for i in range(12)), F.lit(0.0)) / 12
    size = F.sqrt(sum(((F.col(f"c{i}") - mean) * (F.col(f"c{i}") - mean) for i in range(12)), F.lit(0.0)))
    scored = []
    for tonic in range(12):
        for minor, steps in ((0, MAJOR_STEPS), (1, MINOR_STEPS)):
            inside = sum((F.col(f"c{(tonic + s) % 12}") - mean for s in steps), F.lit(0.0))  # the mean of centred values is 0
            spread = (len(steps) * (12 - len(steps)) / 12) ** 0.5
            scored.append(F.struct((-F.round(inside / (size * spread), 9)).alias("r"), F.lit(tonic).alias("tonic"), F.lit(minor).alias("minor")))
    best = F.array_min(F.array(*scored))
    return classes.where(size > 0).select(*keys, best["tonic"].alias("tonic"), best["minor"].alias("minor"), F.round(-best["r"], 6).alias("correlation"))


def frame_levels(df: DataFrame, keys: list[str], position: str, value: str, size: int) -> DataFrame:
    """Level in dB of each whole frame of `size` samples by position; a last frame that isn't whole is left out."""
    frames = df.groupBy(*keys, F.floor(F.col(position) / size).alias("frame")).agg(F.avg(F.col(value) * F.col(value)).alias("power"), F.count(F.lit(1)).alias("n"))
    return frames.where(F.col("n") == size).select(*keys, "frame", (10 * F.log10(F.col("power") + 1e-12)).alias("db"))
