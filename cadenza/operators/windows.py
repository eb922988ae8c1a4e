"""Window operators over ordered sequences: every order names a unique final key, so ties have one result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def middle_of(values: Column, *, upper: bool = False) -> Column:
    """The median of an array (nulls left out): the mean of the two middle values of an even number, or the upper one."""
    ordered = F.array_sort(F.array_compact(values))
    n = F.size(ordered)
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    if upper:
        return high
    return F.when(n % 2 == 1, high).otherwise((high + F.get(ordered, F.floor(n / 2).cast("int") - 1)) / 2)


def rolling_median(df: DataFrame, keys: list[str], order: list[str], value: str, k: int, *, out: str = "median") -> DataFrame:
    """Median of the k rows before to k rows after, fewer at the ends. Frames hold 2k + 1 values, so collecting them is bounded."""
    frame = _over(keys, order).rowsBetween(-k, k)
    return df.withColumn(out, middle_of(F.collect_list(value).over(frame)))


def local_upper_median(df: DataFrame, keys: list[str], order: list[str], value: str, k: int, *, out: str = "local") -> DataFrame:
    """As rolling_median, with the upper of two middle values."""
    frame = _over(keys, order).rowsBetween(-k, k)
    return df.withColumn(out, middle_of(F.collect_list(value).over(frame), upper=True))


def gaps(df: DataFrame, keys: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """Distance to the previous row's end and to the next row's start; null at the ends."""
    w = _over(keys, order)
    return df.withColumn("gap_before", F.col(start) - F.lag(end).over(w)).withColumn("gap_after", F.lead(start).over(w) - F.col(end))


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an aggregate, so it combines before the shuffle and needs no sort."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__row"))
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in others])


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, likewise."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__row"))
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in others])


def islands(df: DataFrame, keys: list[str], order: list[str], new: Column, *, out: str = "island") -> DataFrame:
    """Numbers runs of rows from 1: a row for which `new` holds (null: doesn't) begins one. `new` may use window functions."""
    return df.withColumn("__new", new).withColumn(out, F.sum(F.when(F.coalesce("__new", F.lit(False)), 1).otherwise(0)).over(_over(keys, order)) + 1).drop("__new")


def gap_islands(df: DataFrame, keys: list[str], order: list[str], position: str, threshold: float, *, inclusive: bool = False) -> DataFrame:
    """Islands that a distance above `threshold` (or equal, if inclusive) parts."""
    apart = F.col(position) - F.lag(position).over(_over(keys, order))
    return islands(df, keys, order, apart >= threshold if inclusive else apart > threshold)


def identical_runs(df: DataFrame, keys: list[str], order: list[str], value: str, least: int) -> DataFrame:
    """Runs of at least `least` equal values in a row: the keys, the value, first order value and length."""
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(_over(keys, order)))
    runs = islands(df, keys, order, changed)
    return runs.groupBy(*keys, "island", value).agg(F.min(order[0]).alias("first"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= least)


def trailing_run(df: DataFrame, keys: list[str], order: list[str], start: str, end: str, least_gap: float, most_tail: float) -> DataFrame:
    """Marks what follows the last gap of `least_gap` or more, if it lasts at most `most_tail` and no later row goes back in time: `tail`."""
    w = _over(keys, order)
    whole = Window.partitionBy(*keys)
    df = df.withColumn("__gap", F.col(start) - F.lag(end).over(w)).withColumn("__n", F.row_number().over(w))
    df = df.withColumn("__cut", F.max(F.when(F.col("__gap") >= least_gap, F.col("__n"))).over(whole))
    df = df.withColumn("__back", F.max(F.when(F.col("__gap") < 0, F.col("__n"))).over(whole))
    df = df.withColumn("__span", F.max(end).over(whole) - F.max(F.when(F.col("__n") == F.col("__cut"), F.col(start))).over(whole))
    tail = (F.col("__n") >= F.col("__cut")) & (F.col("__span") <= most_tail) & ~(F.coalesce("__back", F.lit(0)) > F.col("__cut"))
    return df.withColumn("tail", F.coalesce(tail, F.lit(False))).drop("__gap", "__n", "__cut", "__back", "__span")


def monotone_clamp(df: DataFrame, keys: list[str], order: list[str], start: str, length: str, *, out: str = "clamped") -> DataFrame:
    """The least starts, none before the given one, at which rows in order don't overlap: a running maximum, not a loop.

    clamped_j = max over i <= j of (start_i - length before i) + length before j.
    """
    w = _over(keys, order)
    before = F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("__before", before)
    return df.withColumn(out, F.max(F.col(start) - F.col("__before")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__before")).drop("__before")


def fill_missing_times(df: DataFrame, keys: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """Rows without times follow the last known end: the n-th of a run starts 0.1 + 0.2 (n - 1) after it and lasts 0.1; before any known end, at 0."""
    w = _over(keys, order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__known", F.last(end, ignorenulls=True).over(before)).withColumn("__group", F.count(end).over(w))
    nth = F.row_number().over(Window.partitionBy(*keys, "__group").orderBy(*order)) - F.when(F.col("__group") > 0, 1).otherwise(0)
    df = df.withColumn("__nth", nth)
    base = F.when(F.col("__known").isNull(), F.lit(0.2) * (F.col("__nth") - 1)).otherwise(F.col("__known") + 0.1 + F.lit(0.2) * (F.col("__nth") - 1))
    missing = F.col(end).isNull()
    return df.withColumn("filled_start", F.when(missing, base).otherwise(F.col(start))).withColumn("filled_end", F.when(missing, base + 0.1).otherwise(F.col(end))).drop("__known", "__group", "__nth")


def consensus_outliers(df: DataFrame, keys: list[str], order: list[str], value: str, *, before: int = 10, least: int = 3, most: float = 4.0) -> DataFrame:
    """Whether a value is more than `most` from the median of the `before` values before it (if there are `least`)."""
    frame = _over(keys, order).rowsBetween(-before, -1)
    seen = F.collect_list(value).over(frame)
    return df.withColumn("__seen", seen).withColumn("consensus", F.when(F.size("__seen") >= least, middle_of(F.col("__seen")))).withColumn("outlier", F.coalesce(F.abs(F.col(value) - F.col("consensus")) > most, F.lit(False))).drop("__seen")


def words_of_syllables(df: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """Joins syllables to words: a word ends at a trailing blank, before a leading one, and at the end of the keys' rows.

    Result: keys, word_no from 1, word (trimmed), syllables.
    """
    w = _over(keys, order)
    starts = F.lag(text).over(w).rlike(r"\s$") | F.col(text).rlike(r"^\s")
    numbered = islands(df, keys, order, starts, out="word_no")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__text")))), lambda x: x["__text"]), "")
    return numbered.groupBy(*keys, "word_no").agg(F.trim(joined).alias("word"), F.count(F.lit(1)).alias("syllables"))


def merge_same(df: DataFrame, keys: list[str], order: list[str], value: str, joins: Column, start: str, end: str) -> DataFrame:
    """Merges rows into the one before where `joins` holds and the value is the same: keys, island, value, start, end, rows."""
    same = F.col(value).eqNullSafe(F.lag(value).over(_over(keys, order))) & F.coalesce(joins, F.lit(False))
    marked = islands(df, keys, order, ~same & F.lag(F.lit(1)).over(_over(keys, order)).isNotNull())
    return marked.groupBy(*keys, "island").agg(F.min_by(value, F.struct(*order)).alias(value), F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("rows"))
