"""Overlapping and gapped intervals: continuous periods and the gaps between them.

Integer intervals are decomposed into canonical dyadic blocks; blocks covered
by an ancestor are removed, sibling pairs merged upward, adjacent blocks
coalesced. The work is split by ranges of (key, start), so one key holding a
third of all rows spreads over many tasks; what crosses a range border is
mended afterwards from a few rows per range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.session import checkpoint, shuffle_partitions

#: Positions are counted from the least BIGINT, without sign.
LEVELS = 64
SIGN = np.uint64(1 << 63)


def dyadic_blocks(start: np.ndarray, end: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By level, the (group, index) of the canonical blocks of the half-open intervals, each once."""
    levels = []
    low, high, of = start.copy(), end.copy(), group
    for _ in range(LEVELS + 1):
        if not len(low):
            break
        left, right = (low & 1) == 1, (high & 1) == 1
        levels.append(_distinct(np.concatenate([of[left], of[right]]), np.concatenate([low[left], high[right] - 1])))
        low, high = (low >> 1) + left, high >> 1
        more = low < high
        low, high, of = low[more], high[more], of[more]
    return levels


def _distinct(group: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((index, group))
    group, index = group[order], index[order]
    first = np.ones(len(group), bool)
    first[1:] = (group[1:] != group[:-1]) | (index[1:] != index[:-1])
    return group[first], index[first]


def _without_covered(levels: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The blocks that no block of a higher level holds: kept ones are disjoint, so one lookup among them decides.

    Blocks are looked up by whole numbers of (group, place of the start among
    all starts), so positions however far apart are told apart exactly.
    """
    starts = np.unique(np.concatenate([index << k for k, (_, index) in enumerate(levels)]))
    places = len(starts) + 1
    kept: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.uint64))] * len(levels)
    held_from, held_to, held_group = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        group, index = levels[level]
        if not len(group):
            continue
        start = index << level
        key = group * places + np.searchsorted(starts, start)
        if len(held_from):
            at = np.searchsorted(held_from, key, side="right") - 1
            inside = (at >= 0) & (held_group[at] == group) & (held_to[at] > start)
            group, index, start, key = group[~inside], index[~inside], start[~inside], key[~inside]
        kept[level] = group, index
        order = np.argsort(np.concatenate([held_from, key]), kind="stable")
        held_from = np.concatenate([held_from, key])[order]
        held_to = np.concatenate([held_to, start + (1 << level)])[order]
        held_group = np.concatenate([held_group, group])[order]
    return kept


def _merged_upward(levels: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sibling pairs become their parent, from the lowest level on."""
    out, group, index = [], np.empty(0, np.int64), np.empty(0, np.uint64)
    level = 0
    while level < len(levels) or len(group):
        if level < len(levels):
            group, index = _distinct(np.concatenate([group, levels[level][0]]), np.concatenate([index, levels[level][1]]))
        first = np.zeros(len(group), bool)
        first[:-1] = (group[1:] == group[:-1]) & ((index[:-1] & 1) == 0) & (index[1:] == index[:-1] + 1)
        second = np.zeros(len(group), bool)
        second[1:] = first[:-1]
        out.append((group[~(first | second)], index[~(first | second)]))
        group, index = group[first], index[first] >> 1
        level += 1
    return out


def dyadic_union(start: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of half-open integer intervals per group: sorted, disjoint, not touching."""
    if not len(start):
        return start, end, group
    plain = [x.astype(np.int64).view(np.uint64) ^ SIGN for x in (start, end)]
    levels = _merged_upward(_without_covered(dyadic_blocks(*plain, group)))
    blocks = [(g, i << k, (i + 1) << k) for k, (g, i) in enumerate(levels) if len(g)]
    group, low, high = (np.concatenate(x) for x in zip(*blocks, strict=True))
    order = np.lexsort((low, group))
    group, low, high = group[order], low[order], high[order]
    opens = np.ones(len(group), bool)
    opens[1:] = (group[1:] != group[:-1]) | (low[1:] != high[:-1])
    closes = np.append(opens[1:], True)
    return (low[opens] ^ SIGN).view(np.int64), (high[closes] ^ SIGN).view(np.int64), group[opens]


def _runs(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Numbers the runs of equal keys in a sorted frame; nulls are equal to each other."""
    new = np.zeros(len(frame), bool)
    for k in keys:
        codes = pd.factorize(frame[k], use_na_sentinel=True)[0]
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new).astype(np.int64)


def _pieces_of(keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        open_piece: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            if open_piece is not None:
                batch = pd.concat([open_piece, batch], ignore_index=True)
            group = _runs(batch, keys)
            low, high, of = dyadic_union(batch["from_pos"].to_numpy(np.int64), batch["to_pos"].to_numpy(np.int64), group)
            out = batch[keys].iloc[np.searchsorted(group, of)].reset_index(drop=True)
            out["from_pos"], out["to_pos"] = low, high
            open_piece = out.tail(1)
            if len(out) > 1:
                yield out.iloc[:-1].assign(part=part)
        if open_piece is not None:
            yield open_piece.assign(part=part)

    return pieces


def _borders(summary: list[dict], keys: list[str]) -> dict[int, dict]:
    """What each range must know of the ranges before it, from one row per range."""
    known: dict[int, dict] = {}
    key, reach = None, None
    for s in sorted(summary, key=lambda s: s["part"]):
        first, last = tuple(s["first"][k] for k in keys), tuple(s["last"][k] for k in keys)
        known[s["part"]] = {"reach": reach if first == key else None}
        reach = max(s["last"]["to_pos"], reach) if last == first == key else s["last"]["to_pos"]
        key = last
    return known


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, *, partitions: int | None = None) -> DataFrame:
    """Continuous periods per key and the gaps between neighbouring ones.

    df: rows with half-open integer intervals [start, end); a row with a null
    bound, or whose end isn't after its start, covers nothing. Null keys are a
    key like any other. Result: the keys, kind (`period` or `gap`), from_pos,
    to_pos (BIGINT). Intervals that overlap or touch form one period. An empty
    table gives no rows; other columns of df are ignored, and repeated rows
    change nothing.

    Rows with one key and start are first reduced to the longest (combined
    before the shuffle), so that ranges of (key, start) can split any key.
    The driver gets two rows for each range, never rows per key.
    """
    spark = df.sparkSession
    low, high = F.col(f"`{start}`").cast("long"), F.col(f"`{end}`").cast("long")
    longest = (
        df.select(*[F.col(f"`{k}`") for k in keys], low.alias("from_pos"), high.alias("to_pos"))
        .where(F.col("to_pos") > F.col("from_pos"))
        .groupBy(*keys, "from_pos")
        .agg(F.max("to_pos").alias("to_pos"))
    )
    order = [*keys, "from_pos"]
    fields = [longest.schema[k] for k in keys]
    place = [T.StructField("from_pos", T.LongType()), T.StructField("to_pos", T.LongType())]
    ranged = longest.repartitionByRange(partitions or shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    pieces = checkpoint(ranged.mapInPandas(_pieces_of(keys), T.StructType([*fields, *place, T.StructField("part", T.IntegerType())])))

    ends = F.struct(*[F.col(k) for k in keys], "from_pos", "to_pos")
    rank = F.struct(*[F.struct(F.col(k).isNotNull(), F.col(k)) for k in keys], "from_pos")
    summary = [r.asDict(recursive=True) for r in pieces.groupBy("part").agg(F.min_by(ends, rank).alias("first"), F.max_by(ends, rank).alias("last")).collect()]
    known = _borders(summary, keys)
    firsts = {s["part"]: tuple(s["first"][k] for k in keys) for s in summary}

    # Pieces that begin within the reach of earlier ranges continue a period of theirs: at most the first few of a range.
    reach = spark.createDataFrame([(p, k["reach"]) for p, k in known.items() if k["reach"] is not None], "part int, reach long")
    same_key = [F.col(f"f_{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    first_keys = T.StructType([T.StructField("part", T.IntegerType()), *[T.StructField(f"f_{i}", f.dataType) for i, f in enumerate(fields)]])
    bordered = F.broadcast(reach.join(spark.createDataFrame([(p, *f) for p, f in firsts.items()], first_keys), "part"))
    marked = pieces.join(bordered, "part", "left")
    continues = F.col("reach").isNotNull() & (F.col("from_pos") <= F.col("reach"))
    for condition in same_key:
        continues = continues & condition
    marked = marked.withColumn("continues", F.coalesce(continues, F.lit(False)))
    joined = {
        r["part"]: r.asDict(recursive=True)
        for r in marked.groupBy("part")
        .agg(F.max(F.when(F.col("continues"), F.col("to_pos"))).alias("taken_to"), F.max_by(F.when(~F.col("continues"), ends), F.when(~F.col("continues"), rank)).alias("last_own"))
        .collect()
    }
    # Walk the ranges: how far the last own piece of each reaches on, and what precedes the first own piece of each.
    reached: dict[int, int] = {}
    before: dict[int, tuple] = {}
    chain = None
    for part in sorted(joined):
        taken, own = joined[part]["taken_to"], joined[part]["last_own"]
        if taken is not None and chain is not None:
            reached[chain] = max(reached[chain], taken)
        if chain is not None:
            before[part] = (*(joined[chain]["last_own"][k] for k in keys), reached[chain])
        if own is not None:
            chain = part
            reached[part] = own["to_pos"]
    if not joined:
        return spark.createDataFrame([], T.StructType([*fields, T.StructField("kind", T.StringType()), *place]))

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        previous = None
        for batch in batches:
            batch = batch[~batch["continues"]].reset_index(drop=True)
            if not len(batch):
                continue
            part = int(batch["part"].iloc[0])
            last = joined[part]["last_own"]
            group = _runs(batch, keys)
            own_to = batch["to_pos"].to_numpy(np.int64).copy()
            tail = batch.iloc[-1]
            if tail["from_pos"] == last["from_pos"] and all(_same(tail[k], last[k]) for k in keys):
                own_to[-1] = reached[part]
            lead = before.get(part) if previous is None else previous
            low = batch["from_pos"].to_numpy(np.int64)
            gap_from = np.empty(len(batch), np.int64)
            gap_from[1:] = own_to[:-1]
            has = np.zeros(len(batch), bool)
            has[1:] = group[1:] == group[:-1]
            if lead is not None and all(_same(a, batch[k].iloc[0]) for a, k in zip(lead, keys, strict=False)):
                has[0], gap_from[0] = True, lead[-1]
            out = batch[keys].assign(kind="period", from_pos=low, to_pos=own_to)
            gaps = batch.loc[has, keys].assign(kind="gap", from_pos=gap_from[has], to_pos=low[has])
            previous = (*(batch[k].iloc[-1] for k in keys), int(own_to[-1]))
            yield pd.concat([out, gaps], ignore_index=True)

    return marked.select(*keys, "from_pos", "to_pos", "part", "continues").mapInPandas(finished, T.StructType([*fields, T.StructField("kind", T.StringType()), *place]))


def _same(a: object, b: object) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))
