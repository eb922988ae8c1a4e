"""Operators on notes: pitches brought into range, syllables in sixteenths, scores, corrections of timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.windows import rolling_median


def fold_octaves(df: DataFrame, keys: list[str], order: list[str], pitch: str, *, k: int = 5, tolerance: float = 7, rounds: int = 3) -> DataFrame:
    """Pitches further than `tolerance` from the rolling median of their k neighbours on either side, moved by whole octaves toward it, `rounds` times over, so that a cluster of wrong ones can't hold the median."""
    for _ in range(rounds):
        df = rolling_median(df, keys, order, pitch, k, out="__near")
        off = F.col(pitch) - F.col("__near")
        df = df.withColumn(pitch, F.when(F.abs(off) > tolerance, F.col(pitch) - 12 * F.bround(off / 12)).otherwise(F.col(pitch))).drop("__near")
    return df


def fold_to_range(df: DataFrame, keys: list[str], pitch: str, *, tolerance: float = 18) -> DataFrame:
    """Pitches further than `tolerance` from their key's median, moved by whole octaves toward it."""
    middle = df.groupBy(*keys).agg(F.median(pitch).alias("__middle"))
    off = F.col(pitch) - F.col("__middle")
    return df.join(middle, keys).withColumn(pitch, F.when(F.abs(off) > tolerance, F.col(pitch) - 12 * F.bround(off / 12)).otherwise(F.col(pitch))).drop("__middle")


def pull_unsure(df: DataFrame, keys: list[str], order: list[str], pitch: str, sure: str, *, k: int = 5, below: float = 0.3, most: float = 3) -> DataFrame:
    """Pitches of which less than `below` is sure, moved halfway to the rolling median and to within `most` of it; all in whole semitones."""
    near = rolling_median(df, keys, order, pitch, k, out="__near")
    halfway = (F.col(pitch) + F.col("__near")) / 2
    pulled = F.least(F.greatest(halfway, F.col("__near") - most), F.col("__near") + most)
    return near.withColumn(pitch, F.bround(F.when(F.col(sure) < below, pulled).otherwise(F.col(pitch)))).drop("__near")


def pitch_window(start: Column, end: Column, least: float) -> tuple[Column, Column]:
    """A note's stretch, widened around its middle to at least `least`, never before 0."""
    extra = (least - (end - start)) / 2
    return F.when(end - start >= least, start).otherwise(F.greatest(F.lit(0.0), start - extra)), F.when(end - start >= least, end).otherwise(end + extra)


def sixteenths(df: DataFrame, keys: list[str], start: str, end: str, word: str, size: float) -> DataFrame:
    """Syllables longer than a sixteenth (`size` seconds) cut into it: the keys, piece from 0, start, end, word, is_word_end.

    The first piece has the word, the others `~`. What is left at the end is a
    piece of its own from half a sixteenth on, else it goes to the last piece.
    A blank at the word's end goes to the last piece. Starts of further pieces
    are rounded to as many decimals as the size has when written out.
    """
    places = len(repr(float(size)).split(".")[1])
    whole = F.floor((F.col(end) - F.col(start) - size) / size)
    rest = (F.col(end) - F.col(start) - size) - whole * size
    long = F.col(end) - F.col(start) > size
    pieces = F.when(long, whole + F.when(rest >= size / 2, 1).otherwise(0)).otherwise(0).cast("int")
    each = df.select("*", pieces.alias("__last"), whole.alias("__whole"), rest.alias("__rest"), long.alias("__long")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("__last"))))
    own_rest = F.col("__rest") >= size / 2
    begin = F.when(F.col("piece") == 0, F.col(start)).otherwise(F.col(start) + size + F.round((F.col("piece") - 1) * size, places))
    length = F.when(own_rest & (F.col("piece") == F.col("__last")) & (F.col("piece") > 0), F.col("__rest")).otherwise(F.lit(size) + F.when(~own_rest & (F.col("piece") == F.col("__last")), F.col("__rest")).otherwise(0.0))
    blank, final = F.col(word).endswith(" "), F.col("piece") == F.col("__last")
    text = F.when(F.col("piece") > 0, "~").when(blank, F.expr(f"left(`{word}`, char_length(`{word}`) - 1)")).otherwise(F.col(word))
    text = F.when(blank & final, F.concat(text, F.lit(" "))).otherwise(text)
    return each.select(
        *keys, "piece", F.when(F.col("__long"), begin).otherwise(F.col(start)).alias("piece_start"), F.when(F.col("__long"), begin + length).otherwise(F.col(end)).alias("piece_end"),
        F.when(F.col("__long"), text).otherwise(F.col(word)).alias("word"), (blank & final).alias("is_word_end"),
    )


def score(parts: DataFrame, keys: list[str], note: str, *, kind: str, hit: str, notes: DataFrame) -> DataFrame:
    """(keys, notes, golden, line_bonus, score): points of sung parts of notes.

    parts: a row for each part of a note, whether it was hit; notes: the keys
    and how many note rows a song has (`n`). A normal or rap part (`:`, `R`)
    counts one, a golden one (`*`, `G`) two, unscaled. A note hit in all its
    parts earns its share of 1,000 points of bonus; with a bonus the parts
    share 9,000 points, else 10,000. All rounded half to even.
    """
    each = parts.groupBy(*keys, note, kind).agg(F.count(F.lit(1)).alias("parts"), F.count_if(hit).alias("hits"))
    sums = each.groupBy(*keys).agg(
        F.sum("parts").alias("parts"), F.sum(F.when(F.col(kind).isin(":", "R"), F.col("hits")).otherwise(0)).alias("plain"), F.sum(F.when(F.col(kind).isin("*", "G"), 2 * F.col("hits")).otherwise(0)).alias("golden"), F.count_if(F.col("hits") == F.col("parts")).alias("full")
    )
    bonus = F.col("full") * 1000.0 / F.col("n")
    shared = F.bround(F.when(F.col("full") > 0, 9000).otherwise(10000) * F.col("plain") / F.col("parts")).cast("long")
    return sums.join(notes, keys).select(*keys, shared.alias("notes"), F.col("golden").cast("long").alias("golden"), F.bround(bonus).cast("long").alias("line_bonus"), F.bround(shared + bonus + F.col("golden")).cast("long").alias("score"))


def correction(fit: DataFrame, keys: list[str], gap_ms: Column, bpm: Column, *, least_agree: float = 0.8, least_drift_s: float = 0.2) -> DataFrame:
    """(keys, offset_s, drift_s, gap_ms, bpm): what puts notes where they are sung, for fits of which `least_agree` agrees.

    fit: slope, intercept, first and last point and the median offset. A drift
    below `least_drift_s` only moves the gap by the median offset, a larger one
    moves the gap along the line and changes the tempo.
    """
    drift = (F.col("slope") - 1) * (F.col("last") - F.col("first"))
    small = F.abs(drift) < least_drift_s
    return fit.where(F.col("agree") >= least_agree).select(
        *keys, (F.col("intercept") + (F.col("slope") - 1) * F.col("first")).alias("offset_s"), drift.alias("drift_s"),
        F.when(small, gap_ms + 1000 * F.col("median_offset")).otherwise(1000 * (F.col("intercept") + F.col("slope") * gap_ms / 1000)).alias("gap_ms"), F.when(small, bpm).otherwise(bpm / F.col("slope")).alias("bpm"),
    )


def merge_syllables(df: DataFrame, keys: list[str], order: list[str], note: str, word: str, start: str, end: str, *, sixteenth: float, slide: float = 2) -> DataFrame:
    """(keys, island, start, end, note, word): held and slid syllables merged into the one before.

    A syllable joins the one before it if that doesn't end a word (no blank at
    its end) and they have the same pitch, or pitches at most `slide` apart
    while the one before lasts at most two sixteenths. A pause of a sixteenth
    or more parts them. A merged note has the pitch of the note before its
    last slide, else of its first; its word is the parts' without `~`.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    before = lambda c: F.lag(c).over(w)
    same = F.col(note) == before(note)
    slid = ~same & (F.abs(F.col(note) - before(note)) <= slide) & (before(end) - before(start) <= 2 * sixteenth)
    joins = F.coalesce(~before(word).endswith(" ") & (F.col(start) - before(end) < sixteenth) & (same | slid), F.lit(False))
    marked = df.withColumn("__slid", F.when(joins & slid, before(note))).withColumn("__joins", joins)
    numbered = marked.withColumn("island", F.sum(F.when(F.col("__joins"), 0).otherwise(1)).over(w)).withColumn("__i", F.row_number().over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("__i", word))), lambda x: F.rtrim(F.regexp_replace(x[word], "~", "")))
    return numbered.groupBy(*keys, "island").agg(
        F.min(start).alias("start"), F.max_by(end, "__i").alias("end"), F.coalesce(F.max_by("__slid", F.when(F.col("__slid").isNotNull(), F.col("__i"))), F.min_by(note, "__i")).alias("note"),
        F.concat(F.array_join(parts, ""), F.when(F.max_by(word, "__i").endswith(" "), " ").otherwise("")).alias("word"),
    )
