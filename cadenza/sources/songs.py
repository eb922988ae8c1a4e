"""Song files: lines, header tags, notes, lyric lines, edits of the header, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

import pandas as pd

TAG = r"^#([^:]*):(.*)$"
NOTE = r"^([:*FRG])\s+(-?\d+(?:[.,]\d+)?)\s+(-?\d+(?:[.,]\d+)?)\s+(-?\d+)(?: (.*))?$"


@F.pandas_udf(T.StringType())
def decode_text(raw: pd.Series) -> pd.Series:
    """Bytes as text: UTF-8 with or without a byte order mark, else the Western code page, else bytes as they are."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        for encoding in ("utf-8-sig", "cp1252"):
            try:
                return bytes(b).decode(encoding)
            except UnicodeDecodeError:
                pass
        return bytes(b).decode("latin-1")

    return pd.Series([one(b) for b in raw], dtype=object)


def is_song(text: Column) -> Column:
    """Whether a text has a title and an artist tag with something in them."""
    return text.rlike(r"(?im)^[\s\x{FEFF}]*#TITLE[ \t]*:[ \t]*\S") & text.rlike(r"(?im)^[\s\x{FEFF}]*#ARTIST[ \t]*:[ \t]*\S")


def read_library(spark: SparkSession, folder: str, *, admin: tuple[str, ...] = ()) -> DataFrame:
    """(path, text) of every .txt below a folder that is a song, in the order of their paths; files named as in `admin` are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(folder)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    texts = files.where(~name.isin(*[a.lower() for a in admin]) if admin else F.lit(True)).select("path", decode_text("content").alias("text"))
    return texts.where(is_song(F.col("text"))).orderBy("path")


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, line) without line ends and byte order mark. Null texts give no rows."""
    clean = F.regexp_replace(F.col(text), r"^\x{FEFF}", "")
    split = df.select(key, F.posexplode(F.split(clean, r"\r\n|\n|\r", -1)).alias("line_no", "line"))
    return split.select(key, (F.col("line_no") + 1).alias("line_no"), "line")


def all_tags(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tag, value, line_no): header lines split at the first colon, names in capitals, values trimmed."""
    tag = F.upper(F.trim(F.regexp_extract("line", TAG, 1)))
    found = lines(df, key, text).where(F.col("line").rlike(TAG))
    return found.select(key, tag.alias("tag"), F.trim(F.regexp_extract("line", TAG, 2)).alias("value"), "line_no").where("tag <> ''")


def tags(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tag, value): the first value of each tag."""
    return all_tags(df, key, text).groupBy(key, "tag").agg(F.min_by("value", "line_no").alias("value"))


def decimal(x: Column) -> Column:
    return F.replace(x, F.lit(","), F.lit(".")).try_cast("double")


def read_notes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, part, lyric_line, type, beat, length, pitch, word): blanks in words are kept, decimals may have a comma.

    part: the last P1 or P2 line before, null in solo songs; lyric_line: how
    many line breaks came before.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = lines(df, key, text).withColumn("part", F.last(F.when(F.col("line").rlike(r"^P\s?[12]\s*$"), F.concat(F.lit("P"), F.regexp_extract("line", r"([12])", 1))), ignorenulls=True).over(so_far))
    marked = marked.withColumn("lyric_line", F.sum(F.when(F.col("line").rlike(r"^-"), 1).otherwise(0)).over(so_far))
    part = lambda i: F.regexp_extract("line", NOTE, i)
    return marked.where(F.col("line").rlike(NOTE)).select(
        key, "line_no", "part", "lyric_line", part(1).alias("type"), decimal(part(2)).alias("beat"), decimal(part(3)).alias("length"), part(4).cast("int").alias("pitch"), part(5).alias("word")
    )


def timed_notes(notes: DataFrame, headers: DataFrame, key: str) -> DataFrame:
    """Notes with start_s and end_s from their song's BPM and GAP tags (a missing gap is 0; without BPM null)."""
    wide = headers.groupBy(key).agg(
        F.max(F.when(F.col("tag") == "BPM", decimal(F.col("value")))).alias("bpm"), F.coalesce(F.max(F.when(F.col("tag") == "GAP", decimal(F.col("value")))), F.lit(0.0)).alias("gap")
    )
    at = lambda beat: F.when(F.col("bpm") > 0, F.col("gap") / 1000 + beat * 60 / (4 * F.col("bpm")))
    return notes.join(wide, key, "left").select(*notes.columns, at(F.col("beat")).alias("start_s"), at(F.col("beat") + F.col("length")).alias("end_s"))


def lyric_lines(notes: DataFrame, key: str) -> DataFrame:
    """(key, part, lyric_line, text, notes): sung words joined in order, held syllables left out, blanks collapsed."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "word"))), lambda x: F.regexp_replace(x["word"], "~", ""))
    each = notes.groupBy(key, "part", "lyric_line").agg(F.trim(F.regexp_replace(F.array_join(words, ""), r"\s+", " ")).alias("text"), F.count(F.lit(1)).alias("notes"))
    return each


def set_tag(text: Column, tag: str, value: str | None) -> Column:
    """The text with the first line of a tag replaced, later ones dropped; without one, added before the first line that is no tag; value None removes it."""
    joined = lambda x: F.when(text.contains("\r\n"), F.array_join(x, "\r\n")).otherwise(F.array_join(x, "\n"))
    all_lines = F.split(text, r"\r\n|\n", -1)
    is_it = lambda x: F.upper(x).rlike(f"^\\x{{FEFF}}?#{tag.upper()}:")
    first = F.array_min(F.filter(F.transform(all_lines, lambda x, i: F.when(is_it(x), i)), lambda i: i.isNotNull()))
    if value is None:
        return joined(F.filter(all_lines, lambda x: ~is_it(x)))
    new = F.lit(f"#{tag.upper()}:{value}")
    replaced = F.filter(F.transform(all_lines, lambda x, i: F.when(is_it(x) & (i == first), new).when(~is_it(x), x)), lambda x: x.isNotNull())
    header = F.coalesce(F.array_min(F.filter(F.transform(all_lines, lambda x, i: F.when(~x.rlike(r"^\x{FEFF}?#"), i)), lambda i: i.isNotNull())), F.size(all_lines))
    added = F.flatten(F.array(F.filter(all_lines, lambda x, i: i < header), F.array(new), F.filter(all_lines, lambda x, i: i >= header)))
    return joined(F.when(first.isNotNull(), replaced).otherwise(added))


def write_text(headers: DataFrame, notes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, text): tags in the given order, then each part's notes (after a line P1 or P2 in duets), then E.

    A break after each lyric line but a part's last bears the beat at which
    the line's last note ends. Read back, the notes are the same.
    """
    place = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in order]), F.col("tag")), F.lit(0))
    place = F.when(place == 0, len(order) + 1).otherwise(place)
    head = headers.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), "tag", "value"))), lambda x: F.concat(F.lit("#"), x["tag"], F.lit(":"), x["value"])), "\n").alias("head"))
    number = lambda c: F.col(c).cast("long").cast("string")
    row = F.concat_ws(" ", "type", number("beat"), number("length"), F.col("pitch").cast("string"), "word")
    part = F.coalesce("part", F.lit(""))
    lyric = notes.groupBy(key, part.alias("part"), "lyric_line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", row.alias("r")))), lambda x: x["r"]), "\n").alias("body"), F.max(F.col("beat") + F.col("length")).cast("long").cast("string").alias("until")
    )
    broken = lambda x, i: F.when(i < F.size("of") - 1, F.concat(x["body"], F.lit("\n- "), x["until"])).otherwise(x["body"])
    parts = lyric.groupBy(key, "part").agg(F.array_sort(F.collect_list(F.struct("lyric_line", "body", "until"))).alias("of"))
    parts = parts.select(key, "part", F.concat(F.when(F.col("part") != "", F.concat("part", F.lit("\n"))).otherwise(""), F.array_join(F.transform("of", broken), "\n")).alias("body"))
    body = parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "body"))), lambda x: x["body"]), "\n").alias("body"))
    return head.join(body, key, "left").select(key, F.concat(F.col("head"), F.lit("\n"), F.coalesce(F.concat(F.col("body"), F.lit("\n")), F.lit("")), F.lit("E\n")).alias("text"))


def replace_pitch(line: Column, pitch: Column) -> Column:
    """A note line with another pitch, blanks kept."""
    return F.when(line.rlike(r"^[:*FRG]\s"), F.concat(F.regexp_extract(line, r"^([:*FRG]\s+\S+\s+\S+\s+)-?\d+", 1), pitch.cast("string"), F.regexp_extract(line, r"^[:*FRG]\s+\S+\s+\S+\s+-?\d+(.*)$", 1))).otherwise(line)
