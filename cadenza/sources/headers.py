"""Headers of song files as whole texts: flags, version upgrades, play ranges, comments, byte-exact edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.scalars import plain_number
from cadenza.sources.songs import NOTE, all_tags, decimal, lines, set_tag

#: The version that upgraded headers bear, and tags that it has no place for. Fixed values.
VERSION = "1.2.0"
UNVERSIONABLE = ["DUETSINGERP1", "DUETSINGERP2", "NOTESGAP"]


def header_flags(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tags, notes, duet, relative): the first value of each tag as a map, how many note rows there are, whether parts or singers are marked, and whether beats are relative."""
    tags = all_tags(df, key, text).groupBy(key, "tag").agg(F.min_by("value", "line_no").alias("value")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "value")))).alias("tags"))
    body = lines(df, key, text).groupBy(key).agg(F.count_if(F.col("line").rlike(NOTE)).alias("notes"), F.max(F.col("line").rlike(r"^P\s*\d")).alias("marked"))
    both = body.join(tags, key, "left")
    named = F.coalesce(F.map_contains_key("tags", "DUETSINGERP1") | F.map_contains_key("tags", "P1"), F.lit(False))
    return both.select(key, "tags", "notes", (F.col("marked") | named).alias("duet"), F.coalesce(F.lower(F.col("tags")["RELATIVE"]) == "yes", F.lit(False)).alias("relative"))


def split_header(text: Column) -> tuple[Column, Column, Column, Column]:
    """A text's byte order mark, its lines that begin with # at the top, the rest, and its line end."""
    bom = F.when(text.startswith("﻿"), "﻿").otherwise("")
    all_lines = F.split(F.regexp_replace(text, r"^\x{FEFF}", ""), r"\r\n|\n", -1)
    end = F.when(text.contains("\r\n"), "\r\n").otherwise("\n")
    size = F.coalesce(F.array_min(F.filter(F.transform(all_lines, lambda x, i: F.when(~F.ltrim(x).startswith("#"), i)), lambda i: i.isNotNull())), F.size(all_lines))
    return bom, F.slice(all_lines, 1, size), F.slice(all_lines, size + 1, F.greatest(F.size(all_lines), F.lit(1))), end


def tag_of(line: Column) -> Column:
    return F.upper(F.trim(F.regexp_extract(line, r"^\s*#([^:]*):", 1)))


def value_of(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, r"^\s*#[^:]*:(.*)$", 1))


def first_value(header: Column, tag: str) -> Column:
    """The first value of a tag that isn't blank, null without one."""
    return F.get(F.transform(F.filter(header, lambda x: (tag_of(x) == tag) & (value_of(x) != "")), value_of), 0)


def versioned(text: Column) -> tuple[Column, Column]:
    """A text with its header upgraded, and why it isn't (null: it is, or has a version, or no header).

    The version comes first, RELATIVE and ENCODING go, a file named by MP3
    alone is named by AUDIO too. Relative beats, other encodings than UTF-8
    and tags without place keep a header as it is.
    """
    bom, header, rest, end = split_header(text)
    encoding = first_value(header, "ENCODING")
    reason = F.when(F.lower(first_value(header, "RELATIVE")) == "yes", F.concat(F.lit("#RELATIVE:"), first_value(header, "RELATIVE")))
    reason = reason.when(F.replace(F.upper(encoding), F.lit("-"), F.lit("")) != "UTF8", F.concat(F.lit("#ENCODING:"), encoding))
    for tag in UNVERSIONABLE:
        reason = reason.when(first_value(header, tag).isNotNull(), F.lit(f"#{tag}"))
    mirrored = lambda x: F.when((tag_of(x) == "MP3") & (value_of(x) != "") & first_value(header, "AUDIO").isNull(), F.array(x, F.concat(F.lit("#AUDIO:"), value_of(x)))).otherwise(F.array(x))
    new = F.flatten(F.transform(F.filter(header, lambda x: ~tag_of(x).isin("RELATIVE", "ENCODING")), mirrored))
    upgraded = F.concat(bom, F.array_join(F.flatten(F.array(F.array(F.lit(f"#VERSION:{VERSION}")), new, rest)), "\n"))
    upgraded = F.when(text.contains("\r\n"), F.regexp_replace(upgraded, "\n", "\r\n")).otherwise(upgraded)
    keep = first_value(header, "VERSION").isNotNull() | (F.size(header) == 0)
    why = F.when(~keep, reason)
    return F.when(keep | why.isNotNull(), text).otherwise(upgraded), why


def moved_play_range(line: Column, delta_ms: Column, first_note_s: Column, last_end_s: Column, *, lead_s: float = 3.0) -> Column:
    """A header line with START (seconds) or END (ms) moved with the gap; null where it is dropped: a START below 0 or within `lead_s` of the first note, an END before the last note ends."""
    tag, value = tag_of(line), decimal(value_of(line))
    start, end = value + delta_ms / 1000, value + delta_ms
    moved_start = F.when((start >= 0) & (start <= first_note_s - lead_s), F.concat(F.lit("#START:"), plain_number(start, 3)))
    moved_end = F.when(end >= last_end_s * 1000, F.concat(F.lit("#END:"), F.bround(end).cast("long").cast("string")))
    return F.when((tag == "START") & (value != 0), moved_start).when((tag == "END") & value.isNotNull(), moved_end).otherwise(line)


def with_comment(text: Column, note: Column) -> Column:
    """A text with `note` behind its first COMMENT tag, or as a COMMENT of its own before the first note."""
    all_lines = F.split(text, "\n", -1)
    place = lambda hit: F.array_min(F.filter(F.transform(all_lines, lambda x, i: F.when(hit(x), i)), lambda i: i.isNotNull()))
    note_at, comment_at = place(lambda x: x.rlike(r"^[:*FRG] ")), place(lambda x: x.startswith("#COMMENT:"))
    behind = F.transform(all_lines, lambda x, i: F.when(i == comment_at, F.concat(x, F.lit(" | "), note)).otherwise(x))
    before = F.flatten(F.array(F.filter(all_lines, lambda x, i: i < note_at), F.array(F.concat(F.lit("#COMMENT:"), note)), F.filter(all_lines, lambda x, i: i >= note_at)))
    first = comment_at.isNotNull() & (note_at.isNull() | (comment_at < note_at))
    return F.array_join(F.when(first, behind).when(note_at.isNotNull(), before).otherwise(all_lines), "\n")


def genre_in_bytes(content: Column, genre: str | None) -> Column:
    """A file's bytes with another GENRE tag (None: without), all other bytes as they are in whatever encoding."""
    as_characters = F.decode(content, "ISO-8859-1")  # a character for each byte
    value = None if genre is None else genre.encode().decode("latin-1")
    bom = "\xef\xbb\xbf"
    bare = F.when(as_characters.startswith(bom), F.substring(as_characters, 4, 1 << 30)).otherwise(as_characters)
    return F.encode(F.concat(F.when(as_characters.startswith(bom), bom).otherwise(""), set_tag(bare, "GENRE", value)), "ISO-8859-1")


def genre_of_bytes(content: Column) -> Column:
    """The GENRE tag of a file's bytes, which are read as UTF-8."""
    return F.nullif(F.trim(F.regexp_extract(F.decode(content, "UTF-8"), r"(?im)^\x{FEFF}?#GENRE:([^\r\n]*)", 1)), F.lit(""))
