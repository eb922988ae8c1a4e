"""Songs in two parts: lines of each part, shared lines, overlaps, who sings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.sources.headers import tag_of
from cadenza.sources.songs import NOTE, all_tags, decimal, lines


def song_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, kind, raw): every line of a text as it is, `header`, `note`, `break`, `part`, `end`, `blank` or `other`. Joined in order they are the text again, but for its line ends and byte order mark."""
    x = F.col("line")
    kind = (
        F.when(x.rlike(NOTE), "note")
        .when(F.trim(x).startswith("#"), "header")
        .when(x.rlike(r"^P\s*[12]\s*$"), "part")
        .when(F.ltrim(x).startswith("-"), "break")
        .when(F.trim(x).rlike(r"^E(?: .*)?$"), "end")
        .when(F.trim(x) == "", "blank")
        .otherwise("other")
    )
    return lines(df, key, text).select(key, "line_no", kind.alias("kind"), x.alias("raw"))


def part_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, part, lyric_line, start, until, text, notes, back_in_time) of songs up to their end line.

    Notes before a mark are P1's; a break or a mark ends a line; lines of a
    part are numbered from 1. back_in_time: notes that begin before the one
    before them in the line.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    read = song_lines(df, key, text).withColumn("ended", F.max((F.col("kind") == "end").cast("int")).over(so_far)).where("ended = 0")
    marked = read.withColumn("part", F.coalesce(F.last(F.when(F.col("kind") == "part", F.concat(F.lit("P"), F.regexp_extract("raw", r"([12])", 1))), ignorenulls=True).over(so_far), F.lit("P1")))
    marked = marked.withColumn("stretch", F.sum(F.col("kind").isin("part", "break").cast("int")).over(so_far))
    cell = lambda i: F.regexp_extract("raw", NOTE, i)
    notes = marked.where("kind = 'note'").select(key, "line_no", "part", "stretch", decimal(cell(2)).alias("beat"), decimal(cell(3)).alias("length"), cell(5).alias("word"))
    notes = notes.withColumn("back", F.col("beat") < F.lag("beat").over(Window.partitionBy(key, "part", "stretch").orderBy("line_no")))
    of = notes.groupBy(key, "part", "stretch").agg(
        F.min_by("beat", "line_no").alias("start"), F.max(F.col("beat") + F.col("length")).alias("until"), F.count(F.lit(1)).alias("notes"), F.count_if("back").alias("back_in_time"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "word"))), lambda x: x["word"]), "").alias("joined"),
    )
    number = F.row_number().over(Window.partitionBy(key, "part").orderBy("stretch"))
    return of.select(key, "part", number.alias("lyric_line"), "start", "until", F.trim(F.regexp_replace("joined", r"[\s~]+", " ")).alias("text"), "notes", "back_in_time")


def duets(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, p1_lines, p2_lines, problems, name_form, error): what a text is as a duet; error: `relative`, or the part without lines."""
    counted = part_lines(df, key, text).groupBy(key).agg(F.count_if(F.col("part") == "P1").alias("p1_lines"), F.count_if(F.col("part") == "P2").alias("p2_lines"), F.sum("back_in_time").alias("problems"))
    tag = all_tags(df, key, text).groupBy(key).agg(
        F.max(F.col("tag").isin("P1", "P2")).alias("p"), F.max(F.col("tag").isin("DUETSINGERP1", "DUETSINGERP2")).alias("d"), F.min_by(F.when(F.col("tag") == "RELATIVE", F.lower("value")), F.when(F.col("tag") == "RELATIVE", F.col("line_no"))).alias("relative")
    )
    all_songs = df.where(F.col(text).isNotNull()).select(key).join(counted, key, "left").join(tag, key, "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    error = F.when(F.col("relative") == "yes", "relative").when(n("p1_lines") == 0, "P1").when(n("p2_lines") == 0, "P2")
    return all_songs.select(key, n("p1_lines").alias("p1_lines"), n("p2_lines").alias("p2_lines"), n("problems").alias("problems"), F.when(F.col("p"), "P").when(F.col("d"), "DUETSINGERP").alias("name_form"), error.alias("error"))


def timeline(of: DataFrame, key: str) -> DataFrame:
    """(key, start, until, text, singers): every line once, in both parts if they have a line of the same start and text; repeated ones pair in order."""
    same = Window.partitionBy(key, "part", "start", "text").orderBy("lyric_line")
    numbered = of.withColumn("twin", F.row_number().over(same))
    both = numbered.groupBy(key, "start", "text", "twin").agg(F.max("until").alias("until"), F.array_join(F.array_sort(F.collect_set("part")), "").alias("singers"))
    return both.select(key, "start", "until", "text", "singers")


def overlapping(of: DataFrame, key: str, *, share: float = 0.25) -> DataFrame:
    """(key, start, until, singers, partner_start, partner_until): solo lines left out for one of the other singer that they overlap by more than `share` of the shorter; the longer stay, of equally long ones the earlier.

    Songs have some hundred lines; each is worked on in one task.
    """
    kind = of.schema[key].dataType.simpleString()

    def one(group: pd.DataFrame) -> pd.DataFrame:
        kept, out = [], []
        solo = group[group["singers"].isin(["P1", "P2"])].assign(size=lambda g: g["until"] - g["start"]).sort_values(["size", "start", "singers"], ascending=[False, True, True])
        for line in solo.itertuples():
            met = [(min(line.until, o.until) - max(line.start, o.start), o) for o in kept if o.singers != line.singers]
            met = [(x, o) for x, o in met if x > 0 and x / max(1e-9, min(line.size, o.size)) > share]
            if met:
                partner = max(met, key=lambda m: m[0])[1]
                out.append((group[key].iloc[0], line.start, line.until, line.singers, partner.start, partner.until))
            else:
                kept.append(line)
        return pd.DataFrame(out, columns=[key, "start", "until", "singers", "partner_start", "partner_until"])

    return of.select(key, "start", "until", "singers").groupBy(key).applyInPandas(one, f"`{key}` {kind}, start double, until double, singers string, partner_start double, partner_until double")


def with_singers(header: Column, first: Column, second: Column) -> Column:
    """Header lines with the singers' names in the tags that they use, P1 and P2 before DUETSINGERP1 and 2; as P1 and P2 at the end of a header without either."""
    used = lambda *tags: F.exists(header, lambda x: tag_of(x).isin(*tags))

    def named(one: str, two: str) -> Column:
        return F.transform(header, lambda x: F.when(tag_of(x) == one, F.concat(F.lit(f"#{one}:"), first)).when(tag_of(x) == two, F.concat(F.lit(f"#{two}:"), second)).otherwise(x))

    added = F.concat(header, F.array(F.concat(F.lit("#P1:"), first), F.concat(F.lit("#P2:"), second)))
    return F.when(used("P1", "P2"), named("P1", "P2")).when(used("DUETSINGERP1", "DUETSINGERP2"), named("DUETSINGERP1", "DUETSINGERP2")).otherwise(added)


def artist_pair(artist: Column) -> Column:
    """The two names of an artist field that holds just two, else null."""
    names = F.filter(F.transform(F.split(artist, r"(?i)\s*(?:,|&|\+|/|\bfeat\.?|\bft\.?|\band\b|\bund\b|\bmit\b|\bwith\b)\s*"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(names) == 2, names)


MARK = r"(?i)^\s*(P\s*[12](?:\s*\+\s*P\s*[12])?)\s*:\s*"


def singer_mark(line: Column) -> tuple[Column, Column]:
    """Who a lyric line marked `P1:`, `P2:` or `P1+P2:` belongs to (P1, P2, both; null without a mark), and the line without the mark."""
    mark = F.upper(F.regexp_replace(F.regexp_extract(line, MARK, 1), r"\s", ""))
    return F.when(mark.contains("+"), "both").when(mark != "", mark), F.when(mark != "", F.regexp_replace(line, MARK, "")).otherwise(line)


#: Words that name a section and no singer. Fixed values.
SECTION_WORDS = "verse chorus pre-chorus prechorus post-chorus postchorus bridge intro outro hook refrain interlude skit breakdown instrumental part strophe spoken drop segue coda break vamp rap solo chant ad-libs produced zwischenspiel".split()


def header_singers(inside: Column) -> Column:
    """The names in a section header's text: behind its colon, or all of it if it begins with no word for a section."""
    first = F.regexp_replace(F.lower(F.get(F.split(F.trim(inside), r"\s+"), 0)), r"[0-9:]+$", "")
    part = F.when(inside.contains(":"), F.regexp_extract(inside, r"^[^:]*:(?s:(.*))$", 1)).when(~first.isin(SECTION_WORDS), inside).otherwise("")
    names = F.split(F.translate(part, "()", ",,"), r"(?i)\s*(?:,|&|\+|/|\band\b|\bwith\b|\bfeat\.?|\bft\.?)\s*")
    return F.filter(F.transform(names, lambda n: F.regexp_replace(n, r"^[ .]+|[ .]+$", "")), lambda n: n != "")


def sung_by(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line, singer) of the lines under section headers: the header's singer if it names just one (not `Both`), null else."""
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(F.trim("line").rlike(r"^\[[^\[\]]*\]$") & ~F.trim("line").rlike(r"^\[\d+:\d+"), header_singers(F.regexp_extract(F.trim("line"), r"^\[([^\[\]]*)\]$", 1)))
    marked = lines(df, key, text).withColumn("own", header).withColumn("names", F.last("own", ignorenulls=True).over(so_far))
    singer = F.when((F.size("names") == 1) & (F.lower(F.get("names", 0)) != "both"), F.get("names", 0))
    return marked.where(F.col("own").isNull() & (F.trim("line") != "")).select(key, "line_no", "line", singer.alias("singer"))
