"""Other line-oriented inputs: timed lyrics, plain lyrics, want lists, anchors, logs, mounts, append-only results."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import key_values, parse_clock
from cadenza.operators.windows import newest
from cadenza.sources.songs import lines

STAMP = r"^\s*\[(\d+):(\d+)(?:[.:](\d+))?\](.*)$"
#: Lines that name who made a song: Chinese credits also without a colon, English ones only with one. Fixed values.
CREDIT = r"(?i)^(?:(?:作词|作曲|编曲|制作人|混音|母带)(?:\s*[:：]|\s)|(?:lyrics?\s*by|lyricist|composer|arranger|producer|mixed\s*by|mastered\s*by)\s*[:：])"
#: A line all in round brackets is a backing voice.
BACKING = r"^\([^()]*\)$"
#: How often a section comes, in its mark or behind it.
TIMES = r"(?:[x×]\s*\d+|\d+\s*[x×])"
SECTION = rf"(?i)^\[\s*([^\[\]]+?)(?:\s+{TIMES})?\s*\](?:\s*(?:{TIMES}|\[\s*{TIMES}\s*\]|\(\s*{TIMES}\s*\)))?$"


def read_timed_lyrics(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, start_s, line) of `[mm:ss.xx]line` texts; fractions count by their digits; tags, credits, blanks and lines all in brackets are left out."""
    part = lambda i: F.regexp_extract("line", STAMP, i)
    fraction = F.when(part(3) != "", part(3).cast("double") / F.pow(F.lit(10.0), F.length(part(3)))).otherwise(0.0)
    found = lines(df, key, text).where(F.col("line").rlike(STAMP))
    timed = found.select(key, "line_no", (part(1).cast("double") * 60 + part(2).cast("double") + fraction).alias("start_s"), F.trim(part(4)).alias("line"))
    return timed.where((F.col("line") != "") & ~F.col("line").rlike(CREDIT) & ~F.col("line").rlike(BACKING))


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_no, mark, line_no, line): the lines by the section mark before them; no mark (section 0) before the first. Marks are compared in lower case, without how often a section comes."""
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.trim("line").rlike(SECTION), F.lower(F.trim(F.regexp_extract(F.trim("line"), SECTION, 1))))
    marked = lines(df, key, text).withColumn("own", mark).withColumn("section_no", F.count("own").over(so_far)).withColumn("mark", F.last("own", ignorenulls=True).over(so_far))
    return marked.select(key, "section_no", "mark", "line_no", F.when(F.col("own").isNull(), F.col("line")).alias("line"))


def read_plain_lyrics(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_no, mark, line_no, line) of the sung lines.

    Section marks go. A section with nothing but its mark stands for the first
    one of that mark with lines, if that comes before; its lines keep their
    line_no. Stamps at a line's start, credits, lines all in round brackets
    and blanks are left out.
    """
    of = sections(df, key, text)
    size = of.groupBy(key, "section_no", "mark").agg(F.count_if(F.trim("line") != "").alias("n"))
    first = size.where("n > 0 and mark is not null").groupBy(key, "mark").agg(F.min("section_no").alias("source"))
    stands = size.join(first, [key, "mark"], "left")
    source = F.when(F.col("n") > 0, F.col("section_no")).when(F.col("source") < F.col("section_no"), F.col("source"))
    stands = stands.select(key, "section_no", "mark", source.alias("source")).where("source is not null")
    held = of.where("line is not null").select(key, F.col("section_no").alias("source"), "line_no", "line")
    clean = F.trim(F.regexp_replace(F.trim("line"), r"^(?:\[\d+:\d+(?:[.:]\d+)?\]\s*)+", ""))
    sung = stands.join(held, [key, "source"]).select(key, "section_no", "mark", "line_no", clean.alias("line"))
    return sung.where((F.col("line") != "") & ~F.col("line").rlike(CREDIT) & ~F.col("line").rlike(BACKING))


def read_want_list(df: DataFrame, line: str) -> DataFrame:
    """(band, title, url) of `band - title [link]` lines; without a link `skip`; blank and # lines are left out."""
    kept = df.where((F.trim(line) != "") & ~F.col(line).rlike(r"^\s*#"))
    url = F.regexp_extract(line, r"(https?://\S+)", 1)
    rest = F.trim(F.regexp_replace(line, r"https?://\S+", ""))
    parts = F.split(rest, r"\s+-\s+", 2)
    return kept.select(F.trim(F.get(parts, 0)).alias("band"), F.trim(F.coalesce(F.get(parts, 1), F.lit(""))).alias("title"), F.when(url == "", "skip").otherwise(url).alias("url"))


def delimiter_of(header: str) -> str:
    """The comma if it is as frequent as the semicolon, else that."""
    return "," if header.count(",") >= header.count(";") else ";"


def read_delimited(df: DataFrame, key: str, text: str, synonyms: dict[str, list[str]]) -> DataFrame:
    """Hand-kept lists as whole texts: (key, row_no, the columns of `synonyms`), a row for each record after the header.

    Blank and # lines before a record are left out, the header is the first
    record, and the comma separates if it is as frequent in it as the
    semicolon. Quoted cells may hold separators, quotes and line breaks.
    Columns are found by any of their names, blank cells are null, cells
    beyond the header left out. Lists are small; each is read in one task.
    """
    kinds = ", ".join(["row_no int", *[f"`{k}` string" for k in synonyms]])

    @F.pandas_udf(f"array<struct<{kinds.replace(' int', ':int').replace(' string', ':string')}>>")
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else list(_records(t, synonyms)) for t in texts], dtype=object)

    return df.select(key, F.explode(read(F.col(text))).alias("r")).select(key, "r.*")


def _records(text: str, synonyms: dict[str, list[str]]) -> Iterator[tuple]:
    kept, inside = [], False
    for line in text.removeprefix("\ufeff").splitlines(keepends=True):
        if inside or (line.strip() and not line.lstrip().startswith("#")):
            kept.append(line)
            inside ^= line.count('"') % 2 == 1
    if not kept:
        return
    rows = csv.reader(io.StringIO("".join(kept), newline=""), delimiter=delimiter_of(kept[0]))
    header = [n.strip().lower() for n in next(rows, [])]
    places = [[header.index(n) for n in (k, *more) if n in header] for k, more in synonyms.items()]
    for number, row in enumerate(rows, 1):
        yield number, *[next((v for p in of if p < len(row) and (v := row[p].strip())), None) for of in places]


def tsv_cell(x: Column) -> Column:
    """A cell as a TSV line holds it: tabs and line ends as one blank."""
    return F.regexp_replace(x, r"[\t\r\n]+", " ")


def read_genre_edits(df: DataFrame, line: str) -> DataFrame:
    """(folder, file, genres) of `folder/file<TAB>genres` lines; lines without a tab or path are left out."""
    parts = F.split(line, "\t", 2)
    path = F.replace(F.get(parts, 0), F.lit("\\"), F.lit("/"))
    return df.where(F.col(line).contains("\t")).select(F.regexp_extract(path, r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract(path, r"([^/]+)$", 1).alias("file"), F.trim(F.get(parts, 1)).alias("genres")).where("file <> ''")


def read_anchors(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, kind, at_s, text, problem): `time | text` and `end time` lines; problem: `time` for none, `order` where it doesn't rise."""
    kept = lines(df, key, text).where((F.trim("line") != "") & ~F.col("line").rlike(r"^\s*#"))
    is_end = F.col("line").rlike(r"(?i)^\s*end\s")
    stamp = F.when(is_end, F.regexp_extract("line", r"(?i)^\s*end\s+(\S+)", 1)).otherwise(F.trim(F.get(F.split("line", r"\|", 2), 0)))
    read = kept.select(key, "line_no", F.when(is_end, "end").otherwise("anchor").alias("kind"), parse_clock(stamp).alias("at_s"), F.trim(F.get(F.split("line", r"\|", 2), 1)).alias("text"))
    before = F.last("at_s", ignorenulls=True).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    return read.withColumn("problem", F.when(F.col("at_s").isNull(), "time").when(F.col("at_s") <= before, "order"))


def read_log(df: DataFrame, key: str, order: str, line: str, mark: str) -> DataFrame:
    """(key, marks, last_error): the `key=value` marks of the last line that begins with `mark`, and the last line with an error."""
    marked = F.when(F.col(line).startswith(mark), F.struct(order, line))
    error = F.when(F.col(line).rlike(r"(?i)\berror\b"), F.struct(order, line))
    last = df.groupBy(key).agg(F.max(marked).alias("m"), F.max(error).alias("e"))
    return last.select(key, key_values(F.col("m")[line]).alias("marks"), F.col("e")[line].alias("last_error"))


def read_results(df: DataFrame, file: str, text: str, schema: str, name: str) -> DataFrame:
    """The newest row of each name in append-only JSON lines: of files in the order of `file`, the last line. Lines that are no JSON object with a name are left out."""
    row = F.from_json("line", schema)
    rows = lines(df, file, text).where(F.trim("line") != "").select(F.col(file).alias("__file"), F.col("line_no").alias("__n"), row.alias("r")).select("__file", "__n", "r.*").where(F.col(name).isNotNull())
    return newest(rows, [name], ["__file", "__n"]).drop("__file", "__n")


def append_result(text: Column, row: Column) -> Column:
    """A JSON-lines text with one more line."""
    return F.concat(F.when(F.coalesce(text, F.lit("")) == "", "").when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n"))), F.to_json(row), F.lit("\n"))


def read_mounts(df: DataFrame, line: str) -> DataFrame:
    """(source, target, fs) of a mount table; octal escapes are resolved."""
    cells = F.split(line, " ")

    def unescape(x: Column) -> Column:
        for code, character in (("040", " "), ("011", "\t"), ("012", "\n"), ("134", "\\")):
            x = F.replace(x, F.lit(f"\\{code}"), F.lit(character))
        return x

    return df.where(F.size(cells) >= 3).select(unescape(F.get(cells, 0)).alias("source"), unescape(F.get(cells, 1)).alias("target"), F.get(cells, 2).alias("fs"))


def lyrics_lines(df: DataFrame, key: str, given: Column) -> DataFrame:
    """(key, n from 1, line) of arrays of lines: those that hold a letter or a digit, trimmed; n counts all."""
    each = df.select(key, F.posexplode(given).alias("n", "line"))
    return each.where(F.col("line").rlike(r"[\p{L}\p{N}]")).select(key, (F.col("n") + 1).alias("n"), F.trim("line").alias("line"))


def read_marks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, note_seq, kind, text) of `line.note<TAB>type<TAB>text` lines; other lines (band, title) are left out."""
    parts = F.split("line", "\t", -1)
    place = F.get(parts, 0)
    found = lines(df, key, text).where(place.rlike(r"^-?\d+\.-?\d+$"))
    number = lambda i: F.get(F.split(place, r"\."), i).cast("int")
    return found.select(key, number(0).alias("line_no"), number(1).alias("note_seq"), F.get(parts, 1).alias("kind"), F.coalesce(F.get(parts, 2), F.lit("")).alias("text"))


def markdown_tables(df: DataFrame, section: str, order: list[str], columns: dict[str, Column]) -> DataFrame:
    """(section, body): a Markdown table for each section, rows in order. Sections are reports of some rows each."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *columns.values()), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, cells.alias("__line")))), lambda x: x["__line"]), "\n")
    return df.groupBy(section).agg(F.concat(F.lit(head), rows).alias("body"))


def pack(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, content): each text as `key.txt` in an archive of its own, behind a README."""

    @F.pandas_udf("binary")
    def zipped(keys: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for k, v in zip(keys, values, strict=True):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as archive:
                archive.writestr("README.txt", "read me")
                archive.writestr(f"{k}.txt", (v or "").encode("utf-8", "surrogatepass"))
            out.append(held.getvalue())
        return pd.Series(out, dtype=object)

    return df.select(key, zipped(F.col(key), F.col(text)).alias("content"))


def song_of_archive(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, name, text): the first .txt of each archive that is no README; none for what is no archive."""

    @F.pandas_udf("name string, content binary")
    def first(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            try:
                with zipfile.ZipFile(io.BytesIO(v or b"")) as archive:
                    names = [n for n in archive.namelist() if n.lower().endswith(".txt") and "readme" not in n.lower()]
                    out.append((names[0], archive.read(names[0])) if names else (None, None))
            except zipfile.BadZipFile:
                out.append((None, None))
        return pd.DataFrame(out, columns=["name", "content"])

    found = df.select(key, first(F.col(content)).alias("f")).where("f.name is not null")
    decoded = F.decode("f.content", "UTF-8")
    return found.select(key, F.col("f.name").alias("name"), decoded.alias("text"))
