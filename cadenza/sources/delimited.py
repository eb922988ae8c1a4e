"""Delimited text with rows that fail to parse.

A recursive-descent grammar reads records of quoted and plain cells. After a
broken quote it resumes at the next validated record start: one that is known,
or a line from which a whole record can be read. Results are typed records and
located errors.

    text   := record (end record)*
    record := cell (SEPARATOR cell)*
    cell   := quoted | plain
    quoted := QUOTE (char | QUOTE QUOTE)* QUOTE, then SEPARATOR or end
    plain  := any characters but SEPARATOR and, in text, a line break
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a loaded value must not hold: the replacement character, delete, and controls other than tab and line breaks.
BAD_CHARACTER = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\ufffd]"


class QuoteError(ValueError):
    """A quoted cell that isn't closed, or is followed by something else."""

    def __init__(self, at: int):
        super().__init__(at)
        self.at = at


@dataclass
class Outcome:
    """A record of the text, or the error that took its place."""

    start: int
    end: int
    cells: list[str] | None
    reason: str | None
    error_at: int | None


class Grammar:
    """The grammar over one text.

    starts: where records are known to begin, each but the first after a line
    break; a record then ends before the next of them and line breaks in it
    are ordinary characters. Without them a line break outside quotes ends a
    record, and record starts have to be found by reading.
    """

    def __init__(self, text: str, width: int, *, separator: str = "\t", quote: str = '"', starts: list[int] | None = None):
        self.text, self.width, self.separator, self.quote, self.starts = text, width, separator, quote, starts
        self.stop = re.compile(f"[{re.escape(separator)}{'' if starts else chr(10)}]")

    def until(self, at: int) -> int:
        """How far a record that begins at `at` can reach: to the line break before the next known start, else to the end of the text."""
        if not self.starts:
            return len(self.text)
        following = bisect_right(self.starts, at)
        return self.starts[following] - 1 if following < len(self.starts) else len(self.text)

    def record(self, at: int) -> tuple[list[str], int]:
        """The cells of the record at `at`, and where it ends."""
        cells, until = [], self.until(at)
        while True:
            cell, at = self.quoted(at, until) if self.text.startswith(self.quote, at) and at < until else self.plain(at, until)
            cells.append(cell)
            if at >= until or not self.text.startswith(self.separator, at):
                return cells, at
            at += len(self.separator)

    def quoted(self, start: int, until: int) -> tuple[str, int]:
        """A quoted cell; an error at its opening quote if it would run over the next record's start, else at what follows its closing quote."""
        at, parts = start + 1, []
        while 0 <= (end := self.text.find(self.quote, at)) < until:
            parts.append(self.text[at:end])
            at = end + 1
            if at < until and self.text.startswith(self.quote, at):
                parts.append(self.quote)
                at += 1
            elif at == until or self.stop.match(self.text, at):
                return "".join(parts), at
            else:
                raise QuoteError(at)
        raise QuoteError(start)

    def plain(self, at: int, until: int) -> tuple[str, int]:
        found = self.stop.search(self.text, at, until)
        end = found.start() if found else until
        return self.text[at:end], end

    def anchor(self, at: int) -> int:
        """Where reading goes on after a broken record at `at`: at the next known start; else at the next line from which a whole record of the right width can be read; else at the end of the text."""
        if self.starts:
            return min(self.until(at) + 1, len(self.text))
        while (end := self.text.find("\n", at)) >= 0:
            at = end + 1
            try:
                if len(self.record(at)[0]) == self.width:
                    return at
            except QuoteError:
                pass
        return len(self.text)

    def outcome(self, at: int) -> Outcome:
        """The record at `at`, or the error in its place and where reading resumes."""
        try:
            cells, end = self.record(at)
        except QuoteError as broken:
            return Outcome(at, self.anchor(at), None, "quoting", broken.at)
        return Outcome(at, end, cells, None, None) if len(cells) == self.width else Outcome(at, end, cells, "columns", end)

    def records(self) -> Iterator[Outcome]:
        if self.starts:  # each is a validated anchor, so errors skip none
            yield from map(self.outcome, self.starts)
            return
        at = 0
        while at < len(self.text) or at == 0:
            one = self.outcome(at)
            yield one
            at = max(one.end if one.reason == "quoting" else one.end + 1, at + 1)


def value_reason(cells: Column, required: list[int], checked: list[int]) -> Column:
    """Whether a blank in a required cell or a bad character in a checked one spoils the record."""
    spoilt = F.lit(False)
    for i in required:
        spoilt = spoilt | (F.regexp_replace(cells[i], r"[\s\p{Z}\x{FEFF}]+", "") == "")
    for i in checked:
        spoilt = spoilt | cells[i].rlike(BAD_CHARACTER)
    return spoilt


def parse_lines(df: DataFrame, raw: str, names: list[str], *, required: list[str], checked: list[str], separator: str = "\t", quote: str = '"') -> DataFrame:
    """`df` with one array column `cells`, a `reason` (null: loaded) and `error_at`, the offset of a syntax error in the line.

    Each row of `raw` is one line of an export, in which a quoted cell may
    hold separators and line breaks. Reasons, the first that holds: `quoting`,
    `columns`, `value`. A null line has the reason `columns` (no cells). The
    lines of a batch are read as one text: where a broken quote runs on into
    the next lines, reading resumes at the next line, whose start is known.
    Lines without a quote are only separated, which the JVM does; the others
    travel to Python. Nothing is shuffled. Columns of `df` named like the new
    ones are replaced.
    """
    width = len(names)

    @F.pandas_udf("cells array<string>, reason string, error_at int")
    def descend(lines: pd.Series) -> pd.DataFrame:
        here = [(i, line) for i, line in enumerate(lines) if line is not None]
        starts = list(accumulate((len(line) + 1 for _, line in here[:-1]), initial=0))
        rows: list[tuple] = [(None, None, None)] * len(lines)
        if here:
            outcomes = Grammar("\n".join(line for _, line in here), width, separator=separator, quote=quote, starts=starts).records()
            for (i, _), one in zip(here, outcomes, strict=True):
                rows[i] = (one.cells, one.reason, None if one.error_at is None else one.error_at - one.start)
        return pd.DataFrame(rows, columns=["cells", "reason", "error_at"]).astype({"error_at": "Int32"})

    line = F.col(f"`{raw}`")
    hard = line.contains(quote)
    read = df.withColumn("__hard", descend(F.when(hard, line)))
    plain = F.split(line, re.escape(separator) if separator != "\t" else "\t", -1)
    cells = F.when(hard, F.col("__hard.cells")).otherwise(plain)
    broken = F.when(hard, F.col("__hard.reason"))
    read = read.withColumn("cells", cells).withColumn("error_at", F.when(hard, F.col("__hard.error_at")))
    at = {n: i for i, n in enumerate(names)}
    spoilt = value_reason(F.col("cells"), [at[n] for n in required], [at[n] for n in checked])
    reason = (
        F.when(broken.isNotNull(), broken)
        .when(F.coalesce(F.size("cells"), F.lit(0)) != width, F.lit("columns"))
        .when(spoilt, F.lit("value"))
    )
    return read.withColumn("reason", reason).drop("__hard")


def loaded(parsed: DataFrame, names: list[str], *, keep: list[str]) -> DataFrame:
    """The rows of parse_lines that loaded, their cells as columns."""
    return parsed.where(F.col("reason").isNull()).select(*keep, *[F.col("cells")[i].alias(n) for i, n in enumerate(names)])


def rejected(parsed: DataFrame, *, keep: list[str]) -> DataFrame:
    """The rows of parse_lines that failed, with reason and offset."""
    return parsed.where(F.col("reason").isNotNull()).select(*keep, "reason", "error_at")


def files_of_lines(df: DataFrame, file: str, line_no: str, raw: str, *, lines: int = 2000) -> DataFrame:
    """(file, first_line, text): the lines of each file in order, as texts of `lines` lines at most, so that no file is collected whole. Null lines are empty; repeated line numbers follow each other."""
    block = F.floor(F.col(line_no) / lines).alias("block")
    line = F.struct(F.col(line_no).alias("n"), F.coalesce(raw, F.lit("")).alias("raw"))
    read = df.groupBy(file, block).agg(F.array_sort(F.collect_list(line)).alias("of"))
    return read.select(file, F.element_at("of", 1)["n"].alias("first_line"), F.array_join(F.transform("of", lambda x: x["raw"]), "\n").alias("text"))


def parse_files(df: DataFrame, text: str, names: list[str], *, keep: list[str], separator: str = "\t", quote: str = '"') -> DataFrame:
    """The records of whole files: the `keep` columns, `start`, `end`, `cells`, `reason`, `error_at`.

    A line break outside quotes ends a record; after a broken quote reading
    resumes at the next validated record start, so one bad quote spoils one
    record and not the rest of the file. Null texts give no rows.
    """
    width = len(names)

    @F.pandas_udf("array<struct<start:int,`end`:int,cells:array<string>,reason:string,error_at:int>>")
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [(o.start, o.end, o.cells, o.reason, o.error_at) for o in Grammar(t, width, separator=separator, quote=quote).records()] for t in texts], dtype=object)

    return df.select(*keep, F.explode(read(F.col(f"`{text}`"))).alias("__record")).select(*keep, "__record.*")
