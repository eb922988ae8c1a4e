"""Queries of the general training-data operators: intervals, failed rows, packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.intervals import periods_and_gaps
from cadenza.operators.packed import explode_packed
from cadenza.session import table
from cadenza.sources.delimited import files_of_lines, loaded, parse_files, parse_lines, rejected

CELLS = ["band", "title", "genre", "note"]


#: Written with a delimiter, yet one value.
SINGLE_VALUES = ["n/a"]


def vocabulary(spark: SparkSession, sf_dir: str) -> list[str]:
    """The names of the reference list: a fixed table of about a hundred rows."""
    return [r[0] for r in table(spark, sf_dir, "genre_vocabulary").select("genre").where("genre is not null").collect()]


def sung_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes in beats and words in milliseconds, as intervals of a voice or take."""
    notes = table(spark, sf_dir, "notes").select(
        F.lit("notes").alias("src"),
        F.col("song_id").alias("ref_id"),
        F.coalesce("voice", F.lit("")).alias("voice"),
        F.col("beat").cast("long").alias("start"),
        (F.col("beat").cast("long") + F.col("beat_length")).alias("end"),
    )

    def milliseconds(seconds: str):
        return F.round(F.col(seconds) * 1000).try_cast("long")  # null for what no BIGINT holds: NaN, infinity, 9.2e15 seconds and more

    words = table(spark, sf_dir, "timed_words").select(
        F.lit("words").alias("src"), F.col("take_id").alias("ref_id"), F.lit("").alias("voice"), milliseconds("start_s").alias("start"), milliseconds("end_s").alias("end")
    )
    return notes.unionByName(words)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods_and_gaps(sung_intervals(spark, sf_dir), ["src", "ref_id", "voice"], "start", "end")


def parsed_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(table(spark, sf_dir, "raw_fix_lines"), "raw", CELLS, required=["band"], checked=["band", "note"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(parsed_fixes(spark, sf_dir), keep=["line_id"]).select("line_id", "reason")


def p6_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(parsed_fixes(spark, sf_dir), CELLS, keep=["line_id"])


def p6_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exports read as whole texts, in which record starts aren't known: each record or located error, and from where to where it goes."""
    texts = files_of_lines(table(spark, sf_dir, "raw_fix_lines"), "file_name", "line_no", "raw")
    return parse_files(texts, "text", CELLS, keep=["file_name", "first_line"]).select("file_name", "first_line", "start", "end", F.size("cells").alias("cells"), "reason", "error_at")


def packed_genres(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    names = [*vocabulary(spark, sf_dir), *SINGLE_VALUES]
    info = explode_packed(table(spark, sf_dir, "song_info").select("info_id", "genres").distinct(), "genres", names, keep=["info_id"], least=least)
    fixes = explode_packed(table(spark, sf_dir, "genre_song_fixes").select("fix_id", "genre").distinct(), "genre", names, keep=["fix_id"], least=least)
    return info.select(F.lit("song_info").alias("tbl"), F.col("info_id").alias("rec_id"), "pos", "piece").unionByName(
        fixes.select(F.lit("genre_song_fixes").alias("tbl"), F.col("fix_id").alias("rec_id"), "pos", "piece")
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_genres(spark, sf_dir, 2)


QUERIES = {"p5_found": p5_found, "p6_found": p6_found, "p6_loaded": p6_loaded, "p6_files": p6_files, "p7_found": p7_found}

_SUNG = """
    SELECT 'notes' AS src, song_id AS ref_id, coalesce(voice, '') AS voice, beat::BIGINT AS s, beat::BIGINT + beat_length AS e FROM notes
    UNION ALL
    SELECT 'words', take_id, '', round(start_s * 1000)::BIGINT, round(end_s * 1000)::BIGINT FROM timed_words WHERE NOT isnan(start_s) AND NOT isnan(end_s)"""

SQL = {
    "p5_found": f"""
WITH sung AS ({_SUNG}),
marked AS (
    SELECT *, max(e) OVER (PARTITION BY src, ref_id, voice ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
    FROM sung WHERE e > s),
numbered AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY src, ref_id, voice ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked),
periods AS (SELECT src, ref_id, voice, min(s) AS from_pos, max(e) AS to_pos FROM numbered GROUP BY src, ref_id, voice, island),
following AS (SELECT *, lead(from_pos) OVER (PARTITION BY src, ref_id, voice ORDER BY from_pos) AS next_from FROM periods)
SELECT src, ref_id, voice, 'period' AS kind, from_pos, to_pos FROM periods
UNION ALL
SELECT src, ref_id, voice, 'gap' AS kind, to_pos AS from_pos, next_from AS to_pos FROM following WHERE next_from IS NOT NULL""",
}
_CELL = r'(?:"(?:[^"]|"")*"|(?:[^"\t][^\t]*)?)'
_READ = rf"""
    SELECT line_id, raw, regexp_full_match(raw, '{_CELL}(?:\t{_CELL})*', 's') AS whole,
        regexp_extract_all(raw || chr(9), '({_CELL})\t', 1, 's') AS cells
    FROM raw_fix_lines"""
_TIDY = """CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END"""
_REASONED = rf"""
    SELECT *, CASE WHEN NOT whole THEN 'quoting' WHEN len(cells) <> 4 THEN 'columns'
        WHEN regexp_full_match(tidy[1], '[\s\x{{A0}}\x{{3000}}]*', 's') OR regexp_matches(tidy[1] || tidy[4], '[\x01-\x08\x0b\x0c\x0e-\x1f\x7f\x{{FFFD}}]') THEN 'value' END AS reason
    FROM (SELECT *, list_transform(cells, lambda x: {_TIDY}) AS tidy FROM read)"""
SQL["p6_found"] = f"WITH read AS ({_READ}), reasoned AS ({_REASONED}) SELECT line_id, reason FROM reasoned WHERE reason IS NOT NULL"
SQL["p6_loaded"] = f"WITH read AS ({_READ}), reasoned AS ({_REASONED}) SELECT line_id, tidy[1] AS band, tidy[2] AS title, tidy[3] AS genre, tidy[4] AS note FROM reasoned WHERE reason IS NULL"
