"""Queries of song files as whole texts: headers, parts, edits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.plans.scans import L, N_, NOTE, T_, files
from cadenza.session import table
from cadenza.sources import duets as D
from cadenza.sources import headers as H
from cadenza.sources import songs, texts

QUERIES = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL."""

    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


@query("s2_decoded", "SELECT song_id, text FROM song_files")
def s2(spark: SparkSession, d: str) -> DataFrame:
    """Every file as bytes, Western texts in the Western code page (with a last letter that is never valid in UTF-8, taken off again), the others in UTF-8 with or without their mark: decoded, they are what they were."""
    western = F.col("text").rlike(r"^[\x00-\x7F\x{A0}-\x{FF}]*$")
    content = F.when(western, F.encode(F.concat("text", F.lit("ÿ")), "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    decoded = files(spark, d).select("song_id", "text", western.alias("western"), songs.decode_text(content).alias("back"))
    back = F.when(F.col("western"), F.expr("left(back, char_length(back) - 1)")).otherwise(F.col("back"))
    return decoded.select("song_id", F.when(F.col("text").startswith("\ufeff"), F.concat(F.lit("\ufeff"), back)).otherwise(back).alias("text"))


@query("s3_header_flags", rf"""WITH {L}, {T_}, g AS (SELECT song_id, map_from_entries(list((tag, value) ORDER BY tag)) AS m FROM h GROUP BY song_id),
b AS (SELECT song_id, count(*) FILTER (regexp_matches(line, '{NOTE}')) AS notes, bool_or(regexp_matches(line, '^P\s*\d')) AS marked FROM l GROUP BY song_id)
SELECT song_id, m['TITLE'] AS title, cardinality(m)::INT AS tags, notes, marked OR m['DUETSINGERP1'] IS NOT NULL OR m['P1'] IS NOT NULL AS duet, coalesce(lower(m['RELATIVE']) = 'yes', false) AS relative FROM b LEFT JOIN g USING (song_id)""")
def s3(spark: SparkSession, d: str) -> DataFrame:
    return H.header_flags(files(spark, d), "song_id", "text").select("song_id", F.col("tags")["TITLE"].alias("title"), F.size("tags").alias("tags"), "notes", "duet", "relative")


_KIND = rf"""CASE WHEN regexp_matches(line, '{NOTE}') THEN 'note' WHEN trim(line) LIKE '#%' THEN 'header' WHEN regexp_matches(line, '^P\s*[12]\s*$') THEN 'part' WHEN ltrim(line) LIKE '-%' THEN 'break'
WHEN regexp_matches(trim(line), '^E(?: .*)?$') THEN 'end' WHEN trim(line) = '' THEN 'blank' ELSE 'other' END"""


@query("s5_all_lines", f"WITH {L} SELECT song_id, line_no::INT AS line_no, {_KIND} AS kind, line AS raw FROM l")
def s5(spark: SparkSession, d: str) -> DataFrame:
    return D.song_lines(files(spark, d), "song_id", "text")


_PARTS = rf"""k AS (SELECT *, {_KIND} AS kind FROM l), e AS (SELECT *, max((kind = 'end')::INT) OVER w AS ended, coalesce(last_value(CASE WHEN kind = 'part' THEN 'P' || regexp_extract(line, '([12])', 1) END IGNORE NULLS) OVER w, 'P1') AS part, sum((kind IN ('part', 'break'))::INT) OVER w AS stretch FROM k WINDOW w AS (PARTITION BY song_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
c AS (SELECT song_id, line_no, part, stretch, replace(regexp_extract(line, '{NOTE}', 2), ',', '.')::DOUBLE AS beat, replace(regexp_extract(line, '{NOTE}', 3), ',', '.')::DOUBLE AS length, regexp_extract(line, '{NOTE}', 5) AS word FROM e WHERE kind = 'note' AND ended = 0),
v AS (SELECT *, coalesce(beat < lag(beat) OVER (PARTITION BY song_id, part, stretch ORDER BY line_no), false) AS back FROM c),
o AS (SELECT song_id, part, stretch, arg_min(beat, line_no) AS start, max(beat + length) AS until, count(*) AS notes, count(*) FILTER (back) AS back_in_time, trim(regexp_replace(string_agg(word, '' ORDER BY line_no), '[\s~]+', ' ', 'g')) AS text FROM v GROUP BY ALL),
pl AS (SELECT *, row_number() OVER (PARTITION BY song_id, part ORDER BY stretch) AS lyric_line FROM o)"""


@query("s6_part_lines", f"WITH {L}, {_PARTS} SELECT song_id, part, lyric_line::INT AS lyric_line, start, until, text, notes, back_in_time FROM pl")
def s6_lines(spark: SparkSession, d: str) -> DataFrame:
    return D.part_lines(files(spark, d), "song_id", "text")


@query("s6_duets", f"""WITH {L}, {_PARTS}, {T_}, n AS (SELECT song_id, count(*) FILTER (part = 'P1') AS a, count(*) FILTER (part = 'P2') AS b, sum(back_in_time)::BIGINT AS p FROM pl GROUP BY song_id), g AS (SELECT song_id, bool_or(tag IN ('P1', 'P2')) AS p, bool_or(tag IN ('DUETSINGERP1', 'DUETSINGERP2')) AS d, max(CASE WHEN tag = 'RELATIVE' THEN lower(value) END) AS r FROM h GROUP BY song_id)
SELECT s.song_id, coalesce(n.a, 0) AS p1_lines, coalesce(n.b, 0) AS p2_lines, coalesce(n.p, 0) AS problems, CASE WHEN g.p THEN 'P' WHEN g.d THEN 'DUETSINGERP' END AS name_form, CASE WHEN g.r = 'yes' THEN 'relative' WHEN coalesce(n.a, 0) = 0 THEN 'P1' WHEN coalesce(n.b, 0) = 0 THEN 'P2' END AS error FROM song_files s LEFT JOIN n USING (song_id) LEFT JOIN g USING (song_id) WHERE s.text IS NOT NULL""")
def s6_duets(spark: SparkSession, d: str) -> DataFrame:
    return D.duets(files(spark, d), "song_id", "text")


@query("j20_timeline", f"""WITH {L}, {_PARTS}, t AS (SELECT *, row_number() OVER (PARTITION BY song_id, part, start, text ORDER BY lyric_line) AS twin FROM pl)
SELECT song_id, start, max(until) AS until, text, string_agg(part, '' ORDER BY part) AS singers FROM t GROUP BY song_id, start, text, twin""")
def j20(spark: SparkSession, d: str) -> DataFrame:
    return D.timeline(D.part_lines(files(spark, d), "song_id", "text"), "song_id")


@query("j13_overlapping")
def j13(spark: SparkSession, d: str) -> DataFrame:
    return D.overlapping(D.timeline(D.part_lines(files(spark, d), "song_id", "text"), "song_id"), "song_id")


@query("s23_genre_bytes", "SELECT song_id, 'Polka & Süß' AS genre, true AS same_rest FROM song_files")
def s23(spark: SparkSession, d: str) -> DataFrame:
    """Files as bytes with another genre: it can be read, and without it the rest is what it was without its own."""
    raw = files(spark, d).select("song_id", F.encode("text", "UTF-8").alias("content"))
    edited = raw.withColumn("new", H.genre_in_bytes(F.col("content"), "Polka & Süß"))
    return edited.select("song_id", H.genre_of_bytes(F.col("new")).alias("genre"), (H.genre_in_bytes(F.col("new"), None) == H.genre_in_bytes(F.col("content"), None)).alias("same_rest"))


@query("s25_versioned", rf"""WITH {L}, a AS (SELECT song_id, min(line_no) FILTER (ltrim(line) NOT LIKE '#%') AS body FROM l GROUP BY song_id), q AS (SELECT l.song_id, line_no, line, upper(trim(regexp_extract(line, '^\s*#([^:]*):', 1))) AS tag, trim(regexp_extract(line, '^\s*#[^:]*:(.*)$', 1)) AS value FROM l JOIN a USING (song_id) WHERE body IS NULL OR line_no < body),
f AS (SELECT song_id, arg_min(value, line_no) FILTER (tag = 'VERSION' AND value <> '') AS version, arg_min(value, line_no) FILTER (tag = 'RELATIVE' AND value <> '') AS relative, arg_min(value, line_no) FILTER (tag = 'ENCODING' AND value <> '') AS enc, bool_or(tag = 'DUETSINGERP1' AND value <> '') AS d1, bool_or(tag = 'DUETSINGERP2' AND value <> '') AS d2, bool_or(tag = 'NOTESGAP' AND value <> '') AS ng, bool_or(tag = 'AUDIO' AND value <> '') AS audio, count(*) FILTER (tag = 'MP3' AND value <> '') AS mp3, count(*) FILTER (tag NOT IN ('RELATIVE', 'ENCODING')) AS kept FROM q GROUP BY song_id),
r AS (SELECT *, CASE WHEN version IS NULL THEN CASE WHEN lower(relative) = 'yes' THEN '#RELATIVE:' || relative WHEN replace(upper(enc), '-', '') <> 'UTF8' THEN '#ENCODING:' || enc WHEN d1 THEN '#DUETSINGERP1' WHEN d2 THEN '#DUETSINGERP2' WHEN ng THEN '#NOTESGAP' END END AS reason FROM f)
SELECT s.song_id, r.reason, CASE WHEN r.song_id IS NULL THEN 0 WHEN version IS NOT NULL OR reason IS NOT NULL THEN (SELECT count(*) FROM q WHERE q.song_id = s.song_id) ELSE 1 + kept + CASE WHEN audio THEN 0 ELSE mp3 END END::INT AS header_lines FROM song_files s LEFT JOIN r USING (song_id)""")
def s25(spark: SparkSession, d: str) -> DataFrame:
    """Why a header isn't upgraded, and how many lines it has in the end."""
    text, reason = H.versioned(F.col("text"))
    return files(spark, d).select("song_id", reason.alias("reason"), F.size(H.split_header(text)[1]).alias("header_lines"))


@query("pred12_looks_like_song", r"SELECT doc_id, regexp_matches(left(text, 8192), '(?m)^\s*#[A-Za-z0-9]+:') AND regexp_matches(left(text, 8192), '(?m)^[:*FRG]\s+-?\d') AS song FROM documents WHERE text IS NOT NULL")
def p12(spark: SparkSession, d: str) -> DataFrame:
    """A tag and a note row among the first 8,192 letters, which is the rule."""
    head = F.substring("text", 1, 8192)
    return table(spark, d, "documents").where("text is not null").select("doc_id", (head.rlike(r"(?m)^\s*#[A-Za-z0-9]+:") & head.rlike(r"(?m)^[:*FRG]\s+-?\d")).alias("song"))


@query("r4_score_comment", r"""WITH x AS (SELECT song_id, string_split(text, chr(10)) AS ls FROM song_files), m AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '^[:*FRG] '))[1] AS n, list_filter(range(1, len(ls) + 1), lambda i: ls[i] LIKE '#COMMENT:%')[1] AS c FROM x)
SELECT song_id, array_to_string(CASE WHEN c IS NOT NULL AND (n IS NULL OR c < n) THEN list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN i = c THEN ls[i] || ' | Score: 9' ELSE ls[i] END) WHEN n IS NOT NULL THEN list_concat(list_concat(ls[1:n - 1], ['#COMMENT:Score: 9']), ls[n:]) ELSE ls END, chr(10)) AS text FROM m""")
def r4(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("song_id", H.with_comment(F.col("text"), F.lit("Score: 9")).alias("text"))


@query("pred22_play_range", rf"""WITH {L}, {T_}, m AS (SELECT song_id, tag, value, try_cast(replace(value, ',', '.') AS DOUBLE) AS v FROM h WHERE tag IN ('GAP', 'BPM', 'START', 'END'))
SELECT song_id, tag, CASE WHEN v IS NULL THEN '#START:' || value WHEN v + 0.5 < 0 OR v + 0.5 > 297 THEN NULL ELSE '#START:' || regexp_replace(regexp_replace(printf('%.3f', v + 0.5), '(\.\d*?)0+$', '\1'), '\.$', '') END AS start_line, CASE WHEN v IS NULL THEN '#END:' || value WHEN v + 500 < 700 THEN NULL ELSE '#END:' || round_even(v + 500, 0)::BIGINT END AS end_line FROM m WHERE v IS NULL OR v <> 0""")
def p22(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of headers as a START and as an END, moved by half a second."""
    t = songs.tags(files(spark, d), "song_id", "text").where("tag in ('GAP', 'BPM', 'START', 'END')").withColumn("v", songs.decimal(F.col("value"))).where("v is null or v <> 0")
    moved = lambda tag, v: H.moved_play_range(F.concat(F.lit(f"#{tag}:"), v), F.lit(500), F.lit(300), F.lit(0.7))
    return t.select("song_id", "tag", moved("START", F.col("value")).alias("start_line"), moved("END", F.col("value")).alias("end_line"))


@query("r22_singers", "SELECT song_id, CASE WHEN k = 0 THEN '#TITLE:T|#P1:Ann|#P2:Bo' WHEN k = 1 THEN '#DUETSINGERP1:Ann|#DUETSINGERP2:Bo' ELSE '#P2:Bo|#DUETSINGERP1:z|#P1:Ann' END AS header FROM (SELECT song_id, song_id % 3 AS k FROM song_files)")
def r22(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("song_id") % 3
    header = F.when(k == 0, F.array(F.lit("#TITLE:T"))).when(k == 1, F.array(F.lit("#DuetSingerP1:x"), F.lit("#DUETSINGERP2:y"))).otherwise(F.array(F.lit("#P2:x"), F.lit("#DUETSINGERP1:z"), F.lit("#p1:q")))
    return files(spark, d).select("song_id", F.array_join(D.with_singers(header, F.lit("Ann"), F.lit("Bo")), "|").alias("header"))


@query("f9_artist_pair", r"""WITH a AS (SELECT DISTINCT artist, list_filter(list_transform(regexp_split_to_array(artist, '(?i)\s*(?:,|&|\+|/|\bfeat\.?|\bft\.?|\band\b|\bund\b|\bmit\b|\bwith\b)\s*'), lambda x: trim(x)), lambda x: x <> '') AS n FROM media_info WHERE artist IS NOT NULL)
SELECT artist, CASE WHEN len(n) = 2 THEN n[1] END AS one, CASE WHEN len(n) = 2 THEN n[2] END AS two FROM a""")
def f9(spark: SparkSession, d: str) -> DataFrame:
    pair = D.artist_pair(F.col("artist"))
    return table(spark, d, "media_info").where("artist is not null").select("artist").distinct().select("artist", F.get(pair, 0).alias("one"), F.get(pair, 1).alias("two"))


@query("s8_delimited_lists", "SELECT fix_id, nullif(trim(band), '') AS band, nullif(trim(title), '') AS title, nullif(trim(note), '') AS note FROM genre_song_fixes")
def s8(spark: SparkSession, d: str) -> DataFrame:
    """Fixes written as lists with a header each, semicolons and quotes, comments between, and read again."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    text = F.concat(F.lit("# a list\n\nId;Band Name;SONG;Remark\n"), F.col("fix_id").cast("string"), F.lit(";"), quoted("band"), F.lit(";"), quoted("title"), F.lit(";"), quoted("note"), F.lit(";beyond\n  \n# end"))
    lists = table(spark, d, "genre_song_fixes").withColumn("text", text).withColumn("file", F.col("fix_id").cast("string"))
    read = texts.read_delimited(lists, "file", "text", {"id": [], "band": ["band name"], "title": ["song"], "note": ["remark", "comment"]})
    return read.select(F.col("id").cast("long").alias("fix_id"), "band", "title", "note")


@query("s12_append_and_read", "SELECT media_id, arg_max(title, {'l': loaded_at, 't': title}) AS title FROM media_info WHERE title IS NOT NULL GROUP BY media_id")
def s12(spark: SparkSession, d: str) -> DataFrame:
    """Media appended as JSON lines, a file for each day of arrival; the newest line of each is read."""
    row = F.to_json(F.struct("media_id", "title"))
    m = table(spark, d, "media_info").where("title is not null").select("media_id", "title", "loaded_at")
    logs = m.groupBy(F.date_format("loaded_at", "yyyy-MM-dd").alias("day"), (F.col("media_id") % 50).alias("shard")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("loaded_at", "title", row.alias("json")))), lambda x: x["json"]), "\n").alias("text"))
    appended = logs.select("day", "shard", F.concat("text", F.lit("\nno json\n")).alias("text")).withColumn("file", F.concat_ws("/", "day", "shard"))
    return texts.read_results(appended, "file", "text", "media_id long, title string", "media_id").select("media_id", "title")
