"""Queries of the parsers and scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import scalars as S
from cadenza.session import table
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


r6 = lambda c: F.round(c, 6)
L = r"""l AS (SELECT song_id, unnest(regexp_split_to_array(regexp_replace(text, '^\x{FEFF}', ''), '\r\n|\n|\r')) AS line, generate_subscripts(regexp_split_to_array(regexp_replace(text, '^\x{FEFF}', ''), '\r\n|\n|\r'), 1) AS line_no FROM song_files)"""
NOTE = r"^([:*FRG])\s+(-?\d+(?:[.,]\d+)?)\s+(-?\d+(?:[.,]\d+)?)\s+(-?\d+)(?: (.*))?$"
T_ = rf"""t AS (SELECT song_id, line_no, upper(trim(regexp_extract(line, '^#([^:]*):(.*)$', 1))) AS tag, trim(regexp_extract(line, '^#([^:]*):(.*)$', 2)) AS value FROM l WHERE regexp_matches(line, '^#([^:]*):(.*)$')),
h AS (SELECT song_id, tag, arg_min(value, line_no) AS value FROM t WHERE tag <> '' GROUP BY ALL)"""
N_ = rf"""m AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^P\s?[12]\s*$') THEN 'P' || regexp_extract(line, '([12])', 1) END IGNORE NULLS) OVER w AS part, sum((line LIKE '-%')::INT) OVER w AS lyric_line FROM l WINDOW w AS (PARTITION BY song_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
n AS (SELECT song_id, line_no, part, lyric_line, regexp_extract(line, '{NOTE}', 1) AS type, replace(regexp_extract(line, '{NOTE}', 2), ',', '.')::DOUBLE AS beat, replace(regexp_extract(line, '{NOTE}', 3), ',', '.')::DOUBLE AS length, regexp_extract(line, '{NOTE}', 4)::INT AS pitch, regexp_extract(line, '{NOTE}', 5) AS word FROM m WHERE regexp_matches(line, '{NOTE}'))"""


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "song_files").select("song_id", "text")


@query("s3_tags", f"WITH {L}, {T_} SELECT song_id, tag, value FROM h")
def s3(spark: SparkSession, d: str) -> DataFrame:
    return songs.tags(files(spark, d), "song_id", "text")


@query("s5_notes", f"WITH {L}, {N_} SELECT song_id, line_no::INT AS line_no, part, lyric_line::BIGINT AS lyric_line, type, beat, length, pitch, word FROM n")
def s5(spark: SparkSession, d: str) -> DataFrame:
    return songs.read_notes(files(spark, d), "song_id", "text")


@query("s4_timed_notes", rf"""WITH {L}, {T_}, {N_}, g AS (SELECT song_id, max(CASE WHEN tag = 'BPM' THEN try_cast(replace(value, ',', '.') AS DOUBLE) END) AS bpm, coalesce(max(CASE WHEN tag = 'GAP' THEN try_cast(replace(value, ',', '.') AS DOUBLE) END), 0) AS gap FROM h GROUP BY song_id)
SELECT song_id, line_no::INT AS line_no, round(CASE WHEN bpm > 0 THEN gap / 1000 + beat * 60 / (4 * bpm) END, 6) AS start_s, round(CASE WHEN bpm > 0 THEN gap / 1000 + (beat + length) * 60 / (4 * bpm) END, 6) AS end_s FROM n LEFT JOIN g USING (song_id)""")
def s4(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    timed = songs.timed_notes(songs.read_notes(f, "song_id", "text"), songs.tags(f, "song_id", "text"), "song_id")
    return timed.select("song_id", "line_no", r6("start_s").alias("start_s"), r6("end_s").alias("end_s"))


@query("s6_lyric_lines", rf"""WITH {L}, {N_} SELECT song_id, part, lyric_line::BIGINT AS lyric_line, trim(regexp_replace(string_agg(replace(word, '~', ''), '' ORDER BY line_no), '\s+', ' ', 'g')) AS text, count(*) AS notes FROM n GROUP BY ALL""")
def s6(spark: SparkSession, d: str) -> DataFrame:
    return songs.lyric_lines(songs.read_notes(files(spark, d), "song_id", "text"), "song_id")


@query("s1_songs", f"WITH {L}, {T_} SELECT a.song_id FROM h a JOIN h b USING (song_id) WHERE a.tag = 'TITLE' AND b.tag = 'ARTIST' AND a.value <> '' AND b.value <> ''")
def s1(spark: SparkSession, d: str) -> DataFrame:
    t = songs.tags(files(spark, d), "song_id", "text").where("tag in ('TITLE', 'ARTIST') and value <> ''")
    return t.groupBy("song_id").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("song_id")


@query("s24_set_tag", r"""WITH l AS (SELECT song_id, text LIKE '%' || chr(13) || chr(10) || '%' AS crlf, regexp_split_to_array(text, '\r\n|\n') AS ls FROM song_files),
m AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(upper(ls[i]), '^\x{FEFF}?#GENRE:')) AS hits, list_filter(range(1, len(ls) + 1), lambda i: NOT regexp_matches(ls[i], '^\x{FEFF}?#'))[1] AS body FROM l)
SELECT song_id, CASE WHEN crlf THEN replace(t, chr(1), chr(13) || chr(10)) ELSE replace(t, chr(1), chr(10)) END AS text FROM (SELECT song_id, crlf, array_to_string(CASE WHEN len(hits) > 0 THEN list_transform(list_filter(range(1, len(ls) + 1), lambda i: i = hits[1] OR NOT list_contains(hits, i)), lambda i: CASE WHEN i = hits[1] THEN '#GENRE:Polka' ELSE ls[i] END)
ELSE list_concat(list_concat(ls[1:coalesce(body, len(ls) + 1) - 1], ['#GENRE:Polka']), ls[coalesce(body, len(ls) + 1):]) END, chr(1)) AS t FROM m)""")
def s24(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("song_id", songs.set_tag(F.col("text"), "GENRE", "Polka").alias("text"))


@query("s20_write_text", rf"""WITH {L}, {T_}, {N_}, head AS (SELECT song_id, string_agg('#' || tag || ':' || value, chr(10) ORDER BY CASE tag WHEN 'TITLE' THEN 1 WHEN 'ARTIST' THEN 2 WHEN 'LANGUAGE' THEN 3 WHEN 'BPM' THEN 4 WHEN 'GAP' THEN 5 ELSE 6 END, tag) AS head FROM h GROUP BY song_id),
b AS (SELECT song_id, coalesce(part, '') AS part, lyric_line, string_agg(type || ' ' || trunc(beat)::BIGINT || ' ' || trunc(length)::BIGINT || ' ' || pitch || ' ' || word, chr(10) ORDER BY line_no) AS body, trunc(max(beat + length))::BIGINT AS until FROM n GROUP BY ALL),
e AS (SELECT *, lyric_line = max(lyric_line) OVER (PARTITION BY song_id, part) AS last FROM b),
p AS (SELECT song_id, part, CASE WHEN part <> '' THEN part || chr(10) ELSE '' END || string_agg(body || CASE WHEN last THEN '' ELSE chr(10) || '- ' || until END, chr(10) ORDER BY lyric_line) AS body FROM e GROUP BY song_id, part)
SELECT song_id, head || chr(10) || coalesce(string_agg(body, chr(10) ORDER BY part) || chr(10), '') || 'E' || chr(10) AS text FROM head LEFT JOIN p USING (song_id) GROUP BY song_id, head""")
def s20(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return songs.write_text(songs.tags(f, "song_id", "text"), songs.read_notes(f, "song_id", "text"), "song_id", ["TITLE", "ARTIST", "LANGUAGE", "BPM", "GAP"])


@query("s22_replace_pitch", rf"""WITH {L} SELECT song_id, line_no::INT AS line_no, CASE WHEN regexp_matches(line, '^[:*FRG]\s') THEN regexp_extract(line, '^([:*FRG]\s+\S+\s+\S+\s+)-?\d+', 1) || '7' || regexp_extract(line, '^[:*FRG]\s+\S+\s+\S+\s+-?\d+(.*)$', 1) ELSE line END AS line FROM l""")
def s22(spark: SparkSession, d: str) -> DataFrame:
    return songs.lines(files(spark, d), "song_id", "text").select("song_id", "line_no", songs.replace_pitch(F.col("line"), F.lit(7)).alias("line"))


_CREDIT = r"(?i)^(?:(?:作词|作曲|编曲|制作人|混音|母带)(?:\s*[:：]|\s)|(?:lyrics?\s*by|lyricist|composer|arranger|producer|mixed\s*by|mastered\s*by)\s*[:：])"
_MARK = r"(?i)^\[\s*([^\[\]]+?)(?:\s+(?:[x×]\s*\d+|\d+\s*[x×]))?\s*\](?:\s*(?:(?:[x×]\s*\d+|\d+\s*[x×])|\[\s*(?:[x×]\s*\d+|\d+\s*[x×])\s*\]|\(\s*(?:[x×]\s*\d+|\d+\s*[x×])\s*\)))?$"


@query("s15_plain_lyrics", rf"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '^\x{{FEFF}}', ''), '\r\n|\n|\r')) AS line, generate_subscripts(regexp_split_to_array(regexp_replace(text, '^\x{{FEFF}}', ''), '\r\n|\n|\r'), 1) AS line_no FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, CASE WHEN regexp_matches(trim(line), '{_MARK}') THEN lower(trim(regexp_extract(trim(line), '{_MARK}', 1))) END AS own FROM l),
s AS (SELECT doc_id, line_no, line, own, count(own) OVER w AS section_no, last_value(own IGNORE NULLS) OVER w AS mark FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
z AS (SELECT doc_id, section_no, any_value(mark) AS mark, count(*) FILTER (own IS NULL AND trim(line) <> '') AS n FROM s GROUP BY ALL),
r AS (SELECT z.doc_id, z.section_no, z.mark, CASE WHEN z.n > 0 THEN z.section_no ELSE (SELECT min(y.section_no) FROM z y WHERE y.doc_id = z.doc_id AND y.mark = z.mark AND y.n > 0 AND y.section_no < z.section_no) END AS source FROM z),
c AS (SELECT r.doc_id, r.section_no, r.mark, s.line_no, trim(regexp_replace(trim(s.line), '^(?:\[\d+:\d+(?:[.:]\d+)?\]\s*)+', '')) AS line FROM r JOIN s ON s.doc_id = r.doc_id AND s.section_no = r.source AND s.own IS NULL)
SELECT doc_id, section_no::BIGINT AS section_no, mark, line_no::INT AS line_no, line FROM c WHERE line <> '' AND NOT regexp_matches(line, '{_CREDIT}') AND NOT regexp_matches(line, '^\([^()]*\)$')""")
def s15(spark: SparkSession, d: str) -> DataFrame:
    return texts.read_plain_lyrics(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query("s14_timed_lyrics", r"""SELECT take_id, seq::INT + 1 AS line_no, round(m * 60 + s + f / 100, 6) AS start_s, trim(word) AS line FROM (SELECT DISTINCT take_id, seq, word, floor(start_s / 60) AS m, floor(start_s % 60) AS s, 7 AS f FROM timed_words WHERE start_s >= 0 AND NOT isnan(start_s)) WHERE trim(word) <> '' AND NOT regexp_matches(trim(word), '^\([^)]*\)$')""".replace("seq::INT + 1", "1"))
def s14(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "timed_words").where("start_s >= 0 and not isnan(start_s)").select("take_id", "seq", "word", F.floor(F.col("start_s") / 60).alias("m"), F.floor(F.col("start_s") % 60).alias("s")).distinct()
    stamped = w.withColumn("key", F.struct("take_id", "seq", "word", "m", "s")).withColumn("text", F.concat(F.format_string("[%02d:%02d.07]", "m", "s"), "word"))
    return texts.read_timed_lyrics(stamped, "key", "text").select(F.col("key.take_id").alias("take_id"), "line_no", r6("start_s").alias("start_s"), "line")


@query("s9_want_list", r"""WITH l AS (SELECT coalesce(artist, '') || ' - ' || coalesce(title, '') || coalesce(' ' || video_url, '') AS line FROM media_info),
r AS (SELECT regexp_extract(line, '(https?://\S+)', 1) AS url, trim(regexp_replace(line, 'https?://\S+', '', 'g')) AS rest FROM l WHERE trim(line) <> '' AND NOT regexp_matches(line, '^\s*#'))
SELECT trim(regexp_split_to_array(rest, '\s+-\s+')[1]) AS band, trim(CASE WHEN regexp_matches(rest, '\s+-\s+') THEN regexp_extract(rest, '^(?s:.*?)\s+-\s+((?s:.*))$', 1) ELSE '' END) AS title, CASE WHEN url = '' THEN 'skip' ELSE url END AS url FROM r""")
def s9(spark: SparkSession, d: str) -> DataFrame:
    """Every medium as a line of a list; without a link it is to be skipped."""
    line = F.concat(F.coalesce("artist", F.lit("")), F.lit(" - "), F.coalesce("title", F.lit("")), F.coalesce(F.concat(F.lit(" "), "video_url"), F.lit("")))
    return texts.read_want_list(table(spark, d, "media_info").select(line.alias("line")), "line")


@query("s28_log_marks", """SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS kind FROM events""")
def s28(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.concat_ws(" ", F.lit("DONE"), F.concat(F.lit("kind="), "event_type"), F.concat(F.lit("k="), F.get_json_object("props", "$.k"))).alias("line"))
    marks = S.key_values(F.col("line"))
    return e.select("event_id", marks["k"].alias("k"), marks["kind"].alias("kind"))


@query("f8_without_brackets", r"""SELECT DISTINCT media_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '\([^()]*\)|\[[^\[\]]*\]', ' ', 'g'), '\([^()]*\)|\[[^\[\]]*\]', ' ', 'g'), '\([^()]*\)|\[[^\[\]]*\]', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM media_info""")
def f8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "media_info").select("media_id", S.without_brackets(F.col("title")).alias("clean")).distinct()


@query("f10_slug", "SELECT DISTINCT media_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM media_info")
def f10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "media_info").select("media_id", S.slug(F.col("title")).alias("slug")).distinct()


@query("f12_first_year", r"SELECT DISTINCT media_id, CASE WHEN regexp_extract(release_year, '\b(\d{4})\b', 1) <> '' THEN regexp_extract(release_year, '\b(\d{4})\b', 1) ELSE release_year END AS year FROM media_info")
def f12(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "media_info").select("media_id", S.first_year(F.col("release_year")).alias("year")).distinct()


@query("f5_placeholder", "SELECT lower(trim(genre)) IN ('', 'unknown', 'no idea', 'other', 'none', 'misc') AS placeholder, count(*) AS n FROM media_info GROUP BY 1")
def f5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "media_info").groupBy(S.is_placeholder(F.col("genre")).alias("placeholder")).agg(F.count(F.lit(1)).alias("n"))


@query("f22_clock", r"SELECT DISTINCT start_s::BIGINT AS s, CASE WHEN start_s::BIGINT >= 3600 THEN (start_s::BIGINT // 3600) || ':' || lpad((start_s::BIGINT // 60 % 60)::VARCHAR, 2, '0') ELSE (start_s::BIGINT // 60)::VARCHAR END || ':' || lpad((start_s::BIGINT % 60)::VARCHAR, 2, '0') AS clock, start_s::BIGINT::DOUBLE AS back FROM (SELECT floor(abs(start_s) * 77) AS start_s FROM timed_words WHERE start_s IS NOT NULL AND NOT isnan(start_s))")
def f22(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "timed_words").where("start_s is not null and not isnan(start_s)").select(F.floor(F.abs("start_s") * 77).alias("s")).distinct()
    text = S.clock(F.col("s"))
    return w.select("s", text.alias("clock"), S.parse_clock(text).alias("back"))


@query("f24_beats", "SELECT DISTINCT song_id, beat, round(2.0 + beat * 60 / (4 * 250.0), 6) AS s, round_even((2.0 + beat * 60 / (4 * 250.0) - 2.0) * 250.0 * 4 / 60, 0)::BIGINT AS back FROM notes WHERE beat IS NOT NULL")
def f24(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "notes").where("beat is not null").select("song_id", "beat").distinct()
    s = S.beat_seconds(F.col("beat"), F.lit(250.0), F.lit(2000.0))
    return n.select("song_id", "beat", r6(s).alias("s"), S.seconds_beat(s, F.lit(250.0), F.lit(2000.0)).alias("back"))


@query("f25_bpm_multiplier", "SELECT DISTINCT media_id, bpm, greatest(0, ceil(400.0 / bpm) - 1)::BIGINT AS k FROM media_info WHERE bpm > 0 AND NOT isnan(bpm)")
def f25(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "media_info").where("bpm > 0 and not isnan(bpm)").select("media_id", "bpm", S.bpm_multiplier(F.col("bpm")).alias("k")).distinct()


_NAMES = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"


@query("f27_note_names", f"SELECT DISTINCT pitch, {_NAMES}[((pitch + 48) % 12 + 12) % 12 + 1] || (floor((pitch + 48) / 12.0) - 1)::INT AS name, round_even(69 + 12 * log2((440 * pow(2, (pitch + 48 - 69) / 12.0)) / 440), 0)::INT AS midi FROM notes WHERE pitch IS NOT NULL")
def f27(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "notes").where("pitch is not null").select("pitch").distinct()
    hz = F.lit(440.0) * F.pow(F.lit(2.0), (F.col("pitch") + 48 - 69) / 12.0)
    return n.select("pitch", S.midi_name(F.col("pitch") + 48).alias("name"), S.hz_midi(hz).alias("midi"))


@query("f31_nearest_in_key", """WITH o AS (SELECT unnest([0, -1, 1, -2, 2]) AS d, unnest([0, 1, 2, 3, 4]) AS r), p AS (SELECT DISTINCT pitch FROM notes WHERE pitch IS NOT NULL)
SELECT pitch, arg_min(pitch + d, r) AS quantised FROM p, o WHERE ((pitch + d - 2) % 12 + 12) % 12 IN (0, 2, 4, 5, 7, 9, 11) GROUP BY pitch""")
def f31(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "notes").where("pitch is not null").select("pitch").distinct()
    return n.select("pitch", S.nearest_in_key(F.col("pitch"), F.lit(2), F.lit(0)).alias("quantised"))


@query("f34_cosine", """WITH a AS (SELECT * FROM embeddings), c AS (SELECT label, list_transform(range(1, len(any_value(embedding)) + 1), lambda i: avg(embedding[i])) AS m FROM (SELECT 1 AS label, [1.0] AS embedding) GROUP BY label)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 5) AS cosine FROM a""")
def f34(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(S.cosine(F.col("embedding"), F.reverse("embedding")), 5).alias("cosine"))


@query("f16_even_split", "SELECT DISTINCT take_id, seq, (i)::INT AS i, round(start_s + (end_s - start_s) / 3 * i, 6) AS s FROM (SELECT *, unnest([0, 1, 2]) AS i FROM timed_words WHERE NOT isnan(start_s) AND NOT isnan(end_s))")
def f16(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "timed_words").where("not isnan(start_s) and not isnan(end_s) and start_s is not null and end_s is not null")
    parts = w.select("take_id", "seq", F.posexplode(S.split_evenly(F.col("start_s"), F.col("end_s"), F.lit(3))).alias("i", "p"))
    return parts.select("take_id", "seq", "i", r6("p.start").alias("s")).distinct()


@query("f_script", r"""SELECT doc_id, CASE WHEN regexp_matches(song_title, '[\x{3040}-\x{30FF}]') THEN 'japanese' WHEN regexp_matches(song_title, '[\x{AC00}-\x{D7AF}]') THEN 'hangul' WHEN regexp_matches(song_title, '[\x{0400}-\x{04FF}]') THEN 'cyrillic' WHEN regexp_matches(song_title, '[\x{4E00}-\x{9FFF}]') THEN 'chinese' WHEN regexp_matches(song_title, '[A-Za-z]') THEN 'latin' END AS script FROM documents""")
def script(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.script_of(F.col("song_title")).alias("script"))


@query("f20_plain_number", r"SELECT DISTINCT media_id, regexp_replace(regexp_replace(printf('%.2f', bpm), '(\.\d*?)0+$', '\1'), '\.$', '') AS bpm FROM media_info WHERE NOT isnan(bpm) AND bpm IS NOT NULL")
def f20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "media_info").where("not isnan(bpm) and bpm is not null").select("media_id", S.plain_number(F.col("bpm")).alias("bpm")).distinct()


@query("c_candidates", f"""WITH {L}, {T_}, {N_}, c AS (SELECT song_id, count(*) AS notes, max(part IS NOT NULL) AS duet FROM n GROUP BY song_id), b AS (SELECT song_id, max(tag = 'BPM') AS bpm FROM h GROUP BY song_id)
SELECT song_id, CASE WHEN coalesce(duet, false) THEN 'duet' WHEN NOT coalesce(bpm, false) THEN 'no bpm' WHEN coalesce(notes, 0) < 50 THEN 'few notes' ELSE 'ok' END AS state FROM song_files LEFT JOIN c USING (song_id) LEFT JOIN b USING (song_id)""")
def candidates(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    c = songs.read_notes(f, "song_id", "text").groupBy("song_id").agg(F.count(F.lit(1)).alias("notes"), F.max(F.col("part").isNotNull()).alias("duet"))
    b = songs.tags(f, "song_id", "text").groupBy("song_id").agg(F.max(F.col("tag") == "BPM").alias("bpm"))
    state = F.when(F.coalesce("duet", F.lit(False)), "duet").when(~F.coalesce("bpm", F.lit(False)), "no bpm").when(F.coalesce("notes", F.lit(0)) < 50, "few notes").otherwise("ok")
    return f.select("song_id").join(c, "song_id", "left").join(b, "song_id", "left").select("song_id", state.alias("state"))
