"""Queries of media records, marks, exports and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza import register
from cadenza.functions import scalars as S
from cadenza.operators import aggregates as A
from cadenza.operators.windows import newest
from cadenza.plans.scans import L, T_, files
from cadenza.plans.sequences import WORDS, words
from cadenza.session import table
from cadenza.sources import songs, texts
from cadenza.streaming import streams

QUERIES = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL."""

    def register_query(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register_query


r6 = lambda c: F.round(c, 6)


@query("u_registered_functions")
def u_registered(spark: SparkSession, d: str) -> DataFrame:
    """The registered functions in a SQL statement."""
    m = table(spark, d, "media_info").where("artist is not null and title is not null").select("media_id", "artist", "title").distinct()
    return register.with_table(spark, m, "m", "SELECT media_id, fold_word(title) AS folded, normal_name(artist) AS name, round(block_ratio(lower(artist), lower(title)), 6) AS ratio, similar_words(artist, title) AS alike FROM {m}")


@query("f2_normal_name")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return register.with_table(spark, table(spark, d, "song_info").where("artist is not null").select("artist").distinct(), "s", "SELECT artist, normal_name(artist) AS name FROM {s}")


@query("f7_similar_words")
def f7(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring words of a take that are much alike."""
    w = table(spark, d, "timed_words").where("word is not null").select("take_id", "seq", F.lower(F.trim("word")).alias("word")).distinct()
    near = w.withColumn("next", F.lead("word").over(Window.partitionBy("take_id").orderBy("seq", "word"))).where("next is not null").select("word", "next").distinct()
    return register.with_table(spark, near, "n", "SELECT word, next, similar_words(word, next) AS alike FROM {n}")


@query("f32_natural_length", f"{WORDS} SELECT word, 0.1::DOUBLE + 0.06::DOUBLE * len(word) AS length FROM w WHERE word IS NOT NULL GROUP BY word")
def f32(spark: SparkSession, d: str) -> DataFrame:
    return words(spark, d).where("word is not null").select("word").distinct().select("word", S.natural_length(F.col("word")).alias("length"))


@query("r32_quarters", "SELECT DISTINCT beat_length, greatest(0.25, round_even(beat_length * 4.0 / 7 , 0) / 4) AS quarters FROM notes WHERE beat_length IS NOT NULL")
def r32(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notes").where("beat_length is not null").select("beat_length").distinct().select("beat_length", S.quarter_length(F.col("beat_length") / 7.0).alias("quarters"))


@query("pred7_without_points", "SELECT DISTINCT word, replace(replace(word, '.', ''), ',', '') AS bare FROM timed_words WHERE word IS NOT NULL")
def pred7(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "timed_words").where("word is not null").select("word").distinct().select("word", S.strip_punctuation(F.col("word")).alias("bare"))


@query("a2_vote", """WITH v AS (SELECT l_orderkey, l_returnflag AS vote, count(*) AS n, min({'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey}) AS first FROM lineitem GROUP BY ALL) SELECT l_orderkey, arg_min(vote, {'n': -n, 'f': first}) AS vote FROM v GROUP BY l_orderkey""")
def a2(spark: SparkSession, d: str) -> DataFrame:
    """What most windows say; of equally frequent answers the earliest."""
    return A.most_frequent(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", F.col("l_returnflag").alias("vote"))


@query("pred14_stale_rows", """WITH r AS (SELECT media_id, arg_max(coalesce(genre, ''), {'l': loaded_at, 'g': coalesce(genre, '')}) AS now, arg_min(coalesce(genre, ''), {'l': loaded_at, 'g': coalesce(genre, '')}) AS listed FROM media_info GROUP BY media_id) SELECT media_id, now <> listed OR (now = '' AND listed = '') AS stale FROM r""")
def pred14(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose reason has changed since they were listed, or that have none."""
    genre = F.coalesce("genre", F.lit(""))
    r = table(spark, d, "media_info").groupBy("media_id").agg(F.max_by(genre, F.struct("loaded_at", genre.alias("g"))).alias("now"), F.min_by(genre, F.struct("loaded_at", genre.alias("g"))).alias("listed"))
    return r.select("media_id", ((F.col("now") != F.col("listed")) | ((F.col("now") == "") & (F.col("listed") == ""))).alias("stale"))


@query("c8_first_link", """WITH h AS (SELECT media_id, video_url AS link, 1 AS strategy FROM media_info WHERE video_url IS NOT NULL AND media_id % 3 = 0 UNION ALL SELECT media_id, 'text:' || title, 2 FROM media_info WHERE title IS NOT NULL AND media_id % 2 = 0 UNION ALL SELECT media_id, 'free:' || artist, 3 FROM media_info WHERE artist IS NOT NULL)
SELECT m.media_id, (SELECT arg_min(link, {'s': strategy, 'l': link}) FROM h WHERE h.media_id = m.media_id) AS link FROM (SELECT DISTINCT media_id FROM media_info) m""")
def c8(spark: SparkSession, d: str) -> DataFrame:
    """Empty links filled by the first strategy that has an answer."""
    m = table(spark, d, "media_info")
    hit = lambda df, link, n: df.select("media_id", link.alias("link"), F.lit(n).alias("strategy"))
    hits = hit(m.where("video_url is not null and media_id % 3 = 0"), F.col("video_url"), 1)
    hits = hits.unionByName(hit(m.where("title is not null and media_id % 2 = 0"), F.concat(F.lit("text:"), "title"), 2)).unionByName(hit(m.where("artist is not null"), F.concat(F.lit("free:"), "artist"), 3))
    best = hits.groupBy("media_id").agg(F.min_by("link", F.struct("strategy", "link")).alias("link"))
    return m.select("media_id").distinct().join(best, "media_id", "left")


@query("c7_verdict_rows", """WITH v AS (SELECT song_id, arg_max(title, {'l': loaded_at, 't': title}) AS title, count(*) AS n FROM ultrastar_values WHERE title IS NOT NULL GROUP BY song_id), x AS (SELECT song_id, lower(trim(title)) AS key, CASE WHEN n > 1 THEN 'timing' ELSE 'lyrics' END AS category FROM v), k AS (SELECT DISTINCT lower(trim(title)) AS key FROM genre_song_fixes WHERE title IS NOT NULL)
SELECT song_id, category FROM x WHERE key NOT IN (SELECT key FROM k)""")
def c7(spark: SparkSession, d: str) -> DataFrame:
    """Report rows of songs that aren't listed yet, from their newest verdict."""
    u = table(spark, d, "ultrastar_values").where("title is not null")
    v = u.groupBy("song_id").agg(F.max_by("title", F.struct("loaded_at", "title")).alias("title"), F.count(F.lit(1)).alias("n")).withColumn("key", F.lower(F.trim("title")))
    listed = table(spark, d, "genre_song_fixes").where("title is not null").select(F.lower(F.trim("title")).alias("key")).distinct()
    return v.join(listed, "key", "left_anti").select("song_id", F.when(F.col("n") > 1, "timing").otherwise("lyrics").alias("category"))


@query("r2_media_info", rf"""WITH {L}, {T_} SELECT song_id, max(value) FILTER (tag = 'TITLE') AS title, max(value) FILTER (tag = 'ARTIST') AS artist, max(try_cast(replace(value, ',', '.') AS DOUBLE)) FILTER (tag = 'BPM') AS bpm, max(value) FILTER (tag = 'YEAR') AS year, max(value) FILTER (tag = 'GENRE') AS genre, max(value) FILTER (tag = 'LANGUAGE') AS lang FROM h GROUP BY song_id""")
def r2(spark: SparkSession, d: str) -> DataFrame:
    """A record of each song's header."""
    t = songs.tags(files(spark, d), "song_id", "text")
    one = lambda tag, name: F.max(F.when(F.col("tag") == tag, F.col("value"))).alias(name)
    bpm = F.max(F.when(F.col("tag") == "BPM", songs.decimal(F.col("value")))).alias("bpm")
    return t.groupBy("song_id").agg(one("TITLE", "title"), one("ARTIST", "artist"), bpm, one("YEAR", "year"), one("GENRE", "genre"), one("LANGUAGE", "lang"))


@query("r5_metadata_precedence", """WITH i AS (SELECT info_id, min(release_year) AS y FROM song_info GROUP BY info_id), m AS (SELECT media_id, min(release_year) AS y FROM media_info GROUP BY media_id) SELECT media_id, CASE WHEN i.y IS NOT NULL THEN 'id' WHEN m.y IS NOT NULL THEN 'search' ELSE 'given' END AS source, CASE WHEN coalesce(i.y, m.y) LIKE '%-%' THEN string_split(coalesce(i.y, m.y), '-')[1] ELSE coalesce(i.y, m.y) END AS year FROM m LEFT JOIN i ON i.info_id = m.media_id""")
def r5(spark: SparkSession, d: str) -> DataFrame:
    """A year by id before one by search; of a date the part before its first hyphen."""
    i = table(spark, d, "song_info").groupBy(F.col("info_id").alias("media_id")).agg(F.min("release_year").alias("a"))
    m = table(spark, d, "media_info").groupBy("media_id").agg(F.min("release_year").alias("b"))
    both = m.join(i, "media_id", "left")
    source = F.when(F.col("a").isNotNull(), "id").when(F.col("b").isNotNull(), "search").otherwise("given")
    return both.select("media_id", source.alias("source"), F.get(F.split(F.coalesce("a", "b"), "-"), 0).alias("year"))


@query("r7_input_kind", r"""WITH x AS (SELECT DISTINCT media_id, CASE media_id % 3 WHEN 0 THEN coalesce(video_url, '') WHEN 1 THEN coalesce(artist, '') || ' - ' || coalesce(title, '') || '.mp3' ELSE coalesce(title, '') || '.txt' END AS path FROM media_info)
SELECT media_id, CASE WHEN lower(path) LIKE '%.txt' THEN 'song' WHEN path LIKE 'https:%' THEN 'link' ELSE 'file' END AS kind, CASE WHEN contains(regexp_replace(path, '\.[^.]*$', ''), ' - ') THEN trim(string_split(regexp_replace(path, '\.[^.]*$', ''), ' - ')[1]) END AS artist FROM x""")
def r7(spark: SparkSession, d: str) -> DataFrame:
    """What an input is, and the artist in a file's name."""
    c = lambda x: F.coalesce(x, F.lit(""))
    path = F.when(F.col("media_id") % 3 == 0, c("video_url")).when(F.col("media_id") % 3 == 1, F.concat(c("artist"), F.lit(" - "), c("title"), F.lit(".mp3"))).otherwise(F.concat(c("title"), F.lit(".txt")))
    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    kind = F.when(F.lower("path").endswith(".txt"), "song").when(F.col("path").startswith("https:"), "link").otherwise("file")
    return table(spark, d, "media_info").select("media_id", path.alias("path")).distinct().select("media_id", kind.alias("kind"), F.when(stem.contains(" - "), F.trim(F.get(F.split(stem, " - "), 0))).alias("artist"))


@query("r14_memoised_lag", "WITH p AS (SELECT user_id % 10 AS a, user_id % 7 AS b, user_id, round(avg(value), 6) AS m FROM events GROUP BY user_id), q AS (SELECT a, b, min(user_id) AS first FROM p GROUP BY ALL) SELECT p.user_id, f.m AS measured FROM p JOIN q USING (a, b) JOIN p f ON f.user_id = q.first")
def r14(spark: SparkSession, d: str) -> DataFrame:
    """A measure taken once for each pair and joined back to all that have it."""
    p = table(spark, d, "events").groupBy("user_id").agg(r6(F.avg("value")).alias("m")).withColumn("a", F.col("user_id") % 10).withColumn("b", F.col("user_id") % 7)
    once = p.groupBy("a", "b").agg(F.min_by("m", "user_id").alias("measured"))
    return p.join(once, ["a", "b"]).select("user_id", "measured")


@query("r27_seconds_of_beats", rf"""WITH {L}, {T_}, g AS (SELECT song_id, max(try_cast(replace(value, ',', '.') AS DOUBLE)) FILTER (tag = 'BPM') AS bpm, coalesce(max(try_cast(replace(value, ',', '.') AS DOUBLE)) FILTER (tag = 'GAP'), 0) AS gap, coalesce(bool_or(tag = 'RELATIVE' AND lower(value) = 'yes'), false) AS relative FROM h GROUP BY song_id)
SELECT DISTINCT n.song_id, n.beat, CASE WHEN NOT g.relative AND g.bpm > 0 THEN round(g.gap / 1000 + n.beat * 60 / (4 * g.bpm), 6) END AS s FROM notes n JOIN g USING (song_id) WHERE n.beat IS NOT NULL""")
def r27(spark: SparkSession, d: str) -> DataFrame:
    """When the table's beats fall by the song's header; nothing for relative beats."""
    t = songs.tags(files(spark, d), "song_id", "text")
    number = lambda tag: F.max(F.when(F.col("tag") == tag, songs.decimal(F.col("value"))))
    g = t.groupBy("song_id").agg(number("BPM").alias("bpm"), F.coalesce(number("GAP"), F.lit(0.0)).alias("gap"), F.coalesce(F.max((F.col("tag") == "RELATIVE") & (F.lower("value") == "yes")), F.lit(False)).alias("relative"))
    n = table(spark, d, "notes").where("beat is not null").select("song_id", "beat").distinct()
    at = F.col("gap") / 1000 + F.col("beat") * 60 / (4 * F.col("bpm"))
    return n.join(g, "song_id").select("song_id", "beat", F.when(~F.col("relative") & (F.col("bpm") > 0), r6(at)).alias("s"))


@query("r1_pitched_words", f"""{WORDS}, p AS (SELECT take_id, seq, word, s, e, (seq * 5) % 12 AS pitch, CASE WHEN seq % 4 = 0 THEN 0.1 ELSE 0.9 END AS sure FROM w WHERE s IS NOT NULL AND e IS NOT NULL), f AS (SELECT *, max(sure > 0.2) OVER (PARTITION BY take_id, word) AS any_sure FROM p), c AS (SELECT take_id, word, pitch, count(*) AS n, min({{'s': s, 'q': seq}}) AS first FROM f WHERE sure > 0.2 OR NOT any_sure GROUP BY ALL)
SELECT take_id, word, arg_min(pitch, {{'n': -n, 'f': first, 'p': pitch}}) AS pitch FROM c GROUP BY ALL""")
def r1(spark: SparkSession, d: str) -> DataFrame:
    """Each word of a take with its most frequent pitch among sure frames (all, if none is sure)."""
    p = words(spark, d).where("s is not null and e is not null and word is not null").select("take_id", "seq", "word", "s", ((F.col("seq") * 5) % 12).alias("pitch"), F.when(F.col("seq") % 4 == 0, 0.1).otherwise(0.9).alias("sure"))
    sure = p.withColumn("any_sure", F.max(F.col("sure") > 0.2).over(Window.partitionBy("take_id", "word"))).where((F.col("sure") > 0.2) | ~F.col("any_sure"))
    counts = sure.groupBy("take_id", "word", "pitch").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("s", "seq")).alias("first"))
    return counts.groupBy("take_id", "word").agg(F.min_by("pitch", F.struct(-F.col("n"), "first", "pitch")).alias("pitch"))


@query("s16_lyrics_input", r"""WITH x AS (SELECT doc_id, doc_id % 2 = 0 AS json, regexp_split_to_array(text, '\n') AS ls FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM x) SELECT doc_id, n::INT AS n, trim(line) AS line FROM l WHERE regexp_matches(line, '[\p{L}\p{N}]')""")
def s16(spark: SparkSession, d: str) -> DataFrame:
    """Lyrics as JSON or as plain lines: what holds a letter or digit is a line."""
    x = table(spark, d, "documents").where("text is not null").withColumn("ls", F.split("text", "\n", -1))
    given = x.withColumn("given", F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.lit("x").alias("source"), F.col("ls").alias("lines")))).otherwise(F.col("text")))
    parsed = F.when(F.col("given").startswith("{\"source\""), F.from_json("given", "source string, lines array<string>")["lines"])
    return texts.lyrics_lines(given, "doc_id", F.coalesce(parsed, F.split("given", "\n", -1)))


@query("s18_marks_file", "SELECT DISTINCT song_id, line_no, note_seq, note_type AS kind, replace(coalesce(trim(word), ''), chr(9), ' ') AS text FROM notes WHERE line_no IS NOT NULL AND note_seq IS NOT NULL")
def s18(spark: SparkSession, d: str) -> DataFrame:
    """Marks written as lines `row.note<TAB>type<TAB>text` and read again."""
    n = table(spark, d, "notes").where("line_no is not null and note_seq is not null").select("song_id", "line_no", "note_seq", F.col("note_type").alias("kind"), F.replace(F.coalesce(F.trim("word"), F.lit("")), F.lit("\t"), F.lit(" ")).alias("text")).distinct()
    row = F.concat_ws("\t", F.concat_ws(".", F.col("line_no").cast("string"), F.col("note_seq").cast("string")), "kind", "text")
    file = n.groupBy("song_id").agg(F.concat(F.lit("band\tB\ntitle\tT\n"), F.array_join(F.array_sort(F.collect_list(row)), "\n")).alias("text"))
    return texts.read_marks(file, "song_id", "text")


@query("s19_word_export", f"{WORDS} SELECT take_id, seq, coalesce(word, '') AS word, s AS start_s, e AS end_s FROM w")
def s19(spark: SparkSession, d: str) -> DataFrame:
    """Words as lines of a CSV export, read again."""
    w = words(spark, d).withColumn("word", F.coalesce("word", F.lit("")))
    line = F.to_csv(F.struct("take_id", "seq", "word", F.col("s").alias("start_s"), F.col("e").alias("end_s")), {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "quoteAll": "true", "escape": "\""})
    back = F.from_csv("line", "take_id long, seq int, word string, start_s double, end_s double", {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "escape": "\""})
    return w.select(line.alias("line")).select(back.alias("r")).select("r.take_id", "r.seq", F.coalesce("r.word", F.lit("")).alias("word"), "r.start_s", "r.end_s")


@query("s27_report_tables", """WITH c AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL) SELECT s AS section, '| priority | orders |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || p || ' | ' || n || ' |', chr(10) ORDER BY p) AS body FROM c GROUP BY s""")
def s27(spark: SparkSession, d: str) -> DataFrame:
    """A table in Markdown for each status."""
    c = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("section"), F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return texts.markdown_tables(c, "section", ["p"], {"priority": F.col("p"), "orders": F.col("n").cast("string")})


@query("s31_zipped_songs", "SELECT song_id, song_id || '.txt' AS name, text FROM song_files WHERE text IS NOT NULL")
def s31(spark: SparkSession, d: str) -> DataFrame:
    """Songs packed as archives with a README, and the song of each taken out."""
    packed = texts.pack(files(spark, d).where("text is not null"), "song_id", "text")
    return texts.song_of_archive(packed, "song_id", "content")


@query("st_log_tail", "SELECT event_type, max(event_id) AS last_id, count(*) AS lines FROM events GROUP BY event_type")
def st_log_tail(spark: SparkSession, d: str) -> DataFrame:
    """Log lines followed as files come in: the last line of each kind and how many there were."""
    stream = streams.read_stream(spark, f"{d}/event[s].parquet").select("event_type", "event_id")
    seen = streams.drain(stream)
    return newest(seen, ["event_type"], ["event_id"]).select("event_type", F.col("event_id").alias("last_id")).join(seen.groupBy("event_type").agg(F.count(F.lit(1)).alias("lines")), "event_type")


@query("pred19_ladder", "SELECT o_orderkey, CASE WHEN o_totalprice - least(0.25 * o_totalprice, 5000) >= 150000 THEN 'large' WHEN o_totalprice - least(0.25 * o_totalprice, 5000) >= 50000 THEN 'medium' ELSE 'small' END AS size FROM orders")
def pred19(spark: SparkSession, d: str) -> DataFrame:
    """A ladder of thresholds over what is left after a capped margin."""
    left = F.col("o_totalprice") - F.least(0.25 * F.col("o_totalprice"), F.lit(5000.0))
    return table(spark, d, "orders").select("o_orderkey", S.ladder(left, [(150000, "large"), (50000, "medium")], "small").alias("size"))
