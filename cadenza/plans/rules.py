"""Queries of rules over lists and states: picks, precedences, comparisons, reports, caches, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.operators import genres as G
from cadenza.operators import joins as J
from cadenza.operators.packed import bare
from cadenza.plans.training_core import packed_genres
from cadenza.session import table
from cadenza.sources import texts
from cadenza.streaming import streams

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


@query("f13_genre_bases")
def f13(spark: SparkSession, d: str) -> DataFrame:
    """Every typed genre in its bases, by the words of the vocabulary and of the library itself."""
    typed = packed_genres(spark, d, 1).select(F.col("piece").alias("genre")).unionByName(table(spark, d, "media_info").select(bare(F.col("genre")).alias("genre"))).where("genre <> ''").groupBy("genre").agg(F.count(F.lit(1)).alias("n"))
    known = G.corpus(table(spark, d, "genre_vocabulary"), "genre", typed, "genre")
    rules = G.Rules(whole={"rockandroll": "Rock and Roll", "hiphop": "Hip-Hop"}, dropped={"easylistening"}, phrases={"videogamemusic": ["soundtrack"]}, merged={"xmas": ["christmas"]})
    return typed.select("genre", "n", F.array_join(G.split_into_bases(F.col("genre"), rules, known), "|").alias("bases"))


@query("r26_usual_spelling", """WITH w AS (SELECT lower(trim(genre)) AS base, trim(genre) AS written, count(*) AS n FROM media_info WHERE trim(genre) <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY n DESC, left(written, 1) = lower(left(written, 1)), written) AS place FROM w) SELECT base, upper(left(written, 1)) || written[2:] AS written FROM r WHERE place = 1""")
def r26(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "media_info").where("trim(genre) <> ''").groupBy(F.lower(F.trim("genre")).alias("base"), F.trim("genre").alias("written")).agg(F.count(F.lit(1)).alias("n"))
    return G.usual_spelling(m, "base", "written", "n")


@query("r25_cluster_override", """WITH g AS (SELECT DISTINCT genre FROM media_info WHERE genre IS NOT NULL), c AS (SELECT lower(genre) AS key, CASE WHEN genre_id % 3 = 0 THEN '-' ELSE genre || ', Base' END AS cell FROM genre_vocabulary WHERE genre_id % 2 = 0)
SELECT g.genre, CASE WHEN c.cell IS NULL THEN lower(g.genre) ELSE array_to_string(list_filter(list_transform(string_split(c.cell, ','), lambda x: trim(x)), lambda x: x <> '' AND x <> '-'), '|') END AS bases FROM g LEFT JOIN c ON c.key = lower(trim(g.genre))""")
def r25(spark: SparkSession, d: str) -> DataFrame:
    """A reviewed cell for a genre comes before the rules; a dash in it drops the genre."""
    clusters = table(spark, d, "genre_vocabulary").where("genre_id % 2 = 0").select(F.lower("genre").alias("key"), F.when(F.col("genre_id") % 3 == 0, "-").otherwise(F.concat("genre", F.lit(", Base"))).alias("cell"))
    g = table(spark, d, "media_info").where("genre is not null").select("genre").distinct().withColumn("key", F.lower(F.trim("genre")))
    kept = F.filter(F.transform(F.split("cell", ","), lambda x: F.trim(x)), lambda x: ~x.isin("", "-"))
    return g.join(J.small(clusters), "key", "left").select("genre", F.when(F.col("cell").isNull(), F.lower("genre")).otherwise(F.array_join(kept, "|")).alias("bases"))


_NAMES = "WITH f AS (SELECT song_id, string_split(file_path, '/')[-1] AS name, (song_id % 7)::INT AS folder FROM song_files)"


@query("pred15_media_pick", f"""{_NAMES}, c AS (SELECT folder, count(*) AS n, max(CASE WHEN name = folder || '.txt' THEN name END) AS exact, min(name) AS any FROM f WHERE name LIKE '%.txt' GROUP BY folder)
SELECT x.folder, CASE WHEN n IS NULL THEN 'none' WHEN exact IS NOT NULL OR n = 1 THEN 'found' ELSE 'ambiguous' END AS status, coalesce(exact, CASE WHEN n = 1 THEN c.any END) AS name FROM (SELECT unnest(range(9))::INT AS folder) x LEFT JOIN c USING (folder)""")
def pred15(spark: SparkSession, d: str) -> DataFrame:
    """Files of folders: the one named like the folder, else the only one of its kind, never a guess."""
    f = table(spark, d, "song_files").select((F.col("song_id") % 7).cast("int").alias("folder"), F.element_at(F.split("file_path", "/"), -1).alias("name"))
    folders = spark.range(9).select(F.col("id").cast("int").alias("folder")).withColumn("stem", F.col("folder").cast("string"))
    return J.pick_file(folders, f, "folder", "stem", "name", [".txt"]).select("folder", "status", "name")


@query("pred16_link_kind", "SELECT media_id, CASE WHEN video_url IS NULL OR lower(trim(video_url)) IN ('', '-', 'skip', 'none', 'x') THEN 'skip' WHEN video_url LIKE 'https://%' THEN 'link' ELSE 'local' END AS kind FROM (SELECT DISTINCT media_id, CASE media_id % 3 WHEN 0 THEN video_url WHEN 1 THEN replace(video_url, 'https:/', '/mnt') ELSE '-' END AS video_url FROM media_info)")
def pred16(spark: SparkSession, d: str) -> DataFrame:
    url = F.when(F.col("media_id") % 3 == 0, F.col("video_url")).when(F.col("media_id") % 3 == 1, F.replace("video_url", F.lit("https:/"), F.lit("/mnt"))).otherwise("-")
    blank = url.isNull() | F.lower(F.trim(url)).isin("", "-", "skip", "none", "x")
    return table(spark, d, "media_info").select("media_id", F.when(blank, "skip").when(url.startswith("https://"), "link").otherwise("local").alias("kind")).distinct()


@query("pred13_damaged", "WITH t AS (SELECT song_id, take_id, max(CASE WHEN NOT isnan(end_s) THEN end_s END) AS z FROM timed_words GROUP BY ALL), s AS (SELECT song_id, max(z) AS whole FROM t GROUP BY song_id) SELECT take_id, coalesce(z < 0.5 * whole, false) AS damaged, coalesce(whole / 60 > 15, false) AS too_long FROM t JOIN s USING (song_id)")
def pred13(spark: SparkSession, d: str) -> DataFrame:
    """Takes less than half as long as their song's longest, and songs of more than a quarter of an hour; unknown lengths pass."""
    t = table(spark, d, "timed_words").groupBy("song_id", "take_id").agg(F.max(F.when(~F.isnan("end_s"), F.col("end_s"))).alias("z"))
    s = t.groupBy("song_id").agg(F.max("z").alias("whole"))
    return t.join(s, "song_id").select("take_id", F.coalesce(F.col("z") < 0.5 * F.col("whole"), F.lit(False)).alias("damaged"), F.coalesce(F.col("whole") / 60 > 15, F.lit(False)).alias("too_long"))


@query("pred18_fit_accepted", "WITH s AS (SELECT take_id, count(confidence) AS n, avg(confidence) AS score, avg((confidence >= 0.5)::INT) AS share FROM timed_words GROUP BY take_id) SELECT take_id, coalesce(n >= 3 AND score >= 0.6 AND share >= 0.4, false) AS fits FROM s")
def pred18(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "timed_words").groupBy("take_id").agg(F.count("confidence").alias("n"), F.avg("confidence").alias("score"), F.avg((F.col("confidence") >= 0.5).cast("double")).alias("share"))
    return s.select("take_id", F.coalesce((F.col("n") >= 3) & (F.col("score") >= 0.6) & (F.col("share") >= 0.4), F.lit(False)).alias("fits"))


@query("pred21_sane_words", """WITH w AS (SELECT take_id, seq, word, start_s AS s, end_s AS e, end_s - start_s AS length, 0.1::DOUBLE + 0.06::DOUBLE * len(coalesce(word, '')) AS own FROM timed_words WHERE NOT isnan(start_s) AND NOT isnan(end_s))
SELECT take_id, seq, count(*) FILTER (NOT (length > greatest(3 * own, own + 2) OR (length < 0.25 * own AND length < 0.1))) AS kept, count(*) AS n FROM w GROUP BY ALL""")
def pred21(spark: SparkSession, d: str) -> DataFrame:
    """Words that last neither far longer than their natural length nor far shorter."""
    length, own = F.col("end_s") - F.col("start_s"), 0.1 + 0.06 * F.length(F.coalesce("word", F.lit("")))
    bad = (length > F.greatest(3 * own, own + 2)) | ((length < 0.25 * own) & (length < 0.1))
    return table(spark, d, "timed_words").where("not isnan(start_s) and not isnan(end_s) and start_s is not null and end_s is not null").groupBy("take_id", "seq").agg(F.count_if(~bad).alias("kept"), F.count(F.lit(1)).alias("n"))


@query("j16_folder_lookup", """WITH f AS (SELECT DISTINCT string_split(file_path, '/')[2] AS folder FROM song_files), w AS (SELECT fix_id, band FROM genre_song_fixes WHERE band IS NOT NULL GROUP BY ALL) SELECT w.fix_id, w.band, f.folder FROM w LEFT JOIN f ON lower(f.folder) = lower(w.band)""")
def j16(spark: SparkSession, d: str) -> DataFrame:
    """The folder of each band, whatever the case."""
    f = table(spark, d, "song_files").select(F.get(F.split("file_path", "/"), 1).alias("folder")).distinct().withColumn("key", F.lower("folder"))
    w = table(spark, d, "genre_song_fixes").where("band is not null").select("fix_id", "band").distinct().withColumn("key", F.lower("band"))
    return w.join(f, "key", "left").select("fix_id", "band", "folder")


@query("c5_precedence", "SELECT DISTINCT song_id, coalesce(nullif(trim(lang), ''), nullif(trim(genre), ''), 'en') AS language FROM ultrastar_values")
def c5(spark: SparkSession, d: str) -> DataFrame:
    """The first that isn't blank of what was forced, what the file says and what was detected."""
    own = lambda c: F.nullif(F.trim(c), F.lit(""))
    return table(spark, d, "ultrastar_values").select("song_id", F.coalesce(own("lang"), own("genre"), F.lit("en")).alias("language")).distinct()


_MARKS = """n AS (SELECT DISTINCT song_id, coalesce(voice, '') AS voice, line_no, note_seq, note_type, word FROM notes WHERE line_no IS NOT NULL AND note_seq IS NOT NULL), m AS (SELECT song_id, voice, line_no, note_seq, CASE note_seq % 3 WHEN 0 THEN '*' WHEN 1 THEN ':' ELSE 'x' END AS want, CASE WHEN note_seq % 5 = 0 THEN 'other' ELSE word END AS says FROM n WHERE note_seq % 2 = 0)"""


@query("c6_marked_types", f"""WITH {_MARKS} SELECT n.song_id, n.voice, n.line_no, n.note_seq, n.note_type AS is, m.want, CASE WHEN m.want NOT IN (':', '*', 'F', 'R', 'G') THEN 'unknown' WHEN trim(n.word) IS DISTINCT FROM trim(m.says) THEN 'mismatch' WHEN n.note_type <> m.want THEN 'write' ELSE 'same' END AS outcome FROM n JOIN m USING (song_id, voice, line_no, note_seq) WHERE n.note_seq % 2 = 0 AND (m.says IS NOT DISTINCT FROM CASE WHEN n.note_seq % 5 = 0 THEN 'other' ELSE n.word END)""")
def c6(spark: SparkSession, d: str) -> DataFrame:
    """Marks that want other note types, against the notes as they are: unknown types and texts that differ are reported, the rest is written or the same."""
    n = table(spark, d, "notes").where("line_no is not null and note_seq is not null").select("song_id", F.coalesce("voice", F.lit("")).alias("voice"), "line_no", "note_seq", "note_type", "word").distinct()
    m = n.where("note_seq % 2 = 0").withColumn("want", F.when(F.col("note_seq") % 3 == 0, "*").when(F.col("note_seq") % 3 == 1, ":").otherwise("x")).withColumn("says", F.when(F.col("note_seq") % 5 == 0, "other").otherwise(F.col("word")))
    outcome = F.when(~F.col("want").isin(":", "*", "F", "R", "G"), "unknown").when(~F.trim("word").eqNullSafe(F.trim("says")), "mismatch").when(F.col("note_type") != F.col("want"), "write").otherwise("same")
    return m.select("song_id", "voice", "line_no", "note_seq", F.col("note_type").alias("is"), "want", outcome.alias("outcome"))


@query("r35_mark_outcomes", f"""WITH {_MARKS}, k AS (SELECT song_id, count(*) AS marks FROM m GROUP BY song_id), l AS (SELECT lower(trim(title)) AS t, count(DISTINCT song_id) AS songs FROM ultrastar_values WHERE title IS NOT NULL GROUP BY 1), u AS (SELECT DISTINCT song_id, title FROM ultrastar_values)
SELECT u.song_id, u.title, CASE WHEN u.title IS NULL OR trim(u.title) = '' THEN 'unnamed' WHEN l.songs > 1 THEN 'several' WHEN k.marks IS NULL THEN 'missing' ELSE 'found' END AS outcome FROM u LEFT JOIN l ON l.t = lower(trim(u.title)) LEFT JOIN k USING (song_id)""")
def r35(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of a title's marks: found, missing, several songs of that title, or no title."""
    n = table(spark, d, "notes").where("line_no is not null and note_seq is not null and note_seq % 2 = 0").select("song_id").distinct().withColumn("marked", F.lit(True))
    u = table(spark, d, "ultrastar_values").select("song_id", "title").distinct().withColumn("key", F.lower(F.trim("title")))
    songs = u.where("title is not null").groupBy("key").agg(F.count_distinct("song_id").alias("songs"))
    both = u.join(songs, "key", "left").join(n, "song_id", "left")
    return both.select("song_id", "title", F.when(F.col("title").isNull() | (F.trim("title") == ""), "unnamed").when(F.col("songs") > 1, "several").when(F.col("marked").isNull(), "missing").otherwise("found").alias("outcome"))


@query("c9_predicted_genres", """WITH v AS (SELECT l_suppkey, l_returnflag AS base, count(DISTINCT l_shipmode) AS n FROM (SELECT l_suppkey, l_returnflag, l_linenumber % 4 AS l_shipmode FROM lineitem) GROUP BY ALL), b AS (SELECT l_suppkey, arg_max(base, {'n': n, 'b': base}) AS voted FROM v GROUP BY l_suppkey), f AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'fixed' END AS fixed FROM supplier)
SELECT s_suppkey, coalesce(fixed, voted) AS genre, CASE WHEN fixed IS NOT NULL THEN 'fix' WHEN voted IS NOT NULL THEN 'votes' END AS source FROM f LEFT JOIN b ON b.l_suppkey = f.s_suppkey""")
def c9(spark: SparkSession, d: str) -> DataFrame:
    """A fix comes before what most sources say."""
    votes = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("base")).agg(F.count_distinct(F.col("l_linenumber") % 4).alias("n"))
    voted = votes.groupBy("l_suppkey").agg(F.max_by("base", F.struct("n", "base")).alias("voted"))
    f = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, "fixed").alias("fixed"))
    both = f.join(voted, f.s_suppkey == voted.l_suppkey, "left")
    return both.select("s_suppkey", F.coalesce("fixed", "voted").alias("genre"), F.when(F.col("fixed").isNotNull(), "fix").when(F.col("voted").isNotNull(), "votes").alias("source"))


@query("c10_local_media", "WITH m AS (SELECT DISTINCT media_id, coalesce(title, 'untitled') AS name FROM media_info), r AS (SELECT media_id, name, row_number() OVER (PARTITION BY lower(name) ORDER BY media_id, name) AS n FROM m) SELECT media_id, CASE WHEN n = 1 THEN name ELSE name || ' (' || n || ')' END AS target FROM r")
def c10(spark: SparkSession, d: str) -> DataFrame:
    """Target names that differ whatever their case: later ones get a number."""
    m = table(spark, d, "media_info").select("media_id", F.coalesce("title", F.lit("untitled")).alias("name")).distinct()
    n = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("media_id", "name"))
    return m.withColumn("n", n).select("media_id", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat("name", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).alias("target"))


@query("r3_end_times", """SELECT song_id, note_seq, beat, CASE WHEN note_type IN (':', '*', 'F', 'R', 'G') THEN round(2.0 + (trunc(beat) + trunc(beat_length)) * 60 / (4 * 250.0), 6) END AS end_s, CASE WHEN note_type NOT IN (':', '*', 'F', 'R', 'G') THEN 'unknown note type ' || note_type END AS problem FROM (SELECT DISTINCT song_id, note_seq, beat, beat_length, CASE WHEN note_seq % 10 = 3 THEN 'X' ELSE note_type END AS note_type FROM notes WHERE beat IS NOT NULL AND beat_length IS NOT NULL)""")
def r3(spark: SparkSession, d: str) -> DataFrame:
    """When notes end; types that aren't known are reported instead."""
    n = table(spark, d, "notes").where("beat is not null and beat_length is not null").select("song_id", "note_seq", "beat", "beat_length", F.when(F.col("note_seq") % 10 == 3, "X").otherwise(F.col("note_type")).alias("note_type")).distinct()
    known = F.col("note_type").isin(":", "*", "F", "R", "G")
    return n.select("song_id", "note_seq", "beat", F.when(known, r6(2.0 + (F.col("beat").cast("int") + F.col("beat_length").cast("int")) * 60 / (4 * 250.0))).alias("end_s"), F.when(~known, F.concat(F.lit("unknown note type "), "note_type")).alias("problem"))


@query("r10_folder_states", """WITH f AS (SELECT song_id % 40 AS folder, song_id, file_path, text FROM song_files), x AS (SELECT folder, file_path, regexp_matches(text, '(?m)^P\\s*\\d') AS duet, regexp_matches(text, '(?im)^[\\s\\x{FEFF}]*#TITLE[ \\t]*:[ \\t]*\\S') AND regexp_matches(text, '(?im)^[\\s\\x{FEFF}]*#ARTIST[ \\t]*:[ \\t]*\\S') AS valid FROM f WHERE text IS NOT NULL)
SELECT folder, bool_and(duet) AS only_duets, min(file_path) FILTER (valid) AS first_song FROM x GROUP BY folder""")
def r10(spark: SparkSession, d: str) -> DataFrame:
    """Folders with nothing but duets, and the first valid song of each."""
    from cadenza.sources.songs import is_song

    f = table(spark, d, "song_files").where("text is not null").select((F.col("song_id") % 40).alias("folder"), "file_path", F.col("text").rlike(r"(?m)^P\s*\d").alias("duet"), is_song(F.col("text")).alias("valid"))
    return f.groupBy("folder").agg(F.min("duet").alias("only_duets"), F.min(F.when(F.col("valid"), F.col("file_path"))).alias("first_song"))


@query("r24_source_cascade", """WITH c AS (SELECT media_id, 'synced' AS source, 0.9 AS sure, 1 AS place FROM media_info WHERE bpm > 250 UNION ALL SELECT media_id, 'plain', 0.7, 2 FROM media_info WHERE video_url IS NOT NULL UNION ALL SELECT media_id, 'guess', (media_id % 10) / 10.0, 3 FROM media_info), g AS (SELECT DISTINCT media_id, source, sure, place FROM c WHERE sure >= 0.5)
SELECT media_id, arg_min(source, place) AS source, arg_min(sure, place)::DOUBLE AS sure FROM g GROUP BY media_id""")
def r24(spark: SparkSession, d: str) -> DataFrame:
    """The first source in order that is sure enough."""
    m = table(spark, d, "media_info")
    offer = lambda df, source, sure, place: df.select("media_id", F.lit(source).alias("source"), sure.cast("double").alias("sure"), F.lit(place).alias("place"))
    offers = offer(m.where("bpm > 250"), "synced", F.lit(0.9), 1).unionByName(offer(m.where("video_url is not null"), "plain", F.lit(0.7), 2)).unionByName(offer(m, "guess", (F.col("media_id") % 10) / 10.0, 3))
    return offers.where("sure >= 0.5").groupBy("media_id").agg(F.min_by("source", "place").alias("source"), F.min_by("sure", "place").alias("sure"))


@query("r29_report_rows", "SELECT DISTINCT fix_id, coalesce(nullif(trim(band), ''), 'unknown') AS band, coalesce(nullif(trim(note), ''), '-') AS note, coalesce(nullif(trim(genre), ''), 'default') AS genre FROM genre_song_fixes")
def r29(spark: SparkSession, d: str) -> DataFrame:
    own = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other)).alias(c)
    return table(spark, d, "genre_song_fixes").select("fix_id", own("band", "unknown"), own("note", "-"), own("genre", "default")).distinct()


@query("r30_last_of_the_best", "SELECT l_orderkey, arg_max(l_quantity, {'s': l_discount, 'p': l_linenumber, 'k': l_partkey, 'q': l_quantity}) AS quantity FROM lineitem WHERE l_discount >= 0.05 GROUP BY l_orderkey")
def r30(spark: SparkSession, d: str) -> DataFrame:
    """The value of the best score that is good enough; of equal ones the last."""
    return table(spark, d, "lineitem").where("l_discount >= 0.05").groupBy("l_orderkey").agg(F.max_by("l_quantity", F.struct("l_discount", "l_linenumber", "l_partkey", "l_quantity")).alias("quantity"))


@query("f26_stale", "SELECT info_id, max((SELECT max(loaded_at) FROM song_info) - loaded_at > INTERVAL 30 DAY) AS stale FROM song_info GROUP BY info_id")
def f26(spark: SparkSession, d: str) -> DataFrame:
    """Rows more than thirty days older than the newest of all."""
    s = table(spark, d, "song_info").select("info_id", F.col("loaded_at").cast("timestamp").alias("at"))
    newest = s.agg(F.max("at").alias("newest")).first()["newest"]
    return s.groupBy("info_id").agg(F.max(F.lit(newest) - F.col("at") > F.expr("INTERVAL 30 DAYS")).alias("stale"))


@query("s32_cached_answers", """WITH c AS (SELECT DISTINCT info_id, arg_max(genres, {'l': loaded_at, 'g': genres}) OVER (PARTITION BY info_id) AS genres FROM song_info WHERE genres IS NOT NULL) SELECT DISTINCT m.info_id, c.genres, c.genres IS NOT NULL AS hit FROM song_info m LEFT JOIN c USING (info_id)""")
def s32(spark: SparkSession, d: str) -> DataFrame:
    """A cache of answers as JSON lines: the newest of each key is used, failures (nulls) aren't kept."""
    s = table(spark, d, "song_info")
    line = F.to_json(F.struct(F.col("info_id").alias("key"), F.col("genres").alias("answer")))
    stored = s.where("genres is not null").select("info_id", "loaded_at", "genres", line.alias("json"))
    read = stored.select(F.from_json("json", "key long, answer string").alias("r"), "loaded_at").select("r.*", "loaded_at").groupBy("key").agg(F.max_by("answer", F.struct("loaded_at", "answer")).alias("answer"))
    keys = s.select("info_id").distinct()
    return keys.join(read, keys.info_id == read.key, "left").select("info_id", F.col("answer").alias("genres"), F.col("answer").isNotNull().alias("hit"))


@query("f35_with_defaults", """SELECT event_id, coalesce(json_extract_string(props, '$.k')::INT, -1) AS k, 'none' AS word, 1.0::DOUBLE AS sure FROM events""")
def f35(spark: SparkSession, d: str) -> DataFrame:
    """Records from JSON with defaults for what they lack."""
    r = F.from_json("props", "k int, word string, sure double")
    return table(spark, d, "events").select("event_id", F.coalesce(r["k"], F.lit(-1)).alias("k"), F.coalesce(r["word"], F.lit("none")).alias("word"), F.coalesce(r["sure"], F.lit(1.0)).alias("sure"))


@query("f36_nested_releases", """WITH m AS (SELECT DISTINCT artist, media_id, genre, release_year FROM media_info WHERE artist IS NOT NULL) SELECT artist, count(*) FILTER (regexp_full_match(release_year, '\\d{4}')) AS dated, min(release_year) FILTER (regexp_full_match(release_year, '\\d{4}')) AS first_year, coalesce(string_agg(DISTINCT lower(genre), ',' ORDER BY lower(genre)) FILTER (genre IS NOT NULL), '') AS genres FROM m GROUP BY artist""")
def f36(spark: SparkSession, d: str) -> DataFrame:
    """An artist's releases nested in one row, walked by array functions."""
    releases = F.collect_set(F.struct("media_id", "genre", "release_year")).alias("of")
    nested = table(spark, d, "media_info").where("artist is not null").groupBy("artist").agg(releases)
    dated = F.filter("of", lambda x: x["release_year"].rlike(r"^\d{4}$"))
    genres = F.array_sort(F.array_distinct(F.transform(F.filter("of", lambda x: x["genre"].isNotNull()), lambda x: F.lower(x["genre"]))))
    return nested.select("artist", F.size(dated).cast("long").alias("dated"), F.array_min(F.transform(dated, lambda x: x["release_year"])).alias("first_year"), F.array_join(genres, ",").alias("genres"))


@query("a21_genre_summary", "SELECT count(*) AS rows, count(*) FILTER (genre IS NULL OR trim(genre) = '') AS blank, count(*) FILTER (lower(trim(genre)) IN ('unknown', 'no idea', 'other', 'none', 'misc')) AS placeholders, count(DISTINCT lower(trim(genre))) AS spellings, count(*) FILTER (contains(genre, '-')) AS hyphened FROM media_info")
def a21(spark: SparkSession, d: str) -> DataFrame:
    g = F.lower(F.trim("genre"))
    return table(spark, d, "media_info").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("genre").isNull() | (F.trim("genre") == "")).alias("blank"), F.count_if(g.isin("unknown", "no idea", "other", "none", "misc")).alias("placeholders"), F.count_distinct(g).alias("spellings"), F.count_if(F.col("genre").contains("-")).alias("hyphened")
    )


@query("s10_cells", r"SELECT DISTINCT fix_id, regexp_replace(coalesce(band, ''), '[\t\r\n]+', ' ', 'g') AS band, regexp_replace(coalesce(note, ''), '[\t\r\n]+', ' ', 'g') AS note FROM genre_song_fixes")
def s10(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as lines of tab-separated cells and read again: empty cells stay."""
    cell = lambda c: texts.tsv_cell(F.coalesce(c, F.lit("")))
    line = F.concat_ws("\t", F.col("fix_id").cast("string"), cell("band"), cell("note"))
    parts = F.split(F.col("line"), "\t", -1)
    return table(spark, d, "genre_song_fixes").select(line.alias("line")).distinct().select(F.get(parts, 0).cast("long").alias("fix_id"), F.get(parts, 1).alias("band"), F.get(parts, 2).alias("note"))


@query("s11_genre_edits", "SELECT song_id, regexp_extract(file_path, '^(.*)/[^/]+$', 1) AS folder, regexp_extract(file_path, '([^/]+)$', 1) AS file, 'Polka' AS genres FROM song_files WHERE song_id % 2 = 0")
def s11(spark: SparkSession, d: str) -> DataFrame:
    """An export of genre edits, half of it without a tab, paths with backslashes."""
    f = table(spark, d, "song_files")
    line = F.concat(F.replace("file_path", F.lit("/"), F.lit("\\")), F.when(F.col("song_id") % 2 == 0, "\tPolka ").otherwise(""))
    edits = texts.read_genre_edits(f.select(line.alias("line")), "line")
    paths = f.select("song_id", F.regexp_extract("file_path", "^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("file_path", "([^/]+)$", 1).alias("file"))
    return edits.join(paths, ["folder", "file"]).select("song_id", "folder", "file", "genres")


@query("s13_state_after_crash", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS status, (CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::INT AS failures FROM orders")
def s13(spark: SparkSession, d: str) -> DataFrame:
    """A state as JSON read back: what was running when the process ended has failed; what can't be read is left out."""
    state = table(spark, d, "orders").select(F.to_json(F.struct("o_orderkey", F.col("o_orderstatus").alias("status"))).alias("json")).unionByName(spark.createDataFrame([("{broken",)], "json string"))
    r = state.select(F.from_json("json", "o_orderkey long, status string").alias("r")).select("r.*").where("o_orderkey is not null")
    running = F.col("status") == "P"
    return r.select("o_orderkey", F.when(running, "F").otherwise(F.col("status")).alias("status"), running.cast("int").alias("failures"))


@query("s17_anchors", "SELECT DISTINCT take_id, CASE WHEN max(s) OVER (PARTITION BY take_id) >= 0 THEN 'ok' END AS state, count(*) OVER (PARTITION BY take_id) AS anchors FROM (SELECT take_id, floor(start_s) AS s FROM timed_words WHERE start_s >= 0 AND NOT isnan(start_s) GROUP BY take_id, floor(start_s))")
def s17(spark: SparkSession, d: str) -> DataFrame:
    """Anchor files of takes, a line for each second with a word: times rise and none is a problem."""
    t = table(spark, d, "timed_words").where("start_s >= 0 and not isnan(start_s)").select("take_id", F.floor("start_s").alias("s")).distinct()
    minute = F.concat((F.floor(F.col("s") / 60)).cast("string"), F.lit(":"), F.lpad((F.col("s") % 60).cast("string"), 2, "0"), F.lit(" | line"))
    text = t.groupBy("take_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", minute.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    read = texts.read_anchors(text, "take_id", "text")
    return read.groupBy("take_id").agg(F.when(F.max("problem").isNull(), "ok").alias("state"), F.count(F.lit(1)).alias("anchors"))


@query("s29_mounts", "SELECT DISTINCT '//host/' || replace(artist, chr(9), ' ') AS source, '/mnt/' || replace(artist, chr(9), ' ') AS target FROM media_info WHERE artist IS NOT NULL AND NOT contains(artist, chr(92))")
def s29(spark: SparkSession, d: str) -> DataFrame:
    """A mount table with blanks escaped."""
    a = table(spark, d, "media_info").where("artist is not null").where(~F.col("artist").contains("\\")).select(F.replace(F.replace("artist", F.lit("\t"), F.lit(" ")), F.lit(" "), F.lit("\\040")).alias("a")).distinct()
    return texts.read_mounts(a.select(F.concat(F.lit("//host/"), "a", F.lit(" /mnt/"), "a", F.lit(" cifs rw 0 0")).alias("l")), "l").select("source", "target")


@query("s28_last_error", "SELECT user_id, arg_max(event_type || ' error at ' || event_id, {'t': ts, 'i': event_id}) FILTER (event_type = 'error') AS last_error, arg_max(event_id, {'t': ts, 'i': event_id}) FILTER (event_type = 'purchase')::VARCHAR AS done FROM events GROUP BY user_id")
def s28(spark: SparkSession, d: str) -> DataFrame:
    """Logs by user: the marks of the last DONE line and the last line with an error."""
    e = table(spark, d, "events")
    line = F.when(F.col("event_type") == "error", F.concat("event_type", F.lit(" error at "), F.col("event_id").cast("string"))).when(F.col("event_type") == "purchase", F.concat(F.lit("DONE id="), F.col("event_id").cast("string"))).otherwise(F.col("event_type"))
    log = texts.read_log(e.select("user_id", F.struct("ts", "event_id").alias("at"), line.alias("line")), "user_id", "at", "line", "DONE")
    return log.select("user_id", "last_error", F.col("marks")["id"].alias("done"))


@query("st_sliding", "WITH w AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL (6 * k) HOUR AS start FROM events, (SELECT unnest([0, 1, 2, 3]) AS k)) SELECT start, start + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n FROM w GROUP BY ALL HAVING start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def st_sliding(spark: SparkSession, d: str) -> DataFrame:
    stream = streams.read_stream(spark, f"{d}/event[s].parquet").select("event_type", F.col("ts").cast("timestamp").alias("at"))
    return streams.drain(streams.sliding(stream, "at", "1 day", "6 hours", "1 hour", ["event_type"]))


@query("st_dashboard", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_F, count(*) FILTER (o_orderstatus = 'O') AS n_O, count(*) AS total FROM orders GROUP BY o_orderpriority")
def st_dashboard(spark: SparkSession, d: str) -> DataFrame:
    stream = streams.read_stream(spark, f"{d}/order[s].parquet").select("o_orderpriority", "o_orderstatus")
    return streams.dashboard(stream, "o_orderpriority", "o_orderstatus", ["F", "O"])


@query("st_best_of_tries", "SELECT user_id, arg_max(event_id, {'v': value, 'i': event_id}) AS event_id, max(value) AS value FROM events WHERE value IS NOT NULL GROUP BY user_id")
def st_best(spark: SparkSession, d: str) -> DataFrame:
    """Of several tries the one that got furthest."""
    return table(spark, d, "events").where("value is not null").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("event_id"), F.max("value").alias("value"))
