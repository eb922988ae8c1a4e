"""Queries of lyrics against takes: forced alignment, missing lines, refinement, what is heard, who sings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import similarity
from cadenza.functions.scalars import clock, key_values
from cadenza.kernels import align, lyrics, signal
from cadenza.operators import joins as J
from cadenza.plans.kernels import TAKE, sung_words
from cadenza.plans.sequences import WORDS, words
from cadenza.session import table

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


def numbered_words(spark: SparkSession, d: str) -> DataFrame:
    """The words of each take numbered from 0, ten to a line."""
    w = words(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("take_id").orderBy("seq", "word", "s", "e")) - 1)
    return w.select("take_id", "n", F.floor(F.col("n") / 10).cast("int").alias("line"), F.coalesce("word", F.lit("")).alias("word"), "s", "e")


@query("k5_forced_alignment", f"{WORDS}, n AS (SELECT take_id, row_number() OVER (PARTITION BY take_id ORDER BY seq, word, s, e) - 1 AS n FROM w) SELECT take_id, n AS token_no, 3 * n AS first, 3 * n + 1 AS last, 0.9 AS probability FROM n")
def k5(spark: SparkSession, d: str) -> DataFrame:
    """Emissions in which each word's token shows for two frames and a blank for one, aligned with end penalty, fillers and skips allowed: every word where it was put."""
    n = numbered_words(spark, d)
    token = (F.col("n") % 7 + 1).cast("int")
    row = lambda shown: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.log(F.when(c == shown, 0.9).otherwise(0.1 / 7)))
    frames = n.select("take_id", F.posexplode(F.array(row(token), row(token), row(F.lit(0)))).alias("k", "logp"), "n").select("take_id", (F.col("n") * 3 + F.col("k")).alias("frame"), "logp")
    targets = n.select("take_id", "line", F.col("n").alias("word"), F.col("n").alias("token_no"), token.alias("token"))
    return signal.align_tokens(frames, targets, "take_id", filler_beta=0.5, filler_enter=4.0, end_penalty=2.0).select("take_id", "token_no", "first", "last", r6("probability").alias("probability"))


@query("k4_missing_lines")
def k4(spark: SparkSession, d: str) -> DataFrame:
    """What takes hold beyond every other line of the song's file."""
    notes = table(spark, d, "notes").where("word is not null and trim(word) <> '~' and line_no is not null").select("song_id", "line_no", "note_seq", "word").distinct()
    lines = notes.where("line_no % 2 = 0").select("song_id", F.col("line_no").alias("line"), F.col("note_seq").alias("n"), F.trim("word").alias("word"))
    heard = table(spark, d, "timed_words").where("word is not null").select("song_id", "take_id", F.col("seq").alias("n"), F.trim("word").alias("word")).distinct()
    takes = heard.select("song_id", "take_id").distinct()
    return lyrics.propose_lines(lines.join(takes, "song_id"), heard, ["song_id", "take_id"], "line", "n", "word")


@query("k6_pieces_between_anchors", f"""{WORDS}, n AS (SELECT take_id, s, row_number() OVER (PARTITION BY take_id ORDER BY seq, word, s, e) - 1 AS n FROM w), a AS (SELECT take_id, n, s FROM n WHERE s IS NOT NULL AND n % 20 = 10), c AS (SELECT take_id, count(*) AS m, coalesce(max(s), 0) AS fin FROM n GROUP BY take_id),
x AS (SELECT take_id, 0 AS n, 0.0 AS s FROM c UNION ALL SELECT take_id, n, s FROM a UNION ALL SELECT take_id, m, fin FROM c), y AS (SELECT *, lead(n) OVER o AS z, lead(s) OVER o AS t FROM x WINDOW o AS (PARTITION BY take_id ORDER BY n))
SELECT take_id, n AS from_word, z AS to_word, round(s, 6) AS from_s, round(t, 6) AS to_s FROM y WHERE z > n""")
def k6(spark: SparkSession, d: str) -> DataFrame:
    """Takes cut at every twentieth word with a time: the pieces that are aligned one by one."""
    n = numbered_words(spark, d)
    ends = n.groupBy("take_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("s"), F.lit(0.0)).alias("s"))
    cuts = n.where("s is not null and n % 20 = 10").select("take_id", "n", "s").unionByName(ends.select("take_id", "n", "s")).unionByName(ends.select("take_id", F.lit(0).alias("n"), F.lit(0.0).alias("s")))
    w = Window.partitionBy("take_id").orderBy("n")
    return cuts.select("take_id", F.col("n").alias("from_word"), F.lead("n").over(w).alias("to_word"), r6("s").alias("from_s"), r6(F.lead("s").over(w)).alias("to_s")).where("to_word > from_word")


@query("k8_refined_times")
def k8(spark: SparkSession, d: str) -> DataFrame:
    """Words far from the rest of their line put back beside it."""
    n = numbered_words(spark, d).withColumn("score", F.lit(0.5))
    return lyrics.refine_times(n, ["take_id"], "line", "n", "word", "s", "e", "score")


@query("k10_held_pitches")
def k10(spark: SparkSession, d: str) -> DataFrame:
    """Each voice as a pitch track of eight frames to a beat, in stretches of a hundred beats."""
    n = table(spark, d, "notes").where("beat_length > 0 and pitch is not null and beat >= 0").select("song_id", F.coalesce("voice", F.lit("")).alias("voice"), "beat", "beat_length", "pitch").distinct()
    frame = n.withColumn("f", F.explode(F.sequence(F.lit(0), (F.least("beat_length", F.lit(200)) * 8).cast("int") - 1)))
    track = frame.select("song_id", "voice", F.floor(F.col("beat") / 100).alias("stretch"), (F.col("beat") * 8 + F.col("f")).alias("i"), (F.lit(440.0) * F.pow(F.lit(2.0), (F.col("pitch") - 21) / 12.0)).alias("hz"))
    one = track.groupBy("song_id", "voice", "stretch", "i").agg(F.max("hz").alias("hz")).withColumn("at", F.col("i") * 0.016).withColumn("sure", F.lit(0.9))
    return signal.held_pitches(one, ["song_id", "voice", "stretch"], "at", "hz", "sure")


@query("k15_recording_lag")
def k15(spark: SparkSession, d: str) -> DataFrame:
    """A user's values as a recording, four samples to a frame, against themselves three frames later, by their onsets."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("i", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id"))).where("n >= 40")
    loud = F.coalesce("value", F.lit(0.0)) * F.when(F.xxhash64("user_id", F.floor((F.col("i") - 1) / 4)) % 3 == 0, 100.0).otherwise(1.0)
    e = e.withColumn("a", loud)
    e = e.withColumn("v", F.coalesce(F.lag("a", 12).over(w), F.lit(30.0)))
    return signal.find_lag(e, ["user_id"], "i", "a", "v", 8, frame=4).select("user_id", F.round("lag").alias("lag"))


@query("k16_anchored_voices")
def k16(spark: SparkSession, d: str) -> DataFrame:
    """Vectors in two voices, of which every tenth is known by its label."""
    e = table(spark, d, "embeddings").withColumn("part", F.col("vec_id") % 20).withColumn("fixed", F.when(F.floor(F.col("vec_id") / 20) % 10 == 0, F.col("label") % 2))
    return signal.assign_voices(e, ["part"], "vec_id", "embedding", "fixed").select("part", "vec_id", "voice", r6("separation").alias("separation"))


@query("a16_lines_heard")
def a16(spark: SparkSession, d: str) -> DataFrame:
    """For each line of a voice and take: the share of its words heard in order, when the first is, and whether half of it is."""
    left, right = sung_words(spark, d)
    notes = table(spark, d, "notes").where("word is not null and trim(word) <> '~'").select("song_id", F.coalesce("voice", F.lit("P1")).alias("voice"), "line_no", "note_seq", F.lower(F.trim("word")).alias("word")).distinct()
    line = notes.select("song_id", "voice", F.row_number().over(Window.partitionBy("song_id", "voice").orderBy("line_no", "note_seq", "word")).alias("n"), "line_no")
    heard = align.align(left, right, TAKE, "n", "word").select(*TAKE, F.col("left_no").alias("n"), F.col("right_no").alias("at"))
    each = left.join(line, ["song_id", "voice", "n"]).join(heard, [*TAKE, "n"], "left")
    share = F.avg(F.col("at").isNotNull().cast("double"))
    return each.groupBy(*TAKE, "line_no").agg(r6(share).alias("share"), F.min("at").alias("first_heard"), (share >= 0.5).alias("heard"))


@query("r8_review_note", f"""{WORDS}, t AS (SELECT take_id, avg((e IS NOT NULL)::INT) AS heard, max(e) AS ends FROM w GROUP BY take_id)
SELECT take_id, CASE WHEN heard < 0.99 THEN printf('%d', round_even(heard * 100, 0)::BIGINT) || ' % heard' || CASE WHEN ends >= 0 THEN ', singing ends at ' || (floor(ends)::BIGINT // 60) || ':' || lpad((floor(ends)::BIGINT % 60)::VARCHAR, 2, '0') ELSE '' END END AS note FROM t""")
def r8(spark: SparkSession, d: str) -> DataFrame:
    """A note on takes of which words have no time."""
    t = words(spark, d).groupBy("take_id").agg(F.avg(F.col("e").isNotNull().cast("double")).alias("heard"), F.max("e").alias("ends"))
    note = F.concat(F.bround(F.col("heard") * 100).cast("long").cast("string"), F.lit(" % heard"), F.when(F.col("ends") >= 0, F.concat(F.lit(", singing ends at "), clock(F.col("ends")))).otherwise(""))
    return t.select("take_id", F.when(F.col("heard") < 0.99, note).alias("note"))


@query("j12_latest_places", """WITH n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), a AS (SELECT user_id, max(i) FILTER (event_type = 'purchase') AS p FROM n GROUP BY user_id), b AS (SELECT n.user_id, any_value(p) AS p, max(i) FILTER (event_type = 'view' AND i < p) AS v FROM n JOIN a USING (user_id) GROUP BY n.user_id)
SELECT n.user_id, max(i) FILTER (event_type = 'click' AND i < v)::INT AS click, any_value(v)::INT AS view, any_value(p)::INT AS purchase FROM n JOIN b USING (user_id) GROUP BY n.user_id HAVING max(i) FILTER (event_type = 'click' AND i < v) IS NOT NULL""")
def j12(spark: SparkSession, d: str) -> DataFrame:
    """The last click before the last view before the last purchase of each user: running maxima from the last step to the first, no join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    all_of = Window.partitionBy("user_id")
    n = table(spark, d, "events").select("user_id", "event_type", (F.row_number().over(w) - 1).alias("i"))
    limit = F.lit(1 << 30)
    for step in ("purchase", "view", "click"):
        n = n.withColumn(step, F.max(F.when((F.col("event_type") == step) & (F.col("i") < limit), F.col("i"))).over(all_of))
        limit = F.col(step)
    return n.where("click is not null").select("user_id", *[F.col(c).cast("int").alias(c) for c in ("click", "view", "purchase")]).distinct()


@query("j18_takes_compared")
def j18(spark: SparkSession, d: str) -> DataFrame:
    """Each take against the first of its song by equal stretches of words: how many words meet, the median shift, the share within 0.3 s; nulls where nothing meets."""
    w = table(spark, d, "timed_words").select("song_id", "take_id", "seq", F.lower(F.trim("word")).alias("word"), F.when(~F.isnan("start_s"), F.col("start_s")).alias("s")).where("word is not null").distinct()
    n = w.withColumn("n", F.row_number().over(Window.partitionBy("song_id", "take_id").orderBy("seq", "word", "s"))).withColumn("first", F.min("take_id").over(Window.partitionBy("song_id")))
    other = n.where("take_id <> first").select("song_id", "take_id", "n", "word", "s")
    base = n.where("take_id = first").select("song_id", F.col("n").alias("n"), "word", "s")
    left = base.join(other.select("song_id", "take_id").distinct(), "song_id").select("song_id", "take_id", "n", "word", "s")
    pairs = align.align(left, other, ["song_id", "take_id"], "n", "word", "blocks")
    at = lambda df, name, no: df.select("song_id", "take_id", F.col("n").alias(no), F.col("s").alias(name))
    both = pairs.join(at(left, "a", "left_no"), ["song_id", "take_id", "left_no"]).join(at(other, "b", "right_no"), ["song_id", "take_id", "right_no"]).withColumn("shift", F.abs(F.col("b") - F.col("a")))
    found = both.groupBy("song_id", "take_id").agg(F.count(F.lit(1)).alias("words"), r6(F.median("shift")).alias("median_shift"), r6(F.avg((F.col("shift") <= 0.3 + 1e-9).cast("double"))).alias("within"))
    return other.select("song_id", "take_id").distinct().join(found, ["song_id", "take_id"], "left")


@query("j19_cheapest_hit")
def j19(spark: SparkSession, d: str) -> DataFrame:
    """For each fix the medium of its act and title (both ratios 0.8 or more) that has a link first, then the nearest tempo to 200, then the smallest id."""
    f = table(spark, d, "genre_song_fixes").select("fix_id", F.col("band").alias("artist"), "title").dropDuplicates(["fix_id"])
    m = table(spark, d, "media_info").where("artist is not null and media_id is not null").dropDuplicates(["media_id"])
    m = m.select("media_id", "artist", "title", F.col("video_url").isNull().alias("unlinked"), F.abs(F.coalesce("bpm", F.lit(0.0)) - 200).alias("away"))
    return similarity.fuzzy_first(f, m, "fix_id", ["artist", "title"], ["unlinked", "away", "media_id"], least=0.8).select("fix_id", "media_id")


@query("k17_singers", """WITH l AS (SELECT vec_id, vec_id % 20 AS part, CASE vec_id % 7 WHEN 0 THEN 'P1' WHEN 1 THEN 'both' END AS mark, CASE WHEN vec_id % 5 = 0 THEN 'Ann' WHEN vec_id % 5 = 1 THEN 'Bo' END AS header, label % 2 AS voice FROM embeddings),
s AS (SELECT *, CASE WHEN mark IS NOT NULL THEN mark WHEN header = 'Ann' THEN 'P1' WHEN header = 'Bo' THEN 'P2' WHEN voice = 1 THEN 'P2' ELSE 'P1' END AS singer, CASE WHEN mark IS NOT NULL THEN 'marks' WHEN header IS NOT NULL THEN 'header' ELSE 'voice' END AS source FROM l),
f AS (SELECT part, arg_min(singer, vec_id) FILTER (singer <> 'both') AS first, bool_or(mark IS NOT NULL) AS marked FROM s GROUP BY part)
SELECT vec_id, CASE WHEN NOT f.marked AND f.first = 'P2' THEN CASE singer WHEN 'P1' THEN 'P2' WHEN 'P2' THEN 'P1' ELSE singer END ELSE singer END AS singer, source FROM s JOIN f USING (part)""")
def k17(spark: SparkSession, d: str) -> DataFrame:
    """Who sings each line: its mark before the header's name before its voice; without any mark the first solo line is P1's."""
    e = table(spark, d, "embeddings").withColumn("part", F.col("vec_id") % 20)
    e = e.withColumn("mark", F.when(F.col("vec_id") % 7 == 0, "P1").when(F.col("vec_id") % 7 == 1, "both")).withColumn("header", F.when(F.col("vec_id") % 5 == 0, "Ann").when(F.col("vec_id") % 5 == 1, "Bo"))
    return J.singers(e, ["part"], "vec_id", "mark", "header", ("Ann", "Bo"), F.col("label") % 2).select("vec_id", "singer", "source")


@query("a22_song_names", """WITH n AS (SELECT user_id, event_type AS name, count(*) AS n, min({'t': ts, 'i': event_id}) AS first FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS place FROM n) SELECT user_id, max(name) FILTER (place = 1) AS one, max(name) FILTER (place = 2) AS two FROM r GROUP BY user_id""")
def a22(spark: SparkSession, d: str) -> DataFrame:
    """The two names used most, of equally frequent ones the first seen."""
    n = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "event_id")).alias("first"))
    ranked = n.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "name"))).alias("of"))
    return ranked.select("user_id", F.get("of", 0)["name"].alias("one"), F.get("of", 1)["name"].alias("two"))


@query("r16_nested_marks", """SELECT event_id, event_type AS kind, json_extract_string(props, '$.k') AS k FROM events WHERE props IS NOT NULL""")
def r16(spark: SparkSession, d: str) -> DataFrame:
    """Log lines with a map in a mark: `DONE assign=kind:view,k:5`."""
    line = F.concat(F.lit("DONE n=1 assign=kind:"), "event_type", F.lit(",k:"), F.get_json_object("props", "$.k"))
    inner = F.str_to_map(key_values(line)["assign"], F.lit(","), F.lit(":"))
    return table(spark, d, "events").where("props is not null").select("event_id", inner["kind"].alias("kind"), inner["k"].alias("k"))


@query("r21_filler_notes", f"""{WORDS}, n AS (SELECT take_id, word, s, e, row_number() OVER (PARTITION BY take_id ORDER BY seq, word, s, e) - 1 AS n FROM w), l AS (SELECT take_id, n // 10 AS line, min(s) AS a, max(e) AS z, string_agg(coalesce(word, ''), ' ' ORDER BY n) FILTER (n % 10 < 5) AS head, count(*) AS m FROM n GROUP BY ALL), g AS (SELECT *, lag(z) OVER (PARTITION BY take_id ORDER BY line) AS before FROM l)
SELECT take_id, line::INT AS line, round(before, 6) AS from_s, round(a, 6) AS to_s, head || CASE WHEN m > 5 THEN '...' ELSE '' END AS text FROM g WHERE a - before >= 2""")
def r21(spark: SparkSession, d: str) -> DataFrame:
    """Pauses of two seconds and more before a line, with its first five words."""
    l = numbered_words(spark, d).groupBy("take_id", "line").agg(F.min("s").alias("a"), F.max("e").alias("z"), F.array_sort(F.collect_list(F.struct("n", "word"))).alias("of"))  # noqa: E741
    g = l.withColumn("before", F.lag("z").over(Window.partitionBy("take_id").orderBy("line")))
    text = F.concat(F.array_join(F.transform(F.slice("of", 1, 5), lambda x: x["word"]), " "), F.when(F.size("of") > 5, "...").otherwise(""))
    return g.where("a - before >= 2").select("take_id", "line", r6("before").alias("from_s"), r6("a").alias("to_s"), text.alias("text"))
