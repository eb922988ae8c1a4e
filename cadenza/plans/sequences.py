"""Queries of the window, aggregate and interval operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.operators import aggregates as A
from cadenza.operators import windows as W
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


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


ORDER = ["ts", "event_id"]
r6 = lambda c: F.round(c, 6)
EV = "WITH e AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events)"
OV = "PARTITION BY user_id ORDER BY ts, event_id"


@query("w1_rolling_median", f"SELECT event_id, round(median(value) OVER ({OV} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS median FROM events")
def w1(spark: SparkSession, d: str) -> DataFrame:
    return W.rolling_median(events(spark, d), ["user_id"], ORDER, "value", 5).select("event_id", r6("median").alias("median"))


@query("w2_gaps", f"{EV} SELECT event_id, round(t - lag(t) OVER ({OV}), 6) AS gap_before, round(lead(t) OVER ({OV}) - t, 6) AS gap_after FROM e")
def w2(spark: SparkSession, d: str) -> DataFrame:
    return W.gaps(events(spark, d), ["user_id"], ORDER, "t", "t").select("event_id", r6("gap_before").alias("gap_before"), r6("gap_after").alias("gap_after"))


@query("w3_newest", "SELECT media_id, title, genre FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY loaded_at DESC, title DESC, genre DESC) AS n FROM media_info) WHERE n = 1")
def w3(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "media_info").select("media_id", "title", "genre", "loaded_at")
    return W.newest(df, ["media_id"], ["loaded_at", "title"]).select("media_id", "title", "genre")


@query("w4_first_seen", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def w4(spark: SparkSession, d: str) -> DataFrame:
    return W.first_seen(events(spark, d).select("user_id", "event_id", "event_type", "ts"), ["user_id"], ORDER).select("user_id", "event_id", "event_type")


@query("w5_islands", f"{EV}, g AS (SELECT *, CASE WHEN t - lag(t) OVER ({OV}) > 86400 THEN 1 ELSE 0 END AS n FROM e), i AS (SELECT *, sum(n) OVER ({OV} ROWS UNBOUNDED PRECEDING) + 1 AS island FROM g) SELECT user_id, island::BIGINT AS island, count(*) AS rows, round(max(t) - min(t), 6) AS span FROM i GROUP BY user_id, island")
def w5(spark: SparkSession, d: str) -> DataFrame:
    i = W.gap_islands(events(spark, d), ["user_id"], ORDER, "t", 86400)
    return i.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("rows"), r6(F.max("t") - F.min("t")).alias("span"))


@query("w6_trailing_run", f"""{EV}, g AS (SELECT *, t - lag(t) OVER ({OV}) AS gap, row_number() OVER ({OV}) AS n FROM e),
c AS (SELECT *, max(CASE WHEN gap >= 172800 THEN n END) OVER (PARTITION BY user_id) AS cut, max(t) OVER (PARTITION BY user_id) AS fin FROM g),
s AS (SELECT *, max(CASE WHEN n = cut THEN t END) OVER (PARTITION BY user_id) AS began FROM c)
SELECT event_id FROM s WHERE n >= cut AND fin - began <= 864000""")
def w6(spark: SparkSession, d: str) -> DataFrame:
    return W.trailing_run(events(spark, d), ["user_id"], ORDER, "t", "t", 172800, 864000).where("tail").select("event_id")


@query("w7_identical_runs", f"""WITH c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER ({OV}) THEN 1 ELSE 0 END AS n FROM events),
i AS (SELECT *, sum(n) OVER ({OV} ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT user_id, event_type, min(ts) AS first, count(*) AS length FROM i GROUP BY user_id, event_type, run HAVING count(*) >= 2""")
def w7(spark: SparkSession, d: str) -> DataFrame:
    return W.identical_runs(events(spark, d), ["user_id"], ORDER, "event_type", 2).select("user_id", "event_type", "first", "length")


NOTES = "WITH n AS (SELECT DISTINCT song_id, coalesce(voice, '') AS voice, line_no, note_seq, beat, beat_length, pitch, word FROM notes)"
NO = "PARTITION BY song_id, voice ORDER BY line_no, note_seq, beat, beat_length, pitch, word"
NOTE_ORDER = ["line_no", "note_seq", "beat", "beat_length", "pitch", "word"]


def notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notes").select("song_id", F.coalesce("voice", F.lit("")).alias("voice"), *NOTE_ORDER).distinct()


@query("w8_monotone_clamp", f"""{NOTES}, b AS (SELECT *, coalesce(sum(greatest(coalesce(beat_length, 0), 0)) OVER ({NO} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM n)
SELECT song_id, voice, sum(clamped)::BIGINT AS total, count(*) AS rows FROM (SELECT *, max(beat - ahead) OVER ({NO} NULLS FIRST ROWS UNBOUNDED PRECEDING) + ahead AS clamped FROM b) GROUP BY song_id, voice""")
def w8(spark: SparkSession, d: str) -> DataFrame:
    df = notes(spark, d).withColumn("length", F.greatest(F.coalesce("beat_length", F.lit(0)), F.lit(0)))
    return W.monotone_clamp(df, ["song_id", "voice"], NOTE_ORDER, "beat", "length").groupBy("song_id", "voice").agg(F.sum("clamped").alias("total"), F.count(F.lit(1)).alias("rows"))


WORDS = "WITH w AS (SELECT DISTINCT take_id, seq, word, CASE WHEN isnan(start_s) THEN NULL ELSE start_s END AS s, CASE WHEN isnan(end_s) THEN NULL ELSE end_s END AS e FROM timed_words)"


def words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "timed_words").select("take_id", "seq", "word", F.when(~F.isnan("start_s"), F.col("start_s")).alias("s"), F.when(~F.isnan("end_s"), F.col("end_s")).alias("e")).distinct()


@query("w9_fill_missing", f"""{WORDS}, k AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY take_id ORDER BY seq, word, s NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known, count(e) OVER (PARTITION BY take_id ORDER BY seq, word, s NULLS FIRST ROWS UNBOUNDED PRECEDING) AS g FROM w),
m AS (SELECT *, row_number() OVER (PARTITION BY take_id, g ORDER BY seq, word, s NULLS FIRST) - CASE WHEN g > 0 THEN 1 ELSE 0 END AS nth FROM k)
SELECT take_id, seq, round(CASE WHEN known IS NULL THEN 0.2::DOUBLE * (nth - 1) ELSE known + 0.1::DOUBLE + 0.2::DOUBLE * (nth - 1) END, 6) AS filled_start FROM m WHERE e IS NULL""")
def w9(spark: SparkSession, d: str) -> DataFrame:
    df = W.fill_missing_times(words(spark, d), ["take_id"], ["seq", "word", "s"], "s", "e")
    return df.where("e is null").select("take_id", "seq", r6("filled_start").alias("filled_start"))


@query("w10_consensus_outliers", f"""SELECT event_id, round(c, 6) AS consensus FROM (SELECT *, CASE WHEN count(value) OVER w >= 3 THEN median(value) OVER w END AS c FROM events WINDOW w AS ({OV} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) WHERE abs(value - c) > 100""")
def w10(spark: SparkSession, d: str) -> DataFrame:
    return W.consensus_outliers(events(spark, d), ["user_id"], ORDER, "value", most=100.0).where("outlier").select("event_id", r6("consensus").alias("consensus"))


@query("w11_words_of_syllables", f"""{NOTES}, s AS (SELECT *, CASE WHEN regexp_matches(lag(word) OVER ({NO} NULLS FIRST), '\\s$') OR regexp_matches(word, '^\\s') THEN 1 ELSE 0 END AS starts FROM n WHERE word IS NOT NULL),
i AS (SELECT *, sum(starts) OVER ({NO} NULLS FIRST ROWS UNBOUNDED PRECEDING) + 1 AS word_no FROM s)
SELECT song_id, voice, word_no::BIGINT AS word_no, trim(string_agg(word, '' ORDER BY line_no, note_seq, beat, beat_length NULLS FIRST, pitch NULLS FIRST, word)) AS word, count(*) AS syllables FROM i GROUP BY song_id, voice, word_no""")
def w11(spark: SparkSession, d: str) -> DataFrame:
    return W.words_of_syllables(notes(spark, d).where("word is not null"), ["song_id", "voice"], NOTE_ORDER, "word")


@query("w12_merge_same", f"""{NOTES}, c AS (SELECT *, CASE WHEN lag(1) OVER ({NO} NULLS FIRST) IS NOT NULL AND NOT (pitch IS NOT DISTINCT FROM lag(pitch) OVER ({NO} NULLS FIRST) AND coalesce(trim(word) = '~', false)) THEN 1 ELSE 0 END AS new FROM n),
i AS (SELECT *, sum(new) OVER ({NO} NULLS FIRST ROWS UNBOUNDED PRECEDING) + 1 AS island FROM c)
SELECT song_id, voice, island::BIGINT AS island, count(*) AS rows, min(beat) AS beat FROM i GROUP BY song_id, voice, island""")
def w12(spark: SparkSession, d: str) -> DataFrame:
    df = notes(spark, d).withColumn("until", F.col("beat") + F.col("beat_length"))
    return W.merge_same(df, ["song_id", "voice"], NOTE_ORDER, "pitch", F.trim("word") == "~", "beat", "until").select("song_id", "voice", "island", "rows", "beat")


@query("w14_local_upper_median", f"SELECT event_id, list_sort(list(value) OVER w)[len(list(value) OVER w) // 2 + 1] AS local FROM events WINDOW w AS ({OV} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def w14(spark: SparkSession, d: str) -> DataFrame:
    return W.local_upper_median(events(spark, d), ["user_id"], ORDER, "value", 2).select("event_id", "local")


@query("a1_most_frequent", """WITH c AS (SELECT user_id, event_type, count(*) AS n, min({'ts': ts, 'event_id': event_id}) AS first FROM events GROUP BY ALL)
SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k FROM c) WHERE k = 1""")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return A.most_frequent(events(spark, d), ["user_id"], "event_type", ORDER)


@query("a3_status_counts", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p, count(*) AS total FROM orders GROUP BY o_orderpriority")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return A.status_counts(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("a5_spellings", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("user_id", "event_type").distinct().groupBy("event_type").agg(F.count(F.lit(1)).alias("users"))


@query("a6_roll_up", """WITH s AS (SELECT DISTINCT lower(trim(genre)) AS base, media_id, genre FROM media_info WHERE trim(genre) <> ''),
e AS (SELECT base, genre, count(*) AS n FROM s GROUP BY ALL), i AS (SELECT base, count(DISTINCT media_id) AS items FROM s GROUP BY base)
SELECT base, string_agg(genre || ' (' || n || ')', ', ' ORDER BY n DESC, genre) AS spellings, any_value(items) AS items FROM e JOIN i USING (base) GROUP BY base""")
def a6(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "media_info").where("trim(genre) <> ''").select(F.lower(F.trim("genre")).alias("base"), "media_id", "genre")
    return A.roll_up(df, "base", "media_id", "genre").select("base", "spellings", "items")


@query("a7_consensus", """WITH v AS (SELECT l_suppkey, l_returnflag, count(DISTINCT l_partkey) AS sources, min(l_linenumber) AS best FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_returnflag, sources, best, row_number() OVER (PARTITION BY l_suppkey ORDER BY sources DESC, best, l_returnflag) AS place FROM v""")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return A.consensus(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", "l_partkey", "l_linenumber")


@query("a9_spread", "SELECT event_type, round(median(value), 6) AS median, round(quantile_cont(value, 0.9) - quantile_cont(value, 0.1), 6) AS spread, count(value) AS n FROM events GROUP BY event_type")
def a9(spark: SparkSession, d: str) -> DataFrame:
    return A.spread(events(spark, d), ["event_type"], "value").select("event_type", r6("median").alias("median"), r6("spread").alias("spread"), "n")


@query("a10_settled_median", """WITH s AS (SELECT user_id, median(value) AS m, quantile_cont(value, 0.9) - quantile_cont(value, 0.1) AS sp, count(value) AS n FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN n < 5 THEN 'few' WHEN sp > 150 THEN 'spread' ELSE 'ok' END AS reason, CASE WHEN n >= 5 AND sp <= 150 THEN round_even(m * 1000, 0) END AS settled FROM s""")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return A.settled_median(events(spark, d), ["user_id"], "value", least=5, most_spread=150.0).select("user_id", "reason", "settled")


@query("a11_share_within", "SELECT event_type, round(avg((abs(value - 50) <= 10 + 1e-9)::INT), 6) AS near, round(avg((abs(value - 50) <= 30 + 1e-9)::INT), 6) AS wide FROM events WHERE value IS NOT NULL GROUP BY event_type")
def a11(spark: SparkSession, d: str) -> DataFrame:
    df = events(spark, d).where("value is not null").withColumn("off", F.col("value") - 50)
    return A.share_within(df, ["event_type"], "off", {"near": 10, "wide": 30}).select("event_type", r6("near").alias("near"), r6("wide").alias("wide"))


_THEIL = """WITH p AS (SELECT user_id, epoch_us(ts) / 1e6 / 86400 AS x, value AS y FROM events WHERE value IS NOT NULL), s AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY x, y) - 1 AS i FROM p),
t AS (SELECT * FROM s WHERE n >= 8 AND i % greatest(1, n // 400) = 0),
m AS (SELECT a.user_id, median((b.y - a.y) / (b.x - a.x)) AS slope FROM t a JOIN t b ON a.user_id = b.user_id AND b.i > a.i AND b.x - a.x > 1 GROUP BY a.user_id),
f AS (SELECT s.*, coalesce(m.slope, 1.0) AS slope FROM s LEFT JOIN m USING (user_id) WHERE s.n >= 8),
l AS (SELECT user_id, any_value(slope) AS slope, median(y - slope * x) AS intercept, any_value(n) AS n FROM f GROUP BY user_id)
"""


@query("a12_theil_sen", _THEIL + "SELECT l.user_id, round(l.slope, 6) AS slope, round(l.intercept, 4) AS intercept, l.n, round(avg((abs(f.y - l.slope * f.x - l.intercept) <= 50)::INT), 6) AS agree FROM f JOIN l USING (user_id) GROUP BY ALL")
def a12(spark: SparkSession, d: str) -> DataFrame:
    df = events(spark, d).withColumn("x", F.col("t") / 86400)
    return A.theil_sen(df, ["user_id"], "x", "value", within=50.0).select("user_id", r6("slope").alias("slope"), F.round("intercept", 4).alias("intercept"), "n", r6("agree").alias("agree"))


@query("a14_mean_without_largest", """WITH m AS (SELECT *, max(value) OVER (PARTITION BY user_id) AS top FROM events WHERE value IS NOT NULL)
SELECT user_id, round(1e-7 + CASE WHEN count(*) >= 5 AND count(*) FILTER (value < top) > 0 THEN avg(value) FILTER (value < top) ELSE 0 END, 4) AS mean FROM m GROUP BY user_id""")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return A.mean_without_largest(events(spark, d), ["user_id"], "value").select("user_id", F.round(F.col("mean") + 1e-7, 4).alias("mean"))


@query("a17_best_window_share", """WITH c AS (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY value RANGE BETWEEN 20.000000001 PRECEDING AND CURRENT ROW) AS c FROM events WHERE value IS NOT NULL)
SELECT user_id, round(max(c) / count(*), 6) AS share FROM c GROUP BY user_id""")
def a17(spark: SparkSession, d: str) -> DataFrame:
    return A.best_window_share(events(spark, d), ["user_id"], "value", 20.0).select("user_id", r6("share").alias("share"))


@query("a18_mismatch_share", f"""WITH l AS (SELECT user_id, value, list_sort(list(value) OVER w)[len(list(value) OVER w) // 2 + 1] AS local FROM events WINDOW w AS ({OV} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT user_id, round(avg((abs(value - local) > 30)::INT), 6) AS share, avg((abs(value - local) > 30)::INT) > 0.35 AS suspicious FROM l GROUP BY user_id""")
def a18(spark: SparkSession, d: str) -> DataFrame:
    return A.mismatch_share(events(spark, d), ["user_id"], ORDER, "value", most=30.0, share=0.35).select("user_id", r6("share").alias("share"), "suspicious")


@query("a19_ranges_text", """WITH d AS (SELECT DISTINCT song_id, line_no FROM notes WHERE line_no IS NOT NULL), r AS (SELECT *, line_no - row_number() OVER (PARTITION BY song_id ORDER BY line_no) AS run FROM d),
e AS (SELECT song_id, min(line_no) AS a, max(line_no) AS b FROM r GROUP BY song_id, run)
SELECT song_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM e GROUP BY song_id""")
def a19(spark: SparkSession, d: str) -> DataFrame:
    return A.ranges_text(table(spark, d, "notes"), ["song_id"], "line_no")


@query("a20_key", """WITH n AS (SELECT song_id, (pitch % 12 + 12) % 12 AS pc, sum(greatest(coalesce(beat_length, 0), 0))::DOUBLE AS w FROM notes WHERE pitch IS NOT NULL GROUP BY ALL),
t(minor, pattern) AS (VALUES (0, '101011010101'), (1, '101101011010')),
k AS (SELECT minor, tonic, pc, substr(pattern, ((pc - tonic) % 12 + 12) % 12 + 1, 1)::DOUBLE AS p FROM t, (SELECT unnest(range(12)) AS tonic), (SELECT unnest(range(12)) AS pc)), s AS (SELECT DISTINCT song_id FROM n),
c AS (SELECT s.song_id, k.minor, k.tonic, round(corr(coalesce(n.w, 0), k.p), 9) AS r, stddev_pop(coalesce(n.w, 0)) AS sd FROM s CROSS JOIN k LEFT JOIN n ON n.song_id = s.song_id AND n.pc = k.pc GROUP BY ALL)
SELECT song_id, tonic::INT AS tonic, minor, round(r, 6) AS correlation FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY r DESC, tonic, minor) AS place FROM c WHERE sd > 0) WHERE place = 1""")
def a20(spark: SparkSession, d: str) -> DataFrame:
    return A.detect_key(table(spark, d, "notes"), ["song_id"], "pitch", F.greatest(F.coalesce("beat_length", F.lit(0)), F.lit(0)))


@query("a23_frame_levels", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), f AS (SELECT user_id, i // 4 AS frame, avg(value * value) AS power, count(*) AS n FROM n GROUP BY ALL)
SELECT user_id, frame, round(10 * log10(power + 1e-12), 6) AS db FROM f WHERE n = 4""")
def a23(spark: SparkSession, d: str) -> DataFrame:
    df = events(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) - 1)
    return A.frame_levels(df, ["user_id"], "i", "value", 4).select("user_id", "frame", r6("db").alias("db"))


@query("f6_confident_or_all", """WITH m AS (SELECT *, max(confidence > 0.9) OVER (PARTITION BY take_id) AS any_good FROM timed_words)
SELECT take_id, count(*) AS kept FROM m WHERE confidence > 0.9 OR NOT coalesce(any_good, false) GROUP BY take_id""")
def confident_or_all(spark: SparkSession, d: str) -> DataFrame:
    """The confident frames of a take, or all where none is: an aggregate, then a join, so a large take isn't sorted."""
    df = table(spark, d, "timed_words").select("take_id", (F.coalesce(F.col("confidence") > 0.9, F.lit(False))).alias("good"))
    each = df.groupBy("take_id").agg(F.count_if("good").alias("good"), F.count(F.lit(1)).alias("n"))
    return each.select("take_id", F.when(F.col("good") > 0, F.col("good")).otherwise(F.col("n")).alias("kept"))


@query("flagship_timing_audit", f"""{EV}, g AS (SELECT *, median(value) OVER ({OV} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m, CASE WHEN t - lag(t) OVER ({OV}) > 86400 THEN 1 ELSE 0 END AS n FROM e),
i AS (SELECT *, sum(n) OVER ({OV} ROWS UNBOUNDED PRECEDING) + 1 AS island FROM g),
c AS (SELECT user_id, island, event_type, count(*) AS n, min({{'ts': ts, 'event_id': event_id}}) AS first FROM i GROUP BY ALL), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id, island ORDER BY n DESC, first) = 1)
SELECT i.user_id, i.island::BIGINT AS island, any_value(b.event_type) AS event_type, round(avg(i.m), 6) AS level, round(max(t) - min(t), 6) AS span,
CASE WHEN count(*) < 2 THEN 'unclear' WHEN max(i.m) - min(i.m) >= 50 THEN 'drifts' ELSE 'good' END AS verdict FROM i JOIN b ON b.user_id = i.user_id AND b.island = i.island GROUP BY i.user_id, i.island""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Gaps, islands, rolling medians, the usual kind and a verdict for each island."""
    df = W.gap_islands(W.rolling_median(events(spark, d), ["user_id"], ORDER, "value", 5), ["user_id"], ORDER, "t", 86400)
    kinds = A.most_frequent(df, ["user_id", "island"], "event_type", ORDER).drop("n")
    verdict = F.when(F.count(F.lit(1)) < 2, "unclear").when(F.max("median") - F.min("median") >= 50, "drifts").otherwise("good")
    each = df.groupBy("user_id", "island").agg(r6(F.avg("median")).alias("level"), r6(F.max("t") - F.min("t")).alias("span"), verdict.alias("verdict"))
    return each.join(kinds, ["user_id", "island"])
