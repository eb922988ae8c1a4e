"""Queries of the kernels, similarities and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import similarity
from cadenza.kernels import align, signal
from cadenza.session import table
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
OV = "PARTITION BY user_id ORDER BY ts, event_id"


TAKE = ["song_id", "take_id", "voice"]


def sung_words(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The words of a song's file and of a take, each numbered, for every take of the song and every voice of the file; a take holds all voices."""
    notes = table(spark, d, "notes").where("word is not null and trim(word) <> '~'").select("song_id", F.coalesce("voice", F.lit("P1")).alias("voice"), "line_no", "note_seq", F.lower(F.trim("word")).alias("word")).distinct()
    number = lambda keys, *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    left = notes.select("song_id", "voice", number(["song_id", "voice"], "line_no", "note_seq", "word").alias("n"), "word")
    words = table(spark, d, "timed_words").select("song_id", "take_id", "seq", F.lower(F.trim("word")).alias("word")).distinct()
    right = words.select("song_id", "take_id", number(["song_id", "take_id"], "seq", "word").alias("n"), "word")
    takes, voices = right.select("song_id", "take_id").distinct(), left.select("song_id", "voice").distinct()
    return left.join(takes, "song_id").select(*TAKE, "n", "word"), right.join(voices, "song_id").select(*TAKE, "n", "word")


@query("k1_common_subsequence")
def k1(spark: SparkSession, d: str) -> DataFrame:
    return align.align(*sung_words(spark, d), TAKE, "n", "word", "subsequence")


@query("k2_affine_pairs")
def k2(spark: SparkSession, d: str) -> DataFrame:
    return align.align(*sung_words(spark, d), TAKE, "n", "word", "affine")


@query("k3_matching_blocks")
def k3(spark: SparkSession, d: str) -> DataFrame:
    return align.align(*sung_words(spark, d), TAKE, "n", "word", "blocks")


@query("a16_words_heard")
def a16(spark: SparkSession, d: str) -> DataFrame:
    """The share of a voice's words that each take of the song holds in order, and the longest run that it doesn't."""
    left, right = sung_words(spark, d)
    heard = align.align(left, right, TAKE, "n", "word").select(*TAKE, F.col("left_no").alias("n"), F.lit(1).alias("hit"))
    marked = left.join(heard, [*TAKE, "n"], "left").withColumn("miss", F.col("hit").isNull())
    run = F.col("n") - F.row_number().over(Window.partitionBy(*TAKE, "miss").orderBy("n"))
    runs = marked.where("miss").withColumn("run", run).groupBy(*TAKE, "run").agg(F.count(F.lit(1)).alias("k")).groupBy(*TAKE).agg(F.max("k").alias("longest_unheard"))
    share = marked.groupBy(*TAKE).agg(r6(F.avg(F.coalesce("hit", F.lit(0)).cast("double"))).alias("heard"))
    return share.join(runs, TAKE, "left").select(*TAKE, "heard", F.coalesce("longest_unheard", F.lit(0)).alias("longest_unheard"))


_FRAMES = """n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), f AS (SELECT user_id, i // 4 AS frame, 10 * log10(avg(value * value) + 1e-12) AS db FROM n GROUP BY ALL HAVING count(*) = 4)"""


def levels(spark: SparkSession, d: str) -> DataFrame:
    from cadenza.operators.aggregates import frame_levels

    e = table(spark, d, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    return frame_levels(e, ["user_id"], "i", "value", 4)


@query("k13_quiet_stretches", f"WITH {_FRAMES}, q AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS run FROM f WHERE db < 30) SELECT user_id, min(frame) AS first, max(frame) AS last FROM q GROUP BY user_id, run HAVING count(*) >= 2")
def k13(spark: SparkSession, d: str) -> DataFrame:
    return signal.quiet_stretches(levels(spark, d), ["user_id"], "frame", "db", 30.0, 2)


@query("k14_outro_cut", f"""WITH {_FRAMES}, l AS (SELECT user_id, quantile_cont(db, 0.9) - 30 AS loud, count(*) AS whole FROM f GROUP BY user_id), m AS (SELECT * FROM f JOIN l USING (user_id)),
b AS (SELECT user_id, min(frame) + 4 AS fin, any_value(whole) AS whole FROM m WHERE db > loud GROUP BY user_id), q AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS run FROM m WHERE db <= loud),
p AS (SELECT user_id, min(frame) AS first FROM q GROUP BY user_id, run HAVING count(*) >= 1), s AS (SELECT p.user_id, arg_min(first, {{'d': abs(first - fin), 'f': first}}) + 0.5 AS cut_s FROM p JOIN b USING (user_id) WHERE first BETWEEN fin - 10 AND fin + 15 AND whole - 4 >= 8 GROUP BY p.user_id)
SELECT b.user_id, s.cut_s::DOUBLE AS cut_s FROM b LEFT JOIN s USING (user_id)""")
def k14(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a second each."""
    return signal.outro_cut(levels(spark, d), ["user_id"], "frame", "db", 4.0, frame_s=1.0)


@query("k15_lag")
def k15(spark: SparkSession, d: str) -> DataFrame:
    """A user's values against themselves two events later: the lag is known."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("i", F.row_number().over(w)).withColumn("later", F.coalesce(F.lag("value", 2).over(w), F.lit(0.0)))
    return signal.find_lag(e, ["user_id"], "i", "value", "later", 10).select("user_id", F.round("lag").alias("lag"))


@query("k16_two_voices")
def k16(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("part", F.col("vec_id") % 20).withColumn("fixed", F.lit(None).cast("int"))
    return signal.assign_voices(e, ["part"], "vec_id", "embedding", "fixed").select("part", "vec_id", "voice")


@query("k7_interpolate", f"""WITH x AS (SELECT user_id, event_id, ts, epoch_us(ts) / 1e6 AS t, CASE WHEN event_type <> 'error' THEN epoch_us(ts) / 1e6 END AS known, row_number() OVER ({OV}) AS i FROM events),
y AS (SELECT *, last_value(CASE WHEN known IS NOT NULL THEN i END IGNORE NULLS) OVER ({OV} ROWS UNBOUNDED PRECEDING) AS i0, last_value(known IGNORE NULLS) OVER ({OV} ROWS UNBOUNDED PRECEDING) AS t0,
first_value(CASE WHEN known IS NOT NULL THEN i END IGNORE NULLS) OVER ({OV} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1, first_value(known IGNORE NULLS) OVER ({OV} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM x)
SELECT event_id, round(CASE WHEN i0 = i1 THEN t0 ELSE t0 + (t1 - t0) * (i - i0) / (i1 - i0) END, 3) AS filled FROM y""")
def k7(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a time share the stretch between the known ones around them."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    e = e.withColumn("known", F.when(F.col("event_type") != "error", F.col("t"))).withColumn("i", F.row_number().over(w))
    mark = F.when(F.col("known").isNotNull(), F.struct("i", "known"))
    e = e.withColumn("a", F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.first(mark, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    between = F.col("a.known") + (F.col("b.known") - F.col("a.known")) * (F.col("i") - F.col("a.i")) / (F.col("b.i") - F.col("a.i"))
    return e.select("event_id", F.round(F.when(F.col("a.i") == F.col("b.i"), F.col("a.known")).otherwise(between), 3).alias("filled"))


@query("j4_fuzzy_best")
def j4(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "genre_song_fixes").select("fix_id", F.col("band").alias("artist"), "title").dropDuplicates(["fix_id"])
    m = table(spark, d, "media_info").where("artist is not null").select("media_id", "artist", "title").dropDuplicates(["media_id"])
    return similarity.fuzzy_best(f, m, "fix_id", "media_id", ["artist", "title"], least=0.8)


@query("f1_fold_word")
def f1(spark: SparkSession, d: str) -> DataFrame:
    """Words of every script."""
    n = table(spark, d, "notes").where("word is not null").select("word").distinct()
    return n.select("word", similarity.fold_word_column(F.col("word")).alias("folded"))


@query("f3_block_ratio")
def f3(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "media_info").select("media_id", "artist", "title").distinct()
    return m.select("media_id", r6(similarity.block_ratio_column(F.col("artist"), F.col("title"))).alias("ratio"), r6(similarity.indel_ratio_column(F.col("artist"), F.col("title"))).alias("indel"))


@query("st_sessions", f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER ({OV}) >= INTERVAL 1 DAY OR lag(ts) OVER ({OV}) IS NULL THEN 1 ELSE 0 END AS n FROM events), i AS (SELECT *, sum(n) OVER ({OV} ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM i GROUP BY user_id, s""")
def st_sessions(spark: SparkSession, d: str) -> DataFrame:
    return streams.sessions(table(spark, d, "events").select("user_id", "ts"), "ts", "1 day", ["user_id"])


@query("st_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL HAVING time_bucket(INTERVAL 1 DAY, min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def st_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts of a stream of files; the last windows stay open until the watermark passes them."""
    stream = streams.read_stream(spark, f"{d}/event[s].parquet").select("event_type", F.col("ts").cast("timestamp").alias("at"))
    return streams.drain(streams.tumbling(stream, "at", "1 day", "1 hour", ["event_type"]))


@query("st_running_best", "SELECT user_id, max(value) AS best FROM events WHERE value IS NOT NULL GROUP BY user_id")
def st_running_best(spark: SparkSession, d: str) -> DataFrame:
    stream = streams.read_stream(spark, f"{d}/event[s].parquet").select("user_id", "value")
    best = streams.drain(streams.running_best(stream, "user_id", "value"))
    return best.groupBy("user_id").agg(F.max("best").alias("best"))


@query("st_merge_newest", "SELECT user_id, max(event_id) AS event_id FROM (SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY user_id")
def st_merge_newest(spark: SparkSession, d: str) -> DataFrame:
    folder = streams.shared_folder(spark, "merged")
    stream = streams.read_stream(spark, f"{d}/event[s].parquet").select("user_id", "ts", "event_id")
    streams.merge_newest(stream, folder, ["user_id"], ["ts", "event_id"])
    return streams.latest_version(spark, folder, stream.schema).select("user_id", "event_id")
