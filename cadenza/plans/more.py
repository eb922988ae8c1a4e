"""Further queries: progress figures, shares, pieces of notes, gaps in tracks, hints in texts, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.operators.aggregates import theil_sen
from cadenza.plans.sequences import _THEIL, events
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


@query("a4_progress", "SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS mean_done, count(*) FILTER (o_orderstatus = 'O') AS remaining, max(o_orderdate) FILTER (o_orderstatus = 'F') AS last_done FROM orders GROUP BY o_orderpriority")
def a4(spark: SparkSession, d: str) -> DataFrame:
    done = lambda c: F.when(F.col("o_orderstatus") == "F", F.col(c))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg(done("o_totalprice")), 2).alias("mean_done"), F.count_if(F.col("o_orderstatus") == "O").alias("remaining"), F.max(done("o_orderdate")).alias("last_done"))


@query("a24_confident_share", "SELECT take_id, round(avg((confidence > 0.5)::INT), 6) AS share FROM timed_words WHERE confidence IS NOT NULL GROUP BY take_id")
def a24(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "timed_words").where("confidence is not null").groupBy("take_id").agg(r6(F.avg((F.col("confidence") > 0.5).cast("double"))).alias("share"))


@query("k9_pieces", """WITH n AS (SELECT DISTINCT song_id, coalesce(voice, '') AS voice, note_seq, beat, beat_length, pitch, word FROM notes WHERE beat_length > 0)
SELECT song_id, voice, note_seq, i::INT AS piece, beat + 4 * i AS beat, least(4, beat_length - 4 * i) AS length, CASE WHEN i = 0 THEN word ELSE '~' END AS word FROM (SELECT *, unnest(range((beat_length + 3) // 4)) AS i FROM n)""")
def k9(spark: SparkSession, d: str) -> DataFrame:
    """Notes cut into pieces of four beats, the word on the first, the rest held."""
    n = table(spark, d, "notes").where("beat_length > 0").select("song_id", F.coalesce("voice", F.lit("")).alias("voice"), "note_seq", "beat", "beat_length", "pitch", "word").distinct()
    i = n.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("beat_length") / 4).cast("int") - 1)))
    return i.select("song_id", "voice", "note_seq", "piece", (F.col("beat") + 4 * F.col("piece")).alias("beat"), F.least(F.lit(4), F.col("beat_length") - 4 * F.col("piece")).alias("length"), F.when(F.col("piece") == 0, F.col("word")).otherwise("~").alias("word"))


@query("k20_track_gaps", """WITH g AS (SELECT event_id, user_id, epoch_us(ts) AS t, value, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, t, value, false AS inserted FROM g UNION ALL SELECT user_id, t, NULL, true FROM g WHERE gap > 86400000000""")
def k20(spark: SparkSession, d: str) -> DataFrame:
    """A row without value wherever a track pauses for more than a day, so that plots break there."""
    e = events(spark, d).select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    both = F.when(gap > 86_400_000_000, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    each = e.withColumn("both", both).withColumn("inserted", F.explode("both"))
    return each.select("user_id", "t", F.when(~F.col("inserted"), F.col("value")).alias("value"), "inserted")


@query("f21_gap_hints", r"SELECT doc_id, regexp_extract_all(text, '#GAP:\s*(-?\d+)', 1)[1]::BIGINT AS gap, len(regexp_extract_all(text, '#GAP:\s*(-?\d+)', 1)) AS hints FROM documents WHERE regexp_matches(text, '#GAP:\s*-?\d')")
def f21(spark: SparkSession, d: str) -> DataFrame:
    hints = F.regexp_extract_all("text", F.lit(r"#GAP:\s*(-?\d+)"), F.lit(1))
    found = table(spark, d, "documents").where(F.col("text").rlike(r"#GAP:\s*-?\d")).withColumn("h", hints)
    return found.select("doc_id", F.get("h", 0).cast("long").alias("gap"), F.size("h").cast("long").alias("hints"))


@query("v_verdict", _THEIL + ", a AS (SELECT l.user_id, l.slope, l.intercept, avg((abs(f.y - l.slope * f.x - l.intercept) <= 50)::INT) AS agree FROM f JOIN l USING (user_id) GROUP BY ALL) SELECT user_id, CASE WHEN agree < 0.6 THEN 'unclear' WHEN abs(slope) >= 1 THEN 'drifts' WHEN abs(intercept) >= 100 THEN 'shifted' ELSE 'good' END AS verdict FROM a")
def verdict(spark: SparkSession, d: str) -> DataFrame:
    fit = theil_sen(events(spark, d).withColumn("x", F.col("t") / 86400), ["user_id"], "x", "value", within=50.0)
    return fit.select("user_id", F.when(F.col("agree") < 0.6, "unclear").when(F.abs("slope") >= 1, "drifts").when(F.abs("intercept") >= 100, "shifted").otherwise("good").alias("verdict"))
