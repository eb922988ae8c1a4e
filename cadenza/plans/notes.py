"""Queries of notes and timed words: pitches, pieces, scores, corrections, summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.operators import aggregates as A
from cadenza.operators import music as M
from cadenza.plans.sequences import NO, NOTE_ORDER, NOTES, WORDS, notes, words
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
SONG = ["song_id", "voice"]
_PITCHED = f"{NOTES}, p0 AS (SELECT *, pitch::DOUBLE AS p FROM n WHERE pitch IS NOT NULL)"
_W = f"{NO} NULLS FIRST ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING"


def _fold(source: str, out: str) -> str:
    return f"{out}_m AS (SELECT *, median(p) OVER ({_W}) AS near FROM {source}), {out} AS (SELECT * EXCLUDE (p, near), CASE WHEN abs(p - near) > 7 THEN p - 12 * round_even((p - near) / 12, 0) ELSE p END AS p FROM {out}_m)"


_FOLDED = f"{_PITCHED}, {_fold('p0', 'p1')}, {_fold('p1', 'p2')}, {_fold('p2', 'p3')}"
_SONG = "g AS (SELECT song_id, voice, median(p) AS middle FROM p3 GROUP BY ALL), s AS (SELECT p3.* EXCLUDE (p), CASE WHEN abs(p - middle) > 12 THEN p - 12 * round_even((p - middle) / 12, 0) ELSE p END AS p FROM p3 JOIN g USING (song_id, voice))"


def pitched(spark: SparkSession, d: str) -> DataFrame:
    return notes(spark, d).where("pitch is not null").withColumn("p", F.col("pitch").cast("double"))


@query("f28_fold_octaves", f"{_FOLDED} SELECT song_id, voice, note_seq, beat, pitch, p AS folded FROM p3")
def f28(spark: SparkSession, d: str) -> DataFrame:
    return M.fold_octaves(pitched(spark, d), SONG, NOTE_ORDER, "p").select(*SONG, "note_seq", "beat", "pitch", F.col("p").alias("folded"))


@query("f29_fold_to_range", f"{_FOLDED}, {_SONG} SELECT song_id, voice, note_seq, beat, pitch, p AS folded FROM s")
def f29(spark: SparkSession, d: str) -> DataFrame:
    folded = M.fold_to_range(M.fold_octaves(pitched(spark, d), SONG, NOTE_ORDER, "p"), SONG, "p", tolerance=12)
    return folded.select(*SONG, "note_seq", "beat", "pitch", F.col("p").alias("folded"))


@query("f30_pull_unsure", f"""{_FOLDED}, {_SONG}, m AS (SELECT *, median(p) OVER ({_W}) AS near, CASE WHEN beat_length <= 2 THEN 0.1 ELSE 0.9 END AS sure FROM s)
SELECT song_id, voice, note_seq, beat, pitch, round_even(CASE WHEN sure < 0.3 THEN least(greatest((p + near) / 2, near - 3), near + 3) ELSE p END, 0) AS pulled FROM m""")
def f30(spark: SparkSession, d: str) -> DataFrame:
    """Short notes count as unsure."""
    folded = M.fold_to_range(M.fold_octaves(pitched(spark, d), SONG, NOTE_ORDER, "p"), SONG, "p", tolerance=12)
    unsure = folded.withColumn("sure", F.when(F.col("beat_length") <= 2, 0.1).otherwise(0.9))
    return M.pull_unsure(unsure, SONG, NOTE_ORDER, "p", "sure").select(*SONG, "note_seq", "beat", "pitch", F.col("p").alias("pulled"))


@query("f33_pitch_window", f"{WORDS} SELECT take_id, seq, round(CASE WHEN e - s >= 0.2 THEN s ELSE greatest(0, s - (0.2 - (e - s)) / 2) END, 6) AS a, round(CASE WHEN e - s >= 0.2 THEN e ELSE e + (0.2 - (e - s)) / 2 END, 6) AS z FROM w WHERE s IS NOT NULL AND e IS NOT NULL")
def f33(spark: SparkSession, d: str) -> DataFrame:
    a, z = M.pitch_window(F.col("s"), F.col("e"), 0.2)
    return words(spark, d).where("s is not null and e is not null").select("take_id", "seq", r6(a).alias("a"), r6(z).alias("z"))


@query("k9_sixteenths", f"""{WORDS}, x AS (SELECT take_id, seq, word, s, e, e - s > 0.125 AS long, floor((e - s - 0.125) / 0.125) AS whole FROM w WHERE e > s), y AS (SELECT *, (e - s - 0.125) - whole * 0.125 AS rest FROM x),
z AS (SELECT *, CASE WHEN long THEN whole + (rest >= 0.0625)::INT ELSE 0 END AS last FROM y), c AS (SELECT *, unnest(range(0, last::BIGINT + 1)) AS piece FROM z), b AS (SELECT *, CASE WHEN piece = 0 OR NOT long THEN s ELSE s + 0.125::DOUBLE + (piece - 1) * 0.125::DOUBLE END AS a FROM c)
SELECT take_id, seq, piece::INT AS piece, round(a, 6) AS piece_start, round(CASE WHEN NOT long THEN e WHEN rest >= 0.0625 AND piece = last AND piece > 0 THEN a + rest WHEN piece = last AND rest < 0.0625 THEN a + 0.125 + rest ELSE a + 0.125 END, 6) AS piece_end,
CASE WHEN NOT long THEN word ELSE CASE WHEN piece > 0 THEN '~' WHEN word LIKE '% ' THEN left(word, len(word) - 1) ELSE word END || CASE WHEN word LIKE '% ' AND piece = last THEN ' ' ELSE '' END END AS word, word LIKE '% ' AND piece = last AS is_word_end FROM b""")
def k9(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of an eighth of a second, the sixteenth at 120 beats a minute."""
    w = words(spark, d).where("e > s")
    return M.sixteenths(w, ["take_id", "seq"], "s", "e", "word", 0.125).select("take_id", "seq", "piece", r6("piece_start").alias("piece_start"), r6("piece_end").alias("piece_end"), "word", "is_word_end")


_PARTS = """n AS (SELECT DISTINCT song_id, coalesce(voice, '') AS voice, line_no, note_seq, note_type, beat, beat_length, pitch FROM notes WHERE beat_length > 0 AND pitch IS NOT NULL),
q AS (SELECT *, unnest(range(0, beat_length::BIGINT)) AS part FROM n WHERE note_type <> 'F')"""


@query("a15_score", f"""WITH {_PARTS}, h AS (SELECT *, (pitch + part) % 3 <> 0 AS hit FROM q), e AS (SELECT song_id, voice, line_no, note_seq, beat, beat_length, pitch, note_type, count(*) AS parts, count(*) FILTER (hit) AS hits FROM h GROUP BY ALL),
s AS (SELECT song_id, sum(parts) AS parts, sum(CASE WHEN note_type IN (':', 'R') THEN hits ELSE 0 END) AS plain, sum(CASE WHEN note_type IN ('*', 'G') THEN 2 * hits ELSE 0 END) AS golden, count(*) FILTER (hits = parts) AS full_notes FROM e GROUP BY song_id), c AS (SELECT song_id, count(*) AS n FROM n GROUP BY song_id),
r AS (SELECT song_id, round_even(CASE WHEN full_notes > 0 THEN 9000 ELSE 10000 END * plain / parts, 0)::BIGINT AS notes, golden::BIGINT AS golden, full_notes * 1000.0::DOUBLE / n AS bonus FROM s JOIN c USING (song_id))
SELECT song_id, notes, golden, round_even(bonus, 0)::BIGINT AS line_bonus, round_even(notes + bonus + golden, 0)::BIGINT AS score FROM r""")
def a15(spark: SparkSession, d: str) -> DataFrame:
    """Notes in parts of a beat each, of which those are hit whose pitch and number don't add up to a multiple of three."""
    n = table(spark, d, "notes").where("beat_length > 0 and pitch is not null").select("song_id", F.coalesce("voice", F.lit("")).alias("voice"), "line_no", "note_seq", "note_type", "beat", "beat_length", "pitch").distinct()
    parts = n.where("note_type <> 'F'").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("beat_length").cast("int") - 1))).withColumn("hit", (F.col("pitch") + F.col("part")) % 3 != 0)
    parts = parts.withColumn("note", F.struct("voice", "line_no", "note_seq", "beat", "beat_length", "pitch"))
    return M.score(parts, ["song_id"], "note", kind="note_type", hit="hit", notes=n.groupBy("song_id").agg(F.count(F.lit(1)).alias("n")))


_FIT = f"""{WORDS}, p AS (SELECT take_id, s AS x, s * 1.01 + 0.7::DOUBLE + ((seq * 7) % 5) / 50.0::DOUBLE + CASE WHEN seq % 11 = 0 THEN 5 ELSE 0 END AS y FROM w WHERE s IS NOT NULL), z AS (SELECT *, count(*) OVER (PARTITION BY take_id) AS n, row_number() OVER (PARTITION BY take_id ORDER BY x, y) - 1 AS i FROM p),
f AS (SELECT * FROM z WHERE n >= 8), th AS (SELECT * FROM f WHERE i % greatest(1, n // 400) = 0), sl AS (SELECT a.take_id, median((b.y - a.y) / (b.x - a.x)) AS slope FROM th a JOIN th b ON a.take_id = b.take_id AND b.i > a.i AND b.x - a.x > 1 GROUP BY a.take_id),
k AS (SELECT f.take_id, coalesce(any_value(sl.slope), 1.0) AS slope, median(f.y - coalesce(sl.slope, 1.0) * f.x) AS intercept, min(f.x) AS first, max(f.x) AS last, median(f.y - f.x) AS median_offset FROM f LEFT JOIN sl USING (take_id) GROUP BY f.take_id),
g AS (SELECT k.*, (SELECT avg((abs(f.y - k.slope * f.x - k.intercept) <= 1.0)::INT) FROM f WHERE f.take_id = k.take_id) AS agree FROM k)"""


@query("a13_correction", _FIT + """ SELECT take_id, round(intercept + (slope - 1) * first, 4) AS offset_s, round((slope - 1) * (last - first), 4) AS drift_s, round(CASE WHEN abs((slope - 1) * (last - first)) < 0.2 THEN 500 + 1000 * median_offset ELSE 1000 * (intercept + slope * 0.5) END, 2) AS gap_ms, round(CASE WHEN abs((slope - 1) * (last - first)) < 0.2 THEN 300 ELSE 300 / slope END, 4) AS bpm FROM g WHERE agree >= 0.8""")
def a13(spark: SparkSession, d: str) -> DataFrame:
    """Takes against themselves a hundredth slower and moved, with words displaced: the line that corrects them."""
    p = words(spark, d).where("s is not null").select("take_id", F.col("s").alias("x"), (F.col("s") * 1.01 + 0.7 + ((F.col("seq") * 7) % 5) / 50.0 + F.when(F.col("seq") % 11 == 0, 5).otherwise(0)).alias("y"))
    ends = p.groupBy("take_id").agg(F.min("x").alias("first"), F.max("x").alias("last"), F.median(F.col("y") - F.col("x")).alias("median_offset"))
    fit = A.theil_sen(p, ["take_id"], "x", "y").join(ends, "take_id")
    c = M.correction(fit, ["take_id"], F.lit(500.0), F.lit(300.0))
    return c.select("take_id", F.round("offset_s", 4).alias("offset_s"), F.round("drift_s", 4).alias("drift_s"), F.round("gap_ms", 2).alias("gap_ms"), F.round("bpm", 4).alias("bpm"))


@query("w12_merge_syllables", f"""{NOTES}, x AS (SELECT *, beat + beat_length AS until FROM n WHERE word IS NOT NULL AND pitch IS NOT NULL AND beat_length > 0),
j AS (SELECT *, row_number() OVER w AS i, lag(pitch) OVER w AS bp, coalesce(NOT (lag(word) OVER w LIKE '% ') AND beat - lag(until) OVER w < 2 AND (pitch = lag(pitch) OVER w OR (abs(pitch - lag(pitch) OVER w) <= 2 AND lag(until) OVER w - lag(beat) OVER w <= 4)), false) AS joins FROM x WINDOW w AS ({NO} NULLS FIRST)),
k AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY song_id, voice ORDER BY i ROWS UNBOUNDED PRECEDING) AS island, CASE WHEN joins AND pitch <> bp THEN bp END AS slid FROM j)
SELECT song_id, voice, island::BIGINT AS island, min(beat)::DOUBLE AS start, arg_max(until, i)::DOUBLE AS "end", coalesce(arg_max(slid, i) FILTER (slid IS NOT NULL), arg_min(pitch, i))::DOUBLE AS note, string_agg(rtrim(replace(word, '~', '')), '' ORDER BY i) || CASE WHEN arg_max(word, i) LIKE '% ' THEN ' ' ELSE '' END AS word FROM k GROUP BY ALL""")
def w12(spark: SparkSession, d: str) -> DataFrame:
    """In beats, two to a sixteenth."""
    n = notes(spark, d).where("word is not null and pitch is not null and beat_length > 0").withColumn("until", F.col("beat") + F.col("beat_length"))
    m = M.merge_syllables(n, SONG, NOTE_ORDER, "pitch", "word", "beat", "until", sixteenth=2)
    return m.select(*SONG, "island", *[F.col(c).cast("double").alias(c) for c in ("start", "end", "note")], "word")


@query("a19_note_types", """WITH n AS (SELECT DISTINCT song_id, note_type, line_no FROM notes WHERE note_type <> ':' AND line_no IS NOT NULL), r AS (SELECT *, line_no - row_number() OVER (PARTITION BY song_id, note_type ORDER BY line_no) AS run FROM n), e AS (SELECT song_id, note_type, min(line_no) AS a, max(line_no) AS b FROM r GROUP BY song_id, note_type, run),
k AS (SELECT song_id, note_type, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM e GROUP BY ALL) SELECT song_id, string_agg(note_type || ' lines ' || ranges, '; ' ORDER BY note_type) AS summary FROM k GROUP BY song_id""")
def a19(spark: SparkSession, d: str) -> DataFrame:
    """By song, the lines that hold each type of note but the normal one."""
    n = table(spark, d, "notes").where("note_type <> ':'")
    each = A.ranges_text(n, ["song_id", "note_type"], "line_no").select("song_id", F.struct("note_type", F.concat("note_type", F.lit(" lines "), "ranges").alias("text")).alias("x"))
    return each.groupBy("song_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "; ").alias("summary"))


@query("k18_line_starts", "SELECT song_id, coalesce(voice, '') AS voice, line_no, arg_min(word, {'a': beat, 'b': note_seq, 'c': word}) AS first_word, min(beat)::BIGINT AS beat FROM notes WHERE beat IS NOT NULL AND word IS NOT NULL AND line_no IS NOT NULL GROUP BY ALL")
def k18(spark: SparkSession, d: str) -> DataFrame:
    """The first placed word of each line."""
    n = table(spark, d, "notes").where("beat is not null and word is not null and line_no is not null")
    return n.groupBy("song_id", F.coalesce("voice", F.lit("")).alias("voice"), "line_no").agg(F.min_by("word", F.struct("beat", "note_seq", "word")).alias("first_word"), F.min("beat").cast("long").alias("beat"))


@query("k12_unsung_tail", """WITH u AS (SELECT DISTINCT song_id, coalesce(voice, '') AS voice, line_no, note_seq, word, coalesce(beat_length, 0) <= 0 AS unsung FROM notes WHERE word IS NOT NULL AND line_no IS NOT NULL AND note_seq IS NOT NULL),
l AS (SELECT song_id, voice, line_no, bool_and(unsung) AS whole FROM u GROUP BY ALL), t AS (SELECT song_id, voice, max(line_no) FILTER (NOT whole) AS last FROM l GROUP BY ALL),
f AS (SELECT u.song_id, u.voice, min(u.note_seq) AS first FROM u JOIN t ON t.song_id = u.song_id AND t.voice = u.voice AND t.last = u.line_no WHERE u.unsung GROUP BY ALL)
SELECT u.song_id, u.voice, u.line_no, u.note_seq, u.word FROM u JOIN l USING (song_id, voice, line_no) JOIN t USING (song_id, voice) LEFT JOIN f USING (song_id, voice) WHERE NOT l.whole AND u.line_no <= t.last AND NOT (u.line_no = t.last AND f.first IS NOT NULL AND u.note_seq >= f.first)""")
def k12(spark: SparkSession, d: str) -> DataFrame:
    """Words without lines of which nothing is sung (no length) and without the end from the last sung line's first unsung word on."""
    u = table(spark, d, "notes").where("word is not null and line_no is not null and note_seq is not null")
    u = u.select("song_id", F.coalesce("voice", F.lit("")).alias("voice"), "line_no", "note_seq", "word", (F.coalesce("beat_length", F.lit(0)) <= 0).alias("unsung")).distinct()
    line, part = Window.partitionBy(*SONG, "line_no"), Window.partitionBy(*SONG)
    marked = u.withColumn("whole", F.min("unsung").over(line)).withColumn("last", F.max(F.when(~F.col("whole"), F.col("line_no"))).over(part))
    cut = marked.withColumn("first", F.min(F.when(F.col("unsung") & (F.col("line_no") == F.col("last")), F.col("note_seq"))).over(part))
    kept = cut.where(~F.col("whole") & (F.col("line_no") <= F.col("last")) & ~F.coalesce((F.col("line_no") == F.col("last")) & (F.col("note_seq") >= F.col("first")), F.lit(False)))
    return kept.select(*SONG, "line_no", "note_seq", "word")


@query("w8_within_audio")
def w8(spark: SparkSession, d: str) -> DataFrame:
    """Notes pushed behind the one before them and kept inside the audio: shortened at its end, dropped beyond."""
    from cadenza.operators.windows import monotone_clamp

    df = notes(spark, d).withColumn("length", F.greatest(F.coalesce("beat_length", F.lit(0)), F.lit(0)))
    clamped = monotone_clamp(df, SONG, NOTE_ORDER, "beat", "length").where("clamped < 400")
    return clamped.select(*SONG, "note_seq", "clamped", F.greatest(F.lit(1), F.least("length", 400 - F.col("clamped"))).alias("length"))


@query("r20_word_lengths", f"""{NOTES}, s AS (SELECT *, CASE WHEN regexp_matches(lag(word) OVER ({NO} NULLS FIRST), '\\s$') OR regexp_matches(word, '^\\s') THEN 1 ELSE 0 END AS starts FROM n WHERE word IS NOT NULL), i AS (SELECT *, sum(starts) OVER ({NO} NULLS FIRST ROWS UNBOUNDED PRECEDING) AS word_no FROM s),
w AS (SELECT song_id, voice, word_no, max(beat + beat_length) - min(beat) AS length FROM i WHERE beat_length > 0 GROUP BY ALL) SELECT song_id, voice, count(*) AS words, round(avg(length), 6) AS mean_length FROM w GROUP BY ALL""")
def r20(spark: SparkSession, d: str) -> DataFrame:
    """How long words of several notes last, in beats, on average."""
    w = Window.partitionBy(*SONG).orderBy(*NOTE_ORDER)
    n = notes(spark, d).where("word is not null").withColumn("starts", F.coalesce(F.lag("word").over(w).rlike(r"\s$"), F.lit(False)) | F.col("word").rlike(r"^\s"))
    each = n.withColumn("word_no", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("beat_length > 0")
    length = each.groupBy(*SONG, "word_no").agg((F.max(F.col("beat") + F.col("beat_length")) - F.min("beat")).alias("length"))
    return length.groupBy(*SONG).agg(F.count(F.lit(1)).alias("words"), r6(F.avg("length")).alias("mean_length"))


@query("r33_chunk_bounds", f"{WORDS} SELECT take_id, seq, trunc(s * 44100 * 2)::BIGINT AS a, trunc(e * 44100 * 2)::BIGINT AS z FROM w WHERE s IS NOT NULL AND e IS NOT NULL")
def r33(spark: SparkSession, d: str) -> DataFrame:
    """Where each word begins and ends in samples of two channels."""
    return words(spark, d).where("s is not null and e is not null").select("take_id", "seq", (F.col("s") * 44100 * 2).cast("long").alias("a"), (F.col("e") * 44100 * 2).cast("long").alias("z"))


@query("f38_lines_of_words", f"""{WORDS}, t AS (SELECT *, CASE WHEN s - lag(e) OVER o >= 1.0 THEN 1 ELSE 0 END AS new FROM w WHERE s IS NOT NULL AND e IS NOT NULL WINDOW o AS (PARTITION BY take_id ORDER BY seq, word, s, e)), l AS (SELECT *, sum(coalesce(new, 0)) OVER (PARTITION BY take_id ORDER BY seq, word, s, e ROWS UNBOUNDED PRECEDING) AS line FROM t)
SELECT take_id, line::BIGINT AS line, string_agg(trim(word), ' ' ORDER BY seq, word, s, e) AS text, count(*) AS words FROM l GROUP BY ALL""")
def f38(spark: SparkSession, d: str) -> DataFrame:
    """Words flattened to takes and grouped again into lines, which a pause of a second ends."""
    order = ["seq", "word", "s", "e"]
    w = Window.partitionBy("take_id").orderBy(*order)
    t = words(spark, d).where("s is not null and e is not null").withColumn("new", F.coalesce(F.col("s") - F.lag("e").over(w) >= 1.0, F.lit(False)))
    line = t.withColumn("line", F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return line.groupBy("take_id", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda x: F.trim(x["word"])), " ").alias("text"), F.count(F.lit(1)).alias("words"))
