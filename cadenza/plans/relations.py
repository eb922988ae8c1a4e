"""Queries of the join, set, sort and state operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import joins as J
from cadenza.operators.windows import first_seen
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
EV = "e AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events)"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


@query("j1_nearest", f"""WITH {EV}, l AS (SELECT user_id, event_id, t FROM e WHERE event_type = 'click'), r AS (SELECT user_id, t, max(event_id) AS r_event_id FROM e WHERE event_type = 'purchase' GROUP BY ALL)
SELECT user_id, event_id, r_event_id FROM (SELECT l.*, r.r_event_id, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(r.t - l.t), r.t DESC NULLS LAST) AS n FROM l LEFT JOIN r USING (user_id)) WHERE n = 1""")
def j1(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("user_id", "event_id", "t", "event_type")
    left, right = e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type")
    return J.nearest(left, right, ["user_id"], "t", ["event_id"], unique="event_id").select("user_id", "event_id", "r_event_id")


@query("j2_range_join", f"""WITH {EV}, i AS (SELECT event_id AS window_id, user_id, t AS s, t + 43200 AS f FROM e WHERE event_type = 'view')
SELECT i.window_id, count(*) AS events, round(sum(e.value), 4) AS total FROM i JOIN e ON e.user_id = i.user_id AND e.t >= i.s AND e.t < i.f GROUP BY i.window_id""")
def j2(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    windows = e.where("event_type = 'view'").select(F.col("event_id").alias("window_id"), "user_id", F.col("t").alias("s"), (F.col("t") + 43200).alias("f"))
    met = J.range_join(windows, e.select("user_id", "t", "value"), ["user_id"], "s", "f", "t", 43200.0)
    return met.groupBy("window_id").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"))


@query("j3_subtract_intervals", f"""WITH {EV}, w AS (SELECT event_id AS row_id, user_id, t AS s, t + 200000 AS f FROM e WHERE event_type = 'view'), h AS (SELECT user_id, t AS s, t + 60000 AS f FROM e WHERE event_type = 'purchase'),
m AS (SELECT w.row_id, w.user_id, w.s, w.f, h.s AS hs, h.f AS hf FROM w LEFT JOIN h ON h.user_id = w.user_id AND h.s < w.f AND h.f > w.s),
b AS (SELECT *, max(hf) OVER (PARTITION BY row_id ORDER BY hs, hf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m WHERE hs IS NOT NULL),
p AS (SELECT row_id, user_id, greatest(coalesce(reach, s), s) AS a, hs AS z FROM b UNION ALL SELECT row_id, user_id, greatest(coalesce(max(hf), any_value(s)), any_value(s)), any_value(f) FROM m GROUP BY row_id, user_id)
SELECT user_id, row_id, (row_number() OVER (PARTITION BY row_id ORDER BY a) - 1)::INT AS piece, round(a, 3) AS piece_start, round(z, 3) AS piece_end FROM p WHERE z - a >= 1""")
def j3(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    rows = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("row_id"), F.col("t").alias("s"), (F.col("t") + 200000).alias("f"))
    holes = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("s"), (F.col("t") + 60000).alias("f"))
    cut = J.subtract_intervals(rows, holes, ["user_id"], "s", "f", row="row_id", least=1.0, width=200000.0)
    return cut.select("user_id", "row_id", "piece", F.round("piece_start", 3).alias("piece_start"), F.round("piece_end", 3).alias("piece_end"))


@query("j5_normalised_join", "SELECT DISTINCT f.fix_id, m.media_id FROM genre_song_fixes f JOIN media_info m ON lower(trim(f.band)) = lower(trim(m.artist)) AND lower(trim(f.title)) = lower(trim(m.title))")
def j5(spark: SparkSession, d: str) -> DataFrame:
    key = lambda a, b: F.struct(F.lower(F.trim(a)), F.lower(F.trim(b)))
    f = table(spark, d, "genre_song_fixes").select("fix_id", key("band", "title").alias("key")).distinct()
    m = table(spark, d, "media_info").select("media_id", key("artist", "title").alias("key"), "artist").where("artist is not null").distinct()
    return f.join(m, "key").select("fix_id", "media_id").distinct()


@query("j6_not_done", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j6(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(done, "o_orderkey", "left_anti").select("o_orderkey")


@query("j7_current_only", "SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY user_id")
def j7(spark: SparkSession, d: str) -> DataFrame:
    current = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return events(spark, d).join(current, "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("j8_upsert", """WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey, 'N' AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0)
SELECT o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(o.o_totalprice, 0.0) AS o_totalprice FROM o FULL JOIN n USING (o_orderkey)""")
def j8(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    new = orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("N").alias("o_orderstatus"))
    return J.upsert(orders.where("o_orderkey % 3 <> 0"), new, ["o_orderkey"], ["o_orderstatus"], {"o_totalprice": 0.0})


@query("j9_map_values", """WITH m(part, bases) AS (VALUES ('rock', ['Rock']), ('folk rock', ['Folk', 'Rock']), ('karaoke', []::VARCHAR[])),
p AS (SELECT info_id, unnest(string_split(genres, ';')) AS part, generate_subscripts(string_split(genres, ';'), 1) AS pos FROM (SELECT DISTINCT info_id, genres FROM song_info WHERE genres IS NOT NULL)),
b AS (SELECT info_id, pos, unnest(coalesce(bases, [p.part])) AS v, generate_subscripts(coalesce(bases, [p.part]), 1) AS sub FROM p LEFT JOIN m ON m.part = lower(p.part)),
f AS (SELECT info_id, min({'pos': pos, 'sub': sub, 'v': v}) AS f FROM b GROUP BY info_id, lower(v))
SELECT i.info_id, coalesce(string_agg(f.v, '|' ORDER BY f.pos, f.sub), '') AS mapped FROM (SELECT DISTINCT info_id FROM song_info WHERE genres IS NOT NULL) i LEFT JOIN f USING (info_id) GROUP BY i.info_id""")
def j9(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "song_info").where("genres is not null").select("info_id", "genres").distinct()
    mapping = spark.createDataFrame([("rock", ["Rock"]), ("folk rock", ["Folk", "Rock"]), ("karaoke", [])], "part string, base array<string>")
    return J.map_values(df, mapping, "info_id", F.split("genres", ";"), "part", "base").select("info_id", F.array_join("mapped", "|").alias("mapped"))


@query("j10_first_section", """WITH s AS (SELECT user_id, event_id, event_type AS tag, CASE WHEN value > 60 THEN value END AS body FROM events)
SELECT s.event_id, coalesce(s.body, f.b) AS resolved FROM s LEFT JOIN (SELECT user_id, tag, arg_min(body, event_id) AS b FROM s WHERE body IS NOT NULL GROUP BY ALL) f USING (user_id, tag)""")
def j10(spark: SparkSession, d: str) -> DataFrame:
    df = events(spark, d).select("user_id", "event_id", F.col("event_type").alias("tag"), F.when(F.col("value") > 60, F.col("value")).alias("body"))
    return J.first_section(df, ["user_id"], "event_id", "tag", "body").select("event_id", "resolved")


@query("j14_nearest_label", f"""WITH {EV}, x AS (SELECT user_id, event_id, t, CASE WHEN value > 90 THEN event_type END AS label FROM e)
SELECT event_id, filled FROM (SELECT a.event_id, b.label AS filled, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t), b.t, b.event_id DESC) AS n FROM x a LEFT JOIN x b ON a.user_id = b.user_id AND b.label IS NOT NULL) WHERE n = 1""")
def j14(spark: SparkSession, d: str) -> DataFrame:
    df = events(spark, d).withColumn("label", F.when(F.col("value") > 90, F.col("event_type")))
    return J.nearest_label(df, ["user_id"], "t", "label", "event_id").select("event_id", "filled")


@query("j15_longest_prefix", """WITH p(prefix, value) AS (VALUES ('library/', 'library'), ('library/The ', 'the'), ('library/THE L', 'lantern'), ('library/Margarethe', 'margarethe'))
SELECT song_id, value FROM (SELECT s.song_id, p.value, row_number() OVER (PARTITION BY s.song_id ORDER BY length(p.prefix) DESC) AS n FROM song_files s LEFT JOIN p ON starts_with(s.file_path, p.prefix)) WHERE n = 1""")
def j15(spark: SparkSession, d: str) -> DataFrame:
    prefixes = [("library/", "library"), ("library/The ", "the"), ("library/THE L", "lantern"), ("library/Margarethe", "margarethe")]
    files = table(spark, d, "song_files").select("song_id", "file_path")
    return J.longest_prefix(files, spark.createDataFrame(prefixes, "prefix string, value string"), "song_id", "file_path", "prefix", "value", sorted({len(p) for p, _ in prefixes})).select("song_id", "value")


@query("j17_zip", """WITH a AS (SELECT DISTINCT song_id, note_seq, min(word) AS word FROM notes WHERE voice = 'P1' GROUP BY ALL), b AS (SELECT song_id, note_seq, max(pitch) AS pitch FROM notes WHERE voice = 'P2' GROUP BY ALL)
SELECT song_id, note_seq, word, pitch FROM a JOIN b USING (song_id, note_seq)""")
def j17(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "notes")
    a = n.where("voice = 'P1'").groupBy("song_id", "note_seq").agg(F.min("word").alias("word"))
    b = n.where("voice = 'P2'").groupBy("song_id", "note_seq").agg(F.max("pitch").alias("pitch"))
    return a.join(b, ["song_id", "note_seq"])


_N = "SELECT DISTINCT song_id, beat, trim(word) AS word, note_seq, voice FROM notes WHERE voice IS NOT NULL"


@query("j20_pair_up", f"""WITH n AS ({_N}), k AS (SELECT *, row_number() OVER (PARTITION BY song_id, beat, word, voice ORDER BY note_seq) AS nth FROM n)
SELECT coalesce(a.song_id, b.song_id) AS song_id, a.note_seq AS a_row, b.note_seq AS b_row FROM (SELECT * FROM k WHERE voice = 'P1') a FULL JOIN (SELECT * FROM k WHERE voice = 'P2') b
ON a.song_id = b.song_id AND a.beat = b.beat AND a.word = b.word AND a.nth = b.nth""")
def j20(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "notes").where("voice is not null").select("song_id", "beat", F.trim("word").alias("word"), "note_seq", "voice").distinct()
    return J.pair_up(n.where("voice = 'P1'"), n.where("voice = 'P2'"), ["song_id", "beat", "word"], "note_seq").select("song_id", "a_row", "b_row")


@query("j21_availability", """WITH a AS (SELECT lower(trim(artist)) AS name, count(DISTINCT song_id) AS files FROM ultrastar_values GROUP BY 1), w AS (SELECT DISTINCT lower(trim(band)) AS name FROM genre_song_fixes)
SELECT w.name, CASE WHEN files IS NULL THEN 'missing' WHEN files > 1 THEN 'several' ELSE 'found' END AS state FROM w LEFT JOIN a USING (name)""")
def j21(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "ultrastar_values").groupBy(F.lower(F.trim("artist")).alias("name")).agg(F.count_distinct("song_id").alias("files"))
    w = table(spark, d, "genre_song_fixes").select(F.lower(F.trim("band")).alias("name")).distinct()
    return w.join(a, "name", "left").select("name", F.when(F.col("files").isNull(), "missing").when(F.col("files") > 1, "several").otherwise("found").alias("state"))


@query("x1_union_of_ids", "SELECT song_id FROM song_files UNION SELECT song_id FROM notes UNION SELECT song_id FROM timed_words")
def x1(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda t: table(spark, d, t).select("song_id").distinct()
    return ids("song_files").union(ids("notes")).union(ids("timed_words")).distinct()


@query("x2_union_distinct", """WITH a AS (SELECT DISTINCT band, title FROM genre_song_fixes), b AS (SELECT DISTINCT artist AS band, title FROM song_info),
n AS (SELECT min({'band': band, 'title': title}) AS r FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE lower(a.band) || chr(9) || lower(a.title) = lower(b.band) || chr(9) || lower(b.title)) GROUP BY lower(band) || chr(9) || lower(title))
SELECT band, title FROM a UNION ALL SELECT r.band, r.title FROM n""")
def x2(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "genre_song_fixes").select("band", "title").distinct()
    b = table(spark, d, "song_info").select(F.col("artist").alias("band"), "title").distinct()
    return J.union_distinct(a, b, F.concat(F.lower("band"), F.lit("\t"), F.lower("title")))


@query("x3_overlap", "SELECT DISTINCT media_id FROM media_info WHERE list_has_any(string_split(lower(title), ' '), ['garden', 'river', 'lantern'])")
def x3(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(F.lit("garden"), F.lit("river"), F.lit("lantern"))
    return table(spark, d, "media_info").where(F.arrays_overlap(F.split(F.lower("title"), " "), words)).select("media_id").distinct()


@query("x4_unknown_values", """SELECT info_id, string_agg(v, '|' ORDER BY v) AS unknown FROM (SELECT DISTINCT info_id, unnest(string_split(lower(genres), ', ')) AS v FROM song_info WHERE genres IS NOT NULL)
WHERE v NOT IN (SELECT lower(genre) FROM genre_vocabulary) GROUP BY info_id""")
def x4(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "genre_vocabulary").select(F.lower("genre").alias("v"))
    df = table(spark, d, "song_info").where("genres is not null").select("info_id", F.explode(F.split(F.lower("genres"), ", ")).alias("v")).distinct()
    each = df.join(J.small(known), "v", "left_anti")
    return each.groupBy("info_id").agg(F.array_join(F.array_sort(F.collect_list("v")), "|").alias("unknown"))


@query("x5_distinct_ignoring_case", "SELECT band, first AS fix_id FROM (SELECT lower(band) AS low, arg_min(band, fix_id) AS band, min(fix_id) AS first FROM genre_song_fixes WHERE band IS NOT NULL GROUP BY 1)")
def x5(spark: SparkSession, d: str) -> DataFrame:
    return J.distinct_ignoring_case(table(spark, d, "genre_song_fixes"), [], "band", ["fix_id"])


@query("x6_new_output", "SELECT song_id, title FROM ultrastar_values EXCEPT ALL SELECT song_id, title FROM ultrastar_values WHERE song_id % 2 = 0")
def x6(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "ultrastar_values").select("song_id", "title")
    return u.exceptAll(u.where("song_id % 2 = 0"))


@query("t1_mixed_sort", "SELECT genre, songs, row_number() OVER (ORDER BY songs DESC, lower(genre), genre) AS place FROM (SELECT genre, count(*) AS songs FROM media_info WHERE genre IS NOT NULL GROUP BY genre) ")
def t1(spark: SparkSession, d: str) -> DataFrame:
    """All genres in the report's order. Their places come from a range sort and the ranges' sizes, not from one task."""
    counts = table(spark, d, "media_info").where("genre is not null").groupBy("genre").agg(F.count(F.lit(1)).alias("songs"))
    return J.numbered(counts, [F.desc("songs"), F.lower("genre"), F.col("genre")], "place")


@query("t2_top_three", "SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem) WHERE place <= 3")
def t2(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return J.top_of(df, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3).select("l_suppkey", "l_orderkey", "l_linenumber", "place")


@query("t3_arg_extremes", "SELECT l_partkey, arg_min(l_orderkey, {'p': l_extendedprice, 'o': l_orderkey, 'l': l_linenumber}) AS cheapest, arg_max(l_orderkey, {'p': l_extendedprice, 'o': l_orderkey, 'l': l_linenumber}) AS dearest FROM lineitem GROUP BY l_partkey")
def t3(spark: SparkSession, d: str) -> DataFrame:
    by = F.struct("l_extendedprice", "l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min_by("l_orderkey", by).alias("cheapest"), F.max_by("l_orderkey", by).alias("dearest"))


@query("t4_worst_five", "SELECT * FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY abs(value - 50) DESC, event_id) AS place FROM events WHERE value IS NOT NULL) WHERE place <= 5")
def t4(spark: SparkSession, d: str) -> DataFrame:
    return J.top_of(events(spark, d).where("value is not null"), ["event_type"], [F.desc(F.abs(F.col("value") - 50)), F.col("event_id")], 5).select("event_type", "event_id", "place")


@query("t5_seeded_order", "SELECT song_id, md5('42|' || file_path) AS draw FROM song_files")
def t5(spark: SparkSession, d: str) -> DataFrame:
    """A seeded order of all files: the same seed, the same order, whatever the partitions."""
    return table(spark, d, "song_files").select("song_id", F.md5(F.concat(F.lit("42|"), "file_path")).alias("draw")).orderBy("draw", "song_id")


@query("t7_label_sort", "SELECT song_id, file_path FROM song_files ORDER BY lower(file_path), song_id")
def t7(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "song_files").select("song_id", "file_path").orderBy(F.lower("file_path"), "song_id")


@query("t8_top_and_more", "SELECT genre, songs, more FROM (SELECT genre, songs, row_number() OVER (ORDER BY songs DESC, genre) AS n, count(*) OVER () - 8 AS more FROM (SELECT genre, count(*) AS songs FROM media_info WHERE genre IS NOT NULL GROUP BY genre)) WHERE n <= 8")
def t8(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "media_info").where("genre is not null").groupBy("genre").agg(F.count(F.lit(1)).alias("songs"))
    more = counts.agg((F.count(F.lit(1)) - 8).alias("more"))
    return counts.orderBy(F.desc("songs"), "genre").limit(8).crossJoin(F.broadcast(more))


@query("c1_plan_union", """SELECT 'fix-' || fix_id AS id, 'fix' AS kind, coalesce(band, '') || ' - ' || coalesce(title, '') AS label FROM (SELECT DISTINCT fix_id, band, title FROM genre_song_fixes)
UNION ALL SELECT 'media-' || media_id, 'media', coalesce(artist, '') || ' - ' || coalesce(title, '') FROM (SELECT DISTINCT media_id, artist, title FROM media_info)""")
def c1(spark: SparkSession, d: str) -> DataFrame:
    def part(name: str, key: str, act: str, kind: str) -> DataFrame:
        df = table(spark, d, name).select(key, act, "title").distinct()
        return df.select(F.concat_ws("-", F.lit(kind), key).alias("id"), F.lit(kind).alias("kind"), F.concat(F.coalesce(act, F.lit("")), F.lit(" - "), F.coalesce("title", F.lit(""))).alias("label"))

    return part("genre_song_fixes", "fix_id", "band", "fix").unionByName(part("media_info", "media_id", "artist", "media"))


@query("c4_changed", "SELECT a.song_id FROM (SELECT song_id, min(genre) AS g FROM ultrastar_values GROUP BY 1) a JOIN (SELECT song_id, max(genre) AS g FROM ultrastar_values GROUP BY 1) b USING (song_id) WHERE a.g IS DISTINCT FROM b.g")
def c4(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "ultrastar_values").groupBy("song_id").agg(F.min("genre").alias("a"), F.max("genre").alias("b"))
    return g.where(~F.col("a").eqNullSafe(F.col("b"))).select("song_id")


@query("c10_unique_names", """SELECT song_id, name || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END AS name FROM (SELECT song_id, title AS name, row_number() OVER (PARTITION BY lower(title) ORDER BY song_id) AS n FROM (SELECT song_id, min(title) AS title FROM ultrastar_values GROUP BY song_id))""")
def c10(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "ultrastar_values").groupBy("song_id").agg(F.min("title").alias("title"))
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(F.lower("title")).orderBy("song_id"))
    return u.withColumn("n", n).select("song_id", F.when(F.col("n") > 1, F.concat("title", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("title")).alias("name"))


@query("r19_pivot_pairs", "SELECT l_orderkey, max(l_extendedprice) FILTER (l_returnflag = 'A') AS a, max(l_extendedprice) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_orderkey")
def r19(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").groupBy("l_orderkey").pivot("l_returnflag", ["A", "R"]).agg(F.max("l_extendedprice"))
    return p.select("l_orderkey", F.col("A").alias("a"), F.col("R").alias("r"))


@query("r28_started_not_finished", "SELECT song_id FROM song_files WHERE song_id NOT IN (SELECT song_id FROM timed_words)")
def r28(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "song_files").select("song_id").join(table(spark, d, "timed_words").select("song_id").distinct(), "song_id", "left_anti")


@query("c3_first_and_reset", "SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 'done' ELSE 'pending' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def c3(spark: SparkSession, d: str) -> DataFrame:
    e = first_seen(events(spark, d).select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"])
    return e.select("user_id", "event_id", F.when(F.col("event_type") == "purchase", "done").otherwise("pending").alias("status"))
