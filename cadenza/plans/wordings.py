"""Queries of wordings: lists, letters, languages, marks, numbers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import similarity
from cadenza.functions import wording as W
from cadenza.plans.training_core import vocabulary
from cadenza.session import table
from cadenza.sources import duets as D

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


_CAP = "upper(left(trim(p), 1)) || lower(trim(p)[2:])"


@query("f11_title_cased_list", f"""SELECT DISTINCT info_id, array_to_string(list_transform(list_filter(regexp_split_to_array(genres, '[;/,]'), lambda v: trim(v) <> ''), lambda v: array_to_string(list_transform(string_split(v, '-'), lambda p: {_CAP}), '-')), ', ') AS genres FROM song_info""")
def f11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "song_info").select("info_id", W.title_cased_list(F.col("genres")).alias("genres")).distinct()


@query("f14_shared_nouns", r"""WITH g AS (SELECT DISTINCT fix_id, genre FROM genre_song_fixes WHERE genre IS NOT NULL), i AS (SELECT fix_id, genre, unnest(regexp_split_to_array(regexp_replace(genre, '\([^)]*\)', ' ', 'g'), '[;,]')) AS item, generate_subscripts(regexp_split_to_array(regexp_replace(genre, '\([^)]*\)', ' ', 'g'), '[;,]'), 1) AS n FROM g),
p AS (SELECT fix_id, genre, n, list_filter(list_transform(string_split(item, '/'), lambda p: trim(regexp_replace(lower(p), '\s+', ' ', 'g'))), lambda p: p <> '') AS ps FROM i), q AS (SELECT *, string_split(ps[len(ps)], ' ')[-1] AS noun FROM p WHERE len(ps) > 0),
e AS (SELECT fix_id, genre, n, unnest(range(1, len(ps) + 1)) AS k, ps, noun FROM q), o AS (SELECT fix_id, genre, n, k, CASE WHEN k = len(ps) OR string_split(ps[k], ' ')[-1] IN ('metal', 'rock', 'punk', 'pop', 'core', 'music') OR noun NOT IN ('metal', 'rock', 'punk', 'pop', 'core', 'music') THEN ps[k] ELSE ps[k] || ' ' || noun END AS v FROM e),
f AS (SELECT fix_id, genre, v, min(n * 1000 + k) AS at FROM o GROUP BY ALL) SELECT g.fix_id, coalesce(string_agg(f.v, '|' ORDER BY f.at), '') AS genres FROM g LEFT JOIN f ON f.fix_id = g.fix_id AND f.genre = g.genre GROUP BY g.fix_id, g.genre""")
def f14(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "genre_song_fixes").where("genre is not null").select("fix_id", "genre").distinct()
    return g.select("fix_id", F.array_join(W.shared_noun_genres(F.col("genre")), "|").alias("genres"))


_RU = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e yo zh z i y k l m n o p r s t u f kh ts ch sh shch _ y _ e yu ya".replace("_", "").split(" "), strict=True)) + "}"


@query("f17_romanised", rf"""WITH w AS (SELECT DISTINCT word FROM notes WHERE regexp_matches(word, '[\x{{0400}}-\x{{04FF}}]')), r AS (SELECT word, array_to_string(list_transform(string_split(word, ''), lambda c: CASE WHEN {_RU}[lower(c)] IS NULL THEN c WHEN c <> lower(c) THEN upper(left({_RU}[lower(c)], 1)) || lower({_RU}[lower(c)][2:]) ELSE {_RU}[c] END), '') AS latin, regexp_replace(word, '\P{{L}}', '', 'g') AS letters FROM w)
SELECT word, CASE WHEN len(letters) > 1 AND letters = upper(letters) THEN upper(latin) ELSE latin END AS latin FROM r""")
def f17(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "notes").where(F.col("word").rlike(r"[\x{0400}-\x{04FF}]")).select("word").distinct()
    return w.select("word", W.romanised_russian(F.col("word")).alias("latin"))


@query("r34_song_language", """WITH s AS (SELECT song_id, bool_or(regexp_matches(word, '[іїєґІЇЄҐ]')) AS ua, bool_or(regexp_matches(word, '[\\x{0400}-\\x{04FF}]')) AS cyrillic FROM notes WHERE word IS NOT NULL GROUP BY song_id) SELECT song_id, CASE WHEN ua THEN 'ua' ELSE 'ru' END AS language FROM s WHERE cyrillic""")
def r34(spark: SparkSession, d: str) -> DataFrame:
    """The language of songs in Cyrillic letters, from all of a song's words."""
    n = table(spark, d, "notes").where("word is not null").groupBy("song_id").agg(F.max(W.cyrillic_language(F.col("word"))).alias("language"), F.max(F.col("word").rlike(r"[\x{0400}-\x{04FF}]")).alias("cyrillic"))
    return n.where("cyrillic").select("song_id", "language")


@query("pred9_language_code", "SELECT DISTINCT lang, CASE WHEN regexp_full_match(lower(trim(lang)), '[a-z]{2}') THEN lower(trim(lang)) ELSE '' END AS code FROM ultrastar_values WHERE lang IS NOT NULL")
def p9(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ultrastar_values").where("lang is not null").select("lang").distinct().select("lang", W.language_code(F.col("lang")).alias("code"))


@query("pred10_styles", r"""WITH g AS (SELECT DISTINCT genres FROM song_info WHERE genres IS NOT NULL), s AS (SELECT genres, list_sort(list_distinct(list_filter(list_transform(string_split(genres, ','), lambda v: regexp_replace(lower(trim(v)), '\s+', '_', 'g')), lambda v: v <> '' AND v NOT IN ('default', 'none')))) AS s FROM g)
SELECT genres, array_to_string(list_filter(s, lambda v: v IN ('rock', 'pop', 'hip-hop', 'death_metal')), ',') AS known, array_to_string(list_filter(s, lambda v: v NOT IN ('rock', 'pop', 'hip-hop', 'death_metal')), ',') AS unknown FROM s""")
def p10(spark: SparkSession, d: str) -> DataFrame:
    known, unknown = W.styles(F.col("genres"), ["rock", "pop", "hip-hop", "death_metal"], ["default", "none"])
    return table(spark, d, "song_info").where("genres is not null").select("genres").distinct().select("genres", F.array_join(known, ",").alias("known"), F.array_join(unknown, ",").alias("unknown"))


@query("f6_nearest_word", """WITH t AS (SELECT DISTINCT genre FROM media_info WHERE genre IS NOT NULL) SELECT t.genre, arg_min(v.genre, {'d': levenshtein(t.genre, v.genre), 'w': v.genre}) AS nearest FROM t, genre_vocabulary v GROUP BY t.genre""")
def f6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "media_info").where("genre is not null").select("genre").distinct().select("genre", W.nearest_word(F.col("genre"), vocabulary(spark, d)).alias("nearest"))


@query("f5_swap_distance")
def f5(spark: SparkSession, d: str) -> DataFrame:
    """Titles against their letters sorted in pairs: edits and swaps of neighbours."""
    m = table(spark, d, "media_info").where("title is not null").select("title").distinct()
    swapped = F.regexp_replace("title", r"(\w)(\w)(\w)", "$2$1$3")
    return m.select("title", similarity.osa_column(F.col("title"), swapped).alias("distance"))


@query("f39_image_kind", "SELECT event_id, ['jpg', 'png', 'gif', 'webp', NULL][event_id % 5 + 1] AS kind FROM events")
def f39(spark: SparkSession, d: str) -> DataFrame:
    starts = F.array(*[F.lit(x) for x in ("FFD8FFE0", "89504E470D0A1A0A", "474946383961", "524946460000000057454250", "25504446")])
    content = F.unhex(F.concat(F.get(starts, (F.col("event_id") % 5).cast("int")), F.hex(F.encode("event_type", "UTF-8"))))
    return table(spark, d, "events").select("event_id", W.image_kind(content).alias("kind"))


@query("f18_singer_marks", r"""WITH l AS (SELECT doc_id, ['P1: ', 'p2:', 'P1 + P2: ', ''][doc_id % 4 + 1] || coalesce(song_title, '') AS line FROM documents), m AS (SELECT doc_id, line, '(?i)^\s*(P\s*[12](?:\s*\+\s*P\s*[12])?)\s*:\s*' AS re FROM l), u AS (SELECT doc_id, line, upper(regexp_replace(regexp_extract(line, '(?i)^\s*(P\s*[12](?:\s*\+\s*P\s*[12])?)\s*:\s*', 1), '\s', '', 'g')) AS mark FROM m)
SELECT doc_id, CASE WHEN contains(mark, '+') THEN 'both' WHEN mark <> '' THEN mark END AS singer, CASE WHEN mark <> '' THEN regexp_replace(line, '(?i)^\s*(P\s*[12](?:\s*\+\s*P\s*[12])?)\s*:\s*', '') ELSE line END AS line FROM u""")
def f18(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.get(F.array(F.lit("P1: "), F.lit("p2:"), F.lit("P1 + P2: "), F.lit("")), (F.col("doc_id") % 4).cast("int")), F.coalesce("song_title", F.lit("")))
    singer, sung = D.singer_mark(line)
    return table(spark, d, "documents").select("doc_id", singer.alias("singer"), sung.alias("line"))


@query("f18_sung_by", r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '^\x{FEFF}', ''), '\r\n|\n|\r')) AS line, generate_subscripts(regexp_split_to_array(regexp_replace(text, '^\x{FEFF}', ''), '\r\n|\n|\r'), 1) AS line_no FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, CASE WHEN regexp_matches(trim(line), '^\[[^\[\]]*\]$') AND NOT regexp_matches(trim(line), '^\[\d+:\d+') THEN regexp_extract(trim(line), '^\[([^\[\]]*)\]$', 1) END AS ins FROM l),
n AS (SELECT *, CASE WHEN ins IS NOT NULL THEN list_filter(list_transform(regexp_split_to_array(translate(CASE WHEN contains(ins, ':') THEN regexp_extract(ins, '^[^:]*:(?s:(.*))$', 1) WHEN regexp_replace(lower(regexp_split_to_array(trim(ins), '\s+')[1]), '[0-9:]+$', '') NOT IN ('verse', 'chorus', 'pre-chorus', 'prechorus', 'post-chorus', 'postchorus', 'bridge', 'intro', 'outro', 'hook', 'refrain', 'interlude', 'skit', 'breakdown', 'instrumental', 'part', 'strophe', 'spoken', 'drop', 'segue', 'coda', 'break', 'vamp', 'rap', 'solo', 'chant', 'ad-libs', 'produced', 'zwischenspiel') THEN ins ELSE '' END, '()', ',,'), '(?i)\s*(?:,|&|\+|/|\band\b|\bwith\b|\bfeat\.?|\bft\.?)\s*'), lambda x: regexp_replace(x, '^[ .]+|[ .]+$', '', 'g')), lambda x: x <> '') END AS own FROM h),
w AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS names FROM n)
SELECT doc_id, line_no::INT AS line_no, line, CASE WHEN len(names) = 1 AND lower(names[1]) <> 'both' THEN names[1] END AS singer FROM w WHERE own IS NULL AND trim(line) <> ''""")
def f18_headers(spark: SparkSession, d: str) -> DataFrame:
    return D.sung_by(table(spark, d, "documents").where("text is not null").select("doc_id", "text"), "doc_id", "text")


@query("f19_numbers_in_words")
def f19(spark: SparkSession, d: str) -> DataFrame:
    """Titles with their number of the catalogue, in words of their language."""
    m = table(spark, d, "media_info").select("media_id", "lang", "title").distinct()
    return m.select("media_id", W.in_words(F.concat_ws(" ", "title", F.col("media_id").cast("string")), F.coalesce("lang", F.lit(""))).alias("spoken"))


@query("f15_hyphenated")
def f15(spark: SparkSession, d: str) -> DataFrame:
    """Words in syllables by a small set of patterns: a consonant between vowels begins one, and so does the last of several."""
    patterns = [f"{a}1{c}{b}" for a in "aeiou" for b in "aeiou" for c in "bcdfghjklmnpqrstvwxz"] + [f"{c}1{d_}" for c in "lmnr" for d_ in "bcdfgklmnprstvz"]
    n = table(spark, d, "notes").where("word is not null").select("word").distinct()
    return n.select("word", F.array_join(W.hyphenated(F.col("word"), patterns), "-").alias("parts"))


@query("r23_page_artefacts", r"""WITH x AS (SELECT doc_id, list_concat(list_concat([coalesce(song_title, '') || ' Lyrics'], regexp_split_to_array(text, '\n')), [doc_id || 'Embed']) AS ls FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(ls[2:len(ls) - 1], chr(10)) AS text FROM x""")
def r23(spark: SparkSession, d: str) -> DataFrame:
    lines = F.concat(F.array(F.concat(F.coalesce("song_title", F.lit("")), F.lit(" Lyrics"))), F.split("text", "\n", -1), F.array(F.concat(F.col("doc_id").cast("string"), F.lit("Embed"))))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(W.drop_page_artefacts(lines), "\n").alias("text"))
