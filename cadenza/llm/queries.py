"""Queries of the operators for training data, pN_* for problem N."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.canonical import GENRE_ALIASES, map_to_reference
from cadenza.llm.encodings import clean_bigrams, restore
from cadenza.llm.leakage import leaked
from cadenza.llm.matching import match_records
from cadenza.llm.mixing import mix, token_counts
from cadenza.llm.names import act_of_spellings, name_bigrams, same_act_pairs
from cadenza.llm.readability import reading_levels
from cadenza.operators.packed import bare
from cadenza.plans.training_core import packed_genres
from cadenza.session import table


def text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole song files, artists and titles as (field, song_id, value)."""
    files = table(spark, sf_dir, "song_files").select(F.lit("text").alias("field"), "song_id", F.col("text").alias("value"))
    header = table(spark, sf_dir, "ultrastar_values").select("song_id", "artist", "title").distinct()
    return files.unionByName(header.select(F.lit("artist").alias("field"), "song_id", F.col("artist").alias("value"))).unionByName(
        header.select(F.lit("title").alias("field"), "song_id", F.col("title").alias("value"))
    )


def restored_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = text_values(spark, sf_dir)
    return restore(values, "value", clean_bigrams(values, "value"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored_values(spark, sf_dir).where("garbled").select("field", "song_id").distinct()


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored_values(spark, sf_dir).where("garbled").select("field", "song_id", "value", "restored")


def typed_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single genre values as typed: packed fields taken apart, the media's value whole."""
    packed = packed_genres(spark, sf_dir, 1).select(F.col("piece").alias("typed"))
    return packed.unionByName(table(spark, sf_dir, "media_info").select(bare(F.col("genre")).alias("typed")))


def mapped_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_to_reference(typed_genres(spark, sf_dir), "typed", table(spark, sf_dir, "genre_vocabulary"), "genre_id", "genre", aliases=GENRE_ALIASES)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped_genres(spark, sf_dir).select("typed", F.col("ref_id").alias("genre_id"))


def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values without an entry and how often each was typed."""
    return mapped_genres(spark, sf_dir).where("ref_id = 0").select("typed", "n")


NAMED = [("genre_song_fixes", "band", "title"), ("song_info", "artist", "title"), ("ultrastar_values", "artist", "title")]


def act_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spelling, entity) of all names of acts."""
    parts = [table(spark, sf_dir, t).select(F.col(c).alias("name"), F.col(title).alias("title")) for t, c, title in NAMED]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    bigrams = name_bigrams(both.select("name").unionAll(both.select("title")), "name")
    return act_of_spellings(both, "name", bigrams, title="title")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_act_pairs(act_names(spark, sf_dir))


def p3_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per spelling with the act it names."""
    return act_names(spark, sf_dir)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def mixed_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = token_counts(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text")
    return mix(sized.withColumn("members", F.array("source")), table(spark, sf_dir, "mix_targets"), doc_id="doc_id", members="members")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sources(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sources(spark, sf_dir)[1]


def p9_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture with each different text once, which may count for any of the sources that it comes from."""
    sized = token_counts(table(spark, sf_dir, "documents"), ["doc_id", "source", F.sha2("text", 256).alias("copy")], "text")
    once = sized.where("copy is not null").groupBy("copy").agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_set("source")).alias("members"), F.first("tokens").alias("tokens"))
    return mix(once.drop("copy"), table(spark, sf_dir, "mix_targets"), doc_id="doc_id", members="members")[0]


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents concerned, the items in them, the share of the item's words, and that of the question's."""
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


def matched_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes and media that are one song, wrongly decoded values restored first."""
    fixes = table(spark, sf_dir, "genre_song_fixes").select(F.col("fix_id").alias("id"), F.col("band").alias("act"), "title").distinct()
    media = table(spark, sf_dir, "media_info").select(F.col("media_id").alias("id"), F.col("artist").alias("act"), "title").distinct()
    both = fixes.unionByName(media)
    bigrams = name_bigrams(both.select("act").unionAll(both.select("title")), "act")

    def restored(df: DataFrame) -> DataFrame:
        acts = restore(df, "act", bigrams).select("id", F.col("restored").alias("act"), "title")
        return restore(acts, "title", bigrams).select("id", "act", F.col("restored").alias("title"))

    return match_records(restored(fixes), restored(media))


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs with the agreement of their values and a calibrated confidence."""
    return matched_songs(spark, sf_dir).select(F.col("left_id").alias("fix_id"), F.col("right_id").alias("media_id"), "agreement", "cosine", "confidence")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_matches(spark, sf_dir).select("fix_id", "media_id").distinct()


QUERIES = {"p2_found": p2_found, "p2_matches": p2_matches, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_overlapping": p9_overlapping, "p10_found": p10_found, "p3_found": p3_found, "p3_acts": p3_acts, "p4_found": p4_found, "p4_unmatched": p4_unmatched, "p1_found": p1_found, "p1_restored": p1_restored}
SQL: dict[str, str] = {}
