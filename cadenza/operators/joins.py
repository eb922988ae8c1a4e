"""Join-shaped operators: nearest time, ranges, differences of intervals, mappings, merges, prefixes, pairings."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.session import checkpoint, estimated_bytes

#: A side up to this estimated size is sent to every task; larger ones are shuffled.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint if its estimated size allows; otherwise as it is, for the planner to shuffle."""
    return F.broadcast(df) if estimated_bytes(df) <= BROADCAST_BYTES else df


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], *, unique: str) -> DataFrame:
    """Each left row with the right row of its keys that is nearest in `at`; a tie goes to the later one.

    One union, sorted once by (keys, at): the last right row before and the
    first after come from running windows, so nothing is joined or exploded.
    unique: a right column that makes right rows of equal time differ (the
    largest is taken). Columns of the right come as r_<name>.
    """
    kept = F.struct(F.col(at).alias("at"), *[F.col(v).alias(v) for v in values])
    best = right.where(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.max_by(kept, unique).alias("__right"))
    right_rows = best.select(*keys, F.col(at).alias("__at"), F.lit(0).alias("__side"), "__right")
    names = [c for c in left.columns if c not in keys]
    rows = left.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*names).alias("__left")).unionByName(right_rows, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__at", "__side")
    before = F.last("__right", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    back = Window.partitionBy(*keys).orderBy(F.desc("__at"), F.desc("__side"))
    after = F.last("__right", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = rows.withColumn("__b", before).withColumn("__a", after).where("__side = 1")
    near = F.when(F.col("__b").isNull(), F.col("__a")).when(F.col("__a").isNull(), F.col("__b")).when(F.col("__a")["at"] - F.col("__at") <= F.col("__at") - F.col("__b")["at"], F.col("__a")).otherwise(F.col("__b"))
    return found.withColumn("__n", near).select(*keys, *[F.col("__left")[c].alias(c) for c in names], *[F.col("__n")[c].alias(f"r_{c}") for c in ["at", *values]])


def range_join(intervals: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, at: str, width: float) -> DataFrame:
    """Points within half-open intervals of the same keys, by equal time buckets of `width`: an equi-join instead of a comparison of all.

    A long interval meets the buckets that it spans. Columns of both sides are
    kept, so their names must differ but for the keys.
    """
    spanned = intervals.where(F.col(end) > F.col(start)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    placed = points.withColumn("__b", F.floor(F.col(at) / width))
    return spanned.join(placed, [*keys, "__b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__b")


def subtract_intervals(df: DataFrame, holes: DataFrame, keys: list[str], start: str, end: str, *, row: str, least: float, width: float) -> DataFrame:
    """What is left of each row's interval without the holes of its keys, in pieces of at least `least`: keys, row, piece from 0, start, end.

    Touching doesn't overlap. Holes may overlap each other. Rows meet only
    holes of the same buckets of `width` (about a row's length), in the first
    bucket that both span, so a hot key is no comparison of all with all.
    """
    spans = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    cut = holes.select(*keys, F.col(start).alias("h_start"), F.col(end).alias("h_end")).where("h_end > h_start").withColumn("__b", spans("h_start", "h_end"))
    spanned = df.select(*keys, row, start, end).where(F.col(end) > F.col(start)).withColumn("__b", spans(start, end))
    first = F.greatest(F.floor(F.col(start) / width), F.floor(F.col("h_start") / width))
    met = spanned.join(cut, [*keys, "__b"]).where((F.col("h_start") < F.col(end)) & (F.col("h_end") > F.col(start)) & (F.col("__b") == first))
    touched = met.groupBy(*keys, row).agg(F.array_sort(F.collect_list(F.struct("h_start", "h_end"))).alias("holes"))
    whole = df.select(*keys, row, start, end).join(touched, [*keys, row], "left").withColumn("holes", F.coalesce("holes", F.array().cast("array<struct<h_start:double,h_end:double>>")))
    # Walking the sorted holes keeps the end of what is covered so far; the pieces lie between.
    zero = F.struct(F.col(start).cast("double").alias("at"), F.array().cast("array<struct<s:double,e:double>>").alias("pieces"))
    walked = F.aggregate(
        "holes",
        zero,
        lambda acc, h: F.struct(
            F.greatest(acc["at"], h["h_end"]).alias("at"),
            F.when(h["h_start"] > acc["at"], F.concat(acc["pieces"], F.array(F.struct(acc["at"].alias("s"), h["h_start"].alias("e"))))).otherwise(acc["pieces"]).alias("pieces"),
        ),
    )
    last = F.when(F.col("__w")["at"] < F.col(end), F.concat(F.col("__w")["pieces"], F.array(F.struct(F.col("__w")["at"].alias("s"), F.col(end).cast("double").alias("e"))))).otherwise(F.col("__w")["pieces"])
    pieces = whole.withColumn("__w", walked).withColumn("__p", F.filter(last, lambda p: p["e"] - p["s"] >= least))
    return pieces.select(*keys, row, F.posexplode("__p").alias("piece", "__x")).select(*keys, row, "piece", F.col("__x")["s"].alias("piece_start"), F.col("__x")["e"].alias("piece_end"))


def map_values(df: DataFrame, mapping: DataFrame, row: str, values: Column, part: str, base: str) -> DataFrame:
    """Each row's values through a one-to-many mapping, in order, without repeats (ignoring case, the first kept).

    mapping: (part, base) with base an array; an empty one drops the part, a
    part without entry stays. Result: row, mapped (an array, maybe empty).
    """
    each = df.select(row, F.posexplode(values).alias("pos", "__part"))
    known = mapping.select(F.lower(part).alias("__key"), F.col(base).alias("__base"))
    met = each.withColumn("__key", F.lower("__part")).join(small(known), "__key", "left")
    bases = met.select(row, "pos", F.posexplode(F.coalesce("__base", F.array("__part"))).alias("sub", "__value"))
    first = bases.groupBy(row, F.lower("__value").alias("__low")).agg(F.min(F.struct("pos", "sub", "__value")).alias("f"))
    joined = first.groupBy(row).agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["__value"]).alias("mapped"))
    return df.select(row).distinct().join(joined, row, "left").select(row, F.coalesce("mapped", F.array().cast("array<string>")).alias("mapped"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], refresh: list[str], keep: dict[str, object]) -> DataFrame:
    """Rows of either side: `refresh` columns from the new row where there is one, `keep` columns from the old one or their defaults."""
    o = old.select(*keys, *[F.col(c).alias(f"o_{c}") for c in [*refresh, *keep]], F.lit(True).alias("__old"))
    n = new.select(*keys, *[F.col(c).alias(f"n_{c}") for c in refresh], F.lit(True).alias("__new"))
    both = o.join(n, keys, "full_outer")
    fresh = [F.when(F.col("__new"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in refresh]
    kept = [F.when(F.col("__old"), F.col(f"o_{c}")).otherwise(F.lit(d)).alias(c) for c, d in keep.items()]
    return both.select(*keys, *fresh, *kept)


def longest_prefix(df: DataFrame, prefixes: DataFrame, row: str, text: str, prefix: str, value: str, lengths: list[int]) -> DataFrame:
    """Each row's text with the value of the longest prefix that it begins with; null without one.

    lengths: the lengths that prefixes have, so that each is an equi-join key
    rather than a comparison with all prefixes.
    """
    tried = df.select(row, text, F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n")).where(F.length(text) >= F.col("n")).withColumn("__key", F.expr(f"substring({text}, 1, n)"))
    met = tried.join(small(prefixes.select(F.col(prefix).alias("__key"), F.col(value).alias("__value"))), "__key").groupBy(row).agg(F.max_by("__value", "n").alias(value))
    return df.select(row, text).join(met, row, "left")


def pair_up(a: DataFrame, b: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Rows of both sides with equal keys paired in order, the first with the first; the rest alone: keys, a_row, b_row."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(row))
    left = a.select(*keys, F.col(row).alias("a_row"), nth.alias("nth"))
    right = b.select(*keys, F.col(row).alias("b_row"), nth.alias("nth"))
    return left.join(right, [*keys, "nth"], "full_outer").drop("nth")


def nearest_label(df: DataFrame, keys: list[str], at: str, label: str, row: str) -> DataFrame:
    """Unlabelled rows take the label of their keys' nearest labelled row; a tie goes to the earlier one."""
    w = Window.partitionBy(*keys).orderBy(at, row)
    mark = F.when(F.col(label).isNotNull(), F.struct(F.col(at).alias("at"), F.col(label).alias("label")))
    df = df.withColumn("__m", mark)
    df = df.withColumn("__b", F.last("__m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__a", F.first("__m", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    later = F.col("__b").isNull() | (F.col("__a")["at"] - F.col(at) < F.col(at) - F.col("__b")["at"])
    return df.withColumn("filled", F.when(F.col("__a").isNull(), F.col("__b")["label"]).when(later, F.col("__a")["label"]).otherwise(F.col("__b")["label"])).drop("__m", "__a", "__b")


def first_section(df: DataFrame, keys: list[str], number: str, tag: str, body: str) -> DataFrame:
    """Sections without a body take that of their keys' first section of the same tag that has one."""
    captured = df.where(F.col(body).isNotNull()).groupBy(*keys, tag).agg(F.min_by(body, number).alias("__body"))
    return df.join(captured, [*keys, tag], "left").withColumn("resolved", F.coalesce(body, "__body")).drop("__body")


def union_distinct(existing: DataFrame, added: DataFrame, key: Column) -> DataFrame:
    """Existing rows, and those added whose key no existing row has; of added rows with one key, the least by all columns."""
    old = existing.withColumn("__key", key)
    new = added.withColumn("__key", key).join(old.select("__key").distinct(), "__key", "left_anti")
    least = new.groupBy("__key").agg(F.min(F.struct(*added.columns)).alias("r")).select(*[F.col("r")[c].alias(c) for c in added.columns])
    return old.drop("__key").unionByName(least)


def distinct_ignoring_case(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The first spelling of each value, case ignored."""
    first = df.where(F.col(value).isNotNull()).groupBy(*keys, F.lower(value).alias("__low")).agg(F.min_by(value, F.struct(*order)).alias(value), F.min(F.struct(*order)).alias("first"))
    return first.select(*keys, value, *[F.col("first")[c].alias(c) for c in order])


def top_of(df: DataFrame, keys: list[str], order: list[Column], k: int, *, place: str = "place") -> DataFrame:
    """The first k rows of each key in an order that must be unique; Spark keeps only k of each key before the shuffle."""
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= k)


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Rows numbered from 1 in a total order: a range sort, then each range's rows are counted on from the ranges before; one row for each range reaches the driver."""
    spark = df.sparkSession
    kind = T.StructType([T.StructField("__part", T.IntegerType()), *df.schema.fields])
    ranged = checkpoint(df.orderBy(*order).withColumn("__part", F.spark_partition_id()).select("__part", *df.columns))
    sizes = sorted((r["__part"], r.n) for r in ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    before = list(accumulate((n for _, n in sizes), initial=0))
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "__part int, __before long")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return spark.createDataFrame([], kind).drop("__part").withColumn(out, F.lit(0)) if not sizes else ranged.join(F.broadcast(starts), "__part").withColumn(out, (F.col("__before") + within).cast("int")).drop("__part", "__before")


def singers(df: DataFrame, keys: list[str], order: str, mark: str, header: str, names: tuple[str, str], voice: Column) -> DataFrame:
    """`df` with `singer` and `source`: a line's own mark (P1, P2, both), else the part of the header's name, else its voice (1: P2). In songs without any mark the first solo line is P1's, else parts are swapped."""
    by_name = F.when(F.col(header) == names[0], "P1").when(F.col(header) == names[1], "P2")
    own = df.withColumn("singer", F.coalesce(F.col(mark), by_name, F.when(voice == 1, "P2").otherwise("P1")))
    own = own.withColumn("source", F.when(F.col(mark).isNotNull(), "marks").when(by_name.isNotNull(), "header").otherwise("voice"))
    w = Window.partitionBy(*keys)
    first = F.min(F.when(F.col("singer") != "both", F.struct(order, "singer"))).over(w)["singer"]
    swapped = ~F.max(F.col(mark).isNotNull()).over(w) & (first == "P2")
    other = F.when(F.col("singer") == "P1", "P2").when(F.col("singer") == "P2", "P1").otherwise(F.col("singer"))
    return own.withColumn("__swap", F.coalesce(swapped, F.lit(False))).withColumn("singer", F.when(F.col("__swap"), other).otherwise(F.col("singer"))).drop("__swap")


def pick_file(folders: DataFrame, files: DataFrame, folder: str, stem: str, name: str, extensions: list[str]) -> DataFrame:
    """`folders` with `status` and `name`: the file of one of the extensions named like the stem, else the only one (`found`), else nothing (`none`, `ambiguous`): never a guess."""
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    of = files.where(extension.isin(extensions)).join(folders.select(folder, stem), folder)
    exact = F.min(F.when(F.regexp_replace(name, r"\.[^.]*$", "") == F.col(stem), F.col(name)))
    counted = of.groupBy(folder).agg(F.count(F.lit(1)).alias("__n"), exact.alias("__exact"), F.min(name).alias("__any"))
    one = F.coalesce("__exact", F.when(F.col("__n") == 1, F.col("__any")))
    status = F.when(F.col("__n").isNull(), "none").when(one.isNotNull(), "found").otherwise("ambiguous")
    return folders.join(counted, folder, "left").withColumn("status", status).withColumn(name, one).drop("__n", "__exact", "__any")
