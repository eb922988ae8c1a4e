"""Streams of files: event-time windows, sessions, keyed state, idempotent merges."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.windows import newest
from cadenza.session import checkpoint


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    checkpoint(spark.range(1))  # sets the folder where the session has none
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str, *, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream; the schema is that of the files there are."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and gives its result, which lies in the shared folder."""
    spark = stream.sparkSession
    out, state = shared_folder(spark, "stream"), shared_folder(spark, "state")
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def tumbling(events: DataFrame, at: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Counts by event-time window and keys; rows later than `late` are dropped by the watermark, as a stream must."""
    windows = events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return windows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, at: str, gap: str, keys: list[str], *, late: str | None = None) -> DataFrame:
    """Sessions that a pause of `gap` or more ends: start, last event and count. Works on tables and streams."""
    source = events.withWatermark(at, late) if late else events
    found = source.groupBy(*keys, F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last"))
    return found.select(*keys, F.col("session_window.start").alias("start"), "last", "n")


def sliding(events: DataFrame, at: str, width: str, step: str, late: str, keys: list[str]) -> DataFrame:
    """As tumbling, with windows that begin every `step` and overlap."""
    windows = events.withWatermark(at, late).groupBy(F.window(at, width, step), *keys).agg(F.count(F.lit(1)).alias("n"))
    return windows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def running_best(events: DataFrame, key: str, value: str) -> DataFrame:
    """Emits each key's new largest value as batches come in, its state kept between them."""
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        best = max((float(b[value].max()) for b in batches if b[value].notna().any()), default=None)
        if best is not None and (before is None or best > before):
            state.update((best,))
            yield pd.DataFrame({key: [k[0]], "best": [best]})

    return events.select(key, value).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, best double", "best double", "append", "NoTimeout")


def dashboard(stream: DataFrame, key: str, status: str, values: list[str]) -> DataFrame:
    """Counts by key and status of all that has come so far: the whole table of them anew each time (output mode complete)."""
    spark, name = stream.sparkSession, f"board_{uuid.uuid4().hex}"
    counts = stream.groupBy(key).agg(*[F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values], F.count(F.lit(1)).alias("total"))
    counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", shared_folder(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


#: Keys are spread over so many folders, of which a batch rewrites those that it touches.
BUCKETS = 64


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """By bucket, the versions of it in the folder."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    for s in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v*/__bucket=*")) or []:
        parts = s.getPath().toString().split("/")
        found.setdefault(int(parts[-1].split("=")[1]), []).append(int(parts[-2][1:]))
    return found


def merge_newest(stream: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Keeps the newest row of each key in the folder `path`; a repeated batch writes the same version again.

    A batch reads and writes only the buckets of its keys: the latest version
    of each before it, and one version of its own.
    """
    spark = stream.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("__bucket", bucket)
        touched = {r["__bucket"] for r in batch.select("__bucket").distinct().collect()}
        before = {b: max(n for n in of if n < number) for b, of in _versions(spark, path).items() if b in touched and min(of) < number}
        known = batch
        for n in sorted(set(before.values())):
            folders = [f"{path}/v{n}/__bucket={b}" for b, v in before.items() if v == n]
            known = known.unionByName(spark.read.schema(batch.schema).option("basePath", f"{path}/v{n}").parquet(*folders).select(*batch.columns))
        newest(known, keys, order).select(*batch.columns).write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/v{number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def latest_version(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows that merge_newest keeps: the last version of each bucket."""
    last: dict[int, list[str]] = {}
    for b, of in _versions(spark, path).items():
        last.setdefault(max(of), []).append(f"{path}/v{max(of)}/__bucket={b}")
    out = spark.createDataFrame([], schema)
    for n in sorted(last):
        out = out.unionByName(spark.read.schema(schema).parquet(*last[n]))
    return out
