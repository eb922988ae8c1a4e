"""Access to tables, checkpoints and the few settings that operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, its lineage cut.

    The folder is the one in spark.checkpoint.dir. Only where that is unset
    and Spark runs in a single process (tests), a temporary folder serves; it
    is removed at the end.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="cadenza-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def unsent(df: DataFrame) -> DataFrame:
    """`df` marked so that a join with it sorts both sides and broadcasts neither.

    For rows that a list or a Python function multiplies: the size estimate
    doesn't count those, so a side that looks small enough to be broadcast
    could fill the driver's memory.
    """
    return df.hint("merge")


class Shared:
    """A value sent to every task once. It may hold objects of this package: unlike a plain broadcast it travels by value, so executors need no copy of the package."""

    def __init__(self, broadcast: Broadcast):
        self.broadcast = broadcast
        self.loaded: list = []

    def __reduce__(self) -> tuple:
        return Shared, (self.broadcast,)

    @property
    def value(self) -> Any:
        if not self.loaded:
            self.loaded.append(cloudpickle.loads(self.broadcast.value))
        return self.loaded[0]

    def destroy(self) -> None:
        self.broadcast.destroy()


def share(spark: SparkSession, value: Any) -> Shared:
    """Sends a value of proven size to the executors, for functions that use its `value`."""
    return Shared(spark.sparkContext.broadcast(cloudpickle.dumps(value)))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; for files, their size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
