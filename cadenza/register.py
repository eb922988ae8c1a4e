"""Functions by name for SQL: register_all(spark) makes them known to a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import pandas as pd

from cadenza.functions import similarity as S
from cadenza.functions.wording import numbers_in_words
from cadenza.sources.songs import decode_text


def _two(f, kind: T.DataType):
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(apply, kind)


def _one(f):
    def apply(a: pd.Series) -> pd.Series:
        return a.map(f, na_action="ignore")

    return F.pandas_udf(apply, T.StringType())


def functions() -> dict:
    """The functions by their SQL names."""
    return {
        "fold_word": _one(S.fold_word), "normal_name": _one(S.normal_name), "block_ratio": _two(S.block_ratio, T.DoubleType()), "indel_ratio": _two(S.indel_ratio, T.DoubleType()),
        "swap_distance": _two(S.osa, T.IntegerType()), "similar_words": _two(S.similar_words, T.BooleanType()), "numbers_in_words": _two(numbers_in_words, T.StringType()), "decode_text": decode_text,
    }


def register_all(spark: SparkSession) -> list[str]:
    """Registers all functions with a session; their names."""
    for name, f in functions().items():
        spark.udf.register(name, f)
    return sorted(functions())


def with_table(spark: SparkSession, df: DataFrame, name: str, sql: str) -> DataFrame:
    """A SQL statement over a DataFrame under a name, with the functions known."""
    register_all(spark)
    return spark.sql(sql, **{name: df})
