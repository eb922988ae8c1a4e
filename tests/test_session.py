"""What executors need: nothing of the package."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from cadenza.session import share
from cadenza.sources.delimited import Grammar, parse_lines
from cadenza.kernels.align import align

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
held = share(spark, Grammar("a,b", 2, separator=","))
got = spark.range(1).select(F.pandas_udf(lambda s: s.map(lambda _: len(held.value.record(0)[0])), "long")("id")).first()[0]
df = spark.createDataFrame([(1, 1, "sun"), (1, 2, "moon")], "k int, n int, w string")
lines = spark.createDataFrame([('"a"\\tb',)], "raw string")
assert got == 2 and align(df, df, "k", "n", "w").count() == 2 and parse_lines(lines, "raw", ["x", "y"], required=[], checked=[]).where("reason is null").count() == 1
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith(("SPARK", "PYSPARK"))}
    run = subprocess.run([sys.executable, "-c", CODE.format(repo=repo)], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-2000:]
