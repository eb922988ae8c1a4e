"""Cadenza: analytics over libraries of timed text, on Spark DataFrames.

Functions that reach Python workers are pickled by value, so executors need
no copy of this package and no files are shipped to machine-local folders.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
