"""Spark-native tables of annotated sequences: prepare, split, score, evaluate."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run in Python workers travel with the task, so executors need nothing
# but PySpark, NumPy and pandas installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
