"""Operators for preparing text corpora; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
