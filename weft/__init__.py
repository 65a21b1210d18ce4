"""Weft: Spark-native analytics for paired model evaluation, sequence data and text corpora."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
