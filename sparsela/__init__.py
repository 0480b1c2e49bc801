"""Spark-native analytics over labelled sparse matrices kept as long tables.

Functions that run on executors are pickled by value, so that a cluster needs
no copy of this package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
