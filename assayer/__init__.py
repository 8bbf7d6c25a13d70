"""Spark-native analytics over evaluation evidence.

Functions shipped to executors are pickled by value, so a cluster only needs
the job's own driver to have this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
