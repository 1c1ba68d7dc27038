"""Spark-native content inventory and sensitive-data analytics engine."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code with them, so that nothing must be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
