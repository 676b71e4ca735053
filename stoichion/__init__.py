"""Reaction-network analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
