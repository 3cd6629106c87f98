"""marlstone: statistics, record linkage, validation and text data on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions travel to the executors by value: those need no copy of this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
