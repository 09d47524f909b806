"""A Spark-first engine for ranked retrieval and relationship-graph analytics."""

import sys

from pyspark import cloudpickle

# Python workers get functions by value: executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
