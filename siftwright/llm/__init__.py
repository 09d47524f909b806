"""Training-data operators: scans, packing, sharding, dedup, mixing and archives.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Python workers get these functions by value: executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
