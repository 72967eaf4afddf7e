"""Robust distributed linear models as Spark jobs over tables.

The package is shipped to executors by value, so a cluster needs no copy of it on
the Python path of its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
