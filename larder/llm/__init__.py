"""Operators for building training corpora. Nothing else in the library imports this package.

The functions that run inside tasks travel to the executors by value, so a cluster needs no copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
