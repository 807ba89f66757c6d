"""Data mining, analytics and corpus preparation as DataFrame programs."""

import sys

from pyspark import cloudpickle

# Functions of the library travel to executors by value, so they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
