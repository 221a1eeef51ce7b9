"""Operators for preparing training text at scale; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Tasks get these functions by value, and classes by `workers.shipped`, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
