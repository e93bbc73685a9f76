"""Operators of a training-data pipeline over text; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to executors by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
