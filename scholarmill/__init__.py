"""Scholarmill: research-output analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
