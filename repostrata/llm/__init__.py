"""Operators for building training corpora, each usable on its own."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
