"""Operators for preparing training text. Nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value: they need no install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
