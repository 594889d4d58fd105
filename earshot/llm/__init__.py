"""Operators of a training-data pipeline; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Python workers get these modules with the task, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
