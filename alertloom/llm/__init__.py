"""Operators for the preparation of training text; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
