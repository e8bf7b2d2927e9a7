"""Operators of a training-data pipeline over ``documents`` and its neighbours.

Functions that run in Python workers are shipped by value, so workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
