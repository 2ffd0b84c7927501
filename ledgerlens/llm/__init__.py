"""Operators for preparing training data at scale.

Functions that run in Spark's Python workers are sent by value, so that
executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
