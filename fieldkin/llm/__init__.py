"""Operators of a training-data pipeline.

Task functions travel to the executors by value, so a cluster needs this package on
the driver only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
