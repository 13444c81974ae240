"""Operators of a training-data pipeline (one module each) and their queries.

Functions that Spark ships to executors are pickled by value, so a cluster
needs no installed copy of this package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
