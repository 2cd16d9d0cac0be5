"""Retrieval analytics over document collections on Spark.

Executors may lack this package, so functions that run there are pickled by value.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
