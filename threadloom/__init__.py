"""Spark-native analytics for conversation, decision and document data.

Functions shipped to Python workers are pickled by value, so executors need
neither this package nor the driver's working directory.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
