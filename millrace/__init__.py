"""Analytics on Spark DataFrames: tables, text, pixel arrays and many time series at once."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so no py-files need shipping.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
