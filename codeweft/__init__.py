"""Code-graph analytics on Spark: DataFrame operators over property-graph tables."""

import sys

from pyspark import cloudpickle

# Python workers get the package's functions by value, so it need not be installed or on a path where they run.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
