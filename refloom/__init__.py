"""Cross-reference analytics on Spark: DataFrames in, findings and reports out."""

import sys

from pyspark import cloudpickle

# functions travel to executors by value, so these need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
