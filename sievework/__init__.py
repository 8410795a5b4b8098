"""Record curation on Spark: declarative DataFrame operators for overlapping, unreliable feeds."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
