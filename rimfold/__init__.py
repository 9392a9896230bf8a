"""rimfold: Spark-first analytics for elliptical features, rasters and their scoring."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
