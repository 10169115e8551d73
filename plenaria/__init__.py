"""Plenary-debate analytics and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the executors by value, so that a cluster needs no
# copy of this package on its workers' path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
