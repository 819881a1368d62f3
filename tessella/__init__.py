"""Customer analytics on Spark: profiling, cleaning, features, transforms, scaling, clustering and comparison."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
