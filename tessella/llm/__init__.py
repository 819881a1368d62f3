"""Corpus operators for building training data: quality, duplicates, leaks, scoring, mixing.

Nothing else in the package imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
