"""Analytics over ordered histories of item draws, on Spark."""

import sys

from pyspark import cloudpickle

# Kernels travel with the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
