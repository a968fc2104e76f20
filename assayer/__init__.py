"""A PySpark-native engine for code-quality, security and corpus analytics."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job: a cluster's Python workers
# need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
