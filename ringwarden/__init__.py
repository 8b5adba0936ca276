"""ringwarden: call-risk analytics and corpus preparation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
