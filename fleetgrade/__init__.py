"""Quality grading of script fleets as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Kernels of this package travel with the task, so workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
