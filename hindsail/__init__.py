"""Analog forecasting and forecast evaluation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their jobs, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
