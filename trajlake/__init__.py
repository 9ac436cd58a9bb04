"""Trajectory and event analytics on Spark: position logs, instants, events, replays, scores."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with their jobs, so that executors need
# numpy and pandas but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
