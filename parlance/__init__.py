"""Conversation analytics on Spark: an append-only record of meetings, segments, turns and voices as DataFrames."""

import sys

from pyspark import cloudpickle

# Task code travels with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
