"""Operators for training-data pipelines: deduplication, filtering, mixing, formatting and packing."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks are shipped with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
