"""Operators of a training-data pipeline: url filters, packing, near copies, secrets, search, mixing, models, sharding."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
