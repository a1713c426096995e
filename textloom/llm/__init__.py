"""Operators of a training-data pipeline: sharding, token counts, archives, filters, near-duplicate joins, search."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
