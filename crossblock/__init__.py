"""Spark jobs for building, checking and analysing crossed 2x2 evaluation tables."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
