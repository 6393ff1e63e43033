"""Spark operators that audit tables of labelled entities related by shared attribute values."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job: workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
