"""Skytally: aerial survey and annotation analytics expressed as Spark plans."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so that a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
