"""Operators for preparing training data: scoring, deduplication, scanning, sharding and packing of documents."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so that these need not have it on their import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
