"""Operators for preparing training corpora. Nothing outside this subpackage imports it."""

import sys

import pyspark.cloudpickle as cloudpickle

# Functions sent to Python workers travel by value, so a worker needs no copy of the package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
