"""Microbial abundance-profile analytics as plain Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with their code, so that executors need
# no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
