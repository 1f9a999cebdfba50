"""Operators of a training-data pipeline."""

import sys

from pyspark import cloudpickle

# Executors need not have this package: its functions are shipped by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
