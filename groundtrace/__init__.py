"""Spark-native analytics over recorded position tracks and areas of interest."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Executors need not have this package installed: its functions travel by value.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
