"""graphloom: knowledge-graph analytics expressed as Spark DataFrame plans."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Executors need no copy of this package: its functions travel by value.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
