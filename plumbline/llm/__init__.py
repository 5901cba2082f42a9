"""Training-data operators.  Nothing else in the package imports this subpackage."""

import sys

from pyspark import cloudpickle

# Tasks receive these functions by value, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
