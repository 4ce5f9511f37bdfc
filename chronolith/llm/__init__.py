"""Training-data operators: each module holds one operator, ``queries`` the registered queries."""

import sys

from pyspark import cloudpickle

# Functions go to Python workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
