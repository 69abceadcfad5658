"""Training-data operators: one module per operator, queries in ``queries.py``."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors by value, so a
# cluster needs no copy of it on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
