"""Operators that prepare training text: one module each, queries in ``queries``."""

import sys

from pyspark import cloudpickle

# Executors need not have this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
