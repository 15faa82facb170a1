"""Operators for preparing training data; nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# What runs on workers travels with the query, so they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
