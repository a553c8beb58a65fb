"""Training-data operators over documents, pages and conversations."""

import sys

from pyspark import cloudpickle

# What tasks run travels to the executors by value, so they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
