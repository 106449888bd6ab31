"""Operators for building training data from a corpus; nothing else in the library imports this subpackage.

Functions of this subpackage travel to the executors by value, so it need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
