"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage; it imports nothing from
the rest of the library either, so either side can be removed on its own.
Functions that run in Python workers are pickled by value, so executors need
no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
