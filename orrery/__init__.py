"""orrery: a Spark-first analytics engine for document and exam-item corpora."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers go by value: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
