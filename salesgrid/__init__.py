"""Sales analytics over monthly facts, written as plain PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
